"""Packets that wait in keyed state for their stream's parameters.

A container may send a stream's packets before it says what the stream is. Here both are streams: packets, and parameters as
rows of their own, which may come in any micro-batch. A packet whose stream has parameters goes on at once; another one waits in
the state of its key until they come, until its time is over, or until the stream is said to have ended, and then goes on with an
InvalidInput error. What goes on carries its stream's parameters, so decoding is the same stateless pass as for tables. State is
kept by Spark and restored from the checkpoint, so each packet goes on once, whatever restarts.

Packets of one stream are dealt over `salts` keys by frame number, as a stream may hold most of all packets; parameters go to all of
these keys. A key's state is its waiting packets and one row.

Defined cases: parameters that contradict each other give their error to the packets that wait and to all later ones, until better ones
come; the last parameters hold for packets that come after them; parameters that are not complete are as none; packets with
null chunk go on like others; a null stream_id is a stream of its own; an end without packets says nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import errors as E
from ..functions import formats as S
from ..operators import codec

#: Keys to which the packets of one stream are dealt, and packets that go into state, and out of it, together.
SALTS, TOGETHER = 32, 256
PACKET, PARAMETERS, END = 0, 1, 2
HEAD = "frame_no bigint, pts bigint, chunk binary"
CONFIG = "fourcc string, width int, height int, num_slices int, variant string"
READY = f"stream_id string, {HEAD}, {CONFIG}"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Waiting(StatefulProcessor):
    """The state of one key: its stream's parameters, and the packets that wait for them."""

    def __init__(self, wait_ms: int | None):
        self._wait = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._config = handle.getValueState("config", CONFIG)
        self._packets = handle.getListState("packets", HEAD)

    def _released(self, key: tuple, config: tuple) -> Iterator[pd.DataFrame]:
        waiting = iter(self._packets.get())
        while some := list(islice(waiting, TOGETHER)):
            yield self._rows(key, some, config)
        self._packets.clear()

    @staticmethod
    def _rows(key: tuple, packets: list[tuple], config: tuple) -> pd.DataFrame:
        columns = [x.split()[0] for x in READY.split(", ")]
        out = pd.DataFrame([(key[0], *p, *config) for p in packets], columns=columns, dtype=object)
        return out.astype({c: "Int64" for c in ("frame_no", "pts")} | {c: "Int32" for c in ("width", "height", "num_slices")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        none = (None, None, None, None, "InvalidInput")
        config = tuple(self._config.get()) if self._config.exists() else None
        given, ended, ready = config, False, []
        for batch in rows:
            for r in batch.itertuples(index=False):
                if r.kind == PACKET:
                    packet = (*(None if pd.isna(x) else int(x) for x in (r.frame_no, r.pts)), r.chunk)
                    ready.append(packet)
                elif r.kind == PARAMETERS:
                    given = (r.fourcc, *(None if pd.isna(x) else int(x) for x in (r.width, r.height, r.num_slices)), r.variant)
                else:
                    ended = True
            if config is not None and ready:
                yield self._rows(key, ready, config)
            for k in range(0, len(ready) if config is None else 0, TOGETHER):
                self._packets.appendList(ready[k : k + TOGETHER])
            ready = []
        if given is not None:
            if given != config:
                self._config.update(given)
            yield from self._released(key, given)
        elif ended:
            yield from self._released(key, none)
        elif self._wait is not None and self._packets.exists() and not list(self._handle.listTimers()):
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._released(key, (None, None, None, None, "InvalidInput"))

    def close(self) -> None:
        pass


def control(params: DataFrame) -> DataFrame:
    """Rows of a stream of parameters: (stream_id, kind, CONFIG) from (stream_id, fourcc, width, height, extradata, ended). A row whose
    ended holds says that the stream has no more packets; incomplete parameters are left out."""
    read = S.stream_config(params.where(~F.coalesce("ended", F.lit(False))))
    known = read.where(~F.col("deferred") | F.col("error").isNotNull()).select("stream_id", F.lit(PARAMETERS).alias("kind"), "fourcc", "width", "height", "num_slices", F.col("error.variant").alias("variant"))
    ends = params.where("ended").select("stream_id", F.lit(END).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in CONFIG.split(", "))))
    return known.unionByName(ends)


def with_parameters(packets: DataFrame, params: DataFrame, wait_ms: int | None = None, salts: int = SALTS) -> DataFrame:
    """A stream of READY from the streams packets(stream_id, frame_no, pts, chunk) and params, as `control` takes them."""
    nulls = lambda ddl: [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in ddl.split(", "))]
    salt = F.pmod(F.coalesce("frame_no", F.lit(0)), F.lit(salts)).cast("int").alias("salt")
    own = packets.select("stream_id", salt, F.lit(PACKET).alias("kind"), *(F.col(c).cast(t) for c, t in (x.split() for x in HEAD.split(", "))), *nulls(CONFIG))
    said = control(params).select("stream_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "kind", *nulls(HEAD), *(x.split()[0] for x in CONFIG.split(", ")))
    mode = "None" if wait_ms is None else "ProcessingTime"
    return own.unionByName(said).groupBy("stream_id", "salt").transformWithStateInPandas(Waiting(wait_ms), READY, "Append", mode)


def decoded(ready: DataFrame, strict: bool = False) -> DataFrame:
    """What `codec.decode` gives for READY; a packet without usable parameters has their error."""
    out = codec.decode(ready.select(*codec.KEY, "pts", *codec.PARAMETERS, F.when(F.col("variant").isNull(), F.col("chunk")).alias("chunk"), "variant"), strict=strict, keep=("variant",))
    return out.withColumn("error", F.when(F.col("variant").isNotNull(), F.struct(F.col("variant"), F.create_map().cast("map<string,bigint>").alias("fields"))).otherwise(F.col("error")).cast(E.ERROR)).drop("variant")


def run(spark: SparkSession, packets: DataFrame, params: DataFrame, folder: str, checkpoint: str, wait_ms: int | None = None):
    """Decodes both streams and appends them to a Parquet table, each frame once: what is there now, or with wait_ms, whose end needs
    the clock, until it is stopped."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    out = decoded(with_parameters(packets, params, wait_ms))
    writer = out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    # each task of state starts a Python process of its own, so no more of them than two for each core; a checkpoint keeps its number
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", str(min(usual, 2 * spark.sparkContext.defaultParallelism)))
    try:
        return (writer.trigger(availableNow=True) if wait_ms is None else writer.trigger(processingTime="1 second")).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(usual))
