"""Streams of packets and frames, and the one-slot send/receive objects.

Frames are independent, so a stream needs no state and no watermark: a micro-batch is encoded or decoded as a table. The
session objects keep the send, receive and flush order of a codec for callers that work frame by frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import errors as E
from ..functions import formats as S
from ..operators import codec, kernels
from ..sources.planes import repacked

CODEC = {"id": "slicewise", "decode": True, "encode": True, "lossless": True, "intra_only": True, "fourccs": sorted(S.LAYOUTS)}


def encoded_packets(frames: DataFrame) -> DataFrame:
    """Packets of encoded frames: every one is a key frame, and time stamps are not carried."""
    return codec.encode(frames).withColumn("pts", F.lit(None).cast("bigint")).withColumn("keyframe", F.lit(True))


def run_stream(source: DataFrame, transform: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str):
    """Applies a transform to each micro-batch of what is there now and appends it to a table. A batch that is repeated after
    a failure replaces its own part, so that each frame is written once."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def register(spark: SparkSession) -> dict:
    """Makes the codec known to SQL, frame by frame, and tells what it can do.

    frame_info_predictor(x), encode_frame(fourcc, width, height, predictor, num_slices, planes), decode_frame(chunk, fourcc,
    width, height, num_slices), which gives planes, predictor and the variant of its error, and payload_layout of the same.
    A frame that cannot be encoded, and a payload without a layout, give null. Beside them the table functions frame_slices and
    frame_pixels of a payload's five arguments, for LATERAL joins: a row for each slice, and for each sample; a payload that cannot be
    read has none.
    """
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION frame_info_predictor(x BIGINT) RETURNS INT RETURN CAST(shiftright(x, 8) & 3 AS INT)")
    for name, (one, ddl) in FUNCTIONS.items():
        spark.udf.register(name, _by_row(spark, one, ddl))
    for name, (handler, ddl) in TABLES.items():
        spark.udtf.register(name, F.udtf(handler, returnType=ddl, useArrow=True))  # Spark does not join Arrow table functions laterally
    return CODEC | {"functions": ["frame_info_predictor", *FUNCTIONS, *TABLES]}


def _by_row(spark: SparkSession, one: Callable, ddl: str):
    kind = to_arrow_schema(T.StructType.fromDDL(f"x {ddl}")).field("x").type

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([one(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], kind)

    return F.arrow_udf(run, ddl)


def _encoded(fourcc: str, width: int, height: int, predictor: int, num_slices: int, planes: list[bytes]) -> bytes | None:
    if None in (fourcc, width, height, predictor, num_slices, planes) or None in planes or fourcc not in S.LAYOUTS or not 0 <= predictor <= 3:
        return None
    labels, shift, _ = S.LAYOUTS[fourcc]
    dims = [(width >> shift[0], height >> shift[1]) if p in (1, 2) else (width, height) for p in range(len(labels))]
    even = width % (1 << shift[0]) == 0 and height % (1 << shift[1]) == 0 and min(width, height) > 0
    if not even or [len(p) for p in planes] != [w * h for w, h in dims] or not 1 <= num_slices <= min(256, *(h for _, h in dims)):
        return None
    return codec.encode_one(fourcc, width, height, predictor, num_slices, planes)


def _decoded(*row) -> dict:
    out = codec.decode_one(*row)
    return {"planes": out["planes"], "predictor": out["predictor"] if out["error"] is None else None, "variant": out["error"] and out["error"]["variant"]}


def _layout(*row) -> list[dict] | None:
    try:
        return None if None in row or row[1] not in S.LAYOUTS else codec.walk(*row, codes=False)[0]
    except kernels.CodecError:
        return None


FUNCTIONS = {
    "encode_frame": (_encoded, "binary"),
    "decode_frame": (_decoded, "struct<planes:array<binary>,predictor:int,variant:string>"),
    "payload_layout": (_layout, f"array<{codec.PLANE}>"),
}


class FrameSlices:
    """Table function: a payload's slices, from its own table; their bits are not read."""

    def eval(self, chunk: bytes, fourcc: str, width: int, height: int, num_slices: int) -> Iterator[tuple]:
        for p in _layout(chunk, fourcc, width, height, num_slices) or ():
            for s in p["slices"]:
                yield p["plane_idx"], s["slice_idx"], s["start"], s["end"], s["row_start"], s["row_end"], (s["row_end"] - s["row_start"]) * p["width"]


class FramePixels:
    """Table function: a payload's samples, plane by plane."""

    def eval(self, chunk: bytes, fourcc: str, width: int, height: int, num_slices: int) -> Iterator[tuple]:
        for k, plane in enumerate(codec.decode_one(chunk, fourcc, width, height, num_slices)["planes"] or ()):
            wide = max(1, S.plane_size(fourcc, k, width, height)[0])
            for r, at in enumerate(range(0, len(plane), wide)):
                yield from zip(repeat(k), repeat(r), range(wide), plane[at : at + wide], strict=False)


TABLES = {
    "frame_slices": (FrameSlices, "plane_idx int, slice_idx int, start bigint, end bigint, row_start int, row_end int, pixels bigint"),
    "frame_pixels": (FramePixels, "plane_idx int, r int, c int, v int"),
}


def decoder_parameters(params: DataFrame) -> DataFrame | None:
    """(stream_id, fourcc, width, height, num_slices) of the streams that are complete, or None if none is; raises the message of
    parameters that contradict each other. params: (stream_id, fourcc, width, height, extradata), or with num_slices as they are."""
    if "extradata" not in params.columns:
        return params
    read = S.stream_config(params)
    _refuse(read)
    ready = read.where(~F.col("deferred")).select("stream_id", *codec.PARAMETERS)
    return ready if ready.limit(1).count() else None


def encoder_parameters(params: DataFrame) -> DataFrame:
    """params(stream_id, tag, pixel_format, width, height, extradata) with fourcc, num_slices and the extradata that a container is to
    write; raises the message of parameters that cannot be used."""
    read = S.encoder_config(params)
    _refuse(read)
    return read.drop("error")


def _refuse(rows: DataFrame, error: str = "error") -> None:
    if bad := rows.where(F.col(error).isNotNull()).select(F.col(error).cast(E.ERROR).alias("error")).first():
        one = rows.sparkSession.createDataFrame([bad], f"error {E.ERROR}")  # its text is made apart: together the expressions outgrow a class
        raise ValueError(one.select(E.message(F.col("error"))).first()[0])


class NeedMore(Exception):
    """Nothing is pending yet."""


class Eof(Exception):
    """Nothing is pending and nothing will come."""


class Session:
    """One slot: send fills it, receive empties it."""

    def __init__(self) -> None:
        self._pending, self._eof = None, False

    def _send(self, what: DataFrame) -> None:
        if self._pending is not None:
            raise RuntimeError("receive must be called before sending again")
        self._pending = what

    def _take(self) -> DataFrame:
        if self._pending is None:
            raise (Eof if self._eof else NeedMore)()
        what, self._pending = self._pending, None
        return what

    def flush(self) -> None:
        self._eof = True


class DecoderSession(Session):
    """Decodes on receive; parameters may come late, but a packet that is taken before they do is lost. Parameters that contradict
    each other are refused when they are given."""

    def __init__(self, config: DataFrame | None = None, strict: bool = False) -> None:
        super().__init__()
        self._config, self._strict = None if config is None else decoder_parameters(config), strict

    def configure(self, config: DataFrame) -> None:
        self._config = decoder_parameters(config)

    def send_packet(self, packet: DataFrame) -> None:
        self._send(packet)

    def receive_frame(self) -> DataFrame:
        packet = self._take()
        if self._config is None:
            raise ValueError("stream config not configured")
        return codec.decode(packet, self._config, self._strict)


class EncoderSession(Session):
    """Encodes on send. The predictor is pinned, or chosen for each frame from its first plane.

    With params (as `encoder_parameters` takes them) frames need only stream_id, frame_no, planes and, where rows are padded,
    strides; without them they carry their stream's parameters. A frame that cannot be encoded is refused when it is sent.
    """

    def __init__(self, predictor: int | None = None, params: DataFrame | None = None) -> None:
        super().__init__()
        self._predictor = predictor
        self._params = None if params is None else encoder_parameters(params)

    @property
    def output_params(self) -> DataFrame | None:
        """(stream_id, tag, pixel_format, width, height, extradata) for a container."""
        return None if self._params is None else self._params.select("stream_id", F.col("fourcc").alias("tag"), "pixel_format", "width", "height", "extradata")

    def set_predictor(self, predictor: int | None) -> None:
        self._predictor = predictor

    def send_frame(self, frames: DataFrame) -> None:
        if self._pending is not None:
            raise RuntimeError("receive must be called before sending again")
        if self._params is not None:
            frames = frames.drop(*codec.PARAMETERS).join(self._params.select("stream_id", *codec.PARAMETERS), "stream_id", "left")
            if bad := frames.where(F.col("fourcc").isNull()).select("stream_id").first():
                raise ValueError(f"stream {bad[0]} has no parameters")
        if "strides" in frames.columns:
            frames = repacked(frames)
            _refuse(frames, "stride_error")
        _refuse(frames.withColumn("error", S.input_error(*(F.col(c) for c in (*codec.PARAMETERS, "planes")))))
        pinned = frames.withColumn("predictor", F.lit(self._predictor).cast("int")) if self._predictor is not None else codec.with_predictor(frames)
        self._send(encoded_packets(pinned))

    def receive_packet(self) -> DataFrame:
        return self._take()
