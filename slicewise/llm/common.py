"""Helpers that the corpus operators share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an Arrow batch that is sent to Python. Texts may be long, so batches are kept short.
BATCH_ROWS = 256
#: Most bits of a filter that is sent to every task, and bits of a page of it (fixed by Spark's bitmap functions).
FILTER_BITS, PAGE_BITS = 1 << 26, 1 << 15
#: Lower-cases the bytes of A-Z and leaves every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: lineage ends there, and lost executors cost no rework."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches of this session, as whole texts travel in them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str) -> DataFrame:
    """mapInArrow with a function that is made once per task and turns a batch into a dict of columns."""
    short_batches(df.sparkSession)
    fields = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield as_batch(out, fields)
            batch = out = None
        pa.default_memory_pool().release_unused()  # workers stay for later stages

    return df.mapInArrow(run, schema)


def as_batch(columns: dict, fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in fields], schema=fields)


def pa_schema(spark: SparkSession, schema: str | T.StructType) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with columns of these names out of the way, and a function that takes a result back to df's own columns."""
    moved = {c: f"__own_{c}" for c in df.columns if c in names}
    back = lambda out: out.select(*(F.col(moved.get(c, c)).alias(c) for c in df.columns))
    return df.withColumnsRenamed(moved), back


def smallest(df: DataFrame, order: Column, n: int) -> DataFrame:
    """The n rows of df, which is read twice, of smallest hash `order`. A count of the hashes' leading bits tells where to cut
    first, so that all tasks together, and not each of them, send about n rows; rows of equal hash stay together at the cut."""
    head = F.shiftright(order, 52)
    counts = dict(df.groupBy(head.alias("head")).agg(F.count(F.lit(1))).collect())  # 4096 rows at most
    seen, cut = 0, -2048
    for cut in sorted(counts):
        seen += counts[cut]
        if seen >= n:
            break
    return df.where(head <= cut).orderBy(order, *df.columns).limit(n)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(of: int, n: int) -> np.ndarray:
    """1, of, of ** 2, ... modulo 2 ** 64."""
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: Bytes whose words are hashed together, an odd factor and a number for each byte.
STRETCH, FACTOR = 1 << 20, 0xD6E8FEB86659FD93
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
UP, DOWN = powers(FACTOR, STRETCH + 1), powers(pow(FACTOR, -1, 1 << 64), STRETCH + 1)


def word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of the texts in a row, how many each text has). table takes what parts words to the space.

    A word's hash is the sum of its bytes' numbers, each times the factor to the power of its place: differences of running sums.
    """
    data, at, hashes, starts = b" ".join(texts).translate(table), 0, [], []
    while at < len(data):
        end = len(data)
        if end - at > STRETCH:  # at a space, so that no word is parted
            cut = data.rfind(b" ", at, at + STRETCH)
            end = cut if cut > at else cut if (cut := data.find(b" ", at + STRETCH)) >= 0 else end
        x = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.concatenate([[False], x != 32, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        up, down = (UP, DOWN) if len(x) <= STRETCH else (powers(FACTOR, len(x)), powers(pow(FACTOR, -1, 1 << 64), len(x)))
        total = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[x] * up[: len(x)], dtype=np.uint64)])
        first, last = edge[::2], edge[1::2]
        hashes.append(mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
        starts.append(at + first)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), begins))


def filter_of(keys: DataFrame, key: str) -> np.ndarray:
    """A bit filter of a column of 64-bit hashes, two bits for each: 16 bits a key or FILTER_BITS, whichever is less. A fuller
    filter passes more keys that are not in it, never fewer that are."""
    many = keys.count()
    bits = min(FILTER_BITS, max(PAGE_BITS, 1 << (16 * many).bit_length()))
    places = F.array(*(F.shiftrightunsigned(key, by).bitwiseAND(F.lit(bits - 1)) + 1 for by in (0, 32)))
    pages = keys.select(F.explode(places).alias("k")).groupBy(F.bitmap_bucket_number("k").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pages.collect():  # FILTER_BITS at most
        out[(r.page - 1) * PAGE_BITS // 8 : r.page * PAGE_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def passing(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which hashes may be in a filter."""
    keys, most, out = keys.view(np.uint64), np.uint64(8 * len(bits) - 1), None
    for by in (0, 32):
        at = (keys >> np.uint64(by)) & most
        own = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        out = own if out is None else out & own
    return out.astype(bool)


def as_bytes(name: str = "text") -> F.Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(name)
