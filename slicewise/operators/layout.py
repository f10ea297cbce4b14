"""Decode-free inspection of payloads: where planes and slices lie, and what the descriptors say."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import errors as E
from ..functions import formats as S
from .codec import KEY, PARAMETERS, PLANE, configured
from .kernels import UNUSED

#: The numerator of a Kraft sum stops here.
MOST = 2**128 - 1
STATISTICS = ["zero_count", "absent_count", "active_symbol_count", "min_code_length", "max_code_length", "min_code_length_symbol_count", "code_length_histogram"]


def peek_frame_info(chunk: Column) -> Column:
    """The last dword, null for a payload under four bytes."""
    return F.when(F.octet_length(chunk) >= 4, S.u32le(chunk, F.octet_length(chunk) - 4))


def lengths_of(descriptor: Column) -> Column:
    """The 256 bytes as numbers, read four at a time."""
    part = lambda x, by: F.call_function("shiftright", x, F.lit(by)).bitwiseAND(F.lit(255)).cast("int")
    four = lambda k: S.let(F.conv(F.hex(F.substring(descriptor, 4 * k + 1, F.lit(4))), 16, 10).cast("bigint"), lambda x: F.array(*(part(x, by) for by in (24, 16, 8, 0))))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), four))


def statistics(lengths: Column) -> dict[str, Column]:
    """What a descriptor's 256 lengths say, by name, as `codec.statistics` says it."""
    coded = F.sort_array(F.array_remove(F.array_remove(lengths, F.lit(0)), F.lit(UNUSED)))

    def of(some: Column) -> Column:
        used = F.array_distinct(some)
        begin = F.transform(used, lambda k: F.array_position(some, k).cast("int"))
        return S.let(begin, lambda at: F.transform(at, lambda b, i: F.struct(F.get(some, b - 1).alias("code_length"), (F.coalesce(F.get(at, i + 1), F.size(some) + 1) - b).alias("count"))))

    tiers = S.let(coded, of)
    count = lambda n: F.size(lengths) - F.size(F.array_remove(lengths, F.lit(n)))
    parts = {"zero_count": count(0), "absent_count": count(UNUSED), "active_symbol_count": F.size(coded)}
    ends = lambda t: F.struct(
        F.get(t, F.lit(0))["code_length"].alias("min_code_length"), F.when(F.size(t) > 0, F.element_at(t, -1)["code_length"]).alias("max_code_length"),
        F.coalesce(F.get(t, F.lit(0))["count"], F.lit(0)).alias("min_code_length_symbol_count"), t.alias("code_length_histogram"),
    )
    rest = S.let(tiers, ends)
    return parts | {"rest": rest}


def scanned(packets: DataFrame, codes: bool = True) -> DataFrame:
    """packets with layout, frame_info and error as `codec.parsed` gives them without looking at the codes, as columns: the planes'
    places follow from one another, so one fold over the planes finds them, and the first fault ends it. codes: with the descriptors'
    statistics, else these are null."""
    chunk, f, n = F.col("chunk"), F.col("fourcc"), F.col("num_slices")
    stop = F.octet_length(chunk) - 4
    short = lambda at, needed, have: E.error("ChunkTooShort", offset=at, needed=needed, have=have)
    left = lambda at: F.greatest(F.lit(0), stop - at)

    def one(state: Column, p: Column) -> Column:
        """The state (at, error, planes) after a plane."""
        begin = state["at"]
        tables = begin + 256
        data = tables + 4 * n
        ends = F.when(data <= stop, F.transform(F.sequence(F.lit(0), n - 1), lambda k: S.u32le(chunk, (tables + 4 * k).cast("int"))))

        def with_ends(ends: Column) -> Column:
            before = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0))
            odd = F.get(F.filter(F.sequence(F.lit(0), n - 1), lambda k: (F.get(ends, k) < before(k)) | (F.get(ends, k) % 4 != 0)), F.lit(0))
            last = F.element_at(ends, -1)
            error = E.first_of(
                (tables > stop, short(begin, F.lit(256), left(begin))),
                (data > stop, short(tables, 4 * n, left(tables))),
                (odd.isNotNull() & (F.get(ends, odd) < before(odd)), E.error("NonMonotonicSliceOffsets")),
                (odd.isNotNull(), E.error("SliceNotWordAligned", offset=F.get(ends, odd))),
                (data + last > stop, short(data, last, left(data))),
            )
            plane = F.struct(p.alias("plane_idx"), begin.cast("bigint").alias("offset"), ends.alias("ends"))
            return S.let(error, lambda e: F.struct((data + F.coalesce(last, F.lit(0))).cast("bigint").alias("at"), e.alias("error"), F.when(e.isNull(), F.concat(state["planes"], F.array(plane))).otherwise(state["planes"]).alias("planes")))

        return F.when(state["error"].isNotNull(), state).otherwise(S.let(ends, with_ends))

    bad = E.first_of((chunk.isNull() | ~S.known(f) | F.col("width").isNull() | F.col("height").isNull() | n.isNull(), E.error("InvalidInput")), (stop < 0, E.error("MissingFrameInfo")))
    none = F.array().cast("array<struct<plane_idx:int,offset:bigint,ends:array<bigint>>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast(E.ERROR).alias("error"), none.alias("planes"))
    walked = F.aggregate(F.sequence(F.lit(0), S.plane_count(f) - 1), start, one)
    out = packets.withColumn("_bad", bad).withColumn("_w", F.when(F.col("_bad").isNull(), walked))
    rest = F.when(F.col("_w.at") != stop, short(F.col("_w.at"), stop - F.col("_w.at"), F.lit(0)))
    out = out.withColumn("error", F.coalesce("_bad", "_w.error", rest))

    def plane(x: Column) -> Column:
        pw, ph = S.plane_width(f, x["plane_idx"], F.col("width")), S.plane_height(f, x["plane_idx"], F.col("height"))
        tables = x["offset"] + 256
        data = tables + 4 * n
        part = lambda e, k: F.struct(
            k.alias("slice_idx"), (data + F.coalesce(F.get(x["ends"], k - 1), F.lit(0))).alias("start"), (data + e).alias("end"), S.row_start(ph, k, n).alias("row_start"), S.row_start(ph, k + 1, n).alias("row_end")
        )
        descriptor = F.substring(chunk, (x["offset"] + 1).cast("int"), F.lit(256))
        head = [x["plane_idx"].alias("plane_idx"), S.plane_label(f, x["plane_idx"]).alias("label"), pw.alias("width"), ph.alias("height"), x["offset"].alias("offset"), tables.alias("end_offsets_start"), data.alias("slice_data_start"), descriptor.alias("descriptor"), F.transform(x["ends"], part).alias("slices")]
        if not codes:
            return F.struct(*head, *(F.lit(None).alias(name) for name in STATISTICS))

        def whole(d: Column) -> Column:
            said = statistics(d)
            return S.let(said.pop("rest"), lambda rest: F.struct(*head, *(c.alias(name) for name, c in said.items()), *(rest[name].alias(name) for name in STATISTICS if name not in said)))

        return S.let(lengths_of(descriptor), whole)

    good = F.col("error").isNull()
    out = out.withColumn("layout", F.when(good, F.transform("_w.planes", plane)).cast(f"array<{PLANE}>")).withColumn("frame_info", F.when(good, S.u32le(chunk, stop)))
    return out.select(*packets.columns, "layout", "frame_info", "error")


def frame_layout(packets: DataFrame, config: DataFrame | None = None, codes: bool = True) -> DataFrame:
    """packets' keys with the payload's length, layout, frame_info, predictor and error; codebooks are not built, slices not read."""
    read = scanned(configured(packets, config).select(*KEY, *PARAMETERS, "chunk"), codes)
    return read.select(*KEY, "num_slices", F.octet_length("chunk").cast("bigint").alias("length"), "layout", "frame_info", S.predictor_of(F.col("frame_info")).alias("predictor"), "error")


def slice_layout(frames: DataFrame) -> DataFrame:
    """A row for each slice: byte range, rows, pixels."""
    planes = frames.select(*KEY, F.explode("layout").alias("p"))
    s = planes.select(*KEY, "p.plane_idx", "p.label", F.col("p.width").alias("pw"), F.explode("p.slices").alias("s"))
    rows = F.col("s.row_end") - F.col("s.row_start")
    return s.select(
        *KEY, "plane_idx", "label", "s.slice_idx", "s.start", "s.end", (F.col("s.end") - F.col("s.start")).alias("len"), (F.col("s.end") == F.col("s.start")).alias("is_empty"),
        "s.row_start", "s.row_end", rows.alias("row_count"), (rows.cast("bigint") * F.col("pw")).alias("pixel_count"),
    )


def descriptor_lengths(frames: DataFrame) -> DataFrame:
    """(key, plane_idx, sym, code_len) of all 256 descriptor bytes."""
    planes = frames.select(*KEY, F.explode("layout").alias("p")).select(*KEY, "p.plane_idx", "p.descriptor")
    return planes.select(*KEY, "plane_idx", "descriptor", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("sym")).select(
        *KEY, "plane_idx", "sym", F.conv(F.hex(F.substring("descriptor", F.col("sym") + 1, F.lit(1))), 16, 10).cast("int").alias("code_len")
    )


@F.arrow_udf(T.StringType())
def kraft_numerator(histogram: pa.Array) -> pa.Array:
    """Sum of count * 2 ** (max - length), as digits; the numbers go beyond any column type."""

    def one(tiers: list | None) -> str:
        most = max((r["code_length"] for r in tiers or ()), default=0)
        return str(min(MOST, sum(r["count"] << (most - r["code_length"]) for r in tiers or ())))

    return pa.array(map(one, histogram.to_pylist()), pa.string())


def is_kraft_complete(histogram: Column, single: Column) -> Column:
    """Whether the tiers fold into one root: from the deepest tier up, nodes pair off without a rest."""
    step = lambda n, length: F.when(n < 0, n).otherwise(_fold(n, histogram, length))
    most = F.array_max(F.transform(histogram, lambda r: r["code_length"]))
    root = F.aggregate(F.sequence(most, F.lit(1), F.lit(-1)), F.lit(0).cast("bigint"), step)
    return F.when(single, F.lit(True)).when(F.size(histogram) == 0, F.lit(False)).otherwise(root == 1)


def _fold(n: Column, histogram: Column, length: Column) -> Column:
    own = F.aggregate(F.filter(histogram, lambda r: r["code_length"] == length), F.lit(0).cast("bigint"), lambda s, r: s + r["count"])
    return F.when((n + own) % 2 == 1, F.lit(-1).cast("bigint")).otherwise(F.floor((n + own) / 2).cast("bigint"))


def plane_layout(frames: DataFrame) -> DataFrame:
    """A row for each plane: sizes and the descriptor's statistics."""
    size = F.aggregate("p.slices", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    pixels = F.aggregate("p.slices", F.lit(0).cast("bigint"), lambda n, s: n + (s["row_end"] - s["row_start"]).cast("bigint") * F.col("p.width"))
    one = frames.select(*KEY, "num_slices", "length", F.explode("layout").alias("p"))
    starts = [F.col(f"p.{c}") for c in ("end_offsets_start", "slice_data_start")]
    out = one.select(*KEY, "num_slices", "length", "p.plane_idx", "p.label", F.col("p.width").alias("pw"), F.col("p.height").alias("ph"), F.col("p.offset").alias("descriptor_start"), *starts, size.alias("slice_data_total"), pixels.alias("total_pixels"), *(F.col(f"p.{c}") for c in STATISTICS))
    single = (F.col("zero_count") == 1) & (F.col("active_symbol_count") == 0)
    out = out.withColumn("is_single_symbol", single).withColumn("total_size", F.lit(256).cast("bigint") + 4 * F.col("num_slices") + F.col("slice_data_total"))
    out = out.withColumn("unused_symbol_count", F.lit(256) - F.col("active_symbol_count") - F.when(single, F.lit(1)).otherwise(F.lit(0)))
    return out.withColumn("kraft_numerator", kraft_numerator("code_length_histogram")).withColumn("is_kraft_complete", is_kraft_complete(F.col("code_length_histogram"), F.col("is_single_symbol")))


def frame_totals(planes: DataFrame) -> DataFrame:
    """A row for each frame: the planes' sums."""
    return planes.groupBy(*KEY).agg(F.first("length").alias("length"), F.sum("slice_data_total").alias("total_slice_data_bytes"), (F.sum("total_size") + 4).alias("total_size"), F.sum("total_pixels").alias("total_pixels"), F.every("is_kraft_complete").alias("all_planes_kraft_complete"))
