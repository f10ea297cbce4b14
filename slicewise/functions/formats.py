"""Pixel layouts, plane geometry, stream parameters: column expressions over built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors as E

# FourCC -> plane labels, log2 subsampling of planes 1 and 2, source tag bytes.
LAYOUTS = {
    "ULY0": (("Y", "U", "V"), (1, 1), "59563132"),
    "ULY2": (("Y", "U", "V"), (1, 0), "59555932"),
    "ULY4": (("Y", "U", "V"), (0, 0), "59563234"),
    "ULRG": (("G", "B", "R"), (0, 0), "00000118"),
    "ULRA": (("G", "B", "R", "A"), (0, 0), "00000218"),
}
PREDICTORS = ("none", "left", "gradient", "median")
PIXEL_FORMATS = {"Yuv420P": "ULY0", "Yuv422P": "ULY2", "Yuv444P": "ULY4"}
ENCODER_VERSION, HUFFMAN_BIT, INTERLACED_BIT = 0x010000F0, 1, 0x800


def pick(fourcc: Column, values: dict[str, object]) -> Column:
    """A value for each FourCC, null for any other."""
    out = F.lit(None)
    for f, v in values.items():
        out = F.when(fourcc == f, F.lit(v)).otherwise(out)
    return out


def format_dim(spark: SparkSession) -> DataFrame:
    """(fourcc, plane_idx, label, xshift, yshift, is_rgb, has_alpha, source_tag): a row for each plane of the five layouts."""
    rows = [(f, k, label, shift[0] if k in (1, 2) else 0, shift[1] if k in (1, 2) else 0, label in "GBRA" and f.startswith("ULR"), f == "ULRA", tag) for f, (labels, shift, tag) in LAYOUTS.items() for k, label in enumerate(labels)]
    return spark.createDataFrame(rows, "fourcc string, plane_idx int, label string, xshift int, yshift int, is_rgb boolean, has_alpha boolean, source_tag string")


def known(fourcc: Column) -> Column:
    return F.coalesce(fourcc.isin(*LAYOUTS), F.lit(False))


def as_number(fourcc: Column) -> Column:
    """The first four bytes of a tag as one number, null for none."""
    return F.conv(F.hex(F.substring(fourcc.cast("binary"), 1, 4)), 16, 10).cast("bigint")


def plane_count(fourcc: Column) -> Column:
    return pick(fourcc, {f: len(x[0]) for f, x in LAYOUTS.items()}).cast("int")


def is_rgb_family(fourcc: Column) -> Column:
    return fourcc.isin("ULRG", "ULRA")


def has_alpha(fourcc: Column) -> Column:
    return fourcc == "ULRA"


def source_format_tag(fourcc: Column) -> Column:
    return F.unhex(pick(fourcc, {f: x[2] for f, x in LAYOUTS.items()}))


def plane_label(fourcc: Column, idx: Column) -> Column:
    return F.get(pick_array(fourcc), idx)


def pick_array(fourcc: Column) -> Column:
    out = F.lit(None).cast("array<string>")
    for f, x in LAYOUTS.items():
        out = F.when(fourcc == f, F.array(*map(F.lit, x[0]))).otherwise(out)
    return out


def plane_width(fourcc: Column, idx: Column, width: Column) -> Column:
    """Width of a plane; 0 for a plane that a subsampled layout does not have."""
    return F.when(~fourcc.isin("ULY0", "ULY2") | (idx == 0), width).when(idx > 2, F.lit(0)).otherwise(F.shiftright(width, 1)).cast("int")


def plane_size(fourcc: str, idx: int, width: int, height: int) -> tuple[int, int]:
    """Width and height of a plane of a known layout."""
    shift = LAYOUTS[fourcc][1] if idx in (1, 2) else (0, 0)
    return width >> shift[0], height >> shift[1]


def plane_height(fourcc: Column, idx: Column, height: Column) -> Column:
    return F.when(~fourcc.isin("ULY0", "ULY2") | (idx == 0), height).when(idx > 2, F.lit(0)).when(fourcc == "ULY0", F.shiftright(height, 1)).otherwise(height).cast("int")


def dims_error(fourcc: Column, width: Column, height: Column) -> Column:
    odd = lambda x: x % 2 == 1
    rule = F.when((width <= 0) | (height <= 0), 1).when((fourcc == "ULY0") & (odd(width) | odd(height)), 2).when((fourcc == "ULY2") & odd(width), 3)
    return E.first_of((~known(fourcc), E.error("UnknownFourcc", fourcc=as_number(fourcc))), (rule.isNotNull(), E.error("DimensionConstraint", width=width, height=height, rule=rule)))


def predictor_of(frame_info: Column) -> Column:
    return F.shiftright(frame_info.cast("bigint"), 8).bitwiseAND(F.lit(3)).cast("int")


def frame_info_of(predictor: Column) -> Column:
    return F.shiftleft(predictor.cast("bigint"), 8)


def u32le(data: Column, at: Column | int) -> Column:
    """The little-endian dword at a byte offset (from 0) of a binary column, as BIGINT."""
    at = F.lit(at) if isinstance(at, int) else at
    h = lambda k: F.hex(F.substring(data, at + F.lit(k + 1), F.lit(1)))
    return F.conv(F.concat(h(3), h(2), h(1), h(0)), 16, 10).cast("bigint")


def dword(value: Column) -> Column:
    """Four little-endian bytes of a BIGINT below 2**32."""
    h = F.lpad(F.hex(value.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))))


def extradata_error(data: Column) -> Column:
    flags = u32le(data, 12)
    return E.first_of(
        (F.octet_length(data) < 16, E.error("ExtradataTruncated", len=F.octet_length(data))),
        (u32le(data, 8) != 4, E.error("InvalidFrameInfoSize", size=u32le(data, 8))),
        (flags.bitwiseAND(F.lit(HUFFMAN_BIT)) == 0, E.error("HuffmanBitClear")),
        (flags.bitwiseAND(F.lit(INTERLACED_BIT)) != 0, E.error("InterlacedNotSupported")),
    )


def extradata(data: Column) -> Column:
    """STRUCT of the four fields; null where extradata_error is not."""
    fields = F.struct(u32le(data, 0).alias("encoder_version"), F.substring(data, 5, 4).alias("source_format_tag"), u32le(data, 8).alias("frame_info_size"), u32le(data, 12).alias("flags"))
    return F.when(extradata_error(data).isNull(), fields)


def slice_count(flags: Column) -> Column:
    return (F.shiftright(flags, 24).bitwiseAND(F.lit(255)) + 1).cast("int")


def build_extradata(fourcc: Column, n: Column) -> Column:
    """The 16 bytes for a layout and a slice count; null outside 1..256."""
    flags = F.lit(1).cast("bigint") + F.shiftleft(n.cast("bigint") - 1, 24)
    data = F.concat(dword(F.lit(ENCODER_VERSION)), source_format_tag(fourcc), dword(F.lit(4)), dword(flags))
    return F.when(n.between(1, 256), data)


def config_error(fourcc: Column, width: Column, height: Column, data: Column) -> Column:
    """What a stream's parameters fail by: extradata first, then dimensions."""
    return F.coalesce(extradata_error(data), dims_error(fourcc, width, height))


def stream_config(params: DataFrame) -> DataFrame:
    """Decoder parameters (fourcc, width, height, extradata) with num_slices, deferred (something is missing) and error."""
    f, w, h, x = (F.col(c) for c in ("fourcc", "width", "height", "extradata"))
    missing = ~known(f) | w.isNull() | h.isNull() | x.isNull() | (F.octet_length(x) == 0)
    out = params.withColumn("deferred", missing).withColumn("error", F.when(~missing, config_error(f, w, h, x)))
    return out.withColumn("num_slices", F.when(~missing & F.col("error").isNull(), slice_count(extradata(x)["flags"])))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encoder_config(params: DataFrame) -> DataFrame:
    """Encoder parameters (tag, pixel_format, width, height, extradata): the tag wins, empty extradata means one slice."""
    w, h, given = (F.col(c) for c in ("width", "height", "extradata"))

    def of(f: Column) -> Column:
        data = F.when(given.isNull() | (F.octet_length(given) == 0), build_extradata(f, F.lit(1))).otherwise(given)
        return let(data, lambda x: let(error(f, x), lambda e: F.struct(f.alias("fourcc"), x.alias("extradata"), e.alias("error"), F.when(e.isNull(), slice_count(u32le(x, 12))).alias("num_slices"))))

    def error(f: Column, x: Column) -> Column:
        return F.when(f.isNull() | w.isNull() | h.isNull(), E.error("InvalidInput")).otherwise(config_error(f, w, h, x))

    fourcc = F.coalesce(F.when(known(F.col("tag")), F.col("tag")), pick(F.col("pixel_format"), PIXEL_FORMATS))
    out = params.withColumn("_c", let(fourcc, of))
    names = [*params.columns, *(c for c in ("fourcc", "error", "num_slices") if c not in params.columns)]
    return out.select(*(F.col(f"_c.{c}").alias(c) if c in ("fourcc", "extradata", "error", "num_slices") else F.col(c) for c in names))


def row_start(height: Column, slice_idx: Column, n: Column) -> Column:
    return F.floor(height.cast("bigint") * slice_idx / n).cast("int")


def slice_of_row(row: Column, height: Column, n: Column) -> Column:
    """The slice that a plane's row lies in."""
    return F.floor((n * (row.cast("bigint") + 1) - 1) / height).cast("int")


def input_error(fourcc: Column, width: Column, height: Column, num_slices: Column, planes: Column) -> Column:
    """What keeps a frame from being encoded; planes: ARRAY<BINARY>."""
    count, got = plane_count(fourcc), F.size(planes)
    lowest = F.least(plane_height(fourcc, F.lit(0), height), plane_height(fourcc, F.lit(1), height))
    area = lambda k: plane_width(fourcc, k, width).cast("bigint") * plane_height(fourcc, k, height)
    odd = F.get(F.filter(F.sequence(F.lit(0), count - 1), lambda k: F.octet_length(F.get(planes, k)) != area(k)), F.lit(0))
    rest = E.first_of(
        (got != count, E.error("EncoderPlaneSizeMismatch", plane=got, expected=count, got=got)),
        (~num_slices.between(1, 256), E.error("InvalidSliceCount", num_slices=num_slices)),
        (num_slices > lowest, E.error("SliceCountExceedsPlaneHeight", num_slices=num_slices, min_plane_height=lowest)),
        (odd.isNotNull(), E.error("EncoderPlaneSizeMismatch", plane=odd, expected=area(odd), got=F.octet_length(F.get(planes, odd)))),
    )
    return F.coalesce(dims_error(fourcc, width, height), rest)
