"""Registered queries over the given tables, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions import formats as S
from ..operators import codec, entropy, layout, packing, predict, stretches, tiles
from ..sources import planes as P

SLICE = ["frame_no", "plane_idx", "slice_idx"]
W = P.LI_WIDTH

# ---- SQL that several queries share -------------------------------------------------------------------------------------
LI = f"""li0 AS (SELECT *, l_orderkey // {P.LI_ORDERS} AS frame_no FROM lineitem),
li1 AS (SELECT *, row_number() OVER (PARTITION BY frame_no ORDER BY {', '.join(P.LI_ORDER)}) - 1 AS i, count(*) OVER (PARTITION BY frame_no) AS n, (count(*) OVER (PARTITION BY frame_no) + {W - 1}) // {W} AS h FROM li0),
px AS (SELECT frame_no, CAST(i // {W} AS INT) AS r, CAST(i % {W} AS INT) AS c, CAST(h AS INT) AS h, CAST(floor(l_quantity) AS INT) & 255 AS g, CAST(floor(l_discount * 100 + 0.5) AS INT) & 255 AS b, CAST(floor(l_tax * 100 + 0.5) AS INT) & 255 AS x FROM li1
 UNION ALL SELECT frame_no, CAST(i // {W} AS INT), CAST(i % {W} AS INT), CAST(h AS INT), 0, 0, 0 FROM (SELECT frame_no, h, unnest(range(n, h * {W})) AS i FROM (SELECT DISTINCT frame_no, n, h FROM li1))),
pl AS (SELECT frame_no, 0 AS plane_idx, r, c, h, g AS v FROM px UNION ALL SELECT frame_no, 1, r, c, h, b FROM px UNION ALL SELECT frame_no, 2, r, c, h, x FROM px)"""
SLICED = f"""{LI}, s0 AS (SELECT *, ({P.SLICES} * (r + 1) - 1) // h AS slice_idx FROM pl),
sl AS (SELECT *, (r - h * slice_idx // {P.SLICES}) * {W} + c AS i FROM s0)"""
LAGS = f"""{SLICED}, lg AS (SELECT *, lag(v) OVER w AS a, lag(v, {W}) OVER w AS bb, lag(v, {W + 1}) OVER w AS d, i // {W} AS rr FROM sl WINDOW w AS (PARTITION BY frame_no, plane_idx, slice_idx ORDER BY i))"""
GUESS = {
    "none": "0",
    "left": "coalesce(a, 128)",
    "gradient": "CASE WHEN rr = 0 THEN coalesce(a, 128) WHEN c = 0 THEN bb ELSE (a + bb - d) & 255 END",
    "median": "CASE WHEN rr = 0 THEN coalesce(a, 128) WHEN c = 0 AND rr = 1 THEN bb ELSE greatest(least(a, bb), least(greatest(a, bb), (a + bb - d) & 255)) END",
}
RESIDUALS = f"{LAGS}, res AS ({' UNION ALL '.join(f"SELECT '{p}' AS predictor, frame_no, plane_idx, (v - ({g})) & 255 AS sym FROM lg" for p, g in GUESS.items())})"


def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.in_slices(P.planes_of(P.lineitem_pixels(spark, sf_dir)), W)


def sliced_residuals(spark: SparkSession, sf_dir: str, predictor: str, n: int | Column = P.SLICES) -> DataFrame:
    """(SLICE, i, residual), predicted with a frame's three planes side by side."""
    px = P.in_slices(P.lineitem_pixels(spark, sf_dir), W, n)
    wide = predict.residual_of_planes(px, predictor, W, ["frame_no", "slice_idx"])
    return wide.select("frame_no", "slice_idx", "i", F.posexplode(F.array("g", "b", "x")).alias("plane_idx", "residual")).select(*SLICE, "i", "residual")


def residual_query(predictor: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return predict.residual(sliced(spark, sf_dir), predictor, W, SLICE).select(*SLICE, "i", "residual")

    return query


def inverse_query(predictor: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = ["frame_no", "slice_idx"]
        wide = predict.residual_of_planes(P.in_slices(P.lineitem_pixels(spark, sf_dir), W), predictor, W, key)
        for plane in "gbx":  # side by side, so that a row stands for three samples
            wide = predict.inverse(wide.withColumnRenamed(plane, "residual"), predictor, W, key).drop("residual").withColumnRenamed("v", plane)
        return wide.select("frame_no", "slice_idx", "i", F.posexplode(F.array("g", "b", "x")).alias("plane_idx", "v")).select(*SLICE, "i", "v")

    return query


def inverse_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the median predictor makes of the samples, read as residuals."""
    res = sliced(spark, sf_dir).select(*SLICE, "i", F.col("v").alias("residual"))
    return predict.inverse_median(res, W, SLICE).select(*SLICE, "i", "v")


def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = predict.residual(sliced(spark, sf_dir), "gradient", W, SLICE)
    return entropy.histogram(res, ["plane_idx"])


def plane_counts(spark: SparkSession, sf_dir: str, key: list[str]) -> DataFrame:
    """Residual counts of the first rows as one slice, for all predictors."""
    first = P.in_slices(P.planes_of(P.lineitem_pixels(spark, sf_dir)), W, 1).where(F.col("r") < entropy.SAMPLE_ROWS)
    return entropy.histogram(predict.residuals_of_all(first, W, SLICE), ["predictor", *key])


def entropy_by_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = plane_counts(spark, sf_dir, ["frame_no", "plane_idx"])
    return entropy.entropy(counts, ["predictor", "frame_no", "plane_idx"]).select("predictor", "frame_no", "plane_idx", F.round("bits", 4).alias("bits"))


def choose_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = entropy.entropy(plane_counts(spark, sf_dir, ["frame_no", "plane_idx"]), ["predictor", "frame_no", "plane_idx"])
    wide = bits.groupBy("frame_no", "plane_idx").pivot("predictor", list(S.PREDICTORS)).agg(F.first("bits"))
    return wide.select("frame_no", "plane_idx", entropy.choose({p: F.col(p) for p in S.PREDICTORS}).alias("predictor"))


FIRST_ROWS = f"""{LI}, f8 AS (SELECT *, r * {W} + c AS i FROM pl WHERE r < {entropy.SAMPLE_ROWS}),
lg AS (SELECT *, lag(v) OVER w AS a, lag(v, {W}) OVER w AS bb, lag(v, {W + 1}) OVER w AS d, r AS rr FROM f8 WINDOW w AS (PARTITION BY frame_no, plane_idx ORDER BY i)),
res AS ({' UNION ALL '.join(f"SELECT '{p}' AS predictor, frame_no, plane_idx, (v - ({g})) & 255 AS sym FROM lg" for p, g in GUESS.items())}),
hist AS (SELECT predictor, frame_no, plane_idx, sym, count(*) AS n FROM res GROUP BY ALL),
bits AS (SELECT predictor, frame_no, plane_idx, sum(n) * log2(sum(n)) - sum(n * log2(n)) AS bits FROM hist GROUP BY ALL)"""


def rgb_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = P.lineitem_pixels(spark, sf_dir)
    return px.select("frame_no", "r", "c", "g", predict.decorrelated(F.col("g"), F.col("b")).alias("b"), predict.decorrelated(F.col("g"), F.col("x")).alias("x"))


def rgb_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = rgb_forward(spark, sf_dir)
    return px.select("frame_no", "r", "c", "g", predict.correlated(F.col("g"), F.col("b")).alias("b"), predict.correlated(F.col("g"), F.col("x")).alias("x"))


def slice_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced(spark, sf_dir).groupBy("frame_no", "plane_idx", "slice_idx").agg(F.min("r").alias("row_start"), (F.max("r") + 1).cast("int").alias("row_end"), F.count(F.lit(1)).alias("pixel_count"))


def code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.histogram(sliced_residuals(spark, sf_dir, "left"), ["frame_no", "plane_idx"])


def huffman_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.canonical_codes(packing.code_lengths(code_counts(spark, sf_dir), ["frame_no", "plane_idx"]), ["frame_no", "plane_idx"])


def huffman_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits that each plane's residuals take in its code."""
    key = ["frame_no", "plane_idx"]
    counts = code_counts(spark, sf_dir)
    return counts.join(entropy.code_lengths(counts, key), [*key, "sym"]).groupBy(*key).agg(F.sum(F.col("n") * F.col("code_len")).alias("bits"))


def kraft_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of planes, some with their least symbol taken out or given a longer code, against Kraft's equality."""
    from pyspark.sql import Window

    w = Window.partitionBy("frame_no", "plane_idx")
    lengths = entropy.code_lengths(code_counts(spark, sf_dir), ["frame_no", "plane_idx"]).withColumns({"least": F.min("sym").over(w) == F.col("sym"), "many": F.count(F.lit(1)).over(w)}).where("many > 1")
    lengths = lengths.where(~(F.col("least") & (F.col("frame_no") % 3 == 1)))
    lengths = lengths.withColumn("code_len", F.when(F.col("least") & (F.col("frame_no") % 3 == 2), F.col("code_len") + 1).otherwise(F.col("code_len")))
    k = entropy.kraft(lengths, ["frame_no", "plane_idx"])
    return k.select("frame_no", "plane_idx", "complete", (F.col("numerator") < F.pow(F.lit(2.0), F.col("max_len"))).alias("below"))


def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical codes for a complete code that each plane's table defines: its k most frequent symbols get lengths 1, 2, ... k - 1, k - 1."""
    from pyspark.sql import Window

    w = Window.partitionBy("frame_no", "plane_idx")
    ranked = code_counts(spark, sf_dir).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "sym"))).withColumn("m", F.least(F.lit(12), F.count(F.lit(1)).over(w)))
    lengths = ranked.where((F.col("k") <= F.col("m")) & (F.col("m") >= 2)).withColumn("code_len", F.least("k", F.col("m") - 1).cast("int"))
    return entropy.canonical_codes(lengths.select("frame_no", "plane_idx", "sym", "code_len"), ["frame_no", "plane_idx"]).select("frame_no", "plane_idx", "sym", "code_len", "code")


#: Lengths by the package merge: 15 levels of pairs merged with the coins, then taken apart from the last to the first.
HUFFMAN = """co AS (SELECT frame_no, plane_idx, list({'n': CAST(n AS BIGINT), 'sym': sym} ORDER BY n, sym) AS coins FROM hist GROUP BY ALL HAVING count(*) > 1),
pm AS (SELECT frame_no, plane_idx, coins, 0 AS lv, [c.n for c in coins] AS w, CAST([] AS BOOLEAN[][]) AS pairs FROM co
 UNION ALL SELECT frame_no, plane_idx, coins, lv + 1, [x.w for x in met], list_append(pairs, [x.c = 1 for x in met]) FROM (SELECT *, list_sort(list_concat([{'w': w[2 * i + 1] + w[2 * i + 2], 'c': 1, 'k': i} for i in range(len(w) // 2)], [{'w': coins[i + 1].n, 'c': 2, 'k': i} for i in range(len(coins))])) AS met FROM pm WHERE lv < 15)),
un AS (SELECT frame_no, plane_idx, coins, pairs, 15 AS lv, 2 * len(coins) - 2 AS take, CAST([] AS BIGINT[]) AS spent FROM pm WHERE lv = 15
 UNION ALL SELECT frame_no, plane_idx, coins, pairs, lv - 1, 2 * m, list_append(spent, take - m) FROM (SELECT *, len(list_filter(pairs[lv][:take], lambda x: x)) AS m FROM un WHERE lv > 0)),
hl AS (SELECT frame_no, plane_idx, unnest([{'sym': coins[i + 1].sym, 'code_len': len(list_filter(list_append(spent, take), lambda x: x > i))} for i in range(len(coins))], recursive := true) FROM un WHERE lv = 0),
hm AS (SELECT frame_no, plane_idx, sym, CAST(code_len AS INT) AS code_len, CAST(max(code_len) OVER (PARTITION BY frame_no, plane_idx) AS INT) AS mx FROM hl),
hc AS (SELECT frame_no, plane_idx, sym, code_len, CAST(coalesce(sum(1 << (mx - code_len)) OVER (PARTITION BY frame_no, plane_idx ORDER BY code_len DESC, sym DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) >> (mx - code_len) AS code FROM hm)"""
CODE_COUNTS = f"{LAGS}, hist AS (SELECT frame_no, plane_idx, (v - coalesce(a, 128)) & 255 AS sym, count(*) AS n FROM lg GROUP BY ALL)"


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream parameters that the orders table stands for: layouts (one unknown), sizes from keys, slice counts."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    fourcc = F.element_at(F.array(*map(F.lit, [*S.LAYOUTS, "ABCD"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select("o_orderkey", fourcc.alias("fourcc"), (F.col("o_custkey") % 97).cast("int").alias("width"), (F.col("o_orderkey") % 53).cast("int").alias("height"), (F.col("o_custkey") % 260).cast("int").alias("n"))


CONFIGS = "cf AS (SELECT o_orderkey, ['ULY0','ULY2','ULY4','ULRG','ULRA','ABCD'][o_orderkey % 6 + 1] AS fourcc, CAST(o_custkey % 97 AS INT) AS width, CAST(o_orderkey % 53 AS INT) AS height, CAST(o_custkey % 260 AS INT) AS n FROM orders)"


def format_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, w, h = F.col("fourcc"), F.col("width"), F.col("height")
    known = configs(spark, sf_dir).where(S.known(f)).withColumn("plane_idx", F.explode(F.sequence(F.lit(0), S.plane_count(f) - 1)))
    k = F.col("plane_idx")
    return known.select("o_orderkey", "plane_idx", S.plane_label(f, k).alias("label"), S.plane_width(f, k, w).alias("pw"), S.plane_height(f, k, h).alias("ph"), S.is_rgb_family(f).alias("is_rgb"), S.has_alpha(f).alias("has_alpha"), F.hex(S.source_format_tag(f)).alias("tag"))


def config_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = configs(spark, sf_dir)
    e = S.dims_error(F.col("fourcc"), F.col("width"), F.col("height"))
    v = e["variant"]
    return c.select("o_orderkey", v.alias("variant"), E.category(v).alias("category"), E.is_category(v, "StreamShape").alias("is_stream_shape"), E.message(e).alias("message"))


def extradata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extradata built for each stream (none for a slice count out of range) and read again, with one field spoilt in some."""
    c = configs(spark, sf_dir).where(S.known(F.col("fourcc")))
    x = S.build_extradata(F.col("fourcc"), F.col("n"))
    spoilt = F.when(F.col("o_orderkey") % 7 == 1, F.substring(x, 1, 12)).when(F.col("o_orderkey") % 7 == 2, F.concat(F.substring(x, 1, 8), S.dword(F.lit(5)), F.substring(x, 13, 4))).when(F.col("o_orderkey") % 7 == 3, F.concat(F.substring(x, 1, 12), S.dword(F.lit(0)))).when(F.col("o_orderkey") % 7 == 4, F.concat(F.substring(x, 1, 12), S.dword(F.lit(0x801)))).otherwise(x)
    c = c.withColumn("x", spoilt)
    e, d = S.extradata_error(F.col("x")), S.extradata(F.col("x"))
    return c.select("o_orderkey", F.hex("x").alias("data"), e["variant"].alias("variant"), F.coalesce(d["encoder_version"], F.lit(-1)).alias("version"), F.coalesce(S.slice_count(d["flags"]), F.lit(-1)).alias("num_slices"))


def frame_info_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictor that each order's key, as a frame's last dword, names; and the dword that names it back."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 12345 % 4294967296).alias("x"))
    chunk = F.concat(F.lit(b"\0\1\2"), S.dword(F.col("x")))
    p = S.predictor_of(layout.peek_frame_info(chunk))
    return o.select("o_orderkey", p.alias("predictor"), S.frame_info_of(p).alias("frame_info"))


def sample_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would keep each order's stream from being encoded with one missing or short plane in some."""
    f, w, h, n = (F.col(c) for c in ("fourcc", "width", "height", "n"))
    c = configs(spark, sf_dir).withColumn("odd", (F.col("o_orderkey") % 5 == 4)).withColumn("few", F.col("o_orderkey") % 11 == 10)
    area = lambda k: S.plane_width(f, k, w) * S.plane_height(f, k, h)
    short = lambda k: F.when(F.col("odd") & (k == 2), F.lit(1)).otherwise(F.lit(0))
    planes = F.transform(F.sequence(F.lit(0), S.plane_count(f) - 1), lambda k: F.lpad(F.lit(b"").cast("binary"), F.greatest(F.lit(0), area(k) - short(k)), F.lit(b"\0")))
    planes = F.when(F.col("few"), F.slice(planes, 1, 2)).otherwise(planes)
    e = S.input_error(f, w, h, n, planes)
    return c.select("o_orderkey", e["variant"].alias("variant"), E.category(e["variant"]).alias("category"))


SAMPLE_GEOMETRY = f"""WITH {CONFIGS}, q AS (SELECT *, o_orderkey % 5 = 4 AS odd, o_orderkey % 11 = 10 AS few, CASE WHEN fourcc IN ('ULY0') THEN height // 2 ELSE height END AS lowest,
 CASE WHEN fourcc = 'ULY0' THEN (width // 2) * (height // 2) WHEN fourcc = 'ULY2' THEN (width // 2) * height ELSE width * height END AS area2 FROM cf),
v AS (SELECT o_orderkey, CASE WHEN fourcc = 'ABCD' THEN 'UnknownFourcc' WHEN width <= 0 OR height <= 0 OR (fourcc = 'ULY0' AND (width % 2 = 1 OR height % 2 = 1)) OR (fourcc = 'ULY2' AND width % 2 = 1) THEN 'DimensionConstraint'
 WHEN few THEN 'EncoderPlaneSizeMismatch' WHEN n < 1 OR n > 256 THEN 'InvalidSliceCount' WHEN n > lowest THEN 'SliceCountExceedsPlaneHeight' WHEN odd AND area2 > 0 THEN 'EncoderPlaneSizeMismatch' END AS variant FROM q)
SELECT o_orderkey, variant, CASE WHEN variant IN ('UnknownFourcc', 'DimensionConstraint') THEN 'StreamShape' WHEN variant IS NOT NULL THEN 'ApiMisuse' END AS category FROM v"""


def li_frames(spark: SparkSession, sf_dir: str, fourcc: str, predictor: int) -> DataFrame:
    samples = P.lineitem_samples()
    samples |= {"a": samples["g"]} if fourcc == "ULRA" else {}
    return P.shaped(P.row_frames(P.lineitem_rows(spark, sf_dir), P.LI_SORT, samples, W), "li", fourcc, predictor, P.SLICES, W)


def coded(frames: DataFrame) -> DataFrame:
    """Packets that carry their stream's parameters."""
    return codec.encode(frames).withColumn("pts", F.col("frame_no"))


def roundtrip_query(fourcc: str, predictor: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.pixels_of(codec.decode(coded(li_frames(spark, sf_dir, fourcc, S.PREDICTORS.index(predictor))), strict=True), W)

    return query


def embeddings_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames of three equal planes, with the predictor that suits each frame."""
    px = P.embedding_pixels(spark, sf_dir).withColumns({"v1": F.col("v"), "v2": F.col("v")})
    frames = codec.with_predictor(P.frames(px, "emb", "ULY4", 0, P.SLICES, ["v", "v1", "v2"], 64))
    return P.pixels_of(codec.decode(coded(frames)), 64)


EMB = f"""e0 AS (SELECT vec_id // {P.EMB_ROWS} AS frame_no, vec_id, embedding FROM embeddings), e1 AS (SELECT frame_no, embedding, CAST(row_number() OVER (PARTITION BY frame_no ORDER BY vec_id) - 1 AS INT) AS r FROM e0),
e2 AS (SELECT frame_no, r, CAST(unnest(range(len(embedding))) AS INT) AS c, unnest(embedding) AS x FROM e1), ep AS (SELECT frame_no, r, c, CAST(floor(CAST(x AS DOUBLE) * 128) + 128 AS INT) & 255 AS v FROM e2)"""


def layout_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the decode-free layout says of each frame: pixels, sizes against the payload's length, complete codes."""
    frames = layout.frame_layout(coded(li_frames(spark, sf_dir, "ULRG", 2)))
    totals = layout.frame_totals(layout.plane_layout(frames))
    return totals.select("frame_no", F.col("total_pixels").cast("bigint").alias("total_pixels"), (F.col("total_size") == F.col("length")).alias("size_is_length"), F.col("all_planes_kraft_complete").alias("complete"))


def slice_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.slice_layout(layout.frame_layout(coded(li_frames(spark, sf_dir, "ULY4", 1)), codes=False)).select("frame_no", "plane_idx", "slice_idx", "row_start", "row_end", "pixel_count")


def malformed_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads damaged in one way each, by frame number, and what decoding says."""
    packets = coded(li_frames(spark, sf_dir, "ULY4", 1))
    k, x = F.col("frame_no") % 6, F.col("chunk")
    bad = (
        F.when(k == 0, F.substring(x, 1, 3))
        .when(k == 1, F.substring(x, 1, 200))
        .when(k == 2, F.concat(F.lit(b"\0\0"), F.substring(x, F.lit(3), F.octet_length(x) - 2)))
        .when(k == 3, F.concat(F.substring(x, 1, 256), F.lit(b"\1\0\0\0"), F.substring(x, F.lit(261), F.octet_length(x) - 260)))
        .when(k == 4, F.concat(F.substring(x, F.lit(1), F.octet_length(x) - 4), F.lit(b"\0" * 8), F.substring(x, -4, 4)))
        .otherwise(x)
    )
    out = codec.decode(packets.withColumn("chunk", bad))
    return out.select("frame_no", F.col("error.variant").alias("variant"), E.category(F.col("error.variant")).alias("category"), F.when(k != 4, E.message(F.col("error"))).alias("message"))


def strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as planes of 12 samples a row, 16 bytes apart."""
    return li_frames(spark, sf_dir, "ULY4", 1).withColumn("width", F.lit(12)).withColumn("strides", F.array(*[F.lit(W)] * 3))


def stride_repack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pixels_of(P.repacked(strided(spark, sf_dir)), 12)


def stride_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes that cannot be repacked, in one way each by frame number, and what is said of them."""
    k, p = F.col("frame_no") % 5, F.col("planes")
    bad = strided(spark, sf_dir).withColumn("strides", F.when(k == 1, F.array(F.lit(W), F.lit(8), F.lit(W))).when(k == 4, F.array(F.lit(12), F.lit(W), F.lit(None).cast("int"))).otherwise(F.col("strides")))
    cut = F.array(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.substring(F.get(p, F.lit(2)), F.lit(1), F.octet_length(F.get(p, F.lit(2))) - 1))
    bad = bad.withColumn("planes", F.when(k == 2, cut).when(k == 3, F.slice(p, 1, 2)).otherwise(p))
    e = F.col("stride_error")
    out = P.repacked(bad)
    return out.select("frame_no", e["variant"].alias("variant"), e["fields"]["plane"].alias("plane"), E.message(e).alias("message"), F.coalesce(F.aggregate("planes", F.lit(0), lambda n, x: n + F.octet_length(x)), F.lit(-1)).alias("bytes"))


def binary_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of planes with the samples 0 and 1 alone, whose every bit is known: they share a code of one bit."""
    samples = {name: c % 2 for name, c in P.lineitem_samples().items()}
    return coded(P.shaped(P.row_frames(P.lineitem_rows(spark, sf_dir), P.LI_SORT, samples, W), "bits", "ULY4", 0, P.SLICES, W))


def wire_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_packets(spark, sf_dir).select("frame_no", F.hex("chunk").alias("chunk"))


def plane_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each plane of a payload lies and what its descriptor says."""
    planes = layout.plane_layout(layout.frame_layout(binary_packets(spark, sf_dir)))
    tiers = F.array_join(F.transform("code_length_histogram", lambda t: F.concat_ws(":", t["code_length"], t["count"])), ",")
    return planes.select("frame_no", "plane_idx", "descriptor_start", "end_offsets_start", "slice_data_start", "slice_data_total", "zero_count", "absent_count", "active_symbol_count", "unused_symbol_count", F.coalesce("min_code_length", F.lit(0)).alias("min_len"), "min_code_length_symbol_count", tiers.alias("tiers"), "kraft_numerator", "is_kraft_complete")


def slice_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.slice_layout(layout.frame_layout(binary_packets(spark, sf_dir), codes=False)).select("frame_no", "plane_idx", "slice_idx", "start", "end", "len", "is_empty", "row_count")


def stream_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a decoder makes of each order's stream parameters, with one missing in some."""
    c, k = configs(spark, sf_dir), F.col("o_orderkey")
    x = F.when(k % 11 == 10, F.lit(b"")).otherwise(S.build_extradata(F.col("fourcc"), F.col("n")))
    c = c.select("o_orderkey", F.when(k % 9 != 8, F.col("fourcc")).alias("fourcc"), F.when(k % 10 != 9, F.col("width")).alias("width"), "height", x.alias("extradata"))
    return S.stream_config(c).select("o_orderkey", "deferred", F.col("error.variant").alias("variant"), "num_slices")


def sql_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames encoded and decoded by the functions that are registered for SQL."""
    from ..streaming.session import register

    register(spark)
    frames = li_frames(spark, sf_dir, "ULRG", 3)
    coded_ = frames.selectExpr("*", "encode_frame(fourcc, width, height, predictor, num_slices, planes) AS chunk")
    return P.pixels_of(coded_.selectExpr("frame_no", "decode_frame(chunk, fourcc, width, height, num_slices).planes AS planes"), W)


def stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets read as a stream and decoded batch by batch."""
    from ..streaming.session import encoded_packets, run_stream

    folder = shared_folder(spark)
    encoded_packets(li_frames(spark, sf_dir, "ULRG", 3)).withColumn("pts", F.col("frame_no")).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    run_stream(source, codec.decode, f"{folder}/out", f"{folder}/check").awaitTermination()
    return P.pixels_of(spark.read.parquet(f"{folder}/out"), W)


def slices_of_payloads(packets: DataFrame) -> DataFrame:
    """(frame_no, plane_idx, slice_idx, descriptor, bytes, pixels) of packets that carry their stream's parameters."""
    planes = codec.parsed(packets.select("frame_no", *codec.PARAMETERS, "chunk"), codes=False).select("frame_no", "chunk", F.explode("layout").alias("p"))
    cut = planes.select("frame_no", "chunk", "p.plane_idx", "p.descriptor", F.col("p.width").alias("pw"), F.explode("p.slices").alias("s"))
    data = F.substring("chunk", F.col("s.start").cast("int") + 1, (F.col("s.end") - F.col("s.start")).cast("int"))
    return cut.select("frame_no", "plane_idx", "s.slice_idx", "descriptor", data.alias("bytes"), ((F.col("s.row_end") - F.col("s.row_start")).cast("bigint") * F.col("pw")).alias("pixels"))


def stretch_query(predictor: str) -> Callable[[SparkSession, str], DataFrame]:
    """The residuals of frames of one slice each, decoded by stretches of 4 kB in tasks of their own."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        slices = slices_of_payloads(coded(P.large_frames(spark, sf_dir, S.PREDICTORS.index(predictor))))
        out = stretches.decoded(slices, SLICE, 4096)
        return stretches.symbol_rows(out, ["frame_no", "plane_idx"])

    return query


def large_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = P.pixels_of(P.large_frames(spark, sf_dir, 0), P.LARGE_WIDTH)
    return px.select("frame_no", "plane_idx", (F.col("r") * P.LARGE_WIDTH + F.col("c")).alias("i"), "v")


def large_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the samples of `large_pixels`; the table's own row count tells how many there are."""
    return tiles.tasks(3 * spark.read.parquet(f"{sf_dir}/lineitem.parquet").count(), spark.sparkContext.defaultParallelism)


def tiled_residual_query(predictor: str) -> Callable[[SparkSession, str], DataFrame]:
    """Residuals of frames of one slice each, by blocks of 4096 samples with their halo."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tiles.residual(large_pixels(spark, sf_dir), predictor, P.LARGE_WIDTH, ["frame_no", "plane_idx"], 4096, large_tasks(spark, sf_dir)).select("frame_no", "plane_idx", "i", "residual")

    return query


def tiled_inverse_query(predictor: str) -> Callable[[SparkSession, str], DataFrame]:
    """Samples from residuals, by blocks or tiles with carries."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = ["frame_no", "plane_idx"]
        res = tiles.residual(large_pixels(spark, sf_dir), predictor, P.LARGE_WIDTH, key, 4096, large_tasks(spark, sf_dir)).drop("v")
        out = tiles.inverse_left(res, key, 4096) if predictor == "left" else tiles.inverse_gradient(res, P.LARGE_WIDTH, key, 32)
        return out.select(*key, "i", "v")

    return query


LARGE = f"""lb0 AS (SELECT *, l_orderkey // {P.LARGE_ORDERS} AS frame_no FROM lineitem),
lb1 AS (SELECT *, row_number() OVER (PARTITION BY frame_no ORDER BY {', '.join(P.LI_ORDER)}) - 1 AS i, count(*) OVER (PARTITION BY frame_no) AS n, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents FROM lb0),
lp AS (SELECT frame_no, 0 AS plane_idx, i, CAST(floor(l_quantity) AS INT) & 255 AS v FROM lb1 UNION ALL SELECT frame_no, 1, i, CAST(cents & 255 AS INT) FROM lb1 UNION ALL SELECT frame_no, 2, i, CAST(bit_count((cents - 1) & ~cents) AS INT) FROM lb1
 UNION ALL SELECT frame_no, unnest([0, 1, 2]), i, 0 FROM (SELECT frame_no, unnest(range(n, (n + {P.LARGE_WIDTH - 1}) // {P.LARGE_WIDTH} * {P.LARGE_WIDTH})) AS i FROM (SELECT DISTINCT frame_no, n FROM lb1)))"""
LARGE_LAGS = f"{LARGE}, lg AS (SELECT frame_no, plane_idx, i, v, lag(v) OVER w AS a, lag(v, {P.LARGE_WIDTH}) OVER w AS bb, lag(v, {P.LARGE_WIDTH + 1}) OVER w AS d, i // {P.LARGE_WIDTH} AS rr, i % {P.LARGE_WIDTH} AS c FROM lp WINDOW w AS (PARTITION BY frame_no, plane_idx ORDER BY i))"
def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only in local mode, where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root or tempfile.mkdtemp()}/{uuid.uuid4().hex}"


def packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32-bit words of each slice's residuals in its plane's code, without Python."""
    blocks, _ = packing.blocks(sliced_residuals(spark, sf_dir, "left"), SLICE, ["frame_no", "plane_idx"])
    return packing.words_of(blocks, SLICE)


def packed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole payloads put together from words, without Python."""
    res = sliced_residuals(spark, sf_dir, "left", F.least(F.lit(P.SLICES), "h"))
    blocks, lengths = packing.blocks(res, SLICE, ["frame_no", "plane_idx"])
    rows = P.lineitem_rows(spark, sf_dir).groupBy("frame_no").agg(F.ceil(F.count(F.lit(1)) / W).cast("int").alias("h"))
    slices = rows.select("frame_no", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("plane_idx"), F.least(F.lit(P.SLICES), "h").alias("n"))
    slices = slices.select("frame_no", "plane_idx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slice_idx"))
    return packing.frames(slices, packing.words_of(blocks, SLICE), lengths, ["frame_no"], 1).select("frame_no", F.hex("chunk").alias("chunk"))


#: Frames of one height make a stream of late_config; heights with this rest by 8 never get parameters.
WITHOUT = 7


def late_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that come before their streams' parameters: they wait in state over two restarts; some streams end without any, and
    their frames are rows of plane -1."""
    from ..streaming import keyed

    folder = shared_folder(spark)
    packets = coded(li_frames(spark, sf_dir, "ULY4", 1)).withColumn("stream_id", F.concat(F.lit("h"), F.col("height")))
    packets.write.parquet(f"{folder}/packets")
    packets = spark.read.parquet(f"{folder}/packets")
    shape = packets.select("stream_id", "fourcc", "width", "height", S.build_extradata(F.col("fourcc"), F.col("num_slices")).alias("extradata"), F.lit(False).alias("ended")).distinct()
    given = [shape.limit(0), shape.where(F.col("height") % 8 != WITHOUT), shape.withColumn("ended", F.lit(True))]
    shape.limit(0).write.parquet(f"{folder}/params")
    sources = [spark.readStream.schema(x.schema).parquet(f"{folder}/{name}") for name, x in (("packets", packets), ("params", shape))]
    for params in given:
        params.write.mode("append").parquet(f"{folder}/params")
        keyed.run(spark, *sources, f"{folder}/out", f"{folder}/check").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    bad = out.where("error.variant = 'InvalidInput'").select("frame_no", *(F.lit(k).alias(c) for c, k in (("plane_idx", -1), ("r", -1), ("c", -1), ("v", 0))))
    return P.pixels_of(out, W).unionByName(bad)


#: Slices (plane, slice) of a payload whose last word gets its lowest bit set, by the frame's number modulo 3.
DAMAGED = [[], [(1, 2)], [(2, 1), (0, 3)]]


def strict_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of two-valued planes with set bits behind the codes of one slice or two, decoded strictly by slices: the first error."""
    packets = binary_packets(spark, sf_dir).select(*codec.KEY, "pts", *codec.PARAMETERS, "chunk")
    slices = layout.slice_layout(layout.frame_layout(packets, codes=False)).where("len > 0")
    hit = F.lit(False)
    for k, some in enumerate(DAMAGED):
        for p, x in some:
            hit = hit | ((F.col("frame_no") % 3 == k) & (F.col("plane_idx") == p) & (F.col("slice_idx") == x))
    at = slices.where(hit).groupBy(*codec.KEY).agg(F.collect_list((F.col("end") - 4).cast("int")).alias("at"))  # two places
    put = lambda x, k: F.concat(F.substring(x, F.lit(1), k), F.lit(b"\1"), F.substring(x, k + 2, F.octet_length(x)))
    bad = packets.join(at, codec.KEY, "left").withColumn("chunk", F.when(F.col("at").isNull(), F.col("chunk")).otherwise(F.aggregate("at", F.col("chunk"), put)))
    e = F.col("error")
    return codec.decode(bad.drop("at"), strict=True, by_slice=True).select("frame_no", e["variant"].alias("variant"), *(F.coalesce(e["fields"][c], F.lit(-1)).alias(c) for c in ("plane", "slice", "bit_position")))


def kraft_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first plane's code of one bit for each of two symbols, with a longer code for one of them, or a third symbol of one bit."""
    x, k = F.col("chunk"), F.col("frame_no") % 3
    two = F.substring(x, 1, 2) == F.lit(b"\1\1")
    bad = F.when(two & (k == 1), F.concat(F.lit(b"\1\2"), F.substring(x, F.lit(3), F.octet_length(x)))).when(two & (k == 2), F.concat(F.lit(b"\1\1\1"), F.substring(x, F.lit(4), F.octet_length(x)))).otherwise(x)
    planes = layout.plane_layout(layout.frame_layout(binary_packets(spark, sf_dir).withColumn("chunk", bad))).where("plane_idx = 0")
    return planes.select("frame_no", "kraft_numerator", "is_kraft_complete", "active_symbol_count", F.coalesce("max_code_length", F.lit(0)).alias("max_code_length"))


def slices_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large frames of 16 slices, encoded and decoded slice by slice."""
    packets = codec.encode(P.large_frames(spark, sf_dir, 3, 16), by_slice=True).withColumn("pts", F.col("frame_no"))
    return P.pixels_of(codec.decode(packets, strict=True, by_slice=True), P.LARGE_WIDTH)


LATERAL = "SELECT frame_no, x.* FROM {packets}, LATERAL %s(chunk, fourcc, width, height, num_slices) x"


def slices_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of payloads by a table function."""
    from ..streaming.session import register

    register(spark)
    out = spark.sql(LATERAL % "frame_slices", packets=coded(li_frames(spark, sf_dir, "ULY4", 1)))
    return out.select("frame_no", "plane_idx", "slice_idx", "row_start", "row_end", F.col("pixels").alias("pixel_count"))


def pixels_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of payloads by a table function."""
    from ..streaming.session import register

    register(spark)
    return spark.sql(LATERAL % "frame_pixels", packets=coded(li_frames(spark, sf_dir, "ULRG", 3)))


def connector_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets written as frame bodies in two writes, read as a stream and, the streams of even heights, as a table, and decoded."""
    from ..sources import connector
    from ..streaming.session import run_stream

    connector.register(spark)
    folder = shared_folder(spark)
    packets = coded(li_frames(spark, sf_dir, "ULRG", 2)).withColumn("stream_id", F.concat(F.lit("h"), F.col("height")))
    packets.write.parquet(f"{folder}/packets")
    packets = spark.read.parquet(f"{folder}/packets")
    packets.select("stream_id", *codec.PARAMETERS).distinct().write.parquet(f"{folder}/config")
    config = spark.read.parquet(f"{folder}/config")  # of known size, so that it is sent to the packets: by stream few tasks have all
    for half in (0, 1):
        rows = packets.where(F.col("frame_no") % 2 == half).select("stream_id", "frame_no", F.lit(None).cast("bigint").alias("pts"), "chunk")
        rows.write.format(connector.NAME).option("packed", True).mode("append").save(f"{folder}/bodies")
    even = [r.stream_id for r in config.where("height % 2 = 0").collect()]  # a row for a stream
    table = codec.decode(spark.read.format(connector.NAME).load(f"{folder}/bodies").where(F.col("stream_id").isin(even)), config)
    source = spark.readStream.format(connector.NAME).load(f"{folder}/bodies")
    run_stream(source, lambda batch: codec.decode(batch, config), f"{folder}/out", f"{folder}/check").awaitTermination()
    out = P.pixels_of(spark.read.parquet(f"{folder}/out"), W).withColumn("way", F.lit("stream"))
    return out.unionByName(P.pixels_of(table, W).withColumn("way", F.lit("table")))


PLANES_SQL = f"WITH {LI} SELECT frame_no, plane_idx, r, c, v FROM pl"
ALPHA_SQL = f"WITH {LI} SELECT frame_no, plane_idx, r, c, v FROM pl UNION ALL SELECT frame_no, 3, r, c, g FROM px"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"residual_{p}": residual_query(p) for p in S.PREDICTORS},
    **{f"inverse_{p}": inverse_query(p) for p in ("none", "left", "gradient")},
    **{f.__name__: f for f in (inverse_median, residual_histogram, entropy_by_predictor, choose_predictor, rgb_forward, rgb_inverse, slice_partition, huffman_codes, huffman_cost, kraft_check, canonical_order, format_geometry, config_errors, extradata_fields, frame_info_predictor, sample_geometry)},
    **{f"roundtrip_{f.lower()}_{p}": roundtrip_query(f, p) for f, p in [("ULY4", "none"), ("ULY4", "left"), ("ULY4", "gradient"), ("ULY4", "median"), ("ULRG", "left"), ("ULRG", "gradient"), ("ULRG", "median"), ("ULRA", "median")]},
    **{f"stretch_symbols_{p}": stretch_query(p) for p in ("none", "gradient")},
    **{f"tiled_residual_{p}": tiled_residual_query(p) for p in ("left", "gradient", "median")},
    **{f"tiled_inverse_{p}": tiled_inverse_query(p) for p in ("left", "gradient")},
    **{f.__name__: f for f in (embeddings_roundtrip, layout_identities, slice_layout, malformed_taxonomy, stride_repack, stride_errors, wire_bytes, plane_statistics, slice_extents, stream_parameters, sql_roundtrip, stream_roundtrip, late_config, packed_words, packed_frames, connector_roundtrip, slices_lateral, pixels_lateral, strict_padding, kraft_incomplete, slices_roundtrip)},
}
LITTLE = "substr({0}, 7, 2) || substr({0}, 5, 2) || substr({0}, 3, 2) || substr({0}, 1, 2)"
#: Of two samples the larger has the bit 0; bits fill 32-bit words from the top, words are little-endian; an only sample has no bits.
BITS = f"""{LI}, b0 AS (SELECT frame_no, plane_idx, r, c, h, v & 1 AS b, least({P.SLICES}, h) AS ns FROM pl), b1 AS (SELECT *, (ns * (r + 1) - 1) // h AS sl FROM b0),
b2 AS (SELECT *, row_number() OVER (PARTITION BY frame_no, plane_idx, sl ORDER BY r, c) - 1 AS i FROM b1), st AS (SELECT frame_no, plane_idx, min(b) AS lo, max(b) AS hi FROM b0 GROUP BY ALL),
wd AS (SELECT frame_no, plane_idx, sl, i // 32 AS w, printf('%08X', CAST(sum(CAST(1 - b AS BIGINT) << CAST(31 - i % 32 AS INT)) AS BIGINT)) AS x FROM b2 JOIN st USING (frame_no, plane_idx) WHERE lo <> hi GROUP BY ALL),
sd AS (SELECT frame_no, plane_idx, sl, string_agg({LITTLE.format('x')}, '' ORDER BY w) AS d, count(*) * 4 AS len FROM wd GROUP BY ALL),
sa AS (SELECT frame_no, plane_idx, sl, max(h) AS h, max(ns) AS ns FROM b1 GROUP BY ALL),
se AS (SELECT frame_no, plane_idx, sl, h, ns, coalesce(d, '') AS d, CAST(coalesce(len, 0) AS BIGINT) AS len, CAST(sum(coalesce(len, 0)) OVER (PARTITION BY frame_no, plane_idx ORDER BY sl) AS BIGINT) AS e FROM sa LEFT JOIN sd USING (frame_no, plane_idx, sl)),
sp AS (SELECT frame_no, plane_idx, max(ns) AS ns, max(e) AS total, string_agg({LITTLE.format("printf('%08X', e)")}, '' ORDER BY sl) AS ends, string_agg(d, '' ORDER BY sl) AS data FROM se GROUP BY ALL),
pp AS (SELECT *, CASE WHEN lo <> hi THEN '0101' || repeat('FF', 254) WHEN lo = 0 THEN '00' || repeat('FF', 255) ELSE 'FF00' || repeat('FF', 254) END AS ds, CAST(coalesce(sum(256 + 4 * ns + total) OVER (PARTITION BY frame_no ORDER BY plane_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ofs FROM sp JOIN st USING (frame_no, plane_idx))"""
#: Words of codes of many symbols, and payloads made of them.
WORDS = f"""{HUFFMAN}, ws AS (SELECT frame_no, plane_idx, slice_idx, i, code_len AS n, code, CAST(coalesce(sum(code_len) OVER (PARTITION BY frame_no, plane_idx, slice_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
 FROM (SELECT *, (v - coalesce(a, 128)) & 255 AS sym FROM lg) JOIN hc USING (frame_no, plane_idx, sym)),
wp AS (SELECT frame_no, plane_idx, slice_idx, pos // 32 AS word, CASE WHEN pos % 32 + n <= 32 THEN code << CAST(32 - pos % 32 - n AS INT) ELSE code >> CAST(pos % 32 + n - 32 AS INT) END AS value FROM ws
 UNION ALL SELECT frame_no, plane_idx, slice_idx, pos // 32 + 1, (code << CAST(64 - pos % 32 - n AS INT)) & 4294967295 FROM ws WHERE pos % 32 + n > 32),
ww AS (SELECT frame_no, plane_idx, CAST(slice_idx AS INT) AS slice_idx, CAST(word AS INT) AS word, CAST(bit_or(CAST(value AS BIGINT)) AS BIGINT) AS value FROM wp GROUP BY ALL)"""
CHUNKS = f"""{WORDS}, wh AS (SELECT *, printf('%08X', value) AS x FROM ww), sd AS (SELECT frame_no, plane_idx, slice_idx, string_agg({LITTLE.format('x')}, '' ORDER BY word) AS d, 4 * count(*) AS len FROM wh GROUP BY ALL),
sa AS (SELECT frame_no, plane_idx, CAST(unnest(range(least({P.SLICES}, h))) AS INT) AS slice_idx FROM (SELECT DISTINCT frame_no, plane_idx, h FROM pl)),
se AS (SELECT frame_no, plane_idx, slice_idx, coalesce(d, '') AS d, CAST(sum(coalesce(len, 0)) OVER (PARTITION BY frame_no, plane_idx ORDER BY slice_idx) AS BIGINT) AS e FROM sa LEFT JOIN sd USING (frame_no, plane_idx, slice_idx)),
sp AS (SELECT frame_no, plane_idx, string_agg({LITTLE.format("printf('%08X', e)")}, '' ORDER BY slice_idx) AS ends, string_agg(d, '' ORDER BY slice_idx) AS data FROM se GROUP BY ALL),
al AS (SELECT frame_no, plane_idx, sym, code_len FROM hl UNION ALL SELECT frame_no, plane_idx, any_value(sym), 0 FROM hist GROUP BY ALL HAVING count(*) = 1),
ds AS (SELECT frame_no, plane_idx, string_agg(printf('%02X', coalesce(code_len, 255)), '' ORDER BY s) AS ds FROM (SELECT DISTINCT frame_no, plane_idx, unnest(range(256)) AS s FROM pl) LEFT JOIN (SELECT frame_no, plane_idx, sym AS s, code_len FROM al) USING (frame_no, plane_idx, s) GROUP BY ALL)"""
ORACLES: dict[str, str] = {
    "strict_padding": f"""WITH {BITS}, dm AS (SELECT * FROM (VALUES {', '.join(f'({k}, {p}, {x})' for k, some in enumerate(DAMAGED) for p, x in some)}) AS t(k, plane_idx, sl)),
nn AS (SELECT frame_no, plane_idx, sl, count(*) AS n FROM b1 GROUP BY ALL), er AS (SELECT frame_no, plane_idx AS plane, sl AS slice, (n // 32) * 32 + 31 AS bit_position FROM nn JOIN st USING (frame_no, plane_idx) JOIN dm USING (plane_idx, sl) WHERE frame_no % 3 = k AND lo <> hi AND n % 32 <> 0),
fe AS (SELECT frame_no, unnest(min({{'plane': plane, 'slice': slice, 'bit_position': bit_position}})) FROM er GROUP BY frame_no)
SELECT f.frame_no, CASE WHEN plane IS NOT NULL THEN 'NonZeroPadding' END AS variant, CAST(coalesce(plane, -1) AS BIGINT) AS plane, CAST(coalesce(slice, -1) AS BIGINT) AS slice, CAST(coalesce(bit_position, -1) AS BIGINT) AS bit_position FROM (SELECT DISTINCT frame_no FROM px) f LEFT JOIN fe USING (frame_no)""",
    "kraft_incomplete": f"""WITH {BITS}, k0 AS (SELECT frame_no, CASE WHEN lo = hi THEN -1 ELSE frame_no % 3 END AS k FROM st WHERE plane_idx = 0)
SELECT frame_no, CASE k WHEN -1 THEN '0' WHEN 0 THEN '2' ELSE '3' END AS kraft_numerator, k <= 0 AS is_kraft_complete, CAST(CASE k WHEN -1 THEN 0 WHEN 2 THEN 3 ELSE 2 END AS INT) AS active_symbol_count, CAST(CASE k WHEN -1 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS INT) AS max_code_length FROM k0""",
    "slices_roundtrip": f"WITH {LARGE} SELECT frame_no, plane_idx, CAST(i // {P.LARGE_WIDTH} AS INT) AS r, CAST(i % {P.LARGE_WIDTH} AS INT) AS c, v FROM lp",
    "huffman_codes": f"WITH RECURSIVE {CODE_COUNTS}, {HUFFMAN} SELECT frame_no, plane_idx, sym, code_len, code FROM hc",
    "packed_words": f"WITH RECURSIVE {CODE_COUNTS}, {WORDS} SELECT * FROM ww",
    "packed_frames": f"WITH RECURSIVE {CODE_COUNTS.replace(f'({P.SLICES} * (r', f'(least({P.SLICES}, h) * (r').replace(f'slice_idx // {P.SLICES})', f'slice_idx // least({P.SLICES}, h))')}, {CHUNKS} SELECT frame_no, string_agg(ds || ends || data, '' ORDER BY plane_idx) || '00010000' AS chunk FROM sp JOIN ds USING (frame_no, plane_idx) GROUP BY frame_no",
    **{f"residual_{p}": f"WITH {LAGS} SELECT frame_no, plane_idx, CAST(slice_idx AS INT) AS slice_idx, CAST(i AS INT) AS i, (v - ({g})) & 255 AS residual FROM lg" for p, g in GUESS.items()},
    **{f"inverse_{p}": f"WITH {SLICED} SELECT frame_no, plane_idx, CAST(slice_idx AS INT) AS slice_idx, CAST(i AS INT) AS i, v FROM sl" for p in ("none", "left", "gradient")},
    **{f"tiled_residual_{p}": f"WITH {LARGE_LAGS} SELECT frame_no, plane_idx, CAST(i AS INT) AS i, (v - ({GUESS[p]})) & 255 AS residual FROM lg" for p in ("left", "gradient", "median")},
    **{f"tiled_inverse_{p}": f"WITH {LARGE} SELECT frame_no, plane_idx, CAST(i AS INT) AS i, v FROM lp" for p in ("left", "gradient")},
    **{f"stretch_symbols_{p}": f"WITH {LARGE_LAGS} SELECT frame_no, plane_idx, i, (v - ({GUESS[p]})) & 255 AS symbol FROM lg" for p in ("none", "gradient")},
    "connector_roundtrip": f"WITH {LI} SELECT frame_no, plane_idx, r, c, v, 'stream' AS way FROM pl UNION ALL SELECT frame_no, plane_idx, r, c, v, 'table' FROM pl WHERE h % 2 = 0",
    "late_config": f"WITH {LI} SELECT frame_no, plane_idx, r, c, v FROM pl WHERE h % 8 <> {WITHOUT} UNION ALL SELECT DISTINCT frame_no, -1, -1, -1, 0 FROM px WHERE h % 8 = {WITHOUT}",
    "inverse_median": f"""WITH RECURSIVE {SLICED}, rs AS (SELECT frame_no, plane_idx, CAST(slice_idx AS INT) AS slice_idx, list(v ORDER BY i) AS x FROM sl GROUP BY ALL),
iv AS (SELECT *, CAST([] AS INT[]) AS o FROM rs UNION ALL SELECT frame_no, plane_idx, slice_idx, x, list_append(o, (x[n] + CASE WHEN n <= {W} THEN coalesce(o[n - 1], 128) WHEN n = {W + 1} THEN b ELSE greatest(least(a, b), least(greatest(a, b), (a + b - d) & 255)) END) & 255)
 FROM (SELECT *, len(o) + 1 AS n, o[len(o)] AS a, o[len(o) + 1 - {W}] AS b, o[len(o) - {W}] AS d FROM iv) WHERE n <= len(x))
SELECT frame_no, plane_idx, slice_idx, CAST(unnest(range(len(o))) AS INT) AS i, unnest(o) AS v FROM iv WHERE len(o) = len(x)""",
    "residual_histogram": f"WITH {LAGS} SELECT plane_idx, (v - ({GUESS['gradient']})) & 255 AS sym, count(*) AS n FROM lg GROUP BY ALL",
    "entropy_by_predictor": f"WITH {FIRST_ROWS} SELECT predictor, frame_no, plane_idx, round(bits, 4) AS bits FROM bits",
    "choose_predictor": f"""WITH {FIRST_ROWS}, p AS (PIVOT bits ON predictor IN ('none', 'left', 'gradient', 'median') USING first(bits)), q AS (SELECT *, CASE WHEN median + 1e-6 < gradient THEN 'median' ELSE 'gradient' END AS n1, CASE WHEN median + 1e-6 < gradient THEN median ELSE gradient END AS b1 FROM p),
t AS (SELECT *, CASE WHEN "left" + 1e-6 < b1 THEN 'left' ELSE n1 END AS n2, CASE WHEN "left" + 1e-6 < b1 THEN "left" ELSE b1 END AS b2 FROM q) SELECT frame_no, plane_idx, CASE WHEN "none" + 1e-6 < b2 THEN 'none' ELSE n2 END AS predictor FROM t""",
    "rgb_forward": f"WITH {LI} SELECT frame_no, r, c, g, (b - g + 128) & 255 AS b, (x - g + 128) & 255 AS x FROM px",
    "rgb_inverse": f"WITH {LI} SELECT frame_no, r, c, g, b, x FROM px",
    "slice_partition": f"WITH {LI}, f AS (SELECT DISTINCT frame_no, h FROM px), s AS (SELECT frame_no, h, unnest(range({P.SLICES})) AS s FROM f), p AS (SELECT frame_no, unnest([0, 1, 2]) AS plane_idx, CAST(s AS INT) AS slice_idx, CAST(h * s // {P.SLICES} AS INT) AS row_start, CAST(h * (s + 1) // {P.SLICES} AS INT) AS row_end FROM s) SELECT *, CAST((row_end - row_start) * {W} AS BIGINT) AS pixel_count FROM p WHERE row_end > row_start",
    "huffman_cost": f"""WITH RECURSIVE {CODE_COUNTS}, t AS (SELECT frame_no, plane_idx, list_sort(list(n)) AS w, CAST(0 AS BIGINT) AS bits FROM hist GROUP BY ALL UNION ALL
SELECT frame_no, plane_idx, list_sort(list_append(w[3:], w[1] + w[2])), CAST(bits + w[1] + w[2] AS BIGINT) FROM t WHERE len(w) > 1) SELECT frame_no, plane_idx, bits FROM t WHERE len(w) = 1""",
    "kraft_check": f"WITH {CODE_COUNTS} SELECT frame_no, plane_idx, frame_no % 3 = 0 AS complete, frame_no % 3 <> 0 AS below FROM hist GROUP BY ALL HAVING count(*) > 1",
    "canonical_order": f"""WITH {CODE_COUNTS}, k AS (SELECT *, row_number() OVER (PARTITION BY frame_no, plane_idx ORDER BY n DESC, sym) AS k, least(12, count(*) OVER (PARTITION BY frame_no, plane_idx)) AS m FROM hist), l AS (SELECT frame_no, plane_idx, sym, CAST(least(k, m - 1) AS INT) AS code_len, m - 1 AS mx FROM k WHERE k <= m AND m >= 2)
SELECT frame_no, plane_idx, sym, code_len, CAST(coalesce(sum(1 << (mx - code_len)) OVER (PARTITION BY frame_no, plane_idx ORDER BY code_len DESC, sym DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) >> (mx - code_len) AS code FROM l""",
    "format_geometry": f"""WITH {CONFIGS}, k AS (SELECT *, unnest(CASE WHEN fourcc = 'ULRA' THEN [0, 1, 2, 3] ELSE [0, 1, 2] END) AS plane_idx FROM cf WHERE fourcc != 'ABCD')
SELECT o_orderkey, plane_idx, CASE WHEN fourcc IN ('ULRG', 'ULRA') THEN ['G', 'B', 'R', 'A'][plane_idx + 1] ELSE ['Y', 'U', 'V'][plane_idx + 1] END AS label, CASE WHEN fourcc IN ('ULY0', 'ULY2') AND plane_idx > 0 THEN width // 2 ELSE width END AS pw, CASE WHEN fourcc = 'ULY0' AND plane_idx > 0 THEN height // 2 ELSE height END AS ph, fourcc IN ('ULRG', 'ULRA') AS is_rgb, fourcc = 'ULRA' AS has_alpha,
CASE fourcc WHEN 'ULY0' THEN '59563132' WHEN 'ULY2' THEN '59555932' WHEN 'ULY4' THEN '59563234' WHEN 'ULRG' THEN '00000118' ELSE '00000218' END AS tag FROM k""",
    "config_errors": f"""WITH {CONFIGS}, v AS (SELECT o_orderkey, CASE WHEN fourcc = 'ABCD' THEN 'UnknownFourcc' WHEN width <= 0 OR height <= 0 OR (fourcc = 'ULY0' AND (width % 2 = 1 OR height % 2 = 1)) OR (fourcc = 'ULY2' AND width % 2 = 1) THEN 'DimensionConstraint' END AS variant, fourcc, width, height FROM cf)
SELECT o_orderkey, variant, CASE WHEN variant IS NOT NULL THEN 'StreamShape' END AS category, variant IS NOT NULL AS is_stream_shape,
CASE variant WHEN 'UnknownFourcc' THEN 'no layout has the FourCC 41424344' WHEN 'DimensionConstraint' THEN 'a size of ' || width || ' x ' || height || ' does not suit the layout: ' || CASE WHEN width <= 0 OR height <= 0 THEN 'both must be positive' WHEN fourcc = 'ULY0' THEN 'both must be even' ELSE 'the width must be even' END END AS message FROM v""",
    "extradata_fields": f"""WITH {CONFIGS}, k AS (SELECT *, o_orderkey % 7 AS m, 'F0000001' || CASE fourcc WHEN 'ULY0' THEN '59563132' WHEN 'ULY2' THEN '59555932' WHEN 'ULY4' THEN '59563234' WHEN 'ULRG' THEN '00000118' ELSE '00000218' END AS head FROM cf WHERE fourcc != 'ABCD'),
r AS (SELECT o_orderkey, CASE m WHEN 1 THEN head || '04000000' WHEN 2 THEN head || '05000000010000' || printf('%02X', n - 1) WHEN 3 THEN head || '0400000000000000' WHEN 4 THEN head || '0400000001080000' ELSE head || '04000000010000' || printf('%02X', n - 1) END AS data,
CASE m WHEN 1 THEN 'ExtradataTruncated' WHEN 2 THEN 'InvalidFrameInfoSize' WHEN 3 THEN 'HuffmanBitClear' WHEN 4 THEN 'InterlacedNotSupported' END AS variant, CAST(CASE WHEN m IN (1, 2, 3, 4) THEN -1 ELSE 16777456 END AS BIGINT) AS version, CASE WHEN m IN (1, 2, 3, 4) THEN -1 ELSE n END AS num_slices, n BETWEEN 1 AND 256 AS good FROM k)
SELECT o_orderkey, CASE WHEN good THEN data END AS data, CASE WHEN good THEN variant END AS variant, CASE WHEN good THEN version ELSE -1 END AS version, CASE WHEN good THEN num_slices ELSE -1 END AS num_slices FROM r""",
    "frame_info_predictor": "SELECT o_orderkey, CAST(((o_orderkey * 12345 % 4294967296) >> 8) & 3 AS INT) AS predictor, CAST((((o_orderkey * 12345 % 4294967296) >> 8) & 3) << 8 AS BIGINT) AS frame_info FROM orders",
    "sample_geometry": SAMPLE_GEOMETRY,
    **{q: ALPHA_SQL if "ulra" in q else PLANES_SQL for q in QUERIES if q.startswith("roundtrip_") or q in ("stream_roundtrip", "sql_roundtrip", "pixels_lateral")},
    "embeddings_roundtrip": f"WITH {EMB} SELECT frame_no, k AS plane_idx, r, c, v FROM ep, (SELECT unnest([0, 1, 2]) AS k)",
    "layout_identities": f"WITH {LI} SELECT frame_no, CAST(count(*) * 3 AS BIGINT) AS total_pixels, true AS size_is_length, true AS complete FROM px GROUP BY frame_no",
    **dict.fromkeys(("slice_layout", "slices_lateral"), f"WITH {LI}, f AS (SELECT DISTINCT frame_no, h, least({P.SLICES}, h) AS n FROM px), s AS (SELECT frame_no, h, n, unnest(range(n)) AS s FROM f), p AS (SELECT frame_no, unnest([0, 1, 2]) AS plane_idx, CAST(s AS INT) AS slice_idx, CAST(h * s // n AS INT) AS row_start, CAST(h * (s + 1) // n AS INT) AS row_end FROM s) SELECT *, CAST((row_end - row_start) * {W} AS BIGINT) AS pixel_count FROM p"),
    "malformed_taxonomy": f"WITH {LI}, f AS (SELECT DISTINCT frame_no FROM px), v AS (SELECT frame_no, CASE frame_no % 6 WHEN 0 THEN 'MissingFrameInfo' WHEN 1 THEN 'ChunkTooShort' WHEN 2 THEN 'MultipleSingleSymbolSentinels' WHEN 3 THEN 'SliceNotWordAligned' WHEN 4 THEN 'ChunkTooShort' END AS variant FROM f) SELECT frame_no, variant, CASE WHEN variant IS NOT NULL THEN 'MalformedStream' END AS category, CASE frame_no % 6 WHEN 0 THEN 'the payload is too short for the word that ends it' WHEN 1 THEN 'the payload ends early: 256 bytes are due at 0, 196 are left' WHEN 2 THEN 'more than one symbol claims to be the only one' WHEN 3 THEN 'a slice ends at byte 1, which is not a whole number of 32-bit words' END AS message FROM v",
    "wire_bytes": f"WITH {BITS} SELECT frame_no, string_agg(ds || ends || data, '' ORDER BY plane_idx) || '00000000' AS chunk FROM pp GROUP BY frame_no",
    "plane_statistics": f"""WITH {BITS} SELECT frame_no, plane_idx, ofs AS descriptor_start, ofs + 256 AS end_offsets_start, ofs + 256 + 4 * ns AS slice_data_start, total AS slice_data_total, CAST(lo = hi AS INT) AS zero_count, CASE WHEN lo = hi THEN 255 ELSE 254 END AS absent_count,
CASE WHEN lo = hi THEN 0 ELSE 2 END AS active_symbol_count, CASE WHEN lo = hi THEN 255 ELSE 254 END AS unused_symbol_count, CAST(lo <> hi AS INT) AS min_len, CASE WHEN lo = hi THEN 0 ELSE 2 END AS min_code_length_symbol_count, CASE WHEN lo = hi THEN '' ELSE '1:2' END AS tiers, CASE WHEN lo = hi THEN '0' ELSE '2' END AS kraft_numerator, true AS is_kraft_complete FROM pp""",
    "slice_extents": f"WITH {BITS} SELECT frame_no, plane_idx, CAST(sl AS INT) AS slice_idx, ofs + 256 + 4 * pp.ns + e - len AS start, ofs + 256 + 4 * pp.ns + e AS \"end\", len, len = 0 AS is_empty, CAST(h * (sl + 1) // se.ns - h * sl // se.ns AS INT) AS row_count FROM se JOIN pp USING (frame_no, plane_idx)",
    "stride_errors": f"""WITH {LI}, f AS (SELECT frame_no, max(h) AS h, frame_no % 5 AS k FROM px GROUP BY frame_no) SELECT frame_no, CASE k WHEN 1 THEN 'InvalidInput' WHEN 2 THEN 'EncoderPlaneSizeMismatch' WHEN 3 THEN 'EncoderPlaneSizeMismatch' END AS variant, CAST(CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 END AS BIGINT) AS plane,
CASE k WHEN 1 THEN 'the input cannot be used: plane 1, plane_width 12, stride 8' WHEN 2 THEN 'plane 2: ' || (h * 16 - 1) || ' given where ' || h * 16 || ' are due' WHEN 3 THEN 'plane 2: 2 given where 3 are due' END AS message, CAST(CASE WHEN k IN (1, 2, 3) THEN -1 ELSE 36 * h END AS INT) AS bytes FROM f""",
    "stream_parameters": f"""WITH {CONFIGS}, p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 != 8 THEN fourcc END AS f, CASE WHEN o_orderkey % 10 != 9 THEN width END AS w, height AS h, n, n BETWEEN 1 AND 256 AND fourcc != 'ABCD' AND o_orderkey % 11 != 10 AS has FROM cf),
d AS (SELECT *, f IS NULL OR f = 'ABCD' OR w IS NULL OR NOT has AS deferred FROM p), v AS (SELECT *, CASE WHEN NOT deferred AND (w <= 0 OR h <= 0 OR (f = 'ULY0' AND (w % 2 = 1 OR h % 2 = 1)) OR (f = 'ULY2' AND w % 2 = 1)) THEN 'DimensionConstraint' END AS variant FROM d)
SELECT o_orderkey, deferred, variant, CASE WHEN NOT deferred AND variant IS NULL THEN n END AS num_slices FROM v""",
    "stride_repack": f"WITH {LI} SELECT frame_no, plane_idx, r, c, v FROM pl WHERE c < 12",
}
