"""Spatial prediction and its inverse over pixel rows, as window functions.

Pixels are rows (key columns, i, v): key names one slice, i counts its samples in scan order, v is 0..255. All arithmetic is
modulo 256. A slice is one window partition; for slices too large for that use the codec's kernels, which take a slice as bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import FIRST


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def med(a: Column, b: Column, c: Column) -> Column:
    """Median of two neighbours and their modular gradient."""
    return median3(a, b, (a + b - c).bitwiseAND(F.lit(255)))


def guesses(width: int, key: list[str], v: str = "v") -> dict[str, Column]:
    """What each predictor expects of column v, all over one window."""
    w = Window.partitionBy(*key).orderBy("i")
    a, b, d = F.lag(v, 1).over(w), F.lag(v, width).over(w), F.lag(v, width + 1).over(w)
    r, c = F.floor(F.col("i") / width), F.col("i") % width
    left = F.coalesce(a, F.lit(FIRST))
    return {
        "none": F.lit(0),
        "left": left,
        "gradient": F.when(r == 0, left).when(c == 0, b).otherwise((a + b - d).bitwiseAND(F.lit(255))),
        "median": F.when(r == 0, left).when((c == 0) & (r == 1), b).otherwise(med(a, b, d)),
    }


def residual(pixels: DataFrame, predictor: str, width: int, key: list[str]) -> DataFrame:
    """pixels with residual, for one of none, left, gradient, median."""
    return pixels.withColumn("residual", (F.col("v") - guesses(width, key)[predictor]).bitwiseAND(F.lit(255)).cast("int"))


def residual_of_planes(pixels: DataFrame, predictor: str, width: int, key: list[str], planes: tuple[str, ...] = ("g", "b", "x")) -> DataFrame:
    """(key, i, and each plane's residual under its name) of pixels(key, i, planes): one sort serves all planes."""
    own = {p: (F.col(p) - guesses(width, key, p)[predictor]).bitwiseAND(F.lit(255)).cast("int").alias(p) for p in planes}
    return pixels.select(*key, "i", *own.values())


def residuals_of_all(pixels: DataFrame, width: int, key: list[str]) -> DataFrame:
    """A row for each pixel and predictor, with residual: one sort serves all predictors."""
    every = [F.struct(F.lit(p).alias("predictor"), (F.col("v") - g).bitwiseAND(F.lit(255)).cast("int").alias("residual")) for p, g in guesses(width, key).items()]
    return pixels.withColumn("_all", F.array(*every)).select(*pixels.columns, F.inline("_all"))


def inverse(residuals: DataFrame, predictor: str, width: int, key: list[str]) -> DataFrame:
    """residuals(key, i, residual) with v restored, for the linear predictors: running sums in one or two dimensions."""
    total = lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if predictor == "none":
        return residuals.withColumn("v", F.col("residual"))
    if predictor == "left":
        return residuals.withColumn("v", (F.lit(FIRST) + total("residual", Window.partitionBy(*key).orderBy("i"))).bitwiseAND(F.lit(255)).cast("int"))
    if predictor != "gradient":
        raise ValueError("the median has no linear inverse; see inverse_median")
    r, c = F.floor(F.col("i") / width).cast("int"), (F.col("i") % width).cast("int")
    out = residuals.withColumn("_r", r).withColumn("_c", c).withColumn("_s", total("residual", Window.partitionBy(*key, "_r").orderBy("_c")))
    out = out.withColumn("v", (F.lit(FIRST) + total("_s", Window.partitionBy(*key, "_c").orderBy("_r"))).bitwiseAND(F.lit(255)).cast("int"))
    return out.drop("_r", "_c", "_s")


def inverse_median(residuals: DataFrame, width: int, key: list[str]) -> DataFrame:
    """residuals(key, i, residual) with v restored, for the median predictor: each sample needs the one before it, so a slice is folded
    row by row, with the row above as state. A slice is one array of rows; slices are dealt out."""
    r = F.floor(F.col("i") / width).cast("int")
    rows = residuals.groupBy(*key, r.alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "residual"))), lambda x: x["residual"].cast("int")).alias("res"))
    whole = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("r", "res"))).alias("rows"))
    byte = lambda x: x.bitwiseAND(F.lit(255)).cast("int")
    empty = F.array().cast("array<int>")

    def row(state: Column, x: Column) -> Column:
        """The state (row above, last sample of the row above that, rows so far) after a row."""
        up, corner, res = state["up"], state["corner"], x["res"]

        def sample(now: Column, c: Column) -> Column:
            top = F.get(up, c)
            left = F.when(c > 0, F.element_at(now, -1)).otherwise(F.element_at(up, -1))
            guess = F.when(F.size(up) == 0, F.when(c > 0, F.element_at(now, -1)).otherwise(F.lit(FIRST))).when((c == 0) & corner.isNull(), top).otherwise(med(left, top, F.when(c > 0, F.get(up, c - 1)).otherwise(corner)))
            return F.concat(now, F.array(byte(F.get(res, c) + guess)))

        now = F.aggregate(F.sequence(F.lit(0), F.size(res) - 1), empty, sample)
        last = F.when(F.size(up) > 0, F.element_at(up, -1))
        return F.get(F.transform(F.array(now), lambda n: F.struct(n.alias("up"), last.alias("corner"), F.concat(state["out"], F.array(n)).alias("out"))), F.lit(0))

    start = F.struct(empty.alias("up"), F.lit(None).cast("int").alias("corner"), F.array().cast("array<array<int>>").alias("out"))
    out = whole.select(*key, F.flatten(F.aggregate("rows", start, row, lambda s: s["out"])).alias("v"), F.flatten(F.transform("rows", lambda x: x["res"])).alias("res"))
    return out.select(*key, F.posexplode(F.arrays_zip("res", "v")).alias("i", "x")).select(*key, "i", F.col("x.res").alias("residual"), F.col("x.v").alias("v"))


def decorrelated(g: Column, x: Column) -> Column:
    """B or R against G."""
    return (x - g + F.lit(FIRST)).bitwiseAND(F.lit(255)).cast("int")


def correlated(g: Column, x: Column) -> Column:
    return (x + g - F.lit(FIRST)).bitwiseAND(F.lit(255)).cast("int")
