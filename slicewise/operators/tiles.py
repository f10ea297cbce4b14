"""Prediction and its linear inverses over tiles, for slices of any size.

The window forms in `predict` order a whole slice in one window partition. Here a slice is cut up, so that no partition, sort
or task grows with it. Residuals look back at most a row and a sample in scan order, so a block of samples needs that many of the
block before it, its halo, and no more. The inverse of `left` is a running sum: within blocks, plus the sum of the blocks before.
The inverse of `gradient` is a running sum in two dimensions: a sample is the sum of its own tile up to it, of the tiles to the left
up to its row, of those above up to its column, and of all tiles above and to the left; the last three are running sums over tiles of
sums of rows, of columns and of whole tiles, and stand in front of the tile's own rows and columns.

Rows are (key columns, i, v or residual) as in `predict`; i counts a slice's samples in scan order. Tables without rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import FIRST
from .predict import guesses

#: Samples of a block, at least a row and a sample; rows and columns of a tile.
BLOCK, TILE = 1 << 14, 128
#: Samples of a task.
TASK = 1 << 19


def with_halo(pixels: DataFrame, width: int, block: int) -> DataFrame:
    """pixels with block, and halo for the last samples of the block before, which the next block's first ones look back at."""
    own = F.floor(F.col("i") / block).cast("int")
    back = F.col("i") >= (own + 1) * block - (width + 1)
    both = F.when(back, F.array(F.struct(own.alias("block"), F.lit(False).alias("halo")), F.struct((own + 1).alias("block"), F.lit(True).alias("halo")))).otherwise(F.array(F.struct(own.alias("block"), F.lit(False).alias("halo"))))
    return pixels.select(*pixels.columns, F.inline(both))


def tasks(samples: int, at_least: int) -> int:
    """How many tasks so many samples are dealt to."""
    return max(at_least, -(-samples // TASK))


def residual(pixels: DataFrame, predictor: str, width: int, key: list[str], block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """pixels with residual, as `predict.residual` gives it.

    partitions (see `tasks`): blocks are dealt to so many tasks, which then sort a bounded number of samples. Otherwise Spark puts tasks
    together by compressed bytes, and samples compress well.
    """
    cut = with_halo(pixels, width, max(block, width + 1))
    if partitions:
        cut = cut.repartition(partitions, *key, "block")
    guess = guesses(width, [*key, "block"])[predictor]
    return cut.withColumn("residual", (F.col("v") - guess).bitwiseAND(F.lit(255)).cast("int")).where(~F.col("halo")).select(*pixels.columns, "residual")


def running(c: str, by: list[str], order: str, own: bool = True) -> Column:
    """The sum of a column up to a row, or (own is False) of the rows before it."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) if own else F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def inverse_left(residuals: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """residuals(key, i, residual) with v restored."""
    cut = residuals.withColumn("_b", F.floor(F.col("i") / block))
    carry = cut.groupBy(*key, "_b").agg(F.sum("residual").alias("_n")).withColumn("_before", running("_n", key, "_b", own=False)).drop("_n")
    out = cut.withColumn("_own", running("residual", [*key, "_b"], "i")).join(carry, [*key, "_b"])
    return out.withColumn("v", (F.lit(FIRST) + F.col("_before") + F.col("_own")).bitwiseAND(F.lit(255)).cast("int")).select(*residuals.columns, "v")


def inverse_gradient(residuals: DataFrame, width: int, key: list[str], tile: int = TILE) -> DataFrame:
    """residuals(key, i, residual) with v restored. What lies to the left of a tile, above it and in both comes to it as a column, a row and
    a corner of further residuals in front of its own, so that the samples are dealt out once, by tile."""
    r, c = F.floor(F.col("i") / width).cast("int"), (F.col("i") % width).cast("int")
    others = [x for x in residuals.columns if x != "residual"]
    cut = residuals.withColumns({"_r": r, "_c": c, "_tr": F.floor(r / tile).cast("int"), "_tc": F.floor(c / tile).cast("int"), "_n": F.col("residual").cast("bigint")})
    of = [*key, "_tr", "_tc"]
    rows = cut.groupBy(*of, "_r").agg(F.sum("_n").alias("_n"))
    columns = cut.groupBy(*of, "_c").agg(F.sum("_n").alias("_n"))
    # tiles above and to the left: running sums of whole tiles along one axis, then along the other
    whole = rows.groupBy(*of).agg(F.sum("_n").alias("_n")).withColumn("_left", running("_n", [*key, "_tr"], "_tc", own=False))
    corner = whole.withColumn("_n", running("_left", [*key, "_tc"], "_tr", own=False)).withColumns({"_r": F.lit(-1), "_c": F.lit(-1)})
    left = rows.withColumn("_n", running("_n", [*key, "_r"], "_tc", own=False)).withColumn("_c", F.lit(-1))
    above = columns.withColumn("_n", running("_n", [*key, "_tc", "_c"], "_tr", own=False)).withColumn("_r", F.lit(-1))
    all_ = cut.select(*of, "_r", "_c", "_n", *(x for x in others if x not in key), "residual")
    for more in (left, above, corner):
        all_ = all_.unionByName(more.select(*of, "_r", "_c", "_n"), allowMissingColumns=True)
    own = all_.repartition(*of).withColumn("_n", running("_n", [*of, "_r"], "_c")).withColumn("_n", running("_n", [*of, "_c"], "_r"))
    out = own.where((F.col("_r") >= 0) & (F.col("_c") >= 0))
    return out.withColumn("v", (F.lit(FIRST) + F.col("_n")).bitwiseAND(F.lit(255)).cast("int")).select(*residuals.columns, "v")
