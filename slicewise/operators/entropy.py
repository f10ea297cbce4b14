"""Histograms, entropy, predictor choice, code assignment and Kraft sums as aggregations and windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schemas import few, plus
from . import kernels

#: Rows of a plane that predictor choice looks at.
SAMPLE_ROWS = 8
#: The order in which predictors are tried; a later one must be better by more than this.
TRIED, SLACK = ("gradient", "median", "left", "none"), 1e-6


def histogram(residuals: DataFrame, key: list[str]) -> DataFrame:
    """(key, sym, n) over all slices of a plane."""
    return residuals.groupBy(*key, F.col("residual").alias("sym")).agg(F.count(F.lit(1)).alias("n"))


def entropy(counts: DataFrame, key: list[str]) -> DataFrame:
    """(key, total, bits): the sum of n * log2(total) - n * log2(n), from (key, sym, n)."""
    total = counts.groupBy(*key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("own"))
    return total.select(*key, "total", (F.col("total") * F.log2("total") - F.col("own")).alias("bits"))


def choose(bits: dict[str, Column]) -> Column:
    """The predictor of least bits, tried in order, each against the best so far."""
    best, name = bits[TRIED[0]], F.lit(TRIED[0])
    for p in TRIED[1:]:
        better = bits[p] + SLACK < best
        best, name = F.when(better, bits[p]).otherwise(best), F.when(better, F.lit(p)).otherwise(name)
    return name


def code_lengths(counts: DataFrame, key: list[str]) -> DataFrame:
    """(key, sym, code_len) of the symbols in use; 0 for an only symbol. A group is one plane's histogram, 256 rows at most."""
    schema = plus(counts.select(*key).schema, "sym int, code_len int")

    def lengths(group: pa.Table) -> pa.Table:
        n = np.zeros(256, np.int64)
        n[group["sym"].to_numpy()] = group["n"].to_numpy()
        d = kernels.code_lengths(n)
        used = np.flatnonzero(d != kernels.UNUSED)
        names = {c: pa.array([group[c][0].as_py()] * len(used), group.schema.field(c).type) for c in key}
        return pa.table({**names, "sym": pa.array(used, pa.int32()), "code_len": pa.array(d[used].astype(np.int32))})

    return counts.select(*key, "sym", "n").groupBy(*key).applyInArrow(lengths, schema)


def canonical_codes(lengths: DataFrame, key: list[str]) -> DataFrame:
    """(key, sym, code_len, code) from lengths that satisfy Kraft: a running sum over (length, symbol), both descending."""
    some = lengths.where(F.col("code_len") > 0)
    most = F.max("code_len").over(Window.partitionBy(*key))
    before = Window.partitionBy(*key).orderBy(F.desc("code_len"), F.desc("sym")).rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("_share", F.pow(F.lit(2.0), most - F.col("code_len")).cast("bigint"))
    acc = F.coalesce(F.sum("_share").over(before), F.lit(0)).cast("bigint")
    return some.withColumn("code", F.floor(acc / F.col("_share")).cast("bigint")).drop("_share")


def kraft(lengths: DataFrame, key: list[str]) -> DataFrame:
    """(key, max_len, numerator, complete): the sum of 2 ** (max_len - code_len) against 2 ** max_len, for lengths up to 32."""
    some = lengths.where(F.col("code_len") > 0)
    most = some.groupBy(*key).agg(F.max("code_len").alias("max_len"))
    out = some.join(most, key).groupBy(*key, "max_len").agg(F.sum(F.pow(F.lit(2.0), F.col("max_len") - F.col("code_len"))).cast("bigint").alias("numerator"))
    return out.withColumn("complete", F.col("numerator") == F.pow(F.lit(2.0), F.col("max_len")).cast("bigint"))


def chosen_predictors(planes: DataFrame, width: str, height: str, samples: str) -> DataFrame:
    """planes with predictor (0..3), from the entropies of the first rows as one slice; a plane without samples gets gradient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            out = []
            for w, h, x in zip(*(batch[c].to_pylist() for c in (width, height, samples)), strict=True):
                x, best, pick = np.frombuffer(x or b"", np.uint8)[: (w or 0) * min(SAMPLE_ROWS, h or 0)], None, 2
                for name in TRIED if len(x) else ():
                    p = ("none", "left", "gradient", "median").index(name)
                    n = np.bincount(kernels.residuals(p, x, w), minlength=256)
                    n = n[n > 0].astype(float)
                    bits = float((n * np.log2(n.sum()) - n * np.log2(n)).sum())
                    if best is None or bits + SLACK < best:
                        best, pick = bits, p
                out.append(pick)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "predictor"])

    return planes.mapInArrow(run, plus(planes.schema, "predictor int"))
