"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text, windows compressed with both.

A window is a word with a space on both sides, or each STRETCH bytes of a longer one; it is laid down LAID times, as blocks of a
few bytes are not compressed at all. What the two dictionaries make of it, beside its own length, is a cell; labelled documents
tell the log odds of each cell, which are the calibrated thresholds of a window. A document's score is a logistic regression on the
highest log odds of its distinct windows, their mean, and how many are above a few levels.

The toxic dictionary is trained on those words of toxic documents that stand out there (by a test of their share of documents),
the ordinary one on whole stretches of ordinary text. At most SAMPLE labelled rows are learnt from, those of smallest hash of doc_id
among the rows whose crc32(doc_id as text) mod FOLDS is not 0; of their words at most WINDOWS stretches train each dictionary.
Only the text enters a score.

Defined cases: null and empty texts have no windows and get the score of a document without any; very long texts and words are taken
whole; equal texts get equal scores, so ties and repeated rows are scored alike; a null doc_id is not held out and has no label; of
several labels of a doc_id the highest counts, null labels do not; without labels of both kinds the score of every document is the share of toxic
labels, 0 without labels; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, smallest, stored

#: Labelled rows that are learnt from, parts of which one is held out, and stretches of words that train a dictionary.
SAMPLE, FOLDS, WINDOWS = 20_000, 5, 40_000
#: Toxic documents that a word needs, and standard deviations that its share among them must be above the global one.
SUPPORT, TELLING = 3, 4.5
#: Bytes of the dictionaries of toxic and of ordinary text, words of a stretch that trains them.
TOXIC_BYTES, ORDINARY_BYTES, STRETCH_WORDS = 8192, 32_768, 16
#: Bytes of the segments and of their parts that the toxic dictionary is covered by; zstandard's own search for them ends with a smaller dictionary.
COVER = {"k": 48, "d": 8}
#: Most bytes of a window, times that it is laid down, and windows whose cells a task remembers.
STRETCH, LAID, MEMORY = 30, 3, 400_000
#: Lengths in a cell end here; a cell that fewer documents have says nothing.
LENGTHS, SEEN = 64, 5
#: Log odds above which windows are counted, and how many highest ones are added up.
LEVELS, HIGHEST = (1.0, 2.0, 3.0), (1, 2, 4, 8)
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def windows(text: bytes) -> set[bytes]:
    """Distinct words without digits and marks, A-Z as a-z, long ones in stretches."""
    words = set(text.translate(LETTERS).split())
    if max(map(len, words), default=0) > STRETCH:
        long = {w for w in words if len(w) > STRETCH}
        words = (words - long) | {w[k : k + STRETCH] for w in long for k in range(0, len(w), STRETCH)}
    return words


def trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """A dictionary of at most size bytes; the end of the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(dictionary: bytes) -> Callable[[bytes], bytes]:
    own = zstandard.ZstdCompressionDict(dictionary)
    how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=17, search_log=10, min_match=5, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_dict_id=False)
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how).compress


class Distance:
    """Cells of windows under the two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self._toxic, self._ordinary, self._known = compressor(toxic), compressor(ordinary), {}

    def cells(self, some: Iterable[bytes]) -> np.ndarray:
        known, out = self._known, []
        if len(known) > MEMORY:
            known.clear()
        for w in some:
            cell = known.get(w)
            if cell is None:
                laid = (b" " + w + b" ") * LAID
                cell = known[w] = (len(w) * LENGTHS + min(len(self._ordinary(laid)), LENGTHS - 1)) * LENGTHS + min(len(self._toxic(laid)), LENGTHS - 1)
            out.append(cell)
        return np.array(out, np.int64)


def evidence(odds: np.ndarray) -> list[float]:
    """What the regression sees of a document, from the log odds of its windows."""
    v = np.sort(odds)[::-1]
    above = [int((v > x).sum()) for x in LEVELS]
    return [*(float(v[:k].sum()) for k in HIGHEST), float(v.mean()) if len(v) else 0.0, float(np.log1p(len(v))), *map(float, above), *map(float, np.log1p(above))]


class Model:
    """Dictionaries, log odds by cell, and the regression; without dictionaries one score for all."""

    def __init__(self, share: float, toxic: bytes = b"", ordinary: bytes = b"", odds: np.ndarray | None = None, weights: np.ndarray | None = None):
        self.share, self.toxic, self.ordinary, self.odds, self.weights = share, toxic, ordinary, odds, weights

    def scorer(self) -> Callable[[bytes], float]:
        if self.weights is None:
            return lambda _: self.share
        distance, w = Distance(self.toxic, self.ordinary), self.weights
        return lambda text: float(1 / (1 + np.exp(-np.clip(w[0] + w[1:] @ np.array(evidence(self.odds[distance.cells(windows(text))])), -500, 500))))


def regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the constant first, of a logistic regression on standardised columns with a unit penalty, by Newton's steps."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w, hold = np.zeros(z.shape[1]), np.ones(z.shape[1])
    hold[0] = 1e-9
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (p - y) + hold * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    own = w[1:] / spread
    return np.concatenate([[w[0] - own @ mean], own])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    chosen = F.broadcast(smallest(stored(known), F.xxhash64("doc_id"), sample))  # `sample` rows at most
    texts = docs.select("doc_id", as_bytes()).join(chosen, "doc_id").select("toxic", "text")
    seen = stored(map_batches(texts, lambda: lambda b: {"toxic": b.column(0), "windows": [sorted(windows(t)) for t in b.column(1).to_pylist()], "words": [t.translate(LETTERS).split() for t in b.column(1).to_pylist()]}, "toxic int, windows array<binary>, words array<binary>"))
    total, toxic = seen.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    share = (toxic or 0) / max(total, 1)
    if not 0 < share < 1:
        return Model(share)
    counts = seen.select("toxic", F.explode("windows").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= SUPPORT)
    telling = counts.where((F.col("toxic") - F.col("n") * share) >= TELLING * F.sqrt(F.col("n") * share * (1 - share))).select("w")

    def stretches(rows: DataFrame) -> list[bytes]:
        """At most WINDOWS stretches of (words) rows, those of smallest hash."""

        def make():
            def run(batch: pa.RecordBatch) -> dict:
                return {"s": [b" " + b" ".join(ws[k : k + STRETCH_WORDS]) + b" " for ws in batch.column(0).to_pylist() for k in range(0, len(ws), STRETCH_WORDS)]}

            return run

        return [bytes(r.s) for r in smallest(stored(map_batches(rows, make, "s binary")), F.xxhash64("s"), WINDOWS).collect()]

    marked = seen.where("toxic = 1").select(F.monotonically_increasing_id().alias("row"), F.explode("windows").alias("w")).join(telling, "w").groupBy("row").agg(F.sort_array(F.collect_list("w")).alias("words")).select("words")
    toxic_text, ordinary_text = stretches(marked), stretches(seen.where("toxic = 0").select("words"))
    if not toxic_text or not ordinary_text:
        return Model(share)
    model = Model(share, trained(toxic_text, TOXIC_BYTES, **COVER), trained(ordinary_text, ORDINARY_BYTES))

    def in_cells():
        distance = Distance(model.toxic, model.ordinary)
        return lambda batch: {"toxic": batch.column(0), "cells": [distance.cells(ws) for ws in batch.column(1).to_pylist()]}

    placed = stored(map_batches(seen.select("toxic", "windows"), in_cells, "toxic int, cells array<long>"))
    found = placed.select("toxic", F.explode(F.array_distinct("cells")).alias("cell")).groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).toArrow()  # as many rows as there are cells at most
    size = (STRETCH + 1) * LENGTHS * LENGTHS
    ill, all_ = np.zeros(size), np.zeros(size)
    ill[found["cell"].to_numpy()], all_[found["cell"].to_numpy()] = found["toxic"].to_numpy(), found["n"].to_numpy()
    odds = np.log((ill + 0.5 * share) / toxic) - np.log((all_ - ill + 0.5 * (1 - share)) / (total - toxic))
    model.odds = np.where(all_ < SEEN, 0.0, odds)
    rows = map_batches(placed, lambda: lambda b: {"toxic": b.column(0), "x": [evidence(model.odds[np.array(c, np.int64)]) for c in b.column(1).to_pylist()]}, "toxic int, x array<double>").toArrow()  # a short row for a labelled one
    model.weights = regression(np.array(rows["x"].to_pylist()), rows["toxic"].to_numpy())
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score 0 to 1, predicted 0 or 1) of every document."""
    model = fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        one = model.scorer()
        return lambda batch: {"doc_id": batch.column(0), "held_out": batch.column(1), "score": [one(t) for t in batch.column(2).to_pylist()]}

    out = map_batches(docs.select("doc_id", held_out().alias("held_out"), as_bytes()), make, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
