"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

Evidence of a document: two logistic regressions on its telling words and binned shape statistics, one for low quality and one
for toxicity, fitted on at most `sample` labelled rows (those of smallest hash of doc_id); a document is bad if it is either. A
word is telling if its rate among such rows is too far from the global one for chance. Evidence of sites: grouped
aggregation sums the evidence of all documents by path and by host. A path's rate of bad documents is shrunk toward its host's
and a host's toward the global rate; how strongly is estimated from the spread of the rates (method of moments). A document's
odds are then multiplied by its path's posterior odds over the global odds.

Defined cases: null text has no words; null host or path is a site of its own; without labels of both kinds the evidence is
neutral and nothing is rejected; repeated rows are scored alike; very long texts are taken whole; words that tell equally much are taken
in their order, a document just at the threshold is rejected; columns of documents that bear an output's name are kept by `keep_good` and not
read by `classify`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, map_batches, short_batches, smallest, stored

#: At most so many labelled rows fit the classifier, and so many words are its features; a word needs so many of these rows.
SAMPLE, WORDS, SUPPORT = 20_000, 8_000, 5
#: The most telling words are features, as many as make so many to a row.
PER_ROW = 40
#: Bytes of a word's beginnings that are features too.
STEMS = (5, 6, 7, 8)
#: How many standard deviations off the global rate a word must be.
TELLING = 5.0
#: Shape statistics, and the quantiles that part each into bins, finer toward both ends.
SHAPES, CUTS = 10, (0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98)
BINS = len(CUTS) + 1
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def look(text: bytes) -> tuple[set[bytes], list[float]]:
    """Distinct words, without digits and marks, with their beginnings (marked, as words with one stem say the same), and shape
    statistics of a text."""
    tokens = text.split()
    words, n, size = set(text.translate(PLAIN).split()), max(len(tokens), 1), max(len(text), 1)
    long = {w[: STEMS[-1]] for w in words if len(w) > STEMS[0]}
    words.update(w[:k] + b"~" for k in STEMS for w in long if len(w) >= k)
    upper = size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = size - len(text.translate(None, b"#*$%&|<>{}[]\\^~_="))
    return words, [
        len(text) / n,
        np.log(n),
        upper / size,
        symbols / size,
        text.count(b"!") / n,
        (size - len(text.translate(None, b"0123456789"))) / size,
        len(set(tokens)) / n,
        text.count(b"|") / n,
        sum(map(bytes.__eq__, tokens, tokens[1:])) / n,
        len(set(map(hash, zip(tokens, tokens[1:], tokens[2:], strict=False)))) / n,
    ]


class Head:
    """One regression: weights of words and of bins."""

    def __init__(self, words: dict[bytes, float], bins: np.ndarray, bias: float):
        self.words, self.bins, self.bias = words, bins, bias

    def logit(self, words: set[bytes], places: list[int]) -> float:
        return self.bias + sum(map(self.words.__getitem__, self.words.keys() & words)) + sum(float(self.bins[k, p]) for k, p in enumerate(places))


class Model:
    """The heads together: a document is bad if any of them says so."""

    def __init__(self, edges: np.ndarray, heads: list[Head]):
        self.edges, self.heads = edges, heads

    def logit(self, text: bytes) -> float:
        words, shape = look(text)
        places = [int(np.searchsorted(self.edges[k], v, side="right")) for k, v in enumerate(shape)]
        good = sum(-np.logaddexp(0, h.logit(words, places)) for h in self.heads)  # log of the product of 1 - p
        good = min(good, -1e-12)
        return float(np.log(-np.expm1(good)) - good) if self.heads else 0.0


def fit(docs: DataFrame, labels: DataFrame, sample: int) -> Model:
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 0).alias("low"), (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("toxic"))
    chosen = F.broadcast(smallest(known, F.xxhash64("doc_id"), sample))  # `sample` rows at most

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            seen = [look(t) for t in batch.column(2).to_pylist()]
            return {"low": batch.column(0), "toxic": batch.column(1), "words": [sorted(w) for w, _ in seen], "shape": [s for _, s in seen]}

        return run

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).join(chosen, "doc_id").select("low", "toxic", "text")
    seen = stored(map_batches(rows, make, "low boolean, toxic boolean, words array<binary>, shape array<double>"))
    counts = seen.select("low", "toxic", F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(k).cast("long")).alias(k) for k in ("low", "toxic"))).where(F.col("n") >= SUPPORT)
    total, low, toxic = seen.agg(F.count(F.lit(1)), F.sum(F.col("low").cast("double")), F.sum(F.col("toxic").cast("double"))).first()
    rates = {k: s / total for k, s in (("low", low), ("toxic", toxic)) if total and 0 < s < total}
    if not rates:
        return Model(np.zeros((SHAPES, BINS - 1)), [])
    off = {k: F.abs(F.col(k) - F.col("n") * r) / F.sqrt(F.col("n") * r * (1 - r)) for k, r in rates.items()}
    words = {}
    for k, x in off.items():
        best = counts.where(x >= TELLING).orderBy(x.desc(), "w").limit(WORDS).collect()  # WORDS rows at most
        words[k] = [bytes(r.w) for r, seen_in in zip(best, np.cumsum([r.n for r in best]), strict=True) if seen_in <= PER_ROW * total]
    place = {w: k for k, w in enumerate(sorted({w for ws in words.values() for w in ws}))}

    def narrow():
        def run(batch: pa.RecordBatch) -> dict:
            return {"low": batch["low"], "toxic": batch["toxic"], "shape": batch["shape"], "ids": [[place[w] for w in ws if w in place] for ws in batch["words"].to_pylist()]}

        return run

    data = map_batches(seen, narrow, "low boolean, toxic boolean, shape array<double>, ids array<int>").collect()  # `sample` short rows at most
    shape = np.array([r["shape"] for r in data])
    edges = np.quantile(shape, CUTS, axis=0).T
    bins = np.stack([np.searchsorted(edges[k], shape[:, k], side="right") + k * BINS for k in range(SHAPES)], 1)
    ids = [r.ids for r in data]
    return Model(edges, [fit_head(ids, bins, np.array([r[k] for r in data], float), words[k], place) for k in rates])


def fit_head(ids: list[list[int]], bins: np.ndarray, y: np.ndarray, words: list[bytes], place: dict[bytes, int]) -> Head:
    own = {place[w]: k for k, w in enumerate(words)}
    rows = [np.array([*(own[i] for i in some if i in own), *(b + len(words))], np.int64) for some, b in zip(ids, bins, strict=True)]
    w, bias = regress(rows, y, len(words) + SHAPES * BINS)
    return Head(dict(zip(words, w[: len(words)].tolist(), strict=True)), w[len(words) :].reshape(SHAPES, BINS), bias)


def regress(rows: list[np.ndarray], y: np.ndarray, n: int, *, ridge: float = 0.3, steps: int = 800) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features, by accelerated gradient steps with a step size for each feature."""
    flat, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    width = max(len(r) for r in rows) ** 0.5
    scale = 4 / (np.bincount(flat, minlength=n) * width + ridge)
    w, ahead, bias, bias_ahead = np.zeros(n), np.zeros(n), float(np.log(y.mean() / (1 - y.mean()))), 0.0
    bias_ahead = bias
    for k in range(steps):
        z = np.bincount(of, weights=ahead[flat], minlength=len(rows)) + bias_ahead
        wrong = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new = ahead - scale * (np.bincount(flat, weights=wrong[of], minlength=n) + ridge * ahead)
        new_bias = bias_ahead - 2 * wrong.mean()
        push = k / (k + 3)
        w, ahead = new, new + push * (new - w)
        bias, bias_ahead = new_bias, new_bias + push * (new_bias - bias)
    return w, bias


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(groups: DataFrame, rate: float, most: float = 1e6) -> float:
    """The weight of the prior, in documents, from the spread of the groups' rates around the global one."""
    n, spread, many = groups.agg(F.sum("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - rate, 2)), F.count(F.lit(1))).first()
    within = rate * (1 - rate)
    between = (spread or 0) / max(n or 1, 1) - within * (many or 0) / max(n or 1, 1)
    return min(most, max(1.0, within / between - 1)) if between > within / most else most


def scored(docs: DataFrame, labels: DataFrame, keep: list[str], host: Column | None, path: Column | None, sample: int) -> DataFrame:
    """docs' columns `keep` with __host, __path and __z, the document's log odds of being bad."""
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", "source", F.coalesce(F.col("lang"), F.lit("?"))) if path is None else path
    model = fit(docs, labels, sample)
    short_batches(docs.sparkSession)
    schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL("__host string, __path string, __z double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [model.logit(t) for t in batch["__bytes"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in schema[:-1]), pa.array(z, pa.float64())], names=schema.names)

    site = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(*keep, site(host).alias("__host"), site(path).alias("__path"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("__bytes"))
    return stored(rows.mapInArrow(run, schema))


def rated(rows: DataFrame) -> DataFrame:
    """rows of `scored` with p_document, host_rate, path_rate and p_bad. Sites' rates are as many as paths; how they meet the
    documents is left to Spark, which sends them where they are few and else splits the documents of a large path."""
    rows = rows.withColumn("p_document", 1 / (1 + F.exp(-F.col("__z"))))
    paths = rows.groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("n"), F.sum("p_document").alias("s"))
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    rate = min(max((s or 0.5) / (n or 1), 1e-6), 1 - 1e-6)
    of_host, of_path = strength(hosts, rate), strength(paths, rate)
    hosts = hosts.select("__host", ((F.col("s") + of_host * rate) / (F.col("n") + of_host)).alias("host_rate"))
    paths = stored(paths.join(hosts, "__host").select("__host", "__path", "host_rate", ((F.col("s") + of_path * F.col("host_rate")) / (F.col("n") + of_path)).alias("path_rate")))
    z = F.col("__z") + logit(F.col("path_rate")) - F.lit(float(np.log(rate / (1 - rate))))
    return rows.join(paths, ["__host", "__path"]).withColumn("p_bad", 1 / (1 + F.exp(-z)))


def classify(docs: DataFrame, labels: DataFrame, *, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_document, host_rate, path_rate, p_bad, kept), a row per row of docs.

    host and path name a document's site and the part of it; as given, its source and its source with its language.
    """
    out = rated(scored(docs, labels, ["doc_id"], host, path, sample))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "p_document", "host_rate", "path_rate", "p_bad", (F.col("p_bad") < threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, *, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns."""
    free, back = aside(docs, ["p_document", "host_rate", "path_rate", "p_bad"])
    return back(rated(scored(free, labels, free.columns, host, path, sample)).where(F.col("p_bad") < threshold))
