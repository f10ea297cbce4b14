"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item becomes windows of `window` consecutive words (an item of fewer words, but not none, is one window). The
tokens of a window are its shingles of `SHINGLE` words (a shorter window is one shingle). Every window must occur in a document
whole, so all its tokens must, and one token is the necessary prefix: its rarest, by the number of documents that hold it; ties
go to the smaller hash, so the choice is one order of all tokens. Documents and windows meet on that token alone. Where it
stands in the window and how long the document is bound where the window can lie; then the words themselves are compared.

At scale: documents are read twice. The first pass counts the windows' tokens, summed up by task; the second takes along each
place of a prefix token with the words around it, and leaves the text behind. Which tokens these are, tasks know from a bit
filter that grows with the benchmark up to a fixed size (beyond it more places are taken along, none is lost). Windows and places are
joined on the token by a plain join, so that Spark may send a small benchmark to all tasks, and splits the places of a passage
that very many documents hold. Windows keep their items in a table of their own, so that a window of many items is one row.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no windows; a null item_id marks
words but is not listed; repeated items count once per item_id; rows that repeat get the same hits; a very long word or text is
treated like others; an empty benchmark or document table gives no hits or no rows; columns of docs that bear an output's name
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, filter_of, map_batches, pa_schema, passing, short_batches, stored, word_hashes
from .near import rolled

#: Fixed by the word definition [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: all other bytes become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of a token.
SHINGLE = 3
KEY = ["__row1", "__row2"]
FOUND = "array<struct<token:long,pos:int,lead:int,around:binary>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def item_windows(benchmark: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """(item, words): each distinct window of an item, its words joined by spaces."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            ids, out = [], []
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words_of(t)
                for k in range(max(1, len(w) - window + 1)) if w else ():
                    ids.append(item)
                    out.append(b" ".join(w[k : k + window]))
            return {"item": ids, "words": out}

        return run

    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("words"))
    return map_batches(rows, make, "item string, words binary").distinct()


def window_tokens(windows: DataFrame) -> DataFrame:
    """(words, n, size, place, token) of each token of each window: how many words both have, and where it stands."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in ("words", "n", "size", "place", "token")}
            for words in batch.column(0).to_pylist():
                h, (n,) = word_hashes([words], WORD_BYTES)
                size = min(SHINGLE, int(n))
                for place, token in enumerate(rolled(h, size)[: int(n) - size + 1].view(np.int64).tolist()):
                    for c, x in zip(out, (words, int(n), size, place, token), strict=True):
                        out[c].append(x)
            return out

        return run

    return map_batches(windows.select("words"), make, "words binary, n int, size int, place int, token long")


def tokens_in(texts: list[bytes | None], sizes: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(how many words each text has; text, place and token of each token that passes the filter)."""
    h, many = word_hashes([t or b"" for t in texts], WORD_BYTES)
    of, begin = np.repeat(np.arange(len(many)), many), np.cumsum(many) - many
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for size in sizes:
        if len(h) >= size:
            x = rolled(h, size).view(np.int64)
            at = np.flatnonzero(passing(bits, x))
            at = at[at + size <= (begin + many)[of[at]]]
            out.append((at, x[at]))
    at, token = (np.concatenate(x) for x in zip(*out, strict=True))
    return many, of[at], at - begin[of[at]], token


def document_counts(docs: DataFrame, tokens: DataFrame, sizes: list[int], text: str) -> DataFrame:
    """(token, count): the number of documents with each token of the windows, over all documents (and, rarely, of another one)."""
    bits = filter_of(tokens.select("token").distinct(), "token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, of, _, token = tokens_in(batch.column(0).to_pylist(), sizes, bits)
                one = np.unique(np.stack([token, of]), axis=1)[0] if len(token) else token
                token, n = np.unique(one, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(n, pa.int64())], names=["token", "n"])

    short_batches(docs.sparkSession)
    return docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("count"))


def prefixes(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(words, n, token, place): each window's prefix token. A window with a token that no document holds occurs nowhere and goes."""
    of = tokens.join(counts, "token", "left").groupBy("words", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token", "place")).alias("p"))
    return of.where(F.col("p.count") > 0).select("words", "n", "p.token", "p.place")


def taken_along(docs: DataFrame, kept: list[str], prefix: DataFrame, sizes: list[int], window: int, text: str) -> DataFrame:
    """docs' kept columns with n_words, the row's key and found: each place of a prefix token with the words around it (lead before it)."""
    bits = filter_of(prefix.select("token").distinct(), "token")
    schema = T.StructType([*(docs.schema[c] for c in kept), *T.StructType.fromDDL(f"__row1 long, __row2 long, n_words long, found {FOUND}").fields])
    found_type = pa_schema(docs.sparkSession, schema).field("found").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["__bytes"].to_pylist()
            many, of, pos, token = tokens_in(texts, sizes, bits)
            found: list[list] = [[] for _ in texts]
            words: dict[int, list[bytes]] = {}
            for d, p, t in zip(of.tolist(), pos.tolist(), token.tolist(), strict=True):
                lead = min(p, window - 1)
                if d not in words:
                    words[d] = words_of(texts[d])
                found[d].append((t, p, lead, b" ".join(words[d][p - lead : p + window])))
            made = {"n_words": pa.array(many, pa.int64()), "found": pa.array(found, found_type)}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch[f.name] for f in schema], names=[f.name for f in schema])

    short_batches(docs.sparkSession)
    rows = docs.select(*kept, *(k.alias(c) for c, k in zip(KEY, keys_of(text), strict=True)), F.col(text).cast("binary").alias("__bytes"))
    return rows.mapInArrow(run, schema)


def keys_of(text: str, doc_id: str = "doc_id") -> tuple:
    """128 bits that name a document: equal for rows of equal doc_id and text only."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), text, doc_id)


def hits_of(rows: DataFrame, prefix: DataFrame) -> DataFrame:
    """(row's key, s, e, words): where each window occurs, from rows with found."""
    at = rows.where(F.size("found") > 0).select(*KEY, "n_words", F.inline("found")).join(prefix, "token")
    s = F.col("pos") - F.col("place")
    at = at.where((F.col("place") <= F.col("lead")) & (s + F.col("n") <= F.col("n_words")))
    own = F.slice(F.split(F.col("around").cast("string"), " "), F.col("lead") - F.col("place") + 1, F.col("n"))
    return at.where(F.array_join(own, " ").cast("binary") == F.col("words")).select(*KEY, s.alias("s"), (s + F.col("n")).alias("e"), "words").distinct()


def merged(hits: DataFrame) -> DataFrame:
    """(row's key, n_hit, hits): the places of windows as runs of words that do not touch."""
    spans = hits.select(*KEY, "s", "e").distinct()
    order = Window.partitionBy(*KEY).orderBy("s", "e")
    new = F.coalesce(F.col("s") > F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = spans.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*KEY, "run").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    return runs.groupBy(*KEY).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hits"))


def items_of(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """(row's key, item_ids): the items whose windows occur."""
    pairs = hits.select(*KEY, "words").distinct().join(windows.where("item is not null"), "words").select(*KEY, "item").distinct()
    return pairs.groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("item_ids"))


def search(docs: DataFrame, benchmark: DataFrame, kept: list[str], window: int, text: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: docs' kept columns with key and n_words; hits; the items' windows)."""
    windows = stored(item_windows(benchmark, window, item_id, item_text))
    tokens = stored(window_tokens(windows.select("words").distinct()))
    sizes = sorted(r.size for r in tokens.select(F.col("size").alias("size")).distinct().collect())  # SHINGLE numbers at most
    prefix = stored(prefixes(tokens, document_counts(docs, tokens, sizes, text)))
    rows = stored(taken_along(docs, kept, prefix, sizes, window, text))
    return rows.drop("found"), stored(hits_of(rows, prefix)), windows


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_hit (words inside a window's occurrence), item_ids, hits (merged word ranges) and contaminated.

    Columns of docs that bear one of these names are replaced. keep_text=False leaves the text behind.
    """
    outputs = ["n_words", "n_hit", "item_ids", "hits", "contaminated"]
    kept = [c for c in docs.columns if c not in outputs and (keep_text or c != text)]
    rows, hits, windows = search(docs, benchmark, kept, window, text, item_id, item_text)
    out = rows.join(merged(hits).join(items_of(hits, windows), KEY, "left"), KEY, "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return out.select(*kept, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), none("item_ids", "array<string>"), none("hits", "array<struct<start:int,end:int>>"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs without a window of the benchmark, with their own columns."""
    _, hits, _ = search(docs, benchmark, [], window, text, item_id, item_text)
    bad = stored(hits.select(*KEY).distinct())  # two numbers a row: Spark knows its size, and need not move texts where it is small
    one, two = keys_of(text)
    free, back = aside(docs, KEY)
    return back(free.join(bad, (one == bad[KEY[0]]) & (two == bad[KEY[1]]), "left_anti"))


def digest(df: DataFrame) -> DataFrame:
    """The columns that op2 is held to."""
    return df.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"), "contaminated")


#: DuckDB: items' windows of each length against the documents' runs of as many words.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT rid, n, i, item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
