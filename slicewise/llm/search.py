"""Ranked lexical search by pipelined term partitioning.

Documents are cut into blocks of at most BLOCK_DOCS, and the terms that items ask for are dealt to OWNERS owners, rarest terms
first. A bundle of items visits one owner after the other in each block: it is cogrouped with the owner's postings of the block,
adds their integer contributions to the sparse accumulators that it carries, and travels on with what can still reach the top.
After each owner the items' best partial scores of all blocks give a score that the last place has at least; an accumulator
that cannot reach it with all that later owners may add is left behind, and none is begun when even all of it would not do.
Such documents have lower scores than the last place, so the result is that of scoring every document.

Items are asked in blocks of bounded number and vocabulary, which tasks get as part of their function; a larger set of items reads
the documents again for each block of items.

Defined cases: null text has no terms; a text is taken whole, whatever its length; every row of documents is a document of its own,
so repeated rows are ranked one after the other, and null doc_ids come last among equal scores; rows of items that share an
item_id, null included, are one item with all their terms; items without terms, or without documents that score, give no rows;
an empty table on either side gives none. Other columns are not read.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_batch, as_bytes, map_batches, pa_schema, short_batches, stored

#: Places of an item, owners of terms, and the shares of all postings that the owners but the last reach, rarest terms first.
TOP, OWNERS, SHARES = 20, 4, (1 / 64, 1 / 8, 1 / 2)
#: Most documents of a block, items of a bundle, and items and bytes of distinct terms that are asked at once.
BLOCK_DOCS, BUNDLE, ITEMS, VOCABULARY = 4096, 64, 1024, 4 << 20
#: Digits, letters (large ones as small ones) and bytes beyond ASCII make terms; all else parts them.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BUNDLES = "block long, bundle int, items array<int>, docs array<int>, scores array<long>, best_items array<int>, best_scores array<long>"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms array<binary>) of the items that have terms, repeats included."""

    def make():
        return lambda batch: {"item_id": batch.column(0), "terms": [t.translate(TERMS).split() for t in batch.column(1).to_pylist()]}

    kind = items.schema["item_id"].dataType.simpleString()
    read = map_batches(items.select("item_id", as_bytes()), make, f"item_id {kind}, terms array<binary>")
    return read.where(F.size("terms") > 0).groupBy("item_id").agg(F.flatten(F.collect_list("terms")).alias("terms"))


def postings(docs: DataFrame, place: dict[bytes, int]) -> DataFrame:
    """(block, term, docs, tfs) for the terms that have a place, docs counting from 0 in the block; a row with term -1 for each block
    has its documents' ids and how many terms they have."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, term int, docs array<int>, tfs array<int>, ids array<{kind}>, sizes array<long>"
    fields = pa_schema(docs.sparkSession, schema)
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = place.keys(), TaskContext.get().partitionId() << 32
        ids, sizes, found = [], [], [array("i") for _ in range(3)]  # found: term, document, how often

        def block() -> pa.RecordBatch:
            term, doc, tf = (np.frombuffer(x, np.int32) if len(x) else np.empty(0, np.int32) for x in found)
            order = np.argsort(term, kind="stable")
            term, doc, tf = term[order], doc[order], tf[order]
            begin = np.flatnonzero(np.diff(term, prepend=-1))
            ends = pa.array(np.concatenate([begin, [len(term)]]), pa.int32())
            lists = [pa.concat_arrays([pa.ListArray.from_arrays(ends, pa.array(x)), pa.array([None], pa.list_(pa.int32()))]) for x in (doc, tf)]
            n = len(begin)
            rows = {"block": np.full(n + 1, number), "term": np.append(term[begin], -1).astype(np.int32), "docs": lists[0], "tfs": lists[1], "ids": [None] * n + [ids], "sizes": [None] * n + [sizes]}
            return as_batch({k: v if isinstance(v, pa.Array) else pa.array(v, fields.field(k).type) for k, v in rows.items()}, fields)

        for batch in batches:
            for doc_id, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                words = text.translate(TERMS).split()
                count = Counter(words)
                some = count.keys() & known
                found[0].extend(map(place.__getitem__, some))
                found[1].extend([len(ids)] * len(some))
                found[2].extend(map(count.__getitem__, some))
                ids.append(doc_id)
                sizes.append(len(words))
                if len(ids) == BLOCK_DOCS:
                    yield block()
                    number, ids, sizes, found = number + 1, [], [], [array("i") for _ in range(3)]
        if ids:
            yield block()

    return stored(docs.select("doc_id", as_bytes()).mapInArrow(run, schema))


class Asked:
    """One block of items: which terms they have, how much each weighs, who owns it, and what owners may still add."""

    def __init__(self, queries: list[list[int]], df: np.ndarray, most: np.ndarray, documents: int, terms: int):
        self.documents, self.terms, self.items = documents, terms, len(queries)
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        order = np.lexsort((np.arange(len(df)), -self.weight))
        reached = np.cumsum(df[order]) / max(1, int(df.sum()))
        self.owner = np.empty(len(df), np.int64)
        self.owner[order] = np.searchsorted(SHARES, reached, side="left")
        self.askers: list[list[tuple[int, int]]] = [[] for _ in df]  # of a term: items, and how often they have it
        self.rest = np.zeros((OWNERS + 1, len(queries)), np.int64)  # the most that an owner and those after it can add
        bound = self.weight * ((10**9 * most) // (1000 * most + 12 * 75))  # 75 is the least m
        for item, words in enumerate(queries):
            for term, times in Counter(words).items():
                if df[term] and self.weight[term]:
                    self.askers[term].append((item, times))
                    self.rest[: self.owner[term] + 1, item] += times * bound[term]

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        """m of documents by their numbers of terms."""
        if 25 * int(sizes.max(initial=0)) * self.documents < 1 << 63:
            return 75 + 25 * sizes * self.documents // max(1, self.terms)
        return np.array([75 + 25 * int(n) * self.documents // self.terms for n in sizes], np.int64)


def best_places(scores: np.ndarray, ids: list) -> np.ndarray:
    """Where the TOP highest scores above 0 are, equal ones by id, null last."""
    some = np.flatnonzero(scores > 0)
    if len(some) > TOP:
        some = some[scores[some] >= np.partition(scores[some], -TOP)[-TOP]]
    return np.array(sorted(some, key=lambda k: (-scores[k], ids[k] is None, ids[k]))[:TOP], np.int64)


def visited(asked: Asked, stage: int, least: np.ndarray, kind: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What one owner does in one block: bundles and postings in, bundles out; after the last owner the block's best documents."""
    last = stage == OWNERS - 1
    names = [f"{x.split()[0]}" for x in BUNDLES.split(", ")]
    types = {"block": pa.int64(), "bundle": pa.int32(), "items": pa.list_(pa.int32()), "docs": pa.list_(pa.int32()), "scores": pa.list_(pa.int64()), "best_items": pa.list_(pa.int32()), "best_scores": pa.list_(pa.int64())}

    def run(bundles: pa.Table, lists: pa.Table) -> pa.Table:
        term = lists["term"].to_numpy()
        whole = int(np.flatnonzero(term == -1)[0])
        ids, sizes = lists["ids"][whole].as_py(), np.array(lists["sizes"][whole].as_py(), np.int64)
        m = asked.lengths(sizes)
        sums = np.zeros((asked.items, len(ids)), np.int64)
        for items, docs, scores in zip(*(bundles[c] for c in ("items", "docs", "scores")), strict=True):
            if len(items.values):
                sums[items.values.to_numpy(), docs.values.to_numpy()] = scores.values.to_numpy()
        begins = asked.rest[stage] >= least  # items that may still begin accumulators
        for t, docs, tfs in zip(term, lists["docs"], lists["tfs"], strict=True):
            if t < 0:
                continue
            docs, tfs = docs.values.to_numpy(), tfs.values.to_numpy().astype(np.int64)
            adds = asked.weight[t] * (10**9 * tfs // (1000 * tfs + 12 * m[docs]))
            for item, times in asked.askers[t]:
                if begins[item]:
                    sums[item, docs] += times * adds
                else:
                    has = sums[item, docs] > 0
                    sums[item, docs[has]] += times * adds[has]
        out = defaultdict(list)
        for bundle, first in enumerate(range(0, asked.items, BUNDLE)):
            some = sums[first : first + BUNDLE]
            best = [best_places(row, ids) for row in some]
            if last:
                for k, places in enumerate(best):
                    out["item"] += [first + k] * len(places)
                    out["doc_id"] += [ids[p] for p in places]
                    out["score"] += some[k, places].tolist()
                continue
            floor = np.array([max(int(least[first + k]), int(some[k, places[-1]]) if len(places) == TOP else 0) for k, places in enumerate(best)])
            item, doc = np.nonzero((some > 0) & (some + asked.rest[stage + 1][first : first + len(some), None] >= floor[:, None]))
            own = [bundles["block"][0].as_py(), bundle, (item + first).astype(np.int32), doc.astype(np.int32), some[item, doc]]
            own += [np.repeat(np.arange(first, first + len(best)), [len(p) for p in best]).astype(np.int32), np.concatenate([some[k, p] for k, p in enumerate(best)])]
            for name, x in zip(names, own, strict=True):
                out[name].append(x)
        if last:
            return pa.table({"item": pa.array(out["item"], pa.int32()), "doc_id": pa.array(out["doc_id"], lists.schema.field("ids").type.value_type), "score": pa.array(out["score"], pa.int64())})
        return pa.table({name: pa.array(out[name], types[name]) for name in names})

    return run


def _asked(docs: DataFrame, items: list, kinds: tuple[str, str]) -> DataFrame:
    """(item_id, rank, doc_id, score) for one block of items."""
    spark = docs.sparkSession
    place = {t: k for k, t in enumerate(sorted({bytes(t) for i in items for t in i.terms}))}
    lists = postings(docs, place)
    total = lists.where("term = -1").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + (x > 0).cast("long"))), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x))).first()
    counts = lists.where("term >= 0").groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max(F.array_max("tfs")).alias("most")).toArrow()  # a row for a term of these items at most
    df, most = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    df[counts["term"].to_numpy()], most[counts["term"].to_numpy()] = counts["df"].to_numpy(), counts["most"].to_numpy()
    asked = Asked([[place[bytes(t)] for t in i.terms] for i in items], df, most, total[0] or 0, total[1] or 0)

    used = [k for k in range(len(place)) if asked.askers[k]]
    owners = spark.createDataFrame(pa.table({"term": pa.array(used, pa.int32()), "owner": pa.array(asked.owner[used].astype(np.int32))}), "term int, owner int")
    owned = lists.join(F.broadcast(owners), "term", "left").where("term = -1 or owner is not null")  # as bounded as the items' terms
    empty = [F.array().cast(t).alias(n) for n, t in (x.split(" ") for x in BUNDLES.split(", ")[2:])]
    bundles = lists.where("term = -1").select("block", F.explode(F.sequence(F.lit(0), F.lit((len(items) - 1) // BUNDLE))).alias("bundle"), *empty)
    least = np.zeros(len(items), np.int64)
    for stage in range(OWNERS):
        own = owned.where((F.col("term") == -1) | (F.col("owner") == stage)).select("block", "term", "docs", "tfs", "ids", "sizes")
        met = bundles.groupBy("block").cogroup(own.withColumnRenamed("block", "at").groupBy("at"))
        if stage == OWNERS - 1:
            found = met.applyInArrow(visited(asked, stage, least, kinds[1]), f"item int, doc_id {kinds[1]}, score long")
            break
        bundles = stored(met.applyInArrow(visited(asked, stage, least, kinds[1]), BUNDLES))
        best = bundles.select(F.explode(F.arrays_zip("best_items", "best_scores")).alias("b")).select("b.best_items", "b.best_scores")
        nth = best.withColumn("n", F.row_number().over(Window.partitionBy("best_items").orderBy(F.desc("best_scores")))).where(F.col("n") == TOP)
        for r in nth.collect():  # a row for an item at most
            least[r.best_items] = max(least[r.best_items], r.best_scores)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    names = spark.createDataFrame([(k, i.item_id) for k, i in enumerate(items)], f"item int, item_id {kinds[0]}")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents of each item by score."""
    kinds = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    asked = stored(item_terms(items))
    size = asked.agg(F.count(F.lit(1)), F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 1))).first()
    blocks = max(1, -(-size[0] // ITEMS), -(-(size[1] or 0) // VOCABULARY))
    out = None
    for k in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # about ITEMS items and VOCABULARY bytes at most
        if some:
            one = _asked(docs, some, kinds)
            out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long") if out is None else out


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
q AS (SELECT item_id, t, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, n),
m AS (SELECT rid, doc_id, 100 - 25 + (25 * len(w) * n) // l AS m FROM d, s),
x AS (SELECT item_id, rid, doc_id, CAST(sum(times * (w * ((1000000000 * tf) // (1000 * tf + 12 * m)))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN f USING (t) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
