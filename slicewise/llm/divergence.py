"""Source divergence audit: how the words of each source differ from those of the other sources of its language, and of the language.

Frequencies come from single-pass in-memory indexing. A task builds postings of its documents, by language, source and term, until
they fill BLOCK entries, then spills them as a run in the order of the terms' hashes and the terms, cut at the hash shards. The
runs of a shard meet in one task, which merges them with a heap: rows come by their first term, so that only stretches that
overlap the term at hand are open. Where runs are very many, those of FAN tasks are merged to longer ones first.

A pair's divergence is a sum over all kept terms. What terms that neither source has give is the same for each of them; what terms
of one of the two give depends on how often it has them, so a histogram of its counts says it; terms that both have are streamed
once, and their corrections are added up by pair where they are read.

Defined cases: null text, lang and source are ''; texts are taken whole, whatever their length; every row counts, repeated ones
too; a source without terms has the count 0 of each term; a language without kept terms has pairs of value 0 and no term rows; ties are ranked by
the item's bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_batch, as_bytes, pa_schema, short_batches, stored

#: Documents of its language that a term needs, and ranks of a source's own terms.
SUPPORT, RANKS = 3, 200
#: Entries (source and term) of a block, entries of a row of a run, input tasks to a shard, and tasks whose runs are merged first.
BLOCK, ROW, TASKS, FAN = 300_000, 4096, 8, 4096
#: Pairs of sources that are looked at together, and sums that a task holds.
PAIRS, SUMS = 1 << 20, 400_000
#: a-z and bytes beyond ASCII make terms, A-Z as a-z; all else parts them.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: A stretch of a run: its terms in order, where the entries of each end, and each entry's source by number, count and documents.
RUN = "run int, shard int, lang string, first long, terms array<binary>, ends array<int>, sources array<string>, owners array<int>, tfs array<long>, dfs array<long>"
FREQUENCIES = "lang string, term string, total long, sources array<string>, counts array<long>"


class Entries:
    """Entries of one language in the order of their terms (by hash, then bytes): the distinct terms with their hashes, how many entries
    each has, and the entries' sources (numbers of names), counts and documents."""

    def __init__(self, terms: list[bytes], hashes: np.ndarray, many: np.ndarray, owners: np.ndarray, tfs: np.ndarray, dfs: np.ndarray, names: list[str]):
        self.terms, self.hashes, self.many, self.owners, self.tfs, self.dfs, self.names = terms, hashes, many, owners, tfs, dfs, names

    @staticmethod
    def of(terms: list[bytes], hashes: np.ndarray, many: np.ndarray, owners: np.ndarray, tfs: np.ndarray, dfs: np.ndarray, names: list[str]) -> Entries:
        """From lists in any order, in which a term may come again; entries of one term and source are added up."""
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        some = [terms[k] for k in order.tolist()]
        new = np.ones(len(some), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        equal = np.flatnonzero(~new)
        differ = np.array([some[k] != some[k - 1] for k in equal.tolist()], bool)
        if differ.any():  # terms that share a hash
            place = sorted(range(len(some)), key=lambda k: (hashes[k], some[k]))
            some, order = [some[k] for k in place], order[place]
            new[equal] = [some[k] != some[k - 1] for k in equal.tolist()]
        group = np.empty(len(some), np.int64)
        group[order] = np.cumsum(new) - 1  # of the lists as they came
        code = np.repeat(group, many) * len(names) + owners
        code, inverse = np.unique(code, return_inverse=True)
        sums = [np.zeros(len(code), np.int64) for _ in range(2)]
        np.add.at(sums[0], inverse, tfs)
        np.add.at(sums[1], inverse, dfs)
        first = np.flatnonzero(new)
        return Entries([some[k] for k in first.tolist()], hashes[first], np.bincount(code // len(names), minlength=len(first)), code % len(names), *sums, names)

    def rows(self, run: int, lang: str, shards: int) -> Iterator[tuple]:
        """Rows of RUN: cut at shards, and where entries get many."""
        ends = np.cumsum(self.many)
        shard = self.hashes.astype(np.uint64) * np.uint64(shards) >> np.uint64(32)
        full = (ends - self.many) // ROW
        cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (full[1:] != full[:-1])) + 1).tolist(), len(ends)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                low, high = int(ends[a] - self.many[a]), int(ends[b - 1])
                own, owners = np.unique(self.owners[low:high], return_inverse=True)
                yield run, int(shard[a]), lang, int(self.hashes[a]), self.terms[a:b], ends[a:b] - low, [self.names[k] for k in own.tolist()], owners, self.tfs[low:high], self.dfs[low:high]


def hashed(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, terms), np.int64, len(terms))


def batched(rows: Iterator[tuple], fields: pa.Schema, n: int = 64) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, n)):
        yield as_batch(dict(zip(fields.names, zip(*some, strict=True), strict=True)), fields)


def runs(docs: DataFrame, shards: int, block: int) -> DataFrame:
    """Term-sorted runs of all documents."""
    short_batches(docs.sparkSession)
    fields = pa_schema(docs.sparkSession, RUN)

    def spilled(tf: dict, df: dict) -> Iterator[tuple]:
        for lang in sorted({g[0] for g in tf}):
            own = [g for g in tf if g[0] == lang]
            terms = [t for g in own for t in tf[g]]
            if terms:
                tfs = np.fromiter((n for g in own for n in tf[g].values()), np.int64, len(terms))
                dfs = np.fromiter((n for g in own for n in map(df[g].__getitem__, tf[g])), np.int64, len(terms))
                owners = np.repeat(np.arange(len(own)), [len(tf[g]) for g in own])
                yield from Entries.of(terms, hashed(terms), np.ones(len(terms), np.int64), owners, tfs, dfs, [g[1] for g in own]).rows(TaskContext.get().partitionId(), lang, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tf, df, size = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words, own = text.translate(TERMS).split(), tf[lang, source]
                size -= len(own)
                own.update(words)
                df[lang, source].update(set(words))
                size += len(own)
                if size >= block:
                    yield from batched(spilled(tf, df), fields)
                    tf, df, size = defaultdict(Counter), defaultdict(Counter), 0
        yield from batched(spilled(tf, df), fields)

    return docs.select(named("lang").alias("lang"), named("source").alias("source"), as_bytes()).mapInArrow(run, RUN)


class Open:
    """A stretch that is being merged, and how far."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.terms, self.names = batch["terms"][row].as_py(), batch["sources"][row].as_py()
        ends, self.owners, self.tfs, self.dfs = (batch[c][row].values.to_numpy().astype(np.int64) for c in ("ends", "owners", "tfs", "dfs"))
        self.ends, self.hashes, self.at = np.concatenate([[0], ends]), hashed(self.terms), 0
        self.first, self.last = int(self.hashes[0]), int(self.hashes[-1])

    def up_to(self, bound: int) -> tuple | None:
        """What it has next, up to a hash, taken off."""
        a, b = self.at, int(np.searchsorted(self.hashes, bound, side="right"))
        self.at = max(a, b)
        if a < b:
            low, high = self.ends[a], self.ends[b]
            return self.terms[a:b], self.hashes[a:b], np.diff(self.ends[a : b + 1]), self.owners[low:high], self.tfs[low:high], self.dfs[low:high]
        return None


def merged(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, Entries]]:
    """(group, entries) in order, from rows that come by group and first hash. A heap of the open stretches' last hashes tells up to
    where no later row can have a part; so far all open ones are merged."""
    heap: list[tuple[int, int, Open]] = []

    def least() -> Entries:
        bound, names, parts = heap[0][0], {}, []
        for _, _, stretch in heap:
            if part := stretch.up_to(bound):
                number = np.array([names.setdefault(s, len(names)) for s in stretch.names], np.int64)
                parts.append((*part[:3], number[part[3]], *part[4:]))
        while heap and heap[0][0] <= bound:
            heapq.heappop(heap)
        terms = [t for p in parts for t in p[0]]
        return Entries.of(terms, *(np.concatenate([p[k] for p in parts]) for k in range(1, 6)), list(names))

    now: tuple | None = None
    number = 0
    for batch in batches:
        for row, group in enumerate(zip(*(batch[c].to_pylist() for c in by), strict=True)):
            stretch = Open(batch, row)
            while heap and (group != now or heap[0][0] < stretch.first):
                yield now, least()
            now, number = group, number + 1
            heapq.heappush(heap, (stretch.last, number, stretch))
    while heap:
        yield now, least()


def longer(short: DataFrame, shards: int, tasks: int, some: int) -> DataFrame:
    """The runs of each `some` tasks merged to one, cut at more shards."""
    fields = pa_schema(short.sparkSession, RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((row for group, entries in merged(batches, ["run", "shard", "lang"]) for row in entries.rows(group[0], group[2], shards)), fields)

    groups = short.withColumn("run", F.floor(F.col("run") / some).cast("int"))
    return groups.repartition(max(1, tasks // TASKS), "run", "shard").sortWithinPartitions("run", "shard", "lang", "first").mapInArrow(run, RUN)


def frequencies(docs: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """FREQUENCIES: each language's kept terms with their counts by source."""
    tasks = docs.rdd.getNumPartitions()
    shards = max(12, -(-tasks // TASKS))
    if tasks > fan:
        few = stored(runs(docs, 8, block))
        found = longer(few, shards, tasks, max(2, fan // 64))
    else:
        found = runs(docs, shards, block)
    fields = pa_schema(docs.sparkSession, FREQUENCIES)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group, e in merged(batches, ["shard", "lang"]):
            ends = np.cumsum(e.many)
            begins = ends - e.many
            spread, counted = np.add.reduceat(e.dfs, begins), np.add.reduceat(e.tfs, begins)
            for k in np.flatnonzero(spread >= SUPPORT).tolist():
                a, b = int(begins[k]), int(ends[k])
                yield group[1], e.terms[k].decode(), int(counted[k]), [e.names[o] for o in e.owners[a:b].tolist()], e.tfs[a:b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(kept(batches), fields, ROW)

    met = found.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "lang", "first")
    return stored(met.mapInArrow(run, FREQUENCIES))


def named(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def share(count: str, of: str) -> Column:
    """1 + floor(10 ** 9 * (count + 1) / of), in two steps of 31250 and 32000 that stay within 64 bits."""
    x = f"(31250 * ({count} + 1))"
    return F.expr(f"1 + 32000 * ({x} div {of}) + (32000 * ({x} % {of})) div {of}")


def square(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def corrections(terms: DataFrame) -> DataFrame:
    """(lang, source, item, value): over the terms that both have, what the pair's term gives less what each one's count alone says."""
    fields = pa_schema(terms.sparkSession, "lang string, source string, item string, value long")

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple[str, str]] = []
        number: dict[tuple[str, str], int] = {}
        sums: dict[int, int] = defaultdict(int)

        def summed() -> pa.RecordBatch:
            left, right = [names[c >> 32] for c in sums], [names[c & 0xFFFFFFFF] for c in sums]
            return as_batch({"lang": [g[0] for g in left], "source": [g[1] for g in left], "item": [g[1] for g in right], "value": list(sums.values())}, fields)

        for batch in batches:
            own, many = batch.column("own"), np.diff(batch.column("own").offsets.to_numpy())
            flat = own.flatten()
            langs = np.repeat(np.array(batch.column("lang").to_pylist(), object), many)
            ids = np.empty(len(flat), np.int64)
            for k, g in enumerate(zip(langs, flat.field("source").to_pylist(), strict=True)):
                if g not in number:
                    number[g] = len(names)
                    names.append(g)
                ids[k] = number[g]
            p, none = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            each, first = np.repeat(many, many).astype(np.int64), np.repeat(np.cumsum(many) - many, many)
            reach, at = np.cumsum(each), 0
            while at < len(flat):
                end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + PAIRS, side="right")))
                n = each[at:end]
                left = np.repeat(np.arange(at, end), n)
                right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + first[left]
                value = f(p[left], p[right]) - f(p[left], none[right]) - f(none[left], p[right]) + f(none[left], none[right])
                code, place = np.unique(ids[left] << 32 | ids[right], return_inverse=True)
                total = np.zeros(len(code), np.int64)
                np.add.at(total, place, value)
                for c, v in zip(code.tolist(), total.tolist(), strict=True):
                    sums[c] += v
                at = end
                if len(sums) > SUMS:
                    yield summed()
                    sums.clear()
        if sums:
            yield summed()

    return terms.mapInArrow(run, "lang string, source string, item string, value long").where("source <> item")


def audit(docs: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair ranks the other sources, part term the source's own terms up to RANKS."""
    kept = frequencies(docs, block, fan)
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"))
    entries = kept.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", "term", "total", F.col("e.sources").alias("source"), F.col("e.counts").alias("n"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = docs.groupBy(named("lang").alias("lang"), named("source").alias("source")).agg(F.count(F.lit(1)).alias("docs")).drop("docs")
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "v", "all"])
    groups = stored(groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "(size + v)")).otherwise(F.lit(1))))

    met = entries.join(groups, ["lang", "source"])
    met = stored(met.select("lang", "source", "term", "p0", share("n", "(size + v)").alias("p"), share("total", "(all + v)").alias("q")))
    over = met.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(square("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RANKS)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"))
    base = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"v * ({square('p0', 'o0')})").alias("value"))
    counted = met.groupBy("lang", "source", "p0", "p").agg(F.count(F.lit(1)).alias("m"))
    sides = counted.join(other, "lang").where("source <> item").selectExpr(
        "lang", f"inline(array(struct(source, item, m * ({square('p', 'o0')} - {square('p0', 'o0')}) AS value), struct(item AS source, source AS item, m * ({square('o0', 'p')} - {square('o0', 'p0')}) AS value)))"
    )
    both = corrections(met.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("own")).where(F.size("own") > 1).select("lang", "own"))  # the sources of a term
    pairs = base.unionByName(sides).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(terms, "term"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT rid, lang, source, unnest(w) AS t FROM d),
k AS (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT rid) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, count(*) AS n FROM w JOIN k USING (lang, t) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.t, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
p AS (SELECT lang, source, t, n, 1 + (1000000000 * CAST(n + 1 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM x JOIN v USING (lang)),
q AS (SELECT lang, t, 1 + (1000000000 * CAST(sum(n) + 1 AS HUGEINT)) // (sum(sum(n)) OVER (PARTITION BY lang) + any_value(v)) AS q FROM x JOIN v USING (lang) GROUP BY lang, t),
r AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN r ON r.lang = a.lang AND r.source = a.source AND r.item = b.source
 UNION ALL SELECT lang, source, 'term', t, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM e) WHERE part = 'pair' OR rank <= 200
"""
