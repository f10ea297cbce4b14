"""Near duplicates by a signature-coordinate inverted join.

A document is the set of its distinct word shingles. Documents of equal sets form a class, found by the set's digest; what
follows works on classes, one row each. A class has a MinHash signature of `coordinates` values and is posted under each
(coordinate, value). A pair above the similarity shares at least `matches` postings but for a chance of about 1e-6, which has
three consequences that keep the join small:

* a class with fewer than `matches` postings that anyone shares has no partner and leaves;
* prefix: of its m shared postings, in one order by rarity, only the first m - matches + 1 need to be met, as any partner
  shares one of these, so the long lists are skipped;
* collisions are then counted on the two signatures, and only pairs with `matches` or more are compared set with set.

Lists are not expanded into all pairs. First every class meets its list's most central member; the links that hold give
components. Then only classes outside their list's commonest component meet the members of other components, in cells of
bounded size, each pair in the first list that it shares. Links inside a component do not change it, so none is lost. A cell
compares signatures alone and names the pairs that match, whose sets are then fetched; only a cell in which very many match is
read again with the sets themselves, so that a pair's two sets are never sent for each of a group's many pairs.

Defined cases: a null or wordless text has no shingles and no links; fewer words than `width` are one shingle; doc_id names a
document, so rows that repeat one are linked through it; a row with null doc_id has a null component and is kept; very long texts
are taken whole; a pair just at the threshold is linked; `one_of_each` keeps columns that bear an output's name; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, filter_of, map_batches, mix, passing, stored, word_hashes
from .graph import components

COORDINATES, MATCHES = 32, 14
#: Classes on either side of a cell of comparisons, and how many pairs for each class in it make a cell dense.
BLOCK, DENSE = 512, 4
#: Rows of cells that are compared together.
BUCKET = 2048
#: Lower-cases A-Z and takes the white space that parts words to the space.
WORDS = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
ODD = mix(SEEDS) | np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text, lower-cased. Fewer words than `width` are one shingle."""
    words, many = word_hashes(texts, WORDS)
    every = rolled(words, width) if len(words) >= width else words
    out = []
    for at, n in zip((np.cumsum(many) - many).tolist(), many.tolist(), strict=True):
        out.append(np.unique(every[at : at + n - width + 1] if n >= width else rolled(words[at : at + n], n)[:1] if n else words[:0]))
    return out


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of k words from each place on; the last k - 1 places have none and repeat the last."""
    n = len(h) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i])
    return np.concatenate([x, np.repeat(x[-1:], k - 1)])


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """For each set its least value under each of so many hash functions, a row for each set; zeros for an empty one."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), coordinates), np.uint64)
    some = size > 0
    if some.any():
        flat, start = np.concatenate(sets), (np.cumsum(size) - size)[some]
        for k in range(coordinates):
            out[some, k] = np.minimum.reduceat((flat ^ SEEDS[k]) * ODD[k], start)
    return out.view(np.int64)


def set_digest(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8")
    return int(d[0]), int(d[1])


def sketch(docs: DataFrame, width: int, coordinates: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sig): a row for each row of docs, without its text or set."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            digests = [set_digest(s) for s in sets]
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * coordinates, pa.int32()), pa.array(signatures(sets, coordinates).ravel()))
            return {"doc_id": batch.column(0), "n_shingles": [len(s) for s in sets], "f1": [d[0] for d in digests], "f2": [d[1] for d in digests], "sig": sig}

        return run

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_bytes(text)), make, "doc_id long, n_shingles long, f1 long, f2 long, sig array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, text: str, doc_id: str) -> DataFrame:
    """(node, set) of the wanted(node, f1, f2): their texts are read again, so that no table of all sets is kept.

    Texts pass a filter before they are dealt out by document: while few are wanted, few are moved.
    """
    bits = filter_of(wanted.select(F.xxhash64("node").alias("k")), "k")

    def filtered():
        def run(batch: pa.RecordBatch) -> dict:
            some = batch.filter(pa.array(passing(bits, batch["k"].to_numpy())))
            return {"node": some["node"], "text": some["text"]}

        return run

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            sets = shingle_sets(batch["text"].to_pylist(), width)
            out = [(node, s.tobytes()) for node, f1, f2, s in zip(*(batch[c].to_pylist() for c in ("node", "f1", "f2")), sets, strict=True) if set_digest(s) == (f1, f2)]
            return {"node": [x for x, _ in out], "set": [x for _, x in out]}

        return run

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("node"), as_bytes(text).alias("text"))
    rows = map_batches(rows.withColumn("k", F.xxhash64("node")), filtered, "node long, text binary").join(wanted.select("node", "f1", "f2"), "node").select("node", "text", "f1", "f2")
    return map_batches(rows, make, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def alike(a: str, b: str) -> Column:
    """In how many coordinates two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose full sets are similar enough."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            rows = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            good = [(a, b) for a, b, x, y in rows if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)]
            return {"a": [a for a, _ in good], "b": [b for _, b in good]}

        return run

    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return map_batches(full.select("a", "b", "x", "y"), make, "a long, b long")


class Cells:
    """Rows of some cells in order of cell and side."""

    def __init__(self, group: pa.Table):
        columns = {c: group[c].to_numpy() for c in ("key", "r", "c", "side", "node", "label", "n")}
        order = np.lexsort([columns[c] for c in ("side", "c", "r", "key")])
        self.key, self.r, self.c, self.side, self.node, self.label, self.n = (x[order] for x in columns.values())
        sig = group["sig"].combine_chunks()
        self.sig = sig.flatten().to_numpy().reshape(len(order), -1)[order]
        self.prefix = group["prefix"].take(pa.array(order)).to_pylist()
        self.set = group["set"].take(pa.array(order)).to_pylist() if "set" in group.column_names else []

    def each(self) -> Iterator[tuple[int, int, int]]:
        """(begin, begin of side 1, end) of each cell."""
        new = np.flatnonzero(np.r_[True, (self.key[1:] != self.key[:-1]) | (self.r[1:] != self.r[:-1]) | (self.c[1:] != self.c[:-1])]).tolist()
        for a, b in zip(new, [*new[1:], len(self.key)], strict=True):
            yield a, a + int(np.searchsorted(self.side[a:b], 1)), b

    def candidates(self, a: int, m: int, b: int, percent: int, matches: int) -> Iterator[tuple[int, int]]:
        """Places of pairs between the two sides of a cell whose signatures match and whose components differ. Pairs whose first
        shared list is another are left to that one."""
        key, n, label, node, sig = int(self.key[a]), self.n[m:b], self.label[m:b], self.node[m:b], self.sig[m:b]
        for i in range(a, m if m < b else a):
            x, own = self.n[i], self.prefix[i]
            near = np.flatnonzero((label != self.label[i]) & (node != self.node[i]) & (100 * np.minimum(n, x) >= percent * np.maximum(n, x)))
            if len(near):
                near = near[(sig[near] == self.sig[i]).sum(1) >= matches]
            for j in near.tolist():
                if next(p for p in own if p in self.prefix[m + j]) == key:
                    yield i, m + j


def matching(group: pa.Table, percent: int, matches: int) -> pa.Table:
    """The candidates of cells; a cell that has many for each class in it is named instead."""
    x, out = Cells(group), []
    for a, m, b in x.each():
        found = []
        for i, j in x.candidates(a, m, b, percent, matches):
            found.append((int(x.key[a]), int(x.r[a]), int(x.c[a]), int(x.node[i]), int(x.node[j])))
            if len(found) > DENSE * (b - a):
                found = [(*found[0][:3], None, None)]
                break
        out += found
    return pa.Table.from_pylist([dict(zip(("key", "r", "c", "a", "b"), row, strict=True)) for row in out], pa.schema([("key", pa.int64()), ("r", pa.int32()), ("c", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))


def linked(group: pa.Table, percent: int, matches: int) -> pa.Table:
    """Links in cells that come with their sets, as many as join components."""
    x, out = Cells(group), []
    for a, m, b in x.each():
        up: dict[int, int] = {}

        def top(label: int, up: dict[int, int] = up) -> int:
            while (y := up.get(label, label)) != label:
                up[label] = label = up.get(y, y)
            return label

        for i, j in x.candidates(a, m, b, percent, matches):
            one, two = top(int(x.label[i])), top(int(x.label[j]))
            if one != two and similar(np.frombuffer(x.set[i], np.uint64), np.frombuffer(x.set[j], np.uint64), percent):
                out.append({"a": int(x.node[i]), "b": int(x.node[j])})
                up[max(one, two)] = min(one, two)
    return pa.Table.from_pylist(out, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def cells(lists: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(bucket, key, r, c, side, node, label, sig, prefix, n): of each list in which components meet, those outside its commonest
    component (side 0) against all (side 1), dealt over cells of BLOCK by BLOCK. A bucket has the rows of some cells, about BUCKET."""
    member = lists.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    per = member.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("key").agg(F.max_by("label", F.struct("n", F.col("label"))).alias("most"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("others")).where(F.col("others") > 0)
    sides = stored(per.select("key", "most", "n", "others", F.ceil(F.col("others") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("n") / BLOCK).cast("int").alias("cols")))
    total = sides.agg(F.sum(F.col("others") * F.col("cols") + F.col("n") * F.col("rows"))).first()[0] or 0
    member = member.join(sides.drop("n", "others"), "key")
    at = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = member.where(F.col("label") != F.col("most")).select("key", "node", "label", F.lit(0).alias("side"), F.pmod(at, F.col("rows")).cast("int").alias("r"), every("cols").alias("c"))
    right = member.select("key", "node", "label", F.lit(1).alias("side"), every("rows").alias("r"), F.pmod(at, F.col("cols")).cast("int").alias("c"))
    bucket = F.pmod(F.xxhash64("key", "r", "c"), F.lit(total // BUCKET + 1)).alias("bucket")
    return left.union(right).join(nodes.select("node", "sig", "prefix", "n"), "node").select(bucket, "key", "r", "c", "side", "node", "label", "sig", "prefix", "n")


def link_rest(lists: DataFrame, labels: DataFrame, nodes: DataFrame, sets_for: Callable[[DataFrame], DataFrame], percent: int, matches: int) -> DataFrame:
    """Links between components, from lists(key, node) in which two components meet."""
    dealt = cells(lists, labels, nodes)
    found = stored(dealt.groupBy("bucket").applyInArrow(lambda group: matching(group, percent, matches), "key long, r int, c int, a long, b long"))
    pairs = found.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = verified(pairs, sets_for(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), percent)
    dense = found.where("a is null").select("key", "r", "c")
    if dense.limit(1).count():
        again = stored(dealt.join(dense, ["key", "r", "c"], "left_semi"))
        full = again.join(sets_for(again.select("node").distinct()), "node")
        links = links.union(full.groupBy("bucket").applyInArrow(lambda group: linked(group, percent, matches), "a long, b long"))
    return links


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs.

    component_id is the smallest doc_id that links reach. Links: similarity (Jaccard) of at least percent / 100.
    """
    rows = stored(sketch(docs, width, coordinates, text, doc_id))
    classes = stored(rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")))

    posted = classes.select("node", F.posexplode("sig")).select("node", F.xxhash64("pos", "col").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    own = posted.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"), F.sum("n").alias("central")).where(F.size("own") >= matches)  # `coordinates` postings at most
    prefix = F.transform(F.slice("own", F.lit(1), F.size("own") - matches + 1), lambda p: p["key"])
    nodes = stored(own.select("node", "central", prefix.alias("prefix")).join(classes, "node"))

    def sets_for(wanted: DataFrame) -> DataFrame:
        return stored(sets_of(docs, stored(nodes.join(wanted, "node", "left_semi").select("node", "f1", "f2")), width, text, doc_id))

    lists = nodes.select("node", "central", F.explode("prefix").alias("key"))
    centres = lists.groupBy("key").agg(F.max_by("node", F.struct("central", -F.col("node"))).alias("a"), F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    pairs = lists.join(centres, "key").where(F.col("node") != F.col("a")).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (alike("sig_a", "sig_b") >= matches))
    pairs = stored(pairs.select("a", "b"))
    links = stored(verified(pairs, sets_for(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), percent))
    labels = components(links)
    more = stored(link_rest(lists.select("key", "node"), labels, nodes, sets_for, percent, matches))
    if more.limit(1).count():
        labels = components(links.union(more))

    # rows that share a doc_id are one document: link the classes that it stands in
    of_row = rows.where(F.col("n_shingles") > 0).join(classes.select("f1", "f2", "node"), ["f1", "f2"])
    twice = of_row.where(F.col("doc_id") != F.col("node")).select(F.col("doc_id").alias("node")).join(classes.select("node"), "node").limit(1).count()
    if twice:
        labels = components(links.union(more).union(of_row.where("doc_id is not null and doc_id != node").select("doc_id", "node")))
    found = rows.join(classes.select("f1", "f2", "node"), ["f1", "f2"], "left").withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node")))
    found = found.join(labels, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node", "doc_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without all but one document of each component; rows with null doc_id stay."""
    kept = near_duplicates(docs, **options).where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__kept_id")).agg(F.count(F.lit(1)).alias("__n"))
    kept = stored(kept)
    named = docs.join(kept, docs["doc_id"] == kept["__kept_id"], "left_semi")
    if kept.where("__n > 1").limit(1).count():
        named = named.dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


#: DuckDB, for four words and 80 percent: all pairs that share a shingle, their links, and what links reach.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS sh FROM d),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
two AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT doc_id, b FROM reach JOIN two ON r = a)
SELECT doc_id, max(n.n) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM n JOIN reach USING (doc_id) GROUP BY doc_id
"""
