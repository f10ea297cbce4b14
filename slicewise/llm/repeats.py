"""Suffix-array dedup by prefix-free parsing: bytes of strings of `length` bytes that also start earlier in the corpus.

Rolling-hash triggers cut the corpus into phrases. The trigger of a string of `length` bytes is the place in it whose
`WIDTH`-byte hash is least, so equal strings have equal triggers at equal places; a phrase is the stretch of strings with one
trigger, and each string lies in one phrase. Suffixes need to be ordered only as deep as `length` bytes and only as far as to
tell which suffix of each class of equals comes first in corpus order, and the two levels of the parse do that:

* parse: for each trigger, blocks of documents send their phrase's digest and first place, grouped by the trigger's hash. A
  trigger with one phrase in the whole corpus needs nothing; equal phrases are all repeats but for the first;
* dictionary: where a trigger stands in different phrases (at the ends of a repeated passage), a suffix array of these phrases,
  to a depth of `length` bytes, puts equal suffixes side by side; the parse's places give corpus order among them, and all but
  the first repeat. Phrases of one trigger that stand in one block only are ordered there; else the phrases meet in their
  trigger's group. If a trigger has more than `MANY` phrases each suffix goes to a group of its own class instead, by hashes.

A block sends each trigger and each suffix class once, whatever the number of copies in it, so a group has at most one entry
for each block and no copy is compared with another. What comes back to a block are its repeats. Blocks are stored compressed
and read for each level.

Digests of phrases, and the hashes of suffixes that are dealt out, cover every byte of them, whatever the length.

Order: doc_id (null last), then block, then place. Defined cases: null text is empty; texts under `length` bytes have no
repeats; a very long text is a block of its own and is parsed by stretches; repeated rows are repeats of the first; rows of one
doc_id count in the order of their blocks; only doc_id and text are read of documents; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pa_schema, short_batches, stored
from .near import mix

#: Bytes of a trigger, of a block of documents and of the stretch that is hashed at a time; bytes of text for each group of triggers.
WIDTH, BLOCK_BYTES, STRETCH, GROUP_BYTES = 32, 4 << 20, 1 << 20, 16 << 20
LAST = np.iinfo(np.int64).max
ONE, LOW = np.uint64(1), np.uint64(0xFFFFFFFF)
P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * P)
FACTORS = mix(np.arange(1001, 1012, dtype=np.uint64) * Q) | ONE
SENT = "bucket int, block long, keys binary, digests binary, ids binary, starts binary, ords binary, counts binary, phrases binary"
BACK = "block long, level int, whole binary, mixed binary, hot binary"
#: Phrases of a trigger that meet in one group; of more, the suffixes are dealt out.
MANY = 20_000
#: Strings that are ordered together.
TOGETHER = 500_000


def blocks_of(docs: DataFrame, text: str, doc_id: str, block_bytes: int) -> DataFrame:
    """(block, ids, ends, data): documents of about BLOCK_BYTES together, by doc_id; data is compressed."""
    schema = "block long, ids binary, ends binary, nulls binary, data binary"
    fields = pa_schema(docs.sparkSession, schema)

    def pack(number: int, rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: LAST if r[0] is None else r[0])
        ids = np.array([LAST if r[0] is None else r[0] for r in rows], np.int64)
        ends = np.cumsum([len(r[1]) for r in rows], dtype=np.int64)
        nulls = np.array([r[0] is None for r in rows], np.uint8)
        data = zstandard.ZstdCompressor(3).compress(b"".join(r[1] for r in rows))
        block = TaskContext.get().partitionId() << 32 | number
        return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), ends.tobytes(), nulls.tobytes(), data))], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, number = [], 0, 0
        for batch in batches:
            for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows and size + len(r[1]) > block_bytes:
                    yield pack(number, rows)
                    rows, size, number = [], 0, number + 1
                rows.append(r)
                size += len(r[1])
        if rows:
            yield pack(number, rows)

    short_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_bytes(text)).mapInArrow(run, schema)


class Block:
    """A block's documents, its phrases and which of them are the first of their kind in it."""

    def __init__(self, row: dict, length: int, stretch: int):
        self.ids, self.ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], np.uint8)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.length, self.stretch = length, stretch
        self.parse()

    def parse(self) -> None:
        """Finds the phrases, stretch by stretch: no two documents share one, as the last starts of each have no string."""
        found = [[] for _ in range(4)]
        n, length = len(self.data), self.length
        inside = np.zeros(n + 1, bool)  # a string starts here and ends in the same document
        for s, e in zip(self.begins, self.ends, strict=True):
            inside[s : max(s, e - length + 1)] = True
        for at in range(0, max(n - length + 1, 0), self.stretch):
            own = inside[at : min(at + self.stretch, n - length + 1)]
            if not own.any():
                continue
            short, long = hash_of(self.data[at : at + len(own) + length - 1], WIDTH, 64)
            least = (short & ~LOW) | np.arange(len(short), dtype=np.uint64)
            reach, span = 1, length - WIDTH + 1
            while 2 * reach <= span:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
            turn = np.r_[True, (least[1:] != least[:-1]) | ~own[:-1]]
            s = np.flatnonzero(own & turn)
            e = np.flatnonzero(own & np.r_[turn[1:] | ~own[1:], True])
            t = (least[s] & LOW).astype(np.int64)
            size = e - s + length
            digest = spanned(long, s, size, (size.astype(np.uint64) << np.uint64(32)) + (t - s).astype(np.uint64))
            for k, v in enumerate((at + s, at + e, mix(short[t]), digest)):
                found[k].append(v)
        kinds = (np.int64, np.int64, np.uint64, np.uint64)
        self.first, self.last, self.key, self.digest = (np.concatenate(f) if f else np.empty(0, k) for f, k in zip(found, kinds, strict=True))
        n = len(self.key)
        self.is_first, self.lead, self.mixed = np.ones(n, bool), np.ones(n, bool), np.zeros(n, bool)
        self.phrases, self.trigger = np.ones(n, np.int32), np.arange(n)
        some = repeated(self.key)  # the others are alone with their trigger
        some = some[np.lexsort((some, self.digest[some], self.key[some]))]
        key, digest = self.key[some], self.digest[some]
        new_key = np.r_[True, key[1:] != key[:-1]][: len(some)]
        new = new_key | np.r_[True, digest[1:] != digest[:-1]][: len(some)]
        group = np.cumsum(new_key) - 1
        different = np.bincount(group, weights=new, minlength=1).astype(np.int32)
        self.is_first[some], self.lead[some] = new, new_key  # first in this block of its trigger and digest; stands for its trigger
        if len(some):
            self.phrases[some] = different[group]  # different phrases of its trigger
            self.mixed[some] = different[group] > 1
            self.trigger[some] = some[np.flatnonzero(new_key)][group]  # the one that stands for its trigger

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the chosen phrases' strings, by trigger: starts, and whether each is the first of its kind in this block."""
        chosen = chosen[np.argsort(self.key[chosen], kind="stable")]
        starts, first = [np.empty(0, np.int64)], [np.empty(0, bool)]
        for a, b in together(self.key[chosen], self.last[chosen] - self.first[chosen] + 1):
            own = chosen[a:b]
            offset, which = offsets(self.last[own] - self.first[own] + 1)
            starts.append(self.first[own][which] + offset)
            first.append(first_of_each(suffix_ranks(self.data, starts[-1], self.length), starts[-1]))
        return np.concatenate(starts), np.concatenate(first)

    def place(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and place in the document."""
        doc = np.searchsorted(self.ends, starts, side="right")
        return self.ids[doc], starts - self.begins[doc]


def sent(block: int, buckets: int, key: np.ndarray, digest: np.ndarray, ids: np.ndarray, starts: np.ndarray, ords: np.ndarray, counts: np.ndarray, phrases: list[bytes] | None = None) -> dict:
    """Rows of SENT: the entries by bucket, in corpus order inside each."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]) if len(order) else np.empty(0, np.int64)
    parts = np.split(order, cuts[1:]) if len(order) else []
    blob = lambda x, kind: [x[p].astype(kind).tobytes() for p in parts]
    return {
        "bucket": [int(bucket[p[0]]) for p in parts], "block": [block] * len(parts), "keys": blob(key, np.uint64), "digests": blob(digest, np.uint64), "ids": blob(ids, np.int64),
        "starts": blob(starts, np.int64), "ords": blob(ords, np.int32), "counts": blob(counts, np.int32), "phrases": [b"".join(phrases[i] for i in p) if phrases else None for p in parts],
    }


def table_of(columns: dict, fields: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in fields})


def entries_of(group: pa.Table) -> dict[str, np.ndarray]:
    parts = {c: [np.frombuffer(x, t) for x in group[c].to_pylist()] for c, t in (("keys", np.uint64), ("digests", np.uint64), ("ids", np.int64), ("starts", np.int64), ("ords", np.int32), ("counts", np.int32))}
    return {"block": np.repeat(group["block"].to_numpy(), [len(x) for x in parts["keys"]]), **{c: np.concatenate(x) for c, x in parts.items()}}


def replies(level: int, of: np.ndarray, fields: pa.Schema, **ords: np.ndarray) -> pa.Table:
    """Rows of BACK: for each block, what it is told; ords: (whether it is told so, what) for each column."""
    any_ = np.logical_or.reduce([told for told, _ in ords.values()])
    out = {f.name: [] for f in fields}
    for b in np.unique(of[any_]):
        own = of == b
        out["block"].append(int(b))
        out["level"].append(level)
        for c in ("whole", "mixed", "hot"):
            told, what = ords.get(c, (np.zeros(len(of), bool), np.zeros(len(of), np.int32)))
            out[c].append(what[own & told].astype(np.int32).tobytes())
    return table_of(out, fields)


def by_trigger(group: pa.Table, fields: pa.Schema, most: int) -> pa.Table:
    """Level 1: entries that repeat an earlier phrase (whole); those whose trigger stands in different phrases of several blocks (mixed, or hot if these are many)."""
    e = entries_of(group)
    order = np.lexsort((e["block"], e["starts"], e["ids"], e["keys"]))
    k, d, n = e["keys"][order], e["digests"][order], e["counts"][order]
    new = np.r_[True, k[1:] != k[:-1]]
    of = np.cumsum(new) - 1
    differ = np.bincount(of, weights=(d != d[np.flatnonzero(new)][of]) | (n > 1)) > 0
    alone = np.bincount(of) == 1
    several = (differ & ~alone)[of]
    hot = several & (np.bincount(of, weights=n) > most)[of]
    ords = e["ords"][order]
    return replies(1, e["block"][order], fields, whole=(~differ[of] & ~new, ords), mixed=(several & ~hot, ords), hot=(hot, ords))


def by_class(group: pa.Table, fields: pa.Schema) -> pa.Table:
    """Level 2: places of strings that repeat an earlier one, from strings' hashes and, where phrases are given, from theirs."""
    e = entries_of(group)
    has = np.repeat([x is not None for x in group["phrases"].to_pylist()], [len(x) // 8 for x in group["keys"].to_pylist()])
    block, ords, again = [], [], []

    def judge(c: dict[str, np.ndarray], *classes: np.ndarray) -> None:
        """All but the first of each class in corpus order are repeats."""
        order = np.lexsort((c["block"], c["starts"], c["ids"], *classes))
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in classes])
        block.append(c["block"][order])
        ords.append(c["ords"][order])
        again.append(~new)

    hashed = {c: x[~has] for c, x in e.items()}
    some = repeated(hashed["keys"])
    hashed = {c: x[some] for c, x in hashed.items()}
    judge(hashed, hashed["digests"], hashed["keys"])
    if has.any():
        data = np.frombuffer(b"".join(x for x in group["phrases"].to_pylist() if x is not None), np.uint8)
        size = e["counts"][has].astype(np.int64)  # here: bytes of the phrase
        length = int(e["digests"][has][0])  # here: bytes of a string
        begin, key = np.cumsum(size) - size, e["keys"][has]
        order = np.argsort(key, kind="stable")
        of = {c: e[c][has] for c in ("block", "ids", "starts", "ords")}
        for a, b in together(key[order], size[order] - length + 1):
            own = order[a:b]
            offset, which = offsets(size[own] - length + 1)
            ranks = suffix_ranks(data, begin[own][which] + offset, length)
            some = shared_ranks(ranks)
            which, offset = own[which[some]], offset[some]
            judge({"block": of["block"][which], "ids": of["ids"][which], "starts": of["starts"][which] + offset, "ords": of["ords"][which] + offset}, ranks[some])
    return replies(2, np.concatenate(block), fields, whole=(np.concatenate(again), np.concatenate(ords)))


def together(keys: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of sorted keys, all of a key in one, with about TOGETHER strings or a single key: no others are equal."""
    turns = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    total, begin = np.concatenate([[0], np.cumsum(many)]), 0
    for end in [*turns[1:].tolist(), len(keys)] if len(keys) else ():
        if total[end] - total[begin] >= TOGETHER or end == len(keys):
            yield begin, end
            begin = end


def offsets(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, 1, ... many[0] - 1, 0, 1, ... many[1] - 1 and so on, and which of them each belongs to."""
    which = np.repeat(np.arange(len(many)), many)
    return np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many), which


def suffix_ranks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The rank of the suffix at each place among all of them, ordered by their first `length` bytes; equal ones share a rank.

    This is the inverse of the suffix array to that depth, built by refinement: a class of equal beginnings is ordered anew where
    its next eight bytes differ, and what is alone in its class is done.
    """
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    rank = np.zeros(len(at), np.int64)
    active, own = np.arange(len(at)), rank  # in order; the class of each, named by its first place
    for depth in range(0, length, 8):
        if not len(active):
            break
        word = np.ascontiguousarray(eight[at[active] + depth]).view(">u8").ravel()
        if length - depth < 8:
            word = word >> np.uint64(8 * (8 - length + depth))
        turn = np.r_[True, own[1:] != own[:-1]]
        differs = ~turn & np.r_[False, word[1:] != word[:-1]]
        if not differs.any():
            continue
        which = np.cumsum(turn) - 1
        rows = np.flatnonzero((np.bincount(which[differs], minlength=which[-1] + 1) > 0)[which])
        order = np.lexsort((word[rows].astype(np.uint64), own[rows]))
        active[rows], word[rows] = active[rows[order]], word[rows[order]]
        new = turn | np.r_[False, word[1:] != word[:-1]]
        place = np.arange(len(active))
        own = own + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(turn, place, 0))
        rank[active] = own
        shared = ~(new & np.r_[new[1:], True])
        active, own = active[shared], own[shared]
    return rank


def shared_ranks(ranks: np.ndarray) -> np.ndarray:
    """The places of ranks that come more than once."""
    return np.flatnonzero(np.bincount(ranks)[ranks] > 1) if len(ranks) else np.empty(0, np.int64)


def first_of_each(ranks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each is the first, by start, of those of its rank."""
    first = np.ones(len(ranks), bool)
    some = shared_ranks(ranks)
    some = some[np.lexsort((starts[some], ranks[some]))]
    first[some[1:]] = ranks[some][1:] != ranks[some][:-1]
    return first


def spanned(long: np.ndarray, first: np.ndarray, size: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A hash of the `size` bytes from `first` on, from the hashes of 64 bytes at each place: as many as cover all of them."""
    out = mix(salt + P)
    for k in range(-(-int(size.max(initial=64)) // 64)):
        out = mix(out * Q + long[first + np.minimum(64 * k, size - 64)])
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """The places, in order, of keys that come more than once."""
    order = np.argsort(keys)
    k = keys[order]
    like = np.r_[False, k[1:] == k[:-1], False] if len(k) else np.zeros(1, bool)
    return np.sort(order[like[:-1] | like[1:]]) if len(k) else order


def hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string of `length` bytes in the phrases that start at `first`: its start, and two hashes of it."""
    begin = np.cumsum(size) - size
    long = hash_of(data[np.arange(int(size.sum())) + np.repeat(first - begin, size)], 64)[0] if len(size) else np.empty(0, np.uint64)
    offset, which = offsets(size - length + 1)
    whole = np.full(len(which), length, np.int64)
    at = begin[which] + offset
    return first[which] + offset, *(spanned(long, at, whole, np.full(len(which), salt, np.uint64)) for salt in (1, 2))


def hash_of(data: np.ndarray, *widths: int) -> list[np.ndarray]:
    """At each place, the hash of so many bytes from it (powers of two, ascending): a sum of random numbers for the bytes, each
    times a product of odd factors that its place in the string picks."""
    x, w, out = BYTE[data], 1, []
    for width in widths:
        while w < width:
            x = x[:-w] * FACTORS[w.bit_length()] + x[w:] if len(x) > w else x[:0]
            w *= 2
        out.append(x)
    return out


def answers(entries: DataFrame, level: int, many: int) -> DataFrame:
    fields = pa_schema(entries.sparkSession, BACK)
    return entries.groupBy("bucket").applyInArrow(lambda key, group: by_trigger(group, fields, many) if level == 1 else by_class(group, fields), BACK)


def ords_of(back: pa.Table, level: int, column: str) -> np.ndarray:
    some = [np.frombuffer(x, np.int32) for x, of in zip(back[column].to_pylist(), back["level"].to_pylist(), strict=True) if of == level]
    return np.concatenate(some) if some else np.empty(0, np.int32)


def repeats(docs: DataFrame, *, length: int = 100, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES, stretch: int = STRETCH, many: int = MANY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept), a row for each row of docs: the merged byte ranges that repeat, and the other bytes."""
    if length < 64:
        raise ValueError("length must be at least 64")
    spark = docs.sparkSession
    blocks = stored(blocks_of(docs, text, doc_id, block_bytes))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(32, -(-size // GROUP_BYTES))
    fields = pa_schema(spark, SENT)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, length, stretch)
                lead = np.flatnonzero(b.lead)
                out = table_of(sent(row["block"], buckets, b.key[lead], b.digest[lead], *b.place(b.first[lead]), lead, b.phrases[lead]), fields)
                yield from out.to_batches()

    one = stored(answers(blocks.mapInArrow(phrases, SENT), 1, many))

    def of_triggers(b: Block, lead: np.ndarray) -> np.ndarray:
        """The phrases, once for each digest, of the triggers that these stand for."""
        told = np.zeros(len(b.key), bool)
        told[lead] = True
        return np.flatnonzero(told[b.trigger] & b.is_first)

    def chosen(b: Block, back: pa.Table) -> np.ndarray:
        """The phrases whose strings are told apart one by one."""
        told = of_triggers(b, np.concatenate([ords_of(back, 1, "mixed"), ords_of(back, 1, "hot")]))
        return np.union1d(told, np.flatnonzero(b.mixed & b.is_first))

    def suffixes(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, parts = left.to_pylist(), []
        if rows and right.num_rows:
            b = Block(rows[0], length, stretch)
            own = of_triggers(b, ords_of(right, 1, "mixed"))
            if len(own):
                ends = b.last[own] + length
                data = [b.data[s:e].tobytes() for s, e in zip(b.first[own], ends, strict=True)]
                parts.append(sent(rows[0]["block"], buckets, b.key[own], np.full(len(own), length, np.uint64), *b.place(b.first[own]), b.first[own], ends - b.first[own], data))
            if len(own := of_triggers(b, ords_of(right, 1, "hot"))):
                own = own[np.argsort(b.key[own], kind="stable")]
                _, first = b.windows(own)
                starts, x, y = (z[first] for z in hashes(b.data, b.first[own], b.last[own] - b.first[own] + length, length))
                parts.append(sent(rows[0]["block"], buckets, x, y, *b.place(starts), starts, np.ones(len(starts), np.int32)))
        return pa.concat_tables([table_of(x, fields) for x in parts] or [table_of({f.name: [] for f in fields}, fields)])

    two = stored(answers(blocks.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(suffixes, SENT), 2, many))
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    result = pa_schema(spark, schema)

    def marked(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return table_of({f.name: [] for f in result}, result)
        b = Block(rows[0], length, stretch)
        whole = ~b.is_first
        whole[ords_of(right, 1, "whole")] = True
        edge = np.zeros(len(b.data) + 1, np.int32)
        np.add.at(edge, b.first[whole], 1)
        np.add.at(edge, b.last[whole] + length, -1)
        starts, first = b.windows(chosen(b, right))
        again = np.concatenate([starts[~first], ords_of(right, 2, "whole").astype(np.int64)])
        np.add.at(edge, again, 1)
        np.add.at(edge, again + length, -1)
        gone = np.cumsum(edge)[:-1] > 0
        out = {f.name: [] for f in result}
        for k, (s, e) in enumerate(zip(b.begins, b.ends, strict=True)):
            own = gone[s:e]
            turns = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
            out["doc_id"].append(None if b.nulls[k] else int(b.ids[k]))
            out["n_bytes"].append(int(e - s))
            out["n_removed"].append(int(own.sum()))
            out["spans"].append([{"start": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2], strict=True)])
            out["kept"].append(b.data[s:e][~own].tobytes())
        return table_of(out, result)

    both = one.union(two)
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(marked, schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns that op10 is held to."""
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
