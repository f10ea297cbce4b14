"""Byte-level BPE encoding and decoding by a corpus-level merge replay.

The corpus has one dictionary of distinct pieces (matches of the pre-tokenizer's pattern), and merges are replayed over that
dictionary, not over texts. The pieces of a part of the dictionary are laid side by side as one sequence of byte tokens. An
inverted index leads from each mergeable token pair, named by the rank of the token it becomes, to the word positions where it
stands. Merges are applied in rank order: one takes all its positions at once and files only the pairs that it has made with
its neighbours. (Where a merge would bring up a pair of smaller rank, the rest of that piece is replayed by itself.)

As a Spark job: documents are taken in blocks. A block's pieces become numbers of the block's own list, frequent ones small,
and the list goes, split by the pieces' hash, to the parts of the dictionary. A part merges each distinct piece once, whatever
the number of blocks that have it, and answers each block with ids; a document's ids are then its pieces' ids in a row. A
piece travels once per block, not once per occurrence, so a very common one is no different from others, and no row is wider
than a block's share of one part.

Defined cases: null or empty text gives no ids; a very long piece (a text without a break) is one piece like others; rows that
repeat are encoded each; of equal ranks (a file has none) the leftmost pair is merged first; an empty table gives no rows; other columns of the input are kept by `encode` (which replaces those
named as its outputs) and by `decode`; a rank file that lacks a byte is refused.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pa_schema, short_batches, stored

#: Bytes of text in a block of documents and for each part of the dictionary; parts at least.
BLOCK_BYTES, PART_BYTES, PARTS = 32 << 20, 64 << 20, 16
NEVER = np.iinfo(np.int32).max
OUTPUTS = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
#: A block's pieces that fall in one part: their bytes in a row, how long each is, and their numbers as steps from one to the next.
LISTED = "block long, part int, pieces binary, sizes binary, numbers binary"
OF_DOCUMENT = "batch int, at int, own binary, owns binary"
ANSWER = "block long, numbers binary, ids binary, sizes binary"


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f) if token]
    tokens = [b""] * (max(r for r, _ in pairs) + 1)
    for rank, token in pairs:
        tokens[rank] = token
    return tokens


def for_ascii(pattern: str) -> Callable[[str], list[str]] | None:
    """The pattern for texts of ASCII alone, by the faster module; None if it asks for more than letters, numbers and spaces."""
    out, inside = [], False
    for part in re.findall(r"\\p\{[A-Z]\}|\\.|.", pattern, re.S):
        inside = part == "[" or inside and part != "]"
        chars = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r" \t-\r"}.get(part)
        if part == r"\S" and not inside:
            part = r"[^ \t-\r]"
        elif part[0] == "\\" and not chars:
            return None
        out.append(part if not chars else chars if inside else f"[{chars}]")
    return re.compile("".join(out)).findall


class Replay:
    """The merges of a vocabulary, over pieces laid side by side."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: r for r, t in enumerate(tokens) if t}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the ranks lack a byte")
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.rank[t[:k]] << 32 | self.rank[t[k:]], r) for r, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        pairs.sort()
        self.pairs, self.becomes = np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32)
        # \s of the pattern is the Unicode property, as in the library that defines the format
        self.any = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.ascii = for_ascii(pattern) or self.any

    def split(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() else self.any(text)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that each a and b become, or NEVER."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0), self.becomes[at], NEVER)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, how many each has)."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.cumsum(size + 1) - size - 1
        n = int(size.sum()) + len(pieces)
        inner = np.ones(n, bool)
        inner[start + size] = False  # an end stands after each piece, so that no pair spans two
        ids = np.full(n + 1, -1, np.int32)
        ids[:n][inner] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        for k, p in enumerate(pieces):
            if (r := self.rank.get(p)) is not None:
                ids[start[k]], ids[start[k] + 1 : start[k] + size[k]] = r, -1
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        pair = np.full(n + 1, NEVER, np.int32)
        pair[:n] = self.merged(ids[:n], ids[1:])
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def file(places: np.ndarray) -> None:
            r = pair[places]
            places, r = places[r < NEVER], r[r < NEVER]
            if len(places) > 1:
                order = np.argsort(r, kind="stable")
                places, r = places[order], r[order]
            cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)] if len(r) else [0]
            for a, b, x in zip(cuts, cuts[1:], r[cuts[:-1]].tolist(), strict=False):
                if x not in index:
                    heappush(heap, x)
                index[x].append(places[a:b])

        file(np.flatnonzero(pair < NEVER))
        alone: set[int] = set()
        while heap:
            r = heappop(heap)
            found = index.pop(r)
            i = found[0] if len(found) == 1 else np.sort(np.concatenate(found))
            i = i[pair[i] == r]
            if not len(i):
                continue  # earlier merges have taken them
            j = after[i]
            if (chained := i[1:] == j[:-1]).any():  # a run of overlapping pairs: every other one, from the left
                place = np.arange(len(i))
                begin = np.maximum.accumulate(np.where(np.r_[True, ~chained], place, 0))
                i = i[(place - begin) % 2 == 0]
                j = after[i]
            k = after[j]
            beside = ids[k]
            ids[i], ids[j], pair[j] = r, -2, NEVER
            after[i], before[k] = k, i
            h = before[i]
            touched = np.unique(np.concatenate([i, h[h >= 0]])) if len(i) > 1 else np.array([h[0], i[0]] if h[0] >= 0 else i)
            pair[touched] = self.merged(ids[touched], ids[after[touched]])
            new, at = pair[touched], touched
            if (moved := ids[k] != beside).any():  # the pair that stood there before its right side was merged too
                new, at = np.concatenate([new, self.merged(ids[i[moved]], beside[moved])]), np.concatenate([touched, i[moved]])
            if (new < r).any():  # a pair of smaller rank goes first: its piece is replayed by itself
                for p in set(np.searchsorted(start, at[new < r], side="right").tolist()):
                    alone.add(p - 1)
                    pair[start[p - 1] : start[p - 1] + size[p - 1]] = NEVER
            file(touched)
        kept = ids[:n] >= 0
        many = np.add.reduceat(kept, start, dtype=np.int64) if len(start) else size
        flat = ids[:n][kept]
        if alone:
            parts = np.split(flat, np.cumsum(many)[:-1])
            for p in alone:
                parts[p] = np.array(self.by_itself(pieces[p]), np.int32)
                many[p] = len(parts[p])
            flat = np.concatenate(parts)
        return flat, many

    def by_itself(self, piece: bytes) -> list[int]:
        """The same merges over one piece, place by place."""
        ids = [*self.byte[np.frombuffer(piece, np.uint8)].tolist(), -1]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank = lambda x, y: -1 if ids[x] < 0 or ids[y] < 0 else self.rank.get(self.tokens[ids[x]] + self.tokens[ids[y]], -1)
        heap = [(r, i) for i in range(len(ids) - 1) if (r := rank(i, i + 1)) >= 0]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if ids[i] < 0 or rank(i, after[i]) != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -2
            after[i] = right = after[j]
            before[right] = i
            for x, y in ((before[i], i), (i, right)):
                if x >= 0 and (m := rank(x, y)) >= 0:
                    heappush(heap, (m, x))
        return [x for x in ids if x >= 0]


_REPLAYS: dict[tuple[str, str], Replay] = {}


def replay_of(path: str, pattern: str) -> Replay:
    """One for each vocabulary in a worker process."""
    if (path, pattern) not in _REPLAYS:
        _REPLAYS[path, pattern] = Replay(read_ranks(path), pattern)
    return _REPLAYS[path, pattern]


def packed(x: np.ndarray | bytes) -> bytes:
    """Compressed; of numbers, the bytes of equal weight side by side."""
    if isinstance(x, bytes):
        return zstandard.ZstdCompressor(9).compress(x)
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def numbers_of(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpacked(x), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def cut(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def in_blocks(docs: DataFrame, kept: list[str], text: str, parts: int, path: str, pattern: str) -> DataFrame:
    """Rows of documents (the kept columns, and where they stand: batch, at) and rows of LISTED, the block's list by part. The first
    row of a batch carries the pieces of all its documents, as numbers of the block's list (own) and how many each has (owns)."""
    listed = T.StructType.fromDDL(LISTED)
    schema = T.StructType([T.StructField("k" + c, docs.schema[c].dataType) for c in kept] + T.StructType.fromDDL(OF_DOCUMENT).fields + listed.fields)
    fields = pa_schema(docs.sparkSession, schema)
    none = lambda f, n: pa.nulls(n, f.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = replay_of(path, pattern)
        first, held, size, number = TaskContext.get().partitionId() << 32, [], 0, defaultdict()
        number.default_factory = number.__len__
        block = first

        def flush() -> Iterator[pa.RecordBatch]:
            pieces = list(number)
            often = np.bincount(np.concatenate([x for _, own in held for x in own]), minlength=len(pieces)) if pieces else np.empty(0, np.int64)
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            for at, (batch, own) in enumerate(held):
                first_of = lambda x, n=len(own): pa.array([packed(x), *[None] * (n - 1)], pa.binary())
                made = {"k" + c: batch[c] for c in kept} | {"batch": pa.array([at] * len(own), pa.int32()), "at": pa.array(range(len(own)), pa.int32()), "block": pa.array([block] * len(own), pa.int64())}
                made |= {"own": first_of(place[np.concatenate(own)]), "owns": first_of(np.array([len(x) for x in own], np.int32))}
                yield pa.RecordBatch.from_arrays([made.get(f.name, none(f, len(own))) for f in fields], schema=fields)
            raw = [p.encode() for p in pieces]
            part = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % parts
            order = np.argsort(part, kind="stable")
            cuts = [*np.flatnonzero(np.r_[True, np.diff(part[order]) > 0]).tolist(), len(order)] if len(order) else []
            out = {f.name: [] for f in listed}
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = order[a:b][np.argsort(place[order[a:b]])]
                some = [raw[i] for i in own.tolist()]
                for c, x in zip(out, (block, int(part[own[0]]), packed(b"".join(some)), packed(np.fromiter(map(len, some), np.int32, len(some))), packed(np.diff(place[own], prepend=0))), strict=True):
                    out[c].append(x)
            if n := len(out["block"]):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name in out else none(f, n) for f in fields], schema=fields)

        for batch in batches:
            texts = batch[text].to_pylist()
            now = sum(map(len, filter(None, texts)))
            if not texts:
                continue
            if held and size + now > BLOCK_BYTES:
                yield from flush()
                held, size, block = [], 0, block + 1
                number.clear()
            own = []
            for t in texts:
                pieces = r.split(t) if t else ()
                own.append(np.fromiter(map(number.__getitem__, pieces), np.int32, len(pieces)))
            held.append((batch.select(kept), own))
            size += now
        if held:
            yield from flush()

    short_batches(docs.sparkSession)
    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens"), keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with the outputs asked for: ids array<int>, n_tokens, ids_sha256 (of decimal ids joined by a
    space), decoded_sha256 (of the bytes that the ids decode to). path: the ranks' file, found under the same name on every machine."""
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = stored(in_blocks(docs, kept, text, max(PARTS, -(-size // PART_BYTES)), path, pattern))
    answer = pa_schema(spark, ANSWER)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        """Each distinct piece of a part of the dictionary is merged once; each block is told the ids of its own."""
        lists = [cut(unpacked(p), numbers_of(s)) for p, s in zip(group["pieces"].to_pylist(), group["sizes"].to_pylist(), strict=True)]
        place = {p: k for k, p in enumerate(dict.fromkeys(p for x in lists for p in x))}
        flat, many = replay_of(path, pattern).replay(list(place))
        begin = np.cumsum(many) - many
        out = {f.name: [] for f in answer}
        for block, some, numbers in zip(group["block"].to_pylist(), lists, group["numbers"].to_pylist(), strict=True):
            at = np.fromiter(map(place.__getitem__, some), np.int64, len(some))
            for c, x in zip(out, (block, numbers, packed(flat[spread(begin[at], many[at])]), packed(many[at])), strict=True):
                out[c].append(x)
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in answer})

    answers = rows.where("part is not null").select(*(f.name for f in T.StructType.fromDDL(LISTED))).groupBy("part").applyInArrow(merge, ANSWER)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, OUTPUTS[c]) for c in outputs])
    result = pa_schema(spark, schema)

    def joined(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.cumsum(numbers_of(n)), numbers_of(i), numbers_of(s)) for n, i, s in zip(*(right[c].to_pylist() for c in ("numbers", "ids", "sizes")), strict=True)]
        many = np.zeros(sum(len(n) for n, _, _ in parts), np.int64)
        for n, _, s in parts:
            many[n] = s
        begin = np.cumsum(many) - many
        flat = np.empty(int(many.sum()), np.int32)
        for n, i, s in parts:
            flat[spread(begin[n], s)] = i
        tokens, made = replay_of(path, pattern).tokens, {c: [] for c in outputs}
        names = [str(x).encode() for x in range(len(tokens))] if "ids_sha256" in outputs else []
        ends = (begin + many).tolist()
        as_list = flat.tolist() if names or "decoded_sha256" in outputs else []
        said = [b" ".join([names[x] for x in as_list[a:b]]) for a, b in zip([0, *ends], ends, strict=False)] if names else []
        read = [b"".join([tokens[x] for x in as_list[a:b]]) for a, b in zip([0, *ends], ends, strict=False)] if "decoded_sha256" in outputs else []
        lists = {b: np.split(numbers_of(x), np.cumsum(numbers_of(n))[:-1]) for b, x, n in zip(*(left[c].to_pylist() for c in ("batch", "own", "owns")), strict=True) if x is not None}
        for batch, at in zip(left["batch"].to_pylist(), left["at"].to_pylist(), strict=True):
            own = lists[batch][at]
            if "ids" in made:
                made["ids"].append(flat[spread(begin[own], many[own])])
            if "n_tokens" in made:
                made["n_tokens"].append(int(many[own].sum()))
            own = own.tolist()
            if "ids_sha256" in made:
                made["ids_sha256"].append(hashlib.sha256(b" ".join([said[x] for x in own])).hexdigest())
            if "decoded_sha256" in made:
                made["decoded_sha256"].append(hashlib.sha256(b"".join([read[x] for x in own])).hexdigest())
        return pa.table([left["k" + f.name].cast(f.type) if f.name in kept else pa.array(made[f.name], f.type) for f in result], schema=result)

    documents = rows.where("at is not null").select("block", *(f.name for f in T.StructType.fromDDL(OF_DOCUMENT)), *("k" + c for c in kept))
    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(joined, schema)


def spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (many[0] of them), begin[1], ..."""
    many = many.astype(np.int64)
    return np.arange(int(many.sum())) + np.repeat(begin - (np.cumsum(many) - many), many)


def decode(encoded: DataFrame, path: str, pattern: str, *, ids: str = "ids") -> DataFrame:
    """encoded with decoded binary, the bytes of its ids; null ids give no bytes."""
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField("decoded", T.BinaryType())])
    short_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = replay_of(path, pattern).tokens
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in kept), pa.array([b"".join([tokens[k] for k in x or ()]) for x in batch[ids].to_pylist()], pa.binary())], names=[*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, with_ids: ids too): texts are encoded and their ids decoded."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode(docs, path, pattern, outputs=("n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])), keep=["doc_id"])
