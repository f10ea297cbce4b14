"""LM scoring by the likelihood of a subword lattice.

A text is words and an end. Each word, with a word-start mark before it, spans a lattice of pieces from an existing
vocabulary; every path is a segmentation and weighs the product of its pieces' unigram probabilities. A forward recursion in
log space sums all paths, so a word's score is its marginal probability, and a text's the product over its words and its end.
Characters that no piece covers fall back to byte pieces, so every text has a score.

The vocabulary is given. To its pieces the lattice adds an arc over each whole word that the training documents hold, which
weighs the word's share of their tokens; the two ways to write a token are mixed by N / (N + V), so that the score is a
probability over all texts. The pieces' probabilities are fitted here to the training documents by expectation maximisation over
the lattices of all their distinct words, weighted by count.

At scale: documents are taken in blocks. A block's tokens become numbers of the block's own word list, and the list goes, split
by the words' hash, to as many buckets as the corpus needs. A bucket adds up its words' counts over all blocks, scores each
distinct word once and answers each block. So a word travels once per block that has it, not once per occurrence; hot words
are no different from others. The driver sees the vocabulary's probabilities (as many as pieces) and corpus totals.

Defined cases: null text is only an end; a table without training documents gives uniform pieces and base scores of log10(1);
repeated rows count each; null doc_id is in no held-out set (its hash is of no text, so it trains); very long texts are taken whole; only doc_id and text are read of
documents; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, pa_schema, short_batches, stored
from .near import mix
from .repeats import table_of

#: Bytes of text in a block and for each bucket of words; words of one length that go through the recursion together.
BLOCK_BYTES, BUCKET_BYTES, TOGETHER = 32 << 20, 64 << 20, 20_000
#: The mark before a word, as in the vocabulary's pieces.
MARK = "▁"
#: Words longer than this go through the recursion alone.
LONG = 64
EM_ROUNDS = 3
TOKENS = "kind int, block long, bucket int, doc_id long, held_out boolean, n_tokens long, words binary, counts binary"
ANSWER = "block long, bucket int, counts binary, scores binary"


def read_pieces(path: str) -> tuple[list[str], list[int]]:
    """A sentencepiece model's pieces, best first, and for each byte the number of its piece or -1. Control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, of_byte = [], [-1] * 256
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            continue
        if model.is_byte(k):
            of_byte[int(model.id_to_piece(k)[1:-1], 16)] = len(pieces)
        pieces.append(model.id_to_piece(k))
    for b in range(256):
        if of_byte[b] < 0:
            of_byte[b] = len(pieces)
            pieces.append(f"<0x{b:02X}>")
    return pieces, of_byte


class Lattice:
    """Marginal log probabilities of words under piece log probabilities; the last piece number is the end."""

    def __init__(self, pieces: list[str], of_byte: list[int], log_p: np.ndarray):
        self.log_p, self.of_byte = log_p, of_byte
        text = [(k, p) for k, p in enumerate(pieces) if not (p.startswith("<0x") and p.endswith(">"))]
        self.number = {p: k for k, p in text}
        self.most = max((len(p) for _, p in text), default=1)
        keys = np.empty(len(text), np.uint64)
        sizes = np.array([len(p) for _, p in text])
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            codes = np.frombuffer("".join(text[i][1] for i in own).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(own), size)
            h = np.zeros(len(own), np.uint64)
            for k in range(size):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[:, k].astype(np.uint64) + np.uint64(1))
            keys[own] = h
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([k for k, _ in text])[order]

    def arcs(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, piece number or -1 for each start) over words of one length, given as rows of code points."""
        h = np.zeros(codes.shape, np.uint64)
        for size in range(1, min(self.most, codes.shape[1]) + 1):
            h = mix(h[:, : codes.shape[1] - size + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[:, size - 1 :])
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            yield size, np.where(self.keys[at] == h, self.ids[at], -1)

    def spelled(self, codes: np.ndarray, size_one: np.ndarray) -> np.ndarray:
        """Log probability of writing a character in bytes, where no piece is that character; else -inf."""
        out = np.full(codes.shape, -np.inf)
        rows, cols = np.nonzero(size_one < 0)
        known: dict[int, float] = {}
        for r, c in zip(rows.tolist(), cols.tolist(), strict=True):
            code = int(codes[r, c]) - 1
            if code not in known:
                known[code] = sum(float(self.log_p[self.of_byte[b]]) for b in chr(code).encode("utf-8", "surrogatepass"))
            out[r, c] = known[code]
        return out

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, dict, np.ndarray]:
        """alpha (n, L + 1), the arcs' numbers by length, and the byte spellings."""
        n, length = codes.shape
        arcs = dict(self.arcs(codes))
        bytes_of = self.spelled(codes, arcs[1])
        alpha = np.full((n, length + 1), -np.inf)
        alpha[:, 0] = 0
        padded = np.append(self.log_p, -np.inf)  # number -1
        scores = {size: padded[ids] for size, ids in arcs.items()}
        scores[1] = np.maximum(scores[1], bytes_of)
        for end in range(1, length + 1):
            terms = np.stack([alpha[:, end - size] + scores[size][:, end - size] for size in range(1, min(self.most, end) + 1)])
            top = terms.max(0)
            alpha[:, end] = top + np.log(np.exp(terms - np.where(np.isfinite(top), top, 0)).sum(0))
        return alpha, arcs, scores

    def backward(self, length: int, scores: dict, n: int) -> np.ndarray:
        beta = np.full((n, length + 1), -np.inf)
        beta[:, length] = 0
        for start in range(length - 1, -1, -1):
            terms = np.stack([scores[size][:, start] + beta[:, start + size] for size in range(1, min(self.most, length - start) + 1)])
            top = terms.max(0)
            beta[:, start] = top + np.log(np.exp(terms - np.where(np.isfinite(top), top, 0)).sum(0))
        return beta

    def groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words by length, as (their numbers, rows of code points + 1)."""
        texts = [MARK + w.decode("utf-8", "replace") for w in words]
        sizes = np.array([len(t) for t in texts])
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            step = max(1, TOGETHER * 8 // int(size)) if size <= LONG else 1
            for k in range(0, len(own), step):
                some = own[k : k + step]
                yield some, np.frombuffer("".join(texts[i] for i in some).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), size).astype(np.uint64) + np.uint64(1)

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.empty(len(words))
        for own, codes in self.groups(words):
            out[own] = self.forward(codes)[0][:, -1] if codes.shape[1] <= LONG else self.alone(codes[0])
        return out

    def alone(self, codes: np.ndarray) -> float:
        """The recursion over one long word, keeping as many values as a piece is long."""
        text = "".join(chr(int(c) - 1) for c in codes)
        last = [0.0]
        for end in range(1, len(text) + 1):
            last.append(self.total([last[-size] + p for size, p, _ in self.ending(text, end)]))
            if len(last) > self.most:
                last.pop(0)
        return last[-1]

    def ending(self, text: str, end: int) -> Iterator[tuple[int, float, list[int]]]:
        """(length, log probability, piece numbers) of each arc of a word that ends here."""
        for size in range(1, min(self.most, end) + 1):
            k = self.number.get(text[end - size : end])
            if k is not None:
                yield size, float(self.log_p[k]), [k]
            elif size == 1:
                own = [self.of_byte[b] for b in text[end - 1].encode("utf-8", "surrogatepass")]
                yield size, sum(float(self.log_p[k]) for k in own), own

    @staticmethod
    def total(terms: list[float]) -> float:
        top = max(terms)
        return top + float(np.log(sum(np.exp(t - top) for t in terms)))

    def add_alone(self, codes: np.ndarray, count: float, out: np.ndarray) -> None:
        """Adds one long word's expected uses to out. Two values are kept for each of its characters; its arcs are found again on the way back."""
        text = "".join(chr(int(c) - 1) for c in codes)
        alpha, beta = np.zeros(len(text) + 1), np.full(len(text) + 1, -np.inf)
        for end in range(1, len(text) + 1):
            alpha[end] = self.total([float(alpha[end - size]) + p for size, p, _ in self.ending(text, end)])
        beta[-1] = 0
        for end in range(len(text), 0, -1):
            for size, p, own in self.ending(text, end):
                beta[end - size] = np.logaddexp(beta[end - size], p + beta[end])
                weight = count * np.exp(alpha[end - size] + p + beta[end] - alpha[-1])
                for k in own:
                    out[k] += weight

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, weighted by their counts."""
        out = np.zeros(len(self.log_p))
        for own, codes in self.groups(words):
            if codes.shape[1] > LONG:
                self.add_alone(codes[0], counts[own[0]], out)
                continue
            n, length = codes.shape
            alpha, arcs, scores = self.forward(codes)
            beta = self.backward(length, scores, n)
            for size, ids in arcs.items():
                weight = np.exp(alpha[:, : length - size + 1] + scores[size] + beta[:, size:] - alpha[:, -1:]) * counts[own][:, None]
                has = ids >= 0
                out += np.bincount(ids[has], weights=weight[has], minlength=len(out))
                if size == 1:
                    for r, c in zip(*np.nonzero(~has), strict=True):
                        for b in chr(int(codes[r, c]) - 1).encode("utf-8", "surrogatepass"):
                            out[self.of_byte[b]] += weight[r, c]
        return out


def packed(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(x)


def unpacked(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def tokenised(docs: DataFrame, held_out: Column, buckets: int, text: str, doc_id: str) -> DataFrame:
    """Rows of TOKENS. kind 0: a document, its tokens as numbers of its block's word list. kind 1: the part of a block's list
    that falls in a bucket; words joined by spaces, with their training counts and numbers."""
    fields = pa_schema(docs.sparkSession, TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def empty() -> dict:
            return {f.name: [] for f in fields}

        def add(out: dict, **values) -> None:
            for c in out:
                out[c].append(values.get(c))

        def flush(number: dict[bytes, int], train: list[np.ndarray], block: int) -> Iterator[pa.RecordBatch]:
            words = list(number)
            flat = np.concatenate(train) if train else np.empty(0, np.int32)
            counts = np.bincount(flat, minlength=len(words))
            bucket = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]) if len(order) else []
            out = empty()
            for part in np.split(order, cuts[1:]) if len(order) else ():
                blob = np.stack([counts[part], part], 1).astype(np.int64).tobytes()
                add(out, kind=1, block=block, bucket=int(bucket[part[0]]), words=packed(b" ".join(words[i] for i in part)), counts=packed(blob))
            if out["kind"]:
                yield from table_of(out, fields).to_batches()

        def numbered() -> dict[bytes, int]:
            number: dict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            return number

        number, train = numbered(), []
        size, k = 0, 0
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            out = empty()
            for doc, held, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if size and size + len(t) > BLOCK_BYTES:
                    if out["kind"]:
                        yield from table_of(out, fields).to_batches()
                        out = empty()
                    yield from flush(number, train, base | k)
                    number, train, size, k = numbered(), [], 0, k + 1
                words = t.translate(LOWER).split()
                ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                if not held:
                    train.append(ids)
                add(out, kind=0, block=base | k, doc_id=doc, held_out=held, n_tokens=len(words) + 1, counts=packed(ids.tobytes()))
                size += len(t)
            if out["kind"]:
                yield from table_of(out, fields).to_batches()
        yield from flush(number, train, base | k)

    short_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("h"), as_bytes(text)).mapInArrow(run, TOKENS)


def counted(group: pa.Table) -> tuple[dict[bytes, int], list[tuple[int, list[bytes], np.ndarray]]]:
    """A bucket's words with their counts over all blocks, and its parts as (block, words, numbers)."""
    total: dict[bytes, int] = {}
    parts = []
    for block, words, counts in zip(group["block"].to_pylist(), group["words"].to_pylist(), group["counts"].to_pylist(), strict=True):
        w, c = unpacked(words).split(b" "), np.frombuffer(unpacked(counts), np.int64).reshape(-1, 2)
        for word, n in zip(w, c[:, 0].tolist(), strict=True):
            total[word] = total.get(word, 0) + n
        parts.append((block, w, c[:, 1]))
    return total, parts


def fitted(lists: DataFrame, n_docs: int, pieces: list[str], of_byte: list[int], rounds: int, prior: float = 0.01) -> tuple[np.ndarray, int, int]:
    """(piece log probabilities with the end last, training tokens, distinct ones), from the buckets' word lists."""
    spark = lists.sparkSession
    merged = "words binary, counts binary, n long, v long"
    fields = pa_schema(spark, merged)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        total, _ = counted(group)
        some = [(w, n) for w, n in total.items() if n]
        return table_of({"words": [packed(b" ".join(w for w, _ in some))], "counts": [packed(np.array([n for _, n in some], np.int64).tobytes())], "n": [sum(n for _, n in some)], "v": [len(some)]}, fields)

    words = stored(lists.groupBy("bucket").applyInArrow(merge, merged))
    n, v = words.agg(F.sum("n"), F.sum("v")).first()
    n, v = (n or 0), (v or 0)
    start = 1 / (np.arange(len(pieces)) + 10.0)  # by rank, until counts are known
    log_p = np.log(np.append(start, start.sum() * max(n_docs, 1) / max(n, 1) / 2))
    log_p -= np.log(np.exp(log_p).sum())
    for _ in range(rounds if n else 0):
        now = log_p

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            lattice, out = Lattice(pieces, of_byte, now), np.zeros(len(now))
            for batch in batches:
                for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if w := unpacked(w):
                        out += lattice.expected(w.split(b" "), np.frombuffer(unpacked(c), np.int64).astype(float))
            used = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out[used])], names=["k", "x"])

        sums = words.select("words", "counts").mapInArrow(expect, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()  # a row per piece at most
        x = np.full(len(now), prior)
        for r in sums:
            x[r.k] += r.x
        x[-1] += n_docs
        log_p = np.log(x / x.sum())
    return log_p, n + n_docs, v + (n_docs > 0)


def mixed(counts: np.ndarray, lattice: np.ndarray, n: int, whole: float) -> np.ndarray:
    """Log probability of tokens that are written whole with probability `whole`, else in pieces."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(whole) + np.log(counts / max(n, 1)), np.log1p(-whole) + lattice)


def score(docs: DataFrame, pieces_path: str, *, held_out: Column | None = None, rounds: int = EM_ROUNDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    held_out marks rows that are scored but not learned from; as given, those whose crc32(doc_id as text) mod 7 is 2.
    base_score is the add-one word unigram's log10 probability, score the lattice's.
    """
    spark = docs.sparkSession
    held_out = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2 if held_out is None else held_out
    pieces, of_byte = read_pieces(pieces_path)  # a vocabulary of fixed size
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0  # a part of a block's list has as many words as a block has, by buckets
    tokens = stored(tokenised(docs, held_out, max(48, -(-size // BUCKET_BYTES)), text, doc_id), "kind")
    lists = tokens.where("kind = 1").select("block", "bucket", "words", "counts")
    n_docs = tokens.where("kind = 0 and not held_out").count()
    log_p, n, v = fitted(lists, n_docs, pieces, of_byte, rounds)
    answer = pa_schema(spark, ANSWER)
    whole = n / max(n + v, 1)
    starts = np.exp(log_p[[k for k, p in enumerate(pieces) if p.startswith(MARK)]]).sum()
    end = float(mixed(np.array([n_docs]), log_p[-1:] - np.log(starts + np.exp(log_p[-1])), n, whole)[0])

    def reply(key: tuple, group: pa.Table) -> pa.Table:
        total, parts = counted(group)
        words = list(total)
        scores = mixed(np.array([total[w] for w in words]), Lattice(pieces, of_byte, log_p).score(words), n, whole)
        at = dict(zip(words, scores.tolist(), strict=True))
        out = {c: [] for c in ("block", "bucket", "counts", "scores")}
        for block, w, numbers in parts:
            out["block"].append(block)
            out["bucket"].append(key[0].as_py())
            out["counts"].append(packed(np.stack([np.array([total[x] for x in w], np.int64), numbers], 1).tobytes()))
            out["scores"].append(packed(np.array([at[x] for x in w]).tobytes()))
        return table_of(out, answer)

    replies = lists.groupBy("bucket").applyInArrow(reply, ANSWER)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    result = pa_schema(spark, schema)
    ten = np.log(10.0)

    def add_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(unpacked(c), np.int64).reshape(-1, 2), np.frombuffer(unpacked(s))) for c, s in zip(right["counts"].to_pylist(), right["scores"].to_pylist(), strict=True)]
        many = sum(len(s) for _, s in parts)
        counts, scores = np.zeros(many, np.int64), np.zeros(many)
        for c, s in parts:
            counts[c[:, 1]], scores[c[:, 1]] = c[:, 0], s
        base = np.log10((counts + 1) / (n + v + 1))
        out = {f.name: [] for f in result}
        for doc, held, m, ids in zip(*(left[c].to_pylist() for c in ("doc_id", "held_out", "n_tokens", "counts")), strict=True):
            ids = np.frombuffer(unpacked(ids), np.int32)
            out["doc_id"].append(doc)
            out["held_out"].append(held)
            out["n_tokens"].append(m)
            out["n_known"].append(int((counts[ids] > 0).sum()) + (n_docs > 0))
            out["train_tokens"].append(n)
            out["base_score"].append(float(base[ids].sum() + np.log10((n_docs + 1) / (n + v + 1))))
            out["score"].append(float((scores[ids].sum() + end) / ten))
        return table_of(out, result)

    documents = tokens.where("kind = 0").select("block", "doc_id", "held_out", "n_tokens", "counts")
    return documents.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(add_up, schema)


#: DuckDB: counts and the add-one score. The held-out rows go by CRC-32 of doc_id's digits, bit by bit.
BASE_ORACLE = r"""
WITH RECURSIVE k AS (SELECT DISTINCT doc_id FROM documents),
c AS (SELECT doc_id, CAST(4294967295 AS BIGINT) AS crc, CAST(doc_id AS VARCHAR) AS s, 0 AS step FROM k
 UNION ALL SELECT doc_id, CASE WHEN step % 9 = 0 THEN xor(crc, CAST(ord(s[step // 9 + 1]) AS BIGINT)) WHEN crc & 1 = 1 THEN xor(crc >> 1, CAST(3988292384 AS BIGINT)) ELSE crc >> 1 END, s, step + 1 FROM c WHERE step < 9 * length(s)),
h AS (SELECT doc_id, xor(crc, CAST(4294967295 AS BIGINT)) % 7 = 2 AS held_out FROM c WHERE step = 9 * length(s)),
d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(held_out, false) AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents LEFT JOIN h USING (doc_id)),
t AS (SELECT rid, held_out, unnest(list_append(w, '')) AS x FROM d),
v AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM v),
s AS (SELECT rid, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base FROM t LEFT JOIN v USING (x), n GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 3) AS base_score FROM d JOIN s USING (rid), n
"""
