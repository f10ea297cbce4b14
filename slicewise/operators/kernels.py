"""Small NumPy helpers for what columns cannot say: prediction of a slice, code lengths, bits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FIRST = 128  # what a slice's first sample is predicted from
MAX_LENGTH = 16  # of a code that is written
UNUSED = 255  # descriptor byte of a symbol without a code
TABLE_BITS, CHUNK = 16, 1 << 18  # longest code that is read by a table, bits that are looked at together
FEW = 24  # slices under which the median's inverse takes them one by one


class CodecError(Exception):
    def __init__(self, variant: str, **fields: int):
        super().__init__(variant)
        self.variant, self.fields = variant, fields

    def row(self) -> dict:
        return {"variant": self.variant, "fields": list(self.fields.items())}


def median3(a, b, c):
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def residuals(predictor: int, samples: np.ndarray, width: int) -> np.ndarray:
    """What prediction leaves of one slice's samples; all arithmetic is modulo 256."""
    x = samples
    if predictor == 0 or not len(x):
        return x.copy()
    out = x - np.concatenate([[FIRST], x[:-1]]).astype(np.uint8)
    if predictor == 1 or len(x) <= width:
        return out
    if predictor == 2:
        down = x.reshape(-1, width)[1:] - x.reshape(-1, width)[:-1]
        out.reshape(-1, width)[1:] = np.diff(down, axis=1, prepend=np.uint8(0))
        return out
    left, top = x[width - 1 : -1], x[:-width]
    corner = np.concatenate([[0], x[: -width - 1]]).astype(np.uint8)
    guess = median3(left, top, left + top - corner)
    guess[0] = x[0]  # the second row's first sample
    out[width:] = x[width:] - guess
    return out


def restored(predictor: int, res: np.ndarray, width: int) -> np.ndarray:
    """Inverse of `residuals` for slices of one shape: res has a row for each slice."""
    if predictor == 0 or not res.shape[1]:
        return res.copy()
    if predictor == 1:
        return np.cumsum(res, axis=1, dtype=np.uint8) + np.uint8(FIRST)
    if predictor == 2:
        grid = res.reshape(len(res), -1, width)
        return (np.cumsum(np.cumsum(grid, axis=2, dtype=np.uint8), axis=1, dtype=np.uint8) + np.uint8(FIRST)).reshape(res.shape)
    # the median needs the last sample before the next: one step for all slices at a time, or each slice by itself where they are few
    if len(res) < FEW:
        return np.stack([_restored_alone(r.tobytes(), width) for r in res])
    r = np.ascontiguousarray(res.T)
    x = np.empty_like(r)
    x[:width] = np.cumsum(r[:width], axis=0, dtype=np.uint8) + np.uint8(FIRST)
    if len(r) > width:
        x[width] = r[width] + x[0]
    for i in range(width + 1, len(r)):
        a, b = x[i - 1], x[i - width]
        x[i] = r[i] + median3(a, b, a + b - x[i - width - 1])
    return np.ascontiguousarray(x.T)


def _restored_alone(res: bytes, width: int) -> np.ndarray:
    x = bytearray(((np.cumsum(np.frombuffer(res[:width], np.uint8), dtype=np.uint8)) + np.uint8(FIRST)).tobytes())
    if len(res) > width:
        a = (res[width] + x[0]) & 255
        x.append(a)
        for i in range(width + 1, len(res)):
            b = x[i - width]
            g = (a + b - x[i - width - 1]) & 255
            if a > b:
                a, b = b, a
            a = (res[i] + (a if g < a else b if g > b else g)) & 255
            x.append(a)
    return np.frombuffer(bytes(x), np.uint8)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Descriptor for a histogram: optimal code lengths of at most MAX_LENGTH; 0 marks the only symbol, UNUSED an absent one.

    Coins of each denomination are paired and merged with the symbols, MAX_LENGTH - 1 times; of equal weights pairs go first,
    and symbols by number.
    """
    used = [int(s) for s in np.lexsort((np.arange(256), counts)) if counts[s] > 0]
    out = np.full(256, UNUSED, np.uint8)
    if len(used) < 2:
        out[used] = 0
        return out
    coins = counts[used].astype(np.int64)
    row, levels = coins, []
    for _ in range(MAX_LENGTH - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([pairs, coins])
        order = np.argsort(both, kind="stable")
        row = both[order]
        levels.append(order < len(pairs))
    # a coin that is spent at a level adds one to its symbol's length; a pair is spent as two of the level before
    spent, take = np.zeros(len(used), np.int64), 2 * len(used) - 2
    for is_pair in reversed(levels):
        pairs = int(is_pair[:take].sum())
        spent[: take - pairs] += 1
        take = 2 * pairs
    spent[:take] += 1
    out[used] = spent
    return out


def codebook(descriptor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int | None]:
    """(symbols, lengths, codes by ascending code, the only symbol or None); raises what a descriptor fails by."""
    zero = np.flatnonzero(descriptor == 0)
    symbols = np.flatnonzero((descriptor != UNUSED) & (descriptor != 0))
    none = np.empty(0, np.int64)
    if len(zero) > 1:
        raise CodecError("MultipleSingleSymbolSentinels")
    if len(zero):
        if len(symbols):
            raise CodecError("KraftViolation")
        return none, none, none, int(zero[0])
    if not len(symbols):
        return none, none, none, None
    lengths = descriptor[symbols].astype(np.int64)
    most = int(lengths.max())
    if most > 32 or int((1 << (most - lengths)).sum()) != 1 << most:
        raise CodecError("KraftViolation")
    order = np.lexsort((-symbols, -lengths))
    share = 1 << (most - lengths[order])
    codes = (np.cumsum(share) - share) >> (most - lengths[order])
    return symbols[order], lengths[order], codes, None


def packer(descriptor: np.ndarray) -> Callable[[np.ndarray], bytes]:
    """Packs slices in one code: codes in 32-bit little-endian words, most significant bit first, zero padded."""
    symbols, lengths, codes, only = codebook(descriptor)
    length, code = np.zeros(256, np.int64), np.zeros(256, np.int64)
    length[symbols], code[symbols] = lengths, codes

    def pack(res: np.ndarray) -> bytes:
        if only is not None or not len(res) or not len(symbols):
            return b""
        n, c = length[res], code[res]
        at = np.cumsum(n) - n
        bits = np.zeros(-(-int(n.sum()) // 32) * 32, np.uint8)
        for k in range(int(lengths.max())):  # the k-th bit of every code
            has = n > k
            bits[at[has] + k] = c[has] >> (n[has] - 1 - k) & 1
        return np.packbits(bits).view(">u4").astype("<u4").tobytes()

    return pack


def packed_bits(res: np.ndarray, descriptor: np.ndarray) -> bytes:
    return packer(descriptor)(res)


def reader(descriptor: np.ndarray) -> tuple[int | None, int, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """(the only symbol or None, longest code, function): the function tells for each bit of big-endian bytes, but for the last 8
    of them, which symbol's code starts there and how long it is."""
    symbols, lengths, codes, only = codebook(descriptor)
    most = int(lengths.max()) if len(symbols) else 0
    if 0 < most <= TABLE_BITS:
        share = 1 << (most - lengths)
        lookup = np.repeat(symbols, share).astype(np.uint8), np.repeat(lengths, share).astype(np.uint8)
    first = codes << (most - lengths) if most else codes

    def read(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = raw.astype(np.uint64)
        ahead = np.zeros(len(own) - 8, np.uint64)
        for k in range(8):
            ahead = ahead << np.uint64(8) | own[k : len(own) - 8 + k]
        window = np.empty(8 * len(ahead), np.int64)
        for k in range(8):
            window[k::8] = (ahead << np.uint64(k)) >> np.uint64(64 - most)
        if most <= TABLE_BITS:
            return lookup[0][window], lookup[1][window]
        k = np.searchsorted(first, window, side="right") - 1
        return symbols[k].astype(np.uint8), lengths[k].astype(np.uint8)

    return only, most, read


def big_endian(data: bytes) -> np.ndarray:
    """The bytes of 32-bit little-endian words, the most significant first, and 8 zeros."""
    return np.concatenate([np.frombuffer(data, "<u4").astype(">u4").view(np.uint8), np.zeros(8, np.uint8)])


def unpacker(descriptor: np.ndarray) -> Callable[[bytes, int], tuple[np.ndarray, int]]:
    """Reads slices of one code: (data, samples) to (residuals, bits used); raises what a slice fails by.

    At each bit of a stretch of CHUNK bits a table tells which code starts there and how long it is; the codes that do start
    are found by stepping from one to the next. Memory is that of a stretch, whatever the slice.
    """
    only, most, read = reader(descriptor)

    def unpack(data: bytes, count: int) -> tuple[np.ndarray, int]:
        if only is not None:
            return np.full(count, only, np.uint8), 0
        if not count:
            return np.empty(0, np.uint8), 0
        if not most:
            raise CodecError("HuffmanDecodeFailure", bit_position=0)
        raw = big_endian(data)
        total, at, done, out = 8 * (len(raw) - 8), 0, 0, []
        for begin in range(0, total, CHUNK):
            symbol, step = read(raw[begin // 8 : (begin + CHUNK) // 8 + 8])
            steps, places, here, end = step.tobytes(), [], at - begin, len(step)
            add = places.append
            while here < end:
                add(here)
                here += steps[here]
            places = np.array(places[: count - done], np.int64)
            if len(places):
                after = begin + int(places[-1]) + int(step[places[-1]])
                if after > total:  # only the last code of all can reach beyond the data
                    raise CodecError("SliceTruncated", bit_position=begin + int(places[-1]), expected_pixels=count, decoded=done + len(places) - 1)
                out.append(symbol[places])
                done += len(places)
                at = after
            if done == count:
                return np.concatenate(out), at
        raise CodecError("SliceTruncated", bit_position=at, expected_pixels=count, decoded=done)

    return unpack


def unpacked_bits(data: bytes, count: int, descriptor: np.ndarray) -> tuple[np.ndarray, int]:
    return unpacker(descriptor)(data, count)


def padding_bit(data: bytes, used: int) -> int | None:
    """The first set bit at or after `used`."""
    bits = np.unpackbits(np.frombuffer(data, "<u4").astype(">u4").view(np.uint8))[used:]
    return used + int(bits.argmax()) if bits.any() else None
