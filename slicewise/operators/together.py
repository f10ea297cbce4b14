"""The kernels over many small slices at once: what a slice of some dozen samples costs is mostly the call.

`residuals`, `blobs` and `read` give what the functions of `kernels` give slice by slice. What is not as it should be (a code that
is not complete, bits that run out) is only marked: the caller takes those by `kernels`, which says what is wrong.
"""

from __future__ import annotations

import numpy as np

from . import kernels

#: Samples that are taken together, and the largest frame that is not taken by itself.
SAMPLES, SMALL = 1 << 18, 1 << 16
BITS, BIG = 16, 1 << 40  # longest code that is read here; a weight above all that are merged


def groups(sizes: list[int]) -> list[list[int]]:
    """Places of the sizes, in stretches of at most SAMPLES in all."""
    out, total = [[]], 0
    for k, n in enumerate(sizes):
        if out[-1] and total + n > SAMPLES:
            out.append([])
            total = 0
        out[-1].append(k)
        total += n
    return out


def residuals(predictor: int, x: np.ndarray, width: int, begins: np.ndarray) -> np.ndarray:
    """What prediction leaves of slices of one width, whose samples lie one after another and begin at `begins`."""
    if predictor == 0:
        return x
    out = x - np.concatenate([[0], x[:-1]]).astype(np.uint8)
    out[begins] = x[begins] - np.uint8(kernels.FIRST)
    if predictor == 1:
        return out
    later = np.ones(len(x) // width, bool)  # rows but each slice's first
    later[begins // width] = False
    if predictor == 2:
        grid = x.reshape(-1, width)
        rows = np.flatnonzero(later)
        down = grid[rows] - grid[rows - 1]
        out.reshape(-1, width)[rows] = np.diff(down, axis=1, prepend=np.uint8(0))
        return out
    at = np.flatnonzero(np.repeat(later, width))
    a, b, d = x[at - 1], x[at - width], x[np.maximum(at - width - 1, 0)]
    second = np.zeros(len(x) + 1, bool)
    second[np.minimum(begins + width, len(x))] = True  # the first sample of a second row
    out[at] = x[at] - np.where(second[at], b, kernels.median3(a, b, a + b - d))
    return out


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """`kernels.code_lengths` of each row."""
    used = (counts > 0).sum(1)
    most = max(int(used.max(initial=0)), 1)
    order = np.argsort(np.where(counts > 0, counts, BIG), axis=1, kind="stable")[:, :most]
    own = np.take_along_axis(counts, order, 1)
    coins = np.where(own > 0, own, BIG).astype(np.int64)
    row, levels = coins, []
    for _ in range(kernels.MAX_LENGTH - 1):
        half = row.shape[1] // 2
        pairs = np.minimum(row[:, : 2 * half : 2] + row[:, 1 : 2 * half : 2], BIG)
        both = np.concatenate([pairs * 2, coins * 2 + 1], axis=1)  # pairs go before coins of equal weight
        both.sort(axis=1)
        levels.append(both & 1 == 0)
        row = both >> 1
    rank, spent = np.arange(most), np.zeros((len(counts), most), np.int64)
    take = np.maximum(2 * used - 2, 0)
    for pair in reversed(levels):
        n = (pair & (np.arange(pair.shape[1]) < take[:, None])).sum(1)
        spent += rank < (take - n)[:, None]
        take = 2 * n
    spent += rank < take[:, None]
    out = np.full(counts.shape, kernels.UNUSED, np.uint8)
    at, k = np.nonzero(own > 0)
    out[at, order[at, k]] = np.where(used[at] > 1, spent[at, k], 0)
    return out


def codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, code, whether the code is complete) of each row of descriptors with lengths up to BITS; 0 bits where there is no code."""
    n = np.where((lengths == kernels.UNUSED) | (lengths > BITS), 0, lengths).astype(np.int64)
    share = np.where(n > 0, 1 << (BITS - n), 0)
    order = np.argsort(-(n * 256 + np.arange(256)), axis=1)
    sorted_ = np.take_along_axis(share, order, 1)
    first = np.empty_like(share)
    np.put_along_axis(first, order, np.cumsum(sorted_, axis=1) - sorted_, 1)
    bad = ((lengths > BITS) & (lengths != kernels.UNUSED)).any(1)
    return n, first >> (BITS - n), (share.sum(1) == 1 << BITS) & ~bad & (lengths != 0).all(1)


def blobs(res: np.ndarray, sizes: np.ndarray, plane: np.ndarray, planes: int) -> list[bytes]:
    """The planes' bytes (`codec.plane_blob`) from the residuals of all slices, plane by plane, none of them empty."""
    own = np.repeat(plane, sizes) * 256 + res
    d = code_lengths(np.bincount(own, minlength=256 * planes).reshape(planes, 256))
    n, code, _ = codes(d)
    n, code = n.ravel()[own], code.ravel()[own]
    begins = np.cumsum(sizes) - sizes
    before = np.cumsum(n) - n
    bits = np.add.reduceat(n, begins)
    words = (bits + 31) // 32
    first = np.cumsum(words) - words
    at = before + np.repeat(32 * first - before[begins], sizes)
    value = code.astype(np.uint64) << (64 - (at & 31) - n).astype(np.uint64) % np.uint64(64)  # no code, no bits: the code is 0 then
    total = int(words.sum())
    high = np.bincount(at >> 5, weights=value >> np.uint64(32), minlength=total + 1)[: total + 1]
    low = np.bincount((at >> 5) + 1, weights=value & np.uint64(0xFFFFFFFF), minlength=total + 1)[: total + 1]
    data = (high + low)[:total].astype("<u4")
    cut = np.searchsorted(plane, np.arange(planes + 1))  # the planes' slices
    edge = np.concatenate([[0], np.cumsum(words)])
    ends = [((edge[a + 1 : b + 1] - edge[a]) * 4).astype("<u4") for a, b in zip(cut, cut[1:], strict=False)]
    return [b"".join([d[k].tobytes(), ends[k].tobytes(), data[edge[cut[k]] : edge[cut[k + 1]]].tobytes()]) for k in range(planes)]


def read(data: list[bytes], sizes: np.ndarray, plane: np.ndarray, descriptors: np.ndarray, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """(residuals of all slices, whether a slice was read well) from the slices' bytes, all in step: the next code of each slice at a time."""
    n, code, complete = codes(descriptors)
    only = (descriptors == 0).sum(1) == 1
    only &= ~((descriptors != 0) & (descriptors != kernels.UNUSED)).any(1)
    lens = np.array([len(x) for x in data], np.int64)
    good = (complete[plane] | (only[plane] & (lens == 0))) & (lens % 4 == 0)
    begins = np.cumsum(sizes) - sizes
    out = np.repeat(np.argmin(descriptors != 0, axis=1).astype(np.uint8)[plane], sizes)  # the only symbol
    word = np.frombuffer(b"".join(d if g else b"" for d, g in zip(data, good, strict=True)) + bytes(8), "<u4").astype(np.uint64)
    end = np.cumsum(np.where(good, lens, 0)) * 8
    at = end - np.where(good, lens, 0) * 8
    todo = np.flatnonzero(good & complete[plane])
    todo = todo[np.argsort(-sizes[todo], kind="stable")]
    p, k = np.nonzero(n > 0)
    first = (p << BITS) + (code[p, k] << (BITS - n[p, k]))
    order = np.argsort(first)
    first, symbol, step = first[order], k[order].astype(np.uint8), n[p, k][order]
    where, base, left, own = at[todo], begins[todo], sizes[todo], plane[todo] << BITS
    live = len(todo)
    for t in range(int(left[0]) if live else 0):
        while left[live - 1] <= t:
            live -= 1
        x = where[:live]
        w = np.minimum(x >> 5, len(word) - 2)
        window = ((word[w] << np.uint64(32) | word[w + 1]) << (x & 31).astype(np.uint64)) >> np.uint64(64 - BITS)
        i = np.searchsorted(first, own[:live] + window.astype(np.int64), side="right") - 1
        out[base[:live] + t] = symbol[i]
        where[:live] += step[i]
    rest = end[todo] - where
    fine = rest >= 0
    if strict:
        last = word[np.maximum(end[todo] // 32 - 1, 0)].astype(np.int64)
        fine &= (rest < 32) & ((last & ((1 << np.clip(rest, 0, 32)) - 1)) == 0)
    good[todo[~fine]] = False
    return out, good
