"""Kernels over many slices at once against the same slice by slice."""

import numpy as np
import pytest


def frames(r):
    out = []
    for k in range(60):
        fourcc = ("ULY0", "ULY2", "ULY4", "ULRG", "ULRA")[k % 5]
        w, h = 2 * int(r.integers(1, 9)), 2 * int(r.integers(4, 12))
        labels, shift = {"ULY0": (3, (1, 1)), "ULY2": (3, (1, 0))}.get(fourcc, (3 + (fourcc == "ULRA"), (0, 0)))
        dims = [(w >> shift[0], h >> shift[1]) if p in (1, 2) else (w, h) for p in range(labels)]
        kinds = [lambda n: r.integers(0, 256, n), lambda n: np.full(n, 9), lambda n: r.integers(0, 2, n), lambda n: np.minimum(r.geometric(0.5, n), 255)]
        out.append((fourcc, w, h, k % 4, int(r.integers(1, 5)), [kinds[int(r.integers(4))](a * b).astype(np.uint8).tobytes() for a, b in dims]))
    return out


@pytest.fixture(scope="module")
def some():
    return frames(np.random.default_rng(5))


def test_frames_encoded_together_are_the_same(some):
    from slicewise.operators import codec

    assert codec.encode_many(some) == [codec.encode_one(*f) for f in some]
    assert codec.encode_many([]) == []


@pytest.mark.parametrize("strict", [False, True])
def test_frames_decoded_together_are_the_same_with_their_errors(some, strict):
    from slicewise.operators import codec

    r = np.random.default_rng(6)
    packets = []
    for k, f in enumerate(some * 6):
        x = bytearray(codec.encode_one(*f))
        if k >= len(some):  # damaged in some place, or cut
            for _ in range(int(r.integers(1, 4))):
                x[int(r.integers(len(x)))] = int(r.integers(256)) if k % 2 else 0
            x = x[: len(x) - int(r.integers(3)) * 4] if k % 5 == 0 else x
        packets.append((bytes(x), f[0], f[1], f[2], f[4]))
    packets += [(None, "ULY4", 4, 4, 1), (b"", "ULY4", 4, 4, 1), (b"abcd", "ABCD", 4, 4, 1)]
    got, want = codec.decode_many(packets, strict), [codec.decode_one(*x, strict) for x in packets]
    assert got == want
    assert sum(x["error"] is None for x in want) > len(some) and len({x["error"] and x["error"]["variant"] for x in want}) > 5


def test_lengths_of_many_planes_are_those_of_one():
    from slicewise.operators import kernels, together

    r = np.random.default_rng(7)
    counts = np.stack([np.where(r.random(256) < p, r.integers(1, m, 256), 0) for p in (0, 0.01, 0.1, 0.5, 1) for m in (2, 9, 10**6) for _ in range(9)])
    counts[3, :24] = [int(1.7**k) + 1 for k in range(24)]
    assert (together.code_lengths(counts) == np.stack([kernels.code_lengths(c) for c in counts])).all()


def test_planes_packed_together_are_the_same(some):
    from slicewise.operators import codec

    planes = [[p[: len(p) // 3], p[len(p) // 3 :]] for f in some for p in f[5]] + [[b"", b"ab"], [b""]]
    assert codec.plane_blobs(planes) == [codec.plane_blob([np.frombuffer(x, np.uint8) for x in p]) for p in planes]


def test_large_rows_are_taken_few_at_a_time():
    import pyarrow as pa

    from slicewise.functions.schemas import BYTES, ROWS, few

    sizes = [100_000] * 300 + [BYTES + 1, 5] + [0] * (ROWS + 1)
    batch = pa.RecordBatch.from_arrays([pa.array([bytes(n) for n in sizes])], names=["x"])
    parts = list(few(iter([batch, batch.slice(0, 0)])))
    assert [len(x) for p in parts for x in p["x"].to_pylist()] == sizes
    assert all(p.num_rows <= ROWS and (p.num_rows == 1 or p.nbytes <= BYTES) for p in parts)
