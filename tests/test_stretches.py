"""Slices decoded by stretches against the serial reader."""

import numpy as np
import pytest


def planes():
    r = np.random.default_rng(4)
    geometric = np.minimum(r.geometric(0.5, 70_000) - 1, 40).astype(np.uint8)
    return {"even": r.integers(0, 256, 20_000).astype(np.uint8), "long": geometric, "two": r.integers(0, 2, 9_999).astype(np.uint8), "one": np.full(5_000, 7, np.uint8), "few": np.array([3, 3, 9], np.uint8), "skew": (r.integers(0, 256, 30_000) * (r.random(30_000) < 0.02)).astype(np.uint8)}


@pytest.fixture(scope="module")
def slices(spark):
    from slicewise.operators import kernels

    rows = []
    for name, x in planes().items():
        d = kernels.code_lengths(np.bincount(x, minlength=256))
        data = kernels.packed_bits(x, d)
        cut = len(data) // 3 // 4 * 4
        rows += [(name, "whole", d.tobytes(), data, len(x)), (name, "more", d.tobytes(), data + b"\xff" * 400, len(x)), (name, "cut", d.tobytes(), data[:cut], len(x)), (name, "none", d.tobytes(), data, 0)]
    rows.append(("empty", "whole", b"\xff" * 256, b"\0" * 8, 5))
    return spark.createDataFrame(rows, "name string, how string, descriptor binary, bytes binary, pixels long")


@pytest.mark.parametrize("size", [32, 1000, 1 << 16])
def test_stretches_are_the_serial_reader(slices, size):
    from slicewise.operators import kernels, stretches

    rows = slices.collect()
    got = {}
    for r in sorted(stretches.decoded(slices, ["name", "how"], size).collect(), key=lambda r: r.k):
        assert r.first == len(got.get((r["name"], r.how), b""))
        got[r["name"], r.how] = got.get((r["name"], r.how), b"") + bytes(r.symbols)
    wrong = {(r["name"], r.how): r.error for r in stretches.errors(slices, ["name", "how"], size).collect()}
    for r in rows:
        own = got.get((r["name"], r.how), b"")
        if not r.pixels:
            assert own == b"" and (r["name"], r.how) not in wrong
            continue
        error = wrong[r["name"], r.how]
        try:
            want = kernels.unpacked_bits(r.bytes, r.pixels, np.frombuffer(r.descriptor, np.uint8))[0].tobytes()
            assert own == want and error is None
        except kernels.CodecError as e:
            assert error.variant == e.variant and error.fields == e.fields, (r["name"], r.how)


def test_codes_are_long_and_paths_meet():
    from slicewise.operators import kernels, stretches

    x = planes()["long"]
    d = kernels.code_lengths(np.bincount(x, minlength=256))
    assert 13 <= max(n for n in d if n != 255) <= 16
    only, most, read = kernels.reader(d)
    step = stretches.opened(read, kernels.packed_bits(x, d)[:4008], 8 * 4000)[1].tobytes()
    exits, counts = stretches.jumps(step, 8 * 4000, most, False)
    assert only is None and len(set(exits)) < most and max(counts) - min(counts) < 40


def test_a_slice_is_dealt_out(spark):
    """A slice ten times as long has ten times as many stretches, none of them longer."""
    from slicewise.operators import kernels, stretches

    def parts(n):
        x = np.random.default_rng(1).integers(0, 200, n).astype(np.uint8)
        d = kernels.code_lengths(np.bincount(x, minlength=256))
        one = spark.createDataFrame([(1, d.tobytes(), kernels.packed_bits(x, d), n)], "s int, descriptor binary, bytes binary, pixels long")
        cut = stretches.stretches_of(one, 4096)
        return cut.count(), cut.selectExpr("max(octet_length(data))").first()[0]

    (few, small), (many, large) = parts(20_000), parts(200_000)
    assert many >= 9.5 * few and small == large == 4096 + stretches.AHEAD
