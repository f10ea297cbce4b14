"""The layout scan in columns against the walk over bytes."""

import numpy as np


def damaged(spark):
    from slicewise.operators import codec

    r = np.random.default_rng(2)
    rows = []
    for k, (fourcc, w, h, n) in enumerate([("ULY4", 8, 6, 3), ("ULY0", 16, 8, 2), ("ULY2", 10, 4, 4), ("ULRG", 5, 5, 1), ("ULRA", 4, 9, 5)]):
        dims = [(w >> (fourcc in ("ULY0", "ULY2")), h >> (fourcc == "ULY0")) if p in (1, 2) else (w, h) for p in range(4 if fourcc == "ULRA" else 3)]
        planes = [(r.integers(0, [1, 2, 200, 7][(p + k) % 4], a * b)).astype(np.uint8).tobytes() for p, (a, b) in enumerate(dims)]
        x = codec.encode_one(fourcc, w, h, 2, n, planes)
        many = [x, b"", x[:3], x[:4], x[:200], x[:258], x[: 256 + 4 * n], x[: len(x) // 2], x + b"\0\0\0\0", x[:-8] + x[-4:], x[:256] + b"\2\0\0\0" + x[260:], x[:256] + b"\xff\xff\xff\xff" + x[260:], None]
        many += [x[:256] + (4).to_bytes(4, "little") + b"\0" * 4 + x[264:] if n > 1 else x, x[:300] + bytes([7]) + x[301:]]
        rows += [("s", 100 * k + j, fourcc, w, h, n, y) for j, y in enumerate(many)]
    rows += [("s", 900, "ABCD", 4, 4, 1, b"\0" * 900), ("s", 901, None, 4, 4, 1, b"\0" * 900), ("s", 902, "ULY4", None, 4, 1, b"\0" * 900), ("s", 903, "ULY4", 4, 4, None, b"\0" * 900)]
    return spark.createDataFrame(rows, "stream_id string, frame_no long, fourcc string, width int, height int, num_slices int, chunk binary")


def test_the_fold_is_the_walk(spark):
    from slicewise.operators import codec, layout

    packets = damaged(spark)
    got, want = ({r.frame_no: r for r in f.collect()} for f in (layout.scanned(packets), codec.parsed(packets, codes=False)))
    assert len(got) == 79 and sum(r.error is None for r in want.values()) >= 5
    for k in want:
        assert got[k].error == want[k].error, (k, got[k].error, want[k].error)
        assert (got[k].layout, got[k].frame_info) == (want[k].layout, want[k].frame_info), k


def test_no_python_in_the_scan(spark):
    from slicewise.operators import layout

    plan = layout.frame_layout(damaged(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_table_functions(spark):
    """LATERAL rows of slices and of samples; a payload that cannot be read has none."""
    from slicewise.operators import codec
    from slicewise.streaming.session import register

    assert {"frame_slices", "frame_pixels"} <= set(register(spark)["functions"])
    packets = damaged(spark)
    slices = spark.sql("SELECT frame_no, x.* FROM {p}, LATERAL frame_slices(chunk, fourcc, width, height, num_slices) x", p=packets).collect()
    want = {r.frame_no: r.layout for r in codec.parsed(packets, codes=False).where("error is null").collect()}
    assert sorted((r.frame_no, r.plane_idx, r.slice_idx, r.start, r.end, r.pixels) for r in slices) == sorted((k, p.plane_idx, s.slice_idx, s.start, s.end, (s.row_end - s.row_start) * p.width) for k, ps in want.items() for p in ps for s in p.slices)
    pixels = spark.sql("SELECT frame_no, x.* FROM {p}, LATERAL frame_pixels(chunk, fourcc, width, height, num_slices) x", p=packets.where("frame_no % 100 = 0")).collect()
    got = {}
    for r in sorted(pixels, key=lambda r: (r.frame_no, r.plane_idx, r.r, r.c)):
        got.setdefault((r.frame_no, r.plane_idx), bytearray()).append(r.v)
    for r in codec.decode(packets.where("frame_no % 100 = 0").selectExpr("*", "0L AS pts")).where("error is null").collect():
        assert [bytes(got[r.frame_no, k]) for k in range(len(r.planes))] == [bytes(p) for p in r.planes]


def test_frames_of_unknown_streams_are_refused(spark):
    import pytest

    from slicewise.streaming.session import EncoderSession

    params = spark.createDataFrame([("a", "ULY4", None, 4, 2, None)], "stream_id string, tag string, pixel_format string, width int, height int, extradata binary")
    frames = spark.createDataFrame([("a", 1, [b"\0" * 8] * 3), ("b", 2, [b"\0" * 8] * 3)], "stream_id string, frame_no long, planes array<binary>")
    with pytest.raises(ValueError, match="stream b has no parameters"):
        EncoderSession(2, params).send_frame(frames)
    session = EncoderSession(2, params)
    session.send_frame(frames.where("frame_no = 1"))
    assert session.receive_packet().count() == 1
