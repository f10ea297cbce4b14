"""Packets that wait in state for their stream's parameters."""

import pytest

PACKETS = "stream_id string, frame_no long, pts long, chunk binary"
PARAMS = "stream_id string, fourcc string, width int, height int, extradata binary, ended boolean"


@pytest.fixture
def streams(spark, tmp_path):
    """Writes rows to the two streams and runs what is there; gives all frames so far, in the order of frame numbers."""
    from slicewise.streaming import keyed

    spark.createDataFrame([], PACKETS).write.parquet(f"{tmp_path}/packets")
    spark.createDataFrame([], PARAMS).write.parquet(f"{tmp_path}/params")

    def go(packets=(), params=()):
        for name, rows, ddl in (("packets", packets, PACKETS), ("params", params, PARAMS)):
            if rows:
                spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        sources = [spark.readStream.schema(ddl).parquet(f"{tmp_path}/{name}") for name, ddl in (("packets", PACKETS), ("params", PARAMS))]
        keyed.run(spark, *sources, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        out = spark.read.parquet(f"{tmp_path}/out").collect()
        return sorted((r.frame_no, r.stream_id, r.error and r.error.variant, r.planes and bytes(r.planes[0])) for r in out)

    return go


def payload(k):
    from slicewise.operators import codec

    planes = [bytes((k + i) % 256 for i in range(64)), bytes(64), bytes([k] * 64)]
    return codec.encode_one("ULY4", 8, 8, 2, 1, planes), planes[0]


def extradata(n=1):
    return bytes([1, 0, 0, 1]) + b"\0" * 4 + (4).to_bytes(4, "little") + (((n - 1) << 24) | 1).to_bytes(4, "little")


def test_packets_wait_for_their_parameters_over_restarts(streams):
    one, plane = payload(1)
    first = [("a", k, 10 * k, one) for k in range(6)] + [("b", 20, None, one), ("c", 30, 1, one), (None, 40, 1, one), ("d", 50, 1, None)]
    assert streams(first) == []
    good = lambda s: (s, "ULY4", 8, 8, extradata(), False)
    done = streams(params=[good("a"), ("b", "ULY4", -1, 8, extradata(), False), ("c", None, 8, 8, extradata(), False), (None, "ULY4", 8, 8, extradata(), None), good("d")])
    expect = [(k, "a", None, plane) for k in range(6)] + [(20, "b", "DimensionConstraint", None), (40, None, None, plane), (50, "d", "InvalidInput", None)]
    assert done == expect
    more = streams([("a", 7, 70, one), ("b", 21, 1, one)], [good("b"), ("c", None, None, None, None, True), ("nobody", None, None, None, None, True)])
    assert [x for x in more if x not in expect] == [(7, "a", None, plane), more[-4], (30, "c", "InvalidInput", None)] and more[-4][:2] == (21, "b")
    assert streams() == more


def test_a_packet_waits_no_longer_than_it_may(spark, tmp_path):
    import time

    from slicewise.streaming import keyed

    for name, rows, ddl in (("packets", [("a", 1, 1, payload(3)[0])], PACKETS), ("params", [], PARAMS)):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    sources = [spark.readStream.schema(ddl).parquet(f"{tmp_path}/{name}") for name, ddl in (("packets", PACKETS), ("params", PARAMS))]
    query = keyed.run(spark, *sources, f"{tmp_path}/out", f"{tmp_path}/check", wait_ms=100)
    try:
        for _ in range(60):
            time.sleep(1)
            out = spark.read.schema("frame_no long, error struct<variant:string>").parquet(f"{tmp_path}/out").collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
            if out:
                break
    finally:
        query.stop()
    assert [(r.frame_no, r.error.variant) for r in out] == [(1, "InvalidInput")]
