"""The data source of frame bodies: batch, stream, write, failed tasks and aborted writes."""

import pytest


@pytest.fixture
def folder(spark, tmp_path):
    from slicewise.sources import connector

    connector.register(spark)
    return str(tmp_path / "frames")


def packets(spark, ids, tag=b""):
    return spark.createDataFrame([(s, k, None, f"{s}{k}".encode() + tag) for s, n in ids.items() for k in range(n)], "stream_id string, frame_no long, pts long, chunk binary").repartition(3)


def rows(df):
    return sorted((r.stream_id, r.frame_no, bytes(r.chunk)) for r in df.collect())


def test_write_and_read(spark, folder):
    one = packets(spark, {"a": 5, "b/ ü": 3})
    one.write.format("frame_bodies").mode("append").save(folder)
    got = spark.read.format("frame_bodies").load(folder)
    assert rows(got) == rows(one)
    packets(spark, {"c": 2}).write.format("frame_bodies").mode("append").save(folder)
    assert len(rows(spark.read.format("frame_bodies").load(folder))) == 10
    packets(spark, {"a": 1}).write.format("frame_bodies").mode("overwrite").save(folder)
    assert rows(spark.read.format("frame_bodies").load(folder)) == [("a", 0, b"a0")]


def test_filters_leave_files_unopened(spark, folder):
    from pathlib import Path

    packets(spark, {"a": 20, "b": 20, "c": 3}).write.format("frame_bodies").mode("append").save(folder)
    for f in Path(folder).glob("stream_id=b/*/*.frame"):
        if int(f.stem) > 4:  # reading it would fail
            f.unlink()
            f.mkdir()
    df = spark.read.format("frame_bodies").load(folder)
    assert rows(df.where("stream_id = 'a' and frame_no >= 17")) == [("a", k, f"a{k}".encode()) for k in (17, 18, 19)]
    assert rows(df.where("stream_id in ('b', 'c') and frame_no < 2 and frame_no > 0")) == [("b", 1, b"b1"), ("c", 1, b"c1")]
    from slicewise.sources.connector import EqualTo, GreaterThan, In, Reader

    reader = Reader(Path(folder))
    assert list(reader.pushFilters([EqualTo(("stream_id",), "a"), GreaterThan(("frame_no",), 15), In(("pts",), (1,))])) == [In(("pts",), (1,))]
    assert sorted(n for p in reader.partitions() for n, _ in p.paths) == [16, 17, 18, 19] and {p.stream for p in reader.partitions()} == {"a"}


def test_a_failed_task_leaves_nothing_to_see(spark, folder):
    from pathlib import Path

    packets(spark, {"a": 3}).write.format("frame_bodies").mode("append").save(folder)
    bad = packets(spark, {"b": 30}).union(spark.createDataFrame([("b", None, None, b"x")], "stream_id string, frame_no long, pts long, chunk binary"))
    with pytest.raises(Exception, match="cannot be written"):
        bad.write.format("frame_bodies").mode("append").save(folder)
    assert rows(spark.read.format("frame_bodies").load(folder)) == [("a", k, f"a{k}".encode()) for k in range(3)]
    assert not list(Path(folder).glob("stream_id=b/*/*.frame"))


def test_a_folder_without_a_log(spark, folder):
    from pathlib import Path

    (Path(folder) / "stream_id=s").mkdir(parents=True)
    (Path(folder) / "stream_id=s" / "7.frame").write_bytes(b"body")
    assert rows(spark.read.format("frame_bodies").load(folder)) == [("s", 7, b"body")]
    (Path(folder) / "stream_id=s" / "7.frame").unlink()
    assert rows(spark.read.format("frame_bodies").load(folder)) == []


def test_a_stream_reads_each_write_once(spark, folder, tmp_path):
    def run():
        q = spark.readStream.format("frame_bodies").load(folder).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return rows(spark.read.parquet(f"{tmp_path}/out"))

    one, two = packets(spark, {"a": 4}), packets(spark, {"a": 2, "b": 3}, b"!")
    one.write.format("frame_bodies").mode("append").save(folder)
    assert run() == rows(one)
    two.write.format("frame_bodies").mode("append").save(folder)
    assert run() == rows(one.union(two)) == run()


def test_other_stores_are_refused():
    from slicewise.sources.connector import folder_of

    assert str(folder_of("file:///tmp/x%20y")) == "/tmp/x y" and str(folder_of("/tmp/x")) == "/tmp/x"
    with pytest.raises(ValueError, match="can open"):
        folder_of("hdfs://x/y")


def test_packs_hold_many_frames(spark, folder):
    """Files do not become as many as frames, and no row is lost or changed, be it beside single files or written twice."""
    from pathlib import Path

    from slicewise.sources.connector import Reader, planned

    rows_of = spark.createDataFrame([(s, k, None, f"{s}{k}".encode()) for s, n in (("a", 3000), ("b/ ü", 40)) for k in range(-5, n)], "stream_id string, frame_no long, pts long, chunk binary")
    twice = rows_of.where("frame_no = 7").withColumn("chunk", rows_of.chunk.substr(1, 1).cast("binary"))
    one = rows_of.union(twice).coalesce(1)
    one.write.format("frame_bodies").option("packed", True).mode("append").save(folder)
    assert len(list(Path(folder).rglob("*.frame"))) == 0 and len(list(Path(folder).rglob("*.frames"))) <= 4
    packets(spark, {"a": 2}, b"!").write.format("frame_bodies").mode("append").save(folder)
    got = spark.read.format("frame_bodies").load(folder)
    assert rows(got) == sorted(rows(one) + [("a", k, f"a{k}!".encode()) for k in range(2)])
    assert rows(got.where("frame_no > -4 and frame_no <= -2 and stream_id = 'a'")) == [("a", k, f"a{k}".encode()) for k in (-3, -2)]
    assert [len(x.paths) for x in planned(Path(folder), [str(d.relative_to(folder)) for d in Path(folder).glob("stream_id=a/*")], None, 2500, 2600)] == [1]
    assert sum(x.stream == "b/ ü" for x in Reader(Path(folder)).partitions()) == 1


def test_packs_of_other_frames_are_not_opened(spark, folder):
    from pathlib import Path

    for low in (0, 10):
        packets(spark, {"a": 20}).where(f"frame_no >= {low} and frame_no < {low + 10}").coalesce(1).write.format("frame_bodies").option("packed", True).mode("append").save(folder)
    (late,) = Path(folder).glob("stream_id=a/*/10_19_10_*.frames")
    late.write_bytes(b"reading it would fail")
    df = spark.read.format("frame_bodies").load(folder)
    assert rows(df.where("frame_no < 10 and frame_no >= 8")) == [("a", k, f"a{k}".encode()) for k in (8, 9)]
    with pytest.raises(Exception, match="Arrow"):
        spark.read.format("frame_bodies").load(folder).collect()


def test_partitions_go_over_write_tasks(spark, folder):
    """A partition for each task and stream would be as many as both together."""
    from pathlib import Path

    from slicewise.sources.connector import Reader

    packets(spark, {"a": 60, "b": 60}).repartition(8).write.format("frame_bodies").option("packed", True).mode("append").save(folder)
    assert len(list(Path(folder).glob("stream_id=a/*"))) == 8
    parts = Reader(Path(folder)).partitions()
    assert sorted(p.stream for p in parts) == ["a", "b"] and all(len(p.paths) == 8 for p in parts)


def test_the_roundtrip_query_packs_frames_and_moves_no_stream(spark):
    """Frames meet their stream's parameters where they are: by stream a few tasks would have all."""
    from pathlib import Path
    from urllib.parse import urlparse

    from slicewise.plans.queries import QUERIES

    root = Path(urlparse(spark.conf.get("spark.checkpoint.dir")).path)
    there = set(root.glob("*/bodies"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")  # as larger tables are to the usual one
    try:
        out = QUERIES["connector_roundtrip"](spark, "/root/testdata/sf0.01")
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    (bodies,) = set(root.glob("*/bodies")) - there
    frames = out.where("way = 'stream'").select("frame_no").distinct().count()
    assert sum(1 for f in bodies.rglob("*.frame*")) < frames / 2
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
