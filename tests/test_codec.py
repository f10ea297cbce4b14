"""Hand vectors, round trips and errors of the plane codec."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise.functions import errors as E
from slicewise.functions import formats as S
from slicewise.operators import codec, entropy, layout, predict
from slicewise.operators import kernels as K

FRAME = "stream_id string, frame_no long, fourcc string, width int, height int, predictor int, num_slices int, planes array<binary>"
CONFIG = "stream_id string, fourcc string, width int, height int, num_slices int"


def descriptor(lengths):
    d = np.full(256, 255, np.uint8)
    for s, n in lengths.items():
        d[s] = n
    return d


def codes(lengths):
    s, n, c, only = K.codebook(descriptor(lengths))
    return {int(a): format(int(b), f"0{int(k)}b") for a, k, b in zip(s, n, c, strict=True)}, only


def test_canonical_codes():
    assert codes({0: 1, 128: 1})[0] == {128: "0", 0: "1"}
    assert codes({3: 1, 128: 2, 218: 2})[0] == {218: "00", 128: "01", 3: "1"}
    assert codes({s: 8 for s in range(255)} | {255: 8})[0] == {s: format(~s & 255, "08b") for s in range(256)}
    assert codes({42: 0}) == ({}, 42)


@pytest.mark.parametrize(("lengths", "variant"), [({0: 1, 1: 3}, "KraftViolation"), ({1: 0, 2: 0}, "MultipleSingleSymbolSentinels"), ({1: 0, 2: 1, 3: 1}, "KraftViolation"), ({0: 1, 1: 1, 2: 1}, "KraftViolation"), ({**{k: k for k in range(1, 200)}, 200: 199}, "KraftViolation")])
def test_bad_descriptors(lengths, variant):
    with pytest.raises(K.CodecError) as e:
        K.codebook(descriptor(lengths))
    assert e.value.variant == variant


def test_packed_bytes():
    d = descriptor({0: 1, 128: 1})
    assert K.packed_bits(np.array([128] + [0] * 255, np.uint8), d) == bytes.fromhex("ffffff7f") + b"\xff" * 28
    d = descriptor({3: 1, 128: 2, 218: 2})
    data = K.packed_bits(np.array([128] + [3] * 15 + ([218] + [3] * 15) * 15, np.uint8), d)
    assert len(data) == 36 and data[:4] == bytes.fromhex("ff9fff7f")
    assert K.padding_bit(bytes.fromhex("01000000"), 0) == 31 and K.padding_bit(bytes.fromhex("00000080"), 0) == 0


def test_unpacking_ends():
    d = descriptor({i: i + 1 for i in range(14)} | {20: 14})
    x = np.random.default_rng(1).choice([*range(14), 20], 500).astype(np.uint8)
    data = K.packed_bits(x, d)
    assert (K.unpacked_bits(data, 500, d)[0] == x).all()
    with pytest.raises(K.CodecError) as e:
        K.unpacked_bits(data[:8], 500, d)
    assert e.value.variant == "SliceTruncated" and e.value.fields["expected_pixels"] == 500 and e.value.fields["decoded"] < 500
    with pytest.raises(K.CodecError) as e:
        K.unpacked_bits(b"", 3, descriptor({}))
    assert (e.value.variant, e.value.fields) == ("HuffmanDecodeFailure", {"bit_position": 0})
    assert (K.unpacked_bits(bytes([1, 2, 3, 4]), 5, descriptor({7: 0}))[0] == 7).all()


def test_code_lengths():
    counts = np.zeros(256, np.int64)
    counts[[0, 128]] = 100
    assert K.code_lengths(counts)[[0, 128]].tolist() == [1, 1]
    r = np.random.default_rng(3)
    for _ in range(20):
        counts = np.where(r.random(256) < 0.3, r.integers(1, 1000, 256), 0)
        n = K.code_lengths(counts)
        K.codebook(n)
        assert (n[counts > 0] <= 16).all()
        assert int((counts * np.where(n == 255, 0, n).astype(int)).sum()) == huffman_cost(counts)
    counts = np.array([2**min(k, 40) for k in range(40)] + [0] * 216, np.int64)  # the cap binds
    assert K.code_lengths(counts)[:40].max() == 16


def huffman_cost(counts):
    import heapq

    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def plain_residuals(p, x, w):
    """By the definition, sample by sample."""
    x = x.astype(int).reshape(-1, w)
    out = np.zeros_like(x)
    med = lambda a, b, c: sorted([a, b, (a + b - c) % 256])[1]
    for r, c in itertools.product(*map(range, x.shape)):
        if p == 0:
            g = 0
        elif r == 0 or p == 1:
            g = x[r, c - 1] if c else (x[r - 1, w - 1] if r else 128)
        elif c == 0:
            g = x[r - 1, 0] if p == 2 or r == 1 else med(x[r - 1, w - 1], x[r - 1, 0], x[r - 2, w - 1])
        else:
            a, b, d = x[r, c - 1], x[r - 1, c], x[r - 1, c - 1]
            g = (a + b - d) % 256 if p == 2 else med(a, b, d)
        out[r, c] = (x[r, c] - g) % 256
    return out.ravel().astype(np.uint8)


@pytest.mark.parametrize("p", range(4))
def test_prediction(p):
    r = np.random.default_rng(p)
    for h, w in [(1, 1), (1, 7), (6, 1), (5, 2), (9, 7), (12, 32)]:
        x = r.integers(0, 256, (3, h * w), dtype=np.uint8)
        res = np.stack([K.residuals(p, s, w) for s in x])
        assert (res[0] == plain_residuals(p, x[0], w)).all()
        assert (K.restored(p, res, w) == x).all()


def test_median_of_three(spark):
    rows = spark.createDataFrame([(249, 243, 236), (10, 20, 250), (100, 120, 110)], "a int, b int, c int")
    assert [r[0] for r in rows.select(predict.med(F.col("a"), F.col("b"), F.col("c"))).collect()] == [243, 20, 110]


def plane(h, w, seed):
    r = np.random.default_rng(seed)
    return ((np.add.outer(7 * np.arange(h), 3 * np.arange(w)) + r.integers(0, 16, (h, w))) & 255).astype(np.uint8).tobytes()


def dims(f, w, h):
    return [(w, h)] + [(w // 2, h // 2) if f == "ULY0" else (w // 2, h) if f == "ULY2" else (w, h)] * 2 + [(w, h)] * (f == "ULRA")


@pytest.fixture(scope="module")
def matrix(spark):
    rows, k = [], 0
    for f, p, (w, h), n in itertools.product(S.LAYOUTS, range(4), [(2, 2), (16, 16), (32, 48)], (1, 3)):
        if n <= min(y for _, y in dims(f, w, h)):
            rows.append((f"{f}-{w}x{h}-{n}", k, f, w, h, p, n, [plane(y, x, k + i) if k % 5 else bytes([128]) * (x * y) for i, (x, y) in enumerate(dims(f, w, h))]))
            k += 1
    frames = spark.createDataFrame(rows, FRAME)
    return rows, codec.encode(frames).persist(), frames.select("stream_id", "fourcc", "width", "height", "num_slices").distinct()


def test_round_trip_of_all_formats(matrix):
    rows, packets, config = matrix
    sent = packets.select("stream_id", "frame_no", F.col("frame_no").alias("pts"), "chunk")
    for strict, by_slice in ((False, False), (True, False), (True, True)):
        got = {r.frame_no: r for r in codec.decode(sent, config, strict, by_slice).collect()}
        for s, k, _, _, _, p, _, planes in rows:
            assert got[k].error is None and (got[k].stream_id, got[k].predictor, got[k].pts) == (s, p, k)
            assert [bytes(x) for x in got[k].planes] == planes


def test_bytes_do_not_depend_on_partitions(spark, matrix):
    rows, packets, _ = matrix
    again = codec.encode(spark.createDataFrame(rows, FRAME).repartition(7), by_slice=True)
    assert {r.frame_no: bytes(r.chunk) for r in packets.collect()} == {r.frame_no: bytes(r.chunk) for r in again.collect()}


def test_solid_frame_size(spark):
    rows = [("s", 0, "ULY0", 16, 16, 1, 1, [b"\x80" * 256, b"\x80" * 64, b"\x80" * 64]), ("s", 1, "ULY0", 128, 96, 1, 1, [b"\x80" * 12288, b"\x80" * 3072, b"\x80" * 3072])]
    assert {len(r.chunk) for r in codec.encode(spark.createDataFrame(rows, FRAME)).collect()} == {784}


def payload(planes, info=0):
    """planes: (lengths, words for each slice)."""
    out = b""
    for lengths, slices in planes:
        data = [np.array(w, "<u4").tobytes() for w in slices]
        out += descriptor(lengths).tobytes() + np.cumsum([len(d) for d in data]).astype("<u4").tobytes() + b"".join(data)
    return out + info.to_bytes(4, "little")


BITS = {0: 1, 128: 1}


def decoded(spark, chunk, f, w, h, n, strict=False):
    packets = spark.createDataFrame([("s", 0, None, chunk)], "stream_id string, frame_no long, pts long, chunk binary")
    return codec.decode(packets, spark.createDataFrame([("s", f, w, h, n)], CONFIG), strict).first()


def test_empty_slices_are_read(spark):
    out = decoded(spark, payload([(BITS, [[], [0x40000000], [0xC0000000]])] * 3), "ULY4", 2, 2, 3)
    assert out.error is None and bytes(out.planes[0]) == bytes([128, 0, 0, 0])


def test_padding(spark):
    chunk = payload([(BITS, [[0x00000001]])] * 3)
    assert decoded(spark, chunk, "ULY4", 4, 4, 1).error is None
    e = decoded(spark, chunk, "ULY4", 4, 4, 1, strict=True).error
    assert (e.variant, e.fields) == ("NonZeroPadding", {"plane": 0, "slice": 0, "bit_position": 31})


@pytest.mark.parametrize(
    ("chunk", "variant", "fields"),
    [
        (b"\0" * 3, "MissingFrameInfo", {}),
        (b"\0" * 4, "ChunkTooShort", {"offset": 0, "needed": 256, "have": 0}),
        (b"\xff" * 104, "ChunkTooShort", {"offset": 0, "needed": 256, "have": 100}),
        (b"\xff" * 256 + b"\0" * 12, "ChunkTooShort", {"offset": 256, "needed": 16, "have": 8}),
        (descriptor(BITS).tobytes() + np.array([8, 4, 8, 8], "<u4").tobytes() + b"\0" * 12, "NonMonotonicSliceOffsets", {}),
        (descriptor(BITS).tobytes() + np.array([4, 5, 8, 8], "<u4").tobytes() + b"\0" * 12, "SliceNotWordAligned", {"offset": 5}),
        (payload([(BITS, [[0]] * 4)] * 3)[:-4] + b"\0" * 8, "ChunkTooShort", {"offset": 864, "needed": 4, "have": 0}),
        (payload([({0: 1, 1: 3}, [[0]] * 4)] * 3), "KraftViolation", {}),
        (payload([(BITS, [[0]] * 4), (BITS, [[0], [0], [], [0]]), (BITS, [[0], [], [0], [0]])]), "SliceTruncated", {"bit_position": 0, "expected_pixels": 16, "decoded": 0}),
    ],
)
def test_malformed_payloads(spark, chunk, variant, fields):
    e = decoded(spark, chunk, "ULY4", 4, 16, 4).error
    assert (e.variant, e.fields) == (variant, fields)
    packets = spark.createDataFrame([("s", 0, None, chunk, "ULY4", 4, 16, 4)], "stream_id string, frame_no long, pts long, chunk binary, fourcc string, width int, height int, num_slices int")
    e = codec.decode(packets, by_slice=True).first().error
    assert (e.variant, e.fields) == (variant, fields)


def test_inputs_that_cannot_be_encoded(spark):
    good = [b"\0" * 64, b"\0" * 16, b"\0" * 16]
    rows = [("ULY0", 7, 8, 1, good), ("ULY0", 8, 8, 1, good[:2]), ("ULY0", 8, 8, 0, good), ("ULY0", 8, 8, 257, good), ("ULY0", 8, 8, 5, good), ("ULY0", 8, 8, 4, [good[0], good[1], b""]), ("ABCD", 8, 8, 1, good)]
    out = {r.frame_no: r for r in codec.encode(spark.createDataFrame([("s", k, f, w, h, 1, n, p) for k, (f, w, h, n, p) in enumerate(rows)], FRAME)).collect()}
    assert [out[k].error.variant for k in range(7)] == ["DimensionConstraint", "EncoderPlaneSizeMismatch", "InvalidSliceCount", "InvalidSliceCount", "SliceCountExceedsPlaneHeight", "EncoderPlaneSizeMismatch", "UnknownFourcc"]
    assert out[1].error.fields == {"plane": 2, "expected": 3, "got": 2} and out[4].error.fields == {"num_slices": 5, "min_plane_height": 4} and out[5].error.fields == {"plane": 2, "expected": 16, "got": 0}


def test_error_taxonomy(spark):
    rows = spark.createDataFrame([(v,) for v in E.CATEGORY], "v string")
    got = dict(rows.select("v", E.category(F.col("v"))).collect())
    assert got == E.CATEGORY and len(got) == 20 and set(E.MESSAGE) == set(E.CATEGORY)
    text = spark.range(1).select(E.message(E.error("SliceTruncated", bit_position=F.lit(9), expected_pixels=F.lit(4), decoded=F.lit(2)))).first()[0]
    assert text == "the bits run out at 9, after 2 of 4 samples"
    e = S.dims_error(F.lit("ULY0"), F.lit(7), F.lit(8))
    text = spark.range(1).select(E.message(e), E.message(E.error("UnknownFourcc", fourcc=S.as_number(F.lit("AB")))), E.message(E.error("InvalidInput")), E.message(E.error("InvalidSliceCount"))).first()
    assert tuple(text) == ("a size of 7 x 8 does not suit the layout: both must be even", "no layout has the FourCC 00004142", "the input cannot be used", "a plane has 1 to 256 slices, not ?")


def test_extradata(spark):
    data = spark.createDataFrame([(bytearray.fromhex("f0000001595631320400000001000000"),)], "x binary")
    d = data.select(S.extradata(F.col("x")).alias("d")).first().d
    assert (d.encoder_version, bytes(d.source_format_tag), d.frame_info_size, d.flags) == (0x010000F0, b"YV12", 4, 1)
    built = spark.createDataFrame([(f,) for f in S.LAYOUTS], "f string").select("f", F.hex(S.build_extradata(F.col("f"), F.lit(8)))).collect()
    assert dict(built) == {f: "F0000001" + x[2] + "0400000001000007" for f, x in S.LAYOUTS.items()}
    p = spark.createDataFrame([(0xFFFFFFFF,), (0x12345101,)], "x long").select(S.predictor_of(F.col("x"))).collect()
    assert [r[0] for r in p] == [3, 1]


def test_stream_parameters(spark):
    x = bytearray.fromhex("f0000001595631320400000001000003")
    rows = spark.createDataFrame([("ULY0", 8, 8, x), (None, 8, 8, x), ("ULY0", None, 8, x), ("ULY0", 8, 8, bytearray()), ("ULY0", 7, 8, x), ("ULY0", 8, 8, x[:15])], "fourcc string, width int, height int, extradata binary")
    got = [(r.deferred, r.error.variant if r.error else None, r.num_slices) for r in S.stream_config(rows).collect()]
    assert got == [(False, None, 4), (True, None, None), (True, None, None), (True, None, None), (False, "DimensionConstraint", None), (False, "ExtradataTruncated", None)]
    rows = spark.createDataFrame([("ULRG", "Yuv420P", 8, 8, None), (None, "Yuv420P", 8, 8, bytearray()), (None, "Rgb24", 8, 8, None), (None, None, 8, 8, None), ("ULY4", None, None, 8, None)], "tag string, pixel_format string, width int, height int, extradata binary")
    got = [(r.fourcc, r.error.variant if r.error else None, r.num_slices) for r in S.encoder_config(rows).collect()]
    assert got == [("ULRG", None, 1), ("ULY0", None, 1), (None, "InvalidInput", None), (None, "InvalidInput", None), ("ULY4", "InvalidInput", None)]


def test_layout_statistics(spark):
    checker = np.kron([[0, 128], [128, 0]], np.ones((4, 4))).astype(np.uint8).tobytes()
    frames = spark.createDataFrame([("s", 0, "ULY4", 8, 8, 0, 2, [checker] * 3)], FRAME)
    packets = codec.encode(frames).select("stream_id", "frame_no", "chunk")
    read = layout.frame_layout(packets, frames.select("stream_id", "fourcc", "width", "height", "num_slices"))
    p = layout.plane_layout(read).where("plane_idx = 0").first()
    assert [tuple(r) for r in p.code_length_histogram] == [(1, 2)] and p.kraft_numerator == "2" and p.is_kraft_complete
    assert (p.active_symbol_count, p.unused_symbol_count, p.total_pixels, p.total_size) == (2, 254, 64, 256 + 8 + 8)
    s = layout.slice_layout(read).where("plane_idx = 0").orderBy("slice_idx").collect()
    assert [(r.row_start, r.row_end, r.pixel_count, r.len, r.is_empty) for r in s] == [(0, 4, 32, 4, False), (4, 8, 32, 4, False)]


@pytest.mark.parametrize(("tiers", "complete", "digits"), [([*((k, 1) for k in range(1, 200)), (200, 2)], True, str(2**128 - 1)), ([(1, 1), (200, 1)], False, str(2**128 - 1)), ([(1, 2)], True, "2"), ([(1, 1)], False, "1"), ([(2, 4)], True, "4"), ([], False, "0")])
def test_kraft_of_deep_codes(spark, tiers, complete, digits):
    row = spark.createDataFrame([([{"code_length": n, "count": c} for n, c in tiers],)], "h array<struct<code_length:int,count:int>>")
    assert tuple(row.select(layout.is_kraft_complete(F.col("h"), F.lit(False)), layout.kraft_numerator("h")).first()) == (complete, digits)


def test_predictor_choice(spark):
    rows = spark.createDataFrame([(32, 16, bytearray(b"\x40" * 512)), (0, 4, bytearray()), (16, 16, bytearray((np.arange(256) * 3 & 255).astype(np.uint8).tobytes()))], "w int, h int, x binary")
    got = [r.predictor for r in entropy.chosen_predictors(rows, "w", "h", "x").collect()]
    assert got[0] == 0 and got[1] == 2


def test_sessions(spark):
    from slicewise.streaming.session import DecoderSession, EncoderSession, Eof, NeedMore

    frames = spark.createDataFrame([("s", 5, "ULY4", 8, 8, None, 1, [plane(8, 8, k) for k in range(3)])], FRAME)
    config = frames.select("stream_id", "fourcc", "width", "height", "num_slices")
    enc, dec = EncoderSession(), DecoderSession()
    with pytest.raises(NeedMore):
        enc.receive_packet()
    enc.send_frame(frames)
    with pytest.raises(RuntimeError):
        enc.send_frame(frames)
    packet = enc.receive_packet().first()
    assert packet.keyframe and packet.pts is None
    enc.flush()
    with pytest.raises(Eof):
        enc.receive_packet()
    sent = spark.createDataFrame([("s", 5, 42, packet.chunk)], "stream_id string, frame_no long, pts long, chunk binary")
    dec.send_packet(sent)
    with pytest.raises(RuntimeError):
        dec.send_packet(sent)
    with pytest.raises(ValueError):
        dec.receive_frame()  # the packet is taken all the same
    with pytest.raises(NeedMore):
        dec.receive_frame()
    dec.configure(config)
    dec.send_packet(sent)
    out = dec.receive_frame().first()
    assert out.pts == 42 and [bytes(x) for x in out.planes] == [plane(8, 8, k) for k in range(3)]


def test_frames_from_files(spark, tmp_path):
    from slicewise.sources.frames import packets_table, read_frames, stream_frames, write_packets

    (tmp_path / "in" / "stream_id=a").mkdir(parents=True)
    (tmp_path / "in" / "stream_id=a" / "7.frame").write_bytes(b"\1\2")
    got = read_frames(spark, str(tmp_path / "in")).collect()
    assert [(r.stream_id, r.frame_no, bytes(r.chunk)) for r in got] == [("a", 7, b"\1\2")]
    q = stream_frames(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("frames").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("frames").count() == 1
    write_packets(read_frames(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    assert packets_table(spark, str(tmp_path / "out"), F.col("stream_id") == "a").count() == 1


def test_registered_queries_against_sql(spark):
    """Every query that has SQL gives the SQL's rows, on the smallest tables."""
    import os

    import duckdb

    from slicewise.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in os.listdir(sf):
        db.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    for name in ("wire_bytes", "plane_statistics", "slice_extents", "stride_repack", "stride_errors", "stream_parameters", "sql_roundtrip", "kraft_check", "config_errors", "residual_median", "inverse_gradient", "choose_predictor", "slice_partition", "canonical_order", "extradata_fields", "sample_geometry", "roundtrip_ulrg_median", "layout_identities", "malformed_taxonomy"):
        got, want = Q.QUERIES[name](spark, sf), db.execute(Q.ORACLES[name])
        cols = sorted(got.columns)
        order = [[d[0] for d in want.description].index(c) for c in cols]
        key = lambda rows: sorted(map(repr, rows))
        assert key(tuple(r[c] for c in cols) for r in got.collect()) == key(tuple(r[i] for i in order) for r in want.fetchall()), name


def test_entry_without_the_corpus_operators(tmp_path):
    """The entry module works where the llm folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "slicewise", tmp_path / "slicewise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') for k in q); print(len(q))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout) > 25, said.stderr
