"""Encoding and decoding of frames as Spark jobs.

A frame is the unit of work: it is encoded or decoded where it lies, in one pass over Arrow batches, without a shuffle. For few
frames of very many samples there is a second grain (by_slice): frames -> planes -> slices (cut by expressions) -> residuals ->
the plane's histogram, code lengths and packed slices -> frames, and packets -> slices (from the payload's own table) -> samples
-> frames. Both give the same bytes. Errors are values beside the result, the one that comes first in plane and slice order,
and fail no task.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions import formats as S
from ..functions.schemas import few, plus
from . import kernels, together

KEY = ["stream_id", "frame_no"]
ERROR_ARROW = pa.struct([("variant", pa.string()), ("fields", pa.map_(pa.string(), pa.int64()))])


def with_predictor(frames: DataFrame) -> DataFrame:
    """frames whose null predictor_override (if they have the column) is chosen from plane 0."""
    from .entropy import chosen_predictors

    one = frames.drop("predictor").withColumn("_w", S.plane_width(F.col("fourcc"), F.lit(0), F.col("width"))).withColumn("_h", S.plane_height(F.col("fourcc"), F.lit(0), F.col("height"))).withColumn("_x", F.get("planes", F.lit(0)))
    out = chosen_predictors(one, "_w", "_h", "_x").drop("_w", "_h", "_x")
    return out.withColumn("predictor", F.coalesce("predictor_override", "predictor")) if "predictor_override" in frames.columns else out


def rgb_planes(fourcc: str, planes: list | None, inverse: bool) -> list | None:
    """planes with B and R taken against G, or back, in the RGB layouts; A stays."""
    if planes and len(planes) >= 3 and fourcc in ("ULRG", "ULRA") and None not in planes[:3] and len({len(p) for p in planes[:3]}) == 1:
        g, b, r = (np.frombuffer(p, np.uint8) for p in planes[:3])
        shift = np.uint8(kernels.FIRST)
        return [planes[0], *((x + g - shift if inverse else x - g + shift).tobytes() for x in (b, r)), *planes[3:]]
    return planes


def rgb(frames: DataFrame, inverse: bool) -> DataFrame:
    """frames with their planes put through `rgb_planes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            out = [rgb_planes(f, p, inverse) for f, p in zip(batch["fourcc"].to_pylist(), batch["planes"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary())) if c == "planes" else batch[c] for c in batch.schema.names], names=batch.schema.names)

    return frames.mapInArrow(run, frames.schema)


PARAMETERS = ["fourcc", "width", "height", "num_slices"]


def slices_of(frames: DataFrame) -> DataFrame:
    """One row for each slice of each plane; a frame with an error stays as one row without samples."""
    planes = frames.select(*KEY, *PARAMETERS, "predictor", "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("planes"))).alias("plane_idx", "plane"))
    planes = planes.withColumn("pw", S.plane_width(F.col("fourcc"), F.col("plane_idx"), F.col("width"))).withColumn("ph", S.plane_height(F.col("fourcc"), F.col("plane_idx"), F.col("height")))
    cut = planes.withColumn("slice_idx", F.explode(F.sequence(F.lit(0), F.when(F.col("error").isNull(), F.col("num_slices") - 1).otherwise(F.lit(0)))))
    start, end = S.row_start(F.col("ph"), F.col("slice_idx"), F.col("num_slices")), S.row_start(F.col("ph"), F.col("slice_idx") + 1, F.col("num_slices"))
    samples = F.when(F.col("plane").isNotNull(), F.substring("plane", start * F.col("pw") + 1, (end - start) * F.col("pw")))
    return cut.select(*KEY, *PARAMETERS, "predictor", "error", "plane_idx", "slice_idx", "pw", samples.alias("samples"))


def predicted(slices: DataFrame) -> DataFrame:
    """slices with residual in place of samples."""
    schema = plus(slices.schema, "residual binary", without=("samples", "pw"))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            res = [None if x is None else kernels.residuals(p, np.frombuffer(x, np.uint8), w).tobytes() for p, x, w in zip(*(batch[c].to_pylist() for c in ("predictor", "samples", "pw")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(res, pa.binary()) if c == "residual" else batch[c] for c in names], names=names)

    return slices.mapInArrow(run, schema)


def plane_blob(residuals: list[np.ndarray]) -> bytes:
    """A plane's bytes: descriptor of the code that suits all its slices, their end offsets, their bits."""
    d = kernels.code_lengths(np.bincount(np.concatenate(residuals), minlength=256))
    data = list(map(kernels.packer(d), residuals))
    return b"".join([d.tobytes(), np.cumsum([len(x) for x in data]).astype("<u4").tobytes(), *data])


def plane_blobs(planes: list[list[bytes]]) -> list[bytes]:
    """`plane_blob` of each; small planes are packed together."""
    size = [sum(map(len, x)) for x in planes]
    own = [n <= together.SMALL and all(map(len, x)) for n, x in zip(size, planes, strict=True)]
    out = [None if few_ else plane_blob([np.frombuffer(r, np.uint8) for r in x]) for few_, x in zip(own, planes, strict=True)]
    small = [k for k, few_ in enumerate(own) if few_]
    for some in together.groups([size[k] for k in small]) if small else ():
        slices = [(p, r) for p, i in enumerate(some) for r in planes[small[i]]]
        made = together.blobs(np.frombuffer(b"".join(r for _, r in slices), np.uint8), np.array([len(r) for _, r in slices]), np.array([p for p, _ in slices]), len(some))
        for i, x in zip(some, made, strict=True):
            out[small[i]] = x
    return out


def packed(planes: DataFrame) -> DataFrame:
    """planes with blob in place of their slices."""
    schema = plus(planes.schema, "blob binary", without=("slices",))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            blobs = plane_blobs([[s["residual"] or b"" for s in slices] for slices in batch["slices"].to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()) if c == "blob" else batch[c] for c in names], names=names)

    return planes.mapInArrow(run, schema)


def assembled(planes: DataFrame) -> DataFrame:
    """Frames from their planes' bytes: a frame ends with its predictor."""
    head = [*KEY, *PARAMETERS, "predictor"]
    frame = planes.groupBy(*head).agg(F.first("error").alias("error"), F.sort_array(F.collect_list(F.struct("plane_idx", "blob"))).alias("p"))  # four planes at most
    blobs = [F.coalesce(F.get("p", F.lit(k))["blob"], F.lit(b"")) for k in range(4)]
    chunk = F.concat(*blobs, S.dword(S.frame_info_of(F.col("predictor"))))
    return frame.select(*KEY, *PARAMETERS, F.when(F.col("error").isNull(), chunk).alias("chunk"), "error")


def encode(frames: DataFrame, by_slice: bool = False) -> DataFrame:
    """(stream_id, frame_no, the stream's parameters, chunk, error) from frames(stream_id, frame_no, fourcc, width, height, predictor 0..3, num_slices, planes ARRAY<BINARY>).

    by_slice deals out slices instead of frames, with two shuffles: residuals meet by plane, packed planes by frame.
    """
    checked = frames.select(*KEY, *PARAMETERS, "predictor", "planes").withColumn("error", S.input_error(*(F.col(c) for c in ("fourcc", "width", "height", "num_slices", "planes"))))
    if by_slice:
        cut = predicted(slices_of(rgb(checked, inverse=False)))
        one = F.sort_array(F.collect_list(F.struct("slice_idx", "residual")))  # 256 slices at most
        planes = cut.groupBy(*KEY, *PARAMETERS, "predictor", "plane_idx").agg(F.first("error").alias("error"), one.alias("slices"))
        return assembled(packed(planes))
    schema = plus(checked.select(*KEY, *PARAMETERS).schema, f"chunk binary, error {E.ERROR}")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            rows = zip(*(batch[c].to_pylist() for c in ("fourcc", "width", "height", "predictor", "num_slices", "planes")), batch["error"].is_null().to_pylist(), strict=True)
            rows = list(rows)
            made = iter(encode_many([row for *row, good in rows if good]))
            chunks = [next(made) if good else None for *_, good in rows]
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()) if c == "chunk" else batch[c] for c in names], names=names)

    return checked.mapInArrow(run, schema)


def statistics(descriptor: np.ndarray) -> dict:
    """How many symbols have a code of each length, and what follows from that; min and max are null without a code."""
    n = np.bincount(descriptor, minlength=256).tolist()
    tiers = [(k, n[k]) for k in range(1, 255) if n[k]]
    return {
        "zero_count": n[0], "absent_count": n[255], "active_symbol_count": sum(c for _, c in tiers), "min_code_length": tiers[0][0] if tiers else None, "max_code_length": tiers[-1][0] if tiers else None,
        "min_code_length_symbol_count": tiers[0][1] if tiers else 0, "code_length_histogram": [{"code_length": k, "count": c} for k, c in tiers],
    }


def walk(chunk: bytes, fourcc: str, width: int, height: int, num_slices: int, codes: bool = True) -> tuple[list[dict], int]:
    """(planes with their slices' byte ranges, frame_info) of a payload; raises what it fails by first. codes: codebooks are checked too."""
    if len(chunk) < 4:
        raise CodecErrorOf("MissingFrameInfo")
    stop, at, planes = len(chunk) - 4, 0, []
    _, shift, _ = S.LAYOUTS[fourcc]

    def need(n: int) -> None:
        if at + n > stop:
            raise CodecErrorOf("ChunkTooShort", offset=at, needed=n, have=max(0, stop - at))

    for p in range(len(S.LAYOUTS[fourcc][0])):
        pw, ph = (width >> shift[0], height >> shift[1]) if p in (1, 2) else (width, height)
        begin = at
        need(256)
        descriptor = np.frombuffer(chunk, np.uint8, 256, at)
        at += 256
        need(4 * num_slices)
        ends = np.frombuffer(chunk, "<u4", num_slices, at).astype(np.int64)
        at += 4 * num_slices
        for before, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if end < before:
                raise CodecErrorOf("NonMonotonicSliceOffsets")
            if end % 4:
                raise CodecErrorOf("SliceNotWordAligned", offset=end)
        need(int(ends[-1]))
        if codes:
            kernels.codebook(descriptor)
        rows = [ph * s // num_slices for s in range(num_slices + 1)]
        slices = [{"slice_idx": s, "start": at + int(a), "end": at + int(b), "row_start": rows[s], "row_end": rows[s + 1]} for s, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]
        planes.append({"plane_idx": p, "label": S.LAYOUTS[fourcc][0][p], "width": pw, "height": ph, "offset": begin, "end_offsets_start": begin + 256, "slice_data_start": at, "descriptor": descriptor.tobytes(), "slices": slices, **statistics(descriptor)})
        at += int(ends[-1])
    if at != stop:
        raise CodecErrorOf("ChunkTooShort", offset=at, needed=stop - at, have=0)
    return planes, int.from_bytes(chunk[stop:], "little")


CodecErrorOf = kernels.CodecError
SLICE = "struct<slice_idx:int,start:bigint,end:bigint,row_start:int,row_end:int>"
STATISTICS = "zero_count:int,absent_count:int,active_symbol_count:int,min_code_length:int,max_code_length:int,min_code_length_symbol_count:int,code_length_histogram:array<struct<code_length:int,count:int>>"
PLANE = f"struct<plane_idx:int,label:string,width:int,height:int,offset:bigint,end_offsets_start:bigint,slice_data_start:bigint,descriptor:binary,slices:array<{SLICE}>,{STATISTICS}>"


def parsed(packets: DataFrame, codes: bool = True) -> DataFrame:
    """packets with layout ARRAY<plane>, frame_info and error; packets carry their stream's fourcc, width, height and num_slices."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = plus(packets.schema, f"layout array<{PLANE}>, frame_info bigint, error {E.ERROR}")
    kind = to_arrow_schema(schema).field("layout").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            layout, info, errors = [], [], []
            for row in zip(*(batch[c].to_pylist() for c in ("chunk", "fourcc", "width", "height", "num_slices")), strict=True):
                try:
                    if row[0] is None or row[1] not in S.LAYOUTS or None in row:
                        raise kernels.CodecError("InvalidInput")
                    planes, word = walk(*row, codes)
                    errors.append(None)
                except kernels.CodecError as e:
                    planes, word = None, None
                    errors.append(e.row())
                layout.append(planes)
                info.append(word)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(layout, kind), pa.array(info, pa.int64()), pa.array(errors, ERROR_ARROW)], names=[*batch.schema.names, "layout", "frame_info", "error"])

    return packets.mapInArrow(run, schema)


def encode_one(fourcc: str, width: int, height: int, predictor: int, num_slices: int, planes: list[bytes]) -> bytes:
    """The payload of one frame whose input is known to be good."""
    _, shift, _ = S.LAYOUTS[fourcc]
    out = []
    for p, plane in enumerate(rgb_planes(fourcc, list(planes), inverse=False)):
        pw, ph = (width >> shift[0], height >> shift[1]) if p in (1, 2) else (width, height)
        rows = [ph * s // num_slices * pw for s in range(num_slices + 1)]
        x = np.frombuffer(plane, np.uint8)
        out.append(plane_blob([kernels.residuals(predictor, x[a:b], pw) for a, b in zip(rows, rows[1:], strict=False)]))
    return b"".join([*out, (predictor << 8).to_bytes(4, "little")])


def samples_in(fourcc: str, width: int, height: int) -> list[tuple[int, int]]:
    """(width, height) of a frame's planes."""
    labels, shift, _ = S.LAYOUTS[fourcc]
    return [(width >> shift[0], height >> shift[1]) if p in (1, 2) else (width, height) for p in range(len(labels))]


def encode_many(frames: list[tuple]) -> list[bytes]:
    """`encode_one` of each; small frames are encoded together."""
    size = [sum(map(len, f[5])) for f in frames]
    out = [encode_one(*f) if n > together.SMALL else None for f, n in zip(frames, size, strict=True)]
    small = [k for k, x in enumerate(out) if x is None]
    for some in together.groups([size[k] for k in small]) if small else ():
        slices, sizes, plane, planes, alike = [], [], [], 0, defaultdict(list)
        for k in (small[i] for i in some):
            fourcc, width, height, predictor, n, given = frames[k]
            for (pw, ph), x in zip(samples_in(fourcc, width, height), rgb_planes(fourcc, list(given), inverse=False), strict=True):
                rows = [ph * s // n * pw for s in range(n + 1)]
                for a, b in zip(rows, rows[1:], strict=False):
                    alike[predictor, pw].append(len(slices))
                    slices.append(x[a:b])
                    sizes.append(b - a)
                plane += [planes] * n
                planes += 1
        sizes = np.array(sizes)
        begins = np.cumsum(sizes) - sizes
        res = np.frombuffer(b"".join(slices), np.uint8).copy()
        for (predictor, pw), own in alike.items():
            if predictor:
                n = sizes[own]
                at = np.arange(n.sum()) + np.repeat(begins[own] - (np.cumsum(n) - n), n)
                res[at] = together.residuals(predictor, res[at], pw, np.cumsum(n) - n)
        made = iter(together.blobs(res, sizes, np.array(plane), planes))
        for k in (small[i] for i in some):
            out[k] = b"".join([*(next(made) for _ in S.LAYOUTS[frames[k][0]][0]), (frames[k][3] << 8).to_bytes(4, "little")])
    return out


def cut_up(chunk: bytes | None, fourcc: str | None, width: int | None, height: int | None, num_slices: int | None) -> list[tuple[bytes, list[bytes]]] | None:
    """Each plane's descriptor and its slices' bytes, or None for what `walk` may refuse."""
    if None in (chunk, fourcc, width, height, num_slices) or fourcc not in S.LAYOUTS or len(chunk) < 4 or not 1 <= num_slices <= 256:
        return None
    planes = samples_in(fourcc, width, height)
    if min(h for _, h in planes) < num_slices or min(w for w, _ in planes) < 1 or sum(w * h for w, h in planes) > together.SMALL:
        return None
    at, stop, out = 0, len(chunk) - 4, []
    for _ in planes:
        data = at + 256 + 4 * num_slices
        if data > stop:
            return None
        ends = [0, *struct.unpack_from(f"<{num_slices}I", chunk, at + 256)]
        if any(b < a or b % 4 for a, b in zip(ends, ends[1:], strict=False)) or data + ends[-1] > stop:
            return None
        out.append((chunk[at : at + 256], [chunk[data + a : data + b] for a, b in zip(ends, ends[1:], strict=False)]))
        at = data + ends[-1]
    return out if at == stop else None


def decode_many(packets: list[tuple], strict: bool = False) -> list[dict]:
    """`decode_one` of each; small frames are decoded together, but for those that have anything wrong."""
    cut = [cut_up(*x) for x in packets]
    out: list[dict | None] = [None] * len(packets)
    small = [k for k, x in enumerate(cut) if x is not None]
    for some in together.groups([packets[k][2] * packets[k][3] * len(cut[k]) for k in small]) if small else ():
        data, sizes, plane, descriptors, places, alike = [], [], [], [], [], defaultdict(list)
        for k in (small[i] for i in some):
            chunk, fourcc, width, height, n = packets[k]
            info = int.from_bytes(chunk[-4:], "little")
            places.append((k, info, len(data)))
            for (pw, ph), (d, slices) in zip(samples_in(fourcc, width, height), cut[k], strict=True):
                rows = [ph * s // n * pw for s in range(n + 1)]
                for a, b, x in zip(rows, rows[1:], slices, strict=False):
                    alike[info >> 8 & 3, pw, b - a].append(len(data))
                    data.append(x)
                    sizes.append(b - a)
                plane += [len(descriptors)] * n
                descriptors.append(d)
        sizes = np.array(sizes)
        begins = np.cumsum(sizes) - sizes
        v, good = together.read(data, sizes, np.array(plane), np.frombuffer(b"".join(descriptors), np.uint8).reshape(-1, 256), strict)
        for (predictor, pw, n), own in alike.items():
            if predictor:
                at = begins[own][:, None] + np.arange(n)
                v[at] = kernels.restored(predictor, v[at], pw)
        for k, info, s in places:
            _, fourcc, width, height, n = packets[k]
            dims = samples_in(fourcc, width, height)
            if good[s : s + n * len(dims)].all():
                at = np.cumsum([begins[s], *(w * h for w, h in dims)]).tolist()
                planes = [v[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
                out[k] = {"planes": rgb_planes(fourcc, planes, inverse=True), "predictor": info >> 8 & 3, "frame_info": info, "error": None}
    return [decode_one(*x, strict) if o is None else o for x, o in zip(packets, out, strict=True)]


def decode_one(chunk: bytes | None, fourcc: str | None, width: int | None, height: int | None, num_slices: int | None, strict: bool = False) -> dict:
    """planes, predictor, frame_info and error (the first, or None) of one payload."""
    out = {"planes": None, "predictor": None, "frame_info": None, "error": None}
    try:
        if None in (chunk, fourcc, width, height, num_slices) or fourcc not in S.LAYOUTS:
            raise kernels.CodecError("InvalidInput")
        layout, info = walk(chunk, fourcc, width, height, num_slices)
        out |= {"frame_info": info, "predictor": info >> 8 & 3}
        planes = []
        for p in layout:
            read, parts, rows = kernels.unpacker(np.frombuffer(p["descriptor"], np.uint8)), [], []
            for s in p["slices"]:
                n, data = (s["row_end"] - s["row_start"]) * p["width"], chunk[s["start"] : s["end"]]
                res, used = read(data, n) if n else (np.empty(0, np.uint8), 0)
                if strict and n and (bit := kernels.padding_bit(data, used)) is not None:
                    raise kernels.CodecError("NonZeroPadding", plane=p["plane_idx"], slice=s["slice_idx"], bit_position=bit)
                rows.append(res)
            for n in dict.fromkeys(map(len, rows)):  # slices of one shape go through the inverse together
                parts.append((n, iter(kernels.restored(out["predictor"], np.stack([r for r in rows if len(r) == n]), p["width"]))))
            of = dict(parts)
            planes.append(b"".join(next(of[len(r)]).tobytes() for r in rows))
        out["planes"] = rgb_planes(fourcc, planes, inverse=True)
    except kernels.CodecError as e:
        out["error"] = e.row()
    return out


def configured(packets: DataFrame, config: DataFrame | None) -> DataFrame:
    """packets joined to their stream's parameters (fourcc, width, height, num_slices); without config they carry them."""
    if config is None:
        return packets
    return packets.drop(*PARAMETERS).join(config.select("stream_id", "fourcc", "width", "height", "num_slices"), "stream_id", "left")


def read_many(slices: list[tuple[bytes, bytes, int] | None], strict: bool) -> list[np.ndarray | None]:
    """Residuals of slices (bytes, descriptor, samples) that are read together; None for those that have anything wrong."""
    out: list[np.ndarray | None] = [None] * len(slices)
    own = [k for k, x in enumerate(slices) if x is not None]
    for some in together.groups([slices[k][2] for k in own]) if own else ():
        of: dict[bytes, int] = {}
        plane = np.array([of.setdefault(slices[own[i]][1], len(of)) for i in some])
        sizes = np.array([slices[own[i]][2] for i in some])
        res, good = together.read([slices[own[i]][0] for i in some], sizes, plane, np.frombuffer(b"".join(of), np.uint8).reshape(-1, 256), strict)
        for i, x, g in zip(some, np.split(res, np.cumsum(sizes)[:-1]), good.tolist(), strict=True):
            out[own[i]] = x if g else None
    return out


def decoded_slices(slices: DataFrame, strict: bool) -> DataFrame:
    """slices with samples or error. Slices of one shape in a batch go through the median's inverse together."""
    schema = plus(slices.schema, f"samples binary, error {E.ERROR}", without=("bytes", "descriptor", "pw", "rows"))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            samples: list[bytes | None] = [None] * batch.num_rows
            errors: list[dict | None] = [None] * batch.num_rows
            alike: dict[tuple, list] = defaultdict(list)
            codes: dict[bytes, object] = {}  # slices of a plane share their code
            rows_ = list(zip(*(batch[c].to_pylist() for c in ("bytes", "descriptor", "rows", "pw", "predictor", "plane_idx", "slice_idx")), strict=True))
            done = read_many([(data, d, rows * width) if data is not None and 0 < rows * width <= together.SMALL else None for data, d, rows, width, *_ in rows_], strict)
            for k, (data, d, rows, width, p, plane, s) in enumerate(rows_):
                if data is None:
                    continue
                if done[k] is not None:
                    alike[p, width, rows * width].append((k, done[k]))
                    continue
                try:
                    n = rows * width
                    if d not in codes:
                        codes[d] = kernels.unpacker(np.frombuffer(d, np.uint8))
                    res, used = codes[d](data, n) if n else (np.empty(0, np.uint8), 0)
                    if strict and n and (bit := kernels.padding_bit(data, used)) is not None:
                        raise kernels.CodecError("NonZeroPadding", plane=plane, slice=s, bit_position=bit)
                    alike[p, width, n].append((k, res))
                except kernels.CodecError as e:
                    errors[k] = e.row()
            for (p, width, _), some in alike.items():
                for (k, _), x in zip(some, kernels.restored(p, np.stack([r for _, r in some]), width), strict=True):
                    samples[k] = x.tobytes()
            made = {"samples": pa.array(samples, pa.binary()), "error": pa.array(errors, ERROR_ARROW)}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch[c] for c in names], names=names)

    return slices.mapInArrow(run, schema)


def decode(packets: DataFrame, config: DataFrame | None = None, strict: bool = False, by_slice: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(stream_id, frame_no, pts, fourcc, width, height, predictor, frame_info, planes, error) from packets(stream_id, frame_no, pts, chunk).

    config has a stream's fourcc, width, height and num_slices, unless packets carry them. strict: bits after a slice's last
    code must be zero. A packet whose stream has no parameters gets an InvalidInput error. by_slice deals out slices instead of
    frames, with one shuffle: samples meet by frame. keep: further columns of packets that frames have too, not with by_slice.
    """
    ready = configured(packets, config).select(*KEY, "pts", *PARAMETERS, "chunk", *keep)
    return _by_slice(ready, strict) if by_slice else _by_frame(ready, strict, keep)


def _by_frame(packets: DataFrame, strict: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    schema = plus(packets.select(*KEY, "pts", "fourcc", "width", "height", *keep).schema, f"predictor int, frame_info bigint, planes array<binary>, error {E.ERROR}")
    kinds = {"predictor": pa.int32(), "frame_info": pa.int64(), "planes": pa.list_(pa.binary()), "error": ERROR_ARROW}
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            out = decode_many(list(zip(*(batch[c].to_pylist() for c in ("chunk", *PARAMETERS)), strict=True)), strict)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kinds[c]) if c in kinds else batch[c] for c in names], names=names)

    return packets.mapInArrow(run, schema)


def _by_slice(packets: DataFrame, strict: bool) -> DataFrame:
    read = parsed(packets).withColumnRenamed("error", "broken")
    head = [*KEY, "pts", "fourcc", "width", "height", "frame_info"]
    planes = read.select(*head, "chunk", "broken", F.explode_outer("layout").alias("p"))
    slices = planes.select(*head, "chunk", "broken", "p.plane_idx", F.col("p.width").alias("pw"), "p.descriptor", F.explode_outer("p.slices").alias("s"))
    data = F.substring("chunk", F.col("s.start").cast("int") + 1, (F.col("s.end") - F.col("s.start")).cast("int"))
    slices = slices.select(*head, "broken", "plane_idx", "pw", "descriptor", "s.slice_idx", (F.col("s.row_end") - F.col("s.row_start")).alias("rows"), S.predictor_of(F.col("frame_info")).alias("predictor"), data.alias("bytes"))
    done = decoded_slices(slices, strict)
    first = F.coalesce(F.first("broken"), F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("plane_idx", "slice_idx"))))
    samples = F.sort_array(F.collect_list(F.struct("plane_idx", "slice_idx", "samples")))  # 1024 slices at most
    frames = done.groupBy(*head, "predictor").agg(first.alias("error"), samples.alias("s"))
    out = put_together(frames)
    return out.select("stream_id", "frame_no", "pts", "fourcc", "width", "height", "predictor", "frame_info", "planes", "error")


def put_together(frames: DataFrame) -> DataFrame:
    """frames with planes in place of s, their slices' samples in order; no planes beside an error."""
    schema = plus(frames.schema, "planes array<binary>", without=("s",))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            out = []
            for fourcc, slices, error in zip(*(batch[c].to_pylist() for c in ("fourcc", "s", "error")), strict=True):
                if error is not None or fourcc not in S.LAYOUTS:
                    out.append(None)
                    continue
                parts: list[list[bytes]] = [[] for _ in S.LAYOUTS[fourcc][0]]
                for x in slices:
                    parts[x["plane_idx"]].append(x["samples"])
                out.append(rgb_planes(fourcc, [b"".join(x) for x in parts], inverse=True))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary())) if c == "planes" else batch[c] for c in names], names=names)

    return frames.mapInArrow(run, schema)
