"""Frame bodies as a Spark data source, to read, to write and to stream: format("frame_bodies").

A folder holds a directory for each stream, with files in directories of one write task each, and a log of what
has been committed, one file for each write that lists those directories. A write is seen whole or not at all: tasks write into new
directories, the driver adds one file to the log when all have ended, and removes the directories when the write is aborted;
what a failed task leaves is in no list. A stream reads the log's entries in order, its offset is their number. A folder without
a log is taken as it lies (batch reading only). Overwriting begins a new log, so streams of the folder are then to begin anew; a DataFrame
keeps to the entries that were there when it was first run.

A frame is a file <frame_no>.frame. With option("packed", True) a write task puts a stream's frames of an Arrow batch together into
packs, <first>_<last>_<frames>_<number>.frames, Arrow files of frame_no and chunk, so that files do not become as many as frames;
a frame_no that is written twice is two rows there. Both kinds are read, also beside each other.

Filters on stream_id and frame_no are pushed down: other streams' directories, other frames' files and packs of other frames only are
not opened, and of a pack the wanted frames are taken. A partition is some files of one stream, at most FILES of them, FRAMES
or BYTES, if it has more than one.

The folder is one that driver and executors can open by its path, a shared mount. Rows: stream_id, frame_no, pts (null unless
written as part of a name), chunk. A null stream_id, frame_no or chunk cannot be written and fails the task.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote, unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.schemas import few

NAME, SCHEMA = "frame_bodies", "stream_id string, frame_no bigint, pts bigint, chunk binary"
#: Most files, frames and bytes of a partition, the latter two of a pack as well.
FILES, FRAMES, BYTES = 256, 2048, 64 << 20
LOG, PART = "_log", "stream_id="
ONE, PACK = ".frame", ".frames"
#: All frame numbers.
LOW, HIGH = -(1 << 63), (1 << 63) - 1
FIELDS = pa.schema([("stream_id", pa.string()), ("frame_no", pa.int64()), ("pts", pa.int64()), ("chunk", pa.binary())])
FRAME = pa.schema([FIELDS.field("frame_no"), FIELDS.field("chunk")])


def folder_of(path: str) -> Path:
    """The folder behind a path or a file: URL."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{NAME} needs a folder that driver and executors can open, not {path}")
    return Path(unquote(url.path) if url.scheme else path)


def committed(folder: Path, start: int = 0, end: int | None = None) -> list[str]:
    """Directories of the log's entries from start to before end."""
    names = sorted(x.name for x in (folder / LOG).iterdir())[start:end] if (folder / LOG).is_dir() else []
    return [d for n in names for d in json.loads((folder / LOG / n).read_text())]


def lying(folder: Path) -> list[str]:
    """Directories with frames of a folder without a log."""
    return sorted({str(f.parent.relative_to(folder)) for kind in (ONE, PACK) for f in folder.glob(f"{PART}*/**/*{kind}")})


def extent(name: str) -> tuple[int, int, int] | None:
    """First and last frame of a file and their number; None for other files."""
    if name.endswith(ONE):
        return int(name[: -len(ONE)]), int(name[: -len(ONE)]), 1
    if name.endswith(PACK):
        first, last, n, _ = map(int, name[: -len(PACK)].split("_"))
        return first, last, n
    return None


@dataclass
class Files(InputPartition):
    """Files of a stream with their first frames; of packs the frames low to high."""

    stream: str
    paths: list[tuple[int, str]]
    low: int
    high: int

    def __init__(self, stream: str, paths: list[tuple[int, str]], low: int = LOW, high: int = HIGH):
        super().__init__(None)
        self.stream, self.paths, self.low, self.high = stream, paths, low, high


def planned(folder: Path, directories: list[str], streams: set[str] | None = None, low: int = LOW, high: int = HIGH) -> list[Files]:
    """Partitions of the frames low to high of some streams (all if None)."""
    of = defaultdict(list)
    for d in directories:
        of[unquote(d.split("/")[0].removeprefix(PART))].append(d)
    out = []
    for stream in of if streams is None else [s for s in of if s in streams]:
        paths, frames, size = [], 0, 0
        for d in of[stream]:
            with os.scandir(folder / d) as files:
                found = sorted((x, f.path, f) for f in files if (x := extent(f.name)))
            for (first, last, n), path, f in found:
                if low <= last and first <= high:
                    own = f.stat().st_size
                    if paths and (len(paths) == FILES or frames + n > FRAMES or size + own > BYTES):
                        out.append(Files(stream, paths, low, high))
                        paths, frames, size = [], 0, 0
                    paths.append((first, path))
                    frames, size = frames + n, size + own
        if paths:
            out.append(Files(stream, paths, low, high))
    return out


def bodies(partition: Files) -> Iterator[pa.RecordBatch]:
    def rows(numbers: pa.Array, chunks: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([partition.stream] * len(numbers), pa.string()), numbers, pa.nulls(len(numbers), pa.int64()), chunks], schema=FIELDS)

    single = [(n, p) for n, p in partition.paths if p.endswith(ONE)]
    for k in range(0, len(single), 16):
        some = single[k : k + 16]
        yield rows(pa.array([n for n, _ in some], pa.int64()), pa.array([Path(p).read_bytes() for _, p in some], pa.binary()))
    for path in (p for _, p in partition.paths if p.endswith(PACK)):
        first, last, _ = extent(os.path.basename(path))
        with pa.memory_map(path) as source:
            reader = pa.ipc.open_file(source)
            for batch in map(reader.get_batch, range(reader.num_record_batches)):
                if not partition.low <= first <= last <= partition.high:
                    numbers = batch["frame_no"].to_numpy()
                    batch = batch.take(pa.array(np.flatnonzero((numbers >= partition.low) & (numbers <= partition.high))))
                for some in few([batch]):
                    yield rows(some["frame_no"], some["chunk"])


class Reader(DataSourceReader):
    def __init__(self, folder: Path):
        self.folder, self.streams, self.low, self.high = folder, None, LOW, HIGH

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality and membership of stream_id, and comparisons of frame_no; gives back all others."""
        for f in filters:
            value = getattr(f, "value", None)
            if f.__class__ in (EqualTo, In) and f.attribute == ("stream_id",):
                own = {value} if isinstance(f, EqualTo) else set(value)
                self.streams = own if self.streams is None else self.streams & own
            elif getattr(f, "attribute", None) == ("frame_no",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Files]:
        found = committed(self.folder) if (self.folder / LOG).is_dir() else lying(self.folder)
        return planned(self.folder, found, self.streams, self.low, self.high) or [Files("", [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return bodies(partition)


class StreamReader(DataSourceStreamReader):
    """An offset is how many entries of the log have been read."""

    def __init__(self, folder: Path):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"entries": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        log = self.folder / LOG
        return {"entries": len(list(log.iterdir())) if log.is_dir() else 0}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return planned(self.folder, committed(self.folder, start["entries"], end["entries"])) or [Files("", [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return bodies(partition)

    def commit(self, end: dict) -> None:
        """Nothing to forget: the log stays."""


@dataclass
class Written(WriterCommitMessage):
    directories: list[str]


class Writer(DataSourceArrowWriter):
    """Writes bodies; overwrite makes the new write the only one that is seen."""

    def __init__(self, folder: Path, overwrite: bool, packed: bool = False):
        self.folder, self.overwrite, self.packed, self.id = folder, overwrite, packed, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        own, seen, packs = uuid.uuid4().hex, {}, 0
        for batch in iterator:
            if any(batch[c].null_count for c in ("stream_id", "frame_no", "chunk")):
                raise ValueError("a frame without stream_id, frame_no or chunk cannot be written")
            if not batch.num_rows:
                continue
            batch = batch.select(["stream_id", "frame_no", "chunk"]).sort_by([("stream_id", "ascending"), ("frame_no", "ascending")])
            codes = batch["stream_id"].dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                stream, frames = batch["stream_id"][a].as_py(), batch.select(["frame_no", "chunk"]).slice(a, b - a)
                if stream not in seen:
                    seen[stream] = f"{PART}{quote(stream, safe='')}/{self.id}-{own}"
                    (self.folder / seen[stream]).mkdir(parents=True)
                to = self.folder / seen[stream]
                if not self.packed:
                    for frame, chunk in zip(frames["frame_no"].to_pylist(), frames["chunk"].to_pylist(), strict=True):
                        (to / f"{frame}{ONE}").write_bytes(chunk)
                    continue
                for some in few([frames], FRAMES, BYTES):
                    numbers, packs = some["frame_no"], packs + 1
                    with pa.ipc.new_file(str(to / f"{numbers[0]}_{numbers[-1]}_{len(numbers)}_{packs}{PACK}"), FRAME) as out:
                        out.write_batch(pa.RecordBatch.from_arrays([numbers.cast(pa.int64()), some["chunk"].cast(pa.binary())], schema=FRAME))
        return Written(list(seen.values()))

    def commit(self, messages: list[Written | None]) -> None:
        log = self.folder / LOG
        log.mkdir(parents=True, exist_ok=True)
        old = sorted(x.name for x in log.iterdir())
        text = json.dumps([d for m in messages if m for d in m.directories])
        draft = self.folder / f"_{self.id}"
        draft.write_text(text)
        number = int(old[-1]) + 1 if old else 0
        while True:  # another write may have taken the number
            try:
                os.link(draft, log / f"{number:012d}")
                break
            except FileExistsError:
                number += 1
        draft.unlink()
        for name in old if self.overwrite else ():
            for d in json.loads((log / name).read_text()):
                shutil.rmtree(self.folder / d, ignore_errors=True)
            (log / name).unlink()

    def abort(self, messages: list[Written | None]) -> None:
        for d in self.folder.glob(f"{PART}*/{self.id}-*"):
            shutil.rmtree(d, ignore_errors=True)


class FrameBodies(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> Path:
        return folder_of(self.options["path"])

    def reader(self, schema) -> Reader:
        return Reader(self._folder())

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self._folder())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self._folder(), overwrite, str(self.options.get("packed", "false")).lower() == "true")


def register(spark: SparkSession) -> None:
    """Makes format("frame_bodies") known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameBodies)
