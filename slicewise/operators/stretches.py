"""Entropy decoding of one slice in many tasks.

Codes are read one after the other, so where a code starts depends on all before it; but a stretch of bits can be entered at few
places only, fewer than its longest code has bits. So each stretch is decoded from all of them at once, into a table of where the
next stretch is then entered and how many symbols lie between; paths that meet go on as one, which prefix codes do within
a few symbols. The tables of a slice are composed by a prefix scan (within groups of stretches, over the groups, and within groups again),
which gives each stretch its entry and the number of symbols before it; then every stretch emits its symbols by itself.

No task takes more of a slice than a stretch, and what a slice gathers is two short arrays for each stretch. Slices are rows with any
key columns, descriptor, bytes (32-bit little-endian words) and pixels, the number of symbols that are to come.

Defined cases: a slice without pixels gives no rows; one with a single symbol has no bits and is laid out by stretches of STRETCH
symbols; without any code, or where the bits run out first, `errors` says so and the rows end with the symbols that are there;
what is left after the last symbol is not looked at; a descriptor that is no code has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions.schemas import plus
from . import kernels
from .layout import lengths_of

#: Bytes of a stretch (a multiple of 4), bytes that are looked at beyond it, and stretches of a group.
STRETCH, AHEAD, GROUP = 1 << 16, 8, 64
#: A code has at most so many bits, so a stretch has so many places where it may be entered.
LONGEST = 32


def stretches_of(slices: DataFrame, size: int = STRETCH) -> DataFrame:
    """slices with k, own (bits of the stretch), last and data in place of bytes: a row for each stretch, with bytes ahead of it."""
    long = F.octet_length("bytes")
    single = F.col("only").isNotNull()
    number = F.when(single, F.ceil(F.col("pixels") / size)).otherwise(F.greatest(F.lit(1), F.ceil(long / size))).cast("int")
    cut = slices.where(F.col("pixels") > 0).withColumn("only", only_symbol(F.col("descriptor"))).withColumn("_n", number)
    cut = cut.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = F.col("k") * size
    data = F.when(single, F.lit(b"")).otherwise(F.substring("bytes", (at + 1).cast("int"), F.lit(size + AHEAD)))
    own = F.when(single, F.lit(0)).otherwise(8 * F.least(F.lit(size), long - at)).cast("int")
    return cut.withColumns({"own": own, "last": F.col("k") == F.col("_n") - 1, "data": data, "size": F.lit(size)}).drop("bytes", "_n")


def only_symbol(descriptor: Column) -> Column:
    """The symbol of length 0, if there is no other."""
    used = F.filter(F.transform(lengths_of(descriptor), lambda n, k: F.struct(n.alias("n"), k.alias("sym"))), lambda x: x["n"] != kernels.UNUSED)
    return F.when((F.size(used) == 1) & (F.get(used, F.lit(0))["n"] == 0), F.get(used, F.lit(0))["sym"])


class Codes:
    """Readers by descriptor, as the stretches of a plane share theirs."""

    def __init__(self) -> None:
        self.of: dict[bytes, tuple | None] = {}

    def get(self, descriptor: bytes) -> tuple | None:
        if descriptor not in self.of:
            if len(self.of) > 1000:
                self.of.clear()
            try:
                self.of[descriptor] = kernels.reader(np.frombuffer(descriptor, np.uint8))
            except kernels.CodecError:
                self.of[descriptor] = None
        return self.of[descriptor]


def opened(read, data: bytes, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length of the code at each of a stretch's own bits."""
    symbol, step = read(kernels.big_endian(data + b"\0" * (-len(data) % 4)))
    return symbol[:own], step[:own]


def jumps(step: bytes, own: int, entries: int, last: bool) -> tuple[list[int], list[int]]:
    """For each entry bit: where the walk leaves (from the stretch's end, or of the last stretch where it stops, from its beginning),
    and how many whole codes it passes."""
    rank = np.full(own, -1, np.int64)
    exits, counts, ends, steps = [], [], own, 0
    for entry in range(entries):
        here, path, met = entry, [], -1
        while here < own and (met := int(rank[here])) < 0:
            after = here + step[here]
            if last and after > own:
                break
            path.append(here)
            here = after
        if entry == 0:
            rank[path] = np.arange(len(path))
            ends, steps, met = here, len(path), -1
        if met >= 0 and here < own:  # goes on as the first path does
            exits.append(ends)
            counts.append(len(path) + steps - met)
        else:
            exits.append(here)
            counts.append(len(path))
    return [e - (0 if last else own) for e in exits], counts


def tables(stretches: DataFrame, key: list[str]) -> DataFrame:
    """(key, k, last, exits, counts): the jump table of each stretch."""
    schema = plus(stretches.select(*key, "k", "last").schema, "exits array<int>, counts array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            exits, counts = [], []
            for d, data, own, last, only, size, pixels, k in zip(*(batch[c].to_pylist() for c in ("descriptor", "data", "own", "last", "only", "size", "pixels", "k")), strict=True):
                code = codes.get(d)
                if only is not None:
                    x, n = [0], [min(size, pixels - k * size)]
                elif code is None or not code[1]:
                    x, n = [0], [0]
                else:
                    x, n = jumps(opened(code[2], data, own)[1].tobytes(), own, code[1] if k else 1, last)
                exits.append(x)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*key, "k", "last")), pa.array(exits, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=[f.name for f in schema])

    return stretches.mapInArrow(run, schema)


def _walked(tables: Column, start: Column) -> Column:
    """The state (at, n) before each table and after the last, from a start: an array of one more than there are tables."""

    def step(acc: Column, t: Column) -> Column:
        now = F.element_at(acc, -1)
        after = F.struct(F.get(t["exits"], now["at"]).alias("at"), (now["n"] + F.get(t["counts"], now["at"])).alias("n"))
        return F.concat(acc, F.array(after))

    return F.aggregate(tables, F.array(start), step)


def entries(tables: DataFrame, key: list[str]) -> DataFrame:
    """(key, k, entry, before): where each stretch is entered and how many symbols lie before it, by a prefix scan over its slice."""
    state = lambda at, n: F.struct(at.cast("int").alias("at"), n.cast("bigint").alias("n"))
    groups = tables.groupBy(*key, F.floor(F.col("k") / GROUP).cast("int").alias("g")).agg(F.array_sort(F.collect_list(F.struct("k", "exits", "counts"))).alias("t"))  # GROUP tables
    open_ = F.size(F.get("t", F.lit(0))["exits"])
    through = lambda e: F.aggregate("t", state(e, F.lit(0)), lambda s, t: state(F.get(t["exits"], s["at"]), s["n"] + F.get(t["counts"], s["at"])))
    whole = groups.withColumn("w", F.transform(F.sequence(F.lit(0), open_ - 1), through))
    one = F.struct("g", F.transform("w", lambda s: s["at"]).alias("exits"), F.transform("w", lambda s: s["n"]).alias("counts"))
    scan = whole.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("groups"))  # one short table for GROUP stretches
    begins = scan.select(*key, F.posexplode(F.slice(_walked(F.col("groups"), state(F.lit(0), F.lit(0))), F.lit(1), F.size("groups"))).alias("g", "s"))
    within = groups.join(begins, [*key, "g"]).select(*key, F.col("t"), F.explode(F.arrays_zip(F.col("t.k").alias("k"), F.slice(_walked(F.col("t"), F.col("s")), F.lit(1), F.size("t")).alias("s"))).alias("x"))
    return within.select(*key, F.col("x.k").alias("k"), F.col("x.s.at").alias("entry"), F.col("x.s.n").alias("before"))


def decoded(slices: DataFrame, key: list[str], size: int = STRETCH) -> DataFrame:
    """(key, k, first, symbols): the symbols of each stretch and the number of the first of them in the slice."""
    cut = stretches_of(slices, size)
    return emitted(cut, entries(tables(cut, key), key), key)


def emitted(stretches: DataFrame, entries: DataFrame, key: list[str]) -> DataFrame:
    schema = plus(stretches.select(*key, "k").schema, "first bigint, symbols binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            out = []
            for d, data, own, last, only, size, pixels, entry, before in zip(*(batch[c].to_pylist() for c in ("descriptor", "data", "own", "last", "only", "size", "pixels", "entry", "before")), strict=True):
                want, code = max(0, pixels - before), codes.get(d)
                if only is not None:
                    out.append(bytes([only]) * min(size, want))
                    continue
                places = []
                if code is not None and code[1] and want:
                    symbol, step = opened(code[2], data, own)
                    steps, here = step.tobytes(), entry
                    while here < own and not (last and here + steps[here] > own):
                        places.append(here)
                        here += steps[here]
                out.append(symbol[np.array(places[:want], np.int64)].tobytes() if places else b"")
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*key, "k")), batch["before"], pa.array(out, pa.binary())], names=[f.name for f in schema])

    return stretches.join(entries, [*key, "k"]).mapInArrow(run, schema).where(F.octet_length("symbols") > 0)


def errors(slices: DataFrame, key: list[str], size: int = STRETCH) -> DataFrame:
    """(key, error): what keeps a slice from being decoded, null for the others."""
    cut = stretches_of(slices, size)
    known = tables(cut, key)
    last = known.where("last").join(entries(known, key), [*key, "k"])
    ends = last.select(*key, (F.col("before") + F.get("counts", F.col("entry"))).alias("have"), (F.col("k").cast("bigint") * 8 * size + F.get("exits", F.col("entry"))).alias("at"))
    some = F.exists(lengths_of(F.col("descriptor")), lambda n: n != kernels.UNUSED)
    error = E.first_of(
        (~some, E.error("HuffmanDecodeFailure", bit_position=F.lit(0))),
        (F.col("have") < F.col("pixels"), E.error("SliceTruncated", bit_position=F.col("at"), expected_pixels=F.col("pixels"), decoded=F.col("have"))),
    )
    return slices.where(F.col("pixels") > 0).join(ends, key).select(*key, error.alias("error"))


def symbol_rows(decoded: DataFrame, key: list[str]) -> DataFrame:
    """(key, i, symbol) from (key, first, symbols)."""
    schema = plus(decoded.select(*key).schema, "i bigint, symbol int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = np.frombuffer(batch["symbols"][row].as_py(), np.uint8)
                own = [pa.array([batch[c][row].as_py()] * len(x), batch.schema.field(c).type) for c in key]
                yield pa.RecordBatch.from_arrays([*own, pa.array(batch["first"][row].as_py() + np.arange(len(x))), pa.array(x.astype(np.int32))], names=[*key, "i", "symbol"])

    return decoded.select(*key, "first", "symbols").mapInArrow(run, schema)
