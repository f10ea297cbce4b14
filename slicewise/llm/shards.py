"""Sharding by a minimax contiguous partition, with DataFrame functions only.

Rows of equal text are one atomic group. Groups stand in one fixed order (by their text's digest) and shards are runs of that
order. The largest shard is as small as it can be: the least capacity is searched for, each candidate checked greedily (fill
a shard until the next group does not fit), and the greedy cuts at the least feasible capacity are the shards.

At scale: the order's running sums come from windows over digest ranges plus the ranges' totals; there are as many ranges as
`ROWS_PER_RANGE` asks for. A greedy step asks for the last running sum below a point; as two neighbours differ by no more than the largest
group, only sums within that distance are read. `WAYS` capacities are tried in each pass, so that a search over any size needs
a few passes. Only those answers reach the driver. Slots are numbered by (group, salt): a group of copies is dealt over salts.

Defined cases: null text has size 1 and stands with empty texts; rows that repeat get slots of their own; an empty table gives
no rows; fewer groups than shards leave the last shards empty; texts of any length count whole; rows of one text and doc_id take slots in
any order; only doc_id and text are read of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Capacities tried in one pass.
WAYS = 32
#: Rows of a (group, salt) aimed at.
ROWS_PER_SALT = 50_000
#: Rows of a range of digests aimed at.
ROWS_PER_RANGE = 500_000


def least_capacity(groups: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """(capacity, last running sums of all shards but the last) over groups(bytes, end), end being the running sum in order."""
    total, largest = groups.agg(F.max("end"), F.max("bytes")).first()
    if total is None:
        return 0, []

    def reached(points: list[int]) -> list[int]:
        """For each point, the largest running sum that is not above it, 0 if there is none."""
        near = groups.where((F.col("end") > min(points) - largest) & (F.col("end") <= max(points)))
        return [x or 0 for x in near.agg(*(F.max(F.when(F.col("end") <= p, F.col("end"))).alias(f"p{i}") for i, p in enumerate(points))).first()]

    def cuts(capacities: list[int]) -> list[list[int]]:
        steps = [[0] * len(capacities)]
        for _ in range(n_shards):
            steps.append(reached([min(total, at + c) for at, c in zip(steps[-1], capacities, strict=True)]))
            if min(steps[-1]) >= total:
                break
        return [list(x[1:]) for x in zip(*steps, strict=True)]

    low, high = max(largest, -(-total // n_shards)), -(-total // n_shards) + largest  # high is feasible: each full shard holds more than its share
    while low < high:
        tried = sorted({low + (high - low) * k // WAYS for k in range(WAYS)})
        good = [c for c, x in zip(tried, cuts(tried), strict=True) if x[-1] >= total]
        bad = [c for c in tried if c not in good]
        high = min([high, *good])
        low = max([low, *(c + 1 for c in bad if c < high)])
    return high, cuts([high])[0][: n_shards - 1]


def shard(docs: DataFrame, n_shards: int = 8, *, text: str = "text", doc_id: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of docs."""
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.md5(t).alias("g")))
    many = rows.count()
    salts, ranges = max(16, -(-many // ROWS_PER_SALT)), ranges or max(256, -(-many // ROWS_PER_RANGE))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    cells = rows.groupBy("g", "salt").agg(F.count(F.lit(1)).alias("m"), F.min("size").alias("size"))

    bucket = F.floor(F.conv(F.substring("g", 1, 8), 16, 10).cast("long") * ranges / 2**32).cast("int")
    groups = cells.groupBy("g").agg(F.sum("m").alias("n"), F.min("size").alias("size")).withColumn("bucket", bucket).withColumn("bytes", F.col("n") * F.col("size"))
    totals = groups.groupBy("bucket").agg(F.sum("bytes").alias("b"), F.sum("n").alias("r"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over `ranges` rows
    totals = totals.select("bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))
    own = Window.partitionBy("bucket").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("b", F.sum("bytes").over(own)).withColumn("r", F.sum("n").over(own))
    groups = groups.join(F.broadcast(totals), "bucket").select("g", "bytes", (F.col("b0") + F.col("b")).alias("end"), (F.col("r0") + F.col("r") - F.col("n")).alias("first_row"))
    groups = stored(groups.sortWithinPartitions("end"))

    _, ends = least_capacity(groups, n_shards)
    number = sum((F.col("end") > e).cast("int") for e in ends) if ends else F.lit(0)
    groups = groups.select("g", "first_row", number.cast("int").alias("shard"))
    starts = {s: r for s, r in groups.groupBy("shard").agg(F.min("first_row")).collect()}  # a row per shard
    start = F.coalesce(*(F.when(F.col("shard") == s, F.lit(r)) for s, r in starts.items()), F.lit(0))

    earlier = Window.partitionBy("g").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    places = cells.withColumn("skip", F.coalesce(F.sum("m").over(earlier), F.lit(0))).join(groups, "g")
    places = places.select("g", "salt", "shard", (F.col("first_row") - start + F.col("skip")).alias("slot0"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("g", "salt").orderBy("doc_id")))
    return numbered.join(places, ["g", "salt"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot0") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
