"""Shards by a Feistel permutation of global row numbers, in DataFrame functions only.

Rows are numbered 0 to N - 1 by ascending order columns. A keyed permutation of these numbers gives every row its place
in a shuffled order; place ``p`` lies in shard ``p mod shards`` at slot ``p div shards``. Shard and slot of any row follow
from its number alone, so a reader can compute where a row lies, and shards differ by one row at most (law ``rows``).

Nulls sort first, equal rows are interchangeable, an empty table gives no rows, and a text of any length counts only by
its size and checksum. Columns named like the results are replaced.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.functions.rows import let
from shardloom.llm.batches import free_names, without
from shardloom.session import local_table, materialize

ROUNDS = 6
NUMBER, SHARD, SLOT = "row_number", "shard", "slot"


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with gapless ``row_number`` from 0 by ``order``; nulls first, ties by all other atomic columns.

    Rows are dealt by ranges of the order columns and of a scan position, so that many equal rows are split too. The
    dealt rows are written once: their partitions must not change between counting and numbering.
    """
    df = without(df, [NUMBER])
    at, part, before = free_names(df, "at", "part", "before")
    dealt = df.withColumn(at, F.monotonically_increasing_id())
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order] + [F.col(at)]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = dealt.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = materialize(placed.withColumn(at, F.monotonically_increasing_id()), "numbered")
    # The high bits of a monotonic id are the partition, the low 33 bits the position in it.
    number, place = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    counts = dict(placed.groupBy(number.alias("p")).count().collect())  # one number for each partition
    seen, starts = 0, []
    for p in sorted(counts):
        starts.append((p, seen))
        seen += counts[p]
    offsets = F.broadcast(local_table(df.sparkSession, starts, f"{part} bigint, {before} bigint"))
    numbered = placed.withColumn(part, number).join(offsets, part).withColumn(NUMBER, F.col(before) + place)
    return numbered.select([F.col(f"`{c}`") for c in [*df.columns, NUMBER]])


def quotient(x: Column, by: int) -> Column:
    """Whole-number division; ``/`` would go through doubles."""
    return F.call_function("div", x, F.lit(by).cast("bigint"))


def permuted(number: Column, rows: int, seed: int) -> Column:
    """The keyed permutation of 0 .. rows - 1: Feistel rounds over a mixed-radix grid with cycle walking.

    The grid of ``a * b`` cells, a = ceil(sqrt(rows)), holds fewer than ``a`` cells too many, so a walk leaves the rows in
    about one case of sqrt(rows) and comes back after at most ``a`` steps: each start is visited once on its cycle.
    """
    a = isqrt(max(rows - 1, 0)) + 1
    b = -(-rows // a) if rows else 1
    spare = a * b - rows

    def noise(step: Column, x: Column, modulus: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), step.cast("string"), x.cast("string")))
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % modulus

    def once(x: Column) -> Column:
        # A round turns (l, r) with radices (m, n) into (r, l + noise(r)) with radices (n, m).
        start = F.struct(quotient(x, b).alias("l"), (x % F.lit(b).cast("bigint")).alias("r"))

        def step(pair: Column, i: Column) -> Column:
            modulus = F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("bigint")
            return F.struct(pair["r"].alias("l"), ((pair["l"] + noise(i, pair["r"], modulus)) % modulus).alias("r"))

        # An even number of rounds ends with the radices in their first order.
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda p: p["l"] * F.lit(b).cast("bigint") + p["r"])

    def walked(x: Column) -> Column:
        far = F.aggregate(F.sequence(F.lit(1), F.lit(max(spare, 1))), x, lambda at, _: F.when(at < rows, at).otherwise(once(at)))
        return F.when(x < rows, x).otherwise(far)

    return let(once(number), walked)


def shard_rows(df: DataFrame, shards: int, order: list[str], seed: int = 7) -> DataFrame:
    """``df`` with ``row_number``, ``shard`` (0 .. shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    numbered = number_rows(without(df, [SHARD, SLOT]), order)
    rows = numbered.count()
    place = permuted(F.col(NUMBER), rows, seed)
    spot, = free_names(numbered, "spot")
    found = let(place, lambda p: F.struct((p % shards).cast("int").alias(SHARD), quotient(p, shards).alias(SLOT)))
    return numbered.withColumn(spot, found).select(*[F.col(f"`{c}`") for c in numbered.columns], f"{spot}.*")


def write_shards(df: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order; a shard is split over tasks by slot ranges, never held whole."""
    df.repartitionByRange(SHARD, SLOT).sortWithinPartitions(SHARD, SLOT).write.partitionBy(SHARD).parquet(path)
