"""Codebooks: numeric values and labels to a few slots, from which Markers are made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INT_MAX = (1 << 31) - 1
#: Keys of one block of the two-level running sums.
BLOCK = 1 << 16


def running(counts: DataFrame, key: str, n: str = "n", into: str = "before") -> DataFrame:
    """``counts`` (one row a key) with the sum of ``n`` over all smaller keys.

    Sums run inside blocks of ``BLOCK`` consecutive keys and over the blocks'
    totals, so no task sorts all keys.
    """
    blk = F.floor(F.col(key) / BLOCK)
    c = counts.withColumn("__blk", blk)
    totals = c.groupBy("__blk").agg(F.sum(n).alias("__t"))
    earlier = Window.orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__blk", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__blk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = c.withColumn("__in", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(totals, "__blk")
    return out.withColumn(into, F.col("__off") + F.col("__in")).drop("__blk", "__off", "__in")


def numbered(df: DataFrame, key: str, into: str) -> DataFrame:
    """``df`` with each row's place, from 1, in order of a unique integer key; two levels as in ``running``."""
    return running(df.withColumn("__one", F.lit(1)), key, "__one", into).drop("__one").withColumn(into, F.col(into) + 1)


def numeric_starts(df: DataFrame, column: str, slots: int) -> list[int]:
    """First value of each slot: equal counts, but equal values share a slot.

    Exact and distributed: value counts are summed up in order of value, and
    the first value at or after each equal share starts a slot that no earlier
    slot has started.  What is left over starts past the largest value.
    The result has ``slots`` numbers, whatever the data's size.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total, top = counts.agg(F.sum("n"), F.max("v")).first()
    if not total:
        return [0] * slots
    share = F.floor(F.col("before") * slots / F.lit(total))
    starts = running(counts, "v").withColumn("slot", share).groupBy("slot").agg(F.min("v").alias("v"))
    got = [r["v"] for r in starts.orderBy("slot").collect()]  # at most ``slots`` rows
    past = min(top + 1, INT_MAX)
    return got + [past] * (slots - len(got))


def numeric_slot(value: Column, starts: Sequence[int]) -> Column:
    """Last slot that starts at or before the value; the first slot for smaller values."""
    bounds = F.array(*[F.lit(int(x)) for x in starts])
    return F.greatest(F.lit(0), F.size(F.filter(bounds, lambda x: x <= value)) - 1).cast("int")


def lower_bound(value: Column, starts: Sequence[int]) -> Column:
    """Index of the first start at or after the value."""
    bounds = F.array(*[F.lit(int(x)) for x in starts])
    return F.size(F.filter(bounds, lambda x: x < value)).cast("int")


def label_slots(df: DataFrame, column: str, slots: int) -> DataFrame:
    """(label, n, slot): labels by frequency, ties by label, dealt round to the slot with the fewest labels."""
    counts = df.select(F.explode(column).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1
    return counts.withColumn("slot", F.pmod(place, F.lit(slots)).cast("int"))


def registered(codebook: DataFrame, df: DataFrame, column: str, slots: int) -> DataFrame:
    """``codebook`` (label, slot) with the unseen labels of ``df`` added; what is assigned never moves.

    Each new label, in order, goes to the slot with the fewest labels.  The
    number of slots is fixed, so filling them up is arithmetic on their counts:
    candidate places (slot, level) are ranked and the k-th new label takes the k-th.
    """
    spark = df.sparkSession
    new = df.select(F.explode(column).alias("label")).distinct().join(codebook, "label", "left_anti")
    new = new.withColumn("place", F.row_number().over(Window.orderBy("label")))
    all_slots = spark.range(slots).select(F.col("id").cast("int").alias("slot"))
    used = all_slots.join(codebook.groupBy("slot").agg(F.count(F.lit(1)).alias("c")), "slot", "left").na.fill(0, ["c"])
    many = new.agg(F.count(F.lit(1)).alias("m"))
    free = used.crossJoin(many).where("m > 0").select("slot", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("m") - 1)).alias("level"))
    free = free.withColumn("place", F.row_number().over(Window.orderBy("level", "slot")))
    return codebook.select("label", "slot").unionByName(new.join(free, "place").select("label", "slot"))


def map_of(codebook: DataFrame) -> dict[int, int]:
    """The label codebook on the driver; its size is bounded by the label range."""
    return {r["label"]: r["slot"] for r in codebook.select("label", "slot").collect()}


def label_slot(label: Column, mapping: dict[int, int]) -> Column:
    """Slot of a label, -1 if it has none."""
    if not mapping:
        return F.lit(-1)
    pairs = [F.lit(x) for k, v in sorted(mapping.items()) for x in (int(k), int(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), F.lit(-1))


def has_unassigned(mapping: dict[int, int], n_labels: int) -> bool:
    return any(mapping.get(i, -1) < 0 for i in range(n_labels))
