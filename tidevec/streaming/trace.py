"""A staged mutation trace and its replay as a stream.

A trace deletes and inserts records stage by stage.  Replaying applies each
stage to the last committed version of the points and commits the next one;
versions are whole Parquet tables, and a stage that was committed before is
skipped, so a restart after a failure repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trace:
    """Insert from ``initial`` up, delete back down to it, or replace ``step`` records a stage."""

    op: str
    initial: int
    step: int
    capacity: int
    seed: int = 12345

    def __post_init__(self) -> None:
        if self.op not in ("insert", "delete", "replace"):
            raise ValueError("op is insert, delete or replace")
        if self.step <= 0 or self.initial % self.step or self.capacity < 2 * self.initial:
            raise ValueError("step must divide initial, and capacity must hold twice as much")

    @property
    def stages(self) -> int:
        return self.initial // self.step

    def events(self, spark: SparkSession) -> DataFrame:
        """(stage, op, label, logical): stage 0 fills the index, each later one changes ``step`` records."""
        start = self.initial if self.op != "delete" else 2 * self.initial
        fill = spark.range(start).select(F.lit(0).alias("stage"), F.lit("insert").alias("op"), F.col("id").alias("label"), F.col("id").alias("logical"))
        nth = spark.range(self.stages * self.step).withColumn("stage", (F.floor(F.col("id") / self.step) + 1).cast("int"))
        if self.op == "insert":
            more = nth.select("stage", F.lit("insert").alias("op"), (F.col("id") + self.initial).alias("label"), (F.col("id") + self.initial).alias("logical"))
        elif self.op == "delete":
            drawn = spark.range(start).withColumn("k", F.xxhash64("id", F.lit(self.seed))).withColumn("n", F.row_number().over(Window.orderBy("k", "id")) - 1)
            drawn = drawn.where(F.col("n") < self.stages * self.step)
            more = drawn.select((F.floor(F.col("n") / self.step) + 1).cast("int").alias("stage"), F.lit("delete").alias("op"), F.col("id").alias("label"), F.col("id").alias("logical"))
        else:
            gone = nth.select("stage", F.lit("delete").alias("op"), F.col("id").alias("label"), F.col("id").alias("logical"))
            new = nth.select("stage", F.lit("insert").alias("op"), (F.col("id") + self.initial).alias("label"), F.col("id").alias("logical"))
            more = gone.unionByName(new)
        return fill.unionByName(more)


def live_at(events: DataFrame, stage: int, by: str = "label", order: str = "stage") -> DataFrame:
    """(label) live after ``stage``: those whose last event isn't a deletion."""
    last = events.where(F.col(order) <= stage).groupBy(by).agg(F.max_by("op", F.struct(order, (F.col("op") == "insert").cast("int"))).alias("op"))
    return last.where(F.col("op") != "delete").select(by)


def stage_counts(events: DataFrame) -> DataFrame:
    """(stage, inserted, deleted, occupied, dead, live): per stage and summed up to it."""
    per = events.groupBy("stage").agg(F.count_if(F.col("op") == "insert").alias("inserted"), F.count_if(F.col("op") == "delete").alias("deleted"))
    w = Window.orderBy("stage")
    return per.select("stage", "inserted", "deleted", F.sum("inserted").over(w).alias("occupied"), F.sum("deleted").over(w).alias("dead"), (F.sum("inserted").over(w) - F.sum("deleted").over(w)).alias("live"))


class VersionedTable:
    """Versions of a table as Parquet folders; a version exists once its commit file does."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The last committed version, -1 if there is none."""
        fs, p = self._fs(f"{self.path}/commits")
        if not fs.exists(p):
            return -1
        return max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version() if version is None else version}")

    def commit(self, df: DataFrame, version: int) -> None:
        """Write ``df`` as ``version``; an unfinished earlier try is overwritten, a committed one is left alone."""
        if self.version() >= version:
            return
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        fs, p = self._fs(f"{self.path}/commits/{version}")
        fs.create(p, True).close()


def applied(points: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """``points`` after a batch of events (op, label, vector, ...) in which each label's last one counts.

    ``delete`` sets a tombstone, everything else overwrites or inserts and revives.
    """
    cols = [c for c in points.columns if c != "label"]
    last = batch.groupBy("label").agg(F.max_by(F.struct("op", *[c for c in cols if c in batch.columns and c != "deleted"]), order).alias("e"))
    both = points.withColumn("__p", F.lit(True)).join(last, "label", "full")
    gone = F.col("e.op") == "delete"

    def value(c: str):
        if c == "deleted":
            return F.when(F.col("e").isNull(), F.col("deleted")).otherwise(gone).alias(c)
        if c in batch.columns:
            return F.when(F.col("e").isNotNull() & ~gone, F.col(f"e.{c}")).otherwise(F.col(c)).alias(c)
        return F.col(c)

    return both.where(F.col("__p").isNotNull() | ~gone).select("label", *[value(c) for c in cols]).select(*points.columns)


def replay(events: DataFrame, table: VersionedTable, initial: DataFrame, checkpoint: str, on_commit: Callable[[int], None] | None = None):
    """A streaming query that applies micro-batches of ``events`` to ``table``; the caller awaits it."""
    if table.version() < 0:
        table.commit(initial, 0)

    def step(batch: DataFrame, epoch: int) -> None:
        if table.version() >= epoch + 1:
            return
        table.commit(applied(table.read(epoch), batch), epoch + 1)
        if on_commit:
            on_commit(epoch + 1)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Events by type and window with a watermark; works on streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
