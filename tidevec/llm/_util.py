"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import shared_dir

#: Words of the mixing and joining contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's setting that removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = threading.Lock()
_using: dict[int, list] = {}  # by session: how many writes go on, and the setting before them


@contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go at the end of executions; several writes of one session can overlap."""
    with _lock:
        state = _using.setdefault(id(spark), [0, None])
        if not state[0]:
            state[1] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(CLEANUP, state[1])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back.

    Later jobs read files that outlive any executor, and the plan stays short.
    The shuffle files that made it go at once: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaned_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column) -> Column:
    """16 bytes that equal texts share; null for a null text."""
    return F.unhex(F.md5(text))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` is called so (columns' case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ranked(df: DataFrame, part: Sequence[str], order: Sequence[str], n_rows: int, into: str) -> DataFrame:
    """Add ``into``: the row's place (long, from 0) among the rows of its ``part``.

    The places follow a hash of ``order``.  No task holds a whole part: rows are
    dealt to about ``sqrt(n_rows)`` buckets by that hash, counted per bucket,
    and numbered inside their bucket from the bucket's offset.  ``part`` and
    ``order`` columns must not be null.
    """
    buckets = max(1, math.isqrt(max(0, n_rows)))
    b, off, n = f"__{into}_b", f"__{into}_off", f"__{into}_n"
    df = df.withColumn(b, F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)))
    counts = df.groupBy(*part, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*part).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    inside = Window.partitionBy(*part, b).orderBy(*order)
    return (
        df.join(offsets, [*part, b])
        .withColumn(into, F.col(off) + F.row_number().over(inside) - 1)
        .drop(b, off)
    )
