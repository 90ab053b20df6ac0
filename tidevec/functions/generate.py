"""Generators of attributes and predicates, deterministic given the seed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .codebook import running

#: Chance of each of the 20 labels (fixed values).
LABEL_CHANCES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.09, 0.08, 0.07, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01, 0.001)


def zipf(spark: SparkSession, n: int, s: float) -> DataFrame:
    """(k, p): Zipf chances k ** -s over their sum."""
    raw = spark.range(1, n + 1).select(F.col("id").alias("k"), F.pow(F.col("id").cast("double"), F.lit(-float(s))).alias("w"))
    total = raw.agg(F.sum("w").alias("total"))
    return raw.join(F.broadcast(total)).select("k", (F.col("w") / F.col("total")).alias("p"))


def _draw(key: Column, salt: int) -> Column:
    """A number in [0, 1) from a key by integer arithmetic that any SQL engine repeats."""
    a = F.pmod(key * F.lit(7919) + F.lit(104729 * (salt + 1)), F.lit(1_000_003))
    b = F.pmod(a * a + a * F.lit(31) + F.lit(salt * 17), F.lit(1_000_003))
    return b.cast("double") / F.lit(1_000_003.0)


def attributes(df: DataFrame, key: str, high: int = 100_000, chances: Sequence[float] = LABEL_CHANCES) -> DataFrame:
    """``df`` with a uniform a0 in [0, high) and labels a1 drawn independently by their chances."""
    k = F.col(key).cast("long")
    labels = [F.when(_draw(k, i + 1) < F.lit(float(p)), F.lit(i)) for i, p in enumerate(chances)]
    return df.withColumn("a0", F.floor(_draw(k, 0) * high).cast("int")).withColumn("a1", F.array_compact(F.array(*labels)))


#: Windows that are broadcast at once.
WINDOWS_AT_ONCE = 100_000


def windows(points: DataFrame, n_queries: int, selectivity: float, labels: Sequence[int] = (), column: str = "a0") -> DataFrame:
    """(qid, lo, hi, labels): ranges over windows of ranks that hold ``selectivity`` of the rows each.

    A rank's value is the one whose rows cover it: counts per value and their
    running sums answer it without numbering rows.
    """
    n = points.count()
    width = max(1, int(n * selectivity))
    counts = points.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranks = running(counts, "v", into="from").withColumn("to", F.col("from") + F.col("n"))
    start = F.pmod(F.col("id") * F.lit(7919) + F.lit(13), F.lit(max(1, n - width + 1)))
    q = points.sparkSession.range(n_queries).select(F.col("id").alias("qid"), start.alias("s"), (start + F.lit(width - 1)).alias("e"))
    lo = ranks.select(F.col("from").alias("f1"), F.col("to").alias("t1"), F.col("v").alias("lo"))
    hi = ranks.select(F.col("from").alias("f2"), F.col("to").alias("t2"), F.col("v").alias("hi"))
    lab = F.array(*[F.lit(int(x)) for x in labels]) if labels else F.array().cast("array<int>")
    out = []
    for a in range(0, max(1, n_queries), WINDOWS_AT_ONCE):  # each part is sent to the ranks
        part = F.broadcast(q.where(F.col("qid").between(a, a + WINDOWS_AT_ONCE - 1)))
        part = lo.join(part, (F.col("s") >= F.col("f1")) & (F.col("s") < F.col("t1")))
        out.append(hi.join(F.broadcast(part), (F.col("e") >= F.col("f2")) & (F.col("e") < F.col("t2"))).select("qid", "lo", "hi", lab.alias("labels")))
    return reduce(DataFrame.unionByName, out)


def dnf(points: DataFrame, n_queries: int, specs: Sequence[dict]) -> DataFrame:
    """(qid, terms): one term per spec {"range": share, "labels": [...], "mode": 1}; a missing part is unconstrained."""
    out = None
    for i, spec in enumerate(specs):
        share = spec.get("range")
        if share is not None:
            w = windows(points, n_queries, share)
            a0 = F.array(F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi")))
        else:
            w = points.sparkSession.range(n_queries).select(F.col("id").alias("qid"))
            a0 = F.array().cast("array<struct<lo:int,hi:int>>")
        a1 = F.array(*[F.lit(int(x)) for x in spec["labels"]]) if spec.get("labels") else F.array().cast("array<int>")
        t = F.struct(a0.alias("a0"), a1.alias("a1"), F.lit(int(spec.get("mode", 1))).alias("a1_mode")).alias(f"t{i}")
        w = w.select("qid", t)
        out = w if out is None else out.join(w, "qid")
    return out.select("qid", F.array(*[f"t{i}" for i in range(len(specs))]).alias("terms"))
