"""Evaluation: recall, throughput at a recall, contrasts between runs, validation and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): the share of the k true labels that the result has; padding counts for nothing."""
    t = truth.where((F.col("rk") <= k) & (F.col("label") >= 0)).select("qid", "label")
    r = result.where((F.col("rk") <= k) & (F.col("label") >= 0)).select("qid", "label").distinct().withColumn("hit", F.lit(1))
    got = t.join(r, ["qid", "label"], "left")
    return got.groupBy("qid").agg((F.count("hit") / F.lit(float(k))).alias("recall"))


def qps_at_recall(curve: DataFrame, target: float, by: list[str], extrapolate_min: bool = True) -> DataFrame:
    """Throughput at a recall on each curve (…by, ef, recall, qps), between neighbouring points.

    The first pair of points in order of ef that brackets the target decides.
    If the first point is above it already, its own throughput is taken, or
    null without ``extrapolate_min``; curves that stay below give null.
    """
    w = Window.partitionBy(*by).orderBy("ef")
    c = curve.select(*by, "ef", "recall", "qps", F.lead("recall").over(w).alias("r2"), F.lead("qps").over(w).alias("q2"), F.row_number().over(w).alias("nth"))
    inside = (F.col("recall") < target) & (F.col("r2") >= target)
    value = F.when(inside, F.col("qps") + (F.lit(target) - F.col("recall")) / (F.col("r2") - F.col("recall")) * (F.col("q2") - F.col("qps")))
    above = (F.col("nth") == 1) & (F.col("recall") >= target)
    exactly = above & (F.col("recall") == target)
    value = F.when(above if extrapolate_min else exactly, F.col("qps")).otherwise(value)
    return c.withColumn("value", value).groupBy(*by).agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("ef"))).alias("qps_at_target"))


def pivoted(table: DataFrame, rows: str, cells: str, value: str, names: list[str]) -> DataFrame:
    """One row a group, one column a cell."""
    return table.groupBy(rows).pivot(cells, names).agg(F.first(value))


def parsed_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(group, cell, ef, recall, qps, cmps) from text lines ``group cell [ef, recall, qps, cmps]``."""
    pattern = r"^(\S+)\s+(\S+)\s+\[\s*([0-9]+)\s*,\s*([0-9.eE+-]+)\s*,\s*([0-9.eE+-]+)\s*,\s*([0-9.eE+-]+)\s*\]"
    part = lambda i, t: F.regexp_extract(column, pattern, i).cast(t)
    ok = lines.where(F.regexp_like(column, F.lit(pattern)))
    return ok.select(part(1, "string").alias("group"), part(2, "string").alias("cell"), part(3, "int").alias("ef"), part(4, "double").alias("recall"), part(5, "double").alias("qps"), part(6, "double").alias("cmps"))


def median_of_repeats(samples: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return samples.groupBy(*by).agg(*[F.expr(f"percentile({v}, 0.5)").alias(v) for v in values])


def paired_contrasts(samples: DataFrame, base: str, rounds: str = "round", variant: str = "variant", value: str = "qps") -> DataFrame:
    """(variant, median_ratio, min_ratio, max_ratio) of each variant to ``base`` in the same round."""
    b = samples.where(F.col(variant) == base).select(F.col(rounds), F.col(value).alias("b"))
    r = samples.where(F.col(variant) != base).join(b, rounds).withColumn("ratio", F.try_divide(F.col(value), F.col("b")))
    return r.groupBy(variant).agg(F.expr("percentile(ratio, 0.5)").alias("median_ratio"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"))


def relative_change(current: Column, initial: Column) -> Column:
    """current / initial - 1; null where it has no meaning."""
    return F.try_divide(current, initial) - 1


def exceeds(current: Column, old: Column, factor: float = 1.05) -> Column:
    return F.when(current.isNotNull() & old.isNotNull(), current > F.lit(factor) * old)


def mutation_shares(timings: DataFrame, parts: tuple[str, ...] = ("delete_s", "add_s", "scrub_s")) -> DataFrame:
    """Each part's share of the whole time; null where a part is unknown."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return timings.select("*", total.alias("total_s"), *[F.try_divide(F.col(p), total).alias(p.removesuffix("_s") + "_share") for p in parts])


def first_ef(curve: DataFrame, target: float, by: list[str]) -> DataFrame:
    """The least ef whose recall reaches the target."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("recall") >= target, F.col("ef"))).alias("ef"))


def violations(result: DataFrame, k: int, universe: DataFrame | None = None) -> DataFrame:
    """One row of counts that are all 0 for a sound result: ranks, order, duplicates, unknown labels."""
    w = Window.partitionBy("qid").orderBy("rk")
    r = result.withColumn("prev", F.lag("dist").over(w)).withColumn("nth", F.row_number().over(w))
    dup = result.where("label >= 0").groupBy("qid", "label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    out = r.agg(F.count_if((F.col("rk") < 1) | (F.col("rk") > k) | (F.col("rk") != F.col("nth"))).alias("bad_ranks"), F.count_if(F.col("prev") > F.col("dist")).alias("unsorted")).crossJoin(dup)
    if universe is not None:
        lost = result.where("label >= 0").join(universe.select("label"), "label", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
        out = out.crossJoin(lost)
    return out


def digest(df: DataFrame, order: list[str]) -> DataFrame:
    """One hash of a whole table that doesn't depend on the order of rows.

    Rows are hashed one by one and their hashes are combined by exclusive or and
    sum, so nothing is collected.
    """
    h = F.xxhash64(*[F.col(c) for c in order])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum"))


def text_digest(df: DataFrame, cols: list[str]) -> DataFrame:
    """The same by MD5 of the rows as text, which other engines can compute: the sum of the first 60 bits of each."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols])), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("decimal(38,0)").cast("string").alias("digest"))
