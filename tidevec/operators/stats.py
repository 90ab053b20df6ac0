"""Statistics over attributes and predicates: ranks, counts, selectivities, histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codebook import running
from ..functions.predicates import kinds_of, matches
from .knn import _dealt, few


def attr_rank(points: DataFrame, column: str = "a0", id_col: str = "label") -> DataFrame:
    """(label, v, rk): the place, from 0, in order of (value, id).

    Rows are counted per value and stretch of ids first; running sums over the
    values, in two levels, and over a value's stretches give each stretch's
    offset, and rows are numbered inside it.  So no task holds a whole value.
    """
    rows = points.select(F.col(id_col).alias("label"), F.col(column).alias("v"))
    lo, hi, n = rows.agg(F.coalesce(F.min("label"), F.lit(0)), F.coalesce(F.max("label"), F.lit(0)), F.count(F.lit(1))).first()
    wide = max(1, (int(hi) - int(lo)) // max(1, math.isqrt(n)) + 1)
    rows = rows.withColumn("stretch", F.floor((F.col("label") - F.lit(int(lo))) / F.lit(wide)))
    counts = rows.groupBy("v", "stretch").agg(F.count(F.lit(1)).alias("n"))
    values = running(counts.groupBy("v").agg(F.sum("n").alias("n")), "v", into="off").select("v", "off")
    before = Window.partitionBy("v").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("more", F.coalesce(F.sum("n").over(before), F.lit(0))).join(values, "v").select("v", "stretch", (F.col("off") + F.col("more")).alias("off"))
    inside = Window.partitionBy("v", "stretch").orderBy("label")
    return rows.join(offsets, ["v", "stretch"]).select("label", "v", (F.col("off") + F.row_number().over(inside) - 1).cast("long").alias("rk"))


def range_counts(points: DataFrame, ranges: DataFrame, column: str = "a0") -> DataFrame:
    """(qid, n): rows in [lo, hi] for each row (qid, lo, hi) of ``ranges``.

    Rows are counted per value before they meet the ranges.
    """
    counts = points.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    got = ranges.join(counts, F.col("v").between(F.col("lo"), F.col("hi")), "left")
    return got.groupBy("qid").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def inverted_lists(points: DataFrame, column: str = "a1", id_col: str = "label") -> DataFrame:
    """(item, label): one row for each label of each record, the inverted lists in long form."""
    return points.select(F.explode(column).alias("item"), F.col(id_col).alias("label"))


def label_frequency(points: DataFrame, column: str = "a1") -> DataFrame:
    return points.select(F.explode(column).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def selectivity(points: DataFrame, queries: DataFrame, terms: str = "terms") -> DataFrame:
    """(qid, n_match, selectivity) of each query's own disjunction; few queries are sent to the points, more meet them in blocks."""
    n = points.agg(F.count(F.lit(1)).alias("total"))
    asked = queries.select("qid", F.col(terms).alias("terms"))
    kinds = kinds_of(queries.schema[terms].dataType.elementType)
    hit = matches(F.col("terms"), attrs={n: (kind, F.col(n)) for n, kind in kinds.items()})
    if few(queries):
        pairs = points.select(*kinds).join(F.broadcast(asked), hit)
    else:
        ps, qs = _dealt(points.select("label", *kinds), asked)
        pairs = ps.join(qs, ["qb", "pb"]).where(hit)
    hits = pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("n_match"))
    out = queries.select("qid").join(hits, "qid", "left").na.fill(0, ["n_match"]).join(F.broadcast(n))
    return out.select("qid", "n_match", (F.col("n_match") / F.col("total")).alias("selectivity"))


def selectivity_histogram(sel: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n): all bins, a selectivity of 1 in the last."""
    b = F.least(F.floor(F.col("selectivity") * bins), F.lit(bins - 1)).cast("long")
    got = sel.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return sel.sparkSession.range(bins).select(F.col("id").alias("bin")).join(F.broadcast(got), "bin", "left").na.fill(0, ["n"])


def summary(sel: DataFrame, n_col: str = "n_match") -> DataFrame:
    return sel.agg(F.min(n_col).alias("min_match"), F.avg(n_col).alias("mean_match"), F.max(n_col).alias("max_match"), F.sum(n_col).alias("sum_match"))


def live_summary(points: DataFrame) -> DataFrame:
    """One row: occupied, live and deleted records, and the deleted share."""
    return points.agg(
        F.count(F.lit(1)).alias("occupied"), F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("dead"),
        F.avg(F.col("deleted").cast("double")).alias("deleted_ratio"),
    )


def cluster_histogram(points: DataFrame, slots: Column, cluster: str = "cluster_id") -> DataFrame:
    """(cluster_id, slot, n): how many records of a cluster hold each slot; ``slots`` is an array."""
    return points.select(F.col(cluster).alias("cluster_id"), F.explode(slots).alias("slot")).groupBy("cluster_id", "slot").agg(F.count(F.lit(1)).alias("n"))


def cluster_estimate(histogram: DataFrame, slots: list[int]) -> DataFrame:
    """(cluster_id, estimate): the sum of the counts of the slots that a predicate hits."""
    hit = F.col("slot").isin(*slots) if slots else F.lit(False)
    return histogram.groupBy("cluster_id").agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("estimate"))
