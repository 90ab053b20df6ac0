"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words.  Among all document rates between 0
and ``max_rate`` that meet the targets, entropy balancing takes the ones
nearest (in bounded relative entropy) to the common base rate.  Their form is
an exponential tilt, ``rate = max_rate * sigmoid(a + lambda_source * size / mean size)``,
and the multipliers solve a convex dual that has one equation a source.
Distributed Newton iterations find them: each iteration sums gradient and
curvature per source over the histogram of (source, size), which holds
everything the dual needs, and a bracket keeps steps that leave it from
diverging.  Rates are then rounded into whole copies by systematic rounding
along the sizes of a source, so that the copies of a source never stray from
their running sum by more than one document.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; repeated rows count as often as they occur; documents of size
0 get the copies their rate says but take no words; very long texts are counted
whole; which of several documents of one size gets a further copy follows a hash
of its id (ties: of its text, in ``mixed_rows``); a dual that isn't solved is an error; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import WORD, ranked, shared_dir, text_key, unused, written

WEIGHTS = (5.0, 2.0, 1.0)


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, max_rate: float) -> DataFrame:
    """(src_null, src, source_size, target) from (src_null, src, source_size).

    Targets are shares of ``share`` times all words by weight; a target stops
    at ``max_rate`` times its source's size and its excess is shared again by
    weight among the others.  That fills the sources like vessels: those with
    the least room per weight are full, the rest stand at one level.  The
    level is the first, in order of room per weight, that its vessel still holds.
    """
    in_order = Window.orderBy("src_null", "src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__i"), F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("__i", F.row_number().over(in_order) - 1).withColumn("w", weight)
    s = s.withColumn("room", F.lit(float(max_rate)) * F.col("source_size")).withColumn("ratio", F.col("room") / F.col("w"))
    by_ratio = Window.orderBy("ratio", "src_null", "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    s = s.withColumn("level", (total - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src_null", "src", "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("room")).otherwise(F.col("w") * F.col("level"))
    return s.select("src_null", "src", "source_size", target.alias("target"))


def tilt(hist: DataFrame, targets: DataFrame, base_rate: float, max_rate: float, tol: float = 1e-9, max_iter: int = 60) -> DataFrame:
    """(src_null, src, lam, fixed): the dual's solution for each source.

    ``hist`` has (src_null, src, size, n).  ``fixed`` is the rate of sources
    whose target is 0 or as much as they can give, else null.
    """
    key = ["src_null", "src"]
    a = math.log(base_rate / (max_rate - base_rate))
    cells = hist.join(targets, key).where((F.col("size") > 0)).withColumn("z", F.col("size") * F.col("docs") / F.col("source_size"))
    cells = written(cells.where((F.col("target") > 0) & (F.col("target") < max_rate * F.col("source_size") * (1 - 1e-12))), "mix-cells")
    state = cells.select(*key).distinct().select(*key, F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(None).cast("double").alias("off"))
    state = state.checkpoint()
    for _ in range(max_iter):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) + F.col("lam") * F.col("z"))))
        words = F.col("size") * F.col("n")
        step = cells.join(state, key).groupBy(*key).agg(
            F.first("lam").alias("lam"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
            (F.sum(max_rate * p * words) - F.first("target")).alias("g"),
            F.sum(max_rate * p * (1 - p) * F.col("z") * words).alias("h"),
            F.first("target").alias("t"),
        )
        lo = F.when(F.col("g") < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("g") >= 0, F.col("lam")).otherwise(F.col("hi"))
        step = step.select(*key, "lam", lo.alias("lo"), hi.alias("hi"), "g", "h", (F.abs("g") / F.col("t")).alias("off"))
        newton = F.col("lam") - F.try_divide("g", "h")
        # Outside the bracket: halve it, or leave an open side by doubling steps.
        middle = (
            F.when((F.col("lo") > -1e6) & (F.col("hi") < 1e6), (F.col("lo") + F.col("hi")) / 2)
            .when(F.col("lo") > -1e6, F.greatest(F.lit(1.0), 2 * F.abs("lam")))
            .otherwise(-F.greatest(F.lit(1.0), 2 * F.abs("lam")))
        )
        good = newton.isNotNull() & ~F.isnan(newton) & (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("lam")) <= 4 * (1 + F.abs("lam")))
        lam = F.when(F.col("off") <= tol, F.col("lam")).when(good, newton).otherwise(middle)
        state = step.select(*key, lam.alias("lam"), "lo", "hi", "off").checkpoint()
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tol:
            break
    else:
        raise RuntimeError(f"the dual of the mix isn't solved after {max_iter} steps")
    # Rounded, so that reruns agree whatever the order of sums.
    state = state.withColumn("lam", F.round("lam", 9))
    fixed = F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("lam").isNull(), F.lit(float(max_rate)))
    return targets.join(state.select(*key, "lam"), key, "left").select(*key, "lam", fixed.alias("fixed"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_rate: int = 2,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keyed: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, rate, copies, taken.

    ``copies`` is a whole number from 0 to ``max_rate``; ``taken`` is copies
    times size.  With ``keyed`` a column ``key`` tells the texts apart.
    """
    shared_dir(docs.sparkSession)
    key = ["src_null", "src"]
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).isNull().alias("src_null"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
            n_words(F.col(text_col)).alias("size"),
            *([F.coalesce(text_key(F.col(text_col)), F.lit(b"")).alias("key")] if keyed else []),
        ),
        "mix-rows",
    )
    hist = written(rows.groupBy(*key, "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    sources = hist.groupBy(*key).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    targets = source_targets(sources.drop("docs"), weights, share, float(max_rate)).join(sources.drop("source_size"), key)
    targets = written(targets, "mix-targets")
    base = min(max(share, 1e-3 * max_rate), (1 - 1e-3) * max_rate)
    solved = tilt(hist, targets, base, float(max_rate))
    z = F.col("size") * F.col("docs") / F.col("source_size")
    sig = F.lit(float(max_rate)) / (1 + F.exp(-(F.lit(math.log(base / (max_rate - base))) + F.col("lam") * z)))
    rate = F.coalesce(F.col("fixed"), sig)
    cells = hist.join(targets, key).join(solved, key).withColumn("rate", F.greatest(F.lit(0.0), F.least(F.lit(float(max_rate)), rate)))
    cells = cells.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    before = Window.partitionBy(*key).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cum", F.coalesce(F.sum(F.col("part") * F.col("n")).over(before), F.lit(0.0)) + 0.5)
    cells = written(cells.select(*key, "size", "source_size", "target", "rate", "whole", "part", "cum"), "mix-rates")
    n_rows = hist.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = ranked(rows.withColumn("ord", F.coalesce("id", F.lit(-1))), [*key, "size"], ["ord", *(["key"] if keyed else [])], n_rows, "place")
    extra = F.floor(F.col("cum") + (F.col("place") + 1) * F.col("part")) - F.floor(F.col("cum") + F.col("place") * F.col("part"))
    copies = (F.col("whole") + extra).cast("long")
    return placed.join(cells, [*key, "size"]).select(
        F.col("id").alias(id_col),
        F.when(~F.col("src_null"), F.col("src")).alias(source_col),
        "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["key"] if keyed else []),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it has copies.

    Rows that repeat an id, text and source count as one row with all their copies.
    """
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, keyed=True, **options)
    i, src, null, key, copies, copy = names = unused(docs, "id_of", "source_of", "source_is_null", "text_key", "copies_of", "copy_of")
    one = [F.coalesce(F.col(id_col).cast("string"), F.lit("none")).alias(i), F.coalesce(F.col(source_col), F.lit("")).alias(src), F.col(source_col).isNull().alias(null)]
    plan = plan.select(*one, F.col("key").alias(key), "copies").groupBy(*names[:4]).agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    rows = docs.select(*docs.columns, *one, F.coalesce(text_key(F.col(text_col)), F.lit(b"")).alias(key))
    rows = rows.join(plan, names[:4]).dropDuplicates(names[:4])
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
