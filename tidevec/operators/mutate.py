"""Mutations and maintenance over immutable tables: upserts, tombstones, repair.

Every operation takes tables and returns tables.  Batches are validated as a
whole by ``errors`` tables before anything is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions.codebook import numbered


def upsert(points: DataFrame, rows: DataFrame) -> DataFrame:
    """``points`` with ``rows`` put in: existing labels are overwritten and live again; of repeats the last version wins."""
    new = rows.select(*[c for c in points.columns if c in rows.columns], *([] if "deleted" in rows.columns else [F.lit(False).alias("deleted")]))
    both = points.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in points.columns if c != "label"]
    last = both.groupBy("label").agg(F.max_by(F.struct(*cols), "__v").alias("r"))
    return last.select("label", *[F.col(f"r.{c}").alias(c) for c in cols]).select(*points.columns)


def latest(events: DataFrame, by: str = "label", version: str = "version") -> DataFrame:
    """The last row of each label by version."""
    cols = [c for c in events.columns if c != by]
    last = events.groupBy(by).agg(F.max_by(F.struct(*cols), version).alias("r"))
    return last.select(by, *[F.col(f"r.{c}").alias(c) for c in cols]).select(*events.columns)


def delete_errors(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, problem) of a batch deletion: missing, already deleted or duplicate labels."""
    asked = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    state = asked.join(points.select("label", "deleted"), "label", "left")
    problem = F.when(F.col("deleted").isNull(), "missing").when(F.col("deleted"), "already deleted").when(F.col("n") > 1, "duplicate")
    return state.select("label", problem.alias("problem")).where("problem is not null")


def soft_delete(points: DataFrame, labels: DataFrame, check: bool = True) -> DataFrame:
    """``points`` with tombstones on ``labels``; fails before any change if a label can't be deleted."""
    if check and (bad := delete_errors(points, labels).limit(5).collect()):
        raise ValueError("can't delete: " + ", ".join(f"{r['label']} ({r['problem']})" for r in bad))
    return _flagged(points, labels, True)


def _flagged(points: DataFrame, labels: DataFrame, value: bool) -> DataFrame:
    hit = labels.select("label").distinct().withColumn("__hit", F.lit(True))
    out = points.join(hit, "label", "left").withColumn("deleted", F.when(F.col("__hit"), F.lit(value)).otherwise(F.col("deleted")))
    return out.select(*points.columns)


def undelete(points: DataFrame, labels: DataFrame, cleaned: bool = False) -> DataFrame:
    """``points`` with ``labels`` live again; refused once Markers were cleaned up, and for labels that aren't deleted."""
    if cleaned:
        raise ValueError("deleted records can't come back after their Markers were cleaned up")
    state = labels.select("label").join(points.select("label", "deleted"), "label", "left").where("deleted is null or not deleted")
    if bad := state.limit(5).collect():
        raise ValueError("not deleted: " + ", ".join(str(r["label"]) for r in bad))
    return _flagged(points, labels, False)


def replaced(points: DataFrame, rows: DataFrame) -> DataFrame:
    """New labels take the room of tombstoned records, smallest labels first; what is over is appended."""
    dead = numbered(points.where("deleted").select("label"), "label", "__n")
    new = numbered(rows.select("label"), "label", "__n")
    gone = dead.join(new.select("__n"), "__n", "left_semi").select("label")
    kept = points.join(gone, "label", "left_anti")
    return kept.unionByName(rows.select(*[c for c in points.columns if c in rows.columns], *([] if "deleted" in rows.columns else [F.lit(False).alias("deleted")])), allowMissingColumns=True).select(*points.columns)


def removed(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows taken out for good; unknown labels are ignored."""
    return points.join(labels.select("label"), "label", "left_anti")


def updated(points: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``points`` with ``columns`` of live labels replaced from ``rows``; fails on unknown, deleted or repeated labels."""
    bad = delete_errors(points, rows).limit(5).collect()
    if bad:
        raise ValueError("can't update: " + ", ".join(f"{r['label']} ({r['problem']})" for r in bad))
    new = rows.select("label", F.struct(*columns).alias("__new"))
    out = points.join(new, "label", "left")
    return out.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in points.columns])


def scrubbed(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges whose two ends are live."""
    dead = points.where("deleted").select("label")
    e = edges.join(dead.withColumnRenamed("label", "dst"), "dst", "left_anti")
    return e.join(dead.withColumnRenamed("label", "src"), "src", "left_anti").select(*edges.columns)


def dirty(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(label) of live points with a dead neighbour."""
    dead = points.where("deleted").select("label")
    e = edges.join(dead.withColumnRenamed("label", "dst"), "dst", "left_semi").select(F.col("src").alias("label")).distinct()
    return e.join(dead, "label", "left_anti")


def repair_candidates(edges: DataFrame, points: DataFrame, ratio: float = 0.10) -> DataFrame:
    """(label, dead_ratio) of live points whose share of dead neighbours reaches ``ratio``."""
    flag = points.select(F.col("label").alias("dst"), F.col("deleted").cast("double").alias("dead"))
    live = points.where(~F.col("deleted")).select(F.col("label").alias("src"))
    got = edges.select("src", "dst").join(flag, "dst").join(live, "src", "left_semi").groupBy(F.col("src").alias("label")).agg(F.avg("dead").alias("dead_ratio"))
    return got.where(F.col("dead_ratio") >= ratio)


def patched(edges: DataFrame, points: DataFrame, max_degree: int, metric: str = "l2", per_dead: int | None = None) -> DataFrame:
    """Edges after a batch patch: live ones stay, free slots are filled from the neighbours of dead ones, nearest first.

    ``per_dead`` limits the replacements that one lost neighbour brings, as the in-place deletion does.
    """
    e = edges.select("src", "dst", "dist")
    dead = points.where("deleted").select("label")
    live_src = e.join(dead.withColumnRenamed("label", "src"), "src", "left_anti")
    keep = live_src.join(dead.withColumnRenamed("label", "dst"), "dst", "left_anti").select("src", "dst", "dist")
    lost = live_src.join(dead.withColumnRenamed("label", "dst"), "dst", "left_semi").select("src", F.col("dst").alias("mid"))
    cand = lost.join(e.select(F.col("src").alias("mid"), "dst"), "mid").where("src <> dst").join(dead.withColumnRenamed("label", "dst"), "dst", "left_anti")
    cand = cand.select("src", "dst", "mid").distinct().join(keep.select("src", "dst"), ["src", "dst"], "left_anti")
    a = points.select(F.col("label").alias("src"), F.col("vector").alias("v1"))
    b = points.select(F.col("label").alias("dst"), F.col("vector").alias("v2"))
    cand = cand.join(a, "src").join(b, "dst").select("src", "dst", "mid", D.distance(metric, F.col("v1"), F.col("v2")).alias("dist"))
    if per_dead is not None:
        nth = F.row_number().over(Window.partitionBy("src", "mid").orderBy("dist", "dst"))
        cand = cand.withColumn("nth", nth).where(F.col("nth") <= per_dead)
    cand = cand.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    have = keep.groupBy("src").agg(F.count(F.lit(1)).alias("have"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    fill = cand.withColumn("nth", nth).join(have, "src", "left").where(F.col("nth") + F.coalesce("have", F.lit(0)) <= max_degree).select("src", "dst", "dist")
    slot = (F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst")) - 1).cast("int")
    return keep.unionByName(fill).withColumn("slot", slot).select("src", "dst", "slot", "dist")


def deleted_in_place(edges: DataFrame, points: DataFrame, labels: DataFrame, max_degree: int, metric: str = "l2", per_dead: int = 3, most: int = 50) -> tuple[DataFrame, dict[str, int]]:
    """(edges, counters) after the records ``labels``, tombstones by now, were taken out of the graph.

    Whoever pointed to a dead record, or was pointed to by it, gets up to
    ``per_dead`` replacements among the ``most`` nearest of that record's other
    neighbours, as far as it has free places; edges of tombstones go.
    """
    from .graph import cut, slotted

    e = edges.select("src", "dst", "dist")
    dead = points.where("deleted").select("label")
    gone = labels.select(F.col("label").alias("mid")).distinct()
    keep = cut(scrubbed(e, points))
    around = e.select(F.col("src").alias("x"), F.col("dst").alias("mid")).union(e.select(F.col("dst").alias("x"), F.col("src").alias("mid")))
    around = around.join(gone, "mid", "left_semi").join(dead.withColumnRenamed("label", "x"), "x", "left_anti").distinct()
    v = points.select("label", "vector")
    mid = v.select(F.col("label").alias("mid"), F.col("vector").alias("vm"))
    near = around.join(v.withColumnRenamed("label", "x"), "x").join(mid, "mid").select("mid", "x", F.col("vector").alias("vx"), D.distance(metric, F.col("vm"), F.col("vector")).alias("dm"))
    nth = F.row_number().over(Window.partitionBy("mid").orderBy("dm", "x"))
    cand = near.withColumn("nth", nth).where(F.col("nth") <= most).select("mid", F.col("x").alias("dst"), F.col("vx").alias("v2"))
    pairs = near.select("mid", F.col("x").alias("src"), F.col("vx").alias("v1")).join(cand, "mid").where("src <> dst")
    pairs = pairs.join(keep.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "mid", D.distance(metric, F.col("v1"), F.col("v2")).alias("dist"))
    best = F.row_number().over(Window.partitionBy("src", "mid").orderBy("dist", "dst"))
    fill = pairs.withColumn("nth", best).where(F.col("nth") <= per_dead).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    have = keep.groupBy("src").agg(F.count(F.lit(1)).alias("have"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    fill = cut(fill.withColumn("nth", place).join(have, "src", "left").where(F.col("nth") + F.coalesce("have", F.lit(0)) <= max_degree).select("src", "dst", "dist"))
    n_before, n_keep, n_fill = e.count(), keep.count(), fill.count()
    counts = {"edges_before": n_before, "edges_removed": n_before - n_keep, "edges_added": n_fill, "endpoints": around.select("x").distinct().count(), "candidates": pairs.count()}
    return slotted(keep.unionByName(fill)), counts


def reconnected(edges: DataFrame, points: DataFrame, labels: DataFrame, max_degree: int, metric: str = "l2") -> DataFrame:
    """Edges after the records ``labels`` came or moved: what touched them goes, they and their former neighbours are searched anew."""
    from .graph import cut

    moved = labels.select("label").distinct()
    a, b = moved.withColumnRenamed("label", "src"), moved.withColumnRenamed("label", "dst")
    before = edges.join(b, "dst", "left_semi").select(F.col("src").alias("label")).union(edges.join(a, "src", "left_semi").select(F.col("dst").alias("label")))
    nodes = cut(moved.union(before).distinct())
    rest = edges.join(a, "src", "left_anti").join(b, "dst", "left_anti").select(*edges.columns)
    return repaired(cut(rest), points, nodes, max_degree, metric)


def repaired(edges: DataFrame, points: DataFrame, nodes: DataFrame, max_degree: int, metric: str = "l2") -> DataFrame:
    """Edges after the live ones of ``nodes`` (label) were searched anew and connected both ways.

    Their old edges give way to diverse ones among their ``2 * max_degree``
    nearest live points; a neighbour that has more than ``max_degree`` edges
    then is pruned over its live ones.
    """
    from .graph import cut, rng_pruned, slotted
    from .knn import knn

    live = points.where(~F.col("deleted"))
    who = live.join(nodes.select("label").distinct(), "label", "left_semi")
    near = knn(live, who.select(F.col("label").alias("qid"), "vector"), 2 * max_degree, metric, self_excluded=True)
    near = near.select(F.col("qid").alias("src"), F.col("label").alias("dst"), "dist")
    new = cut(rng_pruned(near, live, max_degree, metric).select("src", "dst", "dist"))
    rest = edges.select("src", "dst", "dist").join(who.select(F.col("label").alias("src")), "src", "left_anti")
    back = new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    every = cut(rest.unionByName(new).unionByName(back).groupBy("src", "dst").agg(F.min("dist").alias("dist")))
    full = cut(every.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_degree).join(back.select("src").distinct(), "src", "left_semi").select("src"))
    pruned = rng_pruned(every.join(full, "src", "left_semi"), live, max_degree, metric).select("src", "dst", "dist")
    return slotted(every.join(full, "src", "left_anti").unionByName(pruned))


def repair_nodes(edges: DataFrame, points: DataFrame, ratio: float = 0.10) -> DataFrame:
    """(label) of the repair candidates and of live points without any edge."""
    alone = points.where(~F.col("deleted")).select("label").join(edges.select(F.col("src").alias("label")), "label", "left_anti")
    return repair_candidates(edges, points, ratio).select("label").unionByName(alone)


def maintenance_action(ratio: Column, new_deletes: Column, patch: float = 0.20, rebuild: float = 0.50, least: int = 100_000) -> Column:
    """``rebuild``, ``patch`` or ``none`` by the share of tombstones and the deletions since the last time."""
    return F.when(ratio >= rebuild, "rebuild").when((ratio >= patch) & (new_deletes >= least), "patch").otherwise("none")


def entry_point(points: DataFrame, level: str = "level") -> DataFrame:
    """One row: the live record of the highest level, the smallest label of those."""
    order = F.struct((-F.col(level)).alias("l"), "label")
    return points.where(~F.col("deleted")).agg(F.min(order).alias("e")).select(F.col("e.label").alias("label"), (-F.col("e.l")).alias("level"))


def rebuilt(points: DataFrame) -> DataFrame:
    """Live records only, as a rebuild starts from."""
    return points.where(~F.col("deleted"))


def cleaned_markers(edges: DataFrame, points: DataFrame, bits: int) -> DataFrame:
    """Edge Markers computed anew from live records, so bits that only deleted ones supported are gone."""
    from .graph import marker_edges

    live = points.where(~F.col("deleted"))
    return marker_edges(scrubbed(edges, points), live, bits)
