"""Proximity graphs as edge tables: building, pruning, diagnostics, augmentation.

An edge is (src, dst, slot, dist); slots of a source are numbered from 0,
nearest first.  Traversals are loops of joins whose state is written between
rounds; they go on until nothing changes, unless a number of rounds is asked for.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..shared import shared_dir
from .knn import knn, matrix, ranked

EDGE = "src long, dst long, slot int, dist double"
#: Entry points that all queries start from, at most; seeds of each query's own have no such bound.
MAX_ENTRIES = 1024
#: Pairs whose distances are computed at once.
PAIRS = 1 << 14


def spread_entries(points: DataFrame) -> DataFrame:
    """(label) of about sqrt(rows) points picked by hash, half of MAX_ENTRIES at most: entries to every part of a graph."""
    n = points.count()
    h = F.xxhash64("label")
    first = points.orderBy(h, "label").limit(1).select("label")
    share = max(1, int(n**0.5), -(-2 * n // MAX_ENTRIES))
    return first.union(points.where(F.pmod(h, F.lit(share)) == 0).select("label")).distinct()


def markers_of(df: DataFrame) -> list[str]:
    """The Marker columns m0, m1, ... of a table."""
    return [c for c in df.columns if re.fullmatch(r"m\d+", c)]


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def slotted(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Edges (src, dst, dist) numbered per source by (dist, dst), at most ``most`` each."""
    slot = (F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst")) - 1).cast("int")
    out = edges.select("src", "dst", "dist").withColumn("slot", slot)
    if most is not None:
        out = out.where(F.col("slot") < most)
    return out.select("src", "dst", "slot", "dist")


def knn_graph(points: DataFrame, m: int, metric: str = "l2") -> DataFrame:
    """Each point's ``m`` nearest others."""
    q = points.select(F.col("label").alias("qid"), "vector")
    near = knn(points, q, m, metric, self_excluded=True)
    return near.select(F.col("qid").alias("src"), F.col("label").alias("dst"), (F.col("rk") - 1).cast("int").alias("slot"), "dist")


def rng_pruned(edges: DataFrame, points: DataFrame, most: int, metric: str = "l2", quota: int | None = None, slots: Column | None = None) -> DataFrame:
    """Of each source's edges, nearest first, those that no kept neighbour dominates.

    A candidate goes if some kept neighbour is nearer to it than the source is.
    With ``quota`` and ``slots`` (an array of the destination's slots) a
    candidate is also refused once a third of ``most`` is kept and all its
    slots are held ``quota`` times.  Many sources are worked on at once; a
    source's candidates are bounded by its degree, so a group is small.
    """
    v = points.select(F.col("label").alias("dst"), "vector", (slots if slots is not None else F.array().cast("array<int>")).alias("slots"))
    rows = edges.select("src", "dst", "dist").join(v, "dst").repartition("src").sortWithinPartitions("src", "dist", "dst")

    def prune(src: np.ndarray, dst: np.ndarray, dist: np.ndarray, x: np.ndarray, held_by: list | None) -> pa.RecordBatch:
        """The kept rows of whole groups, all at once: each round keeps every group's first candidate and drops what it dominates."""
        first = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(src))))
        alive, slot = np.ones(len(src), bool), np.full(len(src), -1, np.int32)
        count, place = np.zeros(len(first), np.int32), np.arange(len(src))
        held: list[dict[int, int]] = [{} for _ in first] if quota is not None else []
        while True:
            lead = np.minimum.reduceat(np.where(alive, place, len(src)), first)
            on = np.flatnonzero((lead < len(src)) & (count < most))
            if not len(on):
                break
            alive[lead[on]] = False
            if quota is not None:
                fine = np.ones(len(on), bool)
                for i, g in enumerate(on):
                    own = held_by[lead[g]]
                    fine[i] = not (own and 3 * count[g] >= most and all(held[g].get(s, 0) >= quota for s in own))
                    if fine[i]:
                        for s in own:
                            held[g][s] = held[g].get(s, 0) + 1
                on = on[fine]
            slot[lead[on]] = count[on]
            count[on] += 1
            by = np.full(len(first), -1)
            by[on] = lead[on]
            rest = np.flatnonzero(alive & (by[group] >= 0) & (count[group] < most))
            for a in range(0, len(rest), PAIRS):
                r = rest[a : a + PAIRS]
                alive[r] = ~(D.exact_pairs(metric, x[r], x[by[group[r]]]) < dist[r])
        kept = slot >= 0
        return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (src, dst, slot, dist)], ["src", "dst", "slot", "dist"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["src", "dst", "dist"]
        held: list[tuple] = []
        for batch in it:
            if not batch.num_rows:
                continue
            part = (*[batch.column(c).to_numpy() for c in names], matrix(batch.column("vector")).astype(np.float64), batch.column("slots").to_pylist() if quota is not None else [])
            cut_at = int(np.searchsorted(part[0], part[0][-1]))  # the last group can go on in the next batch
            if cut_at or (held and held[-1][0][-1] != part[0][0]):
                yield prune(*joined([*held, tuple(c[:cut_at] for c in part)]))
                held = []
            held.append(tuple(c[cut_at:] for c in part))
        if held:
            yield prune(*joined(held))

    def joined(parts: list[tuple]) -> tuple:
        return (*[np.concatenate([p[i] for p in parts]) for i in range(4)], [s for p in parts for s in p[4]])

    return rows.select("src", "dst", "dist", "vector", "slots").mapInArrow(run, EDGE)


def connected(edges: DataFrame, points: DataFrame, most: int, metric: str = "l2") -> DataFrame:
    """Edges with their reverses; sources with more than ``most`` are pruned again."""
    both = edges.select("src", "dst", "dist").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).distinct()
    return rng_pruned(both, points, most, metric)


def degrees(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(label, degree) of all points, 0 included."""
    got = edges.groupBy(F.col("src").alias("label")).agg(F.count(F.lit(1)).alias("degree"))
    return points.select("label").join(got, "label", "left").na.fill(0, ["degree"])


def in_degrees(edges: DataFrame, points: DataFrame) -> DataFrame:
    got = edges.groupBy(F.col("dst").alias("label")).agg(F.count(F.lit(1)).alias("degree"))
    return points.select("label").join(got, "label", "left").na.fill(0, ["degree"])


def neighbours(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("src") == node).select("src", "slot", "dst", "dist")


def integrity(edges: DataFrame, points: DataFrame) -> DataFrame:
    """One row: self loops, duplicate edges, points nobody points to, least and largest in-degree."""
    loops = edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_loops"), F.count(F.lit(1)).alias("edges"))
    dup = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    deg = in_degrees(edges, points).agg(F.count_if(F.col("degree") == 0).alias("unreferenced"), F.min("degree").alias("min_in_degree"), F.max("degree").alias("max_in_degree"))
    return loops.crossJoin(dup).crossJoin(deg)


def two_hop(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) over two edges, without the source and its neighbours."""
    a, b = edges.select("src", F.col("dst").alias("mid")), edges.select(F.col("src").alias("mid"), "dst")
    far = a.join(b, "mid").where("src <> dst").select("src", "dst").distinct()
    return far.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def rounds(most: int | None) -> Iterator[int]:
    """1, 2, ... up to ``most``, without an end if that is None."""
    return itertools.count(1) if most is None else iter(range(1, most + 1))


def grown(seen: DataFrame, front: DataFrame, hop: int) -> DataFrame:
    """``seen`` and ``front``; cut now and then, so that a long way doesn't make a long plan."""
    both = seen.unionByName(front.select(*seen.columns))
    return both if hop % 8 else cut(both)


def reachable(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(label, hops) of what ``starts`` (label) reach, breadth first, in up to ``max_hops`` if that is given."""
    seen = starts.select("label").distinct().withColumn("hops", F.lit(0))
    front = seen
    e = edges.select("src", "dst")
    for hop in rounds(max_hops):
        step = e.join(front.select(F.col("label").alias("src")), "src").select(F.col("dst").alias("label")).distinct()
        front = cut(step.join(seen.select("label"), "label", "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = grown(seen, front, hop)
    return seen


def entry_diagnostic(edges: DataFrame, points: DataFrame, entry: DataFrame, n_original: int = 0) -> DataFrame:
    """One row: alive and dead points, new ones, those reached from the entry, mean degree."""
    hit = reachable(edges, entry).select("label", F.lit(1).alias("hit"))
    p = points.join(hit, "label", "left").join(degrees(edges, points), "label")
    alive, new = ~F.col("deleted"), F.col("label") >= n_original
    return p.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(alive).alias("alive"), F.count_if("deleted").alias("dead"),
        F.count_if(alive & new).alias("new_alive"), F.count_if(F.col("deleted") & new).alias("new_dead"),
        F.count_if(alive & F.col("hit").isNotNull()).alias("reachable_alive"), F.avg("degree").alias("mean_degree"),
        F.avg(F.col("deleted").cast("double")).alias("dead_share"),
    )


def partitioned(edges: DataFrame, entries: DataFrame, max_rounds: int | None = None, buckets_each: int = 2) -> DataFrame:
    """(label, bucket): breadth-first growth from all entries at once; a point joins its first ``buckets_each`` buckets."""
    have = entries.select("label", F.col("label").alias("bucket"), F.lit(0).alias("hops"))
    front = have
    e = edges.select("src", "dst")
    for hop in rounds(max_rounds):
        step = front.join(e, front["label"] == e["src"]).select(F.col("dst").alias("label"), "bucket").distinct()
        step = step.join(have.select("label", "bucket"), ["label", "bucket"], "left_anti").withColumn("hops", F.lit(hop))
        full = have.groupBy("label").agg(F.count(F.lit(1)).alias("have"))
        step = step.join(full, "label", "left").withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("bucket")))
        front = cut(step.where(F.col("nth") + F.coalesce("have", F.lit(0)) <= buckets_each).select("label", "bucket", "hops"))
        if front.isEmpty():
            break
        have = grown(have, front, hop)
    return have


def augment_same_label(edges: DataFrame, points: DataFrame, min_same: int = 8, max_hops: int = 3, most_common: float = 0.5, max_degree: int | None = None) -> DataFrame:
    """Added edges (src, dst, item, hops) so that points have ``min_same`` neighbours of each of their labels.

    Labels of more than ``most_common`` of the points are left alone.  Points
    two or up to ``max_hops`` edges away that have the label too are taken,
    nearest in hops first, then by label.  With ``max_degree`` a source takes
    no more than its free places, rarest labels first; ``with_added`` puts the result into the edges.
    """
    n = points.count()
    lists = points.select("label", F.explode("a1").alias("item"))
    rare = lists.groupBy("item").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") <= most_common * n)
    lists = lists.join(rare, "item")
    dst_lists = lists.select(F.col("label").alias("dst"), "item", "often")
    now = edges.select("src", "dst").join(dst_lists, "dst").groupBy("src", "item").agg(F.count(F.lit(1)).alias("have"))
    need = lists.select(F.col("label").alias("src"), "item").join(now, ["src", "item"], "left").na.fill(0, ["have"])
    need = need.withColumn("need", F.lit(min_same) - F.col("have")).where("need > 0")
    near = edges.select("src", "dst").withColumn("hops", F.lit(1))
    step = near
    for hop in range(2, max_hops + 1):
        far = step.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid")
        far = far.where("src <> dst").select("src", "dst").distinct().join(near.select("src", "dst"), ["src", "dst"], "left_anti")
        step = cut(far.withColumn("hops", F.lit(hop)))
        near = near.unionByName(step)
    cand = near.where("hops > 1").join(dst_lists, "dst").join(need.select("src", "item", "need"), ["src", "item"])
    nth = F.row_number().over(Window.partitionBy("src", "item").orderBy("hops", "dst"))
    out = cand.withColumn("nth", nth).where(F.col("nth") <= F.col("need"))
    if max_degree is not None:
        have = edges.groupBy("src").agg(F.count(F.lit(1)).alias("have"))
        place = F.dense_rank().over(Window.partitionBy("src").orderBy("first", "dst"))
        first = F.min(F.struct("often", "item", "nth")).over(Window.partitionBy("src", "dst"))
        out = out.withColumn("first", first).withColumn("place", place).join(have, "src", "left").where(F.col("place") + F.coalesce("have", F.lit(0)) <= max_degree)
    return out.select("src", "dst", "item", "hops")


def with_added(edges: DataFrame, added: DataFrame, points: DataFrame, metric: str = "l2") -> DataFrame:
    """Edges (src, dst, slot, dist) with ``added`` (src, dst, ...) among them, at their distances."""
    new = added.select("src", "dst").distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    a = points.select(F.col("label").alias("src"), F.col("vector").alias("v1"))
    b = points.select(F.col("label").alias("dst"), F.col("vector").alias("v2"))
    new = new.join(a, "src").join(b, "dst").select("src", "dst", D.distance(metric, F.col("v1"), F.col("v2")).alias("dist"))
    return slotted(edges.select("src", "dst", "dist").unionByName(new))


def augment_by_marker(edges: DataFrame, points: DataFrame, min_same: int = 4, max_hops: int = 3, max_degree: int = 32) -> DataFrame:
    """All edges, with up to ``min_same`` neighbours that cover the source's own Markers (columns m0, m1, ...).

    Missing ones come from up to ``max_hops`` edges away; where a source is full, its farthest other edges give way.
    """
    from ..functions.markers import covers

    ms = markers_of(points)
    src = points.select(F.col("label").alias("src"), *[F.col(m).alias(f"own_{m}") for m in ms])
    dst = points.select(F.col("label").alias("dst"), *ms, "vector")
    hold = reduce(lambda a, b: a & b, [covers(F.col(m), F.col(f"own_{m}")) for m in ms], F.lit(True))
    own = lambda df: df.join(src, "src").join(dst, "dst").where(hold)
    same = own(edges.select("src", "dst", "dist")).select("src", "dst", "dist", F.lit(1).alias("same"))
    have = same.groupBy("src").agg(F.count(F.lit(1)).alias("have"))
    near = edges.select("src", "dst")
    step = near
    found = None
    for _ in range(2, max_hops + 1):
        far = step.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid")
        step = cut(far.where("src <> dst").select("src", "dst").distinct().join(near, ["src", "dst"], "left_anti"))
        near = near.unionByName(step)
        found = step if found is None else found.unionByName(step)
    q = points.select(F.col("label").alias("src"), F.col("vector").alias("qv"))
    cand = own(found).join(q, "src").withColumn("dist", D.l2(F.col("qv"), F.col("vector"))).join(have, "src", "left").na.fill(0, ["have"])
    nth = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    added = cand.withColumn("nth", nth).where(F.col("nth") + F.col("have") <= min_same).select("src", "dst", "dist", F.lit(1).alias("same"))
    rest = edges.select("src", "dst", "dist").join(same.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("same", F.lit(0))
    every = same.unionByName(added).unionByName(rest)
    keep = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("same"), "dist", "dst"))
    return slotted(every.withColumn("nth", keep).where(F.col("nth") <= max_degree))


def augment_cht(edges: DataFrame, points: DataFrame, max_degree: int, efc: int = 64, quota: int = 16, slots: Column | None = None, metric: str = "l2") -> DataFrame:
    """Points below ``max_degree`` get diverse, slot-balanced neighbours from a wide exact search, and their reverses."""
    open_ = degrees(edges, points).where(F.col("degree") < max_degree).select("label")
    q = points.join(open_, "label").select(F.col("label").alias("qid"), "vector")
    wide = knn(points, q, efc, metric, self_excluded=True).select(F.col("qid").alias("src"), F.col("label").alias("dst"), "dist")
    new = wide.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    picked = rng_pruned(new, points, max_degree, metric, quota, slots).select("src", "dst", "dist", F.lit(1).alias("new"))
    back = picked.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist", "new").join(open_.withColumnRenamed("label", "src"), "src", "left_semi")
    every = edges.select("src", "dst", "dist", F.lit(0).alias("new")).unionByName(picked).unionByName(back)
    every = every.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("new").alias("new"))
    keep = F.row_number().over(Window.partitionBy("src").orderBy("new", "dist", "dst"))
    return slotted(every.withColumn("nth", keep).where(F.col("nth") <= max_degree))


def voronoi(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(label, region, hops): the seed that reaches each point first, ties to the smaller seed."""
    best = seeds.select("label", F.col("label").alias("region"), F.lit(0).alias("hops"))
    front = best
    e = edges.select("src", "dst")
    for hop in rounds(max_rounds):
        step = front.join(e, front["label"] == e["src"]).groupBy(F.col("dst").alias("label")).agg(F.min("region").alias("region"))
        front = cut(step.join(best.select("label"), "label", "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        best = grown(best, front, hop)
    return best


def bridges(edges: DataFrame, regions: DataFrame, k: int = 4) -> DataFrame:
    """(region, other, src, dst, cost): the shortest bridge of each pair of regions, for each region's ``k`` nearest."""
    a = regions.select(F.col("label").alias("src"), F.col("region").alias("r1"), F.col("hops").alias("h1"))
    b = regions.select(F.col("label").alias("dst"), F.col("region").alias("r2"), F.col("hops").alias("h2"))
    pairs = edges.select("src", "dst").join(a, "src").join(b, "dst").where("r1 <> r2").withColumn("cost", F.col("h1") + F.col("h2") + 1)
    best = pairs.groupBy(F.col("r1").alias("region"), F.col("r2").alias("other")).agg(F.min(F.struct("cost", "src", "dst")).alias("b"))
    nth = F.row_number().over(Window.partitionBy("region").orderBy("b.cost", "other"))
    return best.withColumn("nth", nth).where(F.col("nth") <= k).select("region", "other", "b.src", "b.dst", "b.cost")


def coloured(edges: DataFrame, regions: DataFrame, links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(src, dst): edges on the paths from the seeds over the bridges, which get the bit."""
    tree = edges.select("src", "dst").join(regions.select(F.col("label").alias("src"), F.col("region").alias("r1"), F.col("hops").alias("h1")), "src")
    tree = tree.join(regions.select(F.col("label").alias("dst"), F.col("region").alias("r2"), F.col("hops").alias("h2")), "dst").where("r1 = r2 and h2 = h1 + 1")
    up = tree.groupBy("dst").agg(F.min("src").alias("src"))
    out = links.select("src", "dst")
    front = links.select(F.col("src").alias("dst")).union(links.select("dst")).distinct()
    for hop in rounds(max_rounds):
        step = cut(up.join(front, "dst").select("src", "dst").distinct())
        if step.isEmpty():
            break
        out = grown(out, step, hop)
        front = step.select(F.col("src").alias("dst")).distinct()
    return out.distinct()


def diverse_tail(points: DataFrame, seeds: DataFrame, k_top: int, k_tail: int, metric: str = "l2") -> DataFrame:
    """(src, dst, dist): of each seed's ``k_top`` nearest other seeds, pruned for diversity, the ``k_tail`` farthest."""
    among = points.join(seeds.select("label"), "label", "left_semi")
    near = knn(among, among.select(F.col("label").alias("qid"), "vector"), k_top, metric, self_excluded=True)
    kept = rng_pruned(near.select(F.col("qid").alias("src"), F.col("label").alias("dst"), "dist"), points, k_top, metric)
    nth = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("dist"), "dst"))
    return kept.withColumn("nth", nth).where(F.col("nth") <= k_tail).select("src", "dst", "dist")


def near_graph(points: DataFrame, m: int, metric: str = "l2", nprobe: int = 8, per_cluster: int = 256) -> DataFrame:
    """Each point's ``m`` nearest others among the points of its ``nprobe`` nearest clusters: edges without all pairs.

    A point meets about ``nprobe`` clusters' rows, so the work grows with
    rows * sqrt(rows) at most; a large cluster's rows and its visitors are dealt to blocks.
    """
    from . import ann

    n = points.count()
    centroids = ann.kmeans(points, max(1, min(n // per_cluster, int(n**0.5) * 4)))
    rows = cut(ann.probing(points.select("label", "vector"), centroids, nprobe, metric))
    homes = rows.select(F.get("probes", 0).alias("c"), "label", "vector")
    visits = rows.select(F.explode("probes").alias("c"), F.col("label").alias("qid"), F.col("vector").alias("qv"))
    near = ann.in_blocks(homes, visits, metric, m, self_excluded=True)
    return slotted(near.select(F.col("qid").alias("src"), F.col("label").alias("dst"), "dist"), m)


@dataclass
class Layers:
    """A graph of two layers: ``base`` over all points, ``upper`` over those of level 1, and its entry points."""

    base: DataFrame  # src, dst, slot, dist
    upper: DataFrame
    entry: DataFrame  # label


def levels(points: DataFrame, m: int, seed: int = 100) -> DataFrame:
    """(label, level): level 1 for about one point in ``m``, by a hash of label and seed, 0 for the others."""
    return points.select("label", F.when(F.pmod(F.xxhash64("label", F.lit(seed)), F.lit(max(2, m))) == 0, 1).otherwise(0).alias("level"))


def build_layers(points: DataFrame, m: int = 16, ef_construction: int = 64, metric: str = "l2", seed: int = 100, nprobe: int = 8, planned: DataFrame | None = None) -> Layers:
    """Both layers: near candidates, pruned for diversity and connected both ways; ``planned`` can give the levels (label, level).

    The base layer keeps ``2 * m`` edges a point, the upper one ``m``.
    """
    lv = planned if planned is not None else levels(points, m, seed)
    top = cut(points.join(lv.where("level > 0").select("label"), "label", "left_semi"))
    if top.isEmpty():
        top = points.orderBy("label").limit(1)
    layer = lambda p, most, wide: cut(connected(rng_pruned(near_graph(p, wide, metric, nprobe), p, most, metric), p, most, metric))
    base = layer(points, 2 * m, max(2 * m, ef_construction))
    upper = layer(top, m, max(m, ef_construction // 2))
    return Layers(base, upper, cut(spread_entries(top)))


def gated(edges: DataFrame, passes: Column, floor: int = 10) -> DataFrame:
    """The edges that a search under one predicate may walk.

    Those whose Markers pass, and for sources with fewer than ``floor`` of them
    the nearest others up to that number, as routing.  Markers never refuse a
    match, and what is reached is admitted by the exact predicate only.
    """
    order = Window.partitionBy("src").orderBy(F.desc("passes"), "slot")
    marked = edges.withColumn("passes", F.coalesce(passes, F.lit(True)))
    return marked.withColumn("nth", F.row_number().over(order)).where(F.col("passes") | (F.col("nth") <= floor)).drop("nth", "passes")


def search(edges: DataFrame, points: DataFrame, queries: DataFrame, entry: int | DataFrame, k: int = 10, ef: int = 64, metric: str = "l2", predicate: Column | None = None, stats: bool = False) -> DataFrame:
    """Best-first graph search of a batch of queries, as rounds of frontier joins.

    It starts from one point, or from points of a table: (label) for all
    queries or (qid, label) for each.  Each query keeps its ``ef`` best points
    and its ``ef`` best that are live and match ``predicate``; a round expands
    those not expanded yet, tombstones and other points too, as they lead to
    more.  It ends when no query finds a better point.  (qid, rk, label, dist) of
    live, matching points; with ``stats`` also the distances computed and the rounds.
    """
    q = queries.select("qid", F.col("vector").alias("qv"))
    fine = predicate if predicate is not None else F.lit(True)
    if "deleted" in points.columns:
        fine = ~F.col("deleted") & fine
    v = points.select("label", "vector", F.coalesce(fine, F.lit(False)).alias("ok"))
    if isinstance(entry, DataFrame) and "qid" in entry.columns:
        first = entry.select("qid", "label").distinct()
    elif isinstance(entry, DataFrame):
        starts = entry.select("label").distinct()
        if starts.limit(MAX_ENTRIES + 1).count() > MAX_ENTRIES:
            raise ValueError(f"more than {MAX_ENTRIES} entry points for all queries: give each query its own")
        first = queries.select("qid").crossJoin(F.broadcast(starts))
    else:
        first = queries.select("qid", F.lit(entry).cast("long").alias("label"))
    scored = lambda df, hop: df.join(v, "label").join(q, "qid").select("qid", "label", D.distance(metric, F.col("qv"), F.col("vector")).alias("dist"), "ok", F.lit(False).alias("done"), F.lit(hop).alias("hop"))
    best = Window.partitionBy("qid").orderBy("dist", "label")
    best_ok = Window.partitionBy("qid", "ok").orderBy("dist", "label")
    ahead = edges.select("src", F.col("dst").alias("label"))
    new = cut(scored(first, 0))
    pool, counts = new, [new.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))]
    hop = 0
    while True:
        hop += 1
        front = pool.where("not done").select("qid", F.col("label").alias("src"))
        met = front.join(ahead, "src").select("qid", "label").distinct().join(pool.select("qid", "label"), ["qid", "label"], "left_anti")
        new = scored(met, hop)
        if stats:
            new = cut(new)
            counts.append(new.groupBy("qid").agg(F.count(F.lit(1)).alias("n")))
        pool = pool.withColumn("done", F.lit(True)).unionByName(new)
        pool = pool.withColumn("nth", F.row_number().over(best)).withColumn("nth_ok", F.row_number().over(best_ok))
        pool = cut(pool.where((F.col("nth") <= ef) | (F.col("ok") & (F.col("nth_ok") <= max(ef, k)))).drop("nth", "nth_ok"))
        if pool.where("not done").isEmpty():
            break
    out = pool.where("ok").withColumn("rk", F.row_number().over(best).cast("long")).where(F.col("rk") <= k).select("qid", "rk", "label", "dist")
    if not stats:
        return out
    every = reduce(DataFrame.unionByName, counts).groupBy("qid").agg(F.sum("n").alias("n_distances"))
    return out.join(every, "qid").withColumn("hops", F.lit(hop))


def descend(layers: Layers, points: DataFrame, queries: DataFrame, ef_top: int = 4, metric: str = "l2") -> DataFrame:
    """(qid, label): each query's ``ef_top`` best points of the upper layer, found from the entry point."""
    bare = points.select("label", "vector")
    return search(layers.upper, bare, queries, layers.entry, ef_top, max(ef_top, 8), metric).select("qid", "label")


def layered_search(
    layers: Layers, points: DataFrame, queries: DataFrame, k: int = 10, ef: int = 64, metric: str = "l2",
    predicate: Column | None = None, gate: Column | None = None, floor: int = 10, ef_top: int = 4, stats: bool = False,
) -> DataFrame:
    """Search of both layers: seeds from the upper one, then the base layer's edges, those that ``gate`` (over m0, m1) lets through."""
    base = layers.base if gate is None else cut(gated(layers.base, gate, floor))
    return search(base, points, queries, descend(layers, points, queries, ef_top, metric), k, ef, metric, predicate, stats)


def two_hop_scan(edges: DataFrame, points: DataFrame, queries: DataFrame, found: DataFrame, k: int = 10, metric: str = "l2", predicate: Column | None = None) -> DataFrame:
    """(qid, rk, label, dist): ``found`` (qid, label) and all that is up to two edges from it, scored and admitted exactly."""
    ahead = edges.select(F.col("src").alias("label"), "dst")
    one = found.select("qid", "label").join(ahead, "label").select("qid", F.col("dst").alias("label"))
    two = one.distinct().join(ahead, "label").select("qid", F.col("dst").alias("label"))
    every = found.select("qid", "label").union(one).union(two).distinct()
    fine = predicate if predicate is not None else F.lit(True)
    live = points.where((~F.col("deleted") & fine) if "deleted" in points.columns else fine).select("label", "vector")
    pairs = every.join(live, "label").join(queries.select("qid", F.col("vector").alias("qv")), "qid")
    return ranked(pairs.select("qid", "label", D.distance(metric, F.col("qv"), F.col("vector")).alias("dist")), k)


def marker_edges(edges: DataFrame, points: DataFrame, bits: int) -> DataFrame:
    """Edges with the Markers of what lies behind them: the destination's and its neighbours' bits, for every attribute."""
    from ..functions.markers import merged, merged_agg

    ms = markers_of(points)
    m = points.select(F.col("label").alias("dst"), *ms)
    behind = edges.select("src", "dst").join(m, "dst").groupBy(F.col("src").alias("dst")).agg(*[merged_agg(F.col(c), bits).alias(f"behind_{c}") for c in ms])
    out = edges.join(m, "dst").join(behind, "dst", "left")
    return out.select("src", "dst", "slot", "dist", *[merged(F.col(c), F.coalesce(f"behind_{c}", c)).alias(c) for c in ms])


def painted(marked: DataFrame, paths: DataFrame, column: str, bits: int, slot: int) -> DataFrame:
    """``marked`` edges with the bit of ``slot`` set in Marker ``column`` along ``paths`` (src, dst), both ways, as colouring ends."""
    from ..functions.markers import literal, merged

    on = paths.select("src", "dst").union(paths.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("__on", F.lit(True))
    word = F.array(*[F.lit(x).cast("long") for x in literal([slot], bits)])
    out = marked.join(on, ["src", "dst"], "left")
    return out.select(*[F.when(F.col("__on"), merged(F.col(column), word)).otherwise(F.col(column)).alias(column) if c == column else F.col(c) for c in marked.columns])


def coloured_by_voronoi(marked: DataFrame, points: DataFrame, column: str, bits: int, slot: int, k: int = 4) -> DataFrame:
    """``marked`` edges after the colouring of one bit: the regions around its holders, their bridges, the paths over them."""
    holder = F.get(F.col(column), slot // 63).bitwiseAND(F.lit(1 << (slot % 63)).cast("long")) != 0
    seeds = points.where(holder).select("label")
    regions = cut(voronoi(marked, seeds))
    return painted(marked, coloured(marked, regions, bridges(marked, regions, k)), column, bits, slot)


def coloured_by_tail(marked: DataFrame, points: DataFrame, column: str, bits: int, slot: int, k_top: int, k_tail: int, metric: str = "l2", max_hops: int = 3) -> DataFrame:
    """``marked`` edges after the colouring of one bit towards each holder's diverse tail: edges on shortest ways of up to ``max_hops`` between the two."""
    holder = F.get(F.col(column), slot // 63).bitwiseAND(F.lit(1 << (slot % 63)).cast("long")) != 0
    tails = diverse_tail(points, points.where(holder).select("label"), k_top, k_tail, metric).select("src", F.col("dst").alias("goal"))
    e = marked.select("src", "dst")
    step = tails.select("src", "goal", F.col("src").alias("at"), F.array("src").alias("way"))
    paths = None
    for _ in range(max_hops):
        ahead = step.join(e.select(F.col("src").alias("at"), "dst"), "at")
        way = ahead.where(~F.array_contains("way", F.col("dst"))).select("src", "goal", F.col("dst").alias("at"), F.concat("way", F.array("dst")).alias("way"))
        way = cut(way.groupBy("src", "goal", "at").agg(F.min("way").alias("way")))  # one way to each point
        done = way.where("at = goal").select("src", "goal", "way")
        paths = done if paths is None else paths.unionByName(done.join(paths.select("src", "goal"), ["src", "goal"], "left_anti"))
        step = way.where("at <> goal").join(done.select("src", "goal"), ["src", "goal"], "left_anti")
    pairs = paths.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("way") - 2), lambda i: F.struct(F.get("way", i).alias("src"), F.get("way", i + 1).alias("dst")))).alias("p"))
    return painted(marked, pairs.select("p.src", "p.dst"), column, bits, slot)


def build_counters(wide: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: candidate edges, those kept and refused by pruning, sources, mean kept degree."""
    n = wide.agg(F.count(F.lit(1)).alias("candidates"))
    k = kept.agg(F.count(F.lit(1)).alias("kept"), F.count_distinct("src").alias("sources"))
    both = n.crossJoin(k)
    return both.select("candidates", "kept", (F.col("candidates") - F.col("kept")).alias("pruned"), "sources", F.coalesce(F.try_divide(F.col("kept").cast("double"), F.col("sources").cast("double")), F.lit(0.0)).alias("mean_degree"))
