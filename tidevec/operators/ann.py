"""Approximate search over clusters: k-means, representatives, probing and Marker pruning.

A clustered table is the index: points carry ``cluster_id``; a small table holds
each cluster's centroid, size and the union of its records' Markers.  A query
probes the nearest clusters whose Markers pass its predicate and searches
them exactly, so predicates and tombstones hold without exception and only
recall is approximate.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codebook as C
from ..functions import distance as D
from ..functions import markers as M
from ..functions.predicates import disjunction
from ..schema import NUMERIC, IndexConfig, SearchConfig
from .knn import BLOCK_QUERIES, CHUNK_ROWS, OUT, Nearest, _frame, ranked

#: Rows that k-means is trained on at most, per centroid.
TRAIN_PER_CENTROID = 256


@dataclass
class ClusterIndex:
    """A clustered table with its codebook and its table of clusters."""

    points: DataFrame  # label, vector, a0, a1, ..., deleted, cluster_id, cluster_dist, m0, m1, ...
    clusters: DataFrame  # cluster_id, centroid, n, live, m0, m1, ..., representative
    books: list  # of each attribute: slot starts (numeric) or slots by label
    cfg: IndexConfig
    bits: int

    @property
    def starts(self) -> list[int]:
        """Slot starts of the first numeric attribute."""
        return next((b for b in self.books if not isinstance(b, dict)), [])

    @property
    def mapping(self) -> dict[int, int]:
        """Slots by label of the first label attribute."""
        return next((b for b in self.books if isinstance(b, dict)), {})


def kmeans(points: DataFrame, k: int, seed: int = 1234, max_iter: int = 25) -> np.ndarray:
    """Centroids (k, dim), trained on a bounded sample of TRAIN_PER_CENTROID rows a centroid."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = points.count()
    k = max(1, min(k, n))
    if k == 1:
        dim = F.posexplode("vector").alias("i", "x")
        mean = points.select(dim).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("i").collect()  # one row a component
        return np.array([[r["x"] for r in mean]], np.float64)
    most = TRAIN_PER_CENTROID * k
    train = points if n <= most else points.where(F.pmod(F.xxhash64("label", F.lit(seed)), F.lit(n)) < most)
    rows = train.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="features").fit(rows)
    return np.array(model.clusterCenters())


def assigned(points: DataFrame, centroids: np.ndarray, metric: str = "l2") -> DataFrame:
    """``points`` with cluster_id and cluster_dist: the nearest centroid, ties to the smaller id.

    The centroids number about 4 * sqrt(rows) and are sent to the tasks.
    """
    sent = points.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))

    @F.pandas_udf("cluster_id int, cluster_dist double")
    def nearest(vectors):
        ids, dists = [], []
        for a in range(0, len(vectors), 4096):
            x = np.stack(vectors.iloc[a : a + 4096]).astype(np.float64)
            d = D.rough(metric, x, sent.value)
            near = d.min(axis=1)[:, None] + 1e-9 * (1 + np.abs(d).max()) + D.rounding(metric, x, sent.value)
            for i, row in enumerate(d <= near):
                cand = np.flatnonzero(row)
                e = D.exact_pairs(metric, np.broadcast_to(x[i], (len(cand), x.shape[1])), sent.value[cand])
                j = int(np.lexsort((cand, e))[0])
                ids.append(int(cand[j]))
                dists.append(float(e[j]))
        return pd.DataFrame({"cluster_id": pd.Series(ids, dtype="int32"), "cluster_dist": pd.Series(dists, dtype="float64")})

    return points.withColumn("c", nearest("vector")).select(*points.columns, "c.cluster_id", "c.cluster_dist")


def probing(points: DataFrame, centroids: np.ndarray, nprobe: int, metric: str = "l2") -> DataFrame:
    """``points`` with probes: the ids of the ``nprobe`` nearest centroids, nearest first."""
    sent = points.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))

    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        out: list = []
        for a in range(0, len(vectors), 4096):
            d = D.rough(metric, np.stack(vectors.iloc[a : a + 4096]).astype(np.float64), sent.value)
            out += list(np.argsort(d, axis=1, kind="stable")[:, :nprobe].astype(np.int32))
        return pd.Series(out)

    return points.withColumn("probes", near("vector"))


def representatives(points: DataFrame) -> DataFrame:
    """(cluster_id, representative): the record nearest to its centroid, ties to the smaller label."""
    return points.groupBy("cluster_id").agg(F.min(F.struct("cluster_dist", "label"))["label"].alias("representative"))


def codebooks(points: DataFrame, cfg: IndexConfig) -> list:
    """Of each attribute: slot starts of a number, slots by label of a label set."""
    return [
        C.numeric_starts(points, f"a{i}", cfg.ft_bits) if kind == NUMERIC else C.map_of(C.label_slots(points, f"a{i}", cfg.ft_bits))
        for i, kind in enumerate(cfg.attr_types)
    ]


def build(points: DataFrame, cfg: IndexConfig, n_clusters: int | None = None, books: list | None = None) -> ClusterIndex:
    """Cluster, encode Markers and summarise: points (label, vector, a0, a1, ..., deleted) with the attributes of ``cfg``.

    A codebook that is given is kept, so that records keep their slots.
    """
    n = points.count()
    k = n_clusters or max(1, min(n, int(math.sqrt(n)) * 4))
    books = books if books is not None else codebooks(points, cfg)
    return summarise(marked(assigned(points, kmeans(points, k), cfg.space), books, cfg.ft_bits), books, cfg, cfg.ft_bits)


def marked(points: DataFrame, books: list, bits: int) -> DataFrame:
    """``points`` with a Marker m0, m1, ... of each attribute."""

    def slots(c: Column, book) -> Column:
        return F.transform(c, lambda x: C.label_slot(x, book)) if isinstance(book, dict) else F.array(C.numeric_slot(c, book))

    return points.withColumns({f"m{i}": M.encode(slots(F.col(f"a{i}"), book), bits) for i, book in enumerate(books)}) if books else points


def summarise(rows: DataFrame, books: list, cfg: IndexConfig, bits: int) -> ClusterIndex:
    live = ~F.col("deleted")
    clusters = rows.groupBy("cluster_id").agg(
        F.array(*[F.avg(F.get("vector", i)) for i in range(cfg.dim)]).alias("centroid"),
        F.count(F.lit(1)).alias("n"), F.count_if(live).alias("live"),
        *[M.merged_agg(F.when(live, F.col(f"m{i}")), bits).alias(f"m{i}") for i in range(len(books))],
        F.min(F.struct("cluster_dist", "label"))["label"].alias("representative"),
    )
    return ClusterIndex(rows, clusters, books, cfg, bits)


def fingerprint(points: DataFrame, cfg: IndexConfig, n_clusters: int | None) -> str:
    """What a kept clustering depends on: the rows, whatever their order, and the settings."""
    h = F.xxhash64("label", "vector", *[f"a{i}" for i in range(len(cfg.attr_types))], "deleted")
    r = points.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return f"{list(r)} {cfg.manifest()} {n_clusters}"


def kept(points: DataFrame, cfg: IndexConfig, path: str, n_clusters: int | None = None) -> ClusterIndex:
    """``build``, or what an earlier call left under ``path`` for the same rows and settings."""
    spark = points.sparkSession
    mark = fingerprint(points, cfg, n_clusters)
    try:
        meta = json.loads(spark.read.text(f"{path}/identity").first()["value"])
    except AnalysisException:
        meta = {}
    if meta.get("fingerprint") != mark:
        index = build(points, cfg, n_clusters)
        index.points.write.mode("overwrite").parquet(f"{path}/points")
        meta = {"fingerprint": mark, "books": books_out(index.books), "bits": index.bits}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/identity")
    return summarise(spark.read.parquet(f"{path}/points"), books_in(meta["books"]), cfg, meta["bits"])


def books_out(books: list) -> list:
    """Codebooks as JSON holds them."""
    return [{"labels": sorted(b.items())} if isinstance(b, dict) else {"starts": [int(x) for x in b]} for b in books]


def books_in(kept: list) -> list:
    return [{int(a): int(b) for a, b in x["labels"]} if "labels" in x else list(x["starts"]) for x in kept]


def probes(index: ClusterIndex, queries: DataFrame, search: SearchConfig, terms: list | None = None, modes: list | None = None) -> DataFrame:
    """(qid, cluster_id): the clusters each query looks into.

    Clusters whose Markers refuse the predicate go last; with routing, the
    nearest ``min_clusters`` are looked into even so.  The clusters are sent to
    the queries, which can be any number.
    """
    passes = F.lit(True)
    if terms is not None and search.use_markers:
        passes = M.gate(terms, index.books, index.bits, modes)
    c = index.clusters.select("cluster_id", "centroid", passes.alias("passes"))
    q = queries.select("qid", F.col("vector").alias("qv"))
    d = D.distance(index.cfg.space, F.col("qv"), F.col("centroid"))
    pairs = q.crossJoin(F.broadcast(c)).select("qid", "cluster_id", "passes", d.alias("d"))
    near = Window.partitionBy("qid").orderBy("d", "cluster_id")
    best = Window.partitionBy("qid", "passes").orderBy("d", "cluster_id")
    pairs = pairs.withColumn("nth", F.row_number().over(near)).withColumn("nth_ok", F.row_number().over(best))
    chosen = F.col("passes") & (F.col("nth_ok") <= search.nprobe)
    if search.routing and terms is not None:
        chosen = chosen | (F.col("nth") <= search.min_clusters)
    return pairs.where(chosen).select("qid", "cluster_id")


def search(index: ClusterIndex, queries: DataFrame, k: int = 10, config: SearchConfig = SearchConfig(), terms: list | None = None, modes: list | None = None) -> DataFrame:
    """(qid, rk, label, dist): exact search inside the probed clusters, live and matching records only."""
    live = index.points.where(~F.col("deleted"))
    if terms is not None:
        live = live.where(disjunction(terms, modes, index.cfg.attr_types))
    chosen = probes(index, queries, config, terms, modes)
    visits = chosen.join(queries.select("qid", F.col("vector").alias("qv")), "qid").withColumnRenamed("cluster_id", "c")
    return ranked(in_blocks(live.select(F.col("cluster_id").alias("c"), "label", "vector"), visits, index.cfg.space, k), k)


def in_blocks(rows: DataFrame, visits: DataFrame, metric: str, k: int, self_excluded: bool = False) -> DataFrame:
    """(qid, label, dist): the ``k`` best rows of each block for the ``visits`` (c, qid, qv) of its cluster; rows are (c, label, vector).

    A cluster's rows and visits are dealt to as many blocks as their numbers
    ask for, each pair of which is one group; a pair sends on ``k`` rows a query at most.
    """
    rows, visits = rows.withColumn("c", F.col("c").cast("long")), visits.withColumn("c", F.col("c").cast("long"))
    size = rows.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * CHUNK_ROWS)).cast("int").alias("pn"))
    asked = visits.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_QUERIES)).cast("int").alias("qn"))
    plan = size.join(asked, "c")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ps = rows.join(plan, "c").withColumn("pb", F.pmod(F.xxhash64("label"), F.col("pn")).cast("int")).withColumn("qb", upto("qn"))
    qs = visits.join(plan, "c").withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("qn")).cast("int")).withColumn("pb", upto("pn"))

    def pair(key: tuple, qpdf: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(qpdf) or not len(pdf):
            return _frame([])
        best = Nearest(qpdf["qid"].to_numpy(), np.stack(qpdf["qv"]).astype(np.float64), metric, k, self_excluded)
        best.add(pdf["label"].to_numpy(), np.stack(pdf["vector"]))
        return pd.DataFrame(dict(zip(("qid", "label", "dist"), best.rows())))

    qs, ps = qs.select("c", "qb", "pb", "qid", "qv"), ps.select("c", "qb", "pb", "label", "vector")
    return qs.groupBy("c", "qb", "pb").cogroup(ps.groupBy("c", "qb", "pb")).applyInPandas(pair, OUT)


def estimated_rows(index: ClusterIndex, terms: list, modes: list | None = None) -> DataFrame:
    """(cluster_id, estimate): an upper estimate of matching rows by the records' Markers, summed over terms."""
    out = F.lit(0)
    for i, t in enumerate(terms):
        out = out + F.count_if(M.term_gate(t, index.books, index.bits, modes[i] if modes else None) & ~F.col("deleted"))
    return index.points.groupBy("cluster_id").agg(out.alias("estimate"))
