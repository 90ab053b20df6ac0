"""The layered graph: candidates of near clusters, filtered search, many attributes, a graph in step with its records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidevec.functions import markers as M
from tidevec.functions import predicates as P
from tidevec.operators import ann, evaluate, graph, knn, mutate
from tidevec.plans.index import VectorIndex
from tidevec.schema import IndexConfig

N, DIM = 1500, 8
TYPES = (0, 0, 1)
R = np.random.default_rng(7)
X = R.normal(size=(N, DIM)).astype(np.float32)
A0, A1 = R.integers(0, 100, N), R.integers(0, 1000, N)
A2 = [sorted(set(R.integers(0, 6, 2).tolist())) for _ in range(N)]
DEAD = R.random(N) < 0.1
CFG = IndexConfig(dim=DIM, M=8, ef_construction=32, ft_bits=256, attr_types=TYPES, max_cate_size=6)
TERMS = [[[10, 60], [], [2]], [[], [0, 400], [1, 3]]]
KIND = "label long, vector array<float>, a0 int, a1 int, a2 array<int>, deleted boolean"


def matching(i):
    return (10 <= A0[i] <= 60 and 2 in A2[i]) or (A1[i] <= 400 and {1, 3} <= set(A2[i]))


@pytest.fixture(scope="module")
def pts(spark):
    return spark.createDataFrame([(i, X[i].tolist(), int(A0[i]), int(A1[i]), [int(x) for x in A2[i]], bool(DEAD[i])) for i in range(N)], KIND).cache()


@pytest.fixture(scope="module")
def qs(spark):
    return spark.createDataFrame([(i, (X[i] + 0.05).tolist()) for i in range(0, N, 100)], "qid long, vector array<float>").cache()


@pytest.fixture(scope="module")
def index(spark, pts):
    idx = VectorIndex(spark, CFG, pts)
    idx.build_graph()
    return idx


def recall(found, truth):
    return evaluate.recall(found, truth, 10).agg(F.avg("recall")).first()[0]


def test_near_graph_finds_most_neighbours(pts):
    got = graph.near_graph(pts, 10, nprobe=6)
    want = graph.knn_graph(pts, 10)
    assert got.groupBy("src").count().where("count <> 10").count() == 0 and got.where("src = dst").count() == 0
    assert got.join(want, ["src", "dst"]).count() > 0.8 * 10 * N


def test_layers(index, pts):
    base, upper = index.layers.base, index.layers.upper
    top = graph.levels(pts, 8).where("level = 1")
    assert 0.06 * N < top.count() < 0.2 * N
    assert upper.join(top.withColumnRenamed("label", "src"), "src", "left_anti").count() == 0
    ok = graph.integrity(base, pts).first()
    assert ok["self_loops"] == 0 and ok["duplicates"] == 0
    assert base.groupBy("src").count().agg(F.max("count")).first()[0] <= 16 and upper.groupBy("src").count().agg(F.max("count")).first()[0] <= 8


def test_unfiltered_search(index, pts, qs):
    truth = knn.knn(pts.where(~F.col("deleted")), qs, 10)
    found = graph.cut(index.graph_query(qs, 10, ef=64, stats=True))
    assert recall(found, truth) >= 0.95
    assert found.agg(F.max("n_distances")).first()[0] < 0.6 * N  # it doesn't look at everything
    assert list(evaluate.violations(found, 10, pts.where(~F.col("deleted"))).first()) == [0, 0, 0, 0]


def test_filtered_search(index, pts, qs):
    ok = pts.where(~F.col("deleted") & P.disjunction(TERMS, None, TYPES))
    assert {r["label"] for r in ok.collect()} == {i for i in range(N) if matching(i) and not DEAD[i]}
    truth = knn.knn(ok, qs, 10)
    found = graph.cut(index.graph_query(qs, 10, TERMS, ef=64))
    assert recall(found, truth) >= 0.95
    assert list(evaluate.violations(found, 10, ok).first()) == [0, 0, 0, 0]


def test_gate_never_loses_matches(index, pts):
    """Each edge to a matching record passes, whatever the number of attributes and bits."""
    marked = index.marker_edges()
    hit = index.live().where(P.disjunction(TERMS, None, TYPES)).select(F.col("label").alias("dst"))
    passes = M.gate(TERMS, index.codebook(), 256)
    assert marked.join(hit, "dst").where(~passes).count() == 0
    assert 0 < marked.where(~passes).count() < marked.count()
    walked = graph.gated(marked, passes, 3)
    least = walked.groupBy("src").count().join(marked.groupBy("src").agg(F.count("dst").alias("all")), "src")
    assert least.where(F.col("count") < F.least(F.col("all"), F.lit(3))).count() == 0


def test_clusters_of_three_attributes(index, pts, qs):
    index.build_clusters(10)
    ok = pts.where(~F.col("deleted") & P.disjunction(TERMS, None, TYPES))
    from tidevec.schema import SearchConfig

    found = ann.search(index.clusters, qs, 10, SearchConfig(nprobe=10), TERMS)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, knn.knn(ok, qs, 10).collect()))
    estimate = ann.estimated_rows(index.clusters, TERMS).agg(F.sum("estimate")).first()[0]
    assert estimate >= ok.count()


@pytest.mark.parametrize("blocks", [False, True])
def test_terms_of_three_attributes(spark, pts, qs, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(knn, "MAX_BROADCAST_QUERIES", 4)
        monkeypatch.setattr(knn, "BLOCK_QUERIES", 5)
    one = [([(10, 60)], [], [2], 1), ([], [(0, 100), (900, 999)], [1, 3], 0)]
    own = spark.createDataFrame([(r["qid"], r["vector"], one) for r in qs.collect()], f"qid long, vector array<float>, terms {P.terms_type(TYPES)}")
    ok = np.array([(10 <= A0[i] <= 60 and 2 in A2[i]) or ((A1[i] <= 100 or A1[i] >= 900) and bool({1, 3} & set(A2[i]))) for i in range(N)])
    got = knn.knn(pts, own, 5, terms="terms").collect()
    for q in (0, 700, 1400):
        d = ((X.astype(float) - np.float32(X[q] + 0.05).astype(float)) ** 2).sum(1)
        assert [r["label"] for r in sorted(got, key=lambda r: r["rk"]) if r["qid"] == q] == [int(i) for i in np.lexsort((np.arange(N), d)) if ok[i]][:5]
    assert sorted(map(tuple, knn.knn_expression(pts, own, 5, terms="terms").collect())) == sorted(map(tuple, got))


def test_queries_beyond_a_broadcast(spark):
    q = spark.range(20_001).select(F.col("id").alias("qid"), F.array(F.col("id").cast("float")).alias("vector"))
    p = spark.createDataFrame([(1, [3.0]), (2, [20_000.0])], "label long, vector array<float>")
    got = knn.knn(p, q, 1).groupBy("label").count().collect()
    assert sum(r["count"] for r in got) == 20_001


def test_far_off_the_origin(spark):
    x = (np.random.default_rng(3).random((400, 4)) + 1e7).astype(np.float64)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "label long, vector array<double>")
    q = p.where("label < 20").select(F.col("label").alias("qid"), "vector")
    a, b = knn.knn(p, q, 10), knn.knn_expression(p, q, 10)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_a_long_path_is_walked_to_its_end(spark):
    path = spark.range(100).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    start = spark.createDataFrame([(0,)], "label long")
    assert graph.reachable(path, start).agg(F.max("hops")).first()[0] == 100
    assert graph.reachable(path, start, 5).count() == 6
    assert graph.voronoi(path, start).count() == 101


def test_same_label_edges_within_the_degree(pts, index):
    e = graph.knn_graph(pts, 4)
    added = graph.cut(graph.augment_same_label(e, pts.withColumn("a1", F.col("a2")), 3, 3, 0.9, max_degree=6))
    more = graph.with_added(e, added, pts)
    assert more.count() > e.count() and more.groupBy("src").count().agg(F.max("count")).first()[0] <= 6
    assert graph.integrity(more, pts).first()["duplicates"] == 0


def test_colouring_sets_bits(index, pts):
    book = index.codebook()
    slot = book[2][4]
    marked = graph.cut(graph.marker_edges(index.layers.base, ann.marked(pts, book, 256), 256))
    p = ann.marked(pts, book, 256)
    holds = F.get("m2", slot // 63).bitwiseAND(F.lit(1 << (slot % 63)).cast("long")) != 0
    for done in (graph.coloured_by_voronoi(marked, p, "m2", 256, slot), graph.coloured_by_tail(marked, p, "m2", 256, slot, 12, 3)):
        before, after = marked.where(holds).count(), done.where(holds).count()
        assert done.count() == marked.count() and after >= before
        lost = marked.where(holds).join(done.where(~holds).select("src", "dst"), ["src", "dst"])
        assert lost.count() == 0


def test_two_hop_scan_and_build_counters(index, pts, qs):
    found = index.graph_query(qs, 3, ef=32)
    wide = graph.two_hop_scan(index.edges, pts, qs, found, 10)
    assert recall(wide, knn.knn(pts.where(~F.col("deleted")), qs, 10)) > 0.9
    e = graph.knn_graph(pts, 8)
    n = graph.build_counters(e, graph.rng_pruned(e, pts, 8)).first()
    assert n["candidates"] == 8 * N and n["kept"] + n["pruned"] == 8 * N and 0 < n["mean_degree"] <= 8


def small(spark):
    cfg = IndexConfig(dim=2, M=4, ef_construction=16, attr_types=(0,))
    rows = spark.range(300).select(F.col("id").alias("label"), F.array((F.col("id") % 20).cast("float"), F.floor(F.col("id") / 20).cast("float")).alias("vector"), F.col("id").cast("int").alias("a0"))
    idx = VectorIndex(spark, cfg).add_items(rows)
    idx.build_graph()
    return idx


def ids(spark, xs):
    return spark.createDataFrame([(int(x),) for x in xs], "label long")


def dist_errors(idx):
    a = idx.points.select(F.col("label").alias("src"), F.col("vector").alias("v1"))
    b = idx.points.select(F.col("label").alias("dst"), F.col("vector").alias("v2"))
    from tidevec.functions import distance as D

    return idx.edges.join(a, "src").join(b, "dst").where(F.abs(D.l2(F.col("v1"), F.col("v2")) - F.col("dist")) > 1e-9).count()


def test_graph_follows_inserts_and_moves(spark):
    idx = small(spark)
    new = spark.createDataFrame([(1000 + i, [50.0 + i, 50.0], i) for i in range(5)], "label long, vector array<float>, a0 int")
    idx.add_items(new)
    assert idx.edges.where("src >= 1000").select("src").distinct().count() == 5 and idx.edges.where("dst >= 1000 and src < 1000").count() > 0
    q = spark.createDataFrame([(0, [52.0, 50.0])], "qid long, vector array<float>")
    assert [r["label"] for r in idx.graph_query(q, 1, ef=16).collect()] == [1002]
    idx.update_point(spark.createDataFrame([(0, [51.5, 50.0]), (7, [-9.0, -9.0])], "label long, vector array<float>"))
    assert dist_errors(idx) == 0
    assert {r["label"] for r in idx.graph_query(q, 3, ef=16).collect()} == {0, 1002, 1001} or {r["label"] for r in idx.graph_query(q, 3, ef=16).collect()} == {0, 1002, 1003}
    q = spark.createDataFrame([(0, [-9.0, -9.0])], "qid long, vector array<float>")
    assert idx.graph_query(q, 1, ef=16).first()["label"] == 7


def test_in_place_deletion(spark):
    idx = small(spark)
    before = idx.edges
    gone = [21, 22, 23, 41, 42, 43, 150]
    counts = idx.delete_items(ids(spark, gone))
    assert counts["deleted"] == 7 and counts["edges_removed"] > 0 and counts["edges_added"] > 0
    assert counts["edges_after"] == counts["edges_before"] - counts["edges_removed"] + counts["edges_added"]
    e = idx.edges
    assert e.join(ids(spark, gone).withColumnRenamed("label", "dst"), "dst").count() == 0 and e.where(F.col("src").isin(gone)).count() == 0
    assert e.groupBy("src").count().agg(F.max("count")).first()[0] <= 8 and dist_errors(idx) == 0
    # new edges join the neighbours of a lost record only
    near = {(r["src"], r["dst"]) for r in before.collect()}
    around = {g: {b for a, b in near if a == g} | {a for a, b in near if b == g} for g in gone}
    for r in e.join(before.select("src", "dst"), ["src", "dst"], "left_anti").collect():
        assert any(r["src"] in x and r["dst"] in x for x in around.values())
    assert idx.layers.entry.join(ids(spark, gone), "label").count() == 0
    with pytest.raises(ValueError):
        idx.delete_items(ids(spark, [21]))


def test_repair_candidates_are_taken_once(spark):
    idx = small(spark)
    idx.mark_deleted(ids(spark, range(100, 140)))
    n = idx.get_repair_candidates_size()
    assert n > 10
    first = idx.pop_repair_candidates(3)
    assert len(first) == 3 and idx.get_repair_candidates_size() == n - 3 and not set(first) & {r["label"] for r in idx.get_repair_candidates().collect()}
    assert idx.repair_node(first[0]) and not idx.repair_node(101)
    idx.clear_repair_candidates()
    assert idx.get_repair_candidates_size() == 0


def test_snapshot_keeps_everything(spark, tmp_path):
    idx = small(spark)
    idx.build_clusters(6)
    idx.mark_deleted(ids(spark, [3]))
    idx.build_clusters(6)
    idx.cleanup_deleted_marker_bits().count()
    idx.save_index(f"file://{tmp_path}/s")
    back = VectorIndex.load_index(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError):
        back.unmark_deleted(ids(spark, [3]))
    assert back.new_deletes == 1 and back.books == idx.books
    assert {(r[0], r[1]) for r in back.clusters.points.select("label", "cluster_id").collect()} == {(r[0], r[1]) for r in idx.clusters.points.select("label", "cluster_id").collect()}
    q = spark.createDataFrame([(0, [4.2, 4.1])], "qid long, vector array<float>")
    assert back.graph_query(q, 5, ef=16).collect() == idx.graph_query(q, 5, ef=16).collect()
    assert back.points.where("deleted").count() == 1
    state = idx.state(f"file://{tmp_path}/t")
    assert VectorIndex.from_state(spark, state).edges.count() == idx.edges.count()
    with pytest.raises(ValueError):
        VectorIndex.from_state(spark, state | {"format_version": 0})


def test_deleted_in_place_without_the_index(spark, pts):
    e = graph.cut(graph.knn_graph(pts, 6))
    edges, counts = mutate.deleted_in_place(e, pts, pts.where("deleted").select("label"), 6)
    assert mutate.dirty(edges, pts).count() == 0 and edges.count() == counts["edges_before"] - counts["edges_removed"] + counts["edges_added"]


def plain_prune(rows, x, most, quota=None, slots=None):
    """Kept (src, dst, slot) one candidate after the other."""
    out = []
    for src in sorted({r[0] for r in rows}):
        kept, held = [], {}
        for d, dst in sorted((r[2], r[1]) for r in rows if r[0] == src):
            if len(kept) >= most or any(((x[dst] - x[j]) ** 2).sum() < d for j in kept):
                continue
            if quota is not None and slots[dst] and 3 * len(kept) >= most and all(held.get(s, 0) >= quota for s in slots[dst]):
                continue
            for s in slots[dst] if quota is not None else []:
                held[s] = held.get(s, 0) + 1
            out.append((src, dst, len(kept)))
            kept.append(dst)
    return sorted(out)


@pytest.mark.parametrize("quota", [None, 1])
def test_pruning_works_on_many_sources_at_once(spark, quota):
    """No Python call a source (F1, F6): groups of all sizes, that end anywhere in a batch."""
    r = np.random.default_rng(11)
    x = r.integers(-50, 50, (120, 3)).astype(float)
    slots = {i: [int(s) for s in set(r.integers(0, 3, i % 3))] for i in range(120)}
    rows = [(s, int(t), float(((x[s] - x[t]) ** 2).sum())) for s in range(60) for t in r.permutation(120)[: 1 + (s * 7) % 90] if s != t]
    p = spark.createDataFrame([(i, v.tolist(), slots[i]) for i, v in enumerate(x)], "label long, vector array<double>, slots array<int>")
    e = spark.createDataFrame(rows, "src long, dst long, dist double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = graph.rng_pruned(e, p, 9, quota=quota, slots=F.col("slots"))
        assert sorted((a["src"], a["dst"], a["slot"]) for a in got.collect()) == plain_prune(rows, x, 9, quota, slots)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_queries_send_on_k_rows_each(pts, monkeypatch):
    """However many blocks the points fill (F1, F2, F6, F14), one row a query and place leaves the Python tasks."""
    monkeypatch.setattr(knn, "MAX_BROADCAST_QUERIES", 4)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 300)
    monkeypatch.setattr(knn, "CHUNK_ROWS", 100)
    sent = []
    rank = knn.ranked
    monkeypatch.setattr(knn, "ranked", lambda found, k=None: sent.append(found) or rank(found, k))
    got = knn.knn(pts, pts.select(F.col("label").alias("qid"), "vector"), 7, self_excluded=True).collect()
    assert len(got) == 7 * N and sent[0].count() == 7 * N
    x = X.astype(float)
    for q in (0, 1, 700):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert [r["label"] for r in sorted(got, key=lambda r: r["rk"]) if r["qid"] == q] == np.argsort(d, kind="stable")[:7].tolist()


@pytest.mark.parametrize("kind", ["plain", "copies", "far", "same", "huge"])
@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_nearest_equals_all_exact_distances(kind, metric, monkeypatch):
    from tidevec.functions import distance as D

    monkeypatch.setattr(knn, "CHUNK_ROWS", 256)
    r = np.random.default_rng(2)
    x = {"plain": lambda: r.normal(size=(900, 8)), "copies": lambda: np.repeat(r.normal(size=(9, 8)), 100, 0), "far": lambda: r.random((900, 8)) + 1e7, "same": lambda: np.ones((900, 4)), "huge": lambda: r.normal(size=(900, 4)) * 1e40}[kind]()
    labels = r.permutation(900) * 3
    best = knn.Nearest(labels[:40], x[:40], metric, 6, True)
    for a in range(0, 900, 300):
        best.add(labels[a : a + 300], x[a : a + 300])
    got = sorted(zip(*[c.tolist() for c in best.rows()]))
    want = []
    for i in range(40):
        d = D.exact_pairs(metric, np.broadcast_to(x[i], x.shape), x)
        want += [(int(labels[i]), int(labels[j]), float(d[j])) for j in [j for j in np.lexsort((labels, d)) if j != i][:6]]
    assert got == sorted(want)


@pytest.mark.parametrize("kind", ["l2", "custom", "kernel", "integer", "large integers"])
def test_expressions_do_not_rank_all_pairs(spark, kind, monkeypatch):
    """few pairs are ranked, with the same result as all of them."""
    from tidevec.functions import distance as D

    r = np.random.default_rng(4)
    x = r.integers(-9, 9, (600, 5)) * (2**26 if kind == "large integers" else 1)
    l1 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    metric = {"l2": "l2", "custom": l1, "kernel": D.with_kernel(lambda a, b: l1(a, b), "l1")}.get(kind, D.l2_int)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "label long, vector array<long>")
    q = p.where("label % 20 = 0").select(F.col("label").alias("qid"), "vector")
    want = sorted(map(tuple, knn.knn_expression(p, q, 7, metric).collect()))
    ranked, seen = knn.ranked, []
    monkeypatch.setattr(knn, "ranked", lambda found, k=None: seen.append(found) or ranked(found, k))
    monkeypatch.setattr(knn, "PAIRS_BY_EXPRESSION", 1000)
    assert sorted(map(tuple, knn.knn_expression(p, q, 7, metric).collect())) == want
    assert max(f.count() for f in seen) < 600 * 30 / 2
