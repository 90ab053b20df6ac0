import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidevec import catalog
from tidevec.functions import distance as D
from tidevec.functions import predicates as P
from tidevec.operators import ann, evaluate, graph, knn
from tidevec.plans import planner
from tidevec.schema import IndexConfig, SearchConfig

RNG = np.random.default_rng(5)
N, DIM = 600, 16
X = RNG.normal(size=(N, DIM)).astype(np.float32)
A0 = RNG.integers(0, 100, N)
A1 = [sorted(set(RNG.integers(0, 6, 3).tolist())) for _ in range(N)]
DEAD = RNG.random(N) < 0.1
Q = RNG.normal(size=(12, DIM)).astype(np.float32)


@pytest.fixture(scope="module")
def pts(spark):
    rows = [(i, X[i].tolist(), int(A0[i]), A1[i], bool(DEAD[i]), i // 4) for i in range(N)]
    return spark.createDataFrame(rows, "label long, vector array<float>, a0 int, a1 array<int>, deleted boolean, doc_id long").repartition(3).cache()


@pytest.fixture(scope="module")
def qs(spark):
    rows = [(i, Q[i].tolist(), [([(int(10 * i % 70), int(10 * i % 70 + 30))], [i % 6], 1), ([], [1, 2], 0)]) for i in range(len(Q))]
    return spark.createDataFrame(rows, f"qid long, vector array<float>, terms {P.TERMS_TYPE}").cache()


def dist(metric, q):
    x = X.astype(float)
    q = q.astype(float)
    if metric == "l2":
        return ((x - q) ** 2).sum(1)
    if metric == "ip":
        return 1 - x @ q
    return 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)


def best(metric, q, ok, k):
    d = dist(metric, q)
    return sorted((float(d[i]), i) for i in range(N) if ok[i])[:k]


def rows_of(df):
    out = {}
    for r in df.orderBy("qid", "rk").collect():
        out.setdefault(r["qid"], []).append((r["dist"], r["label"]))
    return out


def same(got, want):
    assert [b for _, b in got] == [b for _, b in want]
    assert np.allclose([a for a, _ in got], [a for a, _ in want])


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_exact(pts, qs, metric):
    got = rows_of(knn.knn(pts, qs, 7, metric))
    for i, q in enumerate(Q):
        same(got[i], best(metric, q, np.ones(N, bool), 7))


def test_filtered(pts, qs):
    got = rows_of(knn.knn(pts, qs, 5, "l2", P.conjunction([[20, 60], [3]]) & ~F.col("deleted")))
    ok = np.array([20 <= a <= 60 and 3 in b and not d for a, b, d in zip(A0, A1, DEAD)])
    for i, q in enumerate(Q):
        same(got[i], best("l2", q, ok, 5))


def ok_for(i):
    lo, hi = int(10 * i % 70), int(10 * i % 70 + 30)
    return np.array([(lo <= a <= hi and i % 6 in b) or 1 in b or 2 in b for a, b in zip(A0, A1)])


@pytest.mark.parametrize("blocks", [False, True])
def test_each_query_its_own_predicate(pts, qs, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(knn, "MAX_BROADCAST_QUERIES", 4)
        monkeypatch.setattr(knn, "BLOCK_QUERIES", 5)
    if blocks:  # in blocks the predicate arrives as rows too
        got = rows_of(knn.knn(pts, qs, 6, "l2"))
        for i, q in enumerate(Q):
            same(got[i], best("l2", q, np.ones(N, bool), 6))
    got = rows_of(knn.knn(pts, qs, 6, "l2", terms="terms"))
    for i, q in enumerate(Q):
        same(got[i], best("l2", q, ok_for(i), 6))


@pytest.mark.parametrize("blocks", [False, True])
def test_labels_beyond_a_word(spark, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(knn, "MAX_BROADCAST_QUERIES", 2)
    labels = [[1, 62], [63], [64, 2], [63, 1000], [1000, 1, 63], [], [5, 1 << 19]]
    p = spark.createDataFrame([(i, [float(i)], 10, x) for i, x in enumerate(labels)], "label long, vector array<float>, a0 int, a1 array<int>")
    asked = [([63], 0), ([63, 1000], 1), ([62, 63], 0), ([1, 63], 1), ([64], 1), ([1 << 19, 5], 1), ([77], 0), ([77], 1), ([2, 64, 1000], 0)]
    q = spark.createDataFrame([(i, [0.0], [([], a, m)]) for i, (a, m) in enumerate(asked)], f"qid long, vector array<float>, terms {P.TERMS_TYPE}")
    got = rows_of(knn.knn(p, q, 9, terms="terms"))
    want = {i: [n for n, x in enumerate(labels) if (set(a) <= set(x) if m else set(a) & set(x))] for i, (a, m) in enumerate(asked)}
    assert {i: [n for _, n in x] for i, x in got.items()} == {i: x for i, x in want.items() if x}
    assert rows_of(knn.knn_expression(p, q, 9, terms="terms")) == got


def test_expression_form_agrees(pts, qs):
    a = knn.knn(pts, qs, 6, "cosine", terms="terms").collect()
    b = knn.knn_expression(pts, qs, 6, "cosine", terms="terms").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_expression_form_keeps_all_queries(pts, qs, monkeypatch):
    want = sorted(map(tuple, knn.knn(pts, qs, 6, "cosine", terms="terms").collect()))
    monkeypatch.setattr(knn, "MAX_BROADCAST_QUERIES", 4)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 5)
    assert sorted(map(tuple, knn.knn_expression(pts, qs, 6, "cosine", terms="terms").collect())) == want
    assert knn.knn_expression(pts, qs, 6).count() == 6 * len(Q)


def test_padding_and_strictness(pts, qs):
    few = knn.knn(pts, qs, 4, predicate=F.col("label") < 2)
    got = rows_of(knn.padded(few, qs, 4))
    assert all(len(v) == 4 and v[2:] == [(float("inf"), -1)] * 2 for v in got.values())
    with pytest.raises(Exception, match="fewer than 4"):
        knn.strict(few, qs, 4).collect()
    assert knn.strict(knn.knn(pts, qs, 4), qs, 4).count() == 4 * len(Q)


def test_epsilon(pts, qs):
    got = rows_of(knn.epsilon(pts, qs, 14.0))
    for i, q in enumerate(Q):
        want = [x for x in best("l2", q, np.ones(N, bool), N) if x[0] <= 14.0]
        same(got.get(i, []), want)
    self_q = pts.where("label = 3").select(F.col("label").alias("qid"), "vector")
    assert [(r["label"], r["dist"]) for r in knn.epsilon(pts, self_q, 1e-4).collect()] == [(3, 0.0)]


@pytest.mark.parametrize("blocks", [False, True])
def test_epsilon_has_no_cap(spark, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(knn, "MAX_BROADCAST_QUERIES", 1)
    p = spark.range(12_000).select(F.col("id").alias("label"), F.array(F.col("id").cast("float") / 12_000, F.lit(0.0).cast("float")).alias("vector"))
    q = p.where("label in (0, 5000)").select(F.col("label").alias("qid"), "vector")
    got = {r["qid"]: (r["n"], r["last"]) for r in knn.epsilon(p, q, 2.0).groupBy("qid").agg(F.count("label").alias("n"), F.max("rk").alias("last")).collect()}
    assert got == {0: (12_000, 12_000), 5000: (12_000, 12_000)}
    assert knn.epsilon(p, q, 2.0, 7).count() == 14


def test_documents(pts, qs):
    got = {}
    for r in knn.by_document(pts, qs, 5, ef=5).collect():
        got.setdefault(r["qid"], []).append((r["rk"], r["label"], r["doc_id"]))
    for i, q in enumerate(Q):
        met, want = [], []
        for n, (_, label) in enumerate(best("l2", q, np.ones(N, bool), N)):
            if label // 4 not in met:
                met.append(label // 4)
            want.append((n + 1, label, label // 4))
            if len(met) == 5:
                break
        assert sorted(got[i]) == want


def test_known_distances(spark):
    v = [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [1, 1, 1]]
    for left, right in ((0, 0), (2, 3)):
        rows = [(i, [0.0] * left + [float(x) for x in r] + [0.0] * right) for i, r in enumerate(v)]
        p = spark.createDataFrame(rows, "label long, vector array<float>")
        q = p.where("label = 4").select(F.col("label").alias("qid"), "vector")
        for metric, want in (("l2", [0, 1, 2, 2, 2]), ("ip", [-2, -1, 0, 0, 0]), ("cosine", [0, 0.1835, 0.423, 0.423, 0.423])):
            got = [r["dist"] for r in knn.knn(p, q, 5, metric).orderBy("rk").collect()]
            assert np.allclose(got, want, atol=1e-3)


def test_zero_vector_under_cosine(spark):
    p = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "label long, vector array<float>")
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, vector array<float>")
    assert [r["dist"] for r in knn.knn(p, q, 2, "cosine").collect()] == [1.0, 1.0]
    assert [r["n"] for r in p.select(F.size(F.filter(D.normalised(F.col("vector")), lambda x: F.isnan(x))).alias("n")).collect()] == [0, 0]


def test_custom_space_and_names(pts, qs):
    with pytest.raises(ValueError):
        D.distance("manhattan", F.col("a"), F.col("b"))
    with pytest.raises(ValueError):
        IndexConfig(dim=3, space="manhattan")


@pytest.fixture(scope="module")
def index(pts):
    idx = ann.build(pts, IndexConfig(dim=DIM, max_cate_size=6), 12)
    idx.points, idx.clusters = idx.points.cache(), idx.clusters.cache()
    return idx


def test_clusters(index, pts):
    assert index.clusters.agg(F.sum("n")).first()[0] == N
    far = index.points.join(index.clusters.select("cluster_id", "representative"), "cluster_id").where("label = representative")
    assert far.count() == index.clusters.count()


def test_probing_recall_and_invariants(index, pts, qs):
    terms = [[[10, 80], [2]], [[], [1, 3]]]
    live = pts.where(~F.col("deleted")).where(P.disjunction(terms))
    truth = knn.knn(live, qs, 10)
    got = ann.search(index, qs, 10, SearchConfig(nprobe=10), terms)
    assert evaluate.recall(got, truth, 10).agg(F.avg("recall")).first()[0] >= 0.95
    bad = evaluate.violations(got, 10, live).first()
    assert list(bad) == [0, 0, 0, 0]
    everything = ann.search(index, qs, 10, SearchConfig(nprobe=12), terms)
    assert rows_of(everything) == rows_of(truth)


def test_probing_keeps_all_queries(index, qs, monkeypatch):
    terms = [[[10, 80], [2]], [[], [1, 3]]]
    want = [rows_of(ann.search(index, qs, 10, SearchConfig(nprobe=3), t)) for t in (None, terms)]
    assert all(len(x) == len(Q) for x in want)
    monkeypatch.setattr(knn, "MAX_BROADCAST_QUERIES", 4)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(ann, "CHUNK_ROWS", 8)
    assert ann.probes(index, qs, SearchConfig(nprobe=3)).count() == 3 * len(Q)
    assert [rows_of(ann.search(index, qs, 10, SearchConfig(nprobe=3), t)) for t in (None, terms)] == want


def test_planner(index, pts, qs):
    terms = [[[10, 80], [2]], [[], [1, 3]]]
    exact = planner.hybrid(index, qs, terms, 10, SearchConfig.variant("strict"))
    truth = knn.knn(pts.where(~F.col("deleted")).where(P.disjunction(terms)), qs, 10)
    assert rows_of(exact) == rows_of(truth)
    assert planner.choose(1, 100, SearchConfig(exact_below=0.05)) == "exact" and planner.choose(50, 100, SearchConfig()) == "probe"
    assert planner.hybrid(index, qs, [[0, 99], []], 3, SearchConfig(exact_below=0.0, nprobe=2)).count() == 36
    assert abs(planner.any_selectivity([0.5, 0.5]) - 0.75) < 1e-12 and planner.term_selectivity([0.5, 0.5]) == 0.25
    est = ann.estimated_rows(index, terms).agg(F.sum("estimate")).first()[0]
    assert est >= pts.where(~F.col("deleted")).where(P.disjunction(terms)).count()


def test_graph(pts, qs):
    e = graph.cut(graph.knn_graph(pts, 8))
    ok = graph.integrity(e, pts).first()
    assert ok["self_loops"] == 0 and ok["duplicates"] == 0 and ok["edges"] == 8 * N
    both = graph.cut(graph.connected(e, pts, 16))
    assert both.groupBy("src").count().agg(F.max("count")).first()[0] <= 16
    reach = graph.reachable(both, pts.where("label = 0").select("label")).count()
    assert reach > 0.9 * N
    found = graph.search(both, pts, qs.limit(4), 0, 10, 60)
    truth = knn.knn(pts.where(~F.col("deleted")), qs.limit(4), 10)
    assert evaluate.recall(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.8


def test_registered_graph_search_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    p = catalog.points(spark, sf_dir)
    q = catalog.query_rows(p)
    truth = knn.knn(p.where(~F.col("deleted")), q, 10)
    per = evaluate.recall(catalog.graph_search(spark, sf_dir), truth, 10).collect()
    assert len(per) == q.count() == 100
    assert sum(r["recall"] for r in per) / len(per) >= 0.97


def test_graph_search_reaches_parts_that_no_edge_joins(spark, pts):
    halves = pts.withColumn("vector", F.transform("vector", lambda x: x + F.when(F.col("label") < N // 2, 100.0).otherwise(0.0).cast("float")))
    q = halves.where("label in (1, 599)").select(F.col("label").alias("qid"), "vector")
    both = graph.cut(graph.connected(graph.knn_graph(halves, 8), halves, 16))
    found = graph.search(both, halves, q, graph.spread_entries(halves), 10, 60)
    truth = knn.knn(halves.where(~F.col("deleted")), q, 10)
    assert min(r["recall"] for r in evaluate.recall(found, truth, 10).collect()) >= 0.8


def test_pruning_keeps_what_no_neighbour_dominates(pts):
    e = graph.knn_graph(pts, 10)
    got = {}
    for r in graph.rng_pruned(e, pts, 10).orderBy("src", "slot").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    x = X.astype(float)
    for src in range(0, N, 60):
        order = sorted((((x[j] - x[src]) ** 2).sum(), j) for j in range(N) if j != src)[:10]
        kept = []
        for d, j in order:
            if all(((x[j] - x[k]) ** 2).sum() >= d for k in kept):
                kept.append(j)
        assert got[src] == kept


def test_kept_clusters(pts, qs, tmp_path):
    path, cfg = f"file://{tmp_path}/clusters", IndexConfig(dim=DIM, max_cate_size=6)
    a = ann.kept(pts, cfg, path, 5)
    before = a.points.inputFiles()
    b = ann.kept(pts, cfg, path, 5)
    assert b.points.inputFiles() == before and (b.starts, b.mapping, b.bits) == (a.starts, a.mapping, a.bits)
    assert rows_of(ann.search(b, qs, 3, SearchConfig(nprobe=5))) == rows_of(knn.knn(pts.where(~F.col("deleted")), qs, 3))
    c = ann.kept(pts.where("label <> 3"), cfg, path, 5)  # other rows, other clusters
    assert c.points.inputFiles() != before
