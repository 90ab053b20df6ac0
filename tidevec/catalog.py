"""The registered queries of the engine, each with its SQL where SQL can say it.

The tables' ``embeddings`` have one label, so attributes are derived by the same
arithmetic in both engines: a0 is a number below 1000, a1 a set of labels, every
eleventh record is deleted, five records make a document.  Queries are
the records whose label is divisible by 20, against all records.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codebook as C
from .functions import distance as D
from .functions import generate as G
from .functions import markers as M
from .functions import predicates as P
from .operators import ann, evaluate, graph, knn, mutate, stats
from .plans import planner
from .schema import IndexConfig, SearchConfig, record_errors
from .shared import shared_dir
from .sources import io
from .streaming import trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

K = 10
#: Queries are the records whose label is divisible by it.
EVERY = 20
BITS = 32
FIXED_CENTROIDS = 10
#: Derived tables for the SQL side.
BASE = """
WITH p AS (
  SELECT vec_id AS label, embedding AS vector, CAST((vec_id * 7919) % 1000 AS INTEGER) AS a0,
         list_sort(list_distinct([CAST(label AS INTEGER), CAST((label + vec_id) % 10 AS INTEGER), CAST((label * 3 + 1) % 10 AS INTEGER)])) AS a1,
         vec_id % 11 = 0 AS deleted, vec_id // 5 AS doc_id, CAST(label AS INTEGER) AS cls
  FROM embeddings
), q AS (SELECT label AS qid, vector AS qv, a0 AS qa0, cls AS qcls FROM p WHERE label % 20 = 0)
"""


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"


def _cos(a: str, b: str) -> str:
    return f"1.0 - {_dot(a, b)} * (1.0 / (sqrt({_dot(a, a)}) + 1e-30)) * (1.0 / (sqrt({_dot(b, b)}) + 1e-30))"


SQL_DIST = {"l2": _l2, "ip": lambda a, b: f"1.0 - {_dot(a, b)}", "cosine": _cos}


def _knn_sql(metric: str = "l2", where: str = "true", k: int = K, cols: str = "qid, rk, label, round(dist, 9) + 0.0 AS dist") -> str:
    return (
        BASE
        + f""", d AS (SELECT q.qid, p.label, {SQL_DIST[metric]("q.qv", "p.vector")} AS dist FROM q JOIN p ON {where}),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, label) AS rk FROM d)
        SELECT {cols} FROM r WHERE rk <= {k}"""
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cls = F.col("label").cast("int")
    labels = F.array(cls, F.pmod(F.col("label") + F.col("vec_id"), F.lit(10)).cast("int"), ((cls * 3 + 1) % 10).cast("int"))
    return e.select(
        F.col("vec_id").alias("label"), F.col("embedding").alias("vector"),
        ((F.col("vec_id") * 7919) % 1000).cast("int").alias("a0"), F.array_sort(F.array_distinct(labels)).alias("a1"),
        (F.col("vec_id") % 11 == 0).alias("deleted"), F.floor(F.col("vec_id") / 5).alias("doc_id"), cls.alias("cls"),
    )


def query_rows(p: DataFrame, every: int = EVERY) -> DataFrame:
    """The queries, every ``every``-th label, each with a conjunction around its own number and a disjunction of its own."""
    own = F.struct(
        F.array(F.struct((F.col("a0") - 150).alias("lo"), (F.col("a0") + 150).alias("hi"))).alias("a0"),
        F.array("cls").alias("a1"), F.lit(1).alias("a1_mode"),
    )
    both = F.struct(F.array().cast("array<struct<lo:int,hi:int>>").alias("a0"), F.array(F.lit(2), F.lit(7)).alias("a1"), F.lit(1).alias("a1_mode"))
    return p.where(F.col("label") % every == 0).select(F.col("label").alias("qid"), "vector", F.col("a0").alias("qa0"), F.col("cls").alias("qcls"), F.array(own, both).alias("terms"))


def shown(result: DataFrame) -> DataFrame:
    return result.select("qid", "rk", "label", (F.round("dist", 9) + 0.0).alias("dist"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- filters

_ROWS = "SELECT label, a0, list_aggregate(list_transform(a1, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS a1 FROM p WHERE "


def _rows(df: DataFrame) -> DataFrame:
    return df.select("label", "a0", F.array_join(F.col("a1").cast("array<string>"), ",").alias("a1"))


def _filter(name: str, predicate, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(points(spark, sf_dir).where(predicate()))

    run.__name__ = name
    query(BASE + _ROWS + where)(run)


DNF = [[[100, 400], [4]], [[], [2, 7]]]
DNF_SQL = "((a0 BETWEEN 100 AND 400 AND list_contains(a1, 4)) OR list_has_all(a1, [2, 7]))"
MULTI = [[[10, 20, 500, 650, 999, 999], []]]
MULTI_SQL = "(a0 BETWEEN 10 AND 20 OR a0 BETWEEN 500 AND 650 OR a0 = 999)"
_filter("filter_range", lambda: P.conjunction([[100, 400], []]), "a0 BETWEEN 100 AND 400")
_filter("filter_labels_all", lambda: P.conjunction([[], [2, 7]]), "list_has_all(a1, [2, 7])")
_filter("filter_labels_any", lambda: P.disjunction([[[], [2, 7]]], [[1, 0]]), "list_has_any(a1, [2, 7])")
_filter("filter_and", lambda: P.conjunction([[100, 400], [4]]), "a0 BETWEEN 100 AND 400 AND list_contains(a1, 4)")
_filter("filter_dnf", lambda: P.disjunction(DNF), DNF_SQL)
_filter("filter_dnf_multirange", lambda: P.disjunction(MULTI), MULTI_SQL)
_filter("filter_dnf_skip_mode", lambda: P.disjunction([[[0, 99], [3]]], [[1, -1]]), "a0 BETWEEN 0 AND 99")
_filter("filter_unconstrained", lambda: P.conjunction([[], []]), "true")
_filter("filter_no_terms", lambda: P.disjunction([]), "false")
_filter("filter_text", lambda: F.expr(P.as_text([[100, 400], [4]])), "a0 BETWEEN 100 AND 400 AND list_contains(a1, 4)")


# -- lookups


@query(BASE + "SELECT label, i - 1 AS i, CAST(vector[i] AS DOUBLE) AS x FROM (SELECT label, vector, unnest(generate_series(1, len(vector))) AS i FROM p WHERE label % 20 = 0 AND NOT deleted)")
def get_items(spark, sf_dir):
    from .plans.index import VectorIndex

    index = VectorIndex(spark, IndexConfig(dim=64, max_cate_size=10), points(spark, sf_dir))
    got = index.get_items(index.live().where(F.col("label") % EVERY == 0))
    return got.select("label", F.posexplode("vector").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


@query(BASE + "SELECT label FROM p")
def list_ids(spark, sf_dir):
    return points(spark, sf_dir).select("label")


@query(BASE + "SELECT count(*) AS occupied, count(*) FILTER (NOT deleted) AS live, count(*) FILTER (deleted) AS dead, avg(CASE WHEN deleted THEN 1.0 ELSE 0.0 END) AS deleted_ratio FROM p")
def live_count(spark, sf_dir):
    return stats.live_summary(points(spark, sf_dir))


@query(BASE + "SELECT label, CAST(list_sum(list_transform(a1, lambda x: CAST(1 AS BIGINT) << x)) AS BIGINT) AS mask, list_aggregate(list_transform(a1, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS labels FROM p")
def decode_labels(spark, sf_dir):
    p = points(spark, sf_dir).select("label", F.expr(P.mask_sql("a1")).alias("mask"))
    return p.select("label", "mask", F.array_join(P.from_mask(F.col("mask"), 20).cast("array<string>"), ",").alias("labels"))


@query(BASE + "SELECT label FROM p WHERE NOT (a0 > 0 AND a0 <= 100000)")
def attr_check(spark, sf_dir):
    return points(spark, sf_dir).where(~((F.col("a0") > 0) & (F.col("a0") <= 100_000))).select("label")


@query(BASE + "SELECT label, len(list_filter(a1, lambda x: x >= 8)) > 0 AS invalid FROM p")
def record_validation(spark, sf_dir):
    return points(spark, sf_dir).select("label", record_errors(points(spark, sf_dir), IndexConfig(dim=64, max_cate_size=8)).isNotNull().alias("invalid"))


@query(BASE + "SELECT label, a0, list_contains(a1, 9) AS has9, list_contains(a1, 2) AS has2 FROM p")
def mixed_projection(spark, sf_dir):
    return points(spark, sf_dir).select("label", "a0", F.array_contains("a1", 9).alias("has9"), F.array_contains("a1", 2).alias("has2"))


# -- exact search


def _search(name: str, metric: str = "l2", predicate=None, where: str = "true", **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = points(spark, sf_dir)
        return shown(knn.knn(p, query_rows(p), K, metric, predicate() if predicate else None, **options))

    run.__name__ = name
    query(_knn_sql(metric, where))(run)


_search("knn_l2")
_search("knn_ip", "ip")
_search("knn_cosine", "cosine")
_search("knn_and", predicate=lambda: P.conjunction([[100, 400], [4]]), where="a0 BETWEEN 100 AND 400 AND list_contains(a1, 4)")
_search("knn_dnf", predicate=lambda: P.disjunction(DNF), where=DNF_SQL)
_search("knn_dnf_per_query", terms="terms", where="(p.a0 BETWEEN q.qa0 - 150 AND q.qa0 + 150 AND list_contains(p.a1, q.qcls)) OR list_has_all(p.a1, [2, 7])")
_search("knn_live", predicate=lambda: ~F.col("deleted") & P.disjunction(DNF), where=f"NOT deleted AND {DNF_SQL}")
_search("knn_self_excluded", where="p.label <> q.qid", self_excluded=True)


@query(_knn_sql())
def knn_by_expression(spark, sf_dir):
    p = points(spark, sf_dir)
    return shown(knn.knn_expression(p, query_rows(p), K))


@query(BASE + f""", d AS (SELECT q.qid, p.label, list_sum(list_transform(list_zip(q.qv, p.vector), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS dist FROM q JOIN p ON true),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, label) AS rk FROM d) SELECT qid, rk, label, round(dist, 9) AS dist FROM r WHERE rk <= {K}""")
def knn_custom_space(spark, sf_dir):
    p = points(spark, sf_dir)
    manhattan = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return shown(knn.knn_expression(p, query_rows(p), K, D.with_kernel(manhattan, "l1")))


@query(BASE + f""", i AS (SELECT label, list_transform(vector, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1.0) * 100.0) AS BIGINT)) AS v FROM p),
    d AS (SELECT a.label AS qid, b.label, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS dist FROM i a JOIN i b ON a.label % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, label) AS rk FROM d) SELECT qid, rk, label, dist FROM r WHERE rk <= {K}""")
def knn_integer(spark, sf_dir):
    whole = F.transform("vector", lambda x: F.floor((x.cast("double") + 1.0) * 100.0))
    p = points(spark, sf_dir).select("label", whole.alias("vector"))
    q = p.where(F.col("label") % EVERY == 0).select(F.col("label").alias("qid"), "vector")
    return knn.knn_expression(p, q, K, D.l2_int)


@query(BASE + f""", d AS (SELECT q.qid, p.label, {_l2("q.qv", "p.vector")} AS dist FROM q JOIN p ON a0 < 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, label) AS rk FROM d),
    g AS (SELECT qid, rk FROM q, generate_series(1, {K}) t(rk))
    SELECT g.qid, g.rk, coalesce(r.label, -1) AS label, coalesce(round(r.dist, 9), CAST('inf' AS DOUBLE)) AS dist FROM g LEFT JOIN r ON g.qid = r.qid AND g.rk = r.rk""")
def knn_padded(spark, sf_dir):
    p = points(spark, sf_dir)
    q = query_rows(p)
    return shown(knn.padded(knn.knn(p, q, K, predicate=F.col("a0") < 10), q, K))


@query(_knn_sql(cols="qid, rk, label, round(dist, 9) + 0.0 AS dist, (SELECT count(*) FROM p) AS n_distances"))
def knn_with_stats(spark, sf_dir):
    p = points(spark, sf_dir)
    return knn.with_stats(p, query_rows(p), K).select("qid", "rk", "label", F.round("dist", 9).alias("dist"), "n_distances")


@query(_knn_sql())
def knn_strict(spark, sf_dir):
    p = points(spark, sf_dir)
    q = query_rows(p)
    return shown(knn.strict(knn.knn(p, q, K), q, K))


@query(BASE + f""", d AS (SELECT q.qid, p.label, {_l2("q.qv", "p.vector")} AS dist FROM q JOIN p ON true)
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, label) AS rk, label, round(dist, 9) AS dist FROM d WHERE dist <= 1.5""")
def epsilon_search(spark, sf_dir):
    p = points(spark, sf_dir)
    return shown(knn.epsilon(p, query_rows(p), 1.5))


@query(BASE + f""", d AS (SELECT q.qid, p.label, p.doc_id, {_l2("q.qv", "p.vector")} AS dist FROM q JOIN p ON true),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, label) AS rk FROM d),
    f AS (SELECT qid, doc_id, min(rk) AS first FROM r GROUP BY ALL),
    c AS (SELECT qid, max(first) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first) AS nth FROM f) WHERE nth <= 5 GROUP BY qid)
    SELECT r.qid, rk, label, doc_id, round(dist, 9) AS dist FROM r JOIN c ON r.qid = c.qid AND rk <= cut""")
def multivector_docs(spark, sf_dir):
    p = points(spark, sf_dir)
    return knn.by_document(p, query_rows(p), 5).select("qid", "rk", "label", "doc_id", F.round("dist", 9).alias("dist"))


# -- codebooks and Markers

_STARTS = f"""s AS (
  SELECT slot, min(v) AS start FROM (
    SELECT v, (coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {BITS}) // (SELECT count(*) FROM p) AS slot
    FROM (SELECT a0 AS v, count(*) AS n FROM p GROUP BY a0)) GROUP BY slot
), st AS (SELECT start FROM s), sl AS (
  SELECT p.label, CAST(greatest(0, (SELECT count(*) FROM st WHERE start <= p.a0) - 1) AS INTEGER) AS slot FROM p
)"""
_LABEL_SLOTS = f"""lf AS (SELECT item, count(*) AS n FROM (SELECT unnest(a1) AS item FROM p) GROUP BY item),
ls AS (SELECT item, n, CAST((row_number() OVER (ORDER BY n DESC, item) - 1) % {BITS} AS INTEGER) AS slot FROM lf)"""


def marked(spark, sf_dir):
    """(points with Markers m0 and m1, slot starts, label slots)."""
    p = points(spark, sf_dir)
    starts = C.numeric_starts(p, "a0", BITS)
    mapping = C.map_of(C.label_slots(p, "a1", BITS))
    m0 = M.encode(F.array(C.numeric_slot(F.col("a0"), starts)), BITS)
    m1 = M.encode(F.transform("a1", lambda x: C.label_slot(x, mapping)), BITS)
    return p.withColumn("m0", m0).withColumn("m1", m1), starts, mapping


@query(BASE + f", {_STARTS} SELECT label, slot FROM sl")
def numeric_slots(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("label", C.numeric_slot(F.col("a0"), C.numeric_starts(p, "a0", BITS)).alias("slot"))


@query(BASE + f", {_STARTS} SELECT p.label, CAST((SELECT count(*) FROM st WHERE start < p.a0) AS INTEGER) AS bound FROM p")
def slot_lower_bound(spark, sf_dir):
    p = points(spark, sf_dir)
    got = [s for s in C.numeric_starts(p, "a0", BITS)]
    return p.select("label", C.lower_bound(F.col("a0"), got).alias("bound"))


@query(BASE + f", {_LABEL_SLOTS} SELECT item AS label, n, slot FROM ls")
def label_slots(spark, sf_dir):
    return C.label_slots(points(spark, sf_dir), "a1", BITS)


_MARKERS = f"""{_STARTS}, {_LABEL_SLOTS},
m AS (SELECT p.label, p.a0, p.a1, CAST(1 AS BIGINT) << sl.slot AS m0, CAST((SELECT sum(DISTINCT CAST(1 AS BIGINT) << ls.slot) FROM ls WHERE list_contains(p.a1, ls.item)) AS BIGINT) AS m1 FROM p JOIN sl ON p.label = sl.label),
w AS (SELECT (SELECT sum(DISTINCT CAST(1 AS BIGINT) << slot)::BIGINT FROM (SELECT unnest(range(CAST((SELECT greatest(0, count(*) - 1) FROM st WHERE start <= 100) AS BIGINT), CAST((SELECT greatest(0, count(*) - 1) FROM st WHERE start <= 400) AS BIGINT) + 1)) AS slot)) AS r0,
  (SELECT sum(CAST(1 AS BIGINT) << slot)::BIGINT FROM ls WHERE item = 4) AS l4, (SELECT sum(CAST(1 AS BIGINT) << slot)::BIGINT FROM ls WHERE item IN (2, 7)) AS l27)"""
_PASS_AND = "((m0 & r0) <> 0 AND (m1 & l4) = l4)"
_PASS_DNF = f"({_PASS_AND} OR (m1 & l27) = l27)"


@query(BASE + f", {_MARKERS} SELECT label, m0, m1 FROM m")
def marker_encode(spark, sf_dir):
    p, _, _ = marked(spark, sf_dir)
    return p.select("label", F.get("m0", 0).alias("m0"), F.get("m1", 0).alias("m1"))


@query(BASE + f", {_MARKERS} SELECT label, {_PASS_AND} AS pass FROM m, w")
def marker_test_and(spark, sf_dir):
    p, starts, mapping = marked(spark, sf_dir)
    return p.select("label", M.term_test([[100, 400], [4]], starts, mapping, BITS).alias("pass"))


@query(BASE + f", {_MARKERS} SELECT label, {_PASS_DNF} AS pass FROM m, w")
def marker_test_dnf(spark, sf_dir):
    p, starts, mapping = marked(spark, sf_dir)
    return p.select("label", M.disjunction_test(DNF, starts, mapping, BITS).alias("pass"))


@query(BASE + f""", {_MARKERS}, t AS (SELECT {_PASS_DNF} AS pass, {DNF_SQL} AS hit FROM m, w),
    c AS (SELECT count(*) AS rows, count(*) FILTER (pass) AS passed, count(*) FILTER (pass AND hit) AS true_positives, count(*) FILTER (pass AND NOT hit) AS false_positives, count(*) FILTER (NOT pass AND hit) AS false_negatives FROM t)
    SELECT *, coalesce(false_positives / CAST(nullif(passed, 0) AS DOUBLE), 0.0) AS fp_rate, (rows - passed) / CAST(rows AS DOUBLE) AS rejection_rate FROM c""")
def marker_fp_stats(spark, sf_dir):
    p, starts, mapping = marked(spark, sf_dir)
    t = p.select(M.disjunction_test(DNF, starts, mapping, BITS).alias("pass"), P.disjunction(DNF).alias("hit"))
    return t.agg(*M.rates(F.col("pass"), F.col("hit")))


@query(BASE + f", {_MARKERS} SELECT CAST(sum(bit_count(m0)) AS BIGINT) AS bits0, CAST(sum(bit_count(m1)) AS BIGINT) AS bits1, count(*) AS records FROM m")
def marker_bit_counts(spark, sf_dir):
    p, _, _ = marked(spark, sf_dir)
    return p.agg(F.sum(M.n_bits(F.col("m0"))).alias("bits0"), F.sum(M.n_bits(F.col("m1"))).alias("bits1"), F.count(F.lit(1)).alias("records"))


@query(BASE + f", {_MARKERS} SELECT p.cls, bit_or(m0) AS m0, bit_or(m1) AS m1 FROM m JOIN p USING (label) GROUP BY p.cls")
def marker_merge(spark, sf_dir):
    p, _, _ = marked(spark, sf_dir)
    g = p.groupBy("cls").agg(M.merged_agg(F.col("m0"), BITS).alias("m0"), M.merged_agg(F.col("m1"), BITS).alias("m1"))
    return g.select("cls", F.get("m0", 0).alias("m0"), F.get("m1", 0).alias("m1"))


@query(BASE + f""", old AS (SELECT item AS label, CAST((row_number() OVER (ORDER BY item) - 1) % 4 AS INTEGER) AS slot FROM (SELECT DISTINCT unnest(a1) AS item FROM p) WHERE item < 3),
    new AS (SELECT item, row_number() OVER (ORDER BY item) AS place FROM (SELECT DISTINCT unnest(a1) AS item FROM p) WHERE item >= 3),
    used AS (SELECT s.slot, count(old.label) AS c FROM generate_series(0, 3) s(slot) LEFT JOIN old ON old.slot = s.slot GROUP BY s.slot),
    free AS (SELECT slot, row_number() OVER (ORDER BY lv, slot) AS place FROM (SELECT slot, unnest(range(c, c + (SELECT count(*) FROM new))) AS lv FROM used))
    SELECT label, slot FROM old UNION ALL SELECT item, CAST(free.slot AS INTEGER) FROM new JOIN free USING (place)""")
def register_labels(spark, sf_dir):
    p = points(spark, sf_dir)
    first = p.select(F.explode("a1").alias("x")).where("x < 3").distinct().agg(F.sort_array(F.collect_set("x")).alias("xs"))
    old = first.select(F.posexplode("xs").alias("i", "label")).select("label", F.pmod("i", F.lit(4)).cast("int").alias("slot"))
    return C.registered(old, p, "a1", 4)


# -- statistics


@query(BASE + f"SELECT count(*) AS n, count(*) FILTER ({DNF_SQL}) AS n_match, count(*) FILTER ({DNF_SQL}) / CAST(count(*) AS DOUBLE) AS selectivity FROM p")
def selectivity_dnf(spark, sf_dir):
    hit = F.count_if(P.disjunction(DNF))
    return points(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), hit.alias("n_match"), (hit / F.count(F.lit(1))).alias("selectivity"))


_SEL = f"""s AS (SELECT q.qid, count(p.label) AS n_match, count(p.label) / CAST((SELECT count(*) FROM p) AS DOUBLE) AS selectivity
  FROM q LEFT JOIN p ON (p.a0 BETWEEN q.qa0 - 150 AND q.qa0 + 150 AND list_contains(p.a1, q.qcls)) OR list_has_all(p.a1, [2, 7]) GROUP BY q.qid)"""


def _sel(spark, sf_dir):
    p = points(spark, sf_dir)
    return stats.selectivity(p, query_rows(p))


@query(BASE + f", {_SEL} SELECT qid, n_match, selectivity FROM s")
def selectivity_per_query(spark, sf_dir):
    return _sel(spark, sf_dir)


@query(BASE + "SELECT q.qid, count(p.label) AS n_match, count(p.label) / CAST((SELECT count(*) FROM p) AS DOUBLE) AS selectivity FROM q LEFT JOIN p ON p.a0 BETWEEN q.qa0 - 150 AND q.qa0 + 150 AND list_contains(p.a1, q.qcls) GROUP BY q.qid")
def selectivity_and(spark, sf_dir):
    p = points(spark, sf_dir)
    return stats.selectivity(p, query_rows(p).withColumn("terms", F.slice("terms", 1, 1)))


@query(BASE + f", {_SEL} SELECT b AS bin, count(s.qid) AS n FROM generate_series(0, 9) t(b) LEFT JOIN s ON least(floor(selectivity * 10), 9) = b GROUP BY b")
def selectivity_histogram(spark, sf_dir):
    return stats.selectivity_histogram(_sel(spark, sf_dir))


@query(BASE + f", {_SEL} SELECT min(n_match) AS min_match, avg(n_match) AS mean_match, max(n_match) AS max_match, CAST(sum(n_match) AS BIGINT) AS sum_match FROM s")
def live_summary(spark, sf_dir):
    return stats.summary(_sel(spark, sf_dir))


@query(BASE + "SELECT item, count(*) AS n FROM (SELECT unnest(a1) AS item FROM p) GROUP BY item")
def label_frequency(spark, sf_dir):
    return stats.label_frequency(points(spark, sf_dir))


@query(BASE + "SELECT unnest(a1) AS item, label FROM p")
def inverted_lists(spark, sf_dir):
    return stats.inverted_lists(points(spark, sf_dir))


@query(BASE + "SELECT label, a0 AS v, row_number() OVER (ORDER BY a0, label) - 1 AS rk FROM p")
def attr_rank(spark, sf_dir):
    return stats.attr_rank(points(spark, sf_dir))


@query(BASE + "SELECT q.qid, count(p.label) AS n FROM q LEFT JOIN p ON p.a0 BETWEEN q.qa0 - 150 AND q.qa0 + 150 GROUP BY q.qid")
def range_count(spark, sf_dir):
    p = points(spark, sf_dir)
    return stats.range_counts(p, query_rows(p).select("qid", (F.col("qa0") - 150).alias("lo"), (F.col("qa0") + 150).alias("hi")))


@query(BASE + f", {_STARTS} SELECT p.cls AS cluster_id, slot, count(*) AS n FROM p JOIN sl ON p.label = sl.label GROUP BY ALL")
def cht_histogram(spark, sf_dir):
    p = points(spark, sf_dir)
    return stats.cluster_histogram(p, F.array(C.numeric_slot(F.col("a0"), C.numeric_starts(p, "a0", BITS))), "cls")


@query(BASE + f""", {_STARTS}, b AS (SELECT CAST((SELECT greatest(0, count(*) - 1) FROM st WHERE start <= 100) AS BIGINT) AS lo, CAST((SELECT greatest(0, count(*) - 1) FROM st WHERE start <= 400) AS BIGINT) AS hi)
    SELECT p.cls AS cluster_id, count(*) FILTER (slot BETWEEN lo AND hi) AS estimate FROM p JOIN sl ON p.label = sl.label, b GROUP BY p.cls""")
def cht_estimate(spark, sf_dir):
    p = points(spark, sf_dir)
    starts = C.numeric_starts(p, "a0", BITS)
    h = stats.cluster_histogram(p, F.array(C.numeric_slot(F.col("a0"), starts)), "cls")
    return stats.cluster_estimate(h, M.range_slots(100, 400, starts))


@query(BASE + "SELECT cls AS cluster_id, count(*) AS n, min(label) AS first FROM p GROUP BY cls")
def bucket_feed(spark, sf_dir):
    return points(spark, sf_dir).groupBy(F.col("cls").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first"))


# -- evaluation

#: A curve of (group, cell, ef, recall, qps, cmps) and repeated timings (fixed values for the tests).
CURVE = [
    ("a", "1", 10, 0.80, 400.0, 90.0), ("a", "1", 20, 0.94, 300.0, 150.0), ("a", "1", 40, 0.97, 200.0, 260.0),
    ("a", "2", 10, 0.96, 420.0, 80.0), ("a", "2", 20, 0.99, 310.0, 140.0),
    ("b", "1", 10, 0.70, 500.0, 70.0), ("b", "1", 20, 0.85, 450.0, 110.0),
    ("b", "2", 10, 0.90, 350.0, 95.0), ("b", "2", 20, 0.95, 250.0, 170.0),
]
SAMPLES = [(r, v, q) for r, row in enumerate([(100.0, 110.0, 95.0), (104.0, 118.0, 97.0), (98.0, 101.0, 99.0)]) for v, q in zip(("base", "full", "strict"), row)]
_CURVE_SQL = "WITH c(grp, cell, ef, recall, qps, cmps) AS (VALUES " + ", ".join(f"('{g}', '{c}', {e}, {r}::DOUBLE, {q}::DOUBLE, {m}::DOUBLE)" for g, c, e, r, q, m in CURVE) + ")"
_SAMPLES_SQL = "WITH s(round, variant, qps) AS (VALUES " + ", ".join(f"({r}, '{v}', {q}::DOUBLE)" for r, v, q in SAMPLES) + ")"


def curve(spark):
    return spark.createDataFrame(CURVE, "grp string, cell string, ef int, recall double, qps double, cmps double")


def samples(spark):
    return spark.createDataFrame(SAMPLES, "round int, variant string, qps double")


@query(_knn_sql(where=DNF_SQL, k=K, cols="*").replace("SELECT * FROM r WHERE", ", t AS (SELECT qid, label FROM r WHERE") + f"""),
    h AS (SELECT qid, label FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY dist, label) AS rk FROM d WHERE label % 7 <> 0) WHERE rk <= {K})
    SELECT t.qid, count(h.label) / {K}.0::DOUBLE AS recall FROM t LEFT JOIN h ON t.qid = h.qid AND t.label = h.label GROUP BY t.qid""")
def recall_at_k(spark, sf_dir):
    p = points(spark, sf_dir)
    q = query_rows(p)
    truth = knn.knn(p, q, K, predicate=P.disjunction(DNF))
    return evaluate.recall(knn.knn(p, q, K, predicate=P.disjunction(DNF) & (F.col("label") % 7 != 0)), truth, K)


_QPS = """, w AS (SELECT *, lead(recall) OVER x AS r2, lead(qps) OVER x AS q2, row_number() OVER x AS nth FROM c WINDOW x AS (PARTITION BY grp, cell ORDER BY ef)),
v AS (SELECT grp, cell, ef, CASE WHEN nth = 1 AND recall >= 0.95 THEN {first} WHEN recall < 0.95 AND r2 >= 0.95 THEN qps + (0.95::DOUBLE - recall) / (r2 - recall) * (q2 - qps) END AS value FROM w),
a AS (SELECT grp, cell, arg_min(value, ef) FILTER (value IS NOT NULL) AS qps_at_target FROM v GROUP BY ALL)"""


@query(_CURVE_SQL + _QPS.format(first="qps") + " SELECT grp, cell, round(qps_at_target, 9) AS qps_at_target FROM a")
def qps_at_recall(spark, sf_dir):
    return evaluate.qps_at_recall(curve(spark), 0.95, ["grp", "cell"]).select("grp", "cell", F.round("qps_at_target", 9).alias("qps_at_target"))


@query(_CURVE_SQL + _QPS.format(first="CASE WHEN recall = 0.95 THEN qps END") + " SELECT grp, cell, round(qps_at_target, 9) AS qps_at_target FROM a")
def qps_at_recall_inside(spark, sf_dir):
    return evaluate.qps_at_recall(curve(spark), 0.95, ["grp", "cell"], extrapolate_min=False).select("grp", "cell", F.round("qps_at_target", 9).alias("qps_at_target"))


@query(_CURVE_SQL + _QPS.format(first="qps") + " SELECT grp, max(round(qps_at_target, 9)) FILTER (cell = '1') AS c1, max(round(qps_at_target, 9)) FILTER (cell = '2') AS c2 FROM a GROUP BY grp")
def qps_pivot(spark, sf_dir):
    t = evaluate.qps_at_recall(curve(spark), 0.95, ["grp", "cell"]).withColumn("qps_at_target", F.round("qps_at_target", 9))
    return evaluate.pivoted(t, "grp", "cell", "qps_at_target", ["1", "2"]).withColumnsRenamed({"1": "c1", "2": "c2"})


@query(_CURVE_SQL + " SELECT grp, cell, min(ef) FILTER (recall >= 0.95) AS ef FROM c GROUP BY ALL")
def calibrated_ef(spark, sf_dir):
    return evaluate.first_ef(curve(spark), 0.95, ["grp", "cell"])


@query(_SAMPLES_SQL + ", r AS (SELECT s.variant, s.qps / b.qps AS ratio FROM s JOIN s b ON s.round = b.round AND b.variant = 'base' WHERE s.variant <> 'base') SELECT variant, round(median(ratio), 9) AS median_ratio, round(min(ratio), 9) AS min_ratio, round(max(ratio), 9) AS max_ratio FROM r GROUP BY variant")
def paired_contrast(spark, sf_dir):
    c = evaluate.paired_contrasts(samples(spark), "base")
    return c.select("variant", *[F.round(x, 9).alias(x) for x in ("median_ratio", "min_ratio", "max_ratio")])


@query(_SAMPLES_SQL + " SELECT variant, median(qps) AS qps FROM s GROUP BY variant")
def median_repeat(spark, sf_dir):
    return evaluate.median_of_repeats(samples(spark), ["variant"], ["qps"])


@query(_SAMPLES_SQL + " SELECT s.round, s.variant, round(s.qps / b.qps - 1, 9) AS change, s.qps > 1.05 * b.qps AS exceeds FROM s JOIN s b ON s.round = b.round AND b.variant = 'base'")
def relative_change(spark, sf_dir):
    s = samples(spark)
    both = s.join(s.where("variant = 'base'").select("round", F.col("qps").alias("b")), "round")
    return both.select("round", "variant", F.round(evaluate.relative_change(F.col("qps"), F.col("b")), 9).alias("change"), evaluate.exceeds(F.col("qps"), F.col("b")).alias("exceeds"))


@query(_knn_sql(cols="qid, CASE WHEN qid % 3 = 0 THEN rk + 1 ELSE rk END AS rk, CASE WHEN qid % 7 = 0 AND rk = 2 THEN label + 100000000 ELSE label END AS label, CASE WHEN qid % 40 = 0 THEN -dist ELSE dist END AS dist").replace("SELECT qid, CASE", ", x AS (SELECT qid, CASE") + """)
    SELECT (SELECT count(*) FROM (SELECT rk, row_number() OVER (PARTITION BY qid ORDER BY rk) AS nth FROM x) WHERE rk < 1 OR rk > 10 OR rk <> nth) AS bad_ranks,
    (SELECT count(*) FROM (SELECT dist, lag(dist) OVER (PARTITION BY qid ORDER BY rk) AS before FROM x) WHERE before > dist) AS unsorted,
    (SELECT count(*) - count(DISTINCT (qid, label)) FROM x) AS duplicates, (SELECT count(*) FROM x WHERE label NOT IN (SELECT label FROM p)) AS unknown""")
def result_validation(spark, sf_dir):
    """What the validation says of results with faults put in: ranks, order and labels of some queries."""
    p = points(spark, sf_dir)
    r = knn.knn(p, query_rows(p), K)
    spoilt = r.select(
        "qid", F.when(F.col("qid") % 3 == 0, F.col("rk") + 1).otherwise(F.col("rk")).alias("rk"),
        F.when((F.col("qid") % 7 == 0) & (F.col("rk") == 2), F.col("label") + 100_000_000).otherwise(F.col("label")).alias("label"),
        F.when(F.col("qid") % 40 == 0, -F.col("dist")).otherwise(F.col("dist")).alias("dist"),
    )
    return evaluate.violations(spoilt, K, p)


@query(_knn_sql(cols="qid, rk, label").replace("SELECT qid,", ", x AS (SELECT qid,") + """)
    SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', qid, rk, label)), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM x""")
def result_digest(spark, sf_dir):
    p = points(spark, sf_dir)
    return evaluate.text_digest(knn.knn(p, query_rows(p), K), ["qid", "rk", "label"])


# -- graphs

M_EDGES = 6
_EDGES = f"""e AS (SELECT src, dst, CAST(rk - 1 AS INTEGER) AS slot, dist FROM (
  SELECT a.label AS src, b.label AS dst, dist, row_number() OVER (PARTITION BY a.label ORDER BY dist, b.label) AS rk
  FROM (SELECT x.label AS la, y.label AS lb, {_l2("x.vector", "y.vector")} AS dist FROM p x JOIN p y ON x.label <> y.label) d JOIN p a ON a.label = la JOIN p b ON b.label = lb) WHERE rk <= {M_EDGES})"""




def _prune(cand: str, most: int) -> str:
    """SQL tables for diversity pruning of ``cand`` (src, dst, i, dist; i from 0, nearest first, below 63): kept(src, dst, slot, dist).

    ``mask`` has a bit for each nearer candidate that is closer to this one than the source is.
    """
    return f"""dom AS (SELECT x.src, x.i, x.dst, x.dist, coalesce(bit_or(CASE WHEN {_l2("a.vector", "b.vector")} < x.dist THEN CAST(1 AS BIGINT) << y.i END), 0) AS mask
      FROM {cand} x LEFT JOIN {cand} y ON x.src = y.src AND y.i < x.i LEFT JOIN p a ON a.label = x.dst LEFT JOIN p b ON b.label = y.dst GROUP BY ALL),
    walk AS (SELECT src, -1::BIGINT AS i, 0::BIGINT AS have FROM (SELECT DISTINCT src FROM dom)
      UNION ALL SELECT walk.src, dom.i, CASE WHEN (dom.mask & have) = 0 AND bit_count(have) < {most} THEN have | (CAST(1 AS BIGINT) << dom.i) ELSE have END FROM walk JOIN dom ON dom.src = walk.src AND dom.i = walk.i + 1),
    kept AS (SELECT dom.src, dom.dst, dom.dist, CAST(row_number() OVER (PARTITION BY dom.src ORDER BY dom.i) - 1 AS INTEGER) AS slot
      FROM dom JOIN (SELECT src, arg_max(have, i) AS have FROM walk GROUP BY src) w ON w.src = dom.src AND (w.have >> dom.i) & 1 = 1)"""


RECURSIVE = BASE.replace("WITH p", "WITH RECURSIVE p")


def edges(spark, sf_dir):
    p = points(spark, sf_dir)
    return p, graph.cut(graph.knn_graph(p, M_EDGES))


@query(BASE + f", {_EDGES} SELECT src, dst, slot, round(dist, 9) AS dist FROM e")
def knn_graph(spark, sf_dir):
    p = points(spark, sf_dir)
    return graph.knn_graph(p, M_EDGES).select("src", "dst", "slot", F.round("dist", 9).alias("dist"))


@query(BASE + f", {_EDGES} SELECT p.label, count(e.src) AS degree FROM p LEFT JOIN e ON e.src = p.label GROUP BY p.label")
def degrees(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    return graph.degrees(e, p)


@query(BASE + f", {_EDGES} SELECT p.label, count(e.dst) AS degree FROM p LEFT JOIN e ON e.dst = p.label GROUP BY p.label")
def in_degrees(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    return graph.in_degrees(e, p)


@query(BASE + f", {_EDGES} SELECT src, slot, dst, round(dist, 9) AS dist FROM e WHERE src = 7")
def neighbors(spark, sf_dir):
    _, e = edges(spark, sf_dir)
    return graph.neighbours(e, 7).withColumn("dist", F.round("dist", 9))


@query(BASE + f""", {_EDGES}, g AS (SELECT p.label, count(e.dst) AS degree FROM p LEFT JOIN e ON e.dst = p.label GROUP BY p.label)
    SELECT (SELECT count(*) FROM e WHERE src = dst) AS self_loops, (SELECT count(*) FROM e) AS edges, 0::BIGINT AS duplicates,
    (SELECT count(*) FROM g WHERE degree = 0) AS unreferenced, (SELECT min(degree) FROM g) AS min_in_degree, (SELECT max(degree) FROM g) AS max_in_degree""")
def integrity(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    return graph.integrity(e, p)


@query(BASE + f", {_EDGES} SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM e c WHERE c.src = a.src AND c.dst = b.dst)")
def two_hop(spark, sf_dir):
    _, e = edges(spark, sf_dir)
    return graph.two_hop(e)


@query(BASE.replace("WITH p", "WITH RECURSIVE p") + f""", {_EDGES}, b AS (SELECT 0::BIGINT AS label, 0 AS hops UNION SELECT e.dst, b.hops + 1 FROM b JOIN e ON e.src = b.label WHERE b.hops < 30)
    SELECT label, min(hops) AS hops FROM b GROUP BY label""")
def reachability(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    return graph.reachable(e, spark.createDataFrame([(0,)], "label long"))


@query(BASE.replace("WITH p", "WITH RECURSIVE p") + f""", {_EDGES}, b AS (SELECT 0::BIGINT AS label, 0 AS hops UNION SELECT e.dst, b.hops + 1 FROM b JOIN e ON e.src = b.label WHERE b.hops < 30),
    h AS (SELECT DISTINCT label FROM b), g AS (SELECT src, count(*) AS degree FROM e GROUP BY src)
    SELECT count(*) AS total, count(*) FILTER (NOT deleted) AS alive, count(*) FILTER (deleted) AS dead, count(*) FILTER (NOT deleted AND p.label >= 100) AS new_alive, count(*) FILTER (deleted AND p.label >= 100) AS new_dead,
    count(*) FILTER (NOT deleted AND h.label IS NOT NULL) AS reachable_alive, avg(coalesce(degree, 0)) AS mean_degree, avg(CASE WHEN deleted THEN 1.0 ELSE 0.0 END) AS dead_share
    FROM p LEFT JOIN h ON h.label = p.label LEFT JOIN g ON g.src = p.label""")
def entry_point_diag(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    return graph.entry_diagnostic(e, p, spark.createDataFrame([(0,)], "label long"), 100)


@query(RECURSIVE + f""", {_EDGES}, c AS (SELECT src, dst, CAST(slot AS BIGINT) AS i, dist FROM e), {_prune("c", M_EDGES)}
    SELECT src, dst, slot, round(dist, 9) AS dist FROM kept""")
def rng_prune(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    return graph.rng_pruned(e, p, M_EDGES).withColumn("dist", F.round("dist", 9))


@query()
def nsw_build(spark, sf_dir):
    p = points(spark, sf_dir)
    return graph.connected(graph.near_graph(p, M_EDGES), p, 2 * M_EDGES)


def _layers(spark, sf_dir):
    p = points(spark, sf_dir)
    return p, graph.build_layers(p, M_EDGES, 8 * M_EDGES)


@query()
def graph_search(spark, sf_dir):
    p, layers = _layers(spark, sf_dir)
    return graph.layered_search(layers, p, query_rows(p), K, 64)


def _filtered_search(spark, sf_dir):
    p, starts, mapping = marked(spark, sf_dir)
    layers = graph.build_layers(p, M_EDGES, 8 * M_EDGES)
    layers.base = graph.cut(graph.marker_edges(layers.base, p.where(~F.col("deleted")), BITS))
    gate = M.disjunction_test(DNF, starts, mapping, BITS)
    return p, graph.layered_search(layers, p, query_rows(p), K, 64, predicate=P.disjunction(DNF), gate=gate)


def _floor(found: DataFrame, p: DataFrame, q: DataFrame, predicate) -> DataFrame:
    """Per query: results, whether all are live matches at their exact distances, whether 90 % of the true ones are among them."""
    ok = p.where(~F.col("deleted") & predicate)
    truth = knn.knn(ok, q, K)
    exact = found.join(ok.select("label", F.col("vector").alias("v")), "label", "left").join(q.select("qid", F.col("vector").alias("qv")), "qid")
    fine = F.bool_and(F.col("v").isNotNull() & (F.abs(D.l2(F.col("qv"), F.col("v")) - F.col("dist")) < 1e-9))
    per = exact.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.coalesce(fine, F.lit(False)).alias("exact"))
    mean = evaluate.recall(found, truth, K).agg((F.avg("recall") >= 0.9).alias("recalled"))
    return per.crossJoin(mean)


def _floor_sql(where: str) -> str:
    return BASE + f"SELECT qid, least({K}, (SELECT count(*) FROM p WHERE NOT deleted AND {where})) AS n, true AS exact, true AS recalled FROM q"


@query(_floor_sql("true"))
def graph_search_floor(spark, sf_dir):
    p, layers = _layers(spark, sf_dir)
    q = query_rows(p)
    return _floor(graph.cut(graph.layered_search(layers, p, q, K, 64)), p, q, F.lit(True))


@query(_floor_sql(DNF_SQL))
def graph_search_filtered_floor(spark, sf_dir):
    p, found = _filtered_search(spark, sf_dir)
    return _floor(graph.cut(found), p, query_rows(p), P.disjunction(DNF))


@query(BASE + f""", {_EDGES}, n1 AS (SELECT src, dst FROM e),
    h2 AS (SELECT DISTINCT a.src, b.dst FROM n1 a JOIN n1 b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM n1 c WHERE c.src = a.src AND c.dst = b.dst)),
    h3 AS (SELECT DISTINCT a.src, b.dst FROM h2 a JOIN n1 b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM n1 c WHERE c.src = a.src AND c.dst = b.dst) AND NOT EXISTS (SELECT 1 FROM h2 c WHERE c.src = a.src AND c.dst = b.dst)),
    l AS (SELECT label, unnest(a1) AS item FROM p), rare AS (SELECT item FROM l GROUP BY item HAVING count(*) <= 0.5 * (SELECT count(*) FROM p)),
    rl AS (SELECT l.* FROM l JOIN rare USING (item)), have AS (SELECT n1.src, rl.item, count(*) AS have FROM n1 JOIN rl ON rl.label = n1.dst GROUP BY ALL),
    need AS (SELECT rl.label AS src, rl.item, 8 - coalesce(have, 0) AS need FROM rl LEFT JOIN have ON have.src = rl.label AND have.item = rl.item WHERE coalesce(have, 0) < 8),
    far AS (SELECT src, dst, 2 AS hops FROM h2 UNION ALL SELECT src, dst, 3 FROM h3),
    r AS (SELECT far.*, rl.item, need, row_number() OVER (PARTITION BY far.src, rl.item ORDER BY hops, dst) AS nth FROM far JOIN rl ON rl.label = far.dst JOIN need ON need.src = far.src AND need.item = rl.item)
    SELECT src, dst, item, hops FROM r WHERE nth <= need""")
def augment_same_label(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    return graph.augment_same_label(e, p)


@query()
def augment_by_marker(spark, sf_dir):
    p, starts, mapping = marked(spark, sf_dir)
    return graph.augment_by_marker(edges(spark, sf_dir)[1], p)


@query()
def augment_cht(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    starts = C.numeric_starts(p, "a0", BITS)
    return graph.augment_cht(e, p, 2 * M_EDGES, 32, 16, F.array(C.numeric_slot(F.col("a0"), starts)))


@query(RECURSIVE + f""", {_EDGES}, near AS (SELECT label, 0 AS hops FROM p WHERE list_contains(a1, 4) AND label % 3 = 0 UNION SELECT e.dst, near.hops + 1 FROM near JOIN e ON e.src = near.label WHERE near.hops < 40),
    h AS (SELECT label, min(hops) AS hops FROM near GROUP BY label),
    v AS (SELECT label, label AS region, 0 AS hops FROM h WHERE hops = 0 UNION ALL SELECT e.dst, min(v.region), v.hops + 1 FROM v JOIN e ON e.src = v.label JOIN h ON h.label = e.dst AND h.hops = v.hops + 1 GROUP BY e.dst, v.hops),
    b AS (SELECT r1, r2, arg_min((src, dst), (cost, src, dst)) AS e, min(cost) AS cost FROM (SELECT e.src, e.dst, a.region AS r1, c.region AS r2, a.hops + c.hops + 1 AS cost FROM e JOIN v a ON a.label = e.src JOIN v c ON c.label = e.dst WHERE a.region <> c.region) GROUP BY r1, r2),
    links AS (SELECT e[1] AS src, e[2] AS dst FROM (SELECT *, row_number() OVER (PARTITION BY r1 ORDER BY cost, r2) AS nth FROM b) WHERE nth <= 4),
    up AS (SELECT e.dst, min(e.src) AS src FROM e JOIN v a ON a.label = e.src JOIN v c ON c.label = e.dst WHERE a.region = c.region AND c.hops = a.hops + 1 GROUP BY e.dst),
    way AS (SELECT src AS at FROM links UNION SELECT dst FROM links UNION SELECT up.src FROM way JOIN up ON up.dst = way.at)
    SELECT src, dst FROM links UNION SELECT up.src, up.dst FROM way JOIN up ON up.dst = way.at""")
def color_voronoi(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    seeds = p.where(F.array_contains("a1", 4) & (F.col("label") % 3 == 0)).select("label")
    regions = graph.cut(graph.voronoi(e, seeds))
    return graph.coloured(e, regions, graph.bridges(e, regions))


@query(RECURSIVE + f""", s AS (SELECT label, vector FROM p WHERE list_contains(a1, 4)),
    c AS (SELECT src, dst, i, dist FROM (SELECT x.label AS src, y.label AS dst, {_l2("x.vector", "y.vector")} AS dist, row_number() OVER (PARTITION BY x.label ORDER BY {_l2("x.vector", "y.vector")}, y.label) - 1 AS i FROM s x JOIN s y ON x.label <> y.label) WHERE i < 16),
    {_prune("c", 16)}
    SELECT src, dst, round(dist, 9) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist DESC, dst) AS nth FROM kept) WHERE nth <= 4""")
def color_diverse_tail(spark, sf_dir):
    p = points(spark, sf_dir)
    return graph.diverse_tail(p, p.where(F.array_contains("a1", 4)).select("label"), 16, 4).withColumn("dist", F.round("dist", 9))


@query()
def graph_partition(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    return graph.partitioned(e, p.where(F.col("label") % 50 == 0).select("label"))


# -- clusters


@query(BASE + f""", c AS (SELECT CAST(label AS INTEGER) AS cid, vector AS cv FROM p WHERE label < {FIXED_CENTROIDS}),
    d AS (SELECT p.label, cid, {_l2("p.vector", "cv")} AS dist FROM p, c)
    SELECT label, arg_min(cid, (dist, cid)) AS cluster_id, round(min(dist), 9) AS cluster_dist FROM d GROUP BY label""")
def cluster_assign_fixed_centroids(spark, sf_dir):
    return _fixed(spark, sf_dir).select("label", "cluster_id", F.round("cluster_dist", 9).alias("cluster_dist"))


def _fixed(spark, sf_dir):
    import numpy as np

    p = points(spark, sf_dir)
    c = np.array([r["vector"] for r in p.where(F.col("label") < FIXED_CENTROIDS).orderBy("label").collect()], np.float64)
    return ann.assigned(p, c)


@query(BASE + f""", c AS (SELECT CAST(label AS INTEGER) AS cid, vector AS cv FROM p WHERE label < {FIXED_CENTROIDS}),
    d AS (SELECT p.label, cid, {_l2("p.vector", "cv")} AS dist FROM p, c),
    a AS (SELECT label, arg_min(cid, (dist, cid)) AS cluster_id, min(dist) AS dist FROM d GROUP BY label)
    SELECT cluster_id, arg_min(label, (dist, label)) AS representative FROM a GROUP BY cluster_id""")
def nearest_representative(spark, sf_dir):
    return ann.representatives(_fixed(spark, sf_dir))


def _index(spark, sf_dir):
    return ann.build(points(spark, sf_dir), IndexConfig(dim=64, max_cate_size=10), 16)


@query()
def kmeans_build(spark, sf_dir):
    return _index(spark, sf_dir).clusters.select("cluster_id", "n", "live", "representative")


@query()
def ann_nprobe(spark, sf_dir):
    p = points(spark, sf_dir)
    return ann.search(_index(spark, sf_dir), query_rows(p), K, SearchConfig(nprobe=12))


@query()
def ann_hybrid(spark, sf_dir):
    p = points(spark, sf_dir)
    return planner.hybrid(_index(spark, sf_dir), query_rows(p), DNF, K, SearchConfig(nprobe=12, exact_below=0.0))


@query(_knn_sql(where=f"NOT deleted AND {DNF_SQL}"))
def planned_strict(spark, sf_dir):
    p = points(spark, sf_dir)
    return shown(planner.hybrid(_index(spark, sf_dir), query_rows(p), DNF, K, SearchConfig.variant("strict")))


# -- mutations

_NEW = "n AS (SELECT label + 7 AS label, (a0 + 1) % 1000 AS a0 FROM p WHERE label % 5 = 0)"


@query(BASE + f", {_NEW} SELECT coalesce(n.label, p.label) AS label, CAST(coalesce(n.a0, p.a0) AS INTEGER) AS a0, CASE WHEN n.label IS NOT NULL THEN false ELSE p.deleted END AS deleted FROM p FULL JOIN n ON n.label = p.label")
def upsert_latest(spark, sf_dir):
    p = points(spark, sf_dir).select("label", "a0", "deleted")
    new = p.where("label % 5 = 0").select((F.col("label") + 7).alias("label"), ((F.col("a0") + 1) % 1000).alias("a0"))
    return mutate.upsert(p, new)


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_event(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id")
    return mutate.latest(e, "user_id", "event_id")


@query(BASE + "SELECT label, deleted OR label % 13 = 1 AS deleted FROM p")
def soft_delete(spark, sf_dir):
    p = points(spark, sf_dir).select("label", "deleted")
    return mutate.soft_delete(p, p.where("label % 13 = 1 and not deleted").select("label"))


@query(BASE + ", a AS (SELECT unnest([3, 3, 11, 22, 10000000, 5]) AS label) SELECT a.label::BIGINT AS label, CASE WHEN any_value(p.label) IS NULL THEN 'missing' WHEN bool_or(p.deleted) THEN 'already deleted' WHEN count(*) > 1 THEN 'duplicate' END AS problem FROM a LEFT JOIN p ON p.label = a.label GROUP BY a.label HAVING problem IS NOT NULL")
def delete_validation(spark, sf_dir):
    asked = spark.createDataFrame([(x,) for x in (3, 3, 11, 22, 10_000_000, 5)], "label long")
    return mutate.delete_errors(points(spark, sf_dir), asked)


@query(BASE + "SELECT label, deleted AND label % 22 <> 0 AS deleted FROM p")
def undelete(spark, sf_dir):
    p = points(spark, sf_dir).select("label", "deleted")
    return mutate.undelete(p, p.where("label % 22 = 0 and deleted").select("label"))


@query(BASE + ", d AS (SELECT label, row_number() OVER (ORDER BY label) AS n FROM p WHERE deleted), g AS (SELECT label FROM d WHERE n <= 20) SELECT label, a0, deleted FROM p WHERE label NOT IN (SELECT label FROM g) UNION ALL SELECT 1000000 + label, a0, false FROM p WHERE label < 20")
def replace_records(spark, sf_dir):
    p = points(spark, sf_dir).select("label", "a0", "deleted")
    return mutate.replaced(p, p.where("label < 20").select((F.col("label") + 1_000_000).alias("label"), "a0"))


@query(BASE + "SELECT label, CAST(CASE WHEN label % 6 = 1 AND NOT deleted THEN 0 ELSE a0 END AS INTEGER) AS a0, deleted FROM p")
def update_attr(spark, sf_dir):
    p = points(spark, sf_dir).select("label", "a0", "deleted")
    return mutate.updated(p, p.where("label % 6 = 1 and not deleted").select("label", F.lit(0).alias("a0")), ["a0"])


@query(BASE + "SELECT label, a0 FROM p WHERE label NOT IN (1, 2, 10000000)")
def flat_delete(spark, sf_dir):
    return mutate.removed(points(spark, sf_dir).select("label", "a0"), spark.createDataFrame([(1,), (2,), (10_000_000,)], "label long"))


_DEADNESS = "r AS (SELECT e.src AS label, avg(CASE WHEN b.deleted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS dead_ratio FROM e JOIN p a ON a.label = e.src AND NOT a.deleted JOIN p b ON b.label = e.dst GROUP BY e.src)"


@query(BASE + f", {_EDGES}, {_DEADNESS} SELECT label, round(dead_ratio, 9) AS dead_ratio FROM r WHERE dead_ratio >= 0.1")
def repair_candidates(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    return mutate.repair_candidates(e, p).withColumn("dead_ratio", F.round("dead_ratio", 9))


@query()
def repair_nodes(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    return mutate.repaired(e, p, graph.cut(mutate.repair_nodes(e, p)), 2 * M_EDGES)


@query(BASE + f", {_EDGES}, {_DEADNESS} SELECT label FROM r WHERE dead_ratio > 0")
def dirty_nodes(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    return mutate.dirty(e, p)


@query(BASE + f", {_EDGES} SELECT src, dst FROM e JOIN p a ON a.label = src JOIN p b ON b.label = dst WHERE NOT a.deleted AND NOT b.deleted")
def scrub_edges(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    return mutate.scrubbed(e, p).select("src", "dst")


_PATCH = f"""{_EDGES}, l AS (SELECT e.* FROM e JOIN p a ON a.label = e.src WHERE NOT a.deleted),
keep AS (SELECT l.src, l.dst, l.dist FROM l JOIN p b ON b.label = l.dst WHERE NOT b.deleted),
cand AS (SELECT DISTINCT l.src, e.dst FROM l JOIN p b ON b.label = l.dst AND b.deleted JOIN e ON e.src = l.dst JOIN p c ON c.label = e.dst WHERE NOT c.deleted AND e.dst <> l.src AND NOT EXISTS (SELECT 1 FROM keep k WHERE k.src = l.src AND k.dst = e.dst)),
cd AS (SELECT src, dst, {_l2("a.vector", "b.vector")} AS dist FROM cand JOIN p a ON a.label = src JOIN p b ON b.label = dst),
h AS (SELECT src, count(*) AS have FROM keep GROUP BY src),
fill AS (SELECT src, dst FROM (SELECT cd.*, row_number() OVER (PARTITION BY cd.src ORDER BY dist, dst) AS nth FROM cd) c LEFT JOIN h USING (src) WHERE nth + coalesce(have, 0) <= {M_EDGES})"""


@query(BASE + f", {_PATCH} SELECT src, dst FROM keep UNION ALL SELECT src, dst FROM fill")
def patch_edges(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    return mutate.patched(e, p, M_EDGES).select("src", "dst")


@query(BASE + f""", {_EDGES}, keep AS (SELECT src, dst, dist FROM e JOIN p a ON a.label = src JOIN p b ON b.label = dst WHERE NOT a.deleted AND NOT b.deleted),
    around AS (SELECT DISTINCT mid, x FROM (SELECT src AS x, dst AS mid FROM e UNION ALL SELECT dst, src FROM e) JOIN p a ON a.label = mid AND a.deleted JOIN p b ON b.label = x AND NOT b.deleted),
    near AS (SELECT mid, x, row_number() OVER (PARTITION BY mid ORDER BY {_l2("a.vector", "b.vector")}, x) AS nth FROM around JOIN p a ON a.label = mid JOIN p b ON b.label = x),
    pairs AS (SELECT m.x AS src, n.x AS dst, m.mid, {_l2("a.vector", "b.vector")} AS dist FROM near m JOIN near n ON m.mid = n.mid AND m.x <> n.x AND n.nth <= 50 JOIN p a ON a.label = m.x JOIN p b ON b.label = n.x
      WHERE NOT EXISTS (SELECT 1 FROM keep k WHERE k.src = m.x AND k.dst = n.x)),
    best AS (SELECT DISTINCT src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src, mid ORDER BY dist, dst) AS nth FROM pairs) WHERE nth <= 3),
    h AS (SELECT src, count(*) AS have FROM keep GROUP BY src),
    fill AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS nth FROM best) LEFT JOIN h USING (src) WHERE nth + coalesce(have, 0) <= {2 * M_EDGES})
    SELECT src, dst FROM keep UNION ALL SELECT src, dst FROM fill""")
def delete_in_place(spark, sf_dir):
    p, e = edges(spark, sf_dir)
    return mutate.deleted_in_place(e, p, p.where("deleted").select("label"), 2 * M_EDGES)[0].select("src", "dst")


@query("SELECT r::DOUBLE AS ratio, n::BIGINT AS new_deletes, CASE WHEN r >= 0.5 THEN 'rebuild' WHEN r >= 0.2 AND n >= 100000 THEN 'patch' ELSE 'none' END AS action FROM (VALUES (0.1, 200000), (0.2, 99999), (0.2, 100000), (0.49, 100000), (0.5, 0)) t(r, n)")
def maintenance_action(spark, sf_dir):
    rows = spark.createDataFrame([(0.1, 200_000), (0.2, 99_999), (0.2, 100_000), (0.49, 100_000), (0.5, 0)], "ratio double, new_deletes long")
    return rows.withColumn("action", mutate.maintenance_action(F.col("ratio"), F.col("new_deletes")))


@query(BASE + "SELECT label, cls AS level FROM p WHERE NOT deleted ORDER BY cls DESC, label LIMIT 1")
def entry_replacement(spark, sf_dir):
    return mutate.entry_point(points(spark, sf_dir), "cls")


@query(BASE + "SELECT label, a0 FROM p WHERE NOT deleted")
def rebuild_live(spark, sf_dir):
    return mutate.rebuilt(points(spark, sf_dir)).select("label", "a0")


@query(BASE + f""", {_EDGES}, {_MARKERS}, k AS (SELECT src, dst FROM e JOIN p a ON a.label = src JOIN p b ON b.label = dst WHERE NOT a.deleted AND NOT b.deleted),
    n AS (SELECT k.src AS label, bit_or(m0) AS n0, bit_or(m1) AS n1 FROM k JOIN m ON m.label = k.dst GROUP BY k.src)
    SELECT k.src, k.dst, m.m0 | coalesce(n0, 0) AS m0, m.m1 | coalesce(n1, 0) AS m1 FROM k JOIN m ON m.label = k.dst LEFT JOIN n ON n.label = k.dst""")
def marker_cleanup(spark, sf_dir):
    p, _, _ = marked(spark, sf_dir)
    return mutate.cleaned_markers(edges(spark, sf_dir)[1], p, BITS).select("src", "dst", F.get("m0", 0).alias("m0"), F.get("m1", 0).alias("m1"))


# -- traces and streams


@query("""WITH e AS (SELECT 0 AS stage, 'insert' AS op, 100 AS n UNION ALL SELECT s, 'delete', 20 FROM generate_series(1, 5) t(s) UNION ALL SELECT s, 'insert', 20 FROM generate_series(1, 5) t(s)),
    g AS (SELECT stage, CAST(coalesce(sum(n) FILTER (op = 'insert'), 0) AS BIGINT) AS inserted, CAST(coalesce(sum(n) FILTER (op = 'delete'), 0) AS BIGINT) AS deleted FROM e GROUP BY stage)
    SELECT CAST(stage AS INTEGER) AS stage, inserted, deleted, CAST(sum(inserted) OVER w AS BIGINT) AS occupied, CAST(sum(deleted) OVER w AS BIGINT) AS dead, CAST(sum(inserted - deleted) OVER w AS BIGINT) AS live FROM g WINDOW w AS (ORDER BY stage)""")
def trace_stage_counts(spark, sf_dir):
    return trace.stage_counts(trace.Trace("replace", 100, 20, 200).events(spark))


@query("SELECT x AS label FROM generate_series(40, 139) t(x)")
def trace_live(spark, sf_dir):
    return trace.live_at(trace.Trace("replace", 100, 20, 200).events(spark), 2)


_OPS = "CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END"


@query(f"SELECT user_id AS label, CAST(round(arg_max(value, (ts, event_id)) FILTER ({_OPS} <> 'delete'), 6) AS DOUBLE) AS last_value, arg_max({_OPS}, (ts, event_id)) = 'delete' AS deleted FROM events GROUP BY user_id HAVING count(*) FILTER ({_OPS} <> 'delete') > 0")
def trace_latest(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    at = F.struct("ts", "event_id")
    g = e.groupBy(F.col("user_id").alias("label")).agg(
        F.max_by("value", F.when(op != "delete", at)).alias("v"), (F.max_by(op, at) == "delete").alias("deleted"), F.count_if(op != "delete").alias("n"),
    )
    return g.where("n > 0").select("label", F.round("v", 6).cast("double").alias("last_value"), "deleted")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    return trace.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query(f"SELECT user_id AS label, arg_max(value, (ts, event_id)) AS value, false AS deleted FROM events GROUP BY user_id HAVING arg_max({_OPS}, (ts, event_id)) <> 'delete'")
def stream_apply_trace(spark, sf_dir):
    """Replays the events table as a stream of mutations and returns the points it ends with."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    muts = stream.select(op.alias("op"), F.col("user_id").alias("label"), F.col("value").alias("value"), F.struct("ts", "event_id").alias("seq"))
    home = f"{shared_dir(spark)}/replay-{uuid4().hex}"
    kind = events.schema["value"].dataType.simpleString()
    table = trace.VersionedTable(spark, f"{home}/table")
    trace.replay(muts, table, spark.createDataFrame([], f"label long, value {kind}, deleted boolean"), f"{home}/checkpoint").awaitTermination()
    return table.read()


# -- generators


@query("SELECT k, round(pow(k::DOUBLE, -1.2) / (SELECT sum(pow(x::DOUBLE, -1.2)) FROM generate_series(1, 50) u(x)), 12) AS p FROM generate_series(1, 50) t(k)")
def gen_zipf(spark, sf_dir):
    return G.zipf(spark, 50, 1.2).select("k", F.round("p", 12).alias("p"))


_DRAW = "((a * a + a * 31 + {s} * 17) % 1000003)::DOUBLE / 1000003.0"


def _draw_sql(s: int) -> str:
    a = f"((vec_id * 7919 + {104729 * (s + 1)}) % 1000003)"
    return f"((({a} * {a} + {a} * 31 + {s * 17}) % 1000003)::DOUBLE / 1000003.0)"


@query("SELECT vec_id AS label, CAST(floor(" + _draw_sql(0) + " * 100000) AS INTEGER) AS a0, concat_ws(',', " + ", ".join(f"CASE WHEN {_draw_sql(i + 1)} < {p}::DOUBLE THEN '{i}' END" for i, p in enumerate(G.LABEL_CHANCES)) + ") AS a1 FROM embeddings")
def gen_attributes_hash(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("label"))
    g = G.attributes(e, "label")
    return g.select("label", "a0", F.array_join(F.col("a1").cast("array<string>"), ",").alias("a1"))


@query(BASE + """, r AS (SELECT a0 AS v, row_number() OVER (ORDER BY a0, label) - 1 AS rk FROM p), n AS (SELECT count(*) AS n, greatest(1, floor(count(*) * 0.1)::BIGINT) AS w FROM p),
    s AS (SELECT i AS qid, (i * 7919 + 13) % greatest(1, n.n - n.w + 1) AS s, w FROM generate_series(0, 19) t(i), n)
    SELECT qid, a.v AS lo, b.v AS hi FROM s JOIN r a ON a.rk = s JOIN r b ON b.rk = s + w - 1""")
def gen_predicate_window(spark, sf_dir):
    return G.windows(points(spark, sf_dir), 20, 0.1).select("qid", "lo", "hi")


@query(BASE + """, r AS (SELECT a0 AS v, row_number() OVER (ORDER BY a0, label) - 1 AS rk FROM p), n AS (SELECT count(*) AS n, greatest(1, floor(count(*) * 0.1)::BIGINT) AS w FROM p),
    s AS (SELECT i AS qid, (i * 7919 + 13) % greatest(1, n.n - n.w + 1) AS s, w FROM generate_series(0, 19) t(i), n),
    g AS (SELECT qid, a.v AS lo, b.v AS hi FROM s JOIN r a ON a.rk = s JOIN r b ON b.rk = s + w - 1)
    SELECT qid, count(label) AS n_match, count(label) / CAST((SELECT count(*) FROM p) AS DOUBLE) AS selectivity FROM g LEFT JOIN p ON (a0 BETWEEN lo AND hi AND list_contains(a1, 4)) OR list_has_all(a1, [2, 7]) GROUP BY qid""")
def gen_predicate_dnf(spark, sf_dir):
    p = points(spark, sf_dir)
    q = G.dnf(p, 20, [{"range": 0.1, "labels": [4]}, {"labels": [2, 7]}])
    return stats.selectivity(p, q)


# -- sources and sinks


@query(BASE + "SELECT label, a0, list_aggregate(list_transform(a1, lambda x: CAST(x AS VARCHAR)), 'string_agg', ', ') AS keywords FROM p")
def export_keywords(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("label", "a0", F.array_join(F.col("a1").cast("array<string>"), ", ").alias("keywords"))


@query(BASE + "SELECT label, a0, list_aggregate(list_transform(a1, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS a1, len(vector)::INTEGER AS dim, deleted FROM p")
def snapshot_round_trip(spark, sf_dir):
    path = f"{shared_dir(spark)}/snapshot-{uuid4().hex}"
    io.save(path, IndexConfig(dim=64, max_cate_size=10), points=points(spark, sf_dir))
    _, tables = io.load(spark, path)
    return tables["points"].select("label", "a0", F.array_join(F.col("a1").cast("array<string>"), ",").alias("a1"), F.size("vector").alias("dim"), "deleted")


@query(BASE + "SELECT label, a0, list_aggregate(list_transform(a1, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS a1 FROM p")
def wire_round_trip(spark, sf_dir):
    from .schema import columns_to_wire, wire_to_columns

    p = points(spark, sf_dir).select("label", F.to_json(columns_to_wire((0, 1))).alias("j"))
    p = p.select("label", F.from_json("j", "array<array<int>>").alias("attrs"))
    return _rows(p.select("label", *wire_to_columns(F.col("attrs"), (0, 1))))


@query(BASE + "SELECT label, a0, CAST(hash_len AS BIGINT) AS record_bytes FROM (SELECT label, a0, 4 + 4 * len(vector) AS hash_len FROM p)")
def vector_records(spark, sf_dir):
    p = points(spark, sf_dir)
    return io.vecs_bytes(p).join(p.select("label", "a0"), "label").select("label", "a0", F.length("raw").cast("long").alias("record_bytes"))
