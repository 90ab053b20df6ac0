import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidevec.functions import codebook as C
from tidevec.functions import markers as M
from tidevec.functions import predicates as P


def slots(spark, values, n):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "label long, a0 int")
    starts = C.numeric_starts(df, "a0", n)
    return starts, [r["s"] for r in df.select("label", C.numeric_slot(F.col("a0"), starts).alias("s")).orderBy("label").collect()]


def test_equal_counts(spark):
    assert slots(spark, range(32), 8)[1] == [t // 4 for t in range(32)]


def test_extremes_and_constants(spark):
    starts, got = slots(spark, [2**31 - 1] * 4, 4)
    assert starts == [2**31 - 1] * 4 and len(set(got)) == 1
    starts, got = slots(spark, [5] * 9, 3)
    assert starts == [5, 6, 6] and got == [0] * 9
    starts, got = slots(spark, [-(2**31), 0, 2**31 - 1], 3)
    assert got == [0, 1, 2]
    assert slots(spark, [], 3)[0] == [0, 0, 0]


def test_labels_round_robin_and_registration(spark):
    df = spark.createDataFrame([(i, list(range(i % 5 + 1))) for i in range(20)], "label long, a1 array<int>")
    book = C.label_slots(df, "a1", 3)
    assert {r["label"]: r["slot"] for r in book.collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1}
    more = C.map_of(C.registered(book, spark.createDataFrame([(0, [7, 6, 2])], "label long, a1 array<int>"), "a1", 3))
    assert more == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 6: 2, 7: 0}
    assert C.map_of(C.registered(book, df, "a1", 3)) == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1}
    assert C.has_unassigned({0: 0}, 2) and not C.has_unassigned({0: 0, 1: 1}, 2)


terms = st.lists(
    st.tuples(
        st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=2).map(lambda ps: [x for a, b in ps for x in (min(a, b), max(a, b))]),
        st.lists(st.integers(0, 9), max_size=3, unique=True),
    ),
    min_size=1,
    max_size=3,
)


@pytest.fixture(scope="module")
def marked(spark):
    rows = [(i, (i * 37) % 50, sorted({i % 9, (i * 5) % 9})) for i in range(80)]
    df = spark.createDataFrame(rows, "label long, a0 int, a1 array<int>")
    starts, mapping = C.numeric_starts(df, "a0", 70), C.map_of(C.label_slots(df, "a1", 70))
    m0 = M.encode(F.array(C.numeric_slot(F.col("a0"), starts)), 70)
    return df.withColumn("m0", m0).withColumn("m1", M.encode(F.transform("a1", lambda x: C.label_slot(x, mapping)), 70)).cache(), starts, mapping


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(terms, st.lists(st.sampled_from([0, 1]), min_size=3, max_size=3))
def test_markers_never_refuse_a_match(marked, ts, any_all):
    df, starts, mapping = marked
    modes = [(1, m) for m in any_all[: len(ts)]]
    ts = [list(t) for t in ts]
    row = df.agg(*M.rates(M.disjunction_test(ts, starts, mapping, 70, modes), P.disjunction(ts, modes))).first()
    assert row["false_negatives"] == 0


def test_bits(marked):
    df, _, _ = marked
    assert df.agg(F.sum(M.n_bits(F.col("m0")))).first()[0] == 80
    one = df.agg(M.merged_agg(F.col("m1"), 70).alias("m")).select(M.n_bits(F.col("m")).alias("n")).first()["n"]
    assert one == 9
    assert df.where(~M.covers(M.merged(F.col("m0"), F.col("m1")), F.col("m1"))).count() == 0
