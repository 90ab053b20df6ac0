import pytest
from pyspark.sql import functions as F

from tidevec.catalog import points  # noqa: F401
from tidevec.functions import predicates as P

ROWS = [(i, 101 * i + 1, sorted({i % 7, (i + 1) % 7}) if i % 8 else []) for i in range(96)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "label long, a0 int, a1 array<int>").cache()


def hits(df, predicate):
    return {r["label"] for r in df.where(predicate).select("label").collect()}


def brute(terms, modes=None):
    out = set()
    for label, a0, a1 in ROWS:
        for i, (numbers, labels) in enumerate(terms):
            m = modes[i] if modes else (1, 1)
            ok = m[0] == -1 or not numbers or any(lo <= a0 <= hi for lo, hi in zip(numbers[::2], numbers[1::2]))
            if labels and m[1] != -1:
                ok = ok and (any(x in a1 for x in labels) if m[1] == 0 else all(x in a1 for x in labels))
            if ok:
                out.add(label)
    return out


CASES = [
    ([[[1, 1], []]], None),  # singleton
    ([[[1, 1011], []]], None),  # prefix
    ([[[1, 203, 204, 500], []]], None),  # adjacent pair
    ([[[101 * 95 + 1, 101 * 95 + 1], []]], None),  # last value
    ([[[2, 101], []]], None),  # off by one
    ([[[-(2**31), 2**31 - 1], []]], None),  # all
    ([[[1, 1, 102, 102, 203, 203], []]], None),  # three singletons
    ([[[], [1, 2]]], None),
    ([[[], [1, 2]]], [(1, 0)]),
    ([[[1, 5000], [3]], [[], [5, 6]]], None),
    ([[[1, 5000], [3]]], [(1, -1)]),
    ([[[1, 5000], [3]]], [(-1, 1)]),
    ([[[], []]], None),
    ([], None),
    ([[[], []]], [(1, 0)]),  # an empty list never constrains, whatever its mode
]


@pytest.mark.parametrize("terms,modes", CASES)
def test_disjunctions(rows, terms, modes):
    want = brute(terms, modes)
    assert hits(rows, P.disjunction(terms, modes)) == want
    data = [([{"lo": a, "hi": b} for a, b in zip(n[::2], n[1::2])] if not (modes and modes[i][0] == -1) else [], list(ls), modes[i][1] if modes else 1) for i, (n, ls) in enumerate(terms)]
    t = rows.sparkSession.createDataFrame([(data,)], f"t {P.TERMS_TYPE}")
    got = rows.crossJoin(t).where(P.matches(F.col("t"), F.col("a0"), F.col("a1")))
    assert {r["label"] for r in got.collect()} == want


def test_conjunctions(rows):
    assert hits(rows, P.conjunction([[102, 5000], [3, 4]])) == brute([[[102, 5000], [3, 4]]])
    assert len(hits(rows, P.conjunction([[], []]))) == 96
    assert hits(rows, P.conjunction([[-1, -1], []])) == set()  # a real range


def test_refusals():
    with pytest.raises(ValueError):
        P.conjunction([[1], []])
    with pytest.raises(ValueError):
        P.conjunction([[1, 2]])
    with pytest.raises(ValueError):
        P.disjunction([[[], []]] * 17)
    with pytest.raises(ValueError):
        P.disjunction([[[1, 2, 3], []]])
    with pytest.raises(ValueError):
        P.conjunction([[], [9]], max_cate_size=9)
    with pytest.raises(ValueError):
        P.disjunction([[[], []]], [[1, 5]])


def test_forms(rows):
    assert P.flattened([[3, 9], [0, 33]], max_cate_size=40) == [3, 9, 1, 2]
    assert P.flattened([[], []], max_cate_size=32) == [-1, -1, 2**32 - 1]
    assert P.is_disjunction([[[[1, 2], [3]]]]) and not P.is_disjunction([[[1, 2], [3]]])
    assert hits(rows, F.expr(P.as_text([[1, 500], [2]]))) == brute([[[1, 500], [2]]])
    masks = rows.select("label", F.expr(P.mask_sql("a1")).alias("m")).select("label", P.from_mask(F.col("m"), 8).alias("a1"))
    assert {r["label"]: r["a1"] for r in masks.collect()} == {i: a1 for i, _, a1 in ROWS}


def test_unseen_label_matches_nothing(rows):
    assert hits(rows, P.conjunction([[], [60]])) == set()
