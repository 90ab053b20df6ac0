import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidevec.llm import jaccard_join, suffix_dedup
from tidevec.llm._components import components
from tidevec.llm.jaccard_join import jaccard_components, keep_one
from tidevec.llm.line_dedup import dedup_lines
from tidevec.llm.suffix_dedup import remove_repeats, suffix_array

ROWS = brute.corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, ROWS).cache()


def by_text(docs, out, cols):
    """Results with the texts of their ids; ids of the fixture have one text each, null has several."""
    return sorted((tuple(r[c] for c in cols) for r in out.collect()), key=repr)


@given(st.lists(st.integers(1, 4), max_size=80))
@settings(max_examples=200, deadline=None)
def test_suffix_array(xs):
    assert suffix_array(np.array(xs, np.int64)).tolist() == sorted(range(len(xs)), key=lambda i: xs[i:])


def check_suffix(docs, rows):
    out = remove_repeats(docs)
    got = sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out.collect()), key=repr)
    want = brute.suffix(rows)
    assert got == sorted(((r[0], *want[r[0], r[1]]) for r in rows), key=repr)


def test_suffix_dedup(docs):
    check_suffix(docs, ROWS)


def test_suffix_dedup_other_ways(spark, docs, monkeypatch):
    """The way for hot anchors gives the same."""
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    check_suffix(docs, ROWS)


def test_segments_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    for n in (99, 100, 599, 600, 601, 1099, 1100, 2000):
        starts = [x for _, o in suffix_dedup._segments(np.array([0, n]), 100) for x in range(int(o[0]), int(o[1]) - 99)]
        assert starts == list(range(n - 99))


def test_segments_name_strings_alike(monkeypatch):
    """A very long text, looked at in segments, has each string once, under the anchor it has in one piece."""
    rng = random.Random(5)
    text = "".join(rng.choice("ab \n") for _ in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([1]), pa.array([text])], ["id", "h", "text"])

    def named():
        out = []
        for b in suffix_dedup._anchors(iter([batch]), 100):
            for g, _, i, h, first, last in zip(*(b.column(k).to_pylist() for k in range(6))):
                out += [(i, h, x, g) for x in range(first, last + 1)]
        return sorted(out)

    whole = named()
    assert [x[:3] for x in whole] == [(7, 1, x) for x in range(4901)]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    assert named() == whole


def test_suffix_dedup_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], brute.SCHEMA)).count() == 0


@pytest.mark.parametrize("k,t", [(3, 90), (5, 80), (2, 70)])
def test_jaccard_components(docs, k, t):
    out = jaccard_components(docs, k, t / 100)
    want = brute.components(ROWS, k, t)
    assert by_text(docs, out, ("doc_id", "n_shingles", "component_id")) == sorted(((r[0], *w) for r, w in zip(ROWS, want)), key=repr)


def test_jaccard_tiles(docs, monkeypatch):
    """Clusters that need many tiles."""
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "LARGE", 2)  # groups of more are merged where it saves pairs
    out = jaccard_components(docs, 3, 0.7)
    want = brute.components(ROWS, 3, 70)
    assert by_text(docs, out, ("doc_id", "component_id")) == sorted(((r[0], w[1]) for r, w in zip(ROWS, want)), key=repr)


def test_links_at_the_threshold():
    assert jaccard_join.links_at(9, 10, 9, 0.9) and not jaccard_join.links_at(8, 9, 9, 0.9)
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 60)
        a = set(rng.sample(range(10_000), n))
        b = (a - set(rng.sample(sorted(a), rng.randint(0, max(0, n // 8))))) | set(rng.sample(range(10_000, 20_000), rng.randint(0, max(0, n // 12))))
        x, y = (jaccard_join.mixed(np.array(sorted(s), np.uint64)) for s in (a, b))
        x.sort(), y.sort()
        if a != b and len(a & b) >= 0.8 * len(a | b):
            assert set(jaccard_join.part_keys(x, 0.8).tolist()) & set(jaccard_join.part_keys(y, 0.8).tolist())


def test_bound_lets_links_through():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(jaccard_join.mixed(rng.integers(0, 10**6, n).astype(np.uint64)))
        keep = a[rng.random(len(a)) < rng.uniform(0.7, 1)]
        b = np.unique(np.concatenate([keep, jaccard_join.mixed(rng.integers(10**6, 10**7, int(rng.integers(0, 1 + n // 8))).astype(np.uint64))]))
        shared = len(np.intersect1d(a, b))
        apart = int(np.bitwise_count(jaccard_join.signature(a) ^ jaccard_join.signature(b)).sum())
        for t in (0.7, 0.8, 0.9):
            if len(b) and jaccard_join.links_at(shared, len(a), len(b), t):
                assert jaccard_join.may_link(np.array([len(a)]), np.array([len(b)]), np.array([apart]), t)[0]


def near_copy(rng, s, t):
    """A set that links with ``s`` at ``t`` by as little as can be: elements go, come or are exchanged."""
    n = len(s)
    kind = rng.integers(3)
    if kind == 0:
        out, add = n - int(np.ceil(t * n - 1e-9)), 0
    elif kind == 1:
        out, add = 0, int(n / t + 1e-9) - n
    else:
        out = add = int((1 - t) / (1 + t) * n + 1e-9)
    return np.sort(np.concatenate([rng.permutation(s)[out:], rng.integers(0, 2**63, add).astype(np.uint64)]))


def test_unrelated_sets_share_no_part():
    """Empty parts made all sets of one size share keys, and pairs grow with the square of the table."""
    rng = np.random.default_rng(8)
    keys = [set(jaccard_join.part_keys(np.unique(rng.integers(0, 2**63, int(n)).astype(np.uint64)), 0.8).tolist()) for n in rng.integers(100, 4000, 150)]
    pairs = sum(bool(x & y) for i, x in enumerate(keys) for y in keys[:i])
    assert pairs <= 0.02 * len(keys) * (len(keys) - 1) / 2
    for t in (0.5, 0.8, 0.9):
        for n in rng.integers(1, 3000, 150):
            x = np.unique(rng.integers(0, 2**63, int(n)).astype(np.uint64))
            y = near_copy(rng, x, t)
            assert np.array_equal(x, y) or set(jaccard_join.part_keys(x, t).tolist()) & set(jaccard_join.part_keys(y, t).tolist())


def test_large_unrelated_sets_make_no_pairs():
    """Signatures of one width were full for large sets, so that all that met made one cluster."""
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 2**63, int(n)).astype(np.uint64)) for n in rng.integers(3500, 12000, 80)]
    copies = [near_copy(rng, s, 0.8) for s in sets]
    every = sets + copies
    for groups in (1, 10):  # a large one, and small ones
        at = sorted(range(len(every)), key=lambda i: i % groups)
        sigs = [jaccard_join.signature(every[i], jaccard_join.width_for(len(every[i]), 0.8)).tobytes() for i in at]
        cols = [pa.array([i % groups for i in at]), pa.array([0] * len(at)), pa.array(at), pa.array([len(every[i]) for i in at]), pa.array(sigs, pa.binary())]
        rows = pa.RecordBatch.from_arrays(cols, ["tile", "side", "node", "n", "sig"])
        got = [tuple(r.values()) for b in jaccard_join._bounded(iter([rows.slice(0, 50), rows.slice(50)]), 0.8) for r in b.to_pylist()]
        assert sorted(got) == [(i, i + 80) for i in range(80)]


def test_keep_one(docs):
    kept = keep_one(docs, 3, 0.9)
    assert kept.columns == docs.columns
    want = brute.components(ROWS, 3, 90)
    ids = sorted({w[1] for r, w in zip(ROWS, want) if w[0] and w[1] is not None})
    bare = sorted(repr(r[0]) for r, w in zip(ROWS, want) if not w[0])
    got = kept.select("doc_id", "text").collect()
    with_words = [r for r in got if brute.shingles(r["text"], 3)]
    assert sorted(r["doc_id"] for r in with_words if r["doc_id"] is not None) == ids
    assert sorted(repr(r["doc_id"]) for r in got if not brute.shingles(r["text"], 3)) == bare


def test_jaccard_of_nothing(spark):
    assert jaccard_components(spark.createDataFrame([], brute.SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}


def test_line_dedup(docs):
    out = dedup_lines(docs)
    got = sorted(((r["doc_id"], r["n_lines"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) for r in out.collect()), key=repr)
    want = brute.lines(ROWS)
    assert got == sorted(((r[0], *want[r[0], r[1]]) for r in ROWS), key=repr)
    assert any(x[2] for x in got)


def test_line_dedup_of_nothing(spark):
    assert dedup_lines(spark.createDataFrame([], brute.SCHEMA)).count() == 0


def test_same_id_with_two_texts(spark):
    t = "w " * 80
    rows = [(1, t + "end", None, None, None), (1, "start " + t, None, None, None), (2, t, None, None, None)]
    out = remove_repeats(spark.createDataFrame(rows, brute.SCHEMA))
    removed = {(r["doc_id"], r["n_bytes"]): sum(s["end"] - s["start"] for s in r["spans"]) for r in out.collect()}
    assert removed[2, 160] == 160  # all of it stands earlier
    assert out.where(F.size("spans") > 0).count() == 3  # each text repeats within itself at least
