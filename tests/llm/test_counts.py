import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidevec.llm.bitsliced import score_slices, slices_of, top_k, top_rows, value_at
from tidevec.llm.decontamination import marked, without_hits
from tidevec.llm.mixing import mix, mixed_rows
from tidevec.llm.sharding import lpt_quotas, shard_documents
from tidevec.llm.token_counts import VOCABULARY, at_limits, encoded_lengths, length_histogram, quantiles

ROWS = brute.corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, ROWS).cache()


# -- mixing


def test_mix(docs):
    got = mix(docs).collect()
    assert len(got) == len(ROWS)
    size = lambda t: len(brute.words(t, lower=False))
    sizes = defaultdict(int)
    for _, t, _, s, _ in ROWS:
        sizes[s] += size(t)
    want = brute.targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert sorted(((r["doc_id"], r["size"], r["source"]) for r in got), key=repr) == sorted(((d, size(t), s) for d, t, _, s, _ in ROWS), key=repr)
    longest = max(size(t) for _, t, *_ in ROWS)
    for s in want:
        assert abs(taken[s] - want[s]) <= longest + 1
    again = mix(docs).select("doc_id", "size", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)


def test_mixed_rows(docs):
    plan = mix(docs).agg(F.sum("copies"), F.sum("taken")).first()
    out = mixed_rows(docs)
    assert out.columns == docs.columns and out.count() == plan[0]


def test_mix_edges(spark):
    assert mix(spark.createDataFrame([], brute.SCHEMA)).count() == 0
    empty = spark.createDataFrame([(1, None, "", "a", 0), (2, "", "", None, 0)], brute.SCHEMA)
    assert {(r["doc_id"], r["size"], r["target"], r["taken"]) for r in mix(empty).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    one = spark.createDataFrame([(i, "w " * 50, "", "a", 0) for i in range(400)], brute.SCHEMA)
    assert abs(mix(one).agg(F.sum("taken")).first()[0] - 30_000) <= 100  # a hot cell of equal documents


# -- decontamination

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron"


def bench_rows():
    some = [r[1] for r in ROWS if r[1] and len(brute.words(r[1], brute.BENCH_WORD)) > 30]
    return [
        (1, PASSAGE), (2, " ".join(brute.words(some[0], brute.BENCH_WORD)[5:25])), (3, "two WORDS"), (4, "one"), (5, None), (6, "?!"), (7, PASSAGE),
        (None, " ".join(brute.words(some[1], brute.BENCH_WORD)[3:14])), (9, "x " * 40), (10, " ".join(brute.words(some[2], brute.BENCH_WORD)[:7])),
    ]


def dirty_rows():
    w = PASSAGE.split()
    more = [
        (900, "Alpha, BETA; gamma-delta epsilon zeta eta theta iota kappa", "", "", 0),  # exactly one window
        (901, "alpha beta gamma delta epsilon zeta eta theta iota", "", "", 0),  # nine words
        (902, ("ü " + PASSAGE + " ß ") * 3, "", "", 0),
        (903, " ".join(w[3:14]) + " " + " ".join(w[1:12]), "", "", 0),
        (904, "x " * 9, "", "", 0), (905, "x " * 23, "", "", 0), (906, "words two words", "", "", 0),
    ]
    return ROWS + more


def test_decontamination(spark):
    rows, bench = dirty_rows(), bench_rows()
    docs, items = brute.frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in marked(docs, items).collect()), key=repr)
    want = [(r[0], *brute.hits(r[1], bench)) for r in rows]
    assert got == sorted(((d, n, h, i, h > 0) for d, n, h, i in want), key=repr)
    clean = without_hits(docs, items)
    assert clean.columns == docs.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d for d, _, h, _ in want if not h)


def test_decontamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert marked(docs, none).where("contaminated or n_hit > 0").count() == 0
    assert marked(spark.createDataFrame([], brute.SCHEMA), spark.createDataFrame(bench_rows(), "item_id long, text string")).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("tidevec.llm.decontamination.MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr("tidevec.llm.decontamination.MAX_BITS", 10)
    test_decontamination(spark)


# -- bit-sliced search


def test_slices():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 200):
        x = rng.integers(-300, 300, (5, n))
        x[2] = 7
        slices, low = slices_of(x)
        for w in ([3, -5, 0, 11, -1], [0, 0, 0, 0, 0], [1, 0, 0, 0, 0], [-9, -9, -9, -9, -9]):
            score, plus = score_slices(slices, low, np.array(w))
            want = np.array(w) @ x
            assert [value_at(score, i) + plus for i in range(n)] == want.tolist()
            alive = np.packbits(np.pad(np.ones(n, np.uint8), (0, -n % 64)), bitorder="little").view(np.uint64)
            for k in (1, 5, n, n + 3):
                assert sorted(top_rows(score, alive, k).tolist()) == sorted(sorted(range(n), key=lambda i: (-want[i], i))[:k])


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(300, 8)) / 3).round(1)  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(300, None), (301, []), (302, [float("nan")] * 8), (303, [None] + [0.1] * 7), (304, [float("inf")] + [0.1] * 7), (305, [0.5, -0.5]), (308, []), (None, [1.0] * 8), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit("x")).repartition(3)
    fine = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64).tolist()) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    got = [tuple(r) for r in top_k(df.where("vec_id % 7 = 0"), df, block_rows=64, block_queries=5).orderBy("query_id", "rank").select("query_id", "rank", "id", "score").collect()]
    want = []
    for qid in sorted({i for i, _ in fine if i % 7 == 0}):
        own = [v for i, v in fine if i == qid]
        best = []
        for q in own:  # a query row that is repeated asks again
            s = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in fine if i != qid]
            best += s
        want += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(sorted(best)[:10])]
    assert got == want
    assert top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(i, [0.5, (i - 3) / 8.0]) for i in range(6)] + [(6, [200_000.0, 1.0]), (7, [-3e6, 0.25]), (8, [1e9, -1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    fine = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64).tolist()) for i, v in rows]
    got = [tuple(r) for r in top_k(df.where("vec_id in (2, 7)"), df, 3).orderBy("query_id", "rank").select("query_id", "rank", "id", "score").collect()]
    want = []
    for qid in (2, 7):
        best = sorted((-sum(a * b for a, b in zip(fine[qid][1], v)), i) for i, v in fine if i != qid)
        want += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(best[:3])]
    assert got == want
    with pytest.raises(Exception, match="too large"):
        top_k(df.where("vec_id = 8"), df, 3, scale=2.0**12).collect()  # the score passes 64 bits
    with pytest.raises(Exception, match="too large"):
        top_k(df, spark.createDataFrame([(1, [1e30])], df.schema), 3).collect()


# -- sharding


def naive_lpt(sizes, n):
    load, got = [0] * n, Counter()
    for s in sorted(sizes, reverse=True):
        k = min(range(n), key=lambda i: (load[i], i))
        load[k] += s
        got[s, k] += 1
    return load


@pytest.mark.parametrize("seed", range(5))
def test_lpt(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 40, rng.integers(1, 400)).tolist() + [500] * int(rng.integers(0, 3))
    n = int(rng.integers(1, 9))
    hist = sorted(Counter(sizes).items(), reverse=True)
    load, count = [0] * n, Counter()
    for size, shard, groups in lpt_quotas(iter(hist), n):
        load[shard] += size * groups
        count[size] += groups
    assert count == Counter(sizes)
    assert sorted(load) == sorted(naive_lpt(sizes, n))


def test_shard_documents(docs):
    got = shard_documents(docs, 4).collect()
    assert len(got) == len(ROWS)
    text = {r[0]: r[1] for r in ROWS if r[0] is not None}
    slots, load, home = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
        if r["doc_id"] is not None:
            t = text[r["doc_id"]]
            assert r["size"] == len((t or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((t or "").encode())
            home[t].add(r["shard"])
    assert all(len(s) == 1 for s in home.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for _, t, *_ in ROWS:
        groups[t] += len((t or "").encode()) + 8
    assert sorted(load[k] for k in range(4)) == sorted(naive_lpt(list(groups.values()), 4))
    assert {(r["doc_id"], r["shard"]) for r in got} == {(r["doc_id"], r["shard"]) for r in shard_documents(docs, 4).collect()}


def test_shards_of_nothing(spark):
    assert shard_documents(spark.createDataFrame([], brute.SCHEMA)).count() == 0


# -- token counts


def test_token_counts(docs):
    import base64

    import tiktoken

    from tidevec.llm.token_counts import PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    ns = sorted(len(enc.encode_ordinary(r[1])) if r[1] else 0 for r in ROWS)
    lengths = encoded_lengths(docs)
    assert sorted(r["n_tokens"] for r in lengths.collect()) == ns
    hist = length_histogram(lengths).cache()
    got = {r["n_tokens"]: r for r in hist.collect()}
    assert set(got) == set(ns)
    for n, r in got.items():
        assert r["docs"] == ns.count(n) and r["tokens"] == n * ns.count(n)
        assert r["docs_from"] == sum(x >= n for x in ns) and r["tokens_from"] == sum(x for x in ns if x >= n)
        assert r["truncated"] == sum(min(x, n) for x in ns)
    for r in at_limits(hist, [0, 10, 100, 10**6]).collect():
        c = r["context"]
        assert (r["docs_over"], r["tokens_over"], r["truncated"]) == (sum(x > c for x in ns), sum(x for x in ns if x > c), sum(min(x, c) for x in ns))
    for r in quantiles(hist, [0.0, 0.25, 0.5, 0.99, 1.0]).collect():
        assert r["n_tokens"] == next(n for n in ns if sum(x <= n for x in ns) >= max(1, np.ceil(r["q"] * len(ns))))


def test_token_counts_of_nothing(spark):
    assert length_histogram(encoded_lengths(spark.createDataFrame([], brute.SCHEMA))).count() == 0


def test_rates_solve_the_dual(spark):
    """Rates have the tilt's form with one multiplier a source, and meet the source's target exactly."""
    import math

    out = mix(brute.frame(spark, ROWS)).toPandas()
    base = math.log(1.5 / 0.5)
    for _, g in out.groupby(out["source"].fillna("\0")):
        target, size = g["target"].iloc[0], g["source_size"].iloc[0]
        assert abs((g["rate"] * g["size"]).sum() - target) <= 1e-6 * target
        some = g[(g["size"] > 0) & (g["rate"] > 1e-6) & (g["rate"] < 2 - 1e-6)]
        if target < 2 * size and len(some) > 1:
            z = some["size"] * len(g) / size
            lam = (np.log(some["rate"] / (2 - some["rate"])) - base) / z
            assert lam.max() - lam.min() < 1e-6 * max(1.0, abs(lam).max())
    again = mix(brute.frame(spark, ROWS)).toPandas()
    cols = ["doc_id", "source", "size", "rate", "copies"]
    key = lambda x: sorted(map(repr, x[cols].itertuples(index=False)))
    assert key(out) == key(again)
