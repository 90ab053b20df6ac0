import os
from collections import Counter, defaultdict

import brute
import pytest

import corpus_pipeline
from tidevec.llm import queries
from tidevec.llm.decontamination import marked

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    """Each stage against a plain version, on what the stage before left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        before, after = docs.collect(), out.collect()
        ids = Counter(r["doc_id"] for r in after)
        if "quality" in name:
            judged = [(r["doc_id"] in ids, labels[r["doc_id"]] == 1) for r in before if r["doc_id"] in labels]
            assert sum(a == b for a, b in judged) >= 0.95 * len(judged)
        elif "Jaccard" in name:
            rows = [(r["doc_id"], r["text"]) for r in before]
            want = brute.components(rows, 5, 80)
            assert sorted(ids) == sorted({c for _, c in want}) and max(ids.values()) == 1
        elif "decontamination" in name:
            assert sorted(ids) == sorted(r["doc_id"] for r in before if not brute.hits(r["text"], bench)[1])
        elif "mixing" in name:
            sizes, taken = defaultdict(int), defaultdict(int)
            for r in before:
                sizes[r["source"]] += len(brute.words(r["text"]))
            for r in after:
                taken[r["source"]] += len(brute.words(r["text"]))
            longest = max(len(brute.words(r["text"])) for r in before)
            for s, t in brute.targets(sizes).items():
                assert abs(taken[s] - t) <= longest + 1
            assert max(ids.values()) <= 2
        else:
            assert ids == Counter(r["doc_id"] for r in before)
            assert {r["shard"] for r in after} <= set(range(24))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == cols
            docs = out
    assert corpus_pipeline.run(spark, SF).count() == len(after)


def test_registered_queries(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_mixing", "op2_decontamination", "op5_jaccard_join", "op6_suffix_dedup", "op8_sharding", "op10_quality"):
        assert queries.QUERIES[name](spark, SF).count() == n


def test_clean_rows_stay_marked_clean(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    items = spark.createDataFrame([(1, "words that no document has at all in this very order here now")], "item_id long, text string")
    assert marked(docs, items).where("contaminated").count() == 0
