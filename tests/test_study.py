"""The study runner: journal, operations, calibration, timings, publication."""

import itertools

import pytest
from pyspark.sql import functions as F

from tidevec import study
from tidevec.functions import generate
from tidevec.plans.index import VectorIndex
from tidevec.schema import IndexConfig
from tidevec.streaming.trace import Trace

CFG = IndexConfig(dim=4, M=4, ef_construction=16, max_cate_size=20)


@pytest.fixture(scope="module")
def records(spark):
    base = spark.range(120).select(F.col("id").alias("label"), F.array(*[((F.col("id") * p) % 97).cast("float") for p in (3, 7, 11, 13)]).alias("vector"))
    return generate.attributes(base, "label").withColumn("deleted", F.lit(False)).cache()


@pytest.fixture(scope="module")
def queries(records):
    return records.where("label % 12 = 0").select(F.col("label").alias("qid"), "vector").cache()


@pytest.fixture(scope="module")
def index(spark, records):
    idx = VectorIndex(spark, CFG, records)
    idx.build_graph()
    return idx


def test_journal(spark, tmp_path):
    j = study.Journal(spark, f"file://{tmp_path}/j")
    assert j.last() == -1 and j.begin(0, {"a": 1}) and j.begin(0, {"a": 1})
    j.commit(0, {"x": 2})
    assert not j.begin(0, {"a": 1}) and j.result(0) == {"x": 2} and j.last() == 0
    with pytest.raises(ValueError, match="another request"):
        j.begin(0, {"a": 2})
    with pytest.raises(ValueError, match="committed"):
        j.commit(0, {})
    j.begin(2, {})
    j.commit(2, {})
    assert j.last() == 0  # the chain is broken at 1


def test_calibration():
    for first, target in itertools.product((1, 2, 3, 17, 64, 100), (0.5, 0.9)):
        ef, seen = study.calibrate(lambda ef: target if ef >= first else 0.1, target, 1, 128)
        assert ef == first and len(seen) < 16
    assert study.calibrate(lambda ef: 0.2, 0.9, 1, 100)[0] is None


def test_paired_rounds():
    seen = []
    out = study.paired_rounds({x: lambda x=x: seen.append(x) for x in "abc"}, 3)
    assert "".join(seen) == "abcbcacab" and len(out) == 9 and {r["round"] for r in out} == {0, 1, 2}
    ok = iter([False, True, True])
    assert len(study.paired_rounds({"a": lambda: None}, 2, clean=lambda times: next(ok))) == 2
    with pytest.raises(RuntimeError):
        study.paired_rounds({"a": lambda: None}, 2, 3, clean=lambda times: False)


def test_operation(spark, records, queries, tmp_path):
    home, trace = f"file://{tmp_path}/op", Trace("replace", 40, 20, 200)
    first = study.run_operation(spark, home, CFG, trace, records, queries, 3, 0.9, through=1)
    assert [r["stage"] for r in first] == [0, 1]
    with pytest.raises(ValueError, match="are committed"):
        study.published(spark, home, trace, f"file://{tmp_path}/early")
    both = study.run_operation(spark, home, CFG, trace, records, queries, 3, 0.9)
    assert both[:2] == first and [(r["live"], r["occupied"]) for r in both] == [(40, 40), (40, 60), (40, 80)]
    assert all(r["recall"] >= 0.9 and r["ef"] for r in both) and both[0]["seconds"]["delete"] is None and both[1]["seconds"]["delete"] > 0
    with pytest.raises(ValueError, match="another request"):
        study.run_operation(spark, home, CFG, trace, records, queries, 3, 0.8)
    table = study.published(spark, home, trace, f"file://{tmp_path}/out")
    assert table.count() == 3 and spark.read.json(f"file://{tmp_path}/out/json").count() == 3
    assert spark.read.option("sep", "\t").option("header", True).csv(f"file://{tmp_path}/out/tsv").columns == table.columns
    with pytest.raises(Exception):
        study.published(spark, home, trace, f"file://{tmp_path}/out")
    again = study.remeasured(spark, home, queries, 3, 0.5)
    assert len(again) == 3 and all(a["ef"] <= b["ef"] for a, b in zip(again, both))


def test_batches(index, queries):
    cells = {"all": [[[0, 100_000], []]], "half": [[[0, 50_000], []], [[], [9]]]}
    out = study.selectivity_batch(index, queries, cells, [16, 64], 5).collect()
    assert {r["cell"] for r in out} == {"all", "half"} and all(r["qps"] > 0 for r in out) and max(r["recall"] for r in out) >= 0.95
    fpr = study.marker_fpr(index, queries, cells, [32], 5).collect()
    assert len(fpr) == 2 and all(r["false_negatives"] == 0 and 0 <= r["fp_rate"] <= 1 and r["recall"] > 0.8 for r in fpr)


def test_first_failure(index, queries):
    assert study.first_failure(index, queries, [[[0, 100_000], []]], 3, 100) is None
    found = study.first_failure(index, queries, [[[0, 100_000], []]], 5, 5, 1.01)
    assert found["qid"] == 0 and {"without_markers", "without_routing", "wider"} <= set(found)


def test_requests(spark, records, tmp_path):
    records.write.parquet(f"file://{tmp_path}/r")
    request = study.audited(spark, {"records": f"file://{tmp_path}/r"}, [{"k": 1}, {"k": 2}])
    assert request["inputs"]["records"]["rows"] == 120 and len({j["id"] for j in request["jobs"]}) == 2
    ran = []
    run = lambda job: ran.append(job["k"]) or {"k": job["k"]}
    for _ in range(2):
        assert study.replayed(spark, request, run, f"file://{tmp_path}/h") == [{"k": 1}, {"k": 2}]
    assert ran == [1, 2]
    records.limit(5).write.mode("append").parquet(f"file://{tmp_path}/r")
    with pytest.raises(ValueError, match="not those"):
        study.replayed(spark, request, run, f"file://{tmp_path}/h")


def test_canary(spark, tmp_path):
    got = study.canary(spark, f"file://{tmp_path}")
    assert got["records"] == got["live"] == 200 and got["edges"] > 200
