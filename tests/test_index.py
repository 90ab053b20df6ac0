"""Life cycle of an index, snapshots, files and streams."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidevec.operators import evaluate, mutate
from tidevec.plans.index import VectorIndex
from tidevec.schema import IndexConfig
from tidevec.sources import io
from tidevec.streaming import trace

CFG = IndexConfig(dim=4, max_cate_size=8)
KIND = "label long, vector array<float>, a0 int, a1 array<int>"


def rows(spark, labels, shift=0.0):
    return spark.createDataFrame([(int(i), [float(i) + shift, 1.0, float(i % 3), 0.0], int(i) * 10, [int(i) % 8]) for i in labels], KIND)


def labels(spark, xs):
    return spark.createDataFrame([(int(x),) for x in xs], "label long")


def query(spark, x):
    return spark.createDataFrame([(0, [float(v) for v in x])], "qid long, vector array<float>")


@pytest.fixture()
def index(spark):
    return VectorIndex(spark, CFG).add_items(rows(spark, range(30)))


def test_insert_query_delete_revive(spark, index):
    q = query(spark, [5.0, 1.0, 2.0, 0.0])
    assert [r["label"] for r in index.knn_query(q, 1).collect()] == [5]
    index.mark_deleted(labels(spark, [5, 6]))
    assert index.get_current_count() == 30 and index.live_count() == 28
    assert index.knn_query(q, 1).first()["label"] != 5
    with pytest.raises(ValueError, match="already deleted"):
        index.mark_deleted(labels(spark, [5]))
    with pytest.raises(ValueError, match="missing"):
        index.mark_deleted(labels(spark, [1, 99]))
    with pytest.raises(ValueError, match="duplicate"):
        index.mark_deleted(labels(spark, [1, 1]))
    assert index.live_count() == 28  # nothing of a refused batch was done
    with pytest.raises(Exception, match="label not found"):
        index.get_items(labels(spark, [5])).collect()
    index.unmark_deleted(labels(spark, [5]))
    assert index.knn_query(q, 1).first()["label"] == 5
    index.add_items(rows(spark, [6], 100.0))  # an insert overwrites and revives
    assert index.live_count() == 30
    assert index.get_items(labels(spark, [6])).first()["vector"][0] == 106.0


def test_undelete_is_refused_after_cleanup(spark, index):
    index.mark_deleted(labels(spark, [3]))
    index.build_clusters(3)
    index.build_graph(4)
    index.cleanup_deleted_marker_bits().count()
    with pytest.raises(ValueError):
        index.unmark_deleted(labels(spark, [3]))


def test_validation(spark):
    for bad in ([(-1, [1.0] * 4, 1, [0])], [(1, [1.0] * 3, 1, [0])], [(1, [float("nan")] * 4, 1, [0])], [(1, [1.0] * 4, None, [0])], [(1, [1.0] * 4, 1, [8])]):
        with pytest.raises(Exception):
            VectorIndex(spark, CFG).add_items(spark.createDataFrame(bad, KIND))
    small = VectorIndex(spark, CFG.with_(max_elements=2))
    with pytest.raises(ValueError, match="exceeds"):
        small.add_items(rows(spark, range(3)))
    with pytest.raises(ValueError):
        IndexConfig(dim=4, ft_bits=9)


def test_updates(spark, index):
    index.update_point(spark.createDataFrame([(2, [9.0, 9.0, 9.0, 9.0])], "label long, vector array<float>"))
    assert index.get_items(labels(spark, [2])).first()["vector"] == [9.0] * 4
    index.update_attr(spark.createDataFrame([(2, 77, [1, 2])], "label long, a0 int, a1 array<int>"))
    q = query(spark, [9.0] * 4)
    assert [r["label"] for r in index.hybrid_knn_query(q, [[77, 77], [1, 2]], 3).collect()] == [2]
    index.mark_deleted(labels(spark, [4]))
    with pytest.raises(ValueError):
        index.update_attr(spark.createDataFrame([(4, 1, [1])], "label long, a0 int, a1 array<int>"))
    assert index.hybrid_knn_query(q, [[0, 10], []], 4, pad=True).where("label = -1").count() == 2
    assert index.hybrid_knn_query_dnf(q, [[[0, 10], []], [[77, 77], []]], k=9).count() == 3


def test_graph_maintenance(spark, index):
    index.build_graph(4)
    index.delete_items(labels(spark, [1, 2, 3]))
    assert index.get_dirty_count() == 0  # mended in place
    bad = index.edges.join(index.points.where("deleted").select(F.col("label").alias("dst")), "dst", "left_semi")
    assert bad.count() == 0 and index.edges.where("src = dst").count() == 0
    assert abs(index.get_deleted_ratio() - 0.1) < 1e-9
    assert index.maintain_deletes() == "none"
    index.mark_deleted(labels(spark, range(10, 25)))
    assert index.get_repair_candidates().count() > 0
    assert index.maintain_deletes() == "rebuild" and index.get_current_count() == 12
    with pytest.raises(ValueError):
        index.resize_index(5)
    assert index.register_attr_values is not None


def test_replacement_takes_the_room_of_deleted(spark, index):
    index.mark_deleted(labels(spark, [1, 2, 3]))
    index.add_items(rows(spark, [100, 101]), replace_deleted=True)
    assert index.get_current_count() == 30 and index.live_count() == 29


def test_snapshot(spark, index, tmp_path):
    path = f"file://{tmp_path}/snap"
    index.build_graph(3)
    index.save_index(path)
    back = VectorIndex.load_index(spark, path, max_elements=1 << 41)
    assert back.cfg == index.cfg.with_(max_elements=1 << 41)
    a = evaluate.digest(index.points, ["label", "vector", "a0", "a1", "deleted"]).first()
    assert a == evaluate.digest(back.points, ["label", "vector", "a0", "a1", "deleted"]).first()
    assert back.index_file_size(path) > 0 and back.edges.count() == index.edges.count()
    with pytest.raises(Exception):
        index.save_index(path)  # written once
    meta = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    meta["format_version"] = 0
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    with pytest.raises(ValueError, match="format"):
        VectorIndex.load_index(spark, path)


def test_vector_files(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 255, (50, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "label long, vector array<float>").repartition(3)
    path = f"{tmp_path}/x.fvecs"
    io.write_local(io.vecs_bytes(df), path)
    raw = np.fromfile(path, np.int32).reshape(50, 7)
    assert (raw[:, 0] == 6).all() and (raw[:, 1:].copy().view(np.float32) == x).all()
    got = io.read_vecs(spark, f"file://{path}", byte_range=True).orderBy("label").collect()
    assert [r["vector"] for r in got] == x.tolist()
    assert io.read_vecs(spark, f"file://{path}", count=7).count() == 7
    x[3, 2] = np.nan
    raw[:, 1:] = x.view(np.int32)
    raw.tofile(path)
    with pytest.raises(Exception, match="not finite"):
        io.read_vecs(spark, f"file://{path}").collect()


def test_json_and_truth(spark, tmp_path):
    attrs = [[[i], sorted({i % 3, 5})] for i in range(9)]
    (tmp_path / "a.json").write_text(json.dumps(attrs))
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, attrs)))
    for lines in (False, True):
        got = io.read_nested_json(spark, f"file://{tmp_path}/a.json" + "l" * lines, lines=lines, count=5).orderBy("label").collect()
        assert [r["attrs"] for r in got] == attrs[:5]
    (tmp_path / "t.json").write_text(json.dumps([[1, 2, 3], [4, 5, 6]]))
    t = io.read_truth(spark, f"file://{tmp_path}/t.json", 2)
    assert sorted(map(tuple, t.collect())) == [(0, 1, 1), (0, 2, 2), (1, 1, 4), (1, 2, 5)]
    with pytest.raises(Exception, match="fewer than"):
        io.read_truth(spark, f"file://{tmp_path}/t.json", 4).collect()
    header, recs = io.truth_bytes(t, 3)
    io.write_local(recs, f"{tmp_path}/t.bin", header)
    assert np.fromfile(f"{tmp_path}/t.bin", np.int32).tolist() == [2, 3, 1, 2, -1, 4, 5, -1]
    vec = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "label long, vector array<float>")
    nested = io.read_nested_json(spark, f"file://{tmp_path}/a.json")
    assert io.load_bundle(vec, nested, IndexConfig(dim=2, max_cate_size=6)).where("a0 = label").count() == 9
    with pytest.raises(Exception, match="differ in length"):
        io.load_bundle(vec.where("label < 4"), nested, IndexConfig(dim=2)).collect()
    assert [r["value"] for r in io.csv_lines(nested.orderBy("label")).collect()] == [str(i) for i in range(9)]


def test_parsed_log(spark):
    lines = spark.createDataFrame([("a 1 [10, 0.9, 100.5, 33]",), ("noise",)], "value string")
    assert [tuple(r) for r in evaluate.parsed_log(lines).collect()] == [("a", "1", 10, 0.9, 100.5, 33.0)]


@pytest.mark.parametrize("op", ["insert", "delete", "replace"])
def test_traces(spark, op):
    t = trace.Trace(op, 40, 10, 80)
    e = t.events(spark).cache()
    last = {r["stage"]: r["live"] for r in trace.stage_counts(e).collect()}
    assert last[t.stages] == {"insert": 80, "delete": 40, "replace": 40}[op]
    assert trace.live_at(e, t.stages).count() == last[t.stages]
    if op == "replace":
        assert e.where("stage > 0").groupBy("op").count().where("count != 40").count() == 0
    with pytest.raises(ValueError):
        trace.Trace(op, 40, 7, 80)


def test_replay_and_resume(spark, tmp_path):
    random.seed(3)
    events = [(i, random.choice(["insert", "delete", "update"]), random.randrange(12), float(i)) for i in range(90)]
    src = f"{tmp_path}/events"
    for k in range(3):
        part = spark.createDataFrame(events[30 * k : 30 * k + 30], "seq long, op string, label long, value double")
        part.coalesce(1).write.mode("append").parquet(src)
        table = trace.VersionedTable(spark, f"file://{tmp_path}/table")
        stream = spark.readStream.schema(part.schema).parquet(src)
        empty = spark.createDataFrame([], "label long, value double, deleted boolean")
        trace.replay(stream, table, empty, f"file://{tmp_path}/cp").awaitTermination()
    want = {}
    for _, op, label, value in events:
        if op == "delete":
            if label in want:
                want[label] = (want[label][0], True)
        else:
            want[label] = (value, False)
    # Within a batch only a label's last event counts, so compare liveness and live values.
    got = {r["label"]: (r["value"], r["deleted"]) for r in table.read().collect()}
    assert {k for k, v in got.items() if not v[1]} == {k for k, v in want.items() if not v[1]}
    assert all(got[k][0] == v[0] for k, v in want.items() if not v[1])
    before = table.version()
    table.commit(empty, before)  # a committed version is left alone
    assert table.read().count() == len(got)
    trace.replay(stream, table, empty, f"file://{tmp_path}/cp").awaitTermination()
    assert table.version() == before


def test_windows_with_watermark(spark, tmp_path):
    e = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:10:00', 'b'")
    assert sorted((r["event_type"], r["n"]) for r in trace.windowed_counts(e).collect()) == [("a", 2), ("b", 1)]


def test_latest_and_repair_limits(spark):
    e = spark.createDataFrame([(1, 1, "x"), (1, 3, "y"), (2, 2, "z")], "label long, version int, v string")
    assert sorted(map(tuple, mutate.latest(e).collect())) == [(1, 3, "y"), (2, 2, "z")]


def test_repair_searches_anew(spark):
    # 0 to 5 on a line; 0 knows only the dead 1 and 2, which know only each other; 5 has no edge
    p = spark.createDataFrame([(i, [float(i)], i in (1, 2)) for i in range(6)], "label long, vector array<float>, deleted boolean")
    e = spark.createDataFrame([(s, d, 0, float((s - d) ** 2)) for s, d in ((0, 1), (0, 2), (1, 2), (2, 1), (3, 4), (4, 3))], "src long, dst long, slot int, dist double")
    assert mutate.patched(e, p, 4).where("src = 0").count() == 0
    nodes = mutate.repair_nodes(e, p)
    assert sorted(r[0] for r in nodes.collect()) == [0, 5]
    got = {(r["src"], r["dst"]) for r in mutate.repaired(e, p, nodes, 4).where("src not in (1, 2)").collect()}
    assert got == {(0, 3), (3, 0), (3, 4), (4, 3), (4, 5), (5, 4)}
    tight = mutate.repaired(e, p, nodes, 1).where("src not in (1, 2)")
    assert sorted((r["src"], r["dst"], r["slot"]) for r in tight.collect()) == [(0, 3, 0), (3, 4, 0), (4, 3, 0), (5, 4, 0)]
