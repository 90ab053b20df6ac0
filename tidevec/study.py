"""Studies of an index: staged operations with a journal, calibration, timings, publication.

An operation runs stage by stage.  Each stage loads the snapshot that the one
before it committed, applies its mutations, makes the truth, calibrates the
search, checks that its own snapshot reads back the same, and is committed last;
a run that is started again goes on after the last committed stage.
"""

from __future__ import annotations

import hashlib
import json
import statistics
import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import generate
from .functions import markers as M
from .functions.predicates import disjunction
from .operators import evaluate, graph
from .operators.knn import knn
from .plans.index import VectorIndex
from .schema import IndexConfig, SearchConfig
from .streaming.trace import Trace, live_at


class Journal:
    """Begun and committed stages as small JSON files under a folder that all machines see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _write(self, name: str, value: dict) -> None:
        """Whole or not at all: the file gets its name by renaming."""
        fs, p = self._at(name)
        _, part = self._at(f".{name}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        if not fs.rename(part, p):
            fs.delete(part, False)
            raise FileExistsError(name)

    def _read(self, name: str) -> dict | None:
        fs, p = self._at(name)
        return json.loads(self.spark.read.text(p.toString(), wholetext=True).first()["value"]) if fs.exists(p) else None

    def begin(self, stage: int, request: dict) -> bool:
        """Whether the stage is still to do; a stage that was begun for another request is refused."""
        mark = fingerprint(request)
        before = self._read(f"begin-{stage}.json")
        if before is None:
            self._write(f"begin-{stage}.json", {"stage": stage, "request": mark})
        elif before["request"] != mark:
            raise ValueError(f"stage {stage} was begun for another request")
        return self.result(stage) is None

    def commit(self, stage: int, result: dict) -> None:
        if self.result(stage) is not None:
            raise ValueError(f"stage {stage} is committed already")
        self._write(f"commit-{stage}.json", {"stage": stage, "result": result})

    def result(self, stage: int) -> dict | None:
        found = self._read(f"commit-{stage}.json")
        return None if found is None else found["result"]

    def last(self) -> int:
        """The last stage of the unbroken chain of committed ones from 0, -1 without any."""
        stage = 0
        while self.result(stage) is not None:
            stage += 1
        return stage - 1


def fingerprint(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


# -- calibration and timing


def calibrate(measure: Callable[[int], float], target: float, low: int = 1, high: int = 4096) -> tuple[int | None, dict[int, float]]:
    """(the first ef whose recall reaches ``target``, all that was measured).

    A grid of doublings finds the step in which the target is crossed, bisection the place in it; None if ``high`` isn't enough.
    """
    seen: dict[int, float] = {}

    def at(ef: int) -> bool:
        if ef not in seen:
            seen[ef] = measure(ef)
        return seen[ef] >= target

    under, ef = low - 1, low
    while not at(ef):
        if ef >= high:
            return None, seen
        under, ef = ef, min(high, 2 * ef)
    while ef - under > 1:
        middle = (ef + under) // 2
        under, ef = (under, middle) if at(middle) else (middle, ef)
    return ef, seen


def paired_rounds(cases: dict[str, Callable[[], object]], rounds: int = 7, most: int = 21, clean: Callable[[dict], bool] = lambda times: True) -> list[dict]:
    """Rows {round, variant, seconds} of the first ``rounds`` clean rounds; each round runs every case, in an order that rotates."""
    names, out, done = list(cases), [], 0
    for i in range(most):
        if done == rounds:
            break
        times = {}
        for name in names[i % len(names) :] + names[: i % len(names)]:
            began = time.perf_counter()
            cases[name]()
            times[name] = time.perf_counter() - began
        if clean(times):
            out += [{"round": done, "variant": name, "seconds": times[name]} for name in names]
            done += 1
    if done < rounds:
        raise RuntimeError(f"only {done} of {rounds} rounds were clean")
    return out


def recall_of(found: DataFrame, truth: DataFrame, k: int) -> float:
    return float(evaluate.recall(found, truth, k).agg(F.avg("recall")).first()[0] or 0.0)


def sweep(search: Callable[[int], DataFrame], truth: DataFrame, n_queries: int, k: int, efs: Iterable[int], repeats: int = 3, stop_at: float = 1.0) -> list[dict]:
    """Rows {ef, recall, qps, seconds}: each ef after a warm-up, ``repeats`` times, which must give the same rows; the median counts.

    It stops early, after the first ef whose recall reaches ``stop_at``.
    """
    out = []
    for ef in efs:
        first = graph.cut(search(ef))
        mark = evaluate.digest(first, ["qid", "rk", "label"]).first()
        times = []
        for _ in range(repeats):
            began = time.perf_counter()
            again = graph.cut(search(ef))
            times.append(time.perf_counter() - began)
            if evaluate.digest(again, ["qid", "rk", "label"]).first() != mark:
                raise RuntimeError(f"repeats of ef={ef} differ")
        took = statistics.median(times)
        out.append({"ef": ef, "recall": recall_of(first, truth, k), "qps": n_queries / took, "seconds": took})
        if out[-1]["recall"] >= stop_at:
            break
    return out


# -- operations


def mutations(trace: Trace, spark: SparkSession, stage: int) -> tuple[DataFrame, DataFrame]:
    """(labels to delete, (label, logical) to insert) of a stage."""
    e = trace.events(spark).where(F.col("stage") == stage)
    return e.where("op = 'delete'").select("label"), e.where("op = 'insert'").select("label", "logical")


def run_operation(
    spark: SparkSession, home: str, cfg: IndexConfig, trace: Trace, records: DataFrame, queries: DataFrame,
    k: int = 10, target: float = 0.95, terms: Sequence | None = None, through: int | None = None, high: int = 512,
) -> list[dict]:
    """The committed results of all stages up to ``through``; ``records`` are (label, vector, a0, ...) of the logical records.

    A stage's result has its counts, calibrated ef, recall and seconds by step (null where a step had nothing to do).
    """
    journal = Journal(spark, f"{home}/journal")
    request = {"cfg": cfg.manifest(), "trace": [trace.op, trace.initial, trace.step, trace.capacity, trace.seed], "k": k, "target": target, "terms": terms}
    last = trace.stages if through is None else min(through, trace.stages)
    for stage in range(last + 1):
        if not journal.begin(stage, request):
            continue
        index = VectorIndex(spark, cfg) if stage == 0 else VectorIndex.load_index(spark, f"{home}/snapshot-{stage - 1}")
        gone, new = mutations(trace, spark, stage)
        seconds: dict[str, float | None] = {"delete": None, "add": None}
        if not gone.isEmpty():
            began = time.perf_counter()
            index.delete_items(gone)
            seconds["delete"] = time.perf_counter() - began
        rows = new.join(records.withColumnRenamed("label", "logical"), "logical").drop("logical")
        if not new.isEmpty():
            began = time.perf_counter()
            index.add_items(rows)
            seconds["add"] = time.perf_counter() - began
        if index.layers is None:
            index.build_graph()
        expected = live_at(trace.events(spark), stage)
        if expected.join(index.live().select("label"), "label", "full_outer").count() != index.live_count():
            raise RuntimeError(f"stage {stage}: the live records aren't those of the trace")
        ef, measured = calibrated(index, queries, k, target, terms, high)
        index.save_index(f"{home}/snapshot-{stage}", "overwrite")
        verify_reload(index, f"{home}/snapshot-{stage}")
        journal.commit(stage, {"stage": stage, "live": index.live_count(), "occupied": index.get_current_count(), "ef": ef, "recall": measured.get(ef) if ef else max(measured.values()), "seconds": seconds})
    return [journal.result(s) for s in range(journal.last() + 1)]


def calibrated(index: VectorIndex, queries: DataFrame, k: int, target: float, terms: Sequence | None = None, high: int = 512) -> tuple[int | None, dict[int, float]]:
    """The first ef of the graph search that reaches ``target`` against the exact result."""
    predicate = None if terms is None else disjunction(terms, None, index.cfg.attr_types, index.cfg.max_cate_size)
    truth = graph.cut(knn(index.live(), queries, k, index.cfg.space, predicate))
    return calibrate(lambda ef: recall_of(index.graph_query(queries, k, terms, ef=ef), truth, k), target, k, high)


def verify_reload(index: VectorIndex, path: str) -> None:
    """Fails unless the snapshot under ``path`` holds the same records and edges as ``index``."""
    back = VectorIndex.load_index(index.spark, path)
    cols = [c for c in index.points.columns if c in back.points.columns]
    if evaluate.digest(index.points, cols).first() != evaluate.digest(back.points, cols).first():
        raise RuntimeError("the snapshot's records differ")
    if (index.layers is None) != (back.layers is None):
        raise RuntimeError("the snapshot's graph differs")
    if index.layers is not None and evaluate.digest(index.edges, ["src", "dst", "slot"]).first() != evaluate.digest(back.edges, ["src", "dst", "slot"]).first():
        raise RuntimeError("the snapshot's edges differ")


def remeasured(spark: SparkSession, home: str, queries: DataFrame, k: int, target: float, terms: Sequence | None = None, high: int = 512) -> list[dict]:
    """New calibrations of the committed snapshots for another target; nothing is mutated or timed."""
    out = []
    for stage in range(Journal(spark, f"{home}/journal").last() + 1):
        ef, seen = calibrated(VectorIndex.load_index(spark, f"{home}/snapshot-{stage}"), queries, k, target, terms, high)
        out.append({"stage": stage, "ef": ef, "recall": seen.get(ef) if ef else max(seen.values())})
    return out


def published(spark: SparkSession, home: str, trace: Trace, out: str) -> DataFrame:
    """The results of a complete operation as one table, written once as JSON and TSV; an incomplete chain is refused."""
    journal = Journal(spark, f"{home}/journal")
    if journal.last() < trace.stages:
        raise ValueError(f"stages up to {journal.last()} of {trace.stages} are committed")
    rows = [journal.result(s) for s in range(trace.stages + 1)]
    flat = [(r["stage"], r["live"], r["occupied"], r["ef"], r["recall"], r["seconds"]["delete"], r["seconds"]["add"]) for r in rows]
    table = spark.createDataFrame(flat, "stage int, live long, occupied long, ef int, recall double, delete_s double, add_s double")
    table.coalesce(1).write.mode("errorifexists").json(f"{out}/json")
    table.coalesce(1).write.mode("errorifexists").option("sep", "\t").option("header", True).csv(f"{out}/tsv")
    return table


# -- batches over selectivities


def selectivity_batch(index: VectorIndex, queries: DataFrame, cells: dict[str, Sequence], efs: Sequence[int], k: int = 10, repeats: int = 1) -> DataFrame:
    """(cell, ef, recall, qps, seconds) of one loaded index; ``cells`` has the terms of each selectivity."""
    n, out = queries.count(), []
    for cell, terms in cells.items():
        predicate = disjunction(terms, None, index.cfg.attr_types, index.cfg.max_cate_size)
        truth = graph.cut(knn(index.live(), queries, k, index.cfg.space, predicate))
        out += [(cell, r["ef"], r["recall"], r["qps"], r["seconds"]) for r in sweep(lambda ef, terms=terms: index.graph_query(queries, k, terms, ef=ef), truth, n, k, efs, repeats)]
    return index.spark.createDataFrame(out, "cell string, ef int, recall double, qps double, seconds double")


def marker_fpr(index: VectorIndex, queries: DataFrame, cells: dict[str, Sequence], efs: Sequence[int], k: int = 10) -> DataFrame:
    """(cell, ef, recall, and the rates of ``markers.rates``): what edge Markers let through, against what lies behind the edges."""
    marked = index.marker_edges()
    out = None
    for cell, terms in cells.items():
        predicate = disjunction(terms, None, index.cfg.attr_types, index.cfg.max_cate_size)
        hit = index.live().where(predicate).select(F.col("label").alias("dst"), F.lit(True).alias("hit"))
        tested = marked.join(hit, "dst", "left").select(M.gate(terms, index.codebook(), index.cfg.ft_bits).alias("pass"), F.coalesce("hit", F.lit(False)).alias("hit"))
        rates = tested.agg(*M.rates(F.col("pass"), F.col("hit")))
        truth = graph.cut(knn(index.live(), queries, k, index.cfg.space, predicate))
        for ef in efs:
            recall = recall_of(index.graph_query(queries, k, terms, ef=ef), truth, k)
            row = rates.select(F.lit(cell).alias("cell"), F.lit(ef).alias("ef"), F.lit(recall).alias("recall"), "*")
            out = row if out is None else out.unionByName(row)
    return out


# -- requests


def audited(spark: SparkSession, inputs: dict[str, str], jobs: Sequence[dict]) -> dict:
    """A request: rows and fingerprints of the input tables, and the jobs, each with an identity of its own."""
    tables = {}
    for name, path in sorted(inputs.items()):
        df = spark.read.parquet(path)
        r = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
        tables[name] = {"path": path, "rows": r[0], "columns": df.columns, "mark": f"{r[1]}:{r[2]}"}
    jobs = [j | {"id": fingerprint([tables, j])[:16]} for j in jobs]
    return {"inputs": tables, "jobs": jobs, "id": fingerprint([tables, jobs])}


def replayed(spark: SparkSession, request: dict, run: Callable[[dict], dict], home: str) -> list[dict]:
    """Results of a frozen request's jobs, one after the other; committed ones aren't run again, changed inputs are refused."""
    now = audited(spark, {n: t["path"] for n, t in request["inputs"].items()}, [{k: v for k, v in j.items() if k != "id"} for j in request["jobs"]])
    if now["id"] != request["id"]:
        raise ValueError("the inputs or jobs are not those of the request")
    journal = Journal(spark, f"{home}/{request['id'][:16]}")
    for i, job in enumerate(request["jobs"]):
        if journal.begin(i, job):
            journal.commit(i, run(job))
    return [journal.result(i) for i in range(len(request["jobs"]))]


def first_failure(index: VectorIndex, queries: DataFrame, terms: Sequence, k: int, ef: int, target: float = 1.0) -> dict | None:
    """The first query whose recall is under ``target``, with its recall when one part of the search at a time is switched off; None without any."""
    predicate = disjunction(terms, None, index.cfg.attr_types, index.cfg.max_cate_size)
    truth = graph.cut(knn(index.live(), queries, k, index.cfg.space, predicate))
    bad = evaluate.recall(index.graph_query(queries, k, terms, ef=ef), truth, k).where(F.col("recall") < target).orderBy("qid").first()
    if bad is None:
        return None
    one, want = queries.where(F.col("qid") == bad["qid"]), truth.where(F.col("qid") == bad["qid"])
    out, before = {"qid": bad["qid"], "recall": bad["recall"]}, index.search_config
    try:
        for name, knobs in {"without_markers": SearchConfig(use_markers=False), "without_routing": SearchConfig(routing=False)}.items():
            index.search_config = knobs
            out[name] = recall_of(index.graph_query(one, k, terms, ef=ef), want, k)
    finally:
        index.search_config = before
    out["wider"] = recall_of(index.graph_query(one, k, terms, ef=4 * ef), want, k)
    return out


def canary(spark: SparkSession, home: str, n: int = 200) -> dict:
    """A tiny life cycle: build, delete, undo, update, save, load, search; fails on the first step that goes wrong."""
    cfg = IndexConfig(dim=4, max_cate_size=20, M=4, ef_construction=16)
    base = spark.range(n).select(F.col("id").alias("label"), F.array(*[((F.col("id") * p) % 97).cast("float") for p in (3, 7, 11, 13)]).alias("vector"))
    index = VectorIndex(spark, cfg).add_items(generate.attributes(base, "label"))
    index.build_graph()
    q = base.limit(5).select(F.col("label").alias("qid"), "vector")
    if index.graph_query(q, 1, ef=16).where("dist > 0").count():
        raise RuntimeError("records aren't their own nearest")
    two = base.where("label < 2").select("label")
    index.mark_deleted(two)
    if index.graph_query(q, 1, ef=16).join(two, "label").count():
        raise RuntimeError("a deleted record was found")
    index.unmark_deleted(two)
    index.update_point(base.where("label = 3").select("label", F.array(*[F.lit(500.0).cast("float")] * 4).alias("vector")))
    index.save_index(f"{home}/canary", "overwrite")
    verify_reload(index, f"{home}/canary")
    return {"records": index.get_current_count(), "live": index.live_count(), "edges": index.edges.count()}
