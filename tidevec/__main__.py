"""Jobs from the command line: ``python -m tidevec JOB ...``; tables are Parquet folders.

    attributes IN OUT [--high N]           add generated attributes to points (label, vector)
    predicates POINTS OUT --queries N --range S [--labels 4,7]
    truth POINTS QUERIES OUT --k K [--space l2]       exact search, each query by its own terms if it has any
    build POINTS OUT --dim D [--clusters N]           clusters, kept under OUT
    sweep POINTS QUERIES OUT --dim D --k K --nprobe 1,2,4,8     recall and throughput of each setting, appended to OUT
    operation POINTS QUERIES OUT --dim D --k K --op replace --initial N --step S [--target R]    a staged operation, journalled under OUT and published there
    canary OUT                                        a tiny life cycle; fails where something is wrong
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import study
from .functions import generate
from .operators import ann, evaluate
from .operators.knn import knn
from .schema import IndexConfig, SearchConfig
from .sources.io import append_metrics
from .streaming.trace import Trace
from .workers import found_by_workers


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidevec", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = p.add_subparsers(dest="job", required=True)
    names = {"attributes": ("points", "out"), "predicates": ("points", "out"), "truth": ("points", "queries", "out"), "build": ("points", "out"), "sweep": ("points", "queries", "out"), "operation": ("points", "queries", "out"), "canary": ("out",)}
    for job, places in names.items():
        j = jobs.add_parser(job)
        for x in places:
            j.add_argument(x)
        j.add_argument("--high", type=int, default=100_000)
        j.add_argument("--queries-n", "--queries", dest="n", type=int, default=1000)
        j.add_argument("--range", dest="share", type=float, default=0.1)
        j.add_argument("--labels", type=lambda s: [int(x) for x in s.split(",") if x], default=[])
        j.add_argument("--k", type=int, default=10)
        j.add_argument("--space", default="l2")
        j.add_argument("--dim", type=int, default=0)
        j.add_argument("--clusters", type=int, default=None)
        j.add_argument("--op", default="replace")
        j.add_argument("--initial", type=int, default=0)
        j.add_argument("--step", type=int, default=0)
        j.add_argument("--target", type=float, default=0.95)
        j.add_argument("--nprobe", type=lambda s: [int(x) for x in s.split(",")], default=[1, 2, 4, 8, 16])
    a = p.parse_args(args)
    spark = found_by_workers(SparkSession.builder.appName(f"tidevec-{a.job}").getOrCreate())
    if a.job == "canary":
        print(study.canary(spark, a.out))
        return
    points = spark.read.parquet(a.points)
    if a.job == "operation":
        run = Trace(a.op, a.initial, a.step, 2 * a.initial)
        study.run_operation(spark, a.out, IndexConfig(dim=a.dim, space=a.space, max_cate_size=1 << 20), run, points, spark.read.parquet(a.queries), a.k, a.target)
        study.published(spark, a.out, run, f"{a.out}/published").show()
        return
    if a.job == "attributes":
        generate.attributes(points, "label", a.high).withColumn("deleted", F.lit(False)).write.parquet(a.out)
    elif a.job == "predicates":
        generate.dnf(points, a.n, [{"range": a.share, "labels": a.labels}]).write.parquet(a.out)
    elif a.job == "truth":
        queries = spark.read.parquet(a.queries)
        live = points.where(~F.col("deleted")) if "deleted" in points.columns else points
        knn(live, queries, a.k, a.space, terms="terms" if "terms" in queries.columns else None).write.parquet(a.out)
    else:
        cfg = IndexConfig(dim=a.dim, space=a.space, max_cate_size=1 << 20)
        if a.job == "build":
            index = ann.kept(points, cfg, a.out, a.clusters)
            index.clusters.select("cluster_id", "n", "live", "representative").show(20)
            return
        queries = spark.read.parquet(a.queries).cache()
        index = ann.build(points, cfg, a.clusters)
        index.points, index.clusters = index.points.cache(), index.clusters.cache()
        truth, n = knn(points.where(~F.col("deleted")), queries, a.k, a.space).cache(), queries.count()
        for nprobe in a.nprobe:
            began = time.perf_counter()
            got = ann.search(index, queries, a.k, SearchConfig(nprobe=nprobe)).cache()
            got.count()
            took = time.perf_counter() - began
            recall = evaluate.recall(got, truth, a.k).agg(F.avg("recall")).first()[0]
            append_metrics(spark.createDataFrame([(a.space, nprobe, float(recall), n / took)], "grp string, ef int, recall double, qps double"), a.out)


if __name__ == "__main__":
    main()
