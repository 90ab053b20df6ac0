import numpy as np

from tidevec.__main__ import main


def test_jobs(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(120, 4))
    raw, pts, qs = (f"file://{tmp_path}/{n}" for n in ("raw", "points", "queries"))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "label long, vector array<float>").write.parquet(raw)
    main(["attributes", raw, pts, "--high", "50"])
    main(["predicates", pts, f"{qs}-p", "--queries", "6", "--range", "0.5", "--labels", "0"])
    q = spark.read.parquet(f"{qs}-p").join(spark.read.parquet(raw).withColumnRenamed("label", "qid"), "qid")
    q.write.parquet(qs)
    main(["truth", pts, qs, f"file://{tmp_path}/truth", "--k", "3"])
    got = spark.read.parquet(f"file://{tmp_path}/truth")
    assert got.groupBy("qid").count().where("count = 3").count() == 6
    main(["build", pts, f"file://{tmp_path}/clusters", "--dim", "4", "--clusters", "5"])
    main(["sweep", pts, qs, f"file://{tmp_path}/metrics", "--dim", "4", "--clusters", "5", "--nprobe", "1,5"])
    rows = {r["ef"]: r["recall"] for r in spark.read.parquet(f"file://{tmp_path}/metrics").collect()}
    assert rows[5] == 1.0 and rows[1] <= 1.0
