import glob
import tempfile

from pyspark.sql import functions as F

from tessera.operators import encode, results
from tessera.plans.report import build_report
from tessera.plans.train import train
from tessera.sinks import writers
from tessera.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_train_report_and_writers(spark):
    cf = T.customer_features(spark, SF)
    res = train(cf, "c_custkey", "DBSCAN", {"eps": 0.6, "min_samples": 5})
    m = res.metrics.collect()[0]
    assert (m["clusters"], m["noise"]) == (4, 63)
    labelled = results.label_join(cf, res.labels, ["c_custkey"])
    rep = build_report(spark, labelled, ["c_custkey"], res.metrics, "DBSCAN", "Mean", "RobustScaler", "None")
    text = [r["text"] for r in rep.orderBy("section", "ordinal").collect()]
    assert {r["section"] for r in rep.collect()} == set(range(9))
    assert "| scaling | RobustScaler |" in text  # the scaler actually given is printed
    assert any(t.endswith("(label -1)") for t in text) and any("4 clusters, 63 noise points" in t for t in text)
    out = tempfile.mkdtemp(prefix="tessera-out-", dir="/tmp")
    writers.write_report(rep, f"{out}/report")
    writers.write_summary(results.cluster_describe(labelled, ["c_custkey"]), f"{out}/summary")
    writers.write_metrics(res.metrics, f"{out}/metrics")
    lines = open(glob.glob(f"{out}/report/part-*")[0]).read().splitlines()
    assert lines == text
    assert spark.read.option("header", True).csv(f"{out}/metrics").count() == 1
    assert spark.read.option("header", True).csv(f"{out}/summary").count() == 5 * 3


def test_dbscan_model_scores_its_own_rows(spark):
    cf = T.customer_features(spark, SF)
    enc = encode.preprocess(cf, ["c_custkey"])
    from tessera.operators.dbscan import core_points, dbscan
    lab = {r["c_custkey"]: r["cluster"] for r in dbscan(enc.frame, "c_custkey", 0.6, 5).collect()}
    core = core_points(enc.frame, "c_custkey", 0.6, 5)
    path = tempfile.mkdtemp(prefix="tessera-model-", dir="/tmp") + "/m"
    writers.save_model(spark, path, "DBSCAN", {"eps": 0.6, "min_samples": 5}, enc, core_x=core)
    scored = {r["c_custkey"]: r["cluster"] for r in writers.score(writers.load_model(spark, path), cf, "c_custkey").collect()}
    core_keys = {r["c_custkey"] for r in core.collect()}
    # core rows keep their cluster, noise stays noise, borders join a cluster
    assert all(scored[k] == lab[k] for k in core_keys)
    assert all((scored[k] == -1) == (lab[k] == -1) for k in lab)


def test_stream_drift_counts_every_event(spark):
    from tessera.streaming.assign import events_drift
    out = events_drift(spark, SF)
    assert out.agg(F.sum("n")).collect()[0][0] == spark.read.parquet(f"{SF}/events.parquet").count()
    assert set(out.columns) == {"window_start", "window_end", "cluster", "n"}


def test_stream_drift_of_part_files_in_any_order(spark):
    """Part files in reverse order of time, far more than the old hour apart,
    beside a table of a similar name: every event is counted once."""
    import os
    from tessera.streaming.assign import events_drift
    home = tempfile.mkdtemp(prefix="tessera-events-", dir="/tmp")
    events = spark.read.parquet(f"{SF}/events.parquet")
    spark.createDataFrame(events.orderBy(F.desc("ts")).limit(300).collect(), events.schema).repartitionByRange(3, F.desc("ts")).write.parquet(f"{home}/events.parquet")
    events.limit(5).coalesce(1).write.parquet(f"{home}/other")
    os.rename(glob.glob(f"{home}/other/part-*")[0], f"{home}/events_old.parquet")
    parts = sorted(glob.glob(f"{home}/events.parquet/part-*"))
    for k, part in enumerate(parts):  # the stream takes the oldest file first
        os.utime(part, (1_700_000_000 + 60 * k,) * 2)
    got = {(r["window_start"], r["cluster"]): r["n"] for r in events_drift(spark, home).collect()}
    assert len(parts) == 3 and sum(got.values()) == 300
    days = {r["d"]: r["n"] for r in spark.read.parquet(f"{home}/events.parquet").groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert len(days) > 1 and days == {d: sum(n for (w, _), n in got.items() if w == d) for d in days}
