"""How often the ingest moves its wide records."""

import re

import __spark_entry__  # noqa: F401 - loads the plans in order
from retentio.plans import ingest_queries as iq
from retentio.plans.ingest_queries import stream_batches
from retentio.streaming import ingest as si


def test_records_move_once_to_their_places(spark, tmp_path):
    rows = [("Ann", 0, "2001-01-02", 0, "f", 0, 0, ["r1"]), ("ann", 0, "2001-01-03", 1, "g", 0, 0, ["r2"]),
            ("ann", 1, "2001-01-03", 1, "g", 0, 1, ["r3"]), ("ann", 1, "2001-01-03", 1, "g", 0, 2, ["r4"]),
            ("ann", 1, "2001-01-02", 0, "f", 0, 1, ["r5"]), ("bob", 0, None, 0, "f", 0, 2, None)]
    log = spark.createDataFrame(rows, "login string, part long, scraped_at string, batch_id int, _file string, "
                                      "_block long, _row long, repositories array<string>")
    log.write.parquet(str(tmp_path / "log"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cur = si.current_users(spark, str(tmp_path / "log"))
        plan = cur._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
        assert len(moved) >= 2 and sum("repositories" in m for m in moved) == 1
        got = sorted((r.login, r.part, r.repositories) for r in cur.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == [("ann", 0, ["r2"]), ("ann", 1, ["r4"]), ("bob", 0, None)]


def test_batches_share_one_assembly(spark):
    batches = stream_batches(spark, "/root/testdata/sf0.001")
    files = {f for b in batches for f in b.inputFiles()}
    assert files and all("/retentio-scratch/" in f for f in files)


def test_landed_batches_log_and_table_are_compressed(spark, tmp_path):
    base = stream_batches(spark, "/root/testdata/sf0.001")[0]
    assert {f.split("/")[-2].rsplit("-", 1)[0] for f in base.inputFiles()} == {"landed"}
    iq.land(base, str(tmp_path / "landing/batch=0"))
    si.run_bucketed_ingest(spark, str(tmp_path / "landing/*"), str(tmp_path / "log"), str(tmp_path / "ckpt"),
                           str(tmp_path / "users"), n_buckets=2)
    files = [f.name for f in (tmp_path / "landing").rglob("part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)
    for name in ("log", "users"):
        files = [f.name for f in (tmp_path / name).rglob("*.parquet")]
        assert files and all(".zstd." in f for f in files)
    assert si.bucketed_users(spark, str(tmp_path / "users")).count() == base.count()


def test_batches_leave_only_their_records(spark):
    """The tables that the records were assembled from go when the records are written."""
    base = stream_batches(spark, "/root/testdata/sf0.001")[0]
    scratch = base.inputFiles()[0].split("/retentio-scratch/")[0] + "/retentio-scratch"
    fs = spark._jvm.org.apache.hadoop.fs.Path(scratch).getFileSystem(spark._jsc.hadoopConfiguration())
    app = fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{scratch}/{spark.sparkContext.applicationId}"))
    before = {s.getPath().getName() for s in app}
    stream_batches(spark, "/root/testdata/sf0.001")
    app = fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{scratch}/{spark.sparkContext.applicationId}"))
    new = {s.getPath().getName() for s in app} - before
    assert {n.rsplit("-", 1)[0] for n in new} == {"landed"}
