import json

import pytest
from pyspark.sql import functions as F

from retentio.operators.labels import (LeakageError, assert_no_leakage, label_users, require_columns,
                                       training_dataset)
from retentio.operators.scoring import align_features
from retentio.schemas import FEATURES
from retentio.sources import raw, sinks


def test_require_columns_lists_every_missing_column(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        require_columns(df, ["a", "b", "c"])


def test_leakage_guard_blocks_training_sink(spark, tmp_path):
    lab = label_users(spark.createDataFrame(
        [("u", 200, 10) + (0.0,) * 8], FEATURES))
    with pytest.raises(LeakageError):
        assert_no_leakage(lab)
    with pytest.raises(LeakageError):
        sinks.save_training(lab, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()
    ok = training_dataset(lab)
    assert_no_leakage(ok)
    assert ok.first().churn == 1


def test_align_fills_missing_drops_extra_and_leaky(spark):
    df = spark.createDataFrame([("u", 3.0, 1.0, 9.0)], "login string, b double, active_repo_ratio double, z double")
    out = align_features(df, ["a", "b", "active_repo_ratio"], keep=("login",))
    assert out.columns == ["login", "a", "b", "active_repo_ratio"]
    assert tuple(out.first()) == ("u", 0.0, 3.0, 0.0)


def test_feature_table_prefers_csv_then_parquet(spark, tmp_path):
    a = spark.createDataFrame([("csv",) + (0, 1) + (0.0,) * 8], FEATURES)
    b = spark.createDataFrame([("pq",) + (0, 1) + (0.0,) * 8], FEATURES)
    csv, pq = str(tmp_path / "f_csv"), str(tmp_path / "f_pq")
    sinks.save_features(a, csv)
    sinks.save_features(b, pq, "parquet")
    assert sinks.read_feature_table(spark, csv, pq).first().login == "csv"
    assert sinks.read_feature_table(spark, str(tmp_path / "none"), pq).first().login == "pq"
    with pytest.raises(FileNotFoundError):
        sinks.read_feature_table(spark, str(tmp_path / "none"), str(tmp_path / "none2"))


def test_raw_reader_takes_a_json_array_file(spark, tmp_path):
    p = tmp_path / "raw.json"
    p.write_text(json.dumps([{"login": "a", "followers": 3, "repositories": [{"stargazers_count": 2}, 7]},
                             {"login": "b", "repositories": "oops"}], indent=2))
    df = raw.read_raw_users(spark, str(p), multi_line=True)
    rows = {r.login: r for r in df.collect()}
    assert rows["a"].followers == "3" and len(rows["a"].repositories) == 2
    assert rows["b"].repositories is None


def test_labeled_parquet_stores_churn_as_float(spark, tmp_path):
    lab = label_users(spark.createDataFrame([("u", 10, 10) + (0.0,) * 8], FEATURES))
    path = sinks.save_labeled(lab, str(tmp_path / "l"), "parquet")
    assert dict(spark.read.parquet(path).dtypes)["churn"] == "float"


def test_streaming_ingest_replay_is_idempotent(spark, tmp_path):
    from retentio.streaming.ingest import ingest_available
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "b0.json").write_text("\n".join(json.dumps(r) for r in [
        {"login": "Ann", "followers": 1, "scraped_at": "2024-01-01T00:00:00+00:00"},
        {"login": "bob", "followers": 1, "scraped_at": "2024-01-01T00:00:00+00:00"}]))
    (landing / "b1.json").write_text("\n".join(json.dumps(r) for r in [
        {"login": "ANN", "followers": 2, "scraped_at": "2024-01-02T00:00:00+00:00"},
        {"login": "bob", "followers": 0, "scraped_at": "2023-12-31T00:00:00+00:00"}]))
    log, ckpt = str(tmp_path / "log"), str(tmp_path / "ckpt")
    first = {r.login.lower(): r.followers for r in ingest_available(spark, str(landing), log, ckpt).collect()}
    again = {r.login.lower(): r.followers for r in ingest_available(spark, str(landing), log, ckpt).collect()}
    assert first == again == {"ann": "2", "bob": "1"}
