import json
import re

from pyspark.sql import functions as F

from retentio.operators.ingest import assemble_users, upsert_users
from retentio.sources.usernames import load_usernames, read_lines, search_logins


def test_upsert_incoming_and_later_rows_win(spark):
    existing = spark.createDataFrame([("Ann", "v1", 0), ("bob", "v1", 1)], "login string, v string, pos int")
    incoming = spark.createDataFrame([("ANN", "v2", 0), ("cy", "v1", 1), ("ann", "v3", 2), (None, "v9", 3)],
                                     "login string, v string, pos int")
    out = upsert_users(existing, incoming).orderBy("first_batch", "first_pos").collect()
    assert [(r.login, r.v) for r in out] == [("ann", "v3"), ("bob", "v1"), ("cy", "v1")]


def test_upsert_is_idempotent(spark):
    existing = spark.createDataFrame([("Ann", "v1", 0), ("bob", "v1", 1)], "login string, v string, pos int")
    incoming = spark.createDataFrame([("ANN", "v2", 0)], "login string, v string, pos int")
    once = upsert_users(existing, incoming).drop("first_batch", "first_pos")
    twice = upsert_users(once, incoming).drop("first_batch", "first_pos")
    assert sorted(once.collect()) == sorted(twice.collect())


def test_usernames_first_spelling_in_file_order(spark, tmp_path):
    p = tmp_path / "names.txt"
    p.write_text("\n".join(["# c", "", " Ann ", "ann", "BOB", "bob"]) + "\n")
    out = load_usernames(read_lines(spark, str(p))).orderBy("_file", "_block", "_row").collect()
    assert [r.username for r in out] == ["Ann", "BOB"]


def _pages(spark, tmp_path, pages):
    p = tmp_path / "pages.json"
    p.write_text("\n".join(json.dumps(x) for x in pages))
    from retentio.sources.raw import read_search_pages
    return read_search_pages(spark, str(p))


def test_search_stops_after_short_page(spark, tmp_path):
    full = [{"login": f"u{i}"} for i in range(100)]
    pages = [{"query": "q", "page": 1, "total_count": 500, "items": full},
             {"query": "q", "page": 2, "total_count": 500, "items": [{"login": "U0"}, {"login": "x"}]},
             {"query": "q", "page": 3, "total_count": 500, "items": [{"login": "late"}]}]
    got = {r.login for r in search_logins(_pages(spark, tmp_path, pages)).collect()}
    assert "late" not in got and "x" in got and "U0" not in got and len(got) == 101


def test_search_stops_before_missing_or_empty_page_and_at_total(spark, tmp_path):
    full = [{"login": f"u{i}"} for i in range(100)]
    more = [{"login": f"v{i}"} for i in range(100)]
    pages = [{"query": "gap", "page": 1, "total_count": 900, "items": full},
             {"query": "gap", "page": 3, "total_count": 900, "items": more},
             {"query": "empty", "page": 1, "total_count": 900, "items": full},
             {"query": "empty", "page": 2, "total_count": 900, "items": []},
             {"query": "empty", "page": 3, "total_count": 900, "items": more},
             {"query": "total", "page": 1, "total_count": 100, "items": full},
             {"query": "total", "page": 2, "total_count": 100, "items": more}]
    out = search_logins(_pages(spark, tmp_path, pages)).groupBy("query").count().collect()
    assert {r.query: r["count"] for r in out} == {"gap": 100, "empty": 100, "total": 100}


def test_assemble_bounds_parts_and_keeps_users_without_repos(spark):
    users = spark.createDataFrame([("a",), ("b",), ("c",)], "login string")
    repos = spark.range(0, 25).select(
        F.when(F.col("id") < 23, F.lit("a")).otherwise(F.lit("b")).alias("login"),
        F.col("id").alias("repo_id"), F.lit("2024-01-01T00:00:00Z").alias("pushed_at"),
        F.lit(1).alias("stargazers_count"), F.lit(0).alias("forks_count"))
    rec = assemble_users(users, repos, None, max_repos=10)
    got = {(r.login, r.part): r.n for r in rec.select("login", "part", F.size("repositories").alias("n")).collect()}
    assert got == {("a", 0): 10, ("a", 1): 10, ("a", 2): 3, ("b", 0): 2, ("c", 0): 0}


def test_assemble_moves_repositories_once_and_splits_heavy_users(spark):
    users = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "login string")
    # ids in mixed order, one twice, some owners unknown or missing
    rows = [("a", (i * 7) % 23) for i in range(23)] + [("a", 5), ("b", 40), ("b", 30), ("z", 1), (None, 2), (None, 3)]
    repos = spark.createDataFrame(rows, "login string, repo_id long").select(
        "login", "repo_id", F.lit("2024-01-01T00:00:00Z").alias("pushed_at"),
        F.lit(1).alias("stargazers_count"), F.lit(0).alias("forks_count"))

    def flat(rec):
        return sorted(((r.login or "", r.part, r.total_repositories, r.ids) for r in rec.select(
            "login", "part", "total_repositories", F.col("repositories.repo_id").alias("ids")).collect()))

    ids = sorted(i for login, i in rows if login == "a")
    expected = [("", 0, 0, [])] + [("a", k, 24, ids[10 * k:10 * k + 10]) for k in range(3)] + [
        ("b", 0, 2, [30, 40]), ("c", 0, 0, [])]
    light = assemble_users(users, repos, None, max_repos=10)
    assert flat(light) == expected
    assert flat(assemble_users(users, repos, None, max_repos=10, max_sorted=5)) == expected
    # rank, arrays and the join share one partitioning by login
    plan = light._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(login#\d+, [^\d]", plan), plan
