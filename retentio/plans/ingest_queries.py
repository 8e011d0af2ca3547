"""Catalog entries for ingest, landed files, sinks and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentio.functions.numbers import size_or_zero
from retentio.operators import ingest as ig
from retentio.operators.features import features_from_records
from retentio.plans import oracle as o
from retentio.plans.catalog import features, labeled, query, training
from retentio.schemas import FEATURES, LABELED, RAW_USER
from retentio.session import collect_garbage, drop_written, scratch_path, write_once
from retentio.sources import raw, sinks, tables, usernames
from retentio.streaming.ingest import CODEC

# Repositories per record part in the nested queries: small enough that many
# users span several parts.
RECORD_BOUND = 8
ISO = "'%Y-%m-%dT%H:%M:%SZ'"
AS_OF_TS = "TIMESTAMP '2001-08-01 00:00:00'"

API = f"""api_users AS (
  SELECT u.login, u.id, u.followers, u.following, u.public_repos, CAST(NULL AS BIGINT) AS public_gists,
         strftime(u.created_at, {ISO}) AS created_at, strftime(u.updated_at, {ISO}) AS updated_at,
         c.c_mktsegment AS company, n.n_name AS location, CAST(NULL AS VARCHAR) AS bio
  FROM u_users u JOIN customer c ON c.c_custkey = u.id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey),
api_repos AS (
  SELECT login, 'repo-' || CAST(repo_id AS VARCHAR) AS repo_name, repo_id,
         strftime(created_at, {ISO}) AS created_at, strftime(updated_at, {ISO}) AS updated_at,
         strftime(pushed_at, {ISO}) AS pushed_at, stargazers_count, forks_count,
         forks_count AS watchers_count, language, stargazers_count AS size,
         CAST(0 AS BIGINT) AS open_issues_count, 'main' AS default_branch
  FROM u_repos),
met AS (
  SELECT login, count(*) AS total_repositories,
         CAST(sum(coalesce(stargazers_count, 0)) AS BIGINT) AS total_stars_received,
         CAST(sum(coalesce(forks_count, 0)) AS BIGINT) AS total_forks_received,
         count(*) FILTER (WHERE floor((epoch({AS_OF_TS}) - epoch(pushed_at)) / 86400) <= 180) AS active_repositories,
         count(*) FILTER (WHERE NOT (floor((epoch({AS_OF_TS}) - epoch(pushed_at)) / 86400) <= 180)) AS inactive_repositories
  FROM u_repos GROUP BY login),
rparts AS (
  SELECT login, CAST((row_number() OVER (PARTITION BY login ORDER BY repo_id) - 1) // {RECORD_BOUND} AS BIGINT) AS part,
         repo_id
  FROM u_repos),
parts AS (SELECT login, part, count(*) AS n_repos, min(repo_id) AS first_repo, max(repo_id) AS last_repo
          FROM rparts GROUP BY ALL),
records AS (
  SELECT a.*, coalesce(p.part, 0) AS part, coalesce(p.n_repos, 0) AS n_repos, p.first_repo, p.last_repo,
         coalesce(m.total_repositories, 0) AS total_repositories,
         coalesce(m.total_stars_received, 0) AS total_stars_received,
         coalesce(m.total_forks_received, 0) AS total_forks_received,
         coalesce(m.active_repositories, 0) AS active_repositories,
         coalesce(m.inactive_repositories, 0) AS inactive_repositories
  FROM api_users a LEFT JOIN parts p USING (login) LEFT JOIN met m USING (login))"""


def landed(spark, sf, bound=RECORD_BOUND):
    return raw.landed_users(spark, sf, tables.ORDERS_AS_OF, max_repos=bound)


def landed_json(spark, sf, bound=RECORD_BOUND):
    """Write the assembled records as JSON lines and read them back."""
    path = raw.write_json_lines(landed(spark, sf, bound), scratch_path(spark, "raw_users"))
    return raw.read_raw_users(spark, path)


@query("project_user", o.with_base("SELECT * FROM api_users", API))
def q_project_user(spark, sf):
    return ig.project_user(raw.api_users(spark, sf))


@query("project_repo", o.with_base("SELECT * EXCLUDE (login) FROM api_repos", API))
def q_project_repo(spark, sf):
    return ig.project_repo(raw.api_repos(spark, sf))


@query("activity_metrics", o.with_base("""
SELECT login, total_repositories, CAST(s AS BIGINT) AS total_stars_received, total_forks_received,
       active_repositories, inactive_repositories
FROM met JOIN (SELECT login, sum(CASE WHEN forks_count = 7 THEN 0 ELSE coalesce(stargazers_count, 0) END) AS s
               FROM u_repos GROUP BY login) USING (login)""", API))
def q_activity_metrics(spark, sf):
    """Star counters as text, some of them words."""
    return ig.activity_metrics(_worded_stars(ig.project_repo(raw.api_repos(spark, sf), keep=("login",))),
                               tables.ORDERS_AS_OF)


def _worded_stars(repos):
    return repos.withColumn("stargazers_count", F.when(F.col("forks_count") == 7, F.lit("seven"))
                            .otherwise(F.col("stargazers_count").cast("string")))


@query("assemble_users", o.with_base(
    "SELECT login, part, n_repos, first_repo, last_repo, total_repositories, active_repositories FROM records", API))
def q_assemble_users(spark, sf):
    r = landed(spark, sf)
    return r.select("login", "part", size_or_zero("repositories").cast("long").alias("n_repos"),
                    F.try_element_at("repositories", F.lit(1))["repo_id"].alias("first_repo"),
                    F.try_element_at("repositories", F.lit(-1))["repo_id"].alias("last_repo"),
                    "total_repositories", "active_repositories")


@query("features_nested", o.with_base("SELECT * FROM features_v"))
def q_features_nested(spark, sf):
    return features_from_records(landed(spark, sf), tables.ORDERS_AS_OF)


_SCAN_COLS = ("login, id, CAST(followers AS VARCHAR) AS followers, CAST(following AS VARCHAR) AS following, "
              "CAST(public_repos AS VARCHAR) AS public_repos, created_at, updated_at, company, location, "
              "total_repositories, total_stars_received, total_forks_received, active_repositories, "
              "inactive_repositories, part, '2001-08-01T00:00:00+00:00' AS scraped_at")


@query("scan_raw_users", o.with_base(f"SELECT {_SCAN_COLS}, n_repos AS n_elements FROM records", API))
def q_scan_raw_users(spark, sf):
    r = landed_json(spark, sf)
    return r.select("login", "id", "followers", "following", "public_repos", "created_at", "updated_at",
                    "company", "location", "total_repositories", "total_stars_received",
                    "total_forks_received", "active_repositories", "inactive_repositories", "part",
                    "scraped_at", size_or_zero("repositories").cast("long").alias("n_elements"))


@query("features_raw_json", o.with_base("SELECT * FROM features_v"))
def q_features_raw_json(spark, sf):
    return features_from_records(landed_json(spark, sf), tables.ORDERS_AS_OF)


@query("flatten_users", o.with_base(
    f"SELECT {_SCAN_COLS}, CAST(NULL AS VARCHAR) AS public_gists, CAST(NULL AS VARCHAR) AS bio FROM flat_users",
    API + """,
flat_users AS (
  SELECT a.*, CAST(0 AS BIGINT) AS part, coalesce(m.total_repositories, 0) AS total_repositories,
         coalesce(m.total_stars_received, 0) AS total_stars_received,
         coalesce(m.total_forks_received, 0) AS total_forks_received,
         coalesce(m.active_repositories, 0) AS active_repositories,
         coalesce(m.inactive_repositories, 0) AS inactive_repositories
  FROM api_users a LEFT JOIN met m USING (login))"""))
def q_flatten_users(spark, sf):
    flat = ig.flatten_users(landed_json(spark, sf))
    path = sinks.write_csv(flat, scratch_path(spark, "flat_users"))
    schema = RAW_USER.__class__([f for f in RAW_USER.fields if f.name != "repositories"])
    back = sinks.read_csv(spark, path, schema)
    return back.select("login", "id", "followers", "following", "public_repos", "created_at", "updated_at",
                       "company", "location", "total_repositories", "total_stars_received",
                       "total_forks_received", "active_repositories", "inactive_repositories", "part",
                       "scraped_at", "public_gists", "bio")


# --- dirty records: validity filters ------------------------------------------

def dirty_records(spark, sf):
    """Records with rule-derived defects: blank / missing logins, follower
    counts written as '1234k', star counts written as words."""
    u = raw.api_users(spark, sf)
    ar = raw.api_repos(spark, sf)
    repos = _worded_stars(ig.project_repo(ar, keep=("login",)))
    rec = ig.assemble_users(ig.project_user(u), repos, tables.ORDERS_AS_OF, max_repos=RECORD_BOUND)
    return rec.select(
        F.when(F.col("following") == 0, F.lit("")).when(F.col("following") == 1, F.lit(None))
        .otherwise(F.col("login")).alias("login"), "id",
        F.when(F.col("followers") % 10 == 7, F.concat(F.col("followers").cast("string"), F.lit("k")))
        .otherwise(F.col("followers").cast("string")).alias("followers"),
        "following", "public_repos", "repositories", "part")


_DIRTY = """dirty AS (
  SELECT CASE WHEN following = 0 THEN '' WHEN following = 1 THEN NULL ELSE login END AS login, id,
         followers % 10 = 7 AS bad_followers, login AS real_login FROM u_users),
bad_repo_users AS (SELECT DISTINCT login FROM u_repos WHERE forks_count = 7)"""


@query("valid_users", o.with_base("SELECT login, id FROM dirty WHERE coalesce(login, '') <> ''", _DIRTY))
def q_valid_users(spark, sf):
    return ig.first_parts(ig.valid_users(dirty_records(spark, sf))).select("login", "id")


@query("reject_bad_numbers", o.with_base(
    "SELECT login, id FROM dirty WHERE NOT bad_followers AND real_login NOT IN (SELECT login FROM bad_repo_users)",
    _DIRTY))
def q_reject_bad_numbers(spark, sf):
    return ig.first_parts(ig.reject_bad_numbers(dirty_records(spark, sf))).select("login", "id")


# --- upsert ------------------------------------------------------------------------

def upsert_batches(spark, sf):
    c = tables.table(spark, sf, "customer").select("c_custkey", "c_name")
    # every customer is in the existing table; the incoming batch re-spells
    # some logins (upper / lower case, blank) and must replace those records
    existing = c.select(
        F.col("c_name").alias("login"), F.lit("v1").alias("version"), F.col("c_custkey").alias("pos"))
    up = c.where(F.col("c_custkey") % 2 == 0).select(
        F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.upper("c_name")).alias("login"),
        F.lit("v2").alias("version"), (F.col("c_custkey") * 2).alias("pos"))
    low = c.where(F.col("c_custkey") % 4 == 0).select(
        F.lower("c_name").alias("login"), F.lit("v3").alias("version"),
        (F.col("c_custkey") * 2 + 1).alias("pos"))
    return existing, up.unionByName(low)


@query("upsert_users", o.with_base("""
SELECT login, version, first_batch, first_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(login) ORDER BY batch DESC, pos DESC) AS rn,
         min(batch * 1000000000 + pos) OVER (PARTITION BY lower(login)) AS first_key
  FROM allrows WHERE coalesce(login, '') <> '')
  CROSS JOIN LATERAL (SELECT CAST(first_key // 1000000000 AS INT) AS first_batch, first_key % 1000000000 AS first_pos)
WHERE rn = 1""", """allrows AS (
  SELECT c_name AS login, 'v1' AS version, c_custkey AS pos, 0 AS batch FROM customer
  UNION ALL SELECT CASE WHEN c_custkey % 7 = 0 THEN '' ELSE upper(c_name) END, 'v2', c_custkey * 2, 1
            FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT lower(c_name), 'v3', c_custkey * 2 + 1, 1 FROM customer WHERE c_custkey % 4 = 0)"""))
def q_upsert_users(spark, sf):
    existing, incoming = upsert_batches(spark, sf)
    return ig.upsert_users(existing, incoming).select("login", "version", "first_batch", "first_pos")


# --- usernames and search pages ------------------------------------------------------

_LINE = """CASE WHEN o_orderkey % 50 = 0 THEN '# page ' || CAST(o_orderkey AS VARCHAR)
     WHEN o_orderkey % 37 = 0 THEN '   '
     WHEN o_orderkey % 4 = 0 THEN '  ' || lower(c_name)
     WHEN o_orderkey % 4 = 1 THEN upper(c_name) || ' '
     ELSE c_name END"""


@query("load_usernames", f"""
WITH lines AS (SELECT o_orderkey, {_LINE} AS line FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT arg_min(trim(line), o_orderkey) AS username FROM lines
WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') GROUP BY lower(trim(line))""")
def q_load_usernames(spark, sf):
    o_ = tables.table(spark, sf, "orders")
    c = tables.table(spark, sf, "customer")
    lines = o_.join(c, c.c_custkey == o_.o_custkey).select(
        "o_orderkey", F.expr(_LINE.replace("AS VARCHAR", "AS STRING")).alias("value"))
    path = scratch_path(spark, "usernames")
    lines.orderBy("o_orderkey").select("value").write.text(path)
    return usernames.load_usernames(usernames.read_lines(spark, path)).select("username")


def search_pages(spark, sf, per_page=100):
    """Landed search pages: query = nation name, items = all the nation's
    orders in key order (login spelled by order key), total_count = matches."""
    from retentio.operators.ordering import ordered_rank
    o_ = tables.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = tables.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = tables.table(spark, sf, "nation").select("n_nationkey", "n_name")
    it = (o_.join(c, c.c_custkey == o_.o_custkey)
          .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
          .select(F.col("n_name").alias("query"), "o_orderkey",
                  F.when(F.col("o_orderkey") % 3 == 0, F.lower("c_name"))
                  .when(F.col("o_orderkey") % 3 == 1, F.upper("c_name"))
                  .otherwise(F.col("c_name")).alias("login")))
    ranked = ordered_rank(it, ["query"], "o_orderkey")
    totals = ranked.groupBy("query").agg(F.count(F.lit(1)).alias("total_count"))
    pages = (ranked.withColumn("page", (F.floor(F.col("_rank") / per_page) + 1).cast("int"))
             .groupBy("query", "page")
             .agg(F.sort_array(F.collect_list(F.struct(F.col("_rank"), F.col("login")))).alias("_it"))
             .join(totals, "query")
             .select("query", "page", "total_count",
                     F.transform("_it", lambda x: F.struct(x["login"].alias("login"))).alias("items")))
    path = scratch_path(spark, "search_pages")
    pages.write.json(path)
    return raw.read_search_pages(spark, path)


@query("search_logins_dedup", """
WITH it AS (
  SELECT n.n_name AS query, o.o_orderkey,
         CASE o.o_orderkey % 3 WHEN 0 THEN lower(c.c_name) WHEN 1 THEN upper(c.c_name) ELSE c.c_name END AS login,
         row_number() OVER (PARTITION BY n.n_name ORDER BY o.o_orderkey) - 1 AS rk,
         count(*) OVER (PARTITION BY n.n_name) AS total
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey),
pg AS (SELECT query, rk // 100 + 1 AS page, rk % 100 AS pos, rk, login, total FROM it),
f AS (SELECT query, lower(login) AS k, min(rk) AS rk FROM pg GROUP BY ALL),
fl AS (SELECT p.query, p.login, p.page, p.pos FROM pg p JOIN f ON f.query = p.query AND f.rk = p.rk),
newp AS (SELECT query, page, count(*) AS new FROM fl GROUP BY ALL),
pages AS (SELECT query, page, count(*) AS nitems, max(total) AS total FROM pg GROUP BY ALL),
cum AS (SELECT p.query, p.page, p.nitems, p.total,
               sum(coalesce(n.new, 0)) OVER (PARTITION BY p.query ORDER BY p.page) AS seen
        FROM pages p LEFT JOIN newp n ON n.query = p.query AND n.page = p.page),
stops AS (SELECT query, min(CASE WHEN nitems = 0 THEN page - 1 WHEN nitems < 100 THEN page
                                 WHEN seen >= total THEN page END) AS stop FROM cum GROUP BY query)
SELECT fl.query, fl.login, CAST(fl.page AS INT) AS page, CAST(fl.pos AS INT) AS pos
FROM fl JOIN stops USING (query) WHERE stop IS NULL OR fl.page <= stop""")
def q_search_logins_dedup(spark, sf):
    return usernames.search_logins(search_pages(spark, sf))


# --- sinks -----------------------------------------------------------------------------

@query("sink_features", o.with_base("SELECT * FROM features_v"))
def q_sink_features(spark, sf):
    path = sinks.save_features(features(spark, sf), scratch_path(spark, "features_csv"))
    return sinks.read_csv(spark, path, FEATURES)


@query("sink_labeled", o.with_base("SELECT * EXCLUDE (churn), CAST(churn AS FLOAT) AS churn FROM labeled_v"))
def q_sink_labeled(spark, sf):
    path = sinks.save_labeled(labeled(spark, sf), scratch_path(spark, "labeled_pq"), "parquet")
    return spark.read.parquet(path)


@query("sink_training", o.with_base("SELECT * EXCLUDE (churn), CAST(churn AS FLOAT) AS churn FROM training_v"))
def q_sink_training(spark, sf):
    path = sinks.save_training(training(spark, sf), scratch_path(spark, "training_pq"), "parquet")
    return spark.read.parquet(path)


@query("scan_features", o.with_base("SELECT * FROM features_v"))
def q_scan_features(spark, sf):
    pq = sinks.save_features(features(spark, sf), scratch_path(spark, "features_pq"), "parquet")
    missing_csv = scratch_path(spark, "absent_csv")
    return sinks.read_feature_table(spark, missing_csv, pq)


@query("coerce_numeric", o.with_base(
    "SELECT login, " + ", ".join(
        (f"CASE WHEN CAST(substr(login, -9) AS INT) % 23 = {i} THEN NULL ELSE CAST({c} AS DOUBLE) END" if i < 4
         else f"CAST({c} AS DOUBLE)") + f" AS {c}" for i, c in enumerate(FEATURES.fieldNames()[1:]))
    + " FROM features_v"))
def q_coerce_numeric(spark, sf):
    from pyspark.sql import types as T
    from retentio.operators.quality import coerce_numeric
    k = F.substring("login", -9, 9).cast("int")
    f = features(spark, sf)
    f = f.select("login", *[(F.when(k % 23 == i, F.lit("n/a")).otherwise(F.col(c).cast("string")) if i < 4 else F.col(c)).alias(c)
                            for i, c in enumerate(FEATURES.fieldNames()[1:])])
    path = sinks.write_csv(f, scratch_path(spark, "features_text"))
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in FEATURES.fields])
    return coerce_numeric(sinks.read_csv(spark, path, as_text))


def _sink_selected_sql():
    var = o.unpivot("training_v", o.TRAIN_COLS, {"v": "var_pop({c})"})
    pairs = o.pairs("training_v", o.TRAIN_COLS).replace("round(", "(").replace(", 6) AS corr", ") AS corr")
    longs = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM training_v"
        for c in o.TRAIN_COLS + ["churn"])
    return o.with_base("""
SELECT feature, value FROM lv
WHERE feature = 'churn' OR feature IN (
  SELECT feature FROM vr LEFT JOIN (
    SELECT feature_b AS feature, max(abs(corr)) AS m FROM pr
    WHERE feature_a IN (SELECT feature FROM vr WHERE v > 0.01) AND feature_b IN (SELECT feature FROM vr WHERE v > 0.01)
    GROUP BY feature_b) USING (feature)
  WHERE v > 0.01 AND NOT coalesce(m > 0.9, false))""", f"vr AS ({var}),\npr AS ({pairs}),\nlv AS ({longs})")


@query("sink_selected", _sink_selected_sql())
def q_sink_selected(spark, sf):
    """Selected columns + target written as CSV and read back, returned as
    (feature, value) pairs so the written columns and values can be checked."""
    from retentio.operators.selection import filter_selection
    t = training(spark, sf)
    data, chosen = filter_selection(t)
    path = sinks.save_selected(data, chosen, "churn", scratch_path(spark, "selected_csv"))
    back = sinks.read_csv(spark, path, data.schema)
    cols = chosen + ["churn"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                for c in cols]))
    return back.select(pairs.alias("p")).select("p.feature", "p.value")


@query("sink_selected_topk", o.with_base("""
SELECT feature, value FROM lv WHERE feature = 'churn' OR feature IN (SELECT feature FROM rk WHERE r <= 6)""",
    "vr AS (" + o.unpivot("training_v", o.TRAIN_COLS, {"v": "round(var_pop({c}), 6)"}) + """),
rk AS (SELECT *, row_number() OVER (ORDER BY v DESC, ordinal) AS r FROM vr),
lv AS (""" + "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM training_v"
                                   for c in o.TRAIN_COLS + ["churn"]) + ")"))
def q_sink_selected_topk(spark, sf):
    """The dataset of a ranking's top 6, as the tree, forest and elimination
    methods write theirs, here with an exact ranking."""
    from retentio.operators.selection import select_top_k
    from retentio.operators.stats import variance
    t = training(spark, sf)
    v = variance(t, o.TRAIN_COLS).select("feature", F.round("variance", 6).alias("importance"), "ordinal")
    chosen = [r["feature"] for r in select_top_k(v, k=6).orderBy("rank").collect()]
    path = sinks.save_selected(t, chosen, "churn", scratch_path(spark, "selected_topk_csv"))
    back = sinks.read_csv(spark, path, t.select(*chosen, "churn").schema)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                for c in [*chosen, "churn"]]))
    return back.select(pairs.alias("p")).select("p.feature", "p.value")


# --- streaming ---------------------------------------------------------------------------

# Files of a landed batch, and how many the stream takes at a time: compressed
# files are read by a task each.
BATCH_FILES = 32
FILES_AT_A_TIME = 8


def stream_batches(spark, sf):
    # every batch is a part of these records: assembled and written once
    records = raw.landed_users(spark, sf, tables.ORDERS_AS_OF)
    base = write_once(records, "landed", CODEC)
    drop_written(records)  # the tables that they were assembled from
    collect_garbage(spark)
    ts = "{d}T00:00:00+00:00"
    b0 = base.withColumn("scraped_at", F.lit(ts.format(d="2001-08-01")))
    b1 = (base.where(F.col("id") % 2 == 0)
          .withColumn("followers", F.col("followers") + 1)
          .withColumn("scraped_at", F.lit(ts.format(d="2001-08-02"))))
    b2 = (base.where(F.col("id") % 3 == 0)
          .withColumn("followers", F.col("followers") + 2)
          .withColumn("scraped_at", F.lit(ts.format(d="2001-08-03"))))
    stale = (base.where(F.col("id") % 5 == 0)
             .withColumn("followers", F.col("followers") + 9)
             .withColumn("scraped_at", F.lit(ts.format(d="2001-07-30"))))
    # two spellings of a login, in one file: the later row wins
    again = base.where(F.col("id") % 7 == 0).withColumn("scraped_at", F.lit(ts.format(d="2001-08-04")))
    twice = (again.withColumn("followers", F.col("followers") + 3).withColumn("_nth", F.lit(0))
             .unionByName(again.withColumn("login", F.upper("login"))
                          .withColumn("followers", F.col("followers") + 4).withColumn("_nth", F.lit(1)))
             .repartition(BATCH_FILES, "id").sortWithinPartitions("id", "_nth", "part").drop("_nth"))
    # all parts of a record in one file
    return [*[b.repartition(BATCH_FILES, "login") for b in (b0, b1, b2, stale)], twice]


def land(batch, path):
    """A batch as compressed JSON lines; nothing of its making stays."""
    batch.write.option("compression", "gzip").json(path)
    collect_garbage(batch.sparkSession)


INCREMENTAL_SQL = o.with_base("""
SELECT l AS login, CAST(f AS VARCHAR) AS followers, scraped_at, n_repos FROM (
  SELECT lower(login) AS k, arg_max(login, scraped_at) AS l, arg_max(followers, scraped_at) AS f,
         max(scraped_at) AS scraped_at FROM (
    SELECT login, followers, '2001-08-01T00:00:00+00:00' AS scraped_at FROM u_users
    UNION ALL SELECT login, followers + 1, '2001-08-02T00:00:00+00:00' FROM u_users WHERE id % 2 = 0
    UNION ALL SELECT login, followers + 2, '2001-08-03T00:00:00+00:00' FROM u_users WHERE id % 3 = 0
    UNION ALL SELECT login, followers + 9, '2001-07-30T00:00:00+00:00' FROM u_users WHERE id % 5 = 0
    UNION ALL SELECT upper(login), followers + 4, '2001-08-04T00:00:00+00:00' FROM u_users WHERE id % 7 = 0)
  GROUP BY lower(login))
LEFT JOIN (SELECT lower(login) AS k, public_repos AS n_repos FROM u_users) USING (k)""")


@query("incremental_ingest", INCREMENTAL_SQL)
def q_incremental_ingest(spark, sf):
    from retentio.streaming.ingest import ingest_available
    landing = scratch_path(spark, "landing")
    for i, b in enumerate(stream_batches(spark, sf)):
        land(b, f"{landing}/batch={i}")
    drop_written(b)  # the records that the batches are parts of
    log = scratch_path(spark, "ingest_log")
    ckpt = scratch_path(spark, "ingest_ckpt")
    cur = ingest_available(spark, landing + "/*", log, ckpt, FILES_AT_A_TIME)
    return (cur.groupBy("login", "followers", "scraped_at")
            .agg(F.sum(size_or_zero("repositories")).alias("n_repos")))


@query("collection_summary", o.with_base("""
SELECT count(*) AS users, CAST(sum(total_repositories) AS BIGINT) AS total_repositories,
       round(avg(total_repositories), 6) AS avg_repositories, round(avg(followers), 6) AS avg_followers,
       CAST(sum(active_repositories) AS BIGINT) AS active_repositories,
       CAST(sum(inactive_repositories) AS BIGINT) AS inactive_repositories
FROM records WHERE part = 0""", API))
def q_collection_summary(spark, sf):
    from retentio.operators.stats import collection_summary
    return collection_summary(ig.first_parts(landed_json(spark, sf)))


@query("preview", o.with_base("SELECT * FROM labeled_v ORDER BY login LIMIT 8"))
def q_preview(spark, sf):
    # a head(8) preview: the limit is the feature
    return labeled(spark, sf).orderBy("login").limit(8)


@query("read_training_csv", o.with_base("SELECT * FROM labeled_v"))
def q_read_training_csv(spark, sf):
    """Labelled table written as CSV, read back with the declared schema and
    the target check."""
    path = sinks.save_labeled(labeled(spark, sf), scratch_path(spark, "labeled_csv"))
    return sinks.read_training_csv(spark, path, "churn", LABELED)


@query("sink_ranking", o.with_base(
    "SELECT feature, importance, ordinal, row_number() OVER (ORDER BY importance DESC, ordinal) AS rank FROM ("
    + o.unpivot("training_v", o.TRAIN_COLS, {"importance": "round(var_pop({c}), 6)"}) + ")"))
def q_sink_ranking(spark, sf):
    """A ranking table written as one CSV file and read back."""
    from pyspark.sql import types as T
    from retentio.operators.selection import rank_importance
    from retentio.operators.stats import variance
    v = variance(training(spark, sf), o.TRAIN_COLS)
    ranked = rank_importance(v.select("feature", F.round("variance", 6).alias("importance"), "ordinal"))
    path = sinks.save_ranking(ranked, scratch_path(spark, "ranking_csv"))
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType()),
                           T.StructField("ordinal", T.IntegerType()), T.StructField("rank", T.LongType())])
    return sinks.read_csv(spark, path, schema)
