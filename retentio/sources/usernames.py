"""Username lists and landed search pages → ordered, de-duplicated logins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.session import prepare_session


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their position: (value, _file, _block, _row). Inside a
    split rows keep file order and ``monotonically_increasing_id`` grows with
    it, so (file, block start, id) orders lines as written."""
    prepare_session(spark)
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"))


def load_usernames(lines: DataFrame) -> DataFrame:
    """Trimmed names, blank and '#' lines skipped, case-insensitive
    de-duplication keeping the first spelling: (username, _file, _block, _row)
    of the first occurrence."""
    t = (lines.select(F.trim("value").alias("username"), "_file", "_block", "_row")
         .where((F.col("username") != "") & ~F.col("username").startswith("#")))
    first = t.groupBy(F.lower("username").alias("_k")).agg(
        F.min(F.struct("_file", "_block", "_row", "username")).alias("f"))
    return first.select("f.username", "f._file", "f._block", "f._row")


def search_logins(pages: DataFrame, per_page: int = 100, query: str = "query",
                  max_pages: int | None = None) -> DataFrame:
    """Logins from landed search pages (query, page, total_count, items).

    Per query, all pages are read in order (up to ``max_pages`` where a caller
    sets that limit): reading stops before a missing page, at an empty page,
    after the first short page, and after the first page at which the distinct
    logins so far reach ``total_count``. Only string logins count;
    case-insensitive first-wins de-duplication. Windows run over one row per
    page.
    """
    from pyspark.sql import Window
    p = pages.where(F.col("page") >= 1)
    if max_pages is not None:
        p = p.where(F.col("page") <= max_pages)
    from retentio.functions.numbers import size_or_zero
    n_items = size_or_zero("items")
    items = (p.select(query, "page", F.posexplode("items").alias("pos", "item"))
             .select(query, "page", "pos", F.col("item.login").alias("login"))
             .where(F.col("login").isNotNull()))
    first = items.groupBy(query, F.lower("login").alias("_k")).agg(
        F.min(F.struct("page", "pos", "login")).alias("f")) \
        .select(query, "f.page", "f.pos", "f.login")
    new_per_page = first.groupBy(query, "page").agg(F.count(F.lit(1)).alias("_new"))
    w = Window.partitionBy(query).orderBy("page")
    pg = (p.select(query, "page", "total_count", n_items.alias("_n"))
          .join(new_per_page, [query, "page"], "left")
          .withColumn("_seen", F.sum(F.coalesce(F.col("_new"), F.lit(0))).over(
              w.rowsBetween(Window.unboundedPreceding, 0)))
          .withColumn("_prev_page", F.lag("page").over(w)))
    # last page read per query: a gap stops before the missing page
    stop_at = F.when(F.coalesce(F.col("_prev_page"), F.lit(0)) != F.col("page") - 1,
                     F.col("page") - 1) \
        .when(F.col("_n") == 0, F.col("page") - 1) \
        .when(F.col("_n") < per_page, F.col("page")) \
        .when(F.col("_seen") >= F.col("total_count"), F.col("page"))
    stops = pg.groupBy(query).agg(F.min(stop_at).alias("_stop"))
    return (first.join(stops, query)
            .where(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop")))
            .select(query, "login", "page", "pos"))
