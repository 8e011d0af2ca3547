"""Shared helpers: table access, word expressions, scratch tables, sources.

Conventions of every operator in this package: input columns beyond those
named are ignored (they may clash with working names: only ``doc_id`` and
``text`` are read, under own names), a null text counts as empty unless the
docstring says otherwise, repeated rows each keep their own result row.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.session import drop_written, prepare_session, small_side, write_once

# Fixed value: white space of the word definition, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of a shared table."""
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of ``text`` (null or blank: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a row's decision: equal for rows with equal id and text, which
    any deterministic operator treats alike; differs for repeated ids. Nulls
    are told apart by flags (the hash itself skips them, so that an id without
    text would meet a text without id). 64 bits."""
    return F.xxhash64(doc_id.isNull(), doc_id.cast("string"), text.isNull(), text)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts
    lineage, survives the loss of any executor."""
    return write_once(df, name)


def drop_saved(df: DataFrame) -> None:
    """Remove the scratch folder behind a table written by :func:`saved`;
    other folders are left alone."""
    drop_written(df)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs started inside send at most ``rows`` rows per batch to Python
    (they must run to their end inside): bounds the texts a worker holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def uniform(text: Column) -> Column:
    """Deterministic number in [0, 1) from a string: 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sized(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows (counted
    here), else as it is, for a shuffled join."""
    return small_side(df, most)


def by_lists(docs: DataFrame, lists: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` (with a key ``doc``) whose key is in ``lists`` (one row
    per key), joined with it, and the other rows. The keys are broadcast up to
    ``most`` of them: then only the texts in the lists are shuffled."""
    keys = sized(lists.select(F.col("doc").alias("_k")), most)
    inside = docs.join(keys, F.col("doc") == F.col("_k"), "left_semi")
    both = inside.join(lists.withColumnRenamed("doc", "_k"), F.col("doc") == F.col("_k")).drop("_k")
    return both, docs.join(keys, F.col("doc") == F.col("_k"), "left_anti")
