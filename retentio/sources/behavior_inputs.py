"""Behavioural inputs over the shared tables: events as they are, tickets,
billing and contracts derived from orders and their line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.sources import tables


# Days from the reference day of the orders to that of the events: a snapshot
# of both shifts the order dates by them, so that one as_of fits all sources.
TO_EVENT_CLOCK = (tables.EVENTS_AS_OF.date() - tables.ORDERS_AS_OF).days


def _orders(spark, sf_dir, shift):
    o = tables.table(spark, sf_dir, "orders")
    return o.withColumn("o_orderdate", F.col("o_orderdate") + F.make_dt_interval(F.lit(shift))) if shift else o


def tickets(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """A ticket per order with line items: opened = order date, closed =
    last ship date of its lines (both moved by ``shift`` days)."""
    o = _orders(spark, sf_dir, shift)
    lines = tables.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.max("l_shipdate") + F.make_dt_interval(F.lit(shift)) if shift else F.max("l_shipdate")).alias("closed"))
    return o.join(lines, o.o_orderkey == lines.l_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("ticket_id"),
        F.col("o_orderdate").alias("opened"), "closed")


def billing(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    o = _orders(spark, sf_dir, shift)
    return o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"),
                    F.col("o_totalprice").alias("amount"))


def contracts(spark: SparkSession, sf_dir: str, as_of=tables.ORDERS_AS_OF,
              term_days: int = 365, shift: int = 0) -> DataFrame:
    """Contract end = last order date on or before as_of + term."""
    o = _orders(spark, sf_dir, shift).where(F.to_date("o_orderdate") <= F.lit(as_of))
    return o.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.date_add(F.to_date(F.max("o_orderdate")), term_days).alias("end_date"))
