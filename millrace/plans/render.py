"""Renders rows of the driver's tables as members, so that what is read back can be held against the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(rows: DataFrame, member: Column, order: Column, text: Column, head: str = "", tail: str = "") -> DataFrame:
    """(member, text): the texts of a member's rows in order, one below the other, between head and tail."""
    each = rows.select(member.cast("string").alias("member"), F.struct(order.alias("k"), text.alias("t")).alias("x"))
    lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"])
    return each.groupBy("member").agg(F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit(tail)).alias("text"))


def bucket(key: Column, rows_each: int, prefix: str) -> Column:
    """A member name for runs of ``rows_each`` keys."""
    return F.concat(F.lit(prefix), F.floor(key / rows_each).cast("string"))
