"""Ranks within groups of any size: rows are dealt over tasks by ranges of their order, so no group fills one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def ranked(df: DataFrame, by: list[Column], order: list[Column]) -> DataFrame:
    """``row`` (each row of ``df`` as a struct), its ``rank`` from 0 in its group, and the group's ``size``.

    A group may hold any share of the rows. A null key is a group like any other, and nulls come first in an
    order. Rows that tie are ranked by a hash of the whole row; rows equal in all columns, in any order. An
    empty table gives an empty one.
    """
    sort = [f"o{i}" for i in range(len(order))] + ["tie", "salt"]
    rows = df.select(
        F.struct("*").alias("row"), F.struct(F.lit(0), *by).alias("key"), *(o.alias(f"o{i}") for i, o in enumerate(order)), F.xxhash64("*").alias("tie"), F.rand(1).alias("salt")
    )
    # Written, as counts and ranks have to see the same ranges.
    dealt = written(rows.repartitionByRange("key", *sort).withColumn("range", F.spark_partition_id()), "ranked")
    # Ranges follow each other, so there are at most as many counts as groups and ranges together.
    counts = dealt.groupBy("key", "range").agg(F.count("*").alias("n"))
    group = Window.partitionBy("key")
    counts = counts.select("key", "range", (F.sum("n").over(group.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(group).alias("size"))
    local = F.row_number().over(Window.partitionBy("key", "range").orderBy(*sort)) - 1
    return dealt.withColumn("local", local).join(counts, ["key", "range"]).select("row", (F.col("before") + F.col("local")).alias("rank"), "size")
