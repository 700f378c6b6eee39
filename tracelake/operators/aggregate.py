"""Censuses, rollups, de-duplicated usage, gaps and islands, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def census(rows: DataFrame, key: Column) -> DataFrame:
    """Rows by key, most first; rows without the key are outside the axis."""
    return rows.withColumn("key", key).filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")


def by_record(hits: DataFrame, keys: list[str], session: str = "session_id", line: str = "line_no", section: str = "section") -> DataFrame:
    """Hits of a record's sections as one row a record, with the first value of each key that a section has. Hits without
    a line stand for themselves."""
    alone = F.col(line).isNull() | (F.col(line) <= 0)
    first = [F.min_by(F.col(k), F.when(F.col(k).isNotNull(), F.col(section))).alias(k) for k in keys]
    own = hits.filter(alone).select(session, line, *keys)
    return hits.filter(~alone).groupBy(session, line).agg(*first).unionByName(own)


def census_multi(rows: DataFrame, keys: Column) -> DataFrame:
    """A row counts once for each of its distinct keys."""
    return census(rows.select(F.explode(F.array_distinct(keys)).alias("k")), F.col("k"))


def excluded(rows: DataFrame, key: Column) -> DataFrame:
    """How many rows are inside and outside the axis."""
    return rows.agg(F.count(key).alias("counted"), F.count(F.when(key.isNull(), 1)).alias("excluded"))


def deduped_usage(rows: DataFrame, group: list[str], message: str, fields: list[str]) -> DataFrame:
    """Usage is repeated on all rows of a message, partly zeroed: the largest of each field counts, once a message; rows
    without a message count one by one."""
    key = F.coalesce(F.col(message).cast("string"), F.concat(F.lit("row:"), F.monotonically_increasing_id().cast("string")))
    once = rows.withColumn("__m", key).groupBy(*group, "__m").agg(*[F.max(f).alias(f) for f in fields])
    return once.groupBy(*group).agg(*[F.sum(f).alias(f) for f in fields], F.count(F.lit(1)).alias("messages"))


def with_total(rows: DataFrame, group: str, aggregates: list[Column], total: str = "TOTAL") -> DataFrame:
    """A row for each group and one over all, in one pass."""
    return rows.rollup(group).agg(F.grouping(group).alias("__g"), *aggregates).withColumn(group, F.when(F.col("__g") == 1, F.lit(total)).otherwise(F.col(group).cast("string"))).drop("__g")


def islands(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Runs of consecutive values: first, last, size."""
    w = Window.partitionBy(*group).orderBy(value)
    d = rows.select(*group, value).distinct().withColumn("__i", F.col(value) - F.row_number().over(w))
    return d.groupBy(*group, "__i").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("size")).drop("__i")


def within_budget(rows: DataFrame, group: str, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The longest prefix of each group, in the order given, whose cost stays within the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)


def greedy_budget(rows: DataFrame, group: str, item: str, cost: str, budget: int, order: Column) -> DataFrame:
    """Items of each group in order, each taken if it still fits; items that don't fit are skipped, not the end.

    A fold over the group's costs (numbers only, the texts stay where they are).
    """
    listed = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(item).alias("i"), F.col(cost).cast("long").alias("c")))).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<bigint>").alias("taken"))
    fold = F.aggregate(
        "l",
        start,
        lambda acc, x: F.when(acc["spent"] + x["c"] <= budget, F.struct((acc["spent"] + x["c"]).alias("spent"), F.concat(acc["taken"], F.array(x["i"].cast("long"))).alias("taken"))).otherwise(acc),
    )
    return listed.select(group, F.explode(fold["taken"]).alias(item))
