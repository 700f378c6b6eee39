"""Pairing, pending rows, as-of and nearest joins, copies, provenance edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairing(uses: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """key, state: uses with a result are paired, without one pending; results without a use are orphans."""
    u = uses.select(key).distinct().withColumn("u", F.lit(1))
    r = results.select(key).distinct().withColumn("r", F.lit(1))
    state = F.when(F.col("u").isNull(), "orphan").when(F.col("r").isNull(), "pending").otherwise("paired")
    return u.join(r, key, "full").select(key, state.alias("state"))


def pending(opened: DataFrame, closed: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the latest opening row, if nothing anywhere closes it."""
    names = opened.columns
    latest = opened.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("r")).select("r.*")
    return latest.join(closed.select(key).distinct(), key, "left_anti")


def asof(left: DataFrame, right: DataFrame, by: str, lt: str, rt: str, value: str, within: str | None = None) -> DataFrame:
    """Each left row with the nearest right row of the same key that is not later, within an interval if given.

    One sort over the union instead of a join over all pairs; the right side carries its value and time.
    """
    a = left.select(F.struct(*left.columns).alias("row"), F.col(by).alias("k"), F.col(lt).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("v"))
    b = right.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col(by).alias("k"), F.col(rt).alias("t"), F.lit(0).alias("side"), F.col(value).alias("v"))
    w = Window.partitionBy("k").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.struct(F.col("t").alias("t"), F.col("v").alias("v"))), ignorenulls=True).over(w)
    out = a.unionByName(b).withColumn("last", last).filter("side = 1")
    near = F.lit(True) if within is None else F.col("last.t") >= F.col("t") - F.expr(within)
    return out.select("row.*", F.when(near, F.col("last.v")).alias(f"{value}_asof"), F.when(near, F.col("last.t")).alias(f"{rt}_asof"))


def prefix_copies(rows: DataFrame, group: str, item: str, content: Column) -> DataFrame:
    """Relation of the copies of one group: identical, prefix (each is a prefix of the longest), or divergent."""
    d = rows.select(group, item, content.alias("c"))
    longest = d.groupBy(group).agg(F.max_by("c", F.struct(F.length("c"), F.col(item))).alias("l"), F.count(F.lit(1)).alias("copies"))
    j = d.join(longest, group)
    worst = F.max(F.when(F.col("c") == F.col("l"), 0).when(F.col("l").startswith(F.col("c")), 1).otherwise(2))
    return j.groupBy(group).agg(F.first("copies").alias("copies"), worst.alias("w")).select(group, "copies", F.element_at(F.array(F.lit("identical"), F.lit("prefix"), F.lit("divergent")), F.col("w") + 1).alias("relation"))


def nearest(left: DataFrame, right: DataFrame, by: str, lt: str, rt: str, value: str) -> DataFrame:
    """Each left row with the nearest right row of the same key, earlier or later: <value>_near, gap (in units of the key,
    which is a number), and tied: whether another right row is as near. Of tied rows the earlier, then the smaller value.

    Equal times on the right are one row first; then one sort over the union, and a look to both sides.
    """
    b = right.groupBy(F.col(by).alias("k"), F.col(rt).alias("t")).agg(F.min(value).alias("v"), F.count(F.lit(1)).alias("n"))
    b = b.select("k", "t", F.lit(0).alias("side"), F.struct("t", "v", "n").alias("r"))
    a = left.select(F.struct(*left.columns).alias("row"), F.col(by).alias("k"), F.col(lt).alias("t"), F.lit(1).alias("side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy("k").orderBy("t", "side")
    before = F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumns({"p": before, "q": after}).filter("side = 1").withColumns({"dp": F.col("t") - F.col("p.t"), "dq": F.col("q.t") - F.col("t")})
    first = F.col("dq").isNull() | (F.col("dp") <= F.col("dq"))
    pick = F.when(F.col("dp").isNotNull() & first, F.col("p")).otherwise(F.col("q"))
    tied = F.coalesce((F.col("dp") == F.col("dq")) & (F.col("p.t") != F.col("q.t")), F.lit(False)) | F.coalesce(pick["n"] > 1, F.lit(False))
    return near.select("row.*", pick["v"].alias(f"{value}_near"), F.least("dp", "dq").alias("gap"), tied.alias("tied"))


def identical(rows: DataFrame, item: str, content: Column) -> DataFrame:
    """digest, copies, first_id of contents that several rows have; null contents are none. Only digests move."""
    hashed = rows.filter(content.isNotNull()).select(F.sha2(content.cast("binary"), 256).alias("digest"), F.col(item).alias("i"))
    return hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("i").alias("first_id")).filter("copies > 1")


def unanswered(opened: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """Keys of opened rows that nothing answers."""
    return opened.select(key).distinct().join(answered.select(key), key, "left_anti")


def branch_points(edges: DataFrame, parent: str, order: str) -> DataFrame:
    """Parents with more than one child: how many, and the widest gap between neighbours."""
    gap = F.col(order) - F.lag(order).over(Window.partitionBy(parent).orderBy(order))
    return edges.filter(F.col(parent).isNotNull()).withColumn("gap", gap).groupBy(parent).agg(F.count(F.lit(1)).alias("children"), F.max("gap").alias("widest")).filter("children > 1")


def last_state(rows: DataFrame, key: str, order: list[str], state: str, ranks: dict[str, str], other: str) -> DataFrame:
    """key, verdict: the newest row's state by a table of precedence."""
    newest = rows.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("s"))
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return newest.select(key, F.coalesce(F.element_at(table, F.col("s")), F.lit(other)).alias("verdict"))


def no_event_between(rows: DataFrame, key: str, order: str, kind: str, mark: str, event: str) -> DataFrame:
    """Neighbouring marks of a key without an event between them: the later mark's row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last_mark = F.max(F.when(F.col(kind) == mark, F.col(order))).over(w)
    last_event = F.max(F.when(F.col(kind) == event, F.col(order))).over(w)
    return rows.withColumn("m", last_mark).withColumn("e", last_event).filter((F.col(kind) == mark) & F.col("m").isNotNull() & (F.col("e").isNull() | (F.col("e") < F.col("m")))).drop("m", "e")
