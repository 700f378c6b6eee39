"""Search: turns, exchanges, matches, context rows, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.grammar import Range, may_match, smart_case


def with_turns(rows: DataFrame, opens: Column, session: str = "session_id", line: str = "line_no") -> DataFrame:
    """Adds turn_index: rows up to the second opener are turn 0, what stands before the first one included."""
    w = Window.partitionBy(session).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("turn_index", F.greatest(F.sum(F.when(opens, 1).otherwise(0)).over(w) - 1, F.lit(0)).cast("long"))


def with_turn_count(rows: DataFrame, session: str = "session_id") -> DataFrame:
    """Adds turns: how many turns the session has."""
    return rows.withColumn("turns", F.max("turn_index").over(Window.partitionBy(session)) + 1)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.coalesce(text.rlike(smart_case(pattern, ignore_case)), F.lit(False))


def exchanges(rows: DataFrame, hit: Column, session: str = "session_id", line: str = "line_no") -> DataFrame:
    """One row for each turn with a hit: its lines, its hits, the first hit's line."""
    marked = rows.withColumn("hit", hit)
    out = marked.groupBy(session, "turn_index").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("hit").cast("long")).alias("n_hits"),
        F.min(line).alias("first_line"),
        F.max(line).alias("last_line"),
        F.min(F.when(F.col("hit"), F.col(line))).alias("first_hit"),
    )
    return out.filter("n_hits > 0")


def turn_range(rows: DataFrame, spec: Range, session: str = "session_id") -> DataFrame:
    return with_turn_count(rows, session).filter(spec.holds(F.col("turn_index"), F.col("turns"))).drop("turns")


def capped(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The earliest n rows, or the latest -n, or all (0): always in order, oldest first."""
    if n == 0:
        return df.orderBy(*order)
    if n > 0:
        return df.orderBy(*order).limit(n)
    return df.orderBy(*[F.desc(c) for c in order]).limit(-n).orderBy(*order)


def ranked(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """capped() with `rank`: the place of each row in the order shown, from 1. Only the rows kept are ranked."""
    return capped(rows, n, order).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def candidates(lines: DataFrame, pattern: str, ignore_case: bool = False, also: list[str] | None = None) -> DataFrame:
    """Raw lines that can hold a match, or one of the strings `also` (what structure needs), before anything is parsed."""
    keep = may_match(F.col("value"), pattern, ignore_case)
    for word in also or []:
        keep = keep | F.col("value").contains(word)
    return lines.filter(keep)


def siblings(rows: DataFrame, hit: Column, caps: dict[str, int], session: str = "session_id", line: str = "line_no", kind: str = "role") -> DataFrame:
    """Rows of turns with a hit that are no hits themselves; of each kind with a cap, the first of the turn."""
    marked = rows.withColumn("hit", hit)
    turn = Window.partitionBy(session, "turn_index")
    inside = marked.withColumn("any", F.max(F.col("hit").cast("int")).over(turn)).filter((F.col("any") == 1) & ~F.col("hit"))
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy(session, "turn_index", kind).orderBy(line)))
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    return ranked.filter(F.col("rank") <= F.coalesce(F.element_at(cap, F.col(kind)), F.lit(2**31 - 1))).drop("rank", "any", "hit")


def zero_match_probe(rows: DataFrame, hit: Column, label: str) -> DataFrame:
    """Where a pattern does occur when the label filter is dropped: matches by label."""
    return rows.filter(hit).groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label)
