"""Which messages of a turn stay, and which turns fit a budget. Selection is windows over narrow columns; only the planner,
whose choice depends on what it has chosen before, folds a session's costs in order."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text as fn

# Nouns that make a number a finding, words that tell of one, openings that only announce.
NOUNS = ["passed", "failed", "tests", "test", "errors", "error", "files", "file", "chars", "lines", "line", "ops", "cases", "case"]
FINDINGS = ["found", "confirmed", "verified", "proven", "proof", "root cause", "root-cause", "defer", "deferred", "fails", "failed", "failure", "error", "bug", "correction", "corrected", "fix", "fixed", "regression"]
OPENINGS = ["let me", "i'll", "i will", "now i", "now let", "next i", "next,", "let's"]

#: A ratio, or two digits or more with a noun that ends or begins within 16 characters of them.
NUMBER = "|".join(["[0-9] *(/|of) *[0-9]", *(f"[0-9]{{2}}(?s:.{{0,{16 - len(w)}}}){w}|{w}(?s:.{{0,{16 - len(w)}}})[0-9]{{2}}" for w in NOUNS)])
FINDING = "|".join(FINDINGS)
OPENING = "^\\s*(" + "|".join(OPENINGS) + ")"


def rich(text: Column, least: int = 280) -> Column:
    """A message that is long, or names a finding, a number of something, a commit, a place in a file, or code."""
    low, signs = F.lower(text), fn.richness(text)
    return (F.length(text) >= least) | low.rlike(NUMBER) | low.rlike(FINDING) | signs["has_hash"] | signs["has_file_line"] | signs["has_code"]


def announces(text: Column, most: int = 200, least: int = 280) -> Column:
    """A short message that only says what comes next."""
    return (F.length(text) <= most) & F.lower(text).rlike(OPENING) & ~rich(text, least)


def select_messages(rows: DataFrame, turn: list[str], order: str, text: str, mode: str = "longest", threshold: int = 6, least: int = 280, most: int = 200, keep_first: bool = True) -> DataFrame:
    """rows with `kept`, and for runs of dropped rows `dropped_run` (their number) on the first of each run.

    longest: the longest (of equal ones the last), a long first, and rich others; eot: the last; all; rich: short runs whole,
    longer ones without what only announces. A null text is empty.
    """
    if mode not in ("longest", "eot", "all", "rich"):
        raise ValueError(f"no such mode: {mode}")
    t = F.coalesce(F.col(text), F.lit(""))
    ordered, whole = Window.partitionBy(*turn).orderBy(order), Window.partitionBy(*turn)
    k, n = F.row_number().over(ordered), F.count(F.lit(1)).over(whole)
    rows = rows.withColumns({"__k": k, "__n": n, "__best": F.max(F.struct(F.length(t), F.col(order))).over(whole)[order]})
    first, last = F.col("__k") == 1, F.col("__k") == F.col("__n")
    kept = {
        "longest": (F.col("__best") == F.col(order)) | F.when(first, F.length(t) >= least).otherwise(rich(t, least)),
        "eot": last,
        "all": F.lit(True),
        "rich": (F.col("__n") <= threshold) | last | (first & F.lit(keep_first)) | ~announces(t, most, least),
    }[mode]
    rows = rows.withColumn("kept", kept)
    # rows of a run of dropped ones have seen equally many kept ones
    rows = rows.withColumn("__run", F.sum(F.col("kept").cast("long")).over(ordered))
    run = Window.partitionBy(*turn, "__run", "kept")
    starts = ~F.col("kept") & (F.row_number().over(run.orderBy(order)) == 1)
    return rows.withColumn("dropped_run", F.when(starts, F.count(F.lit(1)).over(run))).drop("__k", "__n", "__best", "__run")


def plan(turns: Iterable[dict], budget: int, share: float, banners: int | list[int]) -> list[tuple[int, str]]:
    """Turns (newest first: turn, user_cost, agent_cost, human, repeated, crossed) that fit, and which sides of them.

    First, within a share of the budget, whole turns of a person with an answer; the first of them that is larger than the
    share is taken all the same, if nothing is taken yet and the whole has room, and ends its pass. Then of all turns
    whatever fits: both sides, the user's, the agent's. What repeats elsewhere comes last in both. The boundaries down to
    the deepest turn cost a banner each: one cost for all, or one for each from the newest.
    """
    turns = list(turns)
    chosen: dict[int, str] = {}
    spent = deepest = 0

    def framed(t: dict, cost: int) -> int:
        depth = max(deepest, t["crossed"])
        return spent + cost + (depth * banners if isinstance(banners, int) else sum(banners[:depth]))

    passes = [[t for t in turns if not t["repeated"]], [t for t in turns if t["repeated"]]]
    for rows in passes:
        for t in rows:
            both = t["user_cost"] + t["agent_cost"]
            if not (t["user_cost"] and t["agent_cost"] and t.get("human", True)) or framed(t, both) > budget:
                continue
            inside = spent + both <= round(budget * share)
            if not inside and (spent or t["repeated"]):
                continue
            chosen[t["turn"]] = "both"
            spent, deepest = spent + both, max(deepest, t["crossed"])
            if not inside:
                break
    for t in passes[0] + passes[1]:
        if t["turn"] in chosen:
            continue
        options = [("both", t["user_cost"] + t["agent_cost"])] if t["user_cost"] and t["agent_cost"] else []
        options += [(s, c) for s, c in (("user", t["user_cost"]), ("agent", t["agent_cost"])) if c]
        if not (t["user_cost"] and t["agent_cost"]):
            options = options[:1]
        for sides, cost in options:
            if framed(t, cost) <= budget:
                chosen[t["turn"]] = sides
                spent, deepest = spent + cost, max(deepest, t["crossed"])
                break
    return sorted(chosen.items())


def plan_budget(turns: DataFrame, session: str, budget: int, share: float = 0.5, banners: int | list[int] = 0) -> DataFrame:
    """session, turn, sides for each turn chosen. turns: session, turn, latest_line, user_cost, agent_cost, repeated, crossed
    and, if there, human; one short row a turn, texts stay where they are."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["latest_line", "turn"], ascending=False).to_dict("records")
        got = plan(rows, budget, share, banners)
        return pd.DataFrame([(pdf["__s"].iloc[0], t, s) for t, s in got], columns=[session, "turn", "sides"])

    kind = turns.schema[session].dataType.simpleString()
    human = F.coalesce(F.col("human").cast("boolean"), F.lit(True)) if "human" in turns.columns else F.lit(True)
    narrow = turns.select(F.col(session).alias("__s"), *[F.col(c).cast("long") for c in ("turn", "latest_line", "user_cost", "agent_cost", "crossed")], F.coalesce(F.col("repeated").cast("boolean"), F.lit(False)).alias("repeated"), human.alias("human"))
    return narrow.na.fill(0).groupBy("__s").applyInPandas(one, f"`{session}` {kind}, turn long, sides string")


def superseded(rows: DataFrame, turn: list[str], order: str, text: Column, least: int = 80) -> DataFrame:
    """rows with `superseded_by`: the last later row of the turn whose text begins with the whole of this one, case aside.

    Only texts of `least` code points and more. Rows meet by a hash of their first `least` code points and the turn.
    """
    low = F.lower(text)
    long = rows.filter(F.length(text) >= least).select(*turn, F.col(order).alias("__o"), low.alias("__t"), F.xxhash64(F.substring(low, 1, least)).alias("__h"))
    later = long.select(*[F.col(c).alias(f"__{c}") for c in turn], F.col("__h").alias("__h2"), F.col("__o").alias("__later"), F.col("__t").alias("__t2"))
    same = (F.col("__h") == F.col("__h2")) & (F.col("__later") > F.col("__o"))
    for c in turn:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    found = long.join(later, same & F.startswith(F.col("__t2"), F.col("__t"))).groupBy(*turn, "__o").agg(F.max("__later").alias("superseded_by"))
    keys = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in turn]
    found = found.select(*[F.col(c).alias(f"__{c}") for c in turn], "__o", "superseded_by")
    joined = keys[0]
    for k in keys[1:]:
        joined = joined & k
    return rows.join(found, joined & (F.col(order) == F.col("__o")), "left").select(*rows.columns, "superseded_by")
