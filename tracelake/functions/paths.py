"""Paths as text: nothing asks the file system."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(path: Column) -> Column:
    """Without `.` segments, and one separator where several stand. Two at the very beginning stay, more become one; a `..`
    segment stays as it is."""
    lead = F.regexp_extract(path, r"^[/\\]*", 0)
    kept = F.when(F.length(lead) > 2, F.substring(lead, 1, 1)).otherwise(lead)
    body = F.substring(path, F.length(lead) + 1, F.length(path))
    # a `.` segment goes with the separators after it; then runs become their first separator
    body = F.regexp_replace(body, r"(?<=^|[/\\])(?:\.(?:[/\\]+|$))+", "")
    return F.concat(kept, F.regexp_replace(body, r"([/\\])[/\\]+", "$1"))


def names_file(target: str, path: Column) -> Column:
    """Whether target is the path, or its last segments."""
    tail = "(^|[/\\\\])" + re.escape(target).replace("/", "\\/") + "$"
    return (path == target) | path.rlike(tail)


def is_full(path: Column) -> Column:
    """Rooted, or with a drive."""
    return path.rlike(r"^([/\\]|[A-Za-z]:[/\\])")


def parent(path: Column) -> Column:
    """The folder of a path: what stands before its last separator; `.` where there is none, the root for what is in it."""
    up = F.regexp_replace(path, r"[/\\][^/\\]*$", "")
    return F.when(~path.rlike(r"[/\\]"), F.lit(".")).when(up == "", F.lit("/")).otherwise(up)


def join_text(base: str, parts: list[str]) -> str:
    """Parts joined to an absolute base, `.` and `..` resolved as text; `..` never leaves the root. A base with a drive or
    of a network share gives backslashes."""
    drive = re.match(r"[A-Za-z]:", base)
    share = re.match(r"\\\\([^/\\]*)[/\\]?([^/\\]*)", base)
    root = drive[0] if drive else rf"\\{share[1]}\{share[2]}" if share else ""
    rest = base[len((drive or share)[0]) :] if drive or share else base
    held: list[str] = []
    for segment in re.split(r"[/\\]", "/".join([rest, *parts])):
        if segment == "..":
            del held[-1:]
        elif segment not in ("", "."):
            held.append(segment)
    mark = "\\" if root else "/"
    return root + mark + mark.join(held)


def join(base: Column, part: Column) -> Column:
    """join_text() of two columns; a null part leaves the base, a null base gives null."""

    @F.pandas_udf("string")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else join_text(x, [y] if y else []) for x, y in zip(a, b, strict=True)], dtype=object)

    return f(base, part)
