"""Identifiers: shapes of ids, prefixes, folder names, a mixer."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.text import is_uuid


def is_agent_hex(text: Column) -> Column:
    """Twelve hexadecimal digits or more, and nothing else."""
    return text.rlike("^[0-9A-Fa-f]{12,}$")


def is_named_agent(text: Column) -> Column:
    """An `a`, a name, a dash and twelve hexadecimal digits or more, if it isn't a uuid."""
    return text.rlike("^a[A-Za-z0-9-]+-[0-9A-Fa-f]{12,}$") & ~is_uuid(text)


def has_prefix(text: Column, prefix: Column) -> Column:
    """Whether an id begins with a prefix, dashes on both sides aside."""
    return F.startswith(F.replace(text, F.lit("-")), F.replace(prefix, F.lit("-")))


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.floor(F.length(F.encode(text, "UTF-16BE")) / 2).cast("long")


@F.pandas_udf(T.StringType())
def folder_name(path: pd.Series) -> pd.Series:
    """The folder's name for a working directory: composed, and each UTF-16 unit that is no ASCII letter or digit a dash."""

    def one(p: str | None) -> str | None:
        if p is None:
            return None
        units = np.frombuffer(unicodedata.normalize("NFC", p).encode("utf-16-le", "surrogatepass"), "<u2").tolist()
        return "".join(chr(u) if u < 128 and chr(u).isalnum() else "-" for u in units)

    return path.map(one, na_action=None).astype(object)


@F.pandas_udf(T.LongType())
def splitmix64(seed: pd.Series) -> pd.Series:
    """The SplitMix64 generator's output for a state (64 bits; unsigned values above 2^63 read as negative ones)."""
    z = seed.to_numpy(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return pd.Series((z ^ (z >> np.uint64(31))).view(np.int64))
