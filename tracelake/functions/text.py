"""Scalar functions over text, all as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_ws(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def elide(text: Column, most: int) -> Column:
    """At most `most` code points, and how many more there were."""
    n = F.length(text)
    unit = F.when(n - most == 1, F.lit(" char)")).otherwise(F.lit(" chars)"))
    return F.when(n <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("… (+"), (n - most).cast("string"), unit))


def middle_truncate(text: Column, most: int, head: float) -> Column:
    """Head and tail of a text of more than `most` code points, with what is left out between them."""
    front = int(most * head)
    back = most - front
    n = F.length(text)
    cut = F.concat(F.substring(text, 1, front), F.lit(" … (+"), (n - most).cast("string"), F.lit(" chars) … "), F.right(text, F.lit(back)))
    return F.when(n <= most, text).otherwise(cut)


def match_excerpt(text: Column, literal: str, most: int) -> Column:
    """`most` code points around the first match; null if there is none."""
    at = F.locate(literal, text)
    start = F.greatest(F.lit(1), at - F.lit((most - len(literal)) // 2))
    return F.when(at > 0, F.substring(text, start, F.lit(most)))


def fingerprint(text: Column, most: int = 80) -> Column:
    """Lower-cased, white space collapsed, the first `most` code points."""
    return F.substring(F.lower(normalize_ws(text)), 1, most)


def duration(seconds: Column) -> Column:
    """The two largest units of a number of seconds."""
    s = seconds.cast("long")
    two = lambda a, u, b, v: F.concat(a.cast("string"), F.lit(u + " "), b.cast("string"), F.lit(v))
    part = lambda d, m: F.floor(s / d) % m if m else F.floor(s / d)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, two(part(60, 0), "m", s % 60, "s"))
        .when(s < 86400, two(part(3600, 0), "h", part(60, 60), "m"))
        .otherwise(two(part(86400, 0), "d", part(3600, 24), "h"))
    )


def duration_ms(ms: Column) -> Column:
    """The same of milliseconds, rounded to seconds."""
    return duration(F.floor((ms + 500) / 1000))


def took(started: Column, ended: Column) -> Column:
    """2h05m, 14m20s or 3s between two ISO times; null where one is missing or none; never negative."""
    s = F.unix_seconds(F.try_to_timestamp(ended)) - F.unix_seconds(F.try_to_timestamp(started))
    s = F.when(s < 0, 0).otherwise(s)
    two = lambda n: F.lpad((n % 60).cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s / 60)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), two(m), F.lit("m"))).when(m > 0, F.concat(m.cast("string"), F.lit("m"), two(s), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def human_bytes(n: Column) -> Column:
    """A size in B, KB or MB, with one decimal above bytes."""
    one = lambda d, u: F.concat(F.format_string("%.1f", F.floor(n * 10 / d) / 10), F.lit(u))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, one(1024, " KB")).otherwise(one(1024 * 1024, " MB"))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def xml_tag(text: Column, tag: str) -> Column:
    """What stands between the first <tag> and the next </tag>, trimmed; null if nothing does. Tags with attributes, and
    longer names that begin alike, are other tags."""
    got = strip(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1))
    return F.when(got != "", got)


def xml_tags(text: Column, tag: str) -> Column:
    """What stands between each pair of tags, in order, trimmed; empty ones are left out."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def xml_attribute(text: Column, name: str) -> Column:
    """The first value that is given to name, trimmed; null if empty or missing."""
    got = strip(F.regexp_extract(text, f'(?s){name}="(.*?)"', 1))
    return F.when(got != "", got)


def saved_path(text: Column) -> Column:
    """The rest of the line that tells where a long output was saved; null if there is none."""
    got = strip(F.regexp_extract(text, "Full output saved to:([^\n]*)", 1))
    return F.when(got != "", got)


def count_of(n: Column, noun: str) -> Column:
    """A count with its noun: 1 char, 2 chars."""
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {noun}")).otherwise(F.lit(f" {noun}s")))


def one_line(text: Column, most: int) -> Column:
    """White space collapsed, then cut at `most` code points with the number of those left out."""
    return elide(normalize_ws(text), most)


def newlines(text: Column) -> Column:
    """For each newline of a text, the place in normalize_ws(text) of the space that stands for it: 0 in leading white
    space, the length in trailing white space."""
    before = lambda k: F.substring(text, F.lit(1), k)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda k: F.substring(text, k, F.lit(1)) == "\n")
    return F.transform(at, lambda k: F.length(F.regexp_replace(normalize_ws(F.concat(before(k - 1), F.lit("x"))), " ?x$", "")))


def windows(text: Column, size: int) -> Column:
    """A text cut into pieces of at most `size` code points that concatenate to it: whole lines as far as they fit; a line
    that is too long by itself is cut, and its rest goes on with the lines after it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}\\z|.{{0,{size - 1}}}\n|.{{{size}}}"), F.lit(0))


def gutter(text: Column) -> Column:
    """(line, text) of each line that begins with a line number and a tab or an arrow; other lines are left out."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("^(?U)\\s*[0-9]+[\t\u2192]"))
    return F.transform(
        lines, lambda x: F.struct(F.regexp_extract(x, "^(?U)\\s*([0-9]+)", 1).cast("long").alias("line"), F.regexp_extract(x, "(?s)^(?U)\\s*[0-9]+[\t\u2192](.*)$", 1).alias("text"))
    )


def summary_fingerprints(body: Column) -> Column:
    """Fingerprints of a summary's bullets, of what they quote where they quote, and of what other lines quote."""
    lines = F.transform(F.split(body, "\r?\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+", ""))
    quoted = lambda x: F.when(x.rlike('"[^"]*"'), F.regexp_extract(x, '"([^"]*)"', 1))
    said = F.transform(lines, lambda x: F.coalesce(quoted(x), F.when(x.startswith("- "), F.substring(x, F.lit(3), F.length(x)))))
    return F.filter(F.transform(said, lambda x: fingerprint(x)), lambda x: x.isNotNull() & (x != ""))


def ranges(values: Column) -> Column:
    """A sorted array of distinct integers as '1-3, 5': where runs begin and where they end, side by side."""
    n = F.size(values)
    places = F.sequence(F.lit(0), n - 1)
    first = F.filter(places, lambda i: (i == 0) | (F.get(values, i) != F.get(values, i - 1) + 1))
    last = F.filter(places, lambda i: (i == n - 1) | (F.get(values, i) + 1 != F.get(values, i + 1)))
    at = lambda i: F.get(values, i).cast("string")
    runs = F.zip_with(first, last, lambda a, b: F.when(a == b, at(a)).otherwise(F.concat(at(a), F.lit("-"), at(b))))
    return F.when(n > 0, F.array_join(runs, ", ")).when(n == 0, F.lit(""))


def gaps(lines: Column, total: Column) -> Column:
    """(first, last) of each run of numbers from 1 to total that a sorted array of distinct line numbers leaves out. A null
    total ends at the last line; without lines all are missing."""
    n = F.size(lines)
    starts = F.concat(F.array(F.lit(0).cast("long")), lines.cast("array<bigint>"))
    ends = F.concat(lines.cast("array<bigint>"), F.array(F.coalesce(total.cast("bigint"), F.get(lines, n - 1).cast("bigint"), F.lit(0).cast("long")) + 1))
    pairs = F.zip_with(starts, ends, lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last")))
    return F.filter(pairs, lambda g: g["first"] <= g["last"])


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")


def json_long(text: Column, key: str) -> Column:
    """An integer member of a JSON text; null where there is none, never an error."""
    return F.get_json_object(text, f"$.{key}").try_cast("bigint")


def richness(text: Column) -> dict[str, Column]:
    """Signals that a message has substance: a commit hash, file:line, code in backticks, a number with a noun."""
    return {
        "has_hash": text.rlike(r"\b[0-9]*[a-f][0-9a-f]{6,39}\b"),
        "has_file_line": text.rlike(r"[A-Za-z0-9_/-]+\.[a-z]{1,4}:[0-9]+"),
        "has_code": text.rlike("`[^`]+`"),
        "has_number": text.rlike(r"\b[0-9]+ (tests|files|lines|errors|failures|rows)\b"),
    }
