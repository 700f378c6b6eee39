"""Which raw lines an operator has to parse: tests on a line's text before any JSON is read.

A gate may keep a line that turns out to hold nothing; it never leaves out one that does. Keys and values stand between
quotes, which JSON escapes inside a text, so that words quoted in a message are no hits.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a line holds that an operator reads.
NEEDLES = {
    "files": ["Edit", "Write", "Bash", "filePath", "file-history-snapshot", "is_error"],
    "recover": ["toolUseResult", "Edit", "Write", "Read", "Bash", "PowerShell", "filePath", "file_path", "file-history-", "edited_text_file", "tool_use_error"],
    "turns": ['"type":"assistant"', "isCompactSummary", "tool_use"],
    "sessions": ['"continuedInSessionId"'],
    "stats": [],
    "images": ['"type":"image"', '"media_type"', "base64"],
    "plans": ["plan_mode"],
    "spawns": ["tool_use", "tool_result"],
    "background": [
        "run_in_background", "Command running in background", "async_launched", "task-notification", "stopped by the user", '"Monitor"', "Monitor started",
        "manually backgrounded by user with ID: ", "moved to the background (ID: ",
    ],
}
#: Whose messages an operator reads besides.
ROLES = {"files": ["user"], "recover": ["user"], "turns": ["user", "assistant"], "sessions": ["user", "assistant"], "stats": ["user", "assistant"]}
#: Lines of a search beside messages, each kept only where a selector asks for it; all needles of an entry have to be there.
EXTRAS = {
    "boundaries": ["compact_boundary", '"subtype"'],
    "hook_context": ["hook_additional_context"],
    "attachments": ['"attachment"'],
    "queued": ['"queue-operation"'],
    "snapshots": ['"file-history-'],
    "system": ['"subtype"'],
    "fires": ["scheduled_task_fire", '"subtype"'],
}


def has_role(raw: Column, *roles: str) -> Column:
    """Whether a line has a message of one of the roles, however its JSON is spaced."""
    return raw.rlike(f'"role"\\s*:\\s*"({"|".join(roles)})"')


def asks(raw: Column) -> Column:
    """Whether a line can hold a call that asks the user."""
    return raw.contains("AskUserQuestion") & has_role(raw, "assistant")


def admits(raw: Column, reader: str) -> Column:
    """Whether a reader (a key of NEEDLES) has to parse a line."""
    tests = [raw.contains(n) for n in NEEDLES[reader]]
    if reader in ROLES:
        tests.append(has_role(raw, *ROLES[reader]))
    if reader in ("files", "recover"):
        tests.append(asks(raw))
    return reduce(or_, tests)


def searched(raw: Column, extras: list[str] | None = None) -> Column:
    """Whether a search has to parse a line: messages, and the kinds of EXTRAS that its selectors reach."""
    out = has_role(raw, "user", "assistant")
    for name in extras or []:
        out = out | reduce(and_, [raw.contains(n) for n in EXTRAS[name]])
    return out


def gate(lines: DataFrame, reader: str) -> DataFrame:
    """Lines that a reader has to parse."""
    return lines.filter(admits(F.col("value"), reader))
