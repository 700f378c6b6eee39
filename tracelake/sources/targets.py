"""Targets: what a user names (a session, an agent, a beginning of an id, a folder, a file), resolved to transcripts.

Tokens are read on the driver; the table of files, which grows with the store, stays a DataFrame. A beginning has to name
one id among sessions and agents, or it is an error; no more than a few ids of it are brought to the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import ids, paths
from tracelake.operators import agents
from tracelake.sources import transcripts

UUID = "[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
#: Folder names longer than this are cut and have a suffix.
LONGEST_FOLDER = 200
#: Ids that an error message names.
NAMED = 20


@dataclass(frozen=True)
class Target:
    """kind: session, prefix, agent, teammate (value is the name), folder (a folder's own name), path, file, self."""

    kind: str
    value: str
    team: str = ""


def is_prefix(text: str) -> bool:
    """Whether a text can begin an id: 4 to 11 hexadecimal digits, or a uuid cut after its first dash."""
    cut = re.fullmatch("[0-9A-Fa-f-]{9,35}", text) and all((c == "-") == (k in (8, 13, 18, 23)) for k, c in enumerate(text))
    return bool(re.fullmatch("[0-9A-Fa-f]{4,11}", text) or cut)


def is_agent(text: str) -> bool:
    """Whether a text is an agent's id: 12 hexadecimal digits or more, alone or after a name that begins with an a."""
    named = re.fullmatch("a[A-Za-z0-9-]+-[0-9A-Fa-f]{12,}", text) and not re.fullmatch(UUID, text)
    return bool(re.fullmatch("[0-9A-Fa-f]{12,}", text) or named)


def parse(token: str) -> Target:
    """The target that a token names. Ids have an @ before them; without it a token is a file or a path."""
    if not token.startswith("@"):
        if token.endswith(".jsonl"):
            return Target("file", token)
        if re.fullmatch(UUID, token) or is_prefix(token) or is_agent(token):
            raise ValueError(f"{token!r} looks like an id; ids are written @{token}")
        return Target("path", token)
    name = token[1:]
    if name == "main":
        return Target("self", "")
    if name.startswith("trap:"):
        return Target("marker", name.removeprefix("trap:"))
    if re.fullmatch(UUID, name):
        return Target("session", name)
    if is_agent(name):
        return Target("agent", name)
    if mate := re.fullmatch("([A-Za-z0-9_-]+)@([A-Za-z0-9_-]+)", name):
        return Target("teammate", mate[1], mate[2])
    if is_prefix(name):
        return Target("prefix", name)
    if re.match("-|[A-Za-z]--", name):
        return Target("folder", name)
    if re.fullmatch("[0-9A-Fa-f]{1,3}", name):
        raise ValueError(f"{token!r} is too short: the beginning of an id has 4 digits or more")
    raise ValueError(f"{token!r} names no session, agent or folder")


def pins_one(token: str) -> bool:
    """Whether a token names a single transcript."""
    try:
        return parse(token).kind not in ("path", "folder")
    except ValueError:
        return False


def listed(text: str) -> list[str]:
    """Tokens of a list of ids, whatever white space parts them; an @ may stand before each."""
    out = []
    for word in text.split():
        name = word.removeprefix("@")
        if not (re.fullmatch(UUID, name) or is_prefix(name) or is_agent(name)):
            raise ValueError(f"{word!r} is no id of a session or an agent")
        out.append("@" + name)
    return out


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, folder, session_id, is_subagent, parent_session_id, bytes of the transcripts below a store's root. Contents
    are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace(F.col("path"), "^.*?" + re.escape(re.sub("^[a-z]+:/*", "/", root.rstrip("/"))) + "/", "")
    return found.select("path", F.regexp_extract(below, "^([^/]+)/", 1).alias("folder"), *transcripts.identity(F.col("path")), F.col("length").alias("bytes"))


def unique(files: DataFrame, prefix: str) -> tuple[str, bool]:
    """The one id that begins so, and whether it is an agent's."""
    hits = files.filter(ids.has_prefix(F.col("session_id"), F.lit(prefix))).select("session_id", "is_subagent").distinct().orderBy("session_id").limit(NAMED + 1).collect()
    if not hits:
        raise LookupError(f"no id of a session or an agent begins with {prefix!r}")
    if len(hits) > 1:
        raise LookupError(f"@{prefix} is ambiguous: {', '.join(h.session_id for h in hits[:NAMED])}{' and more' if len(hits) > NAMED else ''} begin so")
    return hits[0].session_id, hits[0].is_subagent


def in_folder(folder: Column, path: str) -> Column:
    """Whether a folder holds the transcripts of a working directory."""
    name = ids.folder_name(F.lit(paths.join_text(path, [])))
    return (folder == name) | ((F.length(name) > LONGEST_FOLDER) & F.startswith(folder, F.concat(F.substring(name, 1, LONGEST_FOLDER), F.lit("-"))))


def select(files: DataFrame, tokens: list[str], current: str | None = None, nodes: DataFrame | None = None, with_agents: bool = True) -> DataFrame:
    """Files that the tokens name; all sessions if there is none. Folders and paths bound the sessions named with them; a
    session brings its agents, and an agent those below it (nodes: agents.nodes()), unless with_agents is False. A session
    that isn't there is an error. current: the session of the caller (@main)."""
    wanted = [parse(t) for t in tokens]
    sessions, named_agents = [], []
    for t in wanted:
        if t.kind == "self" and current is None:
            raise LookupError("@main: there is no current session")
        if t.kind == "prefix":
            found, agent = unique(files, t.value)
            (named_agents if agent else sessions).append(found)
        elif t.kind in ("session", "self"):
            sessions.append(t.value or current)
        elif t.kind == "agent":
            named_agents.append(t.value)
        elif t.kind == "teammate":
            if nodes is None:
                raise LookupError(f"@{t.value}@{t.team}: teammates are named by the agents' table")
            rows = nodes.filter((F.col("name") == t.value) & (F.col("team") == t.team)).select("agent_id").distinct().limit(2).collect()
            if len(rows) != 1:
                raise LookupError(f"@{t.value}@{t.team} names {'no agent' if not rows else 'several agents'}")
            named_agents.append(rows[0].agent_id)
        elif t.kind == "marker":
            raise LookupError("a marker is looked up in the lines: see marked()")
    scope = F.lit(not any(t.kind in ("folder", "path") for t in wanted))
    for t in wanted:
        if t.kind == "folder":
            scope = scope | (F.col("folder") == t.value)
        elif t.kind == "path":
            scope = scope | in_folder(F.col("folder"), t.value)
    exact = [F.endswith(F.col("path"), F.lit(t.value)) for t in wanted if t.kind == "file"]
    only_agents = bool(named_agents or exact) and not sessions and not any(t.kind in ("folder", "path") for t in wanted)
    owner = F.coalesce("parent_session_id", "session_id")
    keep = F.lit(False)
    if not only_agents:
        mine = owner.isin(sessions) if sessions else F.lit(True)
        keep = keep | (scope & mine & (F.lit(with_agents) | ~F.col("is_subagent")))
        if sessions:
            there = {r[0] for r in files.filter(~F.col("is_subagent") & scope & F.col("session_id").isin(sessions)).select("session_id").distinct().collect()}
            if missing := sorted(set(sessions) - there):
                raise LookupError(f"no transcript of session {', '.join(missing)}")
    for e in exact:
        keep = keep | e
    if not named_agents:
        return files.filter(keep)
    if files.filter(F.col("is_subagent") & F.col("session_id").isin(named_agents)).isEmpty():
        raise LookupError(f"no transcript of agent {', '.join(named_agents)}")
    tree = agents.subtree(nodes, named_agents) if nodes is not None and with_agents else files.sparkSession.createDataFrame([(a,) for a in named_agents], "agent_id string")
    below = tree.select(F.col("agent_id").alias("session_id"), F.lit(True).alias("is_subagent"), F.lit(True).alias("__below"))
    return files.join(below, ["session_id", "is_subagent"], "left").filter(keep | F.col("__below")).select(*files.columns)


def marked(lines: DataFrame, marker: str) -> DataFrame:
    """Transcripts with a command that holds the marker as it is: path, session_id, is_subagent, line_no of the first."""
    if not re.fullmatch("[A-Za-z0-9_.:-]{6,}", marker):
        raise ValueError("a marker has 6 characters or more that neither JSON nor a shell escapes")
    said = lines.filter(F.col("value").contains(marker) & F.col("value").contains("tool_use") & F.col("value").contains('"Bash"'))
    return said.groupBy("path", "session_id", "is_subagent").agg(F.min("line_no").alias("line_no"))


def copies(files: DataFrame, lines: DataFrame) -> DataFrame:
    """path, kept (the copy that stays), relation (identical, prefix, divergent), dropped: transcripts of one id that stand
    at several paths.

    The largest copy stays, of equal ones that with the smallest path. Where every other is equal to its beginning (the
    last line may be cut) they are dropped; where one differs, all stay. files: files(); lines: path, line_no, value."""
    owner = ["session_id", "is_subagent"]
    groups = files.groupBy(*owner).agg(F.count(F.lit(1)).alias("n"), F.min_by("path", F.struct((-F.col("bytes")).alias("b"), "path")).alias("kept"), F.max("bytes").alias("most")).filter("n > 1")
    members = files.join(groups, owner).select("path", "kept", "bytes", "most")
    # hashes alone are compared, line by line at equal places; the text itself only of a copy's last line
    last = lines.groupBy("path").agg(F.max("line_no").alias("__last"))
    ours = lines.join(members.filter("path <> kept").select("path", "kept"), "path").join(last, "path")
    ours = ours.select("path", "kept", "line_no", F.sha1(F.col("value").cast("binary")).alias("__sha"), F.when(F.col("line_no") == F.col("__last"), F.col("value")).alias("__end"))
    tails = ours.filter("__end IS NOT NULL").select("kept", "line_no").distinct()
    theirs = lines.join(members.select(F.col("kept").alias("path")).distinct(), "path").select(F.col("path").alias("kept"), "line_no", F.sha1(F.col("value").cast("binary")).alias("__of"), "value")
    wanted = theirs.join(tails.withColumn("__tail", F.lit(True)), ["kept", "line_no"], "left").select("kept", "line_no", "__of", F.when(F.col("__tail"), F.col("value")).alias("__text"))
    same = F.coalesce(F.col("__sha") == F.col("__of"), F.lit(False)) | F.coalesce(F.startswith(F.col("__text"), F.col("__end")), F.lit(False))
    differ = ours.join(wanted, ["kept", "line_no"], "left").filter(~same).select("path").distinct().withColumn("__differs", F.lit(True))
    judged = members.join(differ, "path", "left")
    worst = F.when(F.col("__differs"), 2).when(F.col("bytes") < F.col("most"), 1).otherwise(0)
    relation = judged.groupBy("kept").agg(F.max(worst).alias("w")).select("kept", F.element_at(F.array(F.lit("identical"), F.lit("prefix"), F.lit("divergent")), F.col("w") + 1).alias("relation"))
    return members.join(relation, "kept").select("path", "kept", "relation", ((F.col("path") != F.col("kept")) & (F.col("relation") != "divergent")).alias("dropped"))
