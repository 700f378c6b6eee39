"""Chat formatting with DataFrame functions only: a finite-state machine over roles and a declarative template.

The template names the control strings, the roles whose text counts for the loss, and the machine's moves. Every turn
becomes  start role sep text end ; control strings (and the escape itself) inside roles and texts are escaped, so that
splitting at control strings gives the turns back exactly. The result keeps, beside the formatted text, its segments
(text, loss) in order; they concatenate to it.

Turn order is judged by folding the roles over the moves: a conversation is valid when no move is missing and the last
state is accepting. Invalid ones are formatted too, and marked.

Defined results: a null text or role is empty; rows with a null conv_id form one conversation; turns are ordered by turn
(null first), then role, then text, and repeated rows all stand; an empty table gives no conversation; other columns
are ignored whatever their names. A conversation is one row of the result and so has to fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATE: dict = {
    "start": "[INST]",
    "sep": "[/INST]",
    "end": "</s>",
    #: further strings that must not stand in a text
    "reserved": ["<s>"],
    "loss_roles": ["assistant"],
    "escape": "~",
    "moves": {
        ("begin", "system"): "system",
        ("begin", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
    "first": "begin",
    "accepting": ["assistant"],
}


def controls(template: dict) -> list[tuple[str, str]]:
    """Control strings and what stands for them in a text: the escape and a digit; 0 is the escape itself."""
    strings = [template["escape"], template["start"], template["sep"], template["end"], *template["reserved"]]
    if len(strings) > 10 or any(c.isdigit() or template["escape"] in s for s in strings[1:] for c in s):
        raise ValueError("at most nine control strings, without digits and without the escape")
    return [(s, f"{template['escape']}{k}") for k, s in enumerate(strings)]


def escape(text: Column, template: dict) -> Column:
    for string, code in controls(template):
        text = F.replace(text, F.lit(string), F.lit(code))
    return text


def unescape(text: Column, template: dict) -> Column:
    for string, code in reversed(controls(template)):
        text = F.replace(text, F.lit(code), F.lit(string))
    return text


def format_chat(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, formatted, segments (array of text, loss), valid, state: one row for each conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), blank("role").alias("role"), blank("text").alias("text"))
    chats = rows.groupBy(F.col("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in template["moves"].items() for x in (f"{state}\n{role}", to)])
    step = lambda state, t: F.coalesce(F.element_at(moves, F.concat(state, F.lit("\n"), t["role"])), F.lit("reject"))
    start, sep, end = (F.lit(template[k]) for k in ("start", "sep", "end"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(start, escape(t["role"], template), sep), F.lit(False)),
                segment(escape(t["text"], template), t["role"].isin(template["loss_roles"])),
                segment(end, F.lit(False)),
            ),
        )
    )
    out = chats.select("conv_id", parts.alias("segments"), F.aggregate("turns", F.lit(template["first"]), step).alias("state"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", F.col("state").isin(template["accepting"]).alias("valid"), "state")


def parse_chat(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Adds turns (array of role, text, loss) read back from the column formatted."""
    quoted = lambda s: "\\Q" + s + "\\E"
    pieces = F.split("formatted", quoted(template["end"]), -1)
    one = lambda p: F.split(F.substr(p, F.lit(len(template["start"]) + 1)), quoted(template["sep"]), 2)
    raw = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), one)
    turns = F.transform(raw, lambda r: F.struct(unescape(r[0], template).alias("role"), unescape(r[1], template).alias("text"), unescape(r[0], template).isin(template["loss_roles"]).alias("loss")))
    return formatted.withColumn("turns", turns)


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = rows.sparkSession.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all conversations formatted, and read back from the formatted text and its segments."""
    chats = parse_chat(format_chat(with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], TEMPLATE)), "")
    return chats.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _sql() -> str:
    escaped = lambda c: "".join("replace(" for _ in controls(TEMPLATE)) + c + "".join(f", '{s}', '{e}')" for s, e in controls(TEMPLATE))
    marks = sum(len(TEMPLATE[k]) for k in ("start", "sep", "end"))
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS size
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(length(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant')), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({marks} + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN k = 1 WHEN 'user' THEN k = 1 OR before IN ('system', 'assistant')
    WHEN 'assistant' THEN before = 'user' AND k > 1 ELSE false END) AND bool_or(k = size AND role = 'assistant') AS valid
FROM n GROUP BY conv_id
"""


SQL = _sql()
