"""Labels of records: an ordered set of role.category.leaf, as one expression over the record's members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.sources.transcripts import blocks, flat_text

#: Labels of line types, of system subtypes and of attachment types.
LINE_TYPES = {
    "last-prompt": "harness.bookkeeping.last-prompt", "mode": "harness.bookkeeping.mode", "permission-mode": "harness.bookkeeping.mode",
    "ai-title": "harness.bookkeeping.name", "agent-name": "harness.bookkeeping.name", "atis-latch": "harness.bookkeeping.atis",
    "bridge-session": "harness.bookkeeping.bridge", "history-suppression": "harness.bookkeeping.suppression", "pr-link": "harness.bookkeeping.pr-link",
    "frame-link": "harness.bookkeeping.artifact", "artifact-comment-monitor": "harness.bookkeeping.artifact", "artifact-autoreact-ledger": "harness.bookkeeping.artifact",
    "file-history-snapshot": "harness.bookkeeping.file-history", "file-history-delta": "harness.bookkeeping.file-history", "cost-state": "harness.bookkeeping.cost",
    "fork-context-ref": "harness.bookkeeping.fork", "continued-in": "harness.bookkeeping.continued",
}
SUBTYPES = {
    "compact_boundary": "harness.compaction.boundary", "turn_duration": "harness.turn.duration", "stop_hook_summary": "harness.turn.stop-hooks", "away_summary": "harness.turn.recap",
    "scheduled_task_fire": "harness.schedule.event", "model_refusal_fallback": "harness.system.refusal", "model_refusal_no_fallback": "harness.system.refusal",
    "api_error": "harness.system.api-error", "informational": "harness.system.notice", "agents_killed": "harness.system.kill", "local_command": "harness.system.command",
}
ATTACHMENTS = {
    "harness.hook.context": ["hook_additional_context"],
    "harness.hook.outcome": ["hook_success", "hook_blocking_error", "hook_non_blocking_error", "hook_cancelled", "hook_stopped_continuation", "hook_system_message", "async_hook_response_batch"],
    "agent.message.structured": ["structured_output"],
    "harness.context.reminder": ["total_tokens_reminder", "task_reminder", "silent_turn_reminder", "batching_reminder_sent", "ultrathink_effort"],
    "harness.context.listing": ["skill_listing", "agent_listing_delta", "deferred_tools_delta", "deferred_tools_record", "dynamic_skill", "invoked_skills", "mcp_instructions_delta"],
    "harness.context.prompt": ["instructions", "date", "session_context", "environment", "model", "prompt_snapshot", "date_change"],
    "harness.context.file": ["file", "edited_text_file", "compact_file_reference", "nested_memory", "plan_file_reference", "read_truncation_notice", "bash_output_audience_note"],
    "harness.context.mode": ["plan_mode", "plan_mode_exit", "plan_mode_reentry", "auto_mode", "command_permissions"],
    "harness.context.ide": ["opened_file_in_ide", "selected_lines_in_ide", "diagnostics"],
    "harness.context.task": ["task_status", "queued_command", "workflow_keyword_request", "goal_status", "remote_session_change", "relevant_memories", "memory_update", "thinking_stripped", "thinking_drop"],
}
#: What a synthesized text begins with.
STARTS = [
    ("<local-command-caveat>", "harness.command.caveat"), ("<local-command-stdout>", "harness.command.stdout"), ("<command-name>", "harness.command.invocation"), ("<command-message>", "harness.command.invocation"),
    ("[Request interrupted by user for tool use]", "harness.interrupt.tool"), ("[Request interrupted by user]", "harness.interrupt.user"), ("<teammate-message", "agent.communication.inbox"),
    ("Continue from where you left off.", "harness.resume.prompt"), ("# Autonomous loop tick", "harness.schedule.tick"), ("Run the autonomous check", "harness.schedule.tick"),
    ("Base directory for this skill:", "harness.context.skill"), ("[Image: ", "harness.context.image"), ("<system-reminder>", "harness.context.reminder"),
]
#: What the harness's own prompts begin with, which are marked as meta.
PROMPTS = [
    ("<<autonomous-loop-dynamic>>", "harness.schedule.wakeup"), ("# Autonomous loop check", "harness.schedule.wakeup"), ("You're being invoked on a timer", "harness.schedule.wakeup"),
    ("Stop hook feedback:", "harness.hook.feedback"), ("TeammateIdle hook feedback:", "harness.hook.feedback"), ("TaskCreated hook feedback:", "harness.hook.feedback"), ("TaskCompleted hook feedback:", "harness.hook.feedback"),
    ("The last Edit failed because the target file was modified", "harness.enforce.retry"), ("[structured-output-enforce]", "harness.enforce.structured-output"),
    ("You ended the turn without calling SendUserMessage.", "harness.enforce.brief"), ("[handback-send-enforce]", "harness.enforce.handback"),
]
#: Whole prompts that have a turn go on.
CLASSIFIER_STOP = "Your response above was stopped by a safety classifier — this is not a tool or API error. The rest of it was withheld, and tool calls in it that had not finished did not run. Do not produce that content again, even reworded."
CONTINUATIONS = [
    "The previous response failed to produce a valid tool call. Please retry the tool call now.",
    "Your tool call was malformed and could not be parsed. Please retry.",
    "[Your previous response had no visible output. Please continue and produce a user-visible response.]",
    "The PermissionDenied hook indicated you may retry this tool call.",
    CLASSIFIER_STOP,
    CLASSIFIER_STOP + ' Exception: a tool call whose result reads "Interrupted" was already running when the response was stopped; it may have partially or fully completed.',
    "Output token limit hit. Resume directly — no apology, no recap of what you were doing. Pick up mid-thought if that is where the cut happened. Break remaining work into smaller pieces.",
    "Your response above was cut off mid-stream. Resume directly from where it stops — no apology, no recap. If none of it survived, answer the request from the start.",
    "Your response above was cut off mid-stream and only your next message is delivered. Write the complete response again from the start — no apology, no mention of the cut-off.",
]
#: Attachments that never become content for the model.
NEVER_DELIVERED = [
    "async_hook_response_batch", "batching_reminder_sent", "command_permissions", "deferred_tools_record", "goal_status", "hook_cancelled", "hook_non_blocking_error", "hook_system_message",
    "prompt_snapshot", "structured_output", "thinking_drop", "thinking_stripped",
]
#: The header of a message that a hook delivers from another session.
CHANNEL = r"^\[\w+-channel v1 "
INVISIBLE = [
    "user.unsent", "user.rewound", "user.queued", "agent.thinking.omitted", "agent.thinking.redacted", "harness.compaction.boundary", "harness.schedule.event", "harness.hook.outcome",
    "harness.turn.duration", "harness.turn.stop-hooks", "harness.turn.recap", "harness.system.refusal", "harness.system.api-error", "harness.system.notice", "harness.system.kill",
]
ANSWERS = ["User has answered your questions", "Your questions have been answered", "The user answered:", "The user responded:"]
REJECTED = "the user said:\n"


def _table(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _attachment(key: Column) -> Column:
    return _table(key, {v: leaf for leaf, values in ATTACHMENTS.items() for v in values})


def with_labels(records: DataFrame) -> DataFrame:
    """Adds blocks, text, labels (in order, without repeats) and opens (whether the record opens a turn)."""
    r = F.col("r")
    rows = records.withColumn("blocks", blocks(r["message"]["content"])).withColumn("text", F.coalesce(flat_text(F.col("blocks")), F.lit("")))
    text = F.ltrim("text")
    meta, summary = F.coalesce(r["isMeta"], F.lit(False)), F.coalesce(r["isCompactSummary"], F.lit(False))
    own = F.coalesce(*[F.when(text.startswith(s), F.lit(leaf)) for s, leaf in PROMPTS], F.when(text.isin(CONTINUATIONS), F.lit("harness.enforce.retry")))
    start = F.coalesce(F.when(meta, own), *[F.when(text.startswith(s), F.lit(leaf)) for s, leaf in STARTS])
    note = F.regexp_extract(text, "<summary>\\s*(\\w+)", 1)
    pulse = F.when(text.startswith("<task-notification>"), F.coalesce(_table(F.lower(note), {"workflow": "harness.notification.workflow", "monitor": "harness.notification.monitor", "agent": "harness.notification.subagent", "background": "harness.notification.background-command"}), F.lit("harness.notification.task")))
    has = lambda kind: F.coalesce(F.exists("blocks", lambda b: b["type"] == kind), F.lit(False))
    result = F.coalesce(F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "tool_result"), lambda b: F.coalesce(b["content"], F.lit(""))), "\n"), F.lit(""))
    failed = F.coalesce(F.exists("blocks", lambda b: b["is_error"]), F.lit(False))
    answered = has("tool_result") & (F.coalesce(*[F.when(F.ltrim(result).startswith(a), True) for a in ANSWERS], F.lit(False)) | F.coalesce(F.get_json_object(r["toolUseResult"], "$.answers").isNotNull(), F.lit(False)))
    rejected = has("tool_result") & failed & (F.contains(result, F.lit(REJECTED)) | F.contains(result, F.lit("the user said:\\n")))
    when = lambda c, leaf: F.when(c, F.lit(leaf))
    typed = ~has("tool_result") & (text != "") & start.isNull() & pulse.isNull() & ~meta & ~summary
    user = F.array(
        when(summary, "harness.compaction.summary"), when(answered, "user.answer"), when(rejected, "user.rejection"), when(has("tool_result"), "agent.tool.result"),
        F.when(~summary, F.coalesce(start, pulse)), when(typed, "user.message"),
    )
    per_block = F.transform(
        "blocks",
        lambda b: F.when((b["type"] == "text") & (r["message"]["model"] == "<synthetic>") & (b["text"] == "No response requested."), "harness.resume.placeholder")
        .when(b["type"].isin("text", "fallback"), "agent.message.plain")
        .when((b["type"] == "thinking") & (F.coalesce(b["thinking"], F.lit("")) == ""), "agent.thinking.omitted")
        .when((b["type"] == "thinking") & F.contains(F.coalesce(F.decode(F.try_to_binary(b["signature"], F.lit("base64")), "ISO-8859-1"), F.lit("")), F.lit("narration")), "agent.thinking.narration")
        .when(b["type"] == "thinking", "agent.thinking.summary")
        .when(b["type"] == "redacted_thinking", "agent.thinking.redacted")
        .when((b["type"] == "tool_use") & (b["name"] == "SendMessage") & F.coalesce(F.get_json_object(b["input"], "$.type").isNotNull(), F.lit(False)), "agent.communication.signal")
        .when((b["type"] == "tool_use") & b["name"].isin("SendMessage", "Task", "Agent"), "agent.communication.sent")
        .when(b["type"] == "tool_use", "agent.tool.use"),
    )
    calls = F.coalesce(F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: F.lit("agent.tool.use")), F.array().cast("array<string>"))
    queue = F.when((r["type"] == "queue-operation") & r["content"].isNotNull() & (r["operation"] == "enqueue"), F.lit("user.queued")).when(r["type"] == "queue-operation", F.lit("harness.bookkeeping.queue"))
    labels = (
        F.when(r["type"] == "user", user)
        .when(r["type"] == "assistant", F.concat(F.coalesce(per_block, F.array().cast("array<string>")), calls))
        .when(r["type"] == "system", F.array(_table(r["subtype"], SUBTYPES)))
        .when(r["type"] == "attachment", F.array(F.when(channel_text(r).isNotNull(), F.lit("agent.communication.channel")), _attachment(F.get_json_object(r["attachment"], "$.type"))))
        .otherwise(F.array(F.coalesce(queue, _table(r["type"], LINE_TYPES))))
    )
    rows = rows.withColumn("labels", F.array_distinct(F.filter(labels, lambda x: x.isNotNull())))
    opens = F.exists("labels", lambda x: x.isin("user.message", "user.answer", "user.rejection", "agent.communication.inbox")) & (r["type"] == "user")
    return rows.withColumn("opens", F.coalesce(opens, F.lit(False)))


def channel_text(r: Column) -> Column:
    """What another session's message says, header included, of an attachment that a hook delivered; null for all else."""
    content = lambda p: F.get_json_object(r["attachment"], p)
    first = F.when(content("$.content").rlike(r"^\s*\["), content("$.content[0]")).otherwise(content("$.content"))
    return F.when((content("$.type") == "hook_additional_context") & first.rlike(CHANNEL), first)


def with_fires(labelled: DataFrame) -> DataFrame:
    """Adds harness.schedule.fire: to a meta prompt without a label whose parent is a scheduled task's fire, unless it came
    from elsewhere. Only uuids and line numbers meet; what is labelled so opens no turn."""
    fires = labelled.filter((F.col("r.type") == "system") & (F.col("r.subtype") == "scheduled_task_fire") & F.col("r.uuid").isNotNull()).select("session_id", F.col("r.uuid").alias("parent")).distinct()
    prompts = labelled.filter((F.col("r.type") == "user") & F.col("r.isMeta") & (F.size("labels") == 0) & F.get_json_object("value", "$.origin").isNull() & ~F.ltrim("text").rlike("^<(teammate|agent|cross-session)-message"))
    found = prompts.select("session_id", "line_no", F.col("r.parentUuid").alias("parent")).join(fires, ["session_id", "parent"]).select("session_id", "line_no", F.lit(True).alias("__fired"))
    return labelled.join(found, ["session_id", "line_no"], "left").withColumn("labels", F.when(F.col("__fired"), F.array(F.lit("harness.schedule.fire"))).otherwise(F.col("labels"))).drop("__fired")


def visible(label: Column) -> Column:
    """Whether the model receives what has this label, by default."""
    return ~(label.isin(INVISIBLE) | label.startswith("harness.bookkeeping."))


def delivered(r: Column) -> Column:
    """A record's own word on whether the model received it; null where the label decides."""
    kind = F.get_json_object(r["attachment"], "$.type")
    attached = F.when(kind.isin(NEVER_DELIVERED), False).when(kind == "hook_success", r["rendered"].isNotNull())
    return F.when(r["type"] == "attachment", attached).when((r["type"] == "system") & (r["subtype"] == "local_command"), True).when(r["isVirtual"], False).when((r["type"] == "assistant") & r["isApiErrorMessage"] & (r["message"]["model"] == "<synthetic>"), False)


def bridge(labelled: DataFrame) -> DataFrame:
    """One row for each record and label: session_id, line_no, label, visible."""
    seen = F.coalesce(delivered(F.col("r")), visible(F.col("label")))
    return labelled.withColumn("label", F.explode("labels")).select("session_id", "line_no", "label", seen.alias("visible"))


def calls(labelled: DataFrame) -> DataFrame:
    """Tool calls: session_id, line_no, call_id, name, input."""
    return labelled.select("session_id", "line_no", F.explode(F.filter("blocks", lambda b: b["type"] == "tool_use")).alias("b")).select("session_id", "line_no", F.col("b.id").alias("call_id"), F.col("b.name").alias("name"), F.col("b.input").alias("input"))


def results(labelled: DataFrame) -> DataFrame:
    """Tool results: session_id, line_no, call_id, failed, content, and the carrier's own structured result."""
    return labelled.select("session_id", "line_no", F.col("r.toolUseResult").alias("result"), F.explode(F.filter("blocks", lambda b: b["type"] == "tool_result")).alias("b")).select("session_id", "line_no", F.col("b.tool_use_id").alias("call_id"), F.coalesce("b.is_error", F.lit(False)).alias("failed"), F.col("b.content").alias("content"), "result")
