"""Session transcripts of two record shapes as events, interactions and usage.

Both shapes become the same blocks; everything behind that is shared.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from snagline.functions.exprs import exit_code
from snagline.operators.sessions import sticky
from snagline.sources.files import transcript_records

#: What stands for an interrupt (alone), and for a rejected call (anywhere).
INTERRUPT = "[Request interrupted by user]"
REJECTIONS = (
    "[Request interrupted by user for tool use]",
    "The user doesn't want to proceed with this tool use",
    "The user doesn't want to take this action",
    "tool call was rejected",
    "tool call rejected",
    "command was rejected",
    "approval denied",
    "user denied",
    "rejected by user",
)
READ_TOOLS = ("Read", "read_file", "view")
#: Tools that ask the human, how history that is quoted begins, and what a harness adds to a goal.
QUESTION_TOOLS = ("AskUserQuestion", "ask_user_question", "ask_user", "request_user_input", "user_input")
QUOTED = (
    "<user_instructions>", "<environment_context>", "<turn_context>", "<app_context>", "<command-name>", "<command-message>", "<command-args>",
    "<local-command-stdout>", "<local-command-stderr>", "Caveat:",
)
GOAL = r"(?i)^\s*<codex_internal_context\s+source\s*=\s*(['\"])goal\1\s*>"
#: Events of the second shape that end a turn, and that report a rejected call.
DONE = ("task_complete", "turn_complete", "task_finished")
REJECTED = ("tool_call_rejected", "tool_rejected", "approval_rejected")
_BLOCK = (
    "shape string, path string, line long, place int, session_id string, ts string, cwd string, role string, block_type string, text string, tool_use_id string,"
    " tool string, command string, file_path string, is_error boolean, sidechain boolean, meta boolean, message_id string"
)


def is_interrupt(text: Column) -> Column:
    return text == INTERRUPT


def is_rejection(text: Column) -> Column:
    found = F.lit(False)
    for sentinel in REJECTIONS:
        found = found | F.contains(text, F.lit(sentinel))
    return found


def source_kinds(lines: DataFrame, first: int = 1_000) -> DataFrame:
    """(path, source): by a fragment of the path, else by the records among a file's first lines."""
    kind = F.try_variant_get(F.try_parse_json("text"), "$.type", "string")
    b = kind.isin("session_meta", "event_msg", "response_item")
    a = kind.isin("user", "assistant", "attachment")
    by = lines.groupBy("path").agg(F.bool_or(b & (F.col("line") < first)).alias("b"), F.bool_or(a & (F.col("line") < first)).alias("a"))
    source = F.when(F.contains("path", F.lit("/.claude/")), "a").when(F.contains("path", F.lit("/.codex/")), "b")
    return by.select("path", F.coalesce(source, F.when(F.coalesce("b", F.lit(False)), "b").when(F.coalesce("a", F.lit(False)), "a"), F.lit("generic")).alias("source"))


_KEYS = ("text", "message", "content", "output", "stderr", "stdout")


def _walk(node) -> Iterator[str]:
    if isinstance(node, str):
        yield node
    elif isinstance(node, list):
        for x in node:
            yield from _walk(x)
    elif isinstance(node, dict):
        for key in _KEYS:
            yield from _walk(node.get(key))


@pandas_udf(StringType())
def text_within(record: pd.Series) -> pd.Series:
    """All texts below the telling keys of a JSON record, in order; null for none."""

    def texts(x: str | None) -> str | None:
        try:
            return "\n".join(_walk(json.loads(x))) or None
        except (TypeError, ValueError, RecursionError):
            return None

    return record.map(texts)


#: Lines that a task has on average, at most.
TASK_LINES = 50_000
#: Up to so many partitions Spark shuffles rows without holding them in memory (spark.shuffle.sort.bypassMergeThreshold).
UNHELD_PARTS = 200


def parts_of(lines: DataFrame, task_lines: int = TASK_LINES) -> int:
    """Tasks to deal lines and what is made of them to: as many as their number asks for, all shuffle partitions at least.

    Lines are counted, not parsed.  Beyond UNHELD_PARTS the tasks that deal would
    hold what they deal, so their number does not follow the lines further.
    """
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(UNHELD_PARTS, -(-lines.count() // task_lines)))


def dealt(rows: DataFrame, by: str, parts: int | None = None) -> DataFrame:
    """Rows dealt by a key over so many partitions, all shuffle partitions by default, which are not put together again.

    Partitions are otherwise put together by their bytes as they travel, and
    records, which repeat each other, are many times larger in the sorts of a task.
    """
    return rows.repartition(parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def _shaped(rows: DataFrame, shape: str) -> DataFrame:
    """Blocks with every column in its type, null where rows have none."""
    rows = rows.withColumn("shape", F.lit(shape))
    fields = [x.split() for x in _BLOCK.split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def _sticky_context(records: DataFrame, parts: int | None = None) -> DataFrame:
    """Session and folder carried forward over all records of a file; a file that names no session is one."""
    so_far = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    carried = {c: F.last(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(so_far) for c in ("session_id", "cwd")}
    return dealt(records, "path", parts).withColumns(carried).withColumn("session_id", F.coalesce("session_id", "path"))


def _get(of: str):
    return lambda p, t="string": F.try_variant_get(of, p, t)


def _joined(items: Column, field: str, by: str) -> Column:
    """A field of each object in a list that has it as a string."""
    return F.array_join(F.array_compact(F.transform(items, lambda x: F.try_variant_get(x, f"$.{field}", "string"))), by)


def queued_words(records: DataFrame) -> DataFrame:
    """Records with `queued`: (text, source, delivery) of words that a human had delivered while a turn ran, null for others."""
    get = _get("record")
    at = lambda p, t="string": get(f"$.attachment.{p}", t)
    on = (F.col("record_type") == "attachment") & (at("type") == "queued_command") & at("humanTurn", "boolean") & (at("origin.kind") == "human") & ~F.col("meta")
    on = on & (F.coalesce(at("commandMode"), F.lit("prompt")) == "prompt") & (F.trim(at("prompt")) != "") & (at("source_uuid") != "") & (at("delivery_id") != "")
    words = F.struct(at("prompt").alias("text"), at("source_uuid").alias("source"), at("delivery_id").alias("delivery"))
    return records.withColumn("queued", F.when(F.coalesce(on, F.lit(False)), words))


def _queued(records: DataFrame) -> DataFrame:
    """Queued words as blocks, once each: by their source and by their delivery."""
    said = queued_words(records).where("queued is not null").select("path", "line", "session_id", "ts", "cwd", "sidechain", "meta", "queued.*")
    seen = {c: F.row_number().over(Window.partitionBy("session_id", c).orderBy("line")) for c in ("source", "delivery")}
    return said.withColumns({f"n_{c}": n for c, n in seen.items()}).where("n_source = 1 and n_delivery = 1").select(
        "*", F.lit(0).alias("place"), F.lit("user").alias("role"), F.lit("text").alias("block_type"), F.col("source").alias("message_id")
    )


def records_a(lines: DataFrame) -> DataFrame:
    """Records of the first shape with what they say of themselves."""
    get = _get("record")
    return transcript_records(lines).select(
        "path", "line", "record_type", "record", F.coalesce(get("$.sessionId"), get("$.session_id")).alias("session_id"), get("$.cwd").alias("cwd"),
        F.coalesce(get("$.timestamp"), get("$.message.timestamp")).alias("ts"), F.coalesce(get("$.isSidechain", "boolean"), F.lit(False)).alias("sidechain"),
        F.coalesce(get("$.isMeta", "boolean"), F.lit(False)).alias("meta"),
    )


def message_blocks(records: DataFrame, *more: str) -> DataFrame:
    """A row for each block of a record's message, one of no type for a record without; more names further columns that stay."""
    get = _get("record")
    said = F.col("record_type").isin("user", "assistant")
    content = F.when(said, get("$.message.content", "array<variant>"))
    # a list would be cast to its JSON
    plain = F.when(content.isNull() & (F.col("record_type") == "user"), get("$.message.content"))
    rows = records.select(
        "path", "line", "session_id", "ts", "cwd", "sidechain", "meta", F.col("record_type").alias("role"), plain.alias("plain"), *more,
        F.coalesce(get("$.message.id"), get("$.uuid")).alias("message_id"), F.posexplode_outer(content).alias("place", "block"),
    )
    block = _get("block")
    kind = F.coalesce(block("$.type"), F.when(F.col("plain").isNotNull(), "text"))
    questions = F.nullif(_joined(block("$.input.questions", "array<variant>"), "question", "\n"), F.lit(""))
    asked = F.coalesce(questions, *[block(f"$.input.{k}") for k in ("question", "query", "prompt", "message")])
    answer = block("$.content", "array<variant>")
    result = F.when(answer.isNotNull(), _joined(F.filter(answer, lambda x: F.try_variant_get(x, "$.type", "string") == "text"), "text", "\n")).otherwise(block("$.content"))
    return rows.select(
        "path", "line", F.coalesce("place", F.lit(0)).alias("place"), "session_id", "ts", "cwd", "role", kind.alias("block_type"), "sidechain", "meta", *more,
        F.when(F.col("role") == "assistant", F.col("message_id")).alias("message_id"),
        F.when(kind == "tool_result", result).when(kind == "tool_use", asked).otherwise(F.coalesce(block("$.text"), F.col("plain"))).alias("text"),
        F.coalesce(block("$.id"), block("$.tool_use_id")).alias("tool_use_id"), block("$.name").alias("tool"), block("$.input.command").alias("command"),
        block("$.input.file_path").alias("file_path"), block("$.is_error", "boolean").alias("is_error"),
    )


def blocks_a(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """Blocks of records with a message of blocks, and words that were queued.

    Session and folder are carried forward over all records of a file.  Records
    of the harness (meta) and of delegated work (sidechain) are marked.  Large
    inputs take the tasks of parts_of(lines), here and in what is made of them.
    """
    records = _sticky_context(records_a(lines), parts)
    return _shaped(message_blocks(records).where("block_type is not null"), "a").unionByName(_shaped(_queued(records), "a"))


def blocks_b(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """Blocks of records whose payload is a message, a call, its output, or an event that ends a turn."""
    get, at = _get("record"), lambda p, t="string": F.try_variant_get("record", f"$.payload.{p}", t)
    side = F.lit(False)
    for flag in (get("$.isSidechain", "boolean"), get("$.sidechain", "boolean"), at("is_sidechain", "boolean"), at("sidechain", "boolean")):
        side = side | F.coalesce(flag, F.lit(False))
    named = F.when(F.col("record_type") == "session_meta", at("id"))
    records = transcript_records(lines).select(
        "path", "line", "record_type", "record", F.coalesce(get("$.sessionId"), get("$.session_id"), at("session_id"), named).alias("session_id"),
        F.coalesce(get("$.cwd"), at("cwd")).alias("cwd"), F.coalesce(get("$.timestamp"), at("timestamp")).alias("ts"), side.alias("sidechain"),
    )
    inner = F.coalesce(at("type"), F.lit(""))
    arguments = F.try_parse_json(F.coalesce(at("arguments"), at("input")))
    asked = lambda p: F.coalesce(F.try_variant_get(arguments, p, "string"), F.try_variant_get("record", f"$.payload.arguments{p[1:]}", "string"))
    said = F.coalesce(at("message"), at("reason"), at("text"), at("output"))
    event = F.when(inner == "turn_aborted", "aborted").when(inner.isin(*DONE), "done").when(inner.isin(*REJECTED), "rejected").when(
        (inner == "user_message") & is_interrupt(F.trim(said)), "interrupted"
    )
    item = F.when(inner == "message", "text").when(inner.isin("function_call", "custom_tool_call"), "tool_use").when(inner.isin("function_call_output", "custom_tool_call_output"), "tool_result")
    block = F.when(F.col("record_type") == "response_item", item).when(F.col("record_type") == "event_msg", event)
    tool = F.substring_index(at("name"), ".", -1)
    texts = F.transform(at("content", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string"))
    own = F.when(inner == "message", F.coalesce(texts, F.array(at("content")))).when(item == "tool_use", F.array(F.coalesce(asked("$.question"), at("input"), at("arguments"))))
    own = F.coalesce(own.otherwise(F.array(F.coalesce(at("output"), said))), F.array(F.lit(None).cast("string")))
    rows = _sticky_context(records, parts).withColumn("block_type", block).where("block_type is not null")
    rows = rows.select(
        "path", "line", "session_id", "ts", "cwd", "sidechain", "block_type", F.when(F.col("block_type") == "text", at("role")).alias("role"), F.posexplode(own).alias("place", "text"),
        F.coalesce(at("call_id"), F.when(item.isin("tool_use", "tool_result"), at("id"))).alias("tool_use_id"), F.when(item == "tool_use", tool).alias("tool"),
        F.when(item == "tool_use", asked("$.command")).alias("command"), F.when(item == "tool_use", asked("$.file_path")).alias("file_path"),
        F.when(inner == "message", F.coalesce(at("id"), at("message_id"), at("response_id"))).alias("message_id"),
    )
    goal = (F.col("role") == "user") & F.col("text").rlike(GOAL)
    return _shaped(rows.withColumn("meta", F.coalesce(goal, F.lit(False))), "b")


def _at() -> Column:
    return F.struct("line", "place")


def said_by_human() -> Column:
    """A human's words that are neither blank nor a sentinel nor the harness's."""
    return (F.col("block_type") == "text") & (F.col("role") == "user") & (F.trim("text") != "") & ~F.col("meta") & ~stopped() & ~refused()


def stopped() -> Column:
    own = (F.col("block_type") == "text") & (F.col("role") == "user") & is_interrupt(F.trim("text"))
    return F.coalesce(own, F.lit(False)) | F.col("block_type").isin("aborted", "interrupted")


def refused() -> Column:
    """Words or results that say a call was rejected."""
    sentinel = is_rejection(F.coalesce("text", F.lit("")))
    words = (F.col("block_type") == "text") & (F.col("role") == "user") & (F.col("shape") == "a")
    return F.coalesce((words | (F.col("block_type") == "tool_result")) & sentinel, F.lit(False)) | (F.col("block_type") == "rejected")


def events_of(blocks: DataFrame, parts: int | None = None) -> DataFrame:
    """Events of a session: runs with their exit code, tool errors, rejections, interrupts, reads, corrections and other turns.

    A run stands where it was called and takes the first result behind it; one
    without a result has no exit code.  Rejections and errors stand where they
    were reported, with or without their call.  A human's first words after an
    interrupt (in the first shape also after a rejection) are a correction unless
    the agent acted in between: read a file, ended a run, failed; in the second
    shape called or said anything.

    Returns path, session_id, line, place, ts, cwd, sidechain, kind, tool, command, exit_code, file_path, text.
    """
    by_call = Window.partitionBy("session_id", "tool_use_id").orderBy(_at())
    call, result = F.col("block_type") == "tool_use", F.col("block_type") == "tool_result"
    known = F.col("tool_use_id").isNotNull()
    own = F.struct("path", "line", "place", "ts", "cwd", "sidechain", "tool", "command", "file_path")
    rows = dealt(blocks, "session_id", parts).withColumn("refused", refused()).withColumn("stopped", stopped()).withColumn("said", said_by_human())
    earlier = by_call.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("asked", F.when(known & result, F.last(F.when(call, own), ignorenulls=True).over(earlier)))
    # a call is taken by the result behind it; a later one of the same id has none
    latest = F.last(F.when(call | result, F.col("block_type")), ignorenulls=True).over(earlier)
    following = F.last(F.when(call | result, F.col("block_type")), ignorenulls=True).over(Window.partitionBy("session_id", "tool_use_id").orderBy(F.desc("line"), F.desc("place")).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("asked", F.when(latest == "tool_use", F.col("asked"))).withColumn("answered", known & (following == "tool_result"))
    ran = F.col("asked.command").isNotNull()
    code = exit_code(F.col("text"))
    run = lambda c: F.when(c == 0, "run_succeeded").when(c.isNotNull(), "run_failed").otherwise("run")
    failed = F.coalesce("is_error", F.lit(False))
    here = lambda kind, **more: F.struct(
        *[F.col(c) for c in ("path", "line", "place", "ts", "cwd", "sidechain")], kind.alias("kind"),
        *[more.get(c, F.lit(None).cast(t)).alias(c) for c, t in (("tool", "string"), ("command", "string"), ("exit_code", "int"), ("file_path", "string"))], F.col("text").alias("text"),
    )
    there = F.struct(
        *[F.col(f"asked.{c}") for c in ("path", "line", "place", "ts", "cwd", "sidechain")], run(code).alias("kind"), F.col("asked.tool").alias("tool"),
        F.col("asked.command").alias("command"), code.alias("exit_code"), F.col("asked.file_path").alias("file_path"), F.col("text").alias("text"),
    )
    reads = call & F.col("tool").isin(*READ_TOOLS) & F.col("file_path").isNotNull()
    pending = call & F.col("command").isNotNull() & ~F.coalesce("answered", F.lit(False))
    marker = F.col("stopped") | (F.col("refused") & (F.col("shape") == "a"))
    acted_a = reads | (result & ~F.col("refused") & (ran | failed)) | (pending & ~known)
    acted = F.when(F.col("shape") == "a", F.coalesce(acted_a, F.lit(False))).otherwise(call | ((F.col("block_type") == "text") & F.coalesce(F.col("role") == "assistant", F.lit(False))))
    step = F.when(marker, "marker").when(acted, "action").when(F.col("said"), "turn")
    before = F.last(step, ignorenulls=True).over(Window.partitionBy("session_id").orderBy(_at()).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("corrects", F.col("said") & F.coalesce(before == "marker", F.lit(False)))
    tool = F.coalesce("asked.tool", "tool")
    found = F.array_compact(F.array(
        F.when(F.col("stopped"), here(F.lit("interrupt"))), F.when(F.col("refused"), here(F.lit("tool_rejected"), tool=tool)),
        F.when(F.col("said"), here(F.when(F.col("corrects"), "user_turn_after_correction").otherwise("turn"))),
        F.when(reads, here(F.lit("file_read"), tool=F.col("tool"), file_path=F.col("file_path"))),
        F.when(pending, here(F.lit("run"), tool=F.col("tool"), command=F.col("command"))),
        F.when(result & ~F.col("refused") & ran, there), F.when(result & ~F.col("refused") & ~ran & failed, here(F.lit("tool_error"), tool=tool)),
    ))
    each = rows.select("session_id", F.explode(found).alias("e"))
    return each.select("e.path", "session_id", "e.line", "e.place", "e.ts", "e.cwd", "e.sidechain", "e.kind", "e.tool", "e.command", "e.exit_code", "e.file_path", "e.text")


def interactions_of(blocks: DataFrame, cap: int = 1_000, parts: int | None = None) -> DataFrame:
    """Interactions in order, numbered, up to a cap for each session.

    A message that is streamed again, in a later record or word for word in the
    same one, counts once.  Human requests number the turns of their thread;
    delegated work (sidechain) is a thread of its own.  A question is answered by
    its result, or by the next words of the human in its thread.  The last reply
    of the agent in a turn has how the turn ended: interrupted, completed where
    the source says so, else unknown.

    Returns session_key, ordinal, line, ts, origin, sidechain, turn_id, tool_use_id, message_id, question_ordinal,
    call_ordinal, terminal_state, text.
    """
    kind, words = F.col("block_type"), F.coalesce("text", F.lit(""))
    session, thread = Window.partitionBy("session_id"), Window.partitionBy("session_id", "sidechain")
    human = (kind == "text") & (F.col("role") == "user")
    asks = F.coalesce(F.col("tool").isin(*QUESTION_TOOLS), F.lit(False))
    quoted = F.lit(False)
    for head in QUOTED:
        quoted = quoted | F.startswith(F.ltrim(words), F.lit(head))
    rows = dealt(blocks, "session_id", parts).withColumn("stopped", stopped() & (kind != "interrupted")).withColumn("refused", refused() & human)
    origin = (
        F.when((kind == "text") & (F.trim(words) == ""), None)
        .when(kind == "aborted", "harness")
        .when((kind == "tool_use") & asks, "question")
        .when(kind == "tool_use", "tool_call")
        .when(kind == "tool_result", "tool_result")
        .when((kind == "text") & (F.col("role") == "assistant"), "assistant_text")
        .when(human & (F.col("meta") | F.col("stopped") | F.col("refused")), "harness")
        .when(human & quoted, "quoted_history")
        .when(human, "human")
        .when(kind == "text", "harness")
    )
    first = F.min("line").over(Window.partitionBy("session_id", "message_id"))
    again = F.row_number().over(Window.partitionBy("session_id", "line", "origin", "tool_use_id", "text").orderBy("place"))
    rows = rows.withColumn("origin", origin).withColumn("first", first).withColumn("again", again)
    once = F.col("message_id").isNull() | (F.col("role") == "user") | (F.col("first") == F.col("line"))
    rows = rows.where((once & (F.col("again") == 1) & F.col("origin").isNotNull()) | (kind == "done"))
    so_far = session.orderBy(_at()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ordinal", F.sum(F.col("origin").isNotNull().cast("long")).over(so_far) - 1)
    # calls and results meet on their id, a question is answered by its first result
    by_call = Window.partitionBy("session_id", "tool_use_id")
    calls, result = F.col("origin").isin("question", "tool_call"), F.col("origin") == "tool_result"
    before = by_call.orderBy(_at()).rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(calls, F.struct("ordinal", "origin")), ignorenulls=True).over(before)
    earlier = F.coalesce(F.last(F.when(result | calls, F.col("origin")), ignorenulls=True).over(before) == "tool_result", F.lit(False))
    answered = F.min(F.when(result, _at())).over(by_call)
    known = F.col("tool_use_id").isNotNull()
    rows = rows.withColumn("call", F.when(known & result & ~earlier, asked)).withColumn("answered", F.when(known & (F.col("origin") == "question"), answered))
    past = thread.orderBy(_at()).rowsBetween(Window.unboundedPreceding, -1)
    pending = F.last(F.when(F.col("origin") == "question", F.struct("ordinal", _at().alias("at"), "answered")), ignorenulls=True).over(past)
    settled = F.max(F.when((F.col("origin") == "human") | F.col("stopped"), _at())).over(past)
    rows = rows.withColumn("pending", pending).withColumn("settled", settled)
    waits = F.col("pending").isNotNull() & (F.col("settled").isNull() | (F.col("settled") < F.col("pending.at"))) & (F.col("pending.answered").isNull() | (F.col("pending.answered") > _at()))
    by_result = result & (F.col("call.origin") == "question")
    question = F.when((F.col("origin") == "human") & waits, F.col("pending.ordinal")).when(by_result, F.col("call.ordinal"))
    rows = rows.withColumn("question_ordinal", question)
    origin = F.when(F.col("question_ordinal").isNotNull(), "human_answer").when(F.col("origin") == "human", "human_request").otherwise(F.col("origin"))
    rows = rows.withColumn("call_ordinal", F.when(result & ~F.coalesce(by_result, F.lit(False)), F.col("call.ordinal"))).withColumn("origin", origin)
    request = F.col("origin") == "human_request"
    turn = F.sum(F.coalesce(request, F.lit(False)).cast("long")).over(thread.orderBy(_at()).rowsBetween(Window.unboundedPreceding, 0))
    ends = F.when(F.col("stopped"), "interrupted").when(request, "unknown").when(kind == "done", "completed").when(F.col("origin") == "assistant_text", "none")
    next_end = F.last(ends, ignorenulls=True).over(thread.orderBy(F.desc("line"), F.desc("place")).rowsBetween(Window.unboundedPreceding, -1))
    state = F.when(F.col("origin") == "assistant_text", F.coalesce(next_end, F.lit("unknown"))).when(F.col("stopped"), "interrupted").otherwise("none")
    rows = rows.withColumn("turn_id", F.nullif(turn, F.lit(0))).withColumn("terminal_state", state).where(F.col("origin").isNotNull() & (F.col("ordinal") < cap))
    text = F.when(F.col("origin") == "tool_call", F.coalesce("command", "file_path", "text", F.lit(""))).otherwise(F.coalesce("text", F.lit("")))
    return rows.select(
        F.col("session_id").alias("session_key"), "ordinal", "line", "ts", "origin", "sidechain", "turn_id", "tool_use_id", "message_id", "question_ordinal", "call_ordinal", "terminal_state", text.alias("text")
    )


def completed_from_history(interactions: DataFrame, completed: DataFrame) -> DataFrame:
    """Unknown replies whose (session_id, message_id) the history has as completed become so; other states stay."""
    done = completed.select("session_id", "message_id").distinct().withColumn("done", F.lit(True))
    rows = interactions.join(done, ["session_id", "message_id"], "left")
    up = (F.col("terminal_state") == "unknown") & F.coalesce("done", F.lit(False))
    return rows.withColumn("history_confirmed", up).withColumn("terminal_state", F.when(up, "completed").otherwise(F.col("terminal_state"))).drop("done")


def completed_pairs(turns: DataFrame, items: DataFrame) -> DataFrame:
    """(session_id, message_id) of completed turns, out of a history of turns and their items."""
    done = turns.where("status = 'completed'").select("turn_id", "session_id")
    return done.join(items.where("message_id is not null").select("turn_id", "message_id"), "turn_id").select("session_id", "message_id").distinct()


def usage_of(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """Tokens per session: of each message the largest of its counters, then their sum; the last model.

    A message is streamed in several records, each with its counters so far.
    """
    records = transcript_records(lines)
    get = lambda p, t="string": F.try_variant_get("record", f"$.message.{p}", t)
    rows = records.select(
        "path", "line", F.try_variant_get("record", "$.sessionId", "string").alias("session_id"), get("id").alias("message_id"), get("model").alias("model"),
        *[get(f"usage.{c}", "long").alias(c) for c in ("input_tokens", "output_tokens")],
    )
    rows = sticky(dealt(rows.withColumnRenamed("session_id", "sid").withColumnRenamed("path", "session_id"), "session_id", parts), "sid", "line").where("message_id is not null")
    by = rows.groupBy(F.coalesce("sid", "session_id").alias("session"), "message_id").agg(
        F.max("input_tokens").alias("input_tokens"), F.max("output_tokens").alias("output_tokens"), F.max_by("model", "line").alias("model"), F.max("line").alias("line")
    )
    return by.groupBy(F.col("session").alias("session_id")).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.max_by("model", "line").alias("model"), F.count("*").alias("messages")
    )


def fallback_observations(event: DataFrame, cutoff: str | None = None, cap: int = 1_000) -> DataFrame:
    """Observations of events of no known shape: not blank, from the cutoff on, the first of each session up to a cap."""
    rows = event.where(F.trim("text") != "")
    rows = rows.where(F.col("ts_utc") >= F.lit(cutoff).cast("timestamp")) if cutoff else rows
    first = F.row_number().over(Window.partitionBy("session_key").orderBy("source_line", "event_index"))
    kind = F.when(F.col("kind") == "file_read", "file_read").otherwise("session_activity")
    rows = rows.withColumn("n", first).where(F.col("n") <= cap).withColumn("kind", kind)
    return rows.withColumn("path", F.when(F.col("kind") == "file_read", F.col("text"))).withColumn("n", F.col("n").cast("long"))


def discovery_queue(sources: DataFrame, limit: int) -> DataFrame:
    """Sources to visit: of each pattern the least attempted, then newest, then by path; the patterns in turn."""
    own = Window.partitionBy("pattern").orderBy("attempted", F.desc("modified"), "path")
    rows = sources.where("not done").withColumn("round", F.row_number().over(own).cast("long"))
    return rows.orderBy("round", "pattern").limit(limit)
