"""Transcripts as a stream: events as soon as their records are there.

Records are read in the JVM; what a file's later records depend on is state of
that file: its session and folder, whether a correction is awaited, calls
without a result, and queued words that were seen.  A file that comes in pieces
gives the events of the whole file, whatever the cuts.  The state store must be
RocksDB's (STATE_STORE).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from snagline.functions.exprs import exit_code
from snagline.sources import transcripts as T

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Text of a line that says that a file is settled; its open calls are then runs without exit code.
SETTLED = '{"type":"settled-file"}'
_CALL = "line long, place int, ts string, cwd string, sidechain boolean, tool string, command string, file_path string"
EVENTS = "path string, session_id string, line long, place int, ts string, cwd string, sidechain boolean, kind string, tool string, command string, exit_code int, file_path string, text string"
_NAMES = [x.split()[0] for x in EVENTS.split(", ")]
_CALL_NAMES = [x.split()[0] for x in _CALL.split(", ")]


def coded_rows(lines: DataFrame) -> DataFrame:
    """Rows of lines (path, line, text) with what the state machine asks: a row for each block, one for a record without."""
    records = T.queued_words(T.records_a(lines))
    rows = T.message_blocks(records, "queued").withColumn("shape", F.lit("a"))
    words = F.col("queued").isNotNull()
    rows = rows.withColumns({
        "block_type": F.when(words, "text").otherwise(F.col("block_type")), "role": F.when(words, "user").otherwise(F.col("role")), "text": F.coalesce("queued.text", "text"),
    })
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        "path", "line", "place", "session_id", "ts", "cwd", "sidechain", F.coalesce("block_type", F.lit("")).alias("block"), "text", "tool_use_id", "tool", "command", "file_path",
        flag(F.col("is_error")).alias("is_error"), flag(T.refused()).alias("refused"), flag(T.stopped()).alias("stopped"), flag(T.said_by_human()).alias("said"), exit_code(F.col("text")).alias("exit_code"),
        flag(F.col("tool").isin(*T.READ_TOOLS) & F.col("file_path").isNotNull()).alias("reads"), F.col("queued.source").alias("source"), F.col("queued.delivery").alias("delivery"),
        (F.col("role") == "settled-file").alias("settled"),
    )


class _Events(StatefulProcessor):
    """The state of one file."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.file = handle.getValueState("file", "session string, cwd string, armed boolean")
        self.calls = handle.getMapState("calls", "id string", _CALL)
        self.queued = handle.getMapState("queued", "id string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        path = key[0]
        session, cwd, armed = self.file.get() if self.file.exists() else (None, None, False)
        batch = pd.concat(list(rows)).sort_values(["line", "place"]).astype(object)
        out: list[tuple] = []
        for r in batch.where(batch.notna(), None).itertuples(index=False):
            session, cwd = r.session_id or session, r.cwd or cwd
            at = (r.line, r.place, r.ts, cwd, r.sidechain)
            emit = lambda kind, tool=None, command=None, code=None, file=None, at=at, text=r.text: out.append((path, session or path, *at, kind, tool, command, code, file, text))
            if r.settled:
                for (_,), call in self.calls.iterator():
                    self._run(emit, call, None, None)
                self.calls.clear()
            if r.source is not None and self._again(session, r):
                continue
            if r.block == "tool_use":
                call = (*at, r.tool, r.command, r.file_path)
                if r.reads:
                    emit("file_read", r.tool, file=r.file_path)
                if r.tool_use_id is not None:
                    self.calls.updateValue((r.tool_use_id,), call)
                elif r.command is not None:
                    self._run(emit, call, None, r.text)
                armed = armed and not (r.reads or r.tool_use_id is None and r.command is not None)
            elif r.block == "tool_result":
                armed = self._result(emit, r, armed)
            elif r.stopped or r.refused:
                armed = True
                emit("interrupt" if r.stopped else "tool_rejected")
            elif r.said:
                emit("user_turn_after_correction" if armed else "turn")
                armed = False
        self.file.update((session, cwd, armed))
        yield pd.DataFrame(out, columns=_NAMES)

    def _again(self, session: str | None, r) -> bool:
        """Whether queued words came before, by source or delivery; they are known from now on."""
        ids = [(f"{session}|{kind}|{name}",) for kind, name in (("source", r.source), ("delivery", r.delivery))]
        again = any([self.queued.containsKey(i) for i in ids])
        for i in ids:
            self.queued.updateValue(i, (True,))
        return again

    @staticmethod
    def _run(emit, call: tuple, code: int | None, text: str | None) -> None:
        c = dict(zip(_CALL_NAMES, call))
        if c["command"] is not None:
            kind = "run" if code is None else "run_succeeded" if code == 0 else "run_failed"
            emit(kind, c["tool"], c["command"], code, c["file_path"], at=tuple(call[:5]), text=text)

    def _result(self, emit, r, armed: bool) -> bool:
        call, id = None, (r.tool_use_id,)
        if r.tool_use_id is not None and self.calls.containsKey(id):
            call = tuple(self.calls.getValue(id))
            self.calls.removeKey(id)
        tool = call[_CALL_NAMES.index("tool")] if call else None
        ran = call is not None and call[_CALL_NAMES.index("command")] is not None
        if r.refused:
            emit("tool_rejected", tool)
            return True
        if ran:
            self._run(emit, call, None if r.exit_code is None else int(r.exit_code), r.text)
        elif r.is_error:
            emit("tool_error", tool)
        return armed and not (ran or r.is_error)

    def close(self) -> None:
        pass


def event_stream(lines: DataFrame) -> DataFrame:
    """Events (see transcripts.events_of) of a stream of lines (path, line, text); the lines of a file come in order from trigger to trigger."""
    return coded_rows(lines).groupBy("path").transformWithStateInPandas(_Events(), EVENTS, "Append", "None")


def write_events(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the events of what is at hand to a Parquet table."""
    return event_stream(lines).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
