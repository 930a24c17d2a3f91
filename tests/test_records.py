"""Records of both transcript shapes over literal lines: threads, harness notes, questions, queued words, ends of turns."""

import json

import pytest

from snagline.sources import transcripts as T


def rec(role, content, *, message_id=None, sidechain=False, meta=False, **more):
    message = {"role": role, "content": content} | ({"id": message_id} if message_id else {})
    return {"type": role, "sessionId": "s", "isSidechain": sidechain, "isMeta": meta, "message": message} | more


def text(x):
    return [{"type": "text", "text": x}]


def call(i, name, **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def result(i, x, error=False):
    return {"type": "tool_result", "tool_use_id": i, "content": x, "is_error": error}


def queued(words, source, delivery, **change):
    attachment = {"type": "queued_command", "humanTurn": True, "origin": {"kind": "human"}, "prompt": words, "source_uuid": source, "delivery_id": delivery} | change
    return {"type": "attachment", "sessionId": "s", "attachment": attachment}


def item(**payload):
    return {"type": "response_item", "sessionId": "s", "payload": payload}


def event(kind, **payload):
    return {"type": "event_msg", "sessionId": "s", "payload": {"type": kind} | payload}


def message(role, words, **more):
    return item(type="message", role=role, content=[{"type": "input_text", "text": w} for w in ([words] if isinstance(words, str) else words)], **more)


def lines(spark, records, path="/s"):
    return spark.createDataFrame([(path, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "path string, line long, text string")


def interactions(spark, records, shape="a"):
    blocks = (T.blocks_a if shape == "a" else T.blocks_b)(lines(spark, records))
    return T.interactions_of(blocks).orderBy("ordinal").collect()


def kinds(spark, records, shape="a"):
    blocks = (T.blocks_a if shape == "a" else T.blocks_b)(lines(spark, records))
    return [(r["line"], r["kind"]) for r in T.events_of(blocks).orderBy("line", "place", "kind").collect()]


def test_answers_threads_and_streamed_repeats(spark):
    rows = interactions(spark, [
        rec("user", "Make the release notes"),
        rec("assistant", [*text("I will check."), call("ask", "AskUserQuestion", questions=[{"question": "Which audience?"}])], message_id="a1"),
        rec("assistant", text("I will check."), message_id="a1"),
        rec("user", [result("ask", "Customers")]),
        rec("assistant", [call("run", "Bash", command="true")], message_id="a2"),
        rec("user", [result("run", "Exit code 0")]),
        rec("user", "<user_instructions>old</user_instructions>"),
        rec("user", "harness note", meta=True),
        rec("assistant", text("Done."), message_id="final"),
        rec("user", "Delegated check", sidechain=True),
        rec("assistant", text("Summary"), message_id="worker", sidechain=True),
        "no json", json.dumps({"type": "cost-state", "sessionId": "s"}),
    ])
    assert [(r["ordinal"], r["origin"]) for r in rows] == list(enumerate([
        "human_request", "assistant_text", "question", "human_answer", "tool_call", "tool_result", "quoted_history", "harness", "assistant_text", "human_request", "assistant_text",
    ]))
    assert rows[2]["text"] == "Which audience?" and rows[3]["question_ordinal"] == 2 and rows[5]["call_ordinal"] == 4 and rows[3]["call_ordinal"] is None
    assert [(r["sidechain"], r["turn_id"]) for r in rows] == [(False, 1)] * 9 + [(True, 1)] * 2
    assert [r["terminal_state"] for r in rows if r["origin"] == "assistant_text"] == ["none", "unknown", "unknown"]


def test_words_answer_a_question_unless_it_is_settled(spark):
    ask = lambda i: rec("assistant", [call(i, "ask_user", question=f"{i}?")], message_id=i)
    got = [(r["origin"], r["question_ordinal"]) for r in interactions(spark, [
        ask("q1"), rec("user", "yes"), rec("user", "and this"),  # answered by words once
        ask("q2"), rec("user", [result("q2", "fine")]), rec("user", "next"),  # settled by its result
        ask("q3"), rec("user", T.INTERRUPT), rec("user", "stop asking"),  # dropped by an interrupt
        ask("q4"), ask("q5"), rec("user", [result("q4", "four")]), rec("user", "five"), rec("user", [result("q5", "late")]),
        ask("q6"), rec("user", "note", meta=True), rec("user", "other thread", sidechain=True), rec("user", "six"),
    ])]
    assert got == [
        ("question", None), ("human_answer", 0), ("human_request", None), ("question", None), ("human_answer", 3), ("human_request", None), ("question", None), ("harness", None), ("human_request", None),
        ("question", None), ("question", None), ("human_answer", 9), ("human_answer", 10), ("human_answer", 10), ("question", None), ("harness", None), ("human_request", None), ("human_answer", 14),
    ]


def test_queued_words_count_once(spark):
    rows = interactions(spark, [
        rec("user", "begin"), queued("also this", "s1", "d1"), queued("also this", "s1", "d2"), queued("again", "s2", "d1"), queued("by the dropped one", "s9", "d2"),
        queued("other", "s3", "d3"), queued("x", "s4", "d4", humanTurn=False), queued("x", "s5", "d5", origin={"kind": "peer"}), queued("x", "s6", "d6", commandMode="bash"),
        queued(" ", "s7", "d7"), queued("x", "", "d8"), queued("x", "s8", None), queued("x", "s10", "d10") | {"isMeta": True}, queued("mode", "s11", "d11", commandMode="prompt"),
    ])
    assert [(r["text"], r["turn_id"], r["message_id"]) for r in rows] == [("begin", 1, None), ("also this", 2, "s1"), ("other", 3, "s3"), ("mode", 4, "s11")]
    assert kinds(spark, [rec("user", T.INTERRUPT), queued("use tabs", "s", "d"), queued("use tabs", "s", "e")]) == [(0, "interrupt"), (1, "user_turn_after_correction")]


def test_harness_notes_do_not_consume_a_correction(spark):
    assert kinds(spark, [rec("user", T.INTERRUPT), rec("user", "a note", meta=True), rec("user", "use tabs"), rec("user", "more")]) == [(0, "interrupt"), (2, "user_turn_after_correction"), (3, "turn")]


def test_what_ends_the_wait_for_a_correction(spark):
    stop = rec("user", T.INTERRUPT)
    edit = [rec("assistant", [call("e", "Edit", file_path="/a")]), rec("user", [result("e", "ok")])]
    assert kinds(spark, [stop, *edit, rec("user", "no")])[-1] == (3, "user_turn_after_correction")
    assert kinds(spark, [stop, rec("assistant", text("I see.")), rec("user", "no")])[-1] == (2, "user_turn_after_correction")
    assert kinds(spark, [stop, rec("assistant", [call("b", "Bash", command="ls")]), rec("user", "no")])[-1] == (2, "user_turn_after_correction")
    for ended in ([rec("assistant", [call("b", "Bash", command="ls")]), rec("user", [result("b", "x")])], [rec("assistant", [call("r", "Read", file_path="/a")])], [rec("user", [result("z", "bad", True)])]):
        assert kinds(spark, [stop, *ended, rec("user", "no")])[-1][1] == "turn"


def test_results_without_and_beyond_their_call(spark):
    got = kinds(spark, [
        rec("assistant", [call("b", "Bash", command="make"), call("r", "Read", file_path="/a"), {"type": "tool_use", "name": "Bash", "input": {"command": "free"}}]),
        rec("user", [result("r", "missing", True), result("b", [{"type": "text", "text": "Exit code 2"}, {"type": "image"}, {"type": "text", "text": "boom"}], True)]),
        rec("user", [result("b", "again", True), result("none", f"x {T.REJECTIONS[1]} y")]),
        rec("assistant", [call("p", "Bash", command="sleep")]),
    ])
    assert got == [(0, "run_failed"), (0, "file_read"), (0, "run"), (1, "tool_error"), (2, "tool_error"), (2, "tool_rejected"), (3, "run")]


def test_second_shape_ends_turns_itself(spark):
    records = [
        message("user", "Build A"), message("assistant", "Working", id="a1"), message("user", "Status?"),
        item(type="custom_tool_call", name="functions.request_user_input", call_id="q", input="Select audience"), item(type="custom_tool_call_output", call_id="q", output="Customers"),
        message("assistant", "Done", id="a2"), event("task_complete"), message("user", "Build B"), message("assistant", "Partial", id="a3"), event("turn_aborted", reason="stop"), event("token_count"),
    ]
    rows = interactions(spark, records, "b")
    assert {r["message_id"]: r["terminal_state"] for r in rows if r["message_id"]} == {"a1": "unknown", "a2": "completed", "a3": "interrupted"}
    question, answer = (next(r for r in rows if r["origin"] == x) for x in ("question", "human_answer"))
    assert answer["question_ordinal"] == question["ordinal"] and question["text"] == "Select audience"
    assert [r["ordinal"] for r in rows] == list(range(len(rows))) and rows[-1]["origin"] == "harness" and rows[-1]["text"] == "stop"


def test_corrections_of_the_second_shape(spark):
    run = [item(type="function_call", name="shell", call_id="1", arguments='{"command":"ls"}'), item(type="function_call_output", call_id="1", output="Exit code 0\nx")]
    aborted = event("turn_aborted")
    assert kinds(spark, [aborted, message("user", "use tabs"), message("user", "more")], "b") == [(0, "interrupt"), (1, "user_turn_after_correction"), (2, "turn")]
    for acted in (run, [message("assistant", "Sorry")]):
        assert kinds(spark, [aborted, *acted, message("user", "use tabs")], "b")[-1][1] == "turn"
    goal = message("user", '<codex_internal_context source="goal">go on</codex_internal_context>')
    assert kinds(spark, [event("user_message", message=T.INTERRUPT), goal, message("user", "use tabs")], "b") == [(0, "interrupt"), (2, "user_turn_after_correction")]
    denied = item(type="function_call_output", call_id="1", output="approval denied")
    assert kinds(spark, [run[0], denied, message("user", "why"), event("tool_rejected", message="no")], "b") == [(1, "tool_rejected"), (2, "turn"), (3, "tool_rejected")]


@pytest.mark.parametrize("shape", ["a", "b"])
def test_session_and_folder_are_carried_over_all_records(spark, shape):
    records = [{"type": "other", "sessionId": "first", "cwd": "/w"}, rec("user", "hi") if shape == "a" else message("user", "hi"), {"type": "other", "cwd": "/v"}]
    records[1].pop("sessionId")
    row = (T.blocks_a if shape == "a" else T.blocks_b)(lines(spark, records)).first()
    assert (row["session_id"], row["cwd"]) == ("first", "/w")
    row = (T.blocks_a if shape == "a" else T.blocks_b)(lines(spark, records[1:])).first()
    assert (row["session_id"], row["cwd"]) == ("/s", None)
