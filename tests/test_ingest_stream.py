"""A transcript that comes in pieces gives the events of the whole, whatever the cuts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from snagline.sources import transcripts as T
from snagline.streaming import ingest
from tests.test_records import call, queued, rec, result

RECORDS = [
    {"type": "other", "sessionId": "first", "cwd": "/w"},
    rec("assistant", [call("b", "Bash", command="make"), call("r", "Read", file_path="/a"), {"type": "tool_use", "name": "Bash", "input": {"command": "free"}}]),
    rec("user", [result("r", "missing", True), result("b", "Exit code 2\nboom", True)]),
    rec("user", T.INTERRUPT), rec("user", "a note", meta=True), {"type": "other", "cwd": "/v"}, rec("user", "use tabs"), rec("user", "more"),
    rec("assistant", [call("p", "Bash", command="sleep"), call("e", "Edit", file_path="/e")]), queued("also", "s1", "d1"), queued("also", "s1", "d2"), queued("also", "s2", "d2"),
    rec("user", [result("e", "ok"), result("none", f"x {T.REJECTIONS[1]}")]), rec("assistant", [{"type": "text", "text": "I see"}]), rec("user", "why", sidechain=True),
    "no json", rec("user", [result("p", "Exit code 0")]), rec("user", T.REJECTIONS[2]), rec("assistant", [call("x", "Bash", command="never ends")]), rec("user", "last words"),
]


@pytest.fixture(scope="module")
def state_store(spark):
    before = {k: spark.conf.get(k, None) for k in ingest.STATE_STORE}
    for k, v in ingest.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(df):
    return sorted((r["path"], r["session_id"], r["line"], r["place"], r["cwd"], r["sidechain"], r["kind"], r["tool"], r["command"], r["exit_code"], r["file_path"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pieces_give_what_the_whole_gives(spark, tmp_path, state_store, seed):
    rng = random.Random(seed)
    texts = [r if isinstance(r, str) else json.dumps(r).replace('"s"', f'"s{seed}"') for r in RECORDS]
    files = {f"/{name}": texts if name == "whole" else [t for t in texts if rng.random() < 0.7] for name in ("whole", "part")}
    files = {p: [t.replace(f'"s{seed}"', f'"s{p}"').replace('"first"', f'"f{p}"') for t in ts] for p, ts in files.items()}
    schema = "path string, line long, text string"
    cuts = sorted(rng.randrange(len(texts) + 1) for _ in range(seed))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(texts)])):
        rows = [(p, n, t) for p, ts in files.items() for n, t in enumerate(ts) if a <= n < b]
        rows += [(p, len(ts), ingest.SETTLED) for p, ts in files.items()] if b == len(texts) and i == len(cuts) else []
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.write_events(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    batch = spark.createDataFrame([(p, n, t) for p, ts in files.items() for n, t in enumerate(ts)], schema)
    want = T.events_of(T.blocks_a(batch))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(got) == rows_of(want)
    assert got.where(F.col("kind") == "user_turn_after_correction").count() > 0
