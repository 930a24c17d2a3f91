"""Odd texts and the forms of plans that hold at size."""

import duckdb

from snagline.plans import registry


def test_interventions_read_odd_texts_as_sql_does(spark, tmp_path):
    texts = ["\u00e9stop", "stop\u00e9", "\u4e2dactually", "a\u017fk", "I a\u017fked", "than\u212a", "\u00a0build \u00a0x", "\u00a0new task", "thisstop", "stop_", "KEEP x CONCISE", None]
    rows = [(i, turn, "user", t) for i, text in enumerate(texts) for turn, t in ((0, "x"), (1, text))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("intervention_classes", "intervention_signals", "intervention_counts"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = duck.sql(registry.ORACLES[name])
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_phrases_stand_where_a_plain_search_finds_them(spark):
    import itertools
    import unicodedata

    from snagline.functions.words import _plain_letters, stem
    from snagline.operators import detectors as D

    plain = str.maketrans(*_plain_letters())

    def words(text):
        text = "".join(x for x in text.lower().translate(plain) if unicodedata.category(x) != "Mn")
        return [stem(w) for w in "".join(x if unicodedata.category(x)[0] in "LN" else " " for x in text).split()]

    parts = ["bin1", "B\u00ceN1", "bin12", "xbin1", "\u0301bin1", "b\u0301in1", "bi\u0301n1\u0301", "host", "hosts", "\u212aey", "keys", "a", "x\u0301", "\u4e2d"]
    texts = ["".join(t) for t in itertools.product(parts, ["", " ", "-\u0301", "_"], parts)] + ["", None]
    phrases = ["bin1", "host", "key", "a", "bin1 host", "Keys, hosts", "\u4e2d", "--"]
    docs = spark.createDataFrame(list(enumerate(texts)), "path long, text string")
    got = {tuple(r) for r in D.phrase_matches(docs, spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    want = set()
    for (i, text), phrase in itertools.product(enumerate(texts), phrases):
        t, p = words(text or ""), words(phrase)
        if p and any(t[k : k + len(p)] == p for k in range(len(t))):
            want.add((i, phrase))
    assert got == want


def test_hits_of_a_program_meet_its_rules_as_counts(spark):
    from snagline.operators import detectors as D

    at, long = "2024-01-02 00:00:00", "p" * 240
    seen = [(i, f"s{i % 3}", "a" if i % 2 else "b") for i in range(9)] + [(i, f"s{i % 2}", "a:x") for i in range(9, 12)] + [(20, None, "a")]
    obs = spark.createDataFrame(seen, "obs_id long, session_id string, program string").selectExpr(
        "*", f"timestamp('{at}') + make_interval(0, 0, 0, cast(obs_id as int)) AS ts_utc", "'run_failed' AS kind", "program || ': command not found' AS signature", "'h' AS sig_hash", "'h0' AS host"
    )
    # keys cut to one, and a key that two programs give
    rules = [(long + "1", "a"), (long + "2", "a"), ("x:1", "a"), ("1", "a x"), ("2", "b and a")]
    docs = spark.createDataFrame(rules, "path string, text string").selectExpr("*", "0 AS stale", f"timestamp('{at}') AS indexed_at")
    span = D.Span()
    plain = D.Detector("D-08", 2, "plain", D._stale_rule, None, ("key",), D._silent_hosts)
    for kind in D.KINDS:
        got = D.DETECTORS["D-08"].run(kind, span, observation=obs, rule_doc=docs)
        want = plain.run(kind, span, observation=obs, rule_doc=docs)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_fences_hold_few_texts_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from snagline.functions import fences

    seen = []
    own = fences.replaced
    monkeypatch.setattr(fences, "replaced", lambda texts, automaton: seen.append(len(texts)) or own(texts, automaton))
    made = list(fences.fenced(["the"]).func(iter([pa.array(["The x", None, ""] * 100), pa.array([], pa.string())])))
    assert max(seen) <= fences.TEXTS and sum(seen) == 300
    assert made[0].to_pylist() == [f"{fences.MARKER} x", None, ""] * 100 and len(made[1]) == 0


def test_sessions_are_not_put_together_again(spark):
    from snagline.sources import transcripts as T

    a = '{"type":"user","message":{"id":"m","content":"go"}}'
    b = '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"go"}]}}'
    lines = lambda said: spark.createDataFrame([(f"/{i}", 0, said) for i in range(9)], "path string, line long, text string")
    for rows in (T.events_of(T.blocks_a(lines(a))), T.interactions_of(T.blocks_a(lines(a))), T.events_of(T.blocks_b(lines(b)))):
        assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tasks_of_transcripts_follow_the_lines(spark, tmp_path, monkeypatch):
    from snagline.sources import transcripts as T

    lines = spark.range(90).selectExpr("'/a' AS path", "id AS line", "'no record' AS text")
    assert T.parts_of(lines, 9) == 10 and T.parts_of(lines) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert T.parts_of(spark.range(1000), 1) == T.UNHELD_PARTS
    monkeypatch.setattr(T.parts_of, "__defaults__", (7,))
    kind = "element_at(array('view', 'error', 'click', 'signup'), cast(id % 4 + 1 AS int)) AS event_type"
    spark.range(40).selectExpr("id AS event_id", "id % 5 AS user_id", kind, "timestamp('2024-01-02 00:00:00') AS ts").write.parquet(f"{tmp_path}/events.parquet")
    # 80 lines, and one more for each of five files of the second shape
    for name, tasks in (("transcript_events_a", 12), ("transcript_events_b", 13), ("transcript_interactions", 12)):
        got = registry.QUERIES[name](spark, str(tmp_path))
        assert got.rdd.getNumPartitions() == tasks
        want = duckdb.sql(registry.ORACLES[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_tasks_of_sessions_follow_the_rows(spark):
    from snagline.operators import detectors as D

    rows = spark.range(90).selectExpr("id AS obs_id", "concat('s', id % 30) AS session_id")
    assert D.dealt_by_session(rows, 9).rdd.getNumPartitions() == 10


def test_pairs_of_keys_and_sessions_are_whole_and_a_file_of_them_small(spark, tmp_path, monkeypatch):
    from snagline.operators import detectors as D

    keys = spark.range(24_000).selectExpr("'a' AS program", "concat(repeat('k', 60), id) AS key").unionAll(spark.sql("SELECT 'b', 'x' UNION ALL SELECT 'c', 'y'"))
    sessions = spark.range(200).selectExpr("'a' AS program", "concat('s', id) AS session_id").unionAll(spark.sql("SELECT 'b', null UNION ALL SELECT 'd', 's'"))
    D._shared_sessions(sessions, keys).write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert got.count() == got.distinct().count() == 24_000 * 200 + 1
    assert got.where("key = 'x' AND session_id IS NULL").count() == 1
    assert sum(p.stat().st_size for p in tmp_path.glob("pairs/*.parquet")) < 0.4 * 24_000 * 200
    # blocks and runs of any size give the same pairs, and tasks follow them
    few = keys.where("key < concat(repeat('k', 60), '12') or program <> 'a'")
    want = sorted(map(tuple, few.join(sessions, "program").select("key", "session_id").collect()), key=repr)
    for name, size in (("KEYS", 100), ("SESSIONS", 30), ("RUN", 7), ("TASK_PAIRS", 10_000)):
        monkeypatch.setattr(D, name, size)
    small = D._shared_sessions(sessions, few)
    assert small.rdd.getNumPartitions() >= len(want) // 10_000
    assert sorted(map(tuple, small.collect()), key=repr) == want
    assert D._shared_sessions(sessions.limit(0), few).count() == 0
