"""The pipeline on a small folder of tables."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import plain_targets, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(1)
    rows = [(i, prose(i, 120, 3000), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[3][1].upper(), "en", "s1", 0), (101, rows[4][1] + " more", None, "s1", 0), (102, None, "en", None, None), (103, "123 !", "en", "s0", 0)]
    rows += [(104, "before " + prose(700, 30) + " after", "en", "s2", 0), (None, prose(800, 50), "en", "s2", 0), (5, rows[5][1], "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, prose(700, 30)), (2, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    assert rng is not None
    return str(top), rows


def test_stages(spark, folder):
    top, rows = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, top)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        path = f"{top}/{name.replace(' ', '-')}.parquet"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r["doc_id"] for r in docs.collect()})
    every = {r[0] for r in rows}
    assert every - seen[0] == {102, 103}
    assert seen[0] - seen[1] == {3}  # of equal texts the largest doc_id stays
    assert seen[1] - seen[2] == {101}  # of near copies the smallest
    assert seen[2] - seen[3] == {104}
    assert seen[4] <= seen[3] and None in seen[3]
    assert docs.where("taken > 2 * size or taken <= 0").count() == 0


def test_short_documents_of_several_languages_stay(spark):
    rows = [(4 * k + j, "radio hotel taxi", lang) for k in range(10) for j, lang in enumerate("abcd")] + [(99, "taxi", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert corpus_pipeline.language(spark, docs, "").count() == len(rows)


CLASHING = "_lang _score _own _own2 _gone _gone2 _gone_id _gone_sha _keep_id _own_sha _fp _d1 _d2 _g1 _g2 _row _text _source _n row h h2 p carried copies whole node id id2 keys k1 LANG_PRED".split()


def test_columns_may_have_any_name(spark, folder):
    top, rows = folder
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    docs = spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], schema)
    plain = spark.read.parquet(f"{top}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out, want = stage(spark, docs, top), stage(spark, plain, top)
        assert set(CLASHING) <= set(out.columns), name
        key = lambda r: (str(r["doc_id"]), str(r["text"]))
        assert sorted(map(key, out.collect())) == sorted(map(key, want.collect())), name
    taken = corpus_pipeline.mixture(spark, plain.withColumn("Size", plain["n_chars"]), top)
    assert [c.lower() for c in taken.columns].count("size") == 1


WORD, TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def windows(text, n):
    words = re.findall(WORD, lowered(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain_pipeline(rows, items):
    """Every stage by brute force, but for the chance of the last one: its sizes by source, and the rows that reach it."""
    rows = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    largest = {}
    for r in rows:
        was = largest.get(lowered(r[1]))
        if was is None or (r[0] is not None and (was[0] is None or r[0] > was[0])):
            largest[lowered(r[1])] = r
    rows = sorted(largest.values(), key=lambda r: (r[0] is None, r[0]))
    shingles = []
    for r in rows:
        words = re.findall(TOKEN, lowered(r[1]))
        shingles.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
    rows = [r for i, r in enumerate(rows) if group[i] == i]
    asked = set().union(*[windows(t, 10) for _, t in items])
    return [r for r in rows if not windows(r[1], 10) & asked]


def test_run_against_brute_force(spark, tmp_path):
    """Rows of run() are those that every plain stage keeps, and the mix of them meets the plain targets."""
    rng = np.random.default_rng(6)
    rows = [(i, prose(i, int(rng.integers(20, 90)), 3000), "en", [None, "a", "b", "B", "é"][i % 5], 0) for i in range(120)]
    passage = prose(900, 14, 3000, "q")
    rows += [(200 + i, f"{rows[i][1]} x{i}", None, "a", 0) for i in range(0, 40, 3)]  # near copies
    rows += [(300 + i, rows[i][1].upper(), "en", "b", 0) for i in range(0, 30, 4)] + [rows[7], rows[7]]  # exact ones
    rows += [(400 + i, f"{prose(500 + i, 30)} {passage} {prose(600 + i, 9)}", "en", "é", 0) for i in range(6)]
    rows += [(500, None, "en", "a", 0), (501, "", None, None, 0), (502, "1 2 !", "en", "a", 0), (503, "few", None, "c", None), (None, prose(800, 50), "en", "c", 0)]
    items = [(1, passage), (2, None), (3, "no such words here")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = plain_pipeline(rows, items)
    assert 100 < len(kept) < len(rows) - 20
    size = {r[:2]: len(re.findall(TOKEN, r[1])) for r in kept}
    by, taken = Counter(), Counter()
    for r in kept:
        by[r[3]] += size[r[:2]]
    want = plain_targets(by)
    assert len({(r["doc_id"], r["text"]) for r in got}) == len(got)
    for r in got:
        assert size[r["doc_id"], r["text"]] == r["size"] and 0 < r["taken"] <= 2 * r["size"]
        assert r["source_size"] == by[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in by)
    # where a source is repeated at least once, all its documents are there
    whole = {s for s in by if want[s] >= by[s]}
    assert whole and {r[:2] for r in kept if r[3] in whole} == {(r["doc_id"], r["text"]) for r in got if r["source"] in whole}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_meet_what_is_decided_of_them_by_one_plan_at_every_size(spark, folder, capsys):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for stage, kind in ((corpus_pipeline.exact, "LeftAnti"), (corpus_pipeline.mixture, "LeftOuter")):
        stage(spark, docs, folder[0]).explain()
        joins = [x for x in capsys.readouterr().out.splitlines() if kind in x]
        assert joins and all("ShuffledHashJoin" in x for x in joins)
