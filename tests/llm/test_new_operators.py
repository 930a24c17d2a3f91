"""Token packing, conversation repair and periodic runs against brute force, and exact round trips."""

import hashlib
import heapq
import io
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from snagline.llm import packed, repair, runs
from snagline.llm.common import shared_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "plain words, and more words.", "it's 'll we've  two  spaces\n\n lines\t", "é ñ 漢字かな 🎉🎉 ١٢٣", "<|endoftext|> stays text", "word " * 5000, "x" * 3000, "\x00\x1c\x85\xa0　end "]


# --- packing ------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", range(1, 33))
def test_pack_and_unpack(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 4096, 5001):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = packed.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert packed.unpack(data, n, bits).tolist() == ids.tolist()


def test_least_bits_of_a_vocabulary():
    assert [packed.bits_of(n) for n in (1, 2, 3, 256, 257, 32_000, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 15, 16, 16, 17]


def written(docs, bits=15, block=16):
    class Kept(io.BytesIO):
        def close(self):
            pass

    out = Kept()
    w = packed.PackedWriter(out, bits, block)
    for doc_id, ids in docs:
        w.add(doc_id, np.array(ids, np.uint32))
    w.close()
    return packed.PackedReader(io.BytesIO(out.getvalue()))


def test_random_access(monkeypatch):
    monkeypatch.setattr(packed, "CHUNK_IDS", 64)
    rng = random.Random(3)
    docs = [(None, []), (None, [5]), *[(i, [rng.randrange(1 << 15) for _ in range(rng.choice([0, 1, 15, 16, 17, 200]))]) for i in range(40)]]
    r = written(docs)
    every = [x for _, ids in docs for x in ids]
    assert (r.n_docs, r.n_ids) == (len(docs), len(every))
    for i, (doc_id, ids) in enumerate(docs):
        assert r.doc_id(i) == doc_id and r.doc(i).tolist() == ids
    for _ in range(200):
        a, b = sorted((rng.randrange(len(every) + 1), rng.randrange(len(every) + 1)))
        assert r.ids(a, b).tolist() == every[a:b]
    assert r.checksums() == [zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) for _, ids in docs]


def test_an_empty_file_and_a_torn_one():
    r = written([])
    assert (r.n_docs, r.n_ids, r.checksums()) == (0, 0, [])
    with pytest.raises(ValueError):
        packed.PackedReader(io.BytesIO(b"IDPACK"))
    with pytest.raises(ValueError):
        written([(1, [1 << 15])])
    with pytest.raises(ValueError):
        written([(1, []), (None, [])])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_library_s_ids(name, monkeypatch):
    definition = open(public_tokenizers.path(name), encoding="utf-8").read()
    plain = Tokenizer.from_str(definition)
    plain.encode_special_tokens = True
    monkeypatch.setattr(packed, "TAKEN", 500)
    monkeypatch.setattr(packed, "KNOWN_PIECES", 300)
    encode = packed.Encoder(definition)
    assert encode.by_piece == (name == "byte_bpe_50k.json")
    rng = random.Random(4)
    letters = "ab cdé 漢🎉'st re9 1.,!\n\t\x85 ſİǅⅧ²́"
    texts = [t or "" for t in TEXTS] + [" lead", "trail ", " a b, c\nd! 's x's", "x\n y", "x \ny", "a  b", "\x85 x"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(300)]
    for t, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids
    assert list(encode([])) == []


def test_documents_come_back_in_order(spark):
    rows = [(5, "five five"), (1, "one"), (None, "none"), (3, None), (3, "three"), (3, "three"), (2, "word " * 3000), (4, "")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, hash int, start int").repartition(3)
    got = sorted(packed.pack_documents(df, BPE).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 3, 4, 5]
    plain, start = Tokenizer.from_file(BPE), 0
    want = sorted((r["n_tokens"], r["ids_crc32"]) for r in got)
    ids = lambda t: plain.encode(t or "", add_special_tokens=False).ids + [0]
    assert want == sorted((len(ids(t)), zlib.crc32(struct.pack(f"<{len(ids(t))}I", *ids(t)))) for _, t in rows)
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    again = sorted(packed.pack_documents(df.coalesce(1), BPE).collect(), key=lambda r: r["start"])
    assert again == got


def test_files_are_read_one_by_one(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text number"), "id").alias("text"))
    folder = f"{shared_dir(spark)}/packed-test"
    files = packed.write_packed(df, BPE, folder, end_id=None, shard_bytes=400, block_ids=8).orderBy("shard").collect()
    assert len(files) > 4 and sum(f["n_docs"] for f in files) == 200
    plain, doc_id = Tokenizer.from_file(BPE), 0
    for f in files:
        system, name = packed._uri(f["path"])
        with system.open_input_file(name) as stream:
            r = packed.PackedReader(stream)
            assert (r.bits, r.block) == (16, 8)
            for i in range(r.n_docs):
                assert r.doc_id(i) == doc_id and r.doc(i).tolist() == plain.encode(f"text number {doc_id}", add_special_tokens=False).ids
                doc_id += 1


def test_no_documents_to_pack(spark):
    assert packed.pack_documents(spark.createDataFrame([], "doc_id long, text string"), BPE).collect() == []


# --- repair -------------------------------------------------------------------------------------


def cheapest(codes):
    """(cost, audit) of the best edits, by a search from the first turn over plain states."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, best, done = [(0, "", 0, 0)], None, set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if best is not None and (cost, audit) >= best:
            return best
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(codes) and q in (0, 3):
            best = (cost, audit)
        steps = [(2, "I", i, after.get((q, t))) for t in "ua"]
        if i < len(codes):
            steps.append((3, "D", i + 1, q))
            if codes[i] < repair.MUST_GO:
                cut, kind = int(codes[i] >= repair.CUT_OFF), repair.CLASSES[codes[i] % 4]
                steps += [(cut, "K", i + 1, after.get((q, kind)))] + [(2 + cut, "R", i + 1, after.get((q, t))) for t in "ua"]
        for price, letter, at, to in steps:
            if to is not None:
                heapq.heappush(heap, (cost + price, audit + letter, at, to))
    return best


def some_codes(rng, n):
    return bytes(rng.choice([0, 1, 1, 1, 2, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]) for _ in range(n))


def test_the_chart_finds_the_cheapest_edits():
    rng = random.Random(1)
    for _ in range(3000):
        codes = some_codes(rng, rng.randrange(9))
        cost, edits = repair.parsed(codes)
        assert (cost, "".join(letter for letter, _ in edits)) == cheapest(codes)


def test_pieces_give_what_the_whole_gives():
    rng = random.Random(2)
    for _ in range(1000):
        codes = some_codes(rng, rng.randrange(12))
        cuts = [0, *sorted(rng.randrange(len(codes) + 1) for _ in range(3)), len(codes)]
        pieces, costs, behind = [codes[a:b] for a, b in zip(cuts, cuts[1:])], repair.opening()[0], []
        for p in reversed(pieces):
            behind.insert(0, costs)
            m = repair.between(p)
            costs = [min(repair._INF, min(costs[k] + m[k * repair.N + j] for k in range(repair.N))) for j in range(repair.N)]
        edits, item = [], repair.LAST
        for p, b in zip(pieces, behind):
            more, item = repair.traced(repair.chart(p, b)[1], item)
            edits += more
        assert (costs[repair.LAST], (*edits, *repair.closing(item))) == repair.parsed(codes)


def plainly(rows):
    """The row of a conversation: rows (turn, role, text) in order."""
    seen, codes, faults = set(), [], [0, 0, 0]
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        codes.append({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + {0: 8, 1: 8, 2: 4, None: 0}[fault])
    cost, audit = cheapest(codes)
    out, at = [], 0
    for letter in audit:
        role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if letter == "I":
            out.append((role, ""))
            continue
        if letter != "D":
            out.append((rows[at][1] if letter == "K" else role, rows[at][2]))
        at += 1
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, sha), out


def conversations(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for conv, n in sizes:
        for t in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]) if rng.random() < 0.3 else ["user", "assistant"][t % 2]
            rows.append((conv, t + rng.randrange(2) * 0, role, rng.choice([f"text {rng.randrange(6)}.", f"cut {t}", " \t", "", f"fine {t}!\n"])))
    return rows


@pytest.mark.parametrize("piece", [1024, 3])
def test_repair(spark, piece, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_TURNS", piece)
    rows = conversations(7, [(1, 0), (2, 1), (3, 60), (4, 5), (None, 9), *[(i, i % 7) for i in range(5, 40)]])
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, hash string, part int").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(df).collect()}
    turns = {}
    for r in repair.repaired_turns(df).orderBy("part", "no", "place").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role, text))
    want = {c: plainly(r) for c, r in by.items()}
    assert got == {c: w[0] for c, w in want.items()}
    assert turns == {c: w[1] for c, w in want.items() if w[1]}


def test_nulls_ties_and_rows_that_are_not_there(spark):
    rows = [(1, None, None, None, True), (1, None, "user", "Hi.", True), (1, 3, "assistant", "Yes.", True), (1, 3, "assistant", "Yes.", True), (2, 1, "user", "x", False), (2, None, "user", "x", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, there boolean")
    got = {r["conv_id"]: r for r in repair.repair(df, there=F.col("there")).collect()}
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[1]["audit"] == "DKKD" and got[1]["cost"] == 6 and got[1]["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    assert (got[1]["gaps"], got[1]["blank"], got[1]["duplicate"], got[1]["illegal"]) == (0, 1, 1, 2)
    assert repair.repair(df.where("false")).collect() == []


def test_a_long_conversation_is_cut_into_pieces(spark):
    turn = F.col("id")
    df = spark.range(6000).select(F.lit(9).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn % 5 == 4, "system").when(turn % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), turn, F.lit(".")).alias("text"))
    row = repair.repair(df).first()
    codes = bytes(0 if t % 5 == 4 else 1 if t % 2 == 0 else 2 for t in range(6000))
    cost, edits = repair.parsed(codes)
    assert (row["cost"], row["audit"]) == (cost, "".join(letter for letter, _ in edits))


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b!") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in repair.damaged(df).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["there"]))
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        one = ("user" if fault == 4 else role or " ", "" if fault == 1 else re.sub("[.!?]", "", text or " ") if fault == 2 else text or " ", fault != 0)
        assert got[c, t] == [one] * (2 if fault == 3 else 1)


# --- runs ---------------------------------------------------------------------------------------


def all_runs(words, times, least):
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, times * q) and not any(all(words[i + x] == words[i + x + r] for x in range(n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    k, n = rng.choice([1, 2, 2, 3, 5]), rng.choice([0, 1, 5, 6, 12, 40, 90])
    words = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 11)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_of_words():
    rng = random.Random(5)
    for _ in range(600):
        docs = [repetitive(rng) for _ in range(rng.randrange(1, 6))]
        times, least = rng.choice([(4, 6), (4, 6), (2, 2), (3, 1), (5, 9)])
        got = runs.find_runs(np.array([w for d in docs for w in d], np.int64), np.array([len(d) for d in docs]), times, least)
        assert sorted(map(tuple, got.tolist())) == sorted((k, *r) for k, d in enumerate(docs) for r in all_runs(d, times, least))


def test_range_minima():
    rng = np.random.default_rng(6)
    for n in (1, 31, 32, 33, 1000, 5000):
        values = rng.integers(0, 50, n)
        table = runs.RangeMinima(values)
        a, b = np.sort(rng.integers(0, n, (2, 300)), 0)
        assert table.least(a, b).tolist() == [int(values[x : y + 1].min()) for x, y in zip(a, b)]


def test_next_smaller_and_suffixes():
    rng = np.random.default_rng(7)
    for _ in range(200):
        lengths = rng.integers(0, 12, 4)
        words = rng.integers(0, 3, lengths.sum())
        doc, end, left = runs._layout(lengths)
        rank = runs.inverse_suffix_array(words, doc, left)
        suffix = [(int(doc[i]), words[i : end[i]].tolist()) for i in range(len(words))]
        assert sorted(range(len(words)), key=lambda i: suffix[i]) == np.argsort(rank).tolist()
        assert runs.next_smaller(rank, end).tolist() == [next((j for j in range(i + 1, end[i]) if rank[j] < rank[i]), end[i]) for i in range(len(words))]


def run_rows():
    rng = random.Random(8)
    rows = [(i, " ".join("w%d" % w for w in repetitive(rng))) for i in range(80)]
    return rows + [(None, "a b " * 9), (None, None), (81, ""), (82, " \t\n"), (83, "x y " * 8), (84, "same\n" * 30_000), (3, "dup dup dup dup dup dup")]


def test_periodic_runs_and_digests(spark):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in run_rows()], "doc_id long, text string, runs int, collapsed string").repartition(3)
    planted = {(r["doc_id"], r["text"]) for r in runs.with_planted_runs(df).collect()}
    want, texts = [], set()
    for doc_id, text in run_rows():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            text = " ".join(words)
        texts.add((doc_id, text))
        found = all_runs(words, 4, 6)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert planted == texts
    got = runs.run_digests(runs.periodic_runs(runs.with_planted_runs(df))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert runs.periodic_runs(df.where("false")).collect() == []
