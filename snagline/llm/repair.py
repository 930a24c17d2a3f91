"""Conversations repaired by error-correcting Earley parsing of their roles.

A whole conversation is nothing, or an optional system turn and then pairs of
user and assistant.  Productions for errors keep, delete, rerole or insert
turns at a cost.  The chart runs from the last turn to the first over the
mirrored grammar, in which every nonterminal stands first: so all items begin
in the first column, and a column has as many values as items that expect a
terminal.  Each keeps its least (cost, audit); the candidates of an item differ
in the first letter of their audits, so the letter decides a tie.

Turns are dealt by ranges of conversation and turn.  A conversation that lies
within a task and is not long is repaired there.  Of the others each piece
gives a matrix of least costs between items; these are folded from the last
piece to the first, and then each piece is parsed with the costs behind it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import shuffle_partitions, slices, stored, text_of

WHITE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits, and of a turn kept although it is cut off.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Turns and bytes of a piece, bytes of a task.
PIECE_TURNS, PIECE_BYTES, TASK_BYTES = 1024, 4 << 20, 64 << 20
_INF = 1 << 60

# --- the grammar and its chart ------------------------------------------------------------------

#: The mirrored grammar, "$" standing before the first turn: ((a u)+ s?)? read from the end.
GRAMMAR = {"Top": [("S", "$")], "S": [("E",), ("B", "s")], "E": [(), ("B",)], "B": [("E", "a", "u")]}
Item = tuple[str, tuple[str, ...], int]


def _advanced(item: Item) -> list[Item]:
    """Items that expect a terminal once the dot of an item has moved on, by way of completed nonterminals."""
    name, rhs, dot = item[0], item[1], item[2] + 1
    if dot < len(rhs):
        return [(name, rhs, dot)]
    out = []
    for up, rules in GRAMMAR.items():
        for rule in rules:
            if rule and rule[0] == name:
                out += _advanced((up, rule, 0))
    return out


def _compiled() -> tuple[list[Item], list[int], list[tuple[str, list[int]]], int]:
    """Items that expect a terminal; those of the first column; of each its terminal and where it leads; the last one's place."""
    first = [i for name, rules in GRAMMAR.items() if () in rules for i in _advanced((name, ("",), 0))]
    items, at = list(dict.fromkeys(first)), 0
    while at < len(items):
        items += [i for i in _advanced(items[at]) if i not in items]
        at += 1
    place = items.index
    moves = [(rhs[dot], [place(x) for x in _advanced((name, rhs, dot))]) for name, rhs, dot in items]
    return items, [place(i) for i in dict.fromkeys(first)], moves, next(i for i, (t, _) in enumerate(moves) if t == "$")


ITEMS, FIRST, MOVES, LAST = _compiled()
N = len(ITEMS)
#: Places of items that take a user or assistant, in an order in which insertions come to rest in two rounds.
_TURNS = [i for i, (t, _) in enumerate(MOVES) if t in ROLES]
#: How a turn lies in the chart: its class, whether it is cut off, whether it must go.
CLASSES, CUT_OFF, MUST_GO = "sua-", 4, 8
Back = tuple[str, int] | None


def _inserted(costs: list[int], back: list[Back]) -> None:
    """Insertions within a column, until none is cheaper; at equal cost an insertion comes before K and R, behind D."""
    for _ in range(2):
        for i in _TURNS:
            cost = costs[i] + INSERT
            for j in MOVES[i][1]:
                if cost < costs[j] or cost == costs[j] and cost < _INF and back[j] is not None and "I" < back[j][0]:
                    costs[j], back[j] = cost, ("I", i)


def _column(code: int, before: list[int]) -> tuple[list[int], list[Back]]:
    """The column after a turn: deleted, kept, given another role; then with turns inserted before it."""
    costs, back = [min(_INF, c + DELETE) for c in before], [("D", i) for i in range(N)]
    if code < MUST_GO:
        kind, more = CLASSES[code % 4], CUT if code >= CUT_OFF else 0
        for i, (terminal, leads) in enumerate(MOVES):
            ways = [("K", 0)] if terminal == kind else []
            ways += [("R", REROLE)] if terminal in ROLES else []
            for letter, price in ways:
                cost = before[i] + price + more
                for j in leads:
                    if (cost, letter) < (costs[j], back[j][0]) and cost < _INF:
                        costs[j], back[j] = cost, (letter, i)
    _inserted(costs, back)
    return costs, back


def opening() -> tuple[list[int], list[Back]]:
    """The first column: behind the last turn, with what may be inserted there."""
    costs, back = [0 if i in FIRST else _INF for i in range(N)], [None] * N
    _inserted(costs, back)
    return costs, back


def chart(codes: bytes, costs: list[int]) -> tuple[list[int], list[list[Back]]]:
    """Costs before the first of some turns, given those behind the last; and of each column, first turn first, how it came about."""
    columns = []
    for code in reversed(codes):
        costs, back = _column(code, costs)
        columns.append(back)
    return costs, columns[::-1]


def traced(columns: list[list[Back]], item: int) -> tuple[list[tuple[str, str]], int]:
    """(letter, terminal) of the edits from an item before the first turn, and the item behind the last."""
    edits = []
    for back in columns:
        while True:
            letter, before = back[item]
            edits.append((letter, MOVES[before][0]))
            item = before
            if letter != "I":
                break
    return edits, item


def closing(item: int) -> list[tuple[str, str]]:
    """Edits behind the last turn."""
    _, back = opening()
    edits = []
    while back[item] is not None:
        edits.append(("I", MOVES[back[item][1]][0]))
        item = back[item][1]
    return edits


@lru_cache(1 << 16)
def parsed(codes: bytes) -> tuple[int, tuple[tuple[str, str], ...]]:
    """The least cost of a conversation, and its edits."""
    costs, columns = chart(codes, opening()[0])
    edits, item = traced(columns, LAST)
    return costs[LAST], (*edits, *closing(item))


@lru_cache(1 << 12)
def between(codes: bytes) -> tuple[int, ...]:
    """N x N least costs from each item behind the last of some turns to each before the first."""
    rows = [chart(codes, [0 if i == k else _INF for i in range(N)])[0] for k in range(N)]
    return tuple(c for row in rows for c in row)


# --- turns --------------------------------------------------------------------------------------


def coded(roles: list[str], texts: list[str], seen: set[bytes] | None = None) -> tuple[bytes, list[int]]:
    """A code for each turn, and how many are blank, repeated and cut off; seen has digests of earlier turns."""
    codes, counts, own = bytearray(), [0, 0, 0], set()
    for role, text in zip(roles, texts):
        words = text.strip(WHITE)
        again = (role, text) in own or bool(seen) and digest(role, text) in seen
        own.add((role, text))
        fault = 0 if not words else 1 if again else 2 if words[-1] not in ".!?" else 3
        if fault < 3:
            counts[fault] += 1
        codes.append(max(0, CLASSES.find(role[:1])) if role[:1] in ("s", "u", "a") else 3)
        codes[-1] += MUST_GO if fault < 2 else CUT_OFF if fault == 2 else 0
    return bytes(codes), counts


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def repaired(edits: Iterable[tuple[str, str]], roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that stay or are inserted."""
    at = 0
    for letter, terminal in edits:
        if letter == "I":
            yield letter, ROLES[terminal], ""
            continue
        if letter != "D":
            yield letter, roles[at] if letter == "K" else ROLES[terminal], texts[at]
        at += 1


class _Sum:
    """What is counted over the pieces of a conversation, in order."""

    def __init__(self):
        self.turns, self.first, self.last = 0, None, None
        self.faults, self.illegal, self.initial = [0, 0, 0], 0, None
        self.audit, self.sha, self.lines = [], hashlib.sha256(), 0

    def add(self, turns: list[int], faults: list[int], initials: list[str], edits: list[tuple[str, str]], lines: list[tuple[str, str, str]]) -> None:
        """turns has the distinct turn numbers of the piece, its least, its greatest."""
        n, low, high = turns
        if n:
            self.turns += n - (self.last == low)
            self.first, self.last = low if self.first is None else self.first, high
        self.faults = [a + b for a, b in zip(self.faults, faults)]
        self.illegal += illegal_pairs(([self.initial] if self.initial is not None else []) + initials)
        self.initial = initials[-1] if initials else self.initial
        self.audit.append("".join(letter for letter, _ in edits))
        for _, role, text in lines:
            self.sha.update(f"{'' if not self.lines else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.lines += 1

    def row(self, cost: int) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        names = ("blank", "duplicate", "truncated")
        return {"gaps": gaps, **dict(zip(names, self.faults)), "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


_RESULT = "gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string,repaired_sha256:string"
_TURN = "array<struct<edit:string,role:string,text:string>>"
_TURN_TYPE = pa.list_(pa.struct([(c, pa.string()) for c in ("edit", "role", "text")]))
_RESULT_TYPE = pa.struct([(x.split(":")[0], pa.int64() if x.endswith("bigint") else pa.string()) for x in _RESULT.split(",")])
_PIECE = "roles array<string>, texts array<string>, turns array<bigint>"


def _batch(rows: list[dict], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in fields], [n for n, _ in fields])


def _lines(edits: Iterable[tuple[str, str]], roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
    return list(repaired(edits, roles, texts))


def _as_turns(lines: list[tuple[str, str, str]], wanted: bool) -> list[dict] | None:
    return [dict(zip(("edit", "role", "text"), x)) for x in lines] if wanted else None


def _pieces(wanted: bool, conv_type: pa.DataType):
    """A function over sorted turns: whole conversations with their result, pieces of those that may go on elsewhere."""
    piece = [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("turns", pa.list_(pa.int64()))]
    fields = [("conv", conv_type), ("part", pa.int64()), ("no", pa.int64()), ("result", _RESULT_TYPE), ("repaired", _TURN_TYPE), *piece]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, out = TaskContext.get().partitionId(), 0, []
        key, roles, texts, turns, size = None, [], [], [0, None, None], 0
        begun = long = first = False

        def cut() -> dict:
            nonlocal roles, texts, turns, size, no
            row = {"conv": key, "part": part, "no": no, "roles": roles, "texts": texts, "turns": turns}
            no, roles, texts, turns, size = no + 1, [], [], [0, None, None], 0
            return row

        def whole() -> dict:
            row = cut()
            codes, faults = coded(row["roles"], row["texts"])
            cost, edits = parsed(codes)
            lines, total = _lines(edits, row["roles"], row["texts"]), _Sum()
            total.add(row["turns"], faults, [r[:1] for r in row["roles"]], edits, lines)
            return {"conv": key, "part": part, "no": row["no"], "result": total.row(cost), "repaired": _as_turns(lines, wanted)}

        for batch in slices(batches):
            for conv, turn, role, text, there in zip(*[c.to_pylist() for c in batch.columns]):
                if not begun or conv != key:
                    if begun:
                        out.append(cut() if first or long else whole())
                        first = False
                    else:
                        begun = first = True
                    key, long = conv, False
                if not there:
                    continue
                if len(roles) >= PIECE_TURNS or size >= PIECE_BYTES:
                    out.append(cut())
                    long = True
                roles.append(role)
                texts.append(text)
                size += len(role) + len(text)
                if turn is not None and turn != turns[2]:
                    turns = [turns[0] + 1, turn if turns[1] is None else turns[1], turn]
            if out:
                yield _batch(out, fields)
                out = []
        if begun:
            yield _batch([cut()], fields)

    return run


def _described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the turns of pieces, each once."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            found = sorted({digest(a, b) for a, b in zip(r["roles"], r["texts"]) if b.strip(WHITE)})
            yield _batch([{"id": r["id"], "part": r["part"], "no": r["no"], "digest": d} for d in found], _DIGESTS)


def _priced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for r in batch.to_pylist():
            codes, faults = coded(r["roles"], r["texts"], set(r["seen"] or ()))
            rows.append({"id": r["id"], "part": r["part"], "no": r["no"], "codes": codes, "faults": faults, "costs": list(between(codes))})
        yield _batch(rows, _PRICED)


def _behind(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece the least costs behind it; the pieces of a conversation come last first."""
    key, costs = None, []
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["id"] != key:
                key, costs = r["id"], opening()[0]
            rows.append({"id": key, "part": r["part"], "no": r["no"], "codes": r["codes"], "faults": r["faults"], "behind": costs})
            m = r["costs"]
            costs = [min(_INF, min(costs[k] + m[k * N + j] for k in range(N))) for j in range(N)]
        yield _batch(rows, _BEHIND)


_KEY = [("id", pa.string()), ("part", pa.int64()), ("no", pa.int64())]
_CODES = [*_KEY, ("codes", pa.binary()), ("faults", pa.list_(pa.int64()))]
_DIGESTS = [*_KEY, ("digest", pa.binary())]
_PRICED, _BEHIND = [*_CODES, ("costs", pa.list_(pa.int64()))], [*_CODES, ("behind", pa.list_(pa.int64()))]
_KEYS = "id string, part bigint, no bigint"


def _ended(wanted: bool, conv_type: pa.DataType):
    """A function over the pieces of conversations, first to last: parses each, and closes a conversation behind its last."""
    fields = [("conv", conv_type), ("part", pa.int64()), ("no", pa.int64()), ("result", _RESULT_TYPE), ("repaired", _TURN_TYPE)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, item, cost, held = None, None, LAST, 0, None

        def close() -> dict:
            edits = closing(item)
            lines = _lines(edits, [], [])
            total.add([0, None, None], [0, 0, 0], [], edits, lines)
            if wanted:
                held["repaired"] += _as_turns(lines, True)
            return held | {"result": total.row(cost)}

        for batch in slices(batches):
            out = []
            for r in batch.to_pylist():
                fresh = r["id"] != key
                if held is not None:
                    out.append(close() if fresh else held)
                costs, columns = chart(r["codes"], r["behind"])
                if fresh:
                    key, total, item, cost = r["id"], _Sum(), LAST, costs[LAST]
                edits, item = traced(columns, item)
                lines = _lines(edits, r["roles"], r["texts"])
                total.add(r["turns"], r["faults"], [x[:1] for x in r["roles"]], edits, lines)
                held = {"conv": r["conv"], "part": r["part"], "no": r["no"], "repaired": _as_turns(lines, wanted)}
            yield _batch(out, fields)
        if held is not None:
            yield _batch([close()], fields)

    return run


def _rows(conversations: DataFrame, wanted: bool, conv_id: str, turn: str, role: str, text: str, there: Column | None) -> DataFrame:
    spark = conversations.sparkSession
    c = lambda name: F.col(f"`{name}`")
    space = lambda name: F.coalesce(c(name).cast("string"), F.lit(" "))
    rows = conversations.select(
        c(conv_id).alias("conv"), c(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"),
        (F.lit(True) if there is None else F.coalesce(there, F.lit(False))).alias("there"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // TASK_BYTES))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "hash", "row"]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text", "there")
    kind = rows.schema["conv"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    name = kind.simpleString()
    found = stored(dealt.mapInArrow(_pieces(wanted, arrow), f"conv {name}, part bigint, no bigint, result struct<{_RESULT}>, repaired {_TURN}, {_PIECE}"), "conversations")
    done = found.where("result is not null").select("conv", "part", "no", "result", "repaired")
    # conversations that reach over tasks, or over pieces
    open_ = found.where("result is null").withColumn("id", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")))
    pieces = open_.select("id", "conv", "part", "no", "roles", "texts", "turns")
    digests = pieces.select("id", "part", "no", "roles", "texts").mapInArrow(_described, f"{_KEYS}, digest binary")
    firsts = digests.groupBy("id", "digest").agg(F.min(F.struct("part", "no")).alias("first"))
    later = digests.join(firsts, ["id", "digest"]).where(F.struct("part", "no") > F.col("first"))
    seen = later.groupBy("id", "part", "no").agg(F.collect_list("digest").alias("seen"))
    priced = pieces.join(seen, ["id", "part", "no"], "left").select("id", "part", "no", "roles", "texts", "seen")
    priced = priced.mapInArrow(_priced, f"{_KEYS}, codes binary, faults array<bigint>, costs array<bigint>")
    back = priced.repartition(parts, "id").sortWithinPartitions("id", F.desc("part"), F.desc("no"))
    behind = back.mapInArrow(_behind, f"{_KEYS}, codes binary, faults array<bigint>, behind array<bigint>")
    every = pieces.join(behind, ["id", "part", "no"]).select("id", "conv", "part", "no", "roles", "texts", "turns", "codes", "faults", "behind")
    every = every.repartition(parts, "id").sortWithinPartitions("id", "part", "no")
    rest = every.mapInArrow(_ended(wanted, arrow), f"conv {name}, part bigint, no bigint, result struct<{_RESULT}>, repaired {_TURN}")
    return done.unionByName(rest)


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: Column | None = None) -> DataFrame:
    """One row per conversation: its faults, and the cheapest edits that make its roles whole.

    Turns stand in order of turn, those without one first, equal ones by role
    and a hash of their text.  A null role or text is one space.  Rows for which
    `there` is not true only name their conversation; one without other rows
    has zeros and an empty audit.  Rows without conv_id are one conversation.
    A repeated row is a duplicate turn.  Other columns are not read; an empty
    table gives no rows.  The digest of a conversation is one pass over its
    turns, piece by piece, in one task; all else is dealt by pieces.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    rows = _rows(conversations, False, conv_id, turn, role, text, there)
    return rows.where("result is not null").select(F.col("conv").alias("conv_id"), "result.*")


def repaired_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of the repaired conversations: conv_id, piece (part, no), place in it, edit (K, R or I), role, text; see repair."""
    rows = _rows(conversations, True, conv_id, turn, role, text, None)
    each = rows.select(F.col("conv").alias("conv_id"), "part", "no", F.posexplode("repaired").alias("place", "t"))
    return each.select("conv_id", "part", "no", "place", "t.*")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults, chosen by crc32 of conv_id:turn (nulls: one space) modulo 20.

    0 takes the row away (there is false), 1 empties its text, 2 takes its . ! ?
    out, 3 repeats it, 4 makes it the user's.

    Returns conv_id, turn, role, text, there.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fault") != 0).alias("there"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")
