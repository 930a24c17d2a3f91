"""Periodic runs of words by the runs theorem.

A run with period q holds, in its first q places, a Lyndon root: a word sequence
of length q that is the longest Lyndon word at its place in one of two orders of
the words, one the inverse of the other.  The longest Lyndon word at a place ends
before the next smaller value of the inverse suffix array.  A root is then
extended to both sides as far as places q apart are equal, which the longest
common prefixes answer by range minima.

The documents of a batch are handled at once: suffixes are sorted by document
first, so that copies of a document cost nothing, and those that are told apart
leave the sort.  Prefixes are only computed for documents that have a root that
may be repeated often enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from snagline.llm.common import TOKEN, slices, text_of

_TOKEN = re.compile(TOKEN)
#: Times that a run has its period at least, and its least length.
TIMES, LEAST = 4, 6
#: Values under one entry of the sparse table.
_SPAN = 32


def inverse_suffix_array(words: np.ndarray, doc: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The place of each suffix among all, by document, then by words; the end of a document comes before any word.

    words are numbers, doc the document of each in ascending order, left how many
    words the document has from there on.  Prefixes double in each round, in which
    only suffixes that are not told apart yet take part.
    """
    n = len(words)
    rank = np.empty(n, np.int64)
    key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    active, old, step = np.arange(n), np.zeros(n, np.int64), 0
    while len(active):
        if step:
            on = np.minimum(active + step, n - 1)
            old = rank[active]
            key = old * (n + 1) + np.where(left[active] > step, rank[on] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, active, old = key[order], active[order], old[order]
        place = np.arange(len(active))
        new = np.append(True, key[1:] != key[:-1])
        group = np.append(True, old[1:] != old[:-1])
        first, base = np.maximum.accumulate(np.where(new, place, 0)), np.maximum.accumulate(np.where(group, place, 0))
        rank[active] = old + first - base
        alone = new & np.append(new[1:], True)
        active = active[~alone]
        step = 2 * step or 1
    return rank


def next_smaller(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The next place with a smaller value before the end given for each place, else that end."""
    at = np.arange(1, len(values) + 1)
    todo = np.flatnonzero(at < end)
    while len(todo):
        now = at[todo]
        todo = todo[values[now] > values[todo]]
        # whatever lies before the next smaller value of a larger one is larger too
        at[todo] = at[at[todo]]
        todo = todo[at[todo] < end[todo]]
    return at


def common_prefixes(words: list[int], rank: np.ndarray, n_docs_ends: list[int]) -> np.ndarray:
    """Of each suffix, by rank, how many words it shares with the one before it; of other documents none."""
    ends, ranks = n_docs_ends, rank.tolist()
    before = [0] * len(words)
    for i, r in enumerate(ranks):
        before[r] = i
    out = np.zeros(len(words) + 1, np.int64)
    shared = begin = 0
    for end in ends:
        shared = 0
        for i in range(begin, end):
            r = ranks[i]
            j = before[r - 1] if r > begin else -1
            if j < 0:
                shared = 0
                continue
            most = end - max(i, j)
            while shared < most and words[i + shared] == words[j + shared]:
                shared += 1
            out[r] = shared
            shared -= shared > 0
        begin = end
    return out


class RangeMinima:
    """Least value of any range: a sparse table over spans of values, whose ends are looked through."""

    def __init__(self, values: np.ndarray):
        spans = -(-len(values) // _SPAN)
        self.values = np.full(spans * _SPAN, np.iinfo(np.int64).max)
        self.values[: len(values)] = values
        self.values = self.values.reshape(spans, _SPAN)
        self.table = [self.values.min(1)]
        while 2 << (len(self.table) - 1) <= spans:
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def least(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Least values from begin to end (inclusive)."""
        a, b = begin // _SPAN, end // _SPAN
        column = np.arange(_SPAN)
        none = np.iinfo(np.int64).max
        head = np.where((column >= (begin % _SPAN)[:, None]) & ((a < b)[:, None] | (column <= (end % _SPAN)[:, None])), self.values[a], none).min(1)
        tail = np.where(column <= (end % _SPAN)[:, None], self.values[b], none).min(1)
        out = np.where(a < b, np.minimum(head, tail), head)
        inner = np.flatnonzero(b - a > 1)
        if len(inner):
            low, n = a[inner] + 1, b[inner] - a[inner] - 1
            level = np.frexp(n.astype(float))[1] - 1
            for k in np.unique(level):
                some = level == k
                x, y = low[some], low[some] + n[some] - (1 << int(k))
                found = np.minimum(self.table[k][x], self.table[k][y])
                out[inner[some]] = np.minimum(out[inner[some]], found)
        return out


class _Prefixes:
    """Words that two places of a document have in common from there on."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, left: np.ndarray, ends: np.ndarray):
        self.rank = inverse_suffix_array(words, doc, left)
        self.minima = RangeMinima(common_prefixes(words.tolist(), self.rank, ends.tolist()))

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.minima.least(np.minimum(a, b) + 1, np.maximum(a, b))


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document of each word, where it ends, and how many words are left from each on."""
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    end = ends[doc] if len(doc) else np.empty(0, np.int64)
    return doc, end, end - np.arange(len(doc))


def find_runs(words: np.ndarray, lengths: np.ndarray, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """(document, start, length, period) of all runs of documents that lie one after another, in this order.

    words are numbers, lengths those of the documents.  A run cannot be extended,
    its period is its smallest, and it is at least `times` (2 or more) periods and `least` long.
    """
    none = np.empty((0, 4), np.int64)
    doc, end, left = _layout(lengths)
    if not len(words):
        return none
    at = np.arange(len(words))
    top = int(words.max())
    found = []
    for ordered in (words, top - words):
        period = next_smaller(inverse_suffix_array(ordered, doc, left), end) - at
        # of a run's roots one begins in its first period, so the run reaches over times - 1 more and at least a word
        i = np.flatnonzero(left > (times - 1) * period)
        for k in range(1, times):
            i = i[words[i] == words[i + k * period[i]]]
        if times > 2:
            i = i[words[i + period[i] - 1] == words[i + 2 * period[i] - 1]]
        found.append(np.stack([i, period[i]], 1))
    roots = np.unique(np.concatenate(found), axis=0)
    if not len(roots):
        return none
    # on with the documents that have some
    some = np.zeros(len(lengths), bool)
    some[doc[roots[:, 0]]] = True
    kept, own = some[doc], lengths[some]
    place = np.cumsum(kept) - 1
    i, p = place[roots[:, 0]], roots[:, 1]
    sub, (d, e, rest) = words[kept], _layout(own)
    ends = np.cumsum(own)
    right = _Prefixes(sub, d, rest, ends).shared(i, i + p)
    begin = (ends - own)[d[i]]
    mirror = lambda x, of: begin[of] + e[i[of]] - 1 - x
    back = np.zeros(len(i), np.int64)
    inside = np.flatnonzero(i > begin)
    if len(inside):
        turned = np.concatenate([x[::-1] for x in np.split(sub, ends[:-1])])
        back[inside] = _Prefixes(turned, d, rest, ends).shared(mirror(i[inside] - 1, inside), mirror(i[inside] + p[inside] - 1, inside))
    length = back + p + right
    good = length >= np.maximum(least, times * p)
    number = np.flatnonzero(some)[d[i]]
    return np.unique(np.stack([number, i - back - begin, length, p], 1)[good], axis=0)


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: it is not behind the first period of a run."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


_FIELDS = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """One row per document with its periodic runs, and its text without what only repeats.

    Words are runs of anything but ASCII white space, numbered from 0.  Runs come
    by start, then period.  collapsed has the words that no run holds behind its
    first period, joined by one space.  A null or empty text has no words and an
    empty one.  Repeated rows stay, ties do not arise; other columns are not
    read; an empty table gives no rows.  A document is handled whole in one task.

    Returns doc_id, n_words, runs, collapsed.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    out = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(_FIELDS).fields])
    arrow = [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known: dict[str, int] = {}
            each = [np.array([known.setdefault(w, len(known)) for w in _TOKEN.findall(t)], np.int64) for t in batch.column(1).to_pylist()]
            names, lengths = list(known), np.array([len(x) for x in each], np.int64)
            found = find_runs(np.concatenate(each) if each else np.empty(0, np.int64), lengths, times, least)
            cuts = np.searchsorted(found[:, 0], np.arange(len(each) + 1))
            runs, texts = [], []
            for x, a, b in zip(each, cuts, cuts[1:]):
                own = found[a:b, 1:]
                own = own[np.lexsort((own[:, 2], own[:, 0]))]
                runs.append([dict(zip(("start", "length", "period"), r)) for r in own.tolist()])
                texts.append(" ".join([names[w] for w in (x[collapsed(len(x), own)] if b > a else x).tolist()]))
            columns = [batch.column(0), *[pa.array(c, t) for c, t in zip((lengths.tolist(), runs, texts), arrow[1:])]]
            yield pa.RecordBatch.from_arrays(columns, out.names)

    return rows.mapInArrow(run, out)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which some, by h = crc32 of their doc_id, repeat words: from word a on, word i is word a + (i - a) % p.

    With h % 10 = 0, g = h / 10 and n words, a = g % n and p = 1 + (n - a) / (3 + g % 8).  Other texts, and those
    without doc_id, stay.

    Returns doc_id, text.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all(text_of("text"), F.lit(f"({TOKEN})"))).alias("w"), F.floor(h / 10).cast("long").alias("g"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    planted = F.when(F.col("n") > 0, F.array_join(F.transform("w", word), " "))
    return rows.select("doc_id", F.coalesce(planted, "text").alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Of the rows of periodic_runs: how many runs, the one of greatest exponent, digests of all runs and of the collapsed text.

    Of equal exponents the run that starts first, then the shortest period, counts.

    Returns doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.
    """
    order = lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("length"))
    best = F.array_max(F.transform("runs", order))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.array_join(lines, "").alias("lines"), "collapsed")
    period = -F.col("b.p")
    return rows.select(
        "doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("b.length") / period).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
