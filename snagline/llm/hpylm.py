"""Hierarchical Pitman-Yor language model, trained and applied in shards.

Each word is a dish.  The word before, whole, is the context: each has a
restaurant of its own, and so has the beginning of a text.  All context
restaurants share one parent, whose base is uniform.  Customers sit
at tables, and every table sends one customer to the parent.  Gibbs rounds seat
all customers of every dish anew: the number of tables is drawn from its
distribution given the rest, S(c, t) times the weights of t new tables, S being
the generalised Stirling numbers; for dishes of many customers from the limit
law of the same weights.  Dishes are drawn side by side, given the tables of the
round before.  Predictive probabilities are averaged over the last rounds.

Documents are encoded in chunks with a dictionary of their own.  A chunk asks
for each of its (context, word) pairs once; the pairs are dealt to shards by
word, where they are counted over the whole corpus and seated; the answers go
back to the chunk.  Documents go along, dealt by chunk, so that one shuffle brings
both where they stay and what the chunks ask is not written a second time.  A restaurant has dishes in many shards, so contexts have
homes: between rounds each shard sends the tables of its contexts to their
homes, which add them up and send the sums back.  Neither the vocabulary nor the
model is ever in one place; the driver sees a few numbers.  Chance follows word
and context, and all sums are of integers, so neither the number of shards nor
the layout of the input changes a result.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from snagline.llm.common import LOWER_BYTES, shared_dir, shuffle_partitions, slices, stored, text_of
from snagline.llm.setlink import mixed

#: The context of the first word of a text.
START = 0
#: Stands for the parent, where chance follows the context.
CONTEXTS = 1 << 14
#: A chunk is closed at so many tokens.
CHUNK_TOKENS = 2_000_000
STRENGTH, BASE_STRENGTH = 1.0, 1.0
#: Gibbs rounds, and how many of the last are averaged.
ROUNDS, SAMPLES = 3, 2
#: Up to so many customers the tables are drawn from the Stirling numbers themselves.
SMALL = 64
#: Weights that are held at a time while tables are drawn.
WEIGHTS_AT_A_TIME = 1_000_000
_END = b""


def context_of(word: bytes) -> int:
    """The restaurant behind a word: the word by 64 bits of hash, as words are told apart."""
    return max(START + 1, xxhash.xxh64_intdigest(word))


def _pack(x: np.ndarray) -> bytes:
    """The bytes of the numbers, first bytes first, each place with codes of its own, which compresses what is mostly small."""
    packer, out = zlib.compressobj(1, strategy=zlib.Z_RLE), []
    for place in np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T:
        out += packer.compress(place.tobytes()), packer.flush(zlib.Z_BLOCK)
    return b"".join([*out, packer.flush()])


def _unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _pack_rising(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=0).astype(np.uint32))


def _unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint32), dtype=np.int64)


def _pack_hashes(x: np.ndarray, step: int = 1) -> bytes:
    """Rising hashes by what each adds to the one before; with a step the rest of dividing by it, which all share, is left out."""
    return _pack(np.diff(x // np.uint64(step), prepend=np.uint64(0)))


def _unpack_hashes(data: bytes, step: int = 1, rest: int = 0) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64) * np.uint64(step) + np.uint64(rest)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a sorted array and how often each occurs."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x))).astype(np.uint32)


class _Chunk:
    """Documents in the order they came, as numbers of a dictionary of their own."""

    def __init__(self):
        self.words: defaultdict = defaultdict()
        self.words.default_factory = self.words.__len__
        self.docs: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id, held_out: bool, text: str) -> None:
        tokens = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
        tokens.append(_END)
        words = self.words
        self.ids.append(np.array([words[t] for t in tokens], np.int32))
        self.docs.append((doc_id, held_out, len(tokens)))
        self.tokens += len(tokens)

    def encoded(self, shards: int) -> tuple[list[tuple], list[tuple]]:
        """Rows of documents, and rows of pairs by shard."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        context = np.fromiter((START, *(context_of(w) for w in self.words)), np.uint64, len(self.words) + 1)
        ids = np.concatenate(self.ids)
        sizes = np.array([n for *_, n in self.docs])
        ends = np.cumsum(sizes)
        before = np.concatenate(([0], ids[:-1].astype(np.int64) + 1))
        before[ends - sizes] = 0
        pairs, spot = np.unique((before << 32) | ids, return_inverse=True)
        train = np.repeat(np.array([not held for _, held, _ in self.docs]), sizes)
        counts = np.bincount(spot[train], minlength=len(pairs))
        word, ctx = hashes[pairs & 0xFFFFFFFF], context[pairs >> 32]
        shard = (word % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((ctx, word, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        there = np.unique(shard)
        cuts = np.searchsorted(shard[order], there), np.searchsorted(shard[order], there, "right")
        asked = []
        for name, a, b in zip(there.tolist(), *cuts):
            own, runs = _runs(word[order[a:b]])
            names, u = np.unique(ctx[order[a:b]], return_inverse=True)
            packed = _pack_hashes(names), _pack(u.astype(np.uint32)), _pack(counts[order[a:b]].astype(np.uint32))
            asked.append((name, _pack_hashes(own, shards), _pack(runs), *packed))
        docs = []
        for (doc_id, held, n), part in zip(self.docs, np.split(place[spot], ends[:-1])):
            own, times = np.unique(part, return_counts=True)
            docs.append((doc_id, held, n, _pack_rising(own), _pack(times.astype(np.uint32))))
        return docs, asked


def _key(chunk):
    """What documents of a chunk have in the place of a shard."""
    return -1 - chunk


def _encode(shards: int, out: T.StructType, chunk_tokens: int):
    kinds = [to_arrow_type(f.dataType) for f in out.fields]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        chunk = _Chunk()

        def rows() -> pa.RecordBatch:
            name = (part << 24) + number
            docs, asked = chunk.encoded(shards)
            made = [(_key(name), name, *d, *[None] * 5) for d in docs]
            made += [(shard, name, *[None] * 5, *a) for shard, *a in asked]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], out.names)

        for batch in slices(batches):
            for doc_id, held, text in zip(*(c.to_pylist() for c in batch.columns)):
                chunk.add(doc_id, held, text)
                if chunk.tokens >= chunk_tokens:
                    yield rows()
                    chunk, number = _Chunk(), number + 1
        if chunk.docs:
            yield rows()

    return encode


def discount_of(n1: int, n2: int) -> float:
    """n1 / (n1 + 2 n2) of the counts of counts, kept inside (0, 1)."""
    return float(np.clip(n1 / max(1, n1 + 2 * n2), 0.1, 0.95))


@lru_cache(8)
def stirling_logs(d: float, n: int = SMALL) -> np.ndarray:
    """log S(c, t) at [c, t]: seatings of c customers at t tables, each weighted by its sizes."""
    s = np.zeros((n + 1, n + 1))
    s[1, 1] = 1.0
    for c in range(1, n):
        t = np.arange(1, c + 2)
        s[c + 1, t] = s[c, t - 1] + (c - d * t) * s[c, t]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log(np.maximum(s, 0.0))


def chance(word: np.ndarray, context: np.ndarray | int, salt: int) -> np.ndarray:
    """A number in (0, 1) for each word and context."""
    x = mixed(word ^ mixed(np.atleast_1d(np.asarray(context, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)))
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _large(c: np.ndarray, g: np.ndarray, d: float, u: np.ndarray, u2: np.ndarray) -> np.ndarray:
    """Tables besides the first one's, for dishes of many customers.

    With f(x) = (1 - (1-x)^d) / d, the seatings with t tables weighted by g^t have
    the generating function f'(x) g exp(g f(x)), one table being that of the first
    customer.  At the x where its mean size is c - 1 the other tables are a Poisson
    number of mean g f(x) given the size, whose mean and variance follow.
    """
    low, high = np.log((1 - d) / (c + 1.0)), np.full(len(c), -1e-12)
    for _ in range(50):
        middle = (low + high) / 2
        y = np.exp(middle)
        more = (1 - y) * (g * y ** (d - 1) + (1 - d) / y) > c - 1
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    y = np.exp((low + high) / 2)
    x = 1 - y
    mean = g * (1 - y**d) / d
    both = g * x * y ** (d - 1)
    spread = both + g * x * x * (1 - d) * y ** (d - 2) + (1 - d) * x / y**2
    variance = np.clip(mean - both**2 / spread, 1e-9 * mean, mean)
    out = np.floor(mean + np.sqrt(variance) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * u2) + 0.5)
    few = np.flatnonzero(mean < 30)
    if len(few):  # a binomial number of the same mean and variance
        p = np.clip(1 - variance[few] / mean[few], 1e-6, 1 - 1e-6)
        n = np.maximum(1.0, np.round(mean[few] / p))
        p = np.minimum(mean[few] / n, 1 - 1e-9)
        part, total, k = (1 - p) ** n, np.zeros(len(few)), np.zeros(len(few))
        for at in range(200):
            total += part
            on = u[few] > total
            if not on.any():
                break
            k += on
            part = np.maximum(part * (n - at) / (at + 1) * p / (1 - p), 0.0)
        out[few] = k
    return np.maximum(out, 0)


def tables(c: np.ndarray, p: np.ndarray, others: np.ndarray, strength: float, d: float, u: np.ndarray, u2: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A draw of the number of tables of dishes with c > 0 customers, given the rest.

    p is the parent's probability of the dish, others the tables of the rest of
    its restaurant, before the tables in the round before.  t tables have the
    weight S(c, t) p^t times strength + d (others + k) for k = 0 .. t - 1.
    """
    t = np.ones(len(c), np.int64)
    logs = stirling_logs(d)
    order = np.argsort(c, kind="stable")
    for n in np.unique(c[(c > 1) & (c <= SMALL)]).tolist():
        own = order[np.searchsorted(c[order], n) : np.searchsorted(c[order], n, "right")]
        step = max(1, WEIGHTS_AT_A_TIME // n)
        for at in range(0, len(own), step):
            some = own[at : at + step]
            new = np.log(p[some, None] * (strength + d * (others[some, None] + np.arange(n))))
            weight = logs[n, 1 : n + 1] + np.cumsum(new, axis=1)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            t[some] += (weight[:, :-1] <= u[some, None] * weight[:, -1:]).sum(axis=1)
    many = np.flatnonzero(c > SMALL)
    if len(many):
        g = p[many] * (strength + d * (others[many] + (before[many] - 1) / 2))
        t[many] = np.clip(1 + _large(c[many], np.maximum(g, 1e-300), d, u[many], u2[many]), 1, c[many])
    return t


@dataclass
class Sums:
    """What all shards add up to after a round: tables of the contexts at hand, customers and tables of the parent."""

    contexts: np.ndarray | None
    customers: int
    tables: int


@dataclass
class Model:
    """Discounts, types of the training tokens, and for the contexts at hand their tokens, the sums of each round so far and their names.

    A context without a name has its number as name.
    """

    d: float
    d0: float
    types: int
    totals: np.ndarray | None
    rounds: list[Sums]
    seed: int
    names: np.ndarray | None = None

    def parent(self, served: np.ndarray, seated: np.ndarray, at: Sums) -> np.ndarray:
        """The parent's probability of words with so many customers and tables there."""
        new = (BASE_STRENGTH + self.d0 * at.tables) / (self.types + 1)
        return (served - self.d0 * seated + new) / (BASE_STRENGTH + at.customers)

    def seatings(self, word: np.ndarray, of: np.ndarray, u: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For the start and each further round: tables of the dishes, customers and tables of their words in the parent.

        word are hashes, of the word of each dish, u the number of its context, c > 0 its customers.
        """
        t = np.ones(len(c), np.int64)
        served = np.bincount(of, weights=t, minlength=len(word)).astype(np.int64)
        seated = (served > 0).astype(np.int64)
        yield t, served, seated
        live = np.flatnonzero(served)
        name = u if self.names is None else self.names[u]
        for i, at in enumerate(self.rounds):
            # the dish itself does not count among the rest
            left = 1 - t / served[of]
            new = (BASE_STRENGTH + self.d0 * at.tables) / (self.types + 1)
            p = ((served - self.d0 * seated)[of] * left + new) / (BASE_STRENGTH + at.customers - t)
            draw = [chance(word[of], name, 8 * (self.seed + 64 * i) + k) for k in (0, 1)]
            t = tables(c, p, at.contexts[u] - t, STRENGTH, self.d, *draw, t)
            served = np.bincount(of, weights=t, minlength=len(word)).astype(np.int64)
            draw = [chance(word[live], CONTEXTS, 8 * (self.seed + 64 * i) + k) for k in (2, 3)]
            own = seated[live]
            base = np.full(len(live), 1.0 / (self.types + 1))
            seated = np.zeros(len(word), np.int64)
            seated[live] = tables(served[live], base, at.tables - own, BASE_STRENGTH, self.d0, *draw, np.minimum(own, served[live]))
            yield t, served, seated


def _pairs(rows: pd.DataFrame, shards: int) -> tuple[np.ndarray, ...]:
    """Distinct words and contexts of a shard; word, context and training count of its distinct pairs; pair of each asked one."""
    words = [_unpack_hashes(w, shards, s) for w, s in zip(rows["words"], rows["shard"])]
    word = np.concatenate([np.repeat(w, _unpack(r, np.uint32)) for w, r in zip(words, rows["runs"])])
    ctx = np.concatenate([_unpack_hashes(n)[_unpack(x, np.uint32)] for n, x in zip(rows["names"], rows["contexts"])])
    train = np.concatenate([_unpack(x, np.uint32) for x in rows["counts"]]).astype(np.int64)
    order = np.lexsort((ctx, word))
    fresh_word = np.concatenate(([True], word[order][1:] != word[order][:-1]))
    fresh = fresh_word | np.concatenate(([True], ctx[order][1:] != ctx[order][:-1]))
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(fresh) - 1
    of = (np.cumsum(fresh_word) - 1)[fresh]
    names, u = np.unique(ctx[order][fresh], return_inverse=True)
    c = np.bincount(pair, weights=train, minlength=len(u)).astype(np.int64)
    return word[order][fresh_word], names, of, u, c, pair


def _counted(rows: pd.DataFrame, shards: int) -> list[dict]:
    """The pairs of a shard in one row, chunk -1, with its sums; the places of its pairs in a row for each chunk.

    The sums: counts of counts of both levels, trained words, pairs and tokens.
    """
    word, names, of, u, c, pair = _pairs(rows, shards)
    shard = int(rows["shard"].iloc[0])
    own, runs = _runs(word[of[c > 0]])
    sums = [*(int((c == k).sum()) for k in (1, 2)), *(int((runs == k).sum()) for k in (1, 2)), len(own), int((c > 0).sum()), int(c.sum())]
    packed = {
        "words": _pack_hashes(word, shards), "runs": _pack(np.bincount(of).astype(np.uint32)), "names": _pack_hashes(names),
        "contexts": _pack(u.astype(np.uint32)), "counts": _pack(c.astype(np.uint64)),
    }
    out, at = [{"shard": shard, "chunk": -1, **packed, "sums": sums}], 0
    for chunk, runs in zip(rows["chunk"], rows["runs"]):
        asked = pair[at : at + int(_unpack(runs, np.uint32).sum())]
        at += len(asked)
        out.append({"shard": shard, "chunk": chunk, "at": _pack_rising(asked)})
    return out


def _settled(shards: int, out: T.StructType):
    """Shards are counted; documents of a chunk stay as they are."""
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])

    def settled(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() >= 0:
            asked = rows.select(["shard", "chunk", "words", "runs", "names", "contexts", "counts"])
            return pa.Table.from_pylist(_counted(asked.to_pandas(), shards), schema)
        none = lambda f: pa.nulls(rows.num_rows, f.type)
        return pa.Table.from_arrays([rows[f.name] if f.name in rows.column_names else none(f) for f in schema], schema=schema)

    return settled


def _by_home(names: np.ndarray, homes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts in the order of their homes; the homes that have some, and where each begins among them."""
    home = (names % np.uint64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    there, first = np.unique(home[order], return_index=True)
    return order, there, first


def _loaded(row, shards: int) -> tuple[np.ndarray, ...]:
    word = _unpack_hashes(row["words"], shards, row["shard"])
    of = np.repeat(np.arange(len(word)), _unpack(row["runs"], np.uint32))
    return word, _unpack_hashes(row["names"]), of, _unpack(row["contexts"], np.uint32).astype(np.int64), _unpack(row["counts"], np.uint64).astype(np.int64)


def _sent(homes: int):
    """(home, shard, names, tokens, tables): the contexts of each shard by their homes, with what the shard has of them at the start."""

    def sent(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                _, names, _, u, c = _loaded(batch.iloc[i], homes)
                order, there, first = _by_home(names, homes)
                parts = [np.split(x[order], first[1:]) for x in (
                    np.bincount(u, weights=c, minlength=len(names)).astype(np.uint64), np.bincount(u[c > 0], minlength=len(names)).astype(np.uint64),
                )]
                own = [_pack_hashes(x, homes) for x in np.split(names[order], first[1:])]
                rows = [(int(h), batch.iloc[i]["shard"], n, *map(_pack, x)) for h, n, *x in zip(there, own, *parts)]
                yield pd.DataFrame(rows, columns=["home", "shard", "names", "tokens", "tables"])

    return sent


def _housed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each shard the places of its contexts among those of the home, with their sums over all shards."""
    # what all names of a home leave when divided is left out, which tells none apart
    names = [_unpack_hashes(x) for x in rows["names"]]
    _, place = np.unique(np.concatenate(names), return_inverse=True)
    cuts = np.cumsum([len(x) for x in names])[:-1]
    sums = []
    for column in ("tokens", "tables"):
        own = np.concatenate([_unpack(x, np.uint64) for x in rows[column]])
        sums.append(np.split(np.bincount(place, weights=own).astype(np.uint64)[place], cuts))
    out = [(key[0], s, _pack_rising(p), _pack(n), _pack(t)) for s, p, n, t in zip(rows["shard"], np.split(place, cuts), *sums)]
    return pd.DataFrame(out, columns=["home", "shard", "at", "tokens", "tables"])


def _local(model: Model, homes: int, names: np.ndarray, back: pd.DataFrame) -> Model:
    """The model with the sums of the contexts of a shard, as their homes have sent them back."""
    order, _, _ = _by_home(names, homes)

    def whole(column: str, rows: pd.DataFrame) -> np.ndarray:
        out = np.empty(len(names), np.int64)
        out[order] = np.concatenate([_unpack(x, np.uint64) for x in rows.sort_values("home")[column]])
        return out

    by = dict(list(back.groupby("round")))
    rounds = [replace(x, contexts=whole("tables", by[i])) for i, x in enumerate(model.rounds)]
    return replace(model, totals=whole("tokens", by[0]), rounds=rounds, names=names)


def _seated(model: Model, homes: int):
    """(home, shard, tables, customers, seated): tables of the contexts of a shard after one round more than the model has sums of."""

    def seated(state: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        word, names, of, u, c = _loaded(state.iloc[0], homes)
        live = np.flatnonzero(c)
        *_, (t, served, own) = _local(model, homes, names, back).seatings(word, of[live], u[live], c[live])
        order, there, first = _by_home(names, homes)
        sums = np.bincount(u[live], weights=t, minlength=len(names)).astype(np.uint64)
        out = [(int(h), state.iloc[0]["shard"], _pack(x), 0, 0) for h, x in zip(there, np.split(sums[order], first[1:]))]
        out[0] = (*out[0][:3], int(served.sum()), int(own.sum()))
        return pd.DataFrame(out, columns=["home", "shard", "tables", "customers", "seated"])

    return seated


def _added(number: int):
    """The tables of each context added up over all shards, for each shard that has it."""

    def added(places: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        rows = places.merge(sent, on=["home", "shard"])
        place = [_unpack_rising(x) for x in rows["at"]]
        own = np.concatenate([_unpack(x, np.uint64) for x in rows["tables"]])
        sums = np.bincount(np.concatenate(place), weights=own).astype(np.uint64)
        rows["tables"] = [_pack(sums[x]) for x in place]
        return rows.assign(round=number, tokens=None)[["round", "home", "shard", "tokens", "tables", "customers", "seated"]]

    return added


def predictions(model: Model, word: np.ndarray, of: np.ndarray, u: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The probability of each pair, c = 0 among them, averaged over the last rounds.

    model.rounds has the sums of the start and of every round.
    """
    live = np.flatnonzero(c)
    before = replace(model, rounds=model.rounds[:-1])
    p, n = np.zeros(len(u)), min(SAMPLES, len(model.rounds) - 1)
    for i, (t, served, seated) in enumerate(before.seatings(word, of[live], u[live], c[live])):
        if i >= len(model.rounds) - n:
            at, direct = model.rounds[i], np.zeros(len(u))
            direct[live] = c[live] - model.d * t
            new = (STRENGTH + model.d * at.contexts[u]) * model.parent(served, seated, at)[of]
            p += (direct + new) / (STRENGTH + model.totals[u]) / n
    return p


def _answered(model: Model, homes: int):
    def answered(state: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        word, names, of, u, c = _loaded(state[state["chunk"] < 0].iloc[0], homes)
        p = np.log10(predictions(_local(model, homes, names, back), word, of, u, c)).astype(np.float32)
        count = np.bincount(of, weights=c, minlength=len(word)).astype(np.int64)[of]
        asked = state[state["chunk"] >= 0]
        out = [(_key(chunk), shard, _pack(p[own]), _pack(count[own])) for chunk, shard, own in zip(asked["chunk"], asked["shard"], map(_unpack_rising, asked["at"]))]
        return pd.DataFrame(out, columns=["key", "shard", "logs", "count"])

    return answered


def _kept(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """Writes df to the shared folder in buckets of a key and reads it back, so that it meets others on that key where it lies."""
    spark, table = df.sparkSession, f"snagline_{name}_{uuid.uuid4().hex}"
    df.write.option("path", f"{shared_dir(spark)}/{table}").bucketBy(buckets, by).format("parquet").saveAsTable(table)
    read = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay
    return read


def _scored(types: int, n_train: int):
    def scored(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("shard")
        whole = lambda c, kind: np.concatenate([_unpack(x, kind) for x in answers[c]])
        logp, count = whole("logs", np.float32).astype(float), whole("count", np.int64)
        base = np.log10((count + 0.1) / (n_train + 0.1 * (types + 1)))
        out = []
        for steps, times in zip(docs["steps"], docs["times"]):
            at, n = _unpack_rising(steps), _unpack(times, np.uint32).astype(float)
            out.append((int(n[count[at] > 0].sum()), n_train, float(base[at] @ n), float(logp[at] @ n)))
        made = pd.DataFrame(out, columns=["n_known", "train_tokens", "base_score", "score"])
        kept = docs[["_id", "held_out", "n_tokens"]].reset_index(drop=True)
        return pd.concat([kept, made], axis=1)

    return scored


def score_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 11, chunk_tokens: int = CHUNK_TOKENS
) -> DataFrame:
    """One row per document with its log10 probability under the model.

    Learns from the documents whose crc32 of doc_id (as text) modulo 10 is not
    0 (a null doc_id is learned from).  A-Z are lower-cased; tokens are words of
    anything but ASCII white space, and one end.  A null or empty text is its
    end alone.  base_score is the additive unigram score over the same tokens.
    Without any training document every probability is that of the uniform
    base.  Repeated rows stay, and each counts; other columns are not read.  An
    empty table gives no rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(False))
    rows = docs.select(F.col(doc_id).alias("_id"), held.alias("held_out"), text_of(text).alias("text"))
    own = [T.StructField("shard", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("_id", rows.schema["_id"].dataType)]
    fields = "held_out boolean, n_tokens long, steps binary, times binary, words binary, runs binary, names binary, contexts binary, counts binary"
    out = T.StructType([*own, *T.StructType.fromDDL(fields).fields])
    kept = T.StructType([*out.fields, *T.StructType.fromDDL("sums array<long>, at binary").fields])
    shards = shuffle_partitions(spark)
    encoded = rows.mapInArrow(_encode(shards, out, chunk_tokens), out)
    settled = _kept(encoded.groupBy("shard").applyInArrow(_settled(shards, kept), kept), "settled", "shard", shards)
    state = settled.where("shard >= 0").select("shard", "chunk", "words", "runs", "names", "contexts", "counts", "sums", "at")
    pairs = state.where("chunk < 0").select("shard", "words", "runs", "names", "contexts", "counts")
    first = state.where("chunk < 0").agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in range(7)]).first()
    sent = pairs.mapInPandas(_sent(shards), "home int, shard long, names binary, tokens binary, tables binary")
    homes = _kept(sent.groupBy("home").applyInPandas(_housed, "home int, shard long, at binary, tokens binary, tables binary"), "homes", "home", shards)
    places = homes.select("home", "shard", "at").groupBy("home")
    model = Model(discount_of(*first[:2]), discount_of(*first[2:4]), first[4], None, [Sums(None, first[5], first[4])], seed)
    back = homes.select(F.lit(0).alias("round"), "home", "shard", "tokens", "tables")
    for i in range(1, ROUNDS + 1):
        seated = pairs.groupBy("shard").cogroup(back.groupBy("shard")).applyInPandas(
            _seated(model, shards), "home int, shard long, tables binary, customers long, seated long"
        )
        added = stored(places.cogroup(seated.groupBy("home")).applyInPandas(
            _added(i), "round int, home int, shard long, tokens binary, tables binary, customers long, seated long"
        ), "round")
        numbers = added.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("customers", "seated")]).first()
        model = replace(model, rounds=[*model.rounds, Sums(None, *numbers)])
        back = back.unionByName(added.drop("customers", "seated"))
    answers = state.groupBy("shard").cogroup(back.groupBy("shard")).applyInPandas(
        _answered(model, shards), "key long, shard long, logs binary, count binary"
    )
    kind = rows.schema["_id"].dataType.simpleString()
    whole = settled.where("shard < 0").select("shard", "_id", "held_out", "n_tokens", "steps", "times").groupBy("shard")
    scored = whole.cogroup(answers.groupBy("key")).applyInPandas(
        _scored(first[4], first[6]),
        f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scored.withColumnRenamed("_id", doc_id)
