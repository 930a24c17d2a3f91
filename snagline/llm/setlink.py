"""Exact Jaccard links between sets that share a MinHash band.

Signatures are one-permutation MinHash; bands of it are bucket keys.  Keys and
ids travel once, packed by shards of the buckets, and only buckets with two
members or more come out.  Buckets with the same members are examined once.
Within a bucket, pairs that are not yet connected are compared on their whole
sets, so what comes out is a set of edges that joins all sets which are similar
enough and meet in a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import shuffle_partitions, stored
from snagline.llm.components import connected_components
from snagline.llm.simhash import Forest, GrayIndex, grouped_rows

#: Members compared in one task at a time.
CHUNK = 2048
#: Keys that a task packs at a time (16 bytes each), and shards that share a hot bucket.
PACKED_KEYS, HOT_SHARDS = 4_000_000, 64
#: Bits of the broadcast filter of ids: 16 MB, whatever the number of ids.
FILTER_BITS = 1 << 27
#: Values looked up at a time, and bytes of items whose groups are compared together.
PAIR_VALUES, BLOCK_BYTES = 2_000_000, 4_000_000
#: Steps after which a group of so many members goes on by bits, if they take so many bytes at most; bytes made at a time.
FEW_STEPS, DENSE, DENSE_BYTES, MADE_BYTES = 3, 24, 32 << 20, 4 << 20
Signatures = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Times that a small set is hashed anew for its empty bins.
REHASHED = 12


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shift, xor, multiply)."""
    y = x >> np.uint64(32)
    y ^= x
    y *= np.uint64(0xD6E8FEB86659FD93)
    shifted = y >> np.uint64(29)
    y ^= shifted
    y *= np.uint64(0x94D049BB133111EB)
    np.right_shift(y, np.uint64(32), out=shifted)
    y ^= shifted
    return y


def band_keys(values: np.ndarray, owner: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """(n, bands) keys of n sets; values are scrambled hashes, owner (ascending) their set."""
    bins = bands * rows

    def cells(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        cell = values >> np.uint64(40)
        cell *= np.uint64(bins)
        cell >>= np.uint64(24)
        cell = cell.view(np.int64)
        cell += owner * bins
        return cell

    flat = np.full(n * bins, _EMPTY)
    np.minimum.at(flat, cells(values, owner), values)
    # empty bins of a set of few values are filled by hashing it anew, a few times
    empty = flat == _EMPTY
    left = np.flatnonzero(empty)
    left = left[(np.bincount(owner, minlength=n) < 4 * bins)[left // bins]]
    for again in range(1, REHASHED + 1):
        if not len(left):
            break
        few = np.zeros(n, bool)
        few[left // bins] = True
        own = few[owner]
        values, owner = values[own], owner[own]
        more = mixed(values + np.uint64(again))
        at = cells(more, owner)
        asked = empty[at]
        np.minimum.at(flat, at[asked], more[asked])
        filled = flat[left] != _EMPTY
        empty[left[filled]] = False
        left = left[~filled]
    sig = flat.reshape(n, bins)
    # what is empty still takes the value of the next full bin, scrambled by the distance
    full, step = sig.copy(), 1
    row, column = np.nonzero(full == _EMPTY)
    while len(row) and step < bins:
        take = full[row, (column + step) % bins]
        found = take != _EMPTY
        sig[row[found], column[found]] = mixed(take[found] + np.uint64(step))
        row, column = row[~found], column[~found]
        step += 1
    # the bins of a band lie apart, so that bins which borrow do not borrow the same value
    sig = sig.reshape(n, rows, bands)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for r in range(rows):
        keys *= np.uint64(0x9E3779B97F4A7C15)
        keys += sig[:, r]
    return mixed(keys)


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return both >= least * (small + large - both) - 1e-9


def _compare(sets: list[np.ndarray], pairs: Iterable[tuple[int, int]], least: float, edges: list, forest: Forest) -> None:
    for i, j in pairs:
        a, b = forest.find(i), forest.find(j)
        if a != b and _similar(sets[i], sets[j], least):
            forest.root[max(a, b)] = min(a, b)
            edges.append((i, j))


def _compare_rest(sets: list[np.ndarray], least: float, edges: list, forest: Forest) -> None:
    """Compares every pair that the proposed ones have not connected."""
    root = np.array([forest.find(i) for i in range(len(sets))])
    if (root == root[0]).all():
        return
    cells = _Cells(sets)
    for i in range(len(sets) - 1):
        apart = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        hit = apart[cells.similar(np.full(len(apart), i), apart, least)] if len(apart) else apart
        if len(hit):
            edges += [(i, j) for j in hit.tolist()]
            root[np.isin(root, root[hit])] = root[i]


def packed_sets(items: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in items]


class _Cells:
    """The values of many sets in one sorted array, for comparing many pairs at once.

    sets are arrays, or already one array of number << 32 | value, and the sizes.
    """

    def __init__(self, sets: list[np.ndarray] | tuple[np.ndarray, np.ndarray]):
        if isinstance(sets, tuple):
            self.cells, self.size = sets
            self.start = np.cumsum(self.size) - self.size
            return
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.start = np.cumsum(self.size) - self.size
        number = np.repeat(np.arange(len(sets), dtype=np.uint64), self.size)
        values = np.concatenate(sets).astype(np.uint64) if sets else np.empty(0, np.uint64)
        self.cells = (number << np.uint64(32)) | values

    def similar(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Which of the pairs of sets (a, b) have a Jaccard similarity of at least so much."""
        a, b = np.where(self.size[a] <= self.size[b], a, b), np.where(self.size[a] <= self.size[b], b, a)
        found = np.zeros(len(a), bool)
        left = np.flatnonzero(self.size[a] >= least * self.size[b])
        upto = np.cumsum(self.size[a[left]])
        begin = 0
        while begin < len(left):  # some values at a time
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIR_VALUES, "right")))
            now = left[begin:end]
            found[now] = self._reach(a[now], b[now], least)
            begin = end
        return found

    def _reach(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        size = self.size[a]
        pair = np.repeat(np.arange(len(a)), size)
        place = np.arange(len(pair)) + np.repeat(self.start[a] - np.cumsum(size) + size, size)
        wanted = self.cells[place]
        wanted &= np.uint64(0xFFFFFFFF)
        wanted |= np.repeat(b.astype(np.uint64) << np.uint64(32), size)
        at = np.minimum(np.searchsorted(self.cells, wanted), len(self.cells) - 1)
        both = np.bincount(pair[self.cells[at] == wanted], minlength=len(a))
        return both >= least * (size + self.size[b] - both) - 1e-9


def _common_bits(sets: _Cells, members: np.ndarray) -> np.ndarray | None:
    """A row of bits for each member, of the values that two members or more have; None where they take too much."""
    size = sets.size[members]
    owner = np.repeat(np.arange(len(members)), size)
    values = sets.cells[np.arange(len(owner)) + np.repeat(sets.start[members] - np.cumsum(size) + size, size)].astype(np.uint32)
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    fresh = np.append(True, values[1:] != values[:-1])
    shared = ~(fresh & np.append(fresh[1:], True))
    fresh &= shared
    width = -(-int(fresh.sum()) // 64) * 8
    if width * len(members) > DENSE_BYTES:
        return None
    owner, column = owner[shared], (np.cumsum(fresh) - 1)[shared]
    step = max(1, MADE_BYTES // max(1, 8 * width))
    if step < len(members):
        by = np.argsort(owner, kind="stable")
        owner, column = owner[by], column[by]
    bits = np.zeros((len(members), width), np.uint8)
    for at in range(0, len(members), step):
        some = slice(*np.searchsorted(owner, (at, at + step))) if step < len(members) else slice(None)
        made = np.zeros((min(step, len(members) - at), 8 * width), bool)
        made[owner[some] - at, column[some]] = True
        bits[at : at + step] = np.packbits(made, axis=1)
    return bits.view(np.uint64)


def _dense_pairs(sets: _Cells, members: np.ndarray, reached: np.ndarray, least: float) -> list[np.ndarray] | None:
    """What linked_pairs has still to find for one group, whose sets meet in few words of bits instead of value by value."""
    bits, size = _common_bits(sets, members), sets.size[members]
    if bits is None:
        return None
    edges, queue, rest = [], np.flatnonzero(reached).tolist(), np.flatnonzero(~reached)
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        now = queue.pop()
        both = np.bitwise_count(bits[rest] & bits[now]).sum(axis=1, dtype=np.int64)
        small, large = np.minimum(size[rest], size[now]), np.maximum(size[rest], size[now])
        ok = (small >= least * large) & (both >= least * (small + large - both) - 1e-9)
        hit, rest = rest[ok], rest[~ok]
        edges.append(np.stack((np.full(len(hit), now), hit), axis=1))
        queue.extend(hit.tolist())
    return edges


def linked_pairs(group: np.ndarray, number: np.ndarray, cells: _Cells, least: float) -> np.ndarray:
    """Edges (place, place) that connect, in each group, what its similar sets connect.

    group is ascending, number the set of each place.  In each step every group
    compares one member that it has reached with all that it has not; groups
    that are large after a few steps go on by the bits of values that several
    members have.
    """
    place, reached, edges, step = np.arange(len(group)), np.zeros(len(group), bool), [], 0
    while len(place):
        # a group whose members are all reached is done; one without reached members takes its first
        order = np.lexsort((~reached, group[place]))
        place, reached = place[order], reached[order]
        g = group[place]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        n = np.diff(np.append(first, len(g)))
        if step == FEW_STEPS and (n >= DENSE).any():
            stays = np.ones(len(place), bool)
            for at, end in zip(first[n >= DENSE].tolist(), (first + n)[n >= DENSE].tolist()):
                found = _dense_pairs(cells, number[place[at:end]], reached[at:end], least)
                if found is not None:
                    edges += [place[at:end][x] for x in found]
                    stays[at:end] = False
            place, reached, step = place[stays], reached[stays], step + 1
            continue
        of = np.repeat(np.arange(len(first)), n)
        now = place[first][of]
        reached[first] = True
        asked = np.flatnonzero(~reached)
        ok = cells.similar(number[now[asked]], number[place[asked]], least)
        hit = asked[ok]
        edges.append(np.stack((now[hit], place[hit]), axis=1))
        open_groups = np.zeros(len(first), bool)
        reached[hit] = True
        open_groups[of[~reached]] = True
        stays = open_groups[of]
        stays[first] = False
        place, reached, step = place[stays], reached[stays], step + 1
    return np.concatenate(edges) if edges else np.empty((0, 2), np.int64)


def grouped_blocks(batches: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups from batches that are sorted by key, several small ones together."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        keys = batch[key].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        weight, block = np.cumsum(batch["items"].str.len().to_numpy()), 0
        if held and len(keys) and held[-1][key].iloc[-1] != keys[0]:
            yield pd.concat(held)
            held = []
        begin = 0
        for start in starts[1:].tolist():
            if weight[start - 1] - block > BLOCK_BYTES or held:
                yield pd.concat([*held, batch.iloc[begin:start]])
                held, begin, block = [], start, weight[start - 1]
        if begin < len(keys):
            held.append(batch.iloc[begin:])
    if held:
        yield pd.concat(held)


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct pair (a, b), and the number of the pair at each place."""
    order = np.lexsort((b, a))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


def _linked(least: float, radius: int | None, sets_from: Callable[[pd.Series], list[np.ndarray]]):
    def named(rows: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        own, other = rows["id"].to_numpy(), rows["id2"].to_numpy()
        return pd.DataFrame({"a": own[i], "a2": other[i], "b": own[j], "b2": other[j]})

    def linked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if radius is None:
            for rows in grouped_blocks(batches, "key"):
                rows = rows.drop_duplicates(["key", "id", "id2"])
                first, number = _numbered(rows["id"].to_numpy(), rows["id2"].to_numpy())
                cells = _Cells(sets_from(rows["items"].iloc[first]))
                edges = number[linked_pairs(rows["key"].to_numpy(), number, cells, least)]
                yield named(rows, first[edges[:, 0]], first[edges[:, 1]])
            return
        for rows in grouped_rows(batches, "key"):
            rows = rows.drop_duplicates(["id", "id2"])
            sets = sets_from(rows["items"])
            edges, forest, n = [], Forest(len(sets)), len(sets)
            if n > 1:
                codes = rows["fp"].to_numpy(np.int64).view(np.uint64)
                index = GrayIndex(codes)
                for at in range(0, n, 256):
                    q, j = index.search(codes[at : at + 256], radius)
                    later = j < q + at
                    _compare(sets, zip((q[later] + at).tolist(), j[later].tolist()), least, edges, forest)
                _compare_rest(sets, least, edges, forest)
            i = np.array(edges, np.int64).reshape(-1, 2)
            yield named(rows, i[:, 0], i[:, 1])

    return linked


def _edges(tasks: DataFrame, sets_of, least: float, radius: int | None, sets_from) -> DataFrame:
    """Edges (a, b) between ids of 128 bits within each key of tasks (key, id)."""
    full = tasks.join(sets_of(tasks.select("id").distinct()), "id").select("key", "id", "id2", "items", "fp")
    dealt = full.repartition(shuffle_partitions(tasks.sparkSession), "key").sortWithinPartitions("key", "id")
    found = dealt.mapInPandas(_linked(least, radius, sets_from), "a long, a2 long, b long, b2 long").distinct()
    node = lambda x: F.struct(F.col(x).alias("id"), F.col(f"{x}2").alias("id2"))
    return stored(found.select(node("a").alias("a"), node("b").alias("b")), "links")


def _sorted_pairs(bucket: np.ndarray, id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs by bucket, then id; most buckets have one member, so only the others are sorted by both."""
    order = np.argsort(bucket)
    same = bucket[order[1:]] == bucket[order[:-1]]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(order) else order
    rest = order[tied]
    order[tied] = rest[np.lexsort((id[rest], bucket[rest]))]
    bucket, id = bucket[order], id[order]
    fresh = np.ones(len(bucket), bool)
    fresh[1:] = (bucket[1:] != bucket[:-1]) | (id[1:] != id[:-1])
    return bucket[fresh], id[fresh]


def _packed(shards: int, hot: int):
    """Rows (shard, buckets, ids, split) of the keys of a task, each pair once.

    A bucket that has hot members or more in one task is dealt to several
    shards by its members, and named in `split` there and at its own shard.
    """

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            bucket, id = _sorted_pairs(*(np.concatenate(x) for x in zip(*held)))
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            n = np.diff(np.append(first, len(bucket)))
            many = np.repeat(n >= hot, n)
            shard = bucket % np.uint64(shards)
            apart = np.flatnonzero(many)
            part = mixed(bucket[apart] + np.uint64(1) + mixed(id[apart]) % np.uint64(HOT_SHARDS))
            shard[apart] = part % np.uint64(shards)
            own = bucket[first[n >= hot]]
            marks = np.concatenate((own, bucket[apart])), np.concatenate((own % np.uint64(shards), shard[apart]))
            order = np.argsort(shard, kind="stable")
            bucket, id, shard = bucket[order], id[order], shard[order]
            names = np.unique(np.concatenate((shard, marks[1])))
            cuts = np.searchsorted(shard, names), np.searchsorted(shard, names, "right")
            parts = [(int(s), bucket[a:b].tobytes(), id[a:b].tobytes(), np.unique(marks[0][marks[1] == s]).tobytes() if len(own) else b"") for s, a, b in zip(names, *cuts)]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts), kinds)], ["shard", "buckets", "ids", "split"])

        for batch in batches:
            keys = batch.column(1)
            lengths = np.diff(keys.offsets.to_numpy())
            flat = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            if len(flat):
                held.append((flat, np.repeat(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), lengths)))
                size += len(flat)
            if size >= PACKED_KEYS:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    return packed


def _shared(chunk: int):
    """Rows (bucket, split, ids) for the buckets of a shard that have two members, or are split."""

    def shared(key: tuple, rows: pa.Table) -> pa.Table:
        whole = lambda c: np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint64)
        bucket, id = _sorted_pairs(whole("buckets"), whole("ids"))
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(bucket)))
        of = np.isin(bucket[first], np.unique(whole("split")))
        kept = (n > 1) | of
        members = id[np.repeat(kept, n)]
        name, n, of = bucket[first[kept]], n[kept], of[kept]
        # a bucket in as many parts as it takes, of about the same size
        parts = -(-n // chunk)
        place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.repeat(n // parts, parts) + (place < np.repeat(n % parts, parts))
        ends = np.append(0, np.cumsum(size)).astype(np.int32)
        columns = np.repeat(name, parts).view(np.int64), np.repeat(of | (n > chunk), parts)
        return pa.table([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(ends), pa.array(members.view(np.int64)))], ["bucket", "split", "ids"])

    return shared


def bucket_members(keys: DataFrame, chunk: int = CHUNK, signatures: Signatures | None = None) -> DataFrame:
    """(bucket, split, ids): the members of every bucket of two or more, in rows of chunk at most.

    keys has (id long, keys array<long>), repeats of an id allowed, or what
    signatures makes that of.  Shards follow the partitions of the input, so
    that one holds about as many keys as a task packs; a bucket that is hot in a
    task is divided over many shards.
    """
    shards = max(shuffle_partitions(keys.sparkSession), keys.rdd.getNumPartitions())
    pack = _packed(shards, chunk)
    run = pack if signatures is None else lambda batches: pack(signatures(batches))
    packed = keys.mapInArrow(run, "shard long, buckets binary, ids binary, split binary")
    return packed.groupBy("shard").applyInArrow(_shared(chunk), "bucket long, split boolean, ids array<long>")


def id_filter(ids: DataFrame, bits: int = FILTER_BITS) -> Broadcast:
    """A broadcast bitmap with the lowest bits of every id set; its size does not depend on the ids."""
    low = F.col("id").bitwiseAND(F.lit(bits - 1))
    part = ids.select(F.shiftright(low, 15).alias("part"), low.bitwiseAND(F.lit(32767)).alias("bit"))
    rows = part.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bitmap")).collect()  # bits / 32768 rows at most
    whole = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in rows:
        whole[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bitmap"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast(whole)


def passes(bitmap: np.ndarray, id: int) -> bool:
    low = id & (len(bitmap) * 8 - 1)
    return bool(bitmap[low >> 3] >> (low & 7) & 1)


def passing(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the ids may be in the set, as passes tells of one."""
    low = ids & (len(bitmap) * 8 - 1)
    return (bitmap[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)


def similar_components(
    keys: DataFrame, sets_of, least: float, radius: int | None = None, chunk: int = CHUNK, sets_from=packed_sets, *, signatures: Signatures | None = None
) -> DataFrame:
    """(node, root) for every set that is linked to a smaller one; both are structs (id, id2).

    keys has (id, keys array<long>), repeats of an id allowed, or what
    signatures makes that of, batch by batch.  sets_of(ids) gives (id, id2, items, fp) for the ids of a DataFrame, and perhaps for
    others, once each: id and id2 are 128 bits of the set, items are bytes of
    which sets_from makes its sorted distinct values (or the cells of all sets, without a radius), fp a SimHash.  With a
    radius the Gray-order index proposes the pairs of a bucket that are compared
    first; then, or without one, all pairs that are not connected yet are
    compared.

    Buckets of more than chunk members are divided into chunks.  If the members
    of such a bucket are not all connected after that, those outside its
    largest component are compared with every chunk.
    """
    groups = stored(bucket_members(keys, chunk, signatures), "buckets")
    once = groups.where("not split").groupBy("ids").agg(F.min("bucket").alias("key"))
    parts = groups.where("split").select("ids", F.xxhash64("bucket", F.element_at("ids", 1)).alias("key"), "bucket")
    tasks = once.select("key", F.explode("ids").alias("id")).unionAll(parts.select("key", F.explode("ids").alias("id")))
    tasks = stored(tasks, "tasks")
    edges = _edges(tasks, sets_of, least, radius, sets_from)
    roots = connected_components(edges)
    if parts.isEmpty():
        return roots
    members = parts.select("bucket", F.col("key").alias("chunk"), F.explode("ids").alias("id"))
    label = members.join(roots.select(F.col("node.id").alias("id"), "root"), "id", "left").select(
        "bucket", "chunk", "id", F.coalesce("root", F.struct("id", F.lit(None).cast("long").alias("id2"))).alias("root")
    )
    counts = label.groupBy("bucket", "root").count()
    main = counts.groupBy("bucket").agg(F.max_by("root", "count").alias("main"), F.sum("count").alias("all"))
    rest = label.join(main, "bucket").where("not root <=> main")
    pieces = F.ceil(F.col("all") / float(chunk))
    rest = stored(rest.select("bucket", "id", F.pmod(F.xxhash64("id"), pieces).alias("part")).distinct(), "rest")
    if rest.isEmpty():
        return roots
    every = rest.join(parts.select("bucket", F.col("key").alias("chunk")).distinct(), "bucket")
    against = members.join(rest.select("bucket", "part").distinct(), "bucket")
    columns = ["bucket", "part", "chunk", "id"]
    tasks = every.select(columns).unionAll(against.select(columns))
    tasks = stored(tasks.select(F.xxhash64("bucket", "part", "chunk").alias("key"), "id"), "rest-tasks")
    more = _edges(tasks, sets_of, least, radius, sets_from)
    return connected_components(edges.unionAll(more))
