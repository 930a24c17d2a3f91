"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints that can differ in a few bits only are brought together in
blocks.  Within a block they are sorted by Gray rank, so that neighbours share
many bits; groups of neighbours become nodes that hold the bits all of them
share (a mask and a pattern), and each level up holds what its groups share in
turn.  A search goes down from the top, adds up the differences on the bits
that each node has in addition to its parent, and drops a whole group as soon
as the sum exceeds the radius.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import LOWER_BYTES, add_text_columns, distinct, shuffle_partitions, stored
from snagline.llm.components import connected_components

SEED = 42
#: Children of a node.
FAN = 8
#: Buckets above this many fingerprints are divided by 16 more equal bits.
SPLIT_AT = 4096
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; none for an empty text."""
    tokens = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    ends = (ends[len(tokens) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends)], dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit set where more than half of the hashes set it; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str, keep: list[str], words: int) -> DataFrame:
    """The columns in keep and fp, the signed 64-bit fingerprint of the whole text."""
    return add_text_columns(docs, text, keep, "fp long", lambda: lambda t: (signed(simhash(shingle_hashes(t, words))),))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the order in which neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy of shared masked bit patterns over fingerprints in Gray order.

    levels[0] are the fingerprints themselves; node i of a level has the
    nodes i * FAN .. i * FAN + FAN - 1 of the level below as children.
    """

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        ones, zeros = codes[self.order], ~codes[self.order]
        self.levels = []
        while True:
            mask = ones | zeros
            self.levels.append((ones & mask, mask))
            if len(mask) <= FAN:
                break
            starts = np.arange(0, len(mask), FAN)
            # bits that are one in all below, and bits that are zero in all below
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, code) of indexes at most radius bits apart."""
        pattern, mask = self.levels[-1]
        q, node = (x.ravel() for x in np.indices((len(queries), len(mask))))
        known = np.zeros(len(q), np.uint64)
        gone = np.zeros(len(q), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[depth]
            more = mask[node] & ~known
            gone = gone + np.bitwise_count((queries[q] ^ pattern[node]) & more)
            stay = gone <= radius
            q, node, gone = q[stay], node[stay], gone[stay]
            if depth == 0:
                break
            known = np.repeat(mask[node], FAN)
            q, gone = np.repeat(q, FAN), np.repeat(gone, FAN)
            node = (node[:, None] * FAN + np.arange(FAN)).ravel()
            there = node < len(self.levels[depth - 1][1])
            q, node, gone, known = q[there], node[there], gone[there], known[there]
        return q, self.order[node]


class Forest:
    """Union-find over 0..n-1 whose roots are the least members."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1)[a != b], axis=0)
        for x, y in pairs.tolist():
            x, y = self.find(x), self.find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)
        self.flatten()

    def flatten(self) -> None:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up


def linked_in_block(codes: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct codes, the index of its component's first member."""
    index, forest = GrayIndex(codes), Forest(len(codes))
    step = max(64, 2_000_000 // max(1, len(codes)))
    for at in range(0, len(codes), step):
        q, found = index.search(codes[at : at + step], radius)
        forest.add(q + at, found)
    return forest.root


def grouped_rows(batches: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups from batches that are sorted by key."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        keys = batch[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(batch)]))):
            part = batch.iloc[a:b]
            if held and held[0][key].iloc[0] != part[key].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            if len(part):
                held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _links(radius: int):
    def links(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in grouped_rows(batches, "bucket"):
            codes = distinct(rows["fp"].to_numpy(np.int64).view(np.uint64))
            if len(codes) > 1:
                root = linked_in_block(codes, radius)
                own = np.flatnonzero(root != np.arange(len(codes)))
                yield pd.DataFrame({"a": codes[own].view(np.int64), "b": codes[root[own]].view(np.int64)})

    return links


def _buckets(fps: DataFrame, column: str, offset: int, width: int, salt: list) -> DataFrame:
    """One row for each two of four segments: two of them are equal in any two
    fingerprints that differ in at most two bits."""
    each = [
        F.shiftrightunsigned(F.col(column), offset + width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(4)
    ]
    keys = [F.xxhash64(F.lit(4 * i + j), *salt, each[i], each[j]) for i in range(4) for j in range(i + 1, 4)]
    return fps.select("fp", *salt, F.explode(F.array(*keys)).alias("bucket"))


def near_links(fps: DataFrame, radius: int = 2, split_at: int = SPLIT_AT) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints at most radius (0 to 2) bits apart.

    Each fingerprint goes to six buckets by 32 of its bits.  A bucket of more
    than split_at fingerprints is divided in the same way by the segments of
    its 64 bits cut in sixteenths, until 48 bits are equal; such a bucket holds
    65,536 fingerprints at most, so no task holds an unbounded group.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    first = _buckets(fps.select("fp").distinct(), "fp", 0, 16, [])
    first = stored(first, "buckets")
    sizes = first.groupBy("bucket").count().where("count > 1")
    small = first.join(sizes.where(F.col("count") <= split_at), "bucket", "left_semi").select("bucket", "fp")
    large = first.join(sizes.where(F.col("count") > split_at), "bucket", "left_semi")
    # the finer segments: four bits of each of the four 16-bit segments
    nibbles = [
        F.concat(*[F.hex(F.shiftrightunsigned("fp", 16 * s + 4 * i).bitwiseAND(F.lit(15))) for s in range(4)])
        for i in range(4)
    ]
    keys = [F.xxhash64(F.lit(4 * i + j), "bucket", nibbles[i], nibbles[j]) for i in range(4) for j in range(i + 1, 4)]
    finer = large.select(F.explode(F.array(*keys)).alias("bucket"), "fp")
    dealt = small.unionAll(finer).repartition(shuffle_partitions(fps.sparkSession), "bucket")
    return dealt.sortWithinPartitions("bucket").mapInPandas(_links(radius), "a long, b long").distinct()


def simhash_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, radius: int = 2
) -> DataFrame:
    """One row per document: its SimHash and its component of linked fingerprints.

    A-Z are lower-cased; words are anything but ASCII white space; a text of
    fewer words than a shingle is one shingle, and a text without words (null,
    empty) has fingerprint zero, linked like any other.  component_id is the
    smallest doc_id that can be reached; null doc_ids are passed over, so it is
    null only where all are.  Repeated rows give repeated rows.  Other columns
    are not read.  An empty table gives no rows.

    Returns doc_id, fingerprint (16 hex digits), component_id.
    """
    rows = stored(fingerprints(docs, text, [doc_id], words), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min(doc_id).alias("least")), "distinct")
    roots = connected_components(near_links(distinct, radius, SPLIT_AT))
    marked = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    marked = marked.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = marked.join(ids, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(
        F.col(doc_id).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
