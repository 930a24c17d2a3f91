"""Exact duplicates by counting quotient filters and byte verification.

Each input partition builds a counting quotient filter over 64-bit
fingerprints: the high bits (the quotient) choose a run, the low bits (the
remainder) are kept sorted within the run, each with a count.  A filter is cut
by its highest bits into slices; the slices of all partitions that cover the
same quotients merge by their sorted remainders, and no bit of a fingerprint is
lost on the way.  Fingerprints whose merged count exceeds one go to byte
verification, where whole texts are the grouping key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snagline.llm.common import LOWER_BYTES, add_text_columns, broadcast_if_small, free_name, stored


@dataclass
class CountingQuotientFilter:
    """Sorted remainders with counts, in runs by quotient.

    slice_bits high bits name the slice, quotient_bits more the run, and the
    rest is the remainder.  runs holds the length of each run.
    """

    slice_bits: int
    quotient_bits: int
    runs: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @staticmethod
    def _quotient_bits(n: int) -> int:
        return max(0, int(n).bit_length())

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, slice_bits: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints (unsigned) of one slice."""
        q = cls._quotient_bits(len(fingerprints))
        low = np.uint64(64 - slice_bits - q)
        kept = fingerprints & np.uint64((1 << (64 - slice_bits)) - 1)
        quotients = (kept >> low).astype(np.int64)
        return cls(
            slice_bits,
            q,
            np.bincount(quotients, minlength=1 << q).astype(np.uint32),
            kept & np.uint64((1 << int(low)) - 1),
            counts.astype(np.uint64),
        )

    def fingerprints(self, slice_id: int) -> np.ndarray:
        low = np.uint64(64 - self.slice_bits - self.quotient_bits)
        quotients = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        high = np.uint64(slice_id << (64 - self.slice_bits)) if self.slice_bits else np.uint64(0)
        return high | (quotients << low) | self.remainders

    def to_bytes(self) -> bytes:
        head = np.array([self.slice_bits, self.quotient_bits, len(self.remainders)], dtype=np.uint32)
        return b"".join(x.tobytes() for x in (head, self.runs, self.remainders, self.counts))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        s, q, n = (int(x) for x in np.frombuffer(data, np.uint32, 3))
        at = 12
        runs = np.frombuffer(data, np.uint32, 1 << q, at)
        at += runs.nbytes
        remainders = np.frombuffer(data, np.uint64, n, at)
        return cls(s, q, runs, remainders, np.frombuffer(data, np.uint64, n, at + remainders.nbytes))


def merged(fingerprints: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merges sorted fingerprints and adds the counts of equal ones."""
    every, n = np.concatenate(fingerprints), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(n, first) if len(first) else n


def _build(slice_bits: int):
    def build(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            f, n = np.unique(batch["fp"].to_numpy(np.int64).view(np.uint64), return_counts=True)
            held = merged([held[0], f], [held[1], n.astype(np.uint64)])
        f, n = held
        slices = (f >> np.uint64(64 - slice_bits)).astype(np.int64)
        names, starts = np.unique(slices, return_index=True)
        ends = np.append(starts[1:], len(f))
        for name, a, b in zip(names, starts, ends):
            one = CountingQuotientFilter.build(f[a:b], n[a:b], slice_bits)
            yield pd.DataFrame({"slice": [int(name)], "filter": [one.to_bytes()]})

    return build


def _repeated(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    filters = [CountingQuotientFilter.from_bytes(x) for x in rows["filter"]]
    f, n = merged([x.fingerprints(int(key[0])) for x in filters], [x.counts for x in filters])
    return pd.DataFrame({"fp": f[n > 1].view(np.int64), "n": n[n > 1].astype(np.int64)})


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fp, n) for the values of the column fp that occur n > 1 times.

    The number of slices follows the number of input partitions, so that a
    merging task holds a bounded share of the fingerprints.
    """
    parts = fingerprints.rdd.getNumPartitions()
    slice_bits = min(20, max(6, (parts // 32).bit_length()))
    filters = fingerprints.select("fp").mapInPandas(_build(slice_bits), "slice long, filter binary")
    return filters.groupBy("slice").applyInPandas(_repeated, "fp long, n long")


def _keys(with_text: bool):
    def maker():
        def keys(text: str) -> tuple:
            norm = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES)
            fp = xxhash.xxh64_intdigest(norm)
            made = (fp - (1 << 64) if fp >> 63 else fp, hashlib.sha256(norm).hexdigest())
            return (*made, norm.decode("utf-8", "surrogatepass")) if with_text else made

        return keys

    return maker


def _groups(docs: DataFrame, rows: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(fp, text_sha256, keep_id, group_size) of the texts that occur more than once."""
    repeated = stored(repeated_fingerprints(rows).select("fp"), "repeated")
    whole = add_text_columns(docs, text, [doc_id], "fp long, text_sha256 string, norm string", _keys(True))
    some = whole.join(broadcast_if_small(repeated), "fp", "left_semi")
    # whole texts are the key: equal bytes, not equal fingerprints, make a group
    groups = some.groupBy("fp", "text_sha256", "norm").agg(
        F.max(F.col(doc_id)).alias("keep_id"), F.count("*").alias("group_size")
    )
    return stored(groups.where("group_size > 1").drop("norm"), "groups")


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document with its group of equal texts.

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty, and all empty texts form one group.  The row with the largest
    doc_id of a group stays (a null doc_id is smaller than any); where several
    rows share that doc_id and text, exactly one of them stays.  Other columns
    of docs, of whatever name, are not read.  An empty table gives no rows.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    rows = stored(add_text_columns(docs, text, [doc_id], "fp long, text_sha256 string", _keys(False)), "keys")
    groups = _groups(docs, rows, text, doc_id)
    single = F.col("group_size").isNull()
    found = rows.join(groups, ["fp", "text_sha256"], "left").select(
        F.col(doc_id).alias("doc_id"),
        F.when(single, F.col(doc_id)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
    )
    # only rows that repeat both doc_id and text share a window
    rank = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("group_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (rank == 1)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, with their columns, that exact_duplicates keeps.

    Columns of docs may have any name.  An empty table gives no rows.
    """
    own, gone_id, gone_sha, keep_id, fp = (free_name(docs, x) for x in ("own_sha", "gone_id", "gone_sha", "keep_id", "fp"))
    gone = stored(exact_duplicates(docs, text, doc_id).where("not kept"), "gone")
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha), F.col("keep_id").alias(keep_id))
    marked = add_text_columns(docs, text, docs.columns, f"`{fp}` long, `{own}` string", _keys(False)).drop(fp)
    last = F.col(gone_id).eqNullSafe(F.col(keep_id))
    # rows below the group's largest doc_id go here; repeats of the largest itself below
    same = (F.col(own) == F.col(gone_sha)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(gone_id))
    # whole texts are dealt once and not sorted, however few rows go, so that disk grows as the input does
    left = marked.join(gone.where(~last).distinct().hint("shuffle_hash"), same, "left_anti")
    if not gone.where(last).isEmpty():
        left = left.dropDuplicates([doc_id, own])
    return left.drop(own)
