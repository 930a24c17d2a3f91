"""Fuzzy line deduplication by MinHash."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import add_text_columns, distinct, stored, texts_of
from snagline.llm.setlink import band_keys, id_filter, mixed, passing, similar_components

#: Characters of a shingle; bands and rows of a signature.
CHARS, BANDS, ROWS = 5, 14, 6
SIMILAR = 0.8
#: Characters whose shingles are hashed at a time.
BLOCK_CHARS = 150_000
#: Lines that a task remembers as seen.
SEEN = 1_000_000
_WHITE = " \t\n\r\x0b\x0c"


def stripped_lines(text: str) -> list[str]:
    return [line.strip(_WHITE) for line in text.split("\n")]


def line_ids(lines: list[str]) -> np.ndarray:
    """128 bits of each line, as two signed numbers; zeros for a blank line, which is never a duplicate."""
    digest = xxhash.xxh3_128_digest
    whole = b"".join([digest(line.encode("utf-8", "surrogatepass")) if line else bytes(16) for line in lines])
    return np.frombuffer(whole, ">i8").astype(np.int64).reshape(-1, 2)


def shingles(lines: list[str], chars: int = CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Scrambled hashes of the character shingles of all lines, and their line.

    A line shorter than a shingle is padded to one.  Lines must not be empty.
    """
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    if len(lines) and lengths.min() < chars:
        lines = [line.ljust(chars, "\0") for line in lines]
        lengths = np.maximum(lengths, chars)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(len(codes) - chars + 1, 0)
    rolling = codes[:n].copy()
    for i in range(1, chars):
        rolling *= np.uint64(0x100000001B3)
        rolling += codes[i : i + n]
    # the last places of a line begin shingles that reach into the next one
    inside = np.ones(len(codes), bool)
    inside[(np.cumsum(lengths)[:, None] - np.arange(1, chars)).ravel()] = False
    return mixed(rolling[inside[:n]]), np.repeat(np.arange(len(lines)), lengths - chars + 1)


def _ids():
    return lambda text: tuple(line_ids(stripped_lines(text)).T)


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, keys) of the lines that this task has not just seen, some thousand lines at a time."""
    seen: set[int] = set()
    new: dict[int, str] = {}

    def rows() -> pa.RecordBatch:
        values, owner = shingles(list(new.values()))
        keys = band_keys(values, owner, len(new), BANDS, ROWS).view(np.int64)
        ends = np.arange(0, keys.size + 1, BANDS, dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(new), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], ["id", "keys"]
        )

    size = 0
    for batch in batches:
        for text in texts_of(batch.column(0)):
            lines = stripped_lines(text or "")
            for line, i in zip(lines, line_ids(lines)[:, 0].tolist()):
                if line and i not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(i)
                    new[i] = line
                    size += len(line)
            if size > BLOCK_CHARS:
                yield rows()
                new, size = {}, 0
    if new:
        yield rows()


def _sets(wanted: Broadcast):
    def maker():
        seen: set[int] = set()

        def sets(text: str) -> tuple:
            if len(seen) > SEEN:
                seen.clear()
            new: dict[int, tuple] = {}
            lines = stripped_lines(text)
            ids = line_ids(lines)
            for at in np.flatnonzero(passing(wanted.value, ids[:, 0])).tolist():
                i, line = int(ids[at, 0]), lines[at]
                if line and i not in seen:
                    new[i] = (int(ids[at, 1]), line.encode("utf-8", "surrogatepass"))
            seen.update(new)
            return list(new), [i2 for i2, _ in new.values()], [line for _, line in new.values()]

        return sets

    return maker


def line_sets(items: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all lines, from their UTF-8 bytes, as number << 32 | value in one sorted array, and their counts."""
    values, owner = shingles([x.decode("utf-8", "surrogatepass") for x in items])
    values >>= np.uint64(32)
    values |= owner.astype(np.uint64) << np.uint64(32)
    cells = distinct(values)
    return cells, np.bincount((cells >> np.uint64(32)).view(np.int64), minlength=len(items))


def duplicate_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """One row per document with the lines that fuzzy deduplication drops.

    A line is what stands between line feeds, without white space at its ends.
    Lines are linked when the Jaccard similarity of their sets of 5-character
    shingles is at least `similar`; of each connected component one line of the
    whole corpus stays, the first by doc_id (null first), row and place.  Blank
    lines are never dropped.  A null or empty text has no lines.  Rows that
    repeat a doc_id count as documents of their own.  Other columns are not
    read.  An empty table gives no rows.

    Returns doc_id, n_lines (not blank), n_dropped, dropped (places of dropped
    lines, from 0), row.
    """
    found = add_text_columns(docs, text, [doc_id], "ids array<long>, ids2 array<long>", _ids)
    rows = stored(found.withColumn("row", F.monotonically_increasing_id()), "lines")
    def sets_of(ids: DataFrame) -> DataFrame:
        """Whole lines travel, which are smaller than their sets."""
        lines = add_text_columns(docs, text, [], "id array<long>, id2 array<long>, items array<binary>", _sets(id_filter(ids)))
        each = lines.select(F.inline(F.arrays_zip("id", "id2", "items"))).dropDuplicates(["id"])
        return each.select("id", "id2", "items", F.lit(0).cast("long").alias("fp"))

    roots = similar_components(docs.select(F.col(f"`{text}`")), sets_of, similar, sets_from=line_sets, signatures=_signatures)
    each = F.arrays_zip(F.col("ids").alias("id"), F.col("ids2").alias("id2"))
    places = rows.select(F.col(doc_id).alias("doc_id"), "row", F.posexplode(each).alias("place", "id")).where("id.id <> 0 or id.id2 <> 0")
    labelled = stored(
        places.join(roots, places["id"] == roots["node"], "left").select("doc_id", "row", "place", F.coalesce("root", "id").alias("label")), "labels"
    )
    at = F.struct("doc_id", "row", "place")
    first = labelled.groupBy("label").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1")
    # written, so that the join below reads both sides from a shuffle, and a label with very many lines can be split
    first = stored(first.select("label", F.col("first.row").alias("first_row"), F.col("first.place").alias("first_place")), "first")
    gone = labelled.join(first, "label").where("row <> first_row or place <> first_place")
    gone = gone.groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("dropped"))
    return rows.join(gone, "row", "left").select(
        F.col(doc_id).alias("doc_id"),
        F.size(F.filter("ids", lambda x: x != 0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
        "row",
    )


def without_lines(text, dropped):
    """The text (a column) without the lines at the given places (a column)."""
    lines = F.split(text, "\n")
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    left = F.filter(numbered, lambda x: ~F.array_contains(dropped, x["i"]))
    return F.array_join(F.transform(left, lambda x: x["line"]), "\n")
