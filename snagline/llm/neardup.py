"""Near-duplicate documents at a Jaccard similarity, by SimHash in Gray-order blocks.

Five-word shingles at similarity 0.8 put two fingerprints about ten bits apart,
too far for blocks by equal bits.  Here blocks are MinHash bands; within one the
Gray-order hierarchical index proposes the pairs whose SimHash differs in at
most RADIUS bits; they are compared first, on their whole shingle sets, and then
all pairs of the block that are not connected yet.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import LOWER_BYTES, add_text_columns, broadcast_if_small, distinct, free_name, stored
from snagline.llm.setlink import band_keys, id_filter, mixed, passes, similar_components
from snagline.llm.simhash import shingle_hashes, signed, simhash

WORDS, SIMILAR = 5, 0.8
#: Only the order of comparison depends on it: fingerprints of distinct shingles differ
#: in 9.7 bits on average at similarity 0.8, with a deviation of 2.9.
RADIUS = 20
BANDS, ROWS = 16, 5


def content_id(text: str) -> tuple[int, int]:
    """128 bits of the text with A-Z lower-cased, as two signed numbers."""
    whole = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES))
    return signed(whole >> 64), signed(whole & 0xFFFFFFFFFFFFFFFF)


def _ids():
    return content_id


def _keys(words: int):
    def maker():
        def keys(text: str) -> tuple:
            hashes = distinct(shingle_hashes(text, words))
            if not len(hashes):
                return *content_id(text), []
            made = band_keys(mixed(hashes), np.zeros(len(hashes), np.int64), 1, BANDS, ROWS)
            return *content_id(text), made[0].view(np.int64).tolist()

        return keys

    return maker


def _items(words: int, wanted: Broadcast):
    def maker():
        def items(text: str) -> tuple:
            id, id2 = content_id(text)
            if not passes(wanted.value, id):
                return None, None, None, None
            hashes = distinct(shingle_hashes(text, words))
            return id, id2, distinct((hashes >> np.uint64(32)).astype(np.uint32)).tobytes(), signed(simhash(hashes))

        return items

    return maker


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, similar: float = SIMILAR
) -> DataFrame:
    """(doc_id, id, id2, keep_id, keep, keep2) for the documents of groups of more than one.

    Documents are linked when the Jaccard similarity of their shingle sets is at
    least `similar`, or when their texts are equal after lower-casing A-Z (id and
    id2, 128 bits of that text, are the same).  A null text counts as empty; all
    texts without words that are equal form a group, and such a text is linked
    to no other.  The smallest doc_id of a group stays (null last); keep and
    keep2 are its id.  Repeated rows are members like any others.  Other columns
    are not read.  An empty table gives no rows.
    """
    keyed = stored(add_text_columns(docs, text, [doc_id], "id long, id2 long, keys array<long>", _keys(words)), "keyed")

    def sets_of(ids: DataFrame) -> DataFrame:
        made = add_text_columns(docs, text, [], "id long, id2 long, items binary, fp long", _items(words, id_filter(ids)))
        return made.where("id is not null").dropDuplicates(["id"])

    roots = similar_components(keyed.select("id", "keys"), sets_of, similar, RADIUS)
    rows = keyed.select(F.col(doc_id).alias("doc_id"), F.struct("id", "id2").alias("own"))
    label = rows.join(roots, rows["own"] == roots["node"], "left").select("doc_id", "own", F.coalesce("root", "own").alias("label"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own"))
    groups = label.groupBy("label").agg(F.count("*").alias("n"), least.alias("least")).where("n > 1")
    groups = groups.select("label", F.col("least.doc_id").alias("keep_id"), F.col("least.own").alias("keep"))
    return label.join(groups, "label").select(
        "doc_id", "own.id", "own.id2", "keep_id", F.col("keep.id").alias("keep"), F.col("keep.id2").alias("keep2")
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, with their columns, less all but one of each near-duplicate group.

    Null texts count as empty and all empty texts form one group; rows that
    repeat both doc_id and text are one document, and one of them stays.
    Columns of docs may have any name.  An empty table gives no rows.
    """
    members = stored(near_duplicates(docs, text, doc_id), "near")
    found = members.distinct()
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("id") == F.col("keep")) & (F.col("id2") == F.col("keep2"))
    own, own2, gone_id, gone, gone2 = (free_name(docs, x) for x in ("own", "own2", "gone_id", "gone", "gone2"))
    away = found.where(~stays).select(F.col("doc_id").alias(gone_id), F.col("id").alias(gone), F.col("id2").alias(gone2))
    marked = add_text_columns(docs, text, docs.columns, f"`{own}` long, `{own2}` long", _ids)
    same = (F.col(own) == F.col(gone)) & (F.col(own2) == F.col(gone2)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(gone_id))
    left = marked.join(broadcast_if_small(away), same, "left_anti")
    repeated = members.groupBy("doc_id", "id", "id2").count().where("count > 1")  # repeated rows are a group
    if not repeated.isEmpty():
        left = left.dropDuplicates([doc_id, own, own2])
    return left.drop(own, own2)
