"""Benchmark decontamination by a distributed positional inverted index.

DataFrame functions only.  The index holds a posting (term, document, place)
for every place of the corpus where a term of the test set stands.  A test
window is looked up by its rarest terms: the place lists are shifted by the
terms' offsets and intersected, rarest first, and what remains is compared
word by word with the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snagline.llm.common import LOWER, UPPER, broadcast_if_small, free_name, stored, text_of

#: Words of a window.
WINDOW = 10
#: How many terms of a window are intersected before whole words are compared.
RAREST = 2
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower_word(word: Column) -> Column:
    # lower() and translate() agree on ASCII, where lower() is faster
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _raw_words(text: Column) -> Column:
    """Words, not yet lower-cased; '' may stand first or last."""
    return F.split(text, _BETWEEN)


def words(text: Column) -> Column:
    return F.transform(F.filter(_raw_words(text), lambda w: w != ""), _lower_word)


def document_key(text: Column) -> list[Column]:
    """128 bits by which equal texts share their postings."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", width: int = WINDOW) -> DataFrame:
    """(window, words, n) of the distinct windows; an item with fewer words is one window.

    A null text or one without words has none, repeated items count once, and
    an empty table gives no rows.
    """
    items = _items(benchmark, text, item_id, width)
    return items.select("window", "words").groupBy("window").agg(F.first("words").alias("words")).withColumn(
        "n", F.size("words")
    )


def _items(benchmark: DataFrame, text: str, item_id: str, width: int) -> DataFrame:
    """(window, item_id, words), a row for each window of each item."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), words(text_of(text)).alias("all")).where("size(all) > 0")
    last = F.greatest(F.size("all") - width, F.lit(0))
    each = rows.select("item_id", "all", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    each = each.select("item_id", F.slice("all", F.col("at") + 1, F.lit(width)).alias("words"))
    return each.select(F.sha2(F.array_join("words", " "), 256).alias("window"), "item_id", "words")


def build_index(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Postings (term, k1, k2, place) of the given terms, stored; place counts words from 0."""
    doc = docs.select(text_of(text).alias("text")).where("text <> ''")
    raw = doc.select(*document_key(F.col("text")), F.posexplode(_raw_words(F.col("text"))).alias("place", "raw"), F.ascii("text").alias("c"))
    first = F.col("c")
    # a text that begins with a separator has '' before its first word
    begins = ((first >= 48) & (first <= 57)) | ((first >= 65) & (first <= 90)) | ((first >= 97) & (first <= 122)) | (first > 127)
    placed = raw.where("raw <> ''").select(
        "k1", "k2", (F.col("place") - F.when(begins, 0).otherwise(1)).alias("place"), _lower_word(F.col("raw")).alias("term")
    )
    return stored(placed.join(broadcast_if_small(terms), "term", "left_semi"), "postings")


def _anchors(found: DataFrame, index: DataFrame, rarest: int) -> DataFrame:
    """(window, n, terms array<(offset, term)>) with the rarest terms of each window, rarest first."""
    counts = index.groupBy("term").count()
    each = found.select("window", "n", F.posexplode("words").alias("offset", "term"))
    each = each.groupBy("window", "n", "term").agg(F.min("offset").alias("offset"))
    each = each.join(counts, "term", "left").where("count is not null or n > 0")
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("count", F.lit(0)), "term"))
    lacking = F.min(F.coalesce("count", F.lit(0))).over(Window.partitionBy("window"))
    each = each.select("window", "n", "term", "offset", rank.alias("rank"), lacking.alias("lacking"))
    # a window with a term that the corpus lacks stands nowhere
    return each.where((F.col("rank") <= rarest) & (F.col("lacking") > 0)).drop("lacking")


def occurrences(docs: DataFrame, found: DataFrame, text: str = "text", rarest: int = RAREST) -> DataFrame:
    """(k1, k2, start, window, n): the exact places of the windows, by document key."""
    terms = stored(found.select(F.explode("words").alias("term")).distinct(), "terms")
    index = build_index(docs, terms, text)
    anchors = stored(_anchors(found, index, rarest), "anchors")
    hits = None
    for rank in range(1, rarest + 1):
        these = anchors.where(F.col("rank") == rank).select("term", "window", "offset", "n")
        shifted = index.join(broadcast_if_small(these), "term").where("place >= offset")
        shifted = shifted.select("k1", "k2", (F.col("place") - F.col("offset")).alias("start"), "window", "n")
        if hits is None:
            hits = stored(shifted.distinct(), "hits")
            continue
        # windows of fewer distinct terms have no further list to intersect
        longer = these.select("window").distinct()
        open_hits = hits.join(broadcast_if_small(longer), "window", "left_semi")
        ended = hits.join(broadcast_if_small(longer), "window", "left_anti")
        keys = broadcast_if_small(stored(open_hits.select("k1", "k2").distinct(), "open"))
        shifted = shifted.join(keys, ["k1", "k2"], "left_semi")
        both = open_hits.join(shifted.drop("n"), ["k1", "k2", "start", "window"], "left_semi")
        columns = ["k1", "k2", "start", "window", "n"]
        hits = stored(both.select(columns).unionAll(ended.select(columns)), "hits")
    keys = broadcast_if_small(stored(hits.select("k1", "k2").distinct(), "doc-keys"))
    whole = docs.select(text_of(text).alias("text"))
    whole = whole.select(*document_key(F.col("text")), "text").join(keys, ["k1", "k2"], "left_semi")
    whole = whole.dropDuplicates(["k1", "k2"]).select("k1", "k2", words(F.col("text")).alias("all"))
    starts = hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "window", "n")).alias("starts"))
    # the words of each place, hashed as the window is; both sides have a row per document
    match = F.filter(
        "starts",
        lambda s: F.sha2(F.array_join(F.slice("all", s["start"] + 1, s["n"]), " "), 256) == s["window"],
    )
    exact = whole.join(starts, ["k1", "k2"]).select("k1", "k2", F.explode(match).alias("s"))
    return stored(exact.select("k1", "k2", "s.start", "s.window", "s.n"), "exact")


def proximity_matches(docs: DataFrame, found: DataFrame, slop: int = 5, text: str = "text") -> DataFrame:
    """(k1, k2, window, place): the two rarest terms of a window stand within `slop`
    words of the distance they have in it.

    Postings are joined by window, document and a block of places, so that a
    term that is frequent in one document is not paired with all its places.  Of
    terms as rare as each other the first in order counts, of its places in the
    window the first.  A window of one distinct term, or with a term that the
    documents lack, matches nowhere; nor do null texts.  Equal texts share a
    key.  Other columns are not read.  Empty tables give no rows.
    """
    terms = found.select(F.explode("words").alias("term")).distinct()
    index = build_index(docs, terms, text)
    anchors = stored(_anchors(found, index, 2), "anchors")
    width = 2 * slop + 1

    def shifted(rank: int) -> DataFrame:
        these = anchors.where(F.col("rank") == rank).select("term", "window", "offset")
        out = index.join(broadcast_if_small(these), "term")
        return out.select("k1", "k2", "window", (F.col("place") - F.col("offset")).alias("start"), "place")

    near = [F.floor((F.col("start") + d) / width) for d in (-slop, slop)]
    second = shifted(2).select("k1", "k2", "window", F.col("start").alias("other"), F.floor(F.col("start") / width).alias("block"))
    first = shifted(1).withColumn("block", F.explode(F.array_distinct(F.array(*near))))
    pairs = first.join(second, ["k1", "k2", "window", "block"]).where(F.abs(F.col("start") - F.col("other")) <= slop)
    return pairs.select("k1", "k2", "window", "place").distinct()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    width: int = WINDOW,
) -> DataFrame:
    """One row per document with what of the benchmark it holds.

    Texts are lower-cased in A-Z; a window is `width` consecutive words of an
    item, or all words of a shorter item; a document word inside any occurrence
    of a window is hit.  A null text has no words, and an item without words no
    window.  Items that repeat an item_id count once; a null item_id counts as
    none.  Documents with equal texts get equal results, repeated rows stay.
    Other columns are not read.  An empty table on either side gives no hits.

    Returns doc_id, n_words, n_hit, n_items, items_sha256 (of the item_ids with
    occurring windows, sorted as strings, comma-joined), contaminated.
    """
    items = stored(_items(benchmark, item_text, item_id, width), "items")
    found = items.groupBy("window").agg(F.first("words").alias("words")).withColumn("n", F.size("words"))
    exact = occurrences(docs, found, text)
    spots = exact.select("k1", "k2", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place"))
    n_hit = spots.distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_hit"))
    of = items.select("window", F.col("item_id").cast("string").alias("item")).where("item is not null").distinct()
    which = exact.select("k1", "k2", "window").distinct().join(broadcast_if_small(of), "window")
    which = which.select("k1", "k2", "item").distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = stored(n_hit.join(which, ["k1", "k2"], "left"), "doc-hits")
    whole = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    n_words = F.size(F.filter(_raw_words(F.col("text")), lambda w: w != "")).cast("long")
    rows = whole.select("doc_id", *document_key(F.col("text")), n_words.alias("n_words"))
    return rows.join(hits, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, in whose text no window occurs.

    A null text has no words and stays.  Columns of docs may have any name.  An
    empty table gives no rows; with an empty benchmark all rows stay.
    """
    items = _items(benchmark, "text", "item_id", WINDOW)
    found = stored(items.groupBy("window").agg(F.first("words").alias("words")).withColumn("n", F.size("words")), "windows")
    d1, d2, g1, g2 = (free_name(docs, x) for x in ("d1", "d2", "g1", "g2"))
    keys = occurrences(docs, found, text).select(F.col("k1").alias(g1), F.col("k2").alias(g2)).distinct()
    keys = broadcast_if_small(stored(keys, "contaminated"))
    k1, k2 = document_key(text_of(F.col(f"`{text}`")))
    marked = docs.withColumn(d1, k1).withColumn(d2, k2)
    return marked.join(keys, (F.col(d1) == F.col(g1)) & (F.col(d2) == F.col(g2)), "left_anti").drop(d1, d2)
