"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets a fractional number of copies, target / source size.  Its
integral part is taken as it is; the fractional parts are rounded in pairs:
two documents exchange mass (words, so that their sum stays) until one of them
is integral, and the other goes on to the next pair.  Each block of a source
leaves at most one fractional document, and these residuals meet in a
reduction tree until one per source is left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import TOKEN, broadcast_if_small, shuffle_partitions, stored, text_of

#: By code point of the source's name, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words.
SHARE = 1.5
#: No source is repeated more often than this.
MOST_COPIES = 2
#: Documents in a block, and residuals that meet in one node of the tree.
BLOCK_ROWS, FAN_IN = 1_000, 64


def numbered_sources(by: DataFrame) -> DataFrame:
    """Adds place: the number of each source by code point, from 0, null last.

    Sources are sorted over many tasks; what a task begins with is the number
    of sources in those before it, a sum over one row per task.
    """
    spread = by.repartitionByRange(shuffle_partitions(by.sparkSession), F.col("source").asc_nulls_last())
    sorted_ = spread.sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_n", F.monotonically_increasing_id())
    rows = stored(sorted_, "sources")
    part = F.shiftright("_n", 33)
    tasks = rows.groupBy(part.alias("task")).agg(F.count("*").alias("n")).collect()  # a row per task
    begin, at = {}, 0
    for r in sorted(tasks):
        begin[r["task"]], at = at, at + r["n"]
    starts = by.sparkSession.createDataFrame(list(begin.items()) or [(0, 0)], "_task long, _begin long")
    placed = rows.join(F.broadcast(starts), part == F.col("_task"))
    return placed.withColumn("place", F.col("_begin") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).drop("_n", "_task", "_begin")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) by weighted filling with a ceiling.

    Targets are level * weight, stopped at most * source_size; what is above
    goes to the other sources by weight, a sum over all sources a step, until no
    further source is full.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    by = stored(numbered_sources(by).withColumn("w", w).drop("place"), "weights")
    level, full = 0.0, F.lit(False)
    while True:
        sums = by.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("w")))).first()
        if not sums[2]:  # every source is full, or there is none
            full = F.lit(True)
            break
        before, level = level, (share * sums[0] - most * (sums[1] or 0)) / sums[2]
        full = F.lit(level) * F.col("w") > F.col("source_size") * float(most)
        if level <= before:
            break
    target = F.when(full, F.col("source_size") * float(most)).otherwise(F.lit(level) * F.col("w"))
    return by.select("source", "source_size", "n_docs", target.alias("target"))


def _pivot(a: tuple, b: tuple, rng: np.random.Generator) -> tuple[tuple, tuple]:
    """Moves words between two fractional units; the first returned is integral.

    A unit is (name, size, p) with 0 < p < 1.  size * p summed over both stays,
    and each p keeps its mean.
    """
    (ra, sa, pa), (rb, sb, pb) = a, b
    up = min((1 - pa) * sa, pb * sb)
    down = min(pa * sa, (1 - pb) * sb)
    move = up if rng.random() * (up + down) < down else -down
    qa, qb = pa + move / sa, pb - move / sb
    if min(qa, 1 - qa) <= min(qb, 1 - qb):
        return (ra, sa, float(round(qa))), (rb, sb, qb)
    return (rb, sb, float(round(qb))), (ra, sa, qa)


def _is_integral(p: float) -> bool:
    return p < 1e-12 or p > 1 - 1e-12


def _round_sorted(seed: int, level: int):
    """Over rows sorted by (source, node): streams them with one unit in hand."""
    columns = ["source", "node", "h", "h2", "row", "size", "p"]

    def rounds(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, rng = None, None, None
        flat = lambda unit, open_: (*now, *unit[0], *unit[1:], open_)
        for batch in batches:
            out = []
            for source, node, h, h2, row, size, p in batch[columns].itertuples(index=False, name=None):
                key = (source if isinstance(source, str) else None, node)
                if key != now:
                    if held:
                        out.append(flat(held, True))
                    now, held = key, None
                    rng = np.random.default_rng([seed, level, node, *(key[0] or "\0null").encode("utf-8", "surrogatepass")])
                unit = ((h, h2, row), size, p)
                if held:
                    done, held = _pivot(held, unit, rng)
                    out.append(flat(done, False))
                    if _is_integral(held[2]):
                        out.append(flat((held[0], held[1], float(round(held[2]))), False))
                        held = None
                else:
                    held = unit
            yield pd.DataFrame(out, columns=[*columns, "open"])
        if held:
            yield pd.DataFrame([flat(held, True)], columns=[*columns, "open"])

    return rounds


_UNITS = "source string, node long, h long, h2 long, row long, size long, p double, open boolean"


def _round(units: DataFrame, partitions: int, seed: int, level: int) -> DataFrame:
    """Units are met in the order of their content, so that the layout of the input decides nothing."""
    dealt = units.repartition(partitions, "source", "node").sortWithinPartitions("source", "node", "h", "h2", "size", "row")
    return stored(dealt.mapInPandas(_round_sorted(seed, level), _UNITS), "units")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    seed: int = 17,
    block_rows: int = BLOCK_ROWS,
    fan_in: int = FAN_IN,
    weights=WEIGHTS,
    share: float = SHARE,
    carry: list[str] | None = None,
) -> DataFrame:
    """What the mix takes of each document.

    size is the number of words.  The last fractional document of each source
    is cut: the mix takes round(p * size) of its words, so that a source misses
    its target by a word at most.  A null source is a source of its own and
    comes last; a null text has size 0 and takes nothing; so does every
    document when no text has a word.  Rows that repeat a doc_id are units of
    their own.  Chance and order follow (source, doc_id, text), so reruns give
    the same mix however the rows are split; of rows that agree in all three it
    does not matter which is taken.  Other columns are not read, but those in
    carry come out whole in the struct `carried`.  An empty table gives no rows.

    Returns doc_id, source, size, source_size, target, taken, and carried.
    """
    n = F.regexp_count(text_of(F.col(f"`{text}`")), F.lit(TOKEN)).cast("long")
    own, of = F.col(f"`{doc_id}`"), F.col(f"`{source}`").cast("string")
    content = (own, of, F.col(f"`{text}`"))
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    rows = docs.select(
        own.alias("doc_id"), of.alias("source"), n.alias("size"), F.xxhash64(*content).alias("h"), F.xxhash64(F.lit(seed), *content).alias("h2"), *carried
    )
    # written once, so the numbers given to rows hold for every later read
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    targets = stored(source_targets(rows.select("source", "size"), weights, share), "targets").withColumnRenamed("source", "_source")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    each = rows.join(broadcast_if_small(targets), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("copies", copies)
    whole = F.floor(F.col("copies") + 1e-12)
    each = each.withColumn("whole", whole).withColumn("p", F.greatest(F.col("copies") - whole, F.lit(0.0)))
    blocks = F.ceil(F.col("n_docs") / float(block_rows))
    open_units = each.where("p > 1e-12 and size > 0").select("source", F.pmod(F.col("h"), blocks).alias("node"), "h", "h2", "row", "size", "p")
    parts, level = shuffle_partitions(docs.sparkSession), 0
    done = _round(open_units, parts, seed, level)
    settled = done.where("not open")
    left = done.where("open")
    while left.groupBy("source").count().where("count > 1").limit(1).count():
        level += 1
        nodes = left.withColumn("node", F.floor(F.col("node") / fan_in)).drop("open")
        done = _round(nodes, parts, seed, level)
        settled, left = settled.unionAll(done.where("not open")), done.where("open")
    settled = settled.unionAll(left).select(F.col("row").alias("_row"), F.col("p").alias("_p"))
    p = F.coalesce("_p", "p")
    taken = F.col("whole") * F.col("size") + F.round(p * F.col("size"))
    # rows with what they carry are dealt once and not sorted, at every size, so that disk grows as the input does
    return each.join(settled.hint("shuffle_hash"), F.col("row") == F.col("_row"), "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.least(taken, F.col("size") * MOST_COPIES).cast("long").alias("taken"),
        *(["carried"] if carry else []),
    )


def drop_untaken(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that the mix takes words of, with their columns and size, source_size, target, taken.

    Columns of docs with these four names give way to those of the mix; others
    may have any name.  Rows without words, null texts among them, are not
    taken.  An empty table gives no rows.
    """
    names = ["size", "source_size", "target", "taken"]
    taken = mix(docs, text, source, doc_id, carry=docs.columns).where("taken > 0")
    kept = [F.col(f"carried.`{c}`").alias(c) for c in docs.columns if c.lower() not in names]
    return taken.select(*kept, *names)
