"""Distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snagline.llm.common import stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """Adds to each (node, other) the least of the node and its others."""
    least = pairs.groupBy("node").agg(F.min("other").alias("low"))
    least = least.select("node", F.least("node", "low").alias("least"))
    return pairs.join(least, "node")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("node", "other").unionAll(
        edges.select(F.col("other").alias("node"), F.col("node").alias("other"))
    )
    return (
        _with_least(both)
        .where(F.col("other") > F.col("node"))
        .select(F.col("other").alias("node"), F.col("least").alias("other"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    linked = _with_least(edges)
    own = linked.select("node", F.col("least").alias("other"))
    others = linked.select(F.col("other").alias("node"), F.col("least").alias("other"))
    return own.unionAll(others).where("node <> other").distinct()


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("node", "other")
    row = edges.agg(F.count("*"), F.sum(mark % 1_000_003), F.sum(F.shiftright(mark, 20) % 1_000_003)).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Components of an undirected graph.

    Alternates large-star and small-star steps until the edges no longer
    change; each node then points at the least node of its component.  Every
    step is a grouped minimum and a join, so a node with very many edges is
    combined before the shuffle and its join is one that adaptive execution
    can split.  Nothing is collected but three numbers a step.

    Returns (node, root) for every node but the least of its component, the root.
    Edges with a null end and loops are ignored; an empty table gives no rows.
    """
    now = edges.select(
        F.greatest(F.col(left), F.col(right)).alias("node"), F.least(F.col(left), F.col(right)).alias("other")
    ).where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    now = stored(now.distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = stored(_small_star(_large_star(now)), "edges")
        state, before = _state(now), state
        if state == before:
            break
    return now.select("node", F.col("other").alias("root"))
