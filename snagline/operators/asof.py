"""As-of lookups: rows of both sides in one order, the last value carried to whoever asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(asks: DataFrame, points: DataFrame, by: list[str], at: str, name: str, forward: bool = False) -> DataFrame:
    """asks with the point (struct `name`) that is the last at or before its time, or the first at or after it.

    Both sides have the columns in `by` and the time `at`; the other columns of
    points go into the struct, null where there is none.  Of points of equal
    time the last by their columns counts.  No pair of rows is compared: each
    group is ordered once.  Asks without a time have no point.
    """
    value = F.struct(F.col(at), *[F.col(c) for c in points.columns if c not in (*by, at)])
    own = [c for c in asks.columns if c not in (*by, at)]
    left = asks.select(*by, at, F.struct(*own, F.lit(True).alias("_")).alias("_ask"), F.lit(None).cast(points.select(value.alias("v")).schema["v"].dataType).alias("_point"))
    right = points.where(F.col(at).isNotNull()).select(*by, at, F.lit(None).cast(left.schema["_ask"].dataType).alias("_ask"), value.alias("_point"))
    # of equal times the points come first in either direction
    asking = F.col("_ask").isNotNull()
    order = [F.col(at).desc_nulls_first() if forward else F.col(at).asc_nulls_first(), asking, F.col("_point")]
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = left.unionByName(right).withColumn("_point", F.last("_point", ignorenulls=True).over(so_far)).where(asking)
    return rows.select(*by, at, *[F.col(f"_ask.{c}").alias(c) for c in own], F.when(F.col(at).isNotNull(), F.col("_point")).alias(name))
