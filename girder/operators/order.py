"""Numbering rows over the whole table without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.sources.staging import staged


def numbered(rows: DataFrame, order: list[Column | str], name: str = "rn") -> DataFrame:
    """Adds the place of each row (from 1) in the given total order.

    Rows are dealt to ranges of the order; a row's place is its place in its range plus the rows of the ranges before, which are as
    many numbers as there are partitions and are broadcast. The order must be total, or equal rows may change places.
    """
    return running(rows.withColumn("__one", F.lit(1).cast("long")), order, {"__one": name}).drop("__one")


def running(rows: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each column of `sums`, its sum over all rows up to this one in the given total order, under the name given."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    # written once: ranges are cut by a sample, and a second evaluation may cut them elsewhere
    ranged = staged(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    upto = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sizes = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for c, n in sums.items()])
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.__part") < F.col("a.__part"), "left")
    before = before.groupBy(F.col("a.__part").alias("__part")).agg(*[F.coalesce(F.sum(f"b.__{n}"), F.lit(0)).alias(f"__{n}") for n in sums.values()])
    out = ranged.withColumns({n: F.sum(c).over(upto) for c, n in sums.items()}).join(F.broadcast(before), "__part")
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums.values()}).drop("__part", *[f"__{n}" for n in sums.values()])
