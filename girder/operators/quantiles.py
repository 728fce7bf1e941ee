"""Exact quantiles by distributed selection: sketches say which values can hold a rank, and only those are put in order.

A sketch of bounded size, combined before the shuffle, gives each wanted rank a bracket of values. One more pass counts the rows below the
bracket and each distinct value inside it (all of them where fewer than ACCURACY are known, else about SPREAD / ACCURACY of the rows on either side), again combined before the shuffle. The values inside are
dealt to ranges and numbered there, so no task ever holds all values, nor all those of one column or group.

Defined cases: nulls are left out; NaN counts as the largest value; a column or group without a known value has null for each mark; an
empty table has a row for each column if there are no groups, and none otherwise; null is a group of its own; ties are counted, not expanded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.operators.order import running
from girder.sources.staging import staged

ACCURACY, SPREAD = 2_000, 4
#: Up to this many brackets (groups x columns x marks, counted first) are broadcast; more are joined.
BRACKETS = 100_000


def quantiles(rows: DataFrame, columns: Sequence[str] | dict[str, Column], marks: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n, marks): the known values of each column and its quantiles, interpolated between neighbours as `percentile` does.

    columns: names, or names with the expressions behind them.
    """
    exprs = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    cells = F.inline(F.array(*[F.struct(F.struct(F.lit(n).alias("c"), *[F.col(g).alias(f"g{i}") for i, g in enumerate(by)]).alias("__key"), e.cast("double").alias("__v")) for n, e in exprs.items()]))
    long = rows.select(cells)
    ends = [(max(p - SPREAD / ACCURACY, 0.0), min(p + SPREAD / ACCURACY, 1.0)) for p in marks]
    sketch = F.percentile_approx(F.nanvl("__v", F.lit(float("inf"))), F.array(*[F.lit(x) for e in ends for x in e]), ACCURACY)
    groups = long.groupBy("__key").agg(F.count("__v").alias("__n"), sketch.alias("__s"))
    if not by:  # a column without rows has its row all the same
        names = rows.sparkSession.createDataFrame([(n,) for n in exprs], "c string").select(F.struct("c").alias("__key"))
        groups = names.join(groups, "__key", "left").withColumn("__n", F.coalesce("__n", F.lit(0).cast("long")))
    brackets = []
    for k, (p, (lo, hi)) in enumerate(zip(marks, ends, strict=True)):
        low = F.get("__s", F.lit(2 * k)) if lo > 0 else F.lit(float("-inf"))
        high = F.get("__s", F.lit(2 * k + 1)) if hi < 1 else F.lit(float("nan"))
        high = F.when(high == float("inf"), float("nan")).otherwise(high)  # NaN is above all
        few = F.col("__n") < ACCURACY  # too few for a bracket to hold both neighbours of a rank
        low, high = F.when(few, float("-inf")).otherwise(low), F.when(few, float("nan")).otherwise(high)
        brackets.append(F.struct(F.lit(k).alias("__k"), (F.lit(float(p)) * (F.col("__n") - 1)).alias("__at"), low.alias("__lo"), high.alias("__hi")))
    asked = staged(groups.select("__key", "__n", F.inline(F.array(*brackets))), "brackets")
    small = F.broadcast if asked.count() <= BRACKETS else (lambda df: df)
    met = long.where("__v IS NOT NULL").join(small(asked.drop("__n", "__at")), "__key").where("__v <= __hi")
    counted = met.groupBy("__key", "__k", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")).alias("__v")).agg(F.count("*").alias("__here"))
    counted = staged(counted, "bracket-counts")
    ranked = running(counted.where("__v IS NOT NULL"), ["__key", "__k", "__v"], {"__here": "__upto"})
    below = counted.where("__v IS NULL").select("__key", "__k", F.col("__here").alias("__below"))
    base = ranked.groupBy("__key", "__k").agg(F.min(F.col("__upto") - F.col("__here")).alias("__base")).join(small(below), ["__key", "__k"], "left")
    spots = asked.join(base, ["__key", "__k"]).select("__key", "__k", "__at", (F.col("__base") - F.coalesce("__below", F.lit(0))).alias("__base"), (F.col("__at") < F.coalesce("__below", F.lit(0))).alias("__missed"))
    upto = F.col("__upto") - F.col("__base")
    found = ranked.join(small(spots), ["__key", "__k"]).groupBy("__key", "__k").agg(
        F.min(F.when(upto > F.floor("__at"), F.col("__v"))).alias("__a"), F.min(F.when(upto > F.ceil("__at"), F.col("__v"))).alias("__b"), F.bool_or("__missed").alias("__missed")
    )
    a, b, at = F.col("__a"), F.col("__b"), F.col("__at")
    between = F.when(a == b, a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b)
    sound = b.isNotNull() & ~F.col("__missed")
    value = F.when(F.col("__n") == 0, F.lit(None)).when(sound, between).otherwise(F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
    out = asked.join(small(found), ["__key", "__k"], "left").groupBy("__key").agg(F.first("__n").alias("__n"), F.sort_array(F.collect_list(F.struct("__k", value.alias("v")))).alias("__m"))
    return out.select(*[F.col(f"__key.g{i}").alias(g) for i, g in enumerate(by)], F.col("__key.c").alias("column"), F.col("__n").alias("n"), F.col("__m.v").alias("marks"))


def median_of(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """One row: the exact median of an expression."""
    return quantiles(rows, {name: value}, [0.5]).select(F.get("marks", F.lit(0)).alias(name))
