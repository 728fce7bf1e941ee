"""Leakage-safe splits of a panel, what is reported about them, and the feature files of the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.operators.order import numbered
from girder.operators.quantiles import quantiles

SPLITS = ("train", "validation", "test")


def first_rows(rows: DataFrame, columns: list[str], key: str, order: str) -> DataFrame:
    """The given columns of each key's first row as it stands, nulls included (unlike panel.first_known, which goes by column)."""
    first = F.min_by(F.struct(*columns), order).alias("first")
    return rows.groupBy(key).agg(first).select(key, *[F.col(f"first.{c}").alias(c) for c in columns])


def repeated_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat an earlier row's keys."""
    return rows.groupBy(*keys).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated"))


def chronological_split(keys: DataFrame, start: str, key: str, train: float = 0.70, valid: float = 0.15, tie: Column | None = None) -> DataFrame:
    """Adds split: the earliest starts train, the next validate, the rest test; equal starts by `tie`, then by key.

    Sizes round half to even. An empty part is refused.
    """
    n = keys.count()
    cut = round(n * train), round(n * train) + round(n * valid)
    if n and not (0 < cut[0] < cut[1] < n):
        raise ValueError(f"an empty split of {n} keys")
    order = [F.col(start), *([tie] if tie is not None else []), F.col(key)]
    rows = numbered(keys, order, "__rn")
    return rows.withColumn("split", F.when(F.col("__rn") <= cut[0], "train").when(F.col("__rn") <= cut[1], "validation").otherwise("test")).drop("__rn")


def assigned(rows: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """rows with their key's split; a key without one is refused."""
    out = rows.join(splits.select(key, "split"), key, "left")
    if not (lost := out.where("split IS NULL").select(key).distinct().limit(5)).isEmpty():
        raise ValueError(f"no split for {[r[0] for r in lost.collect()]}")
    return out


def split_overlaps(rows: DataFrame, key: str) -> DataFrame:
    """Keys that are in more than one split: none, if the split is safe."""
    return rows.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").select(key)


def split_metadata(rows: DataFrame, key: str, start: str, month: str, terminal: str) -> DataFrame:
    """(split, n_keys, n_rows, n_terminal, first_start, last_start, first_month, last_month); terminal rows count apart."""
    kept = ~F.col(terminal)
    return rows.groupBy("split").agg(
        F.count_distinct(F.when(kept, F.col(key))).alias("n_keys"), F.count_if(kept).alias("n_rows"), F.count_if(F.col(terminal)).alias("n_terminal"),
        F.min(F.when(kept, F.col(start))).alias("first_start"), F.max(F.when(kept, F.col(start))).alias("last_start"), F.min(F.when(kept, F.col(month))).alias("first_month"), F.max(F.when(kept, F.col(month))).alias("last_month"),
    )


def cohort_diagnostic(rows: DataFrame, target: str, kind: str) -> DataFrame:
    """(split, n, mean, std, median, share of the commonest kind) of the projects of each split."""
    by_kind = rows.groupBy("split", kind).agg(F.count("*").alias("k")).groupBy("split").agg(F.max("k").alias("top"))
    stats = rows.groupBy("split").agg(F.count("*").alias("n"), F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"))
    middle = quantiles(rows, [target], [0.5], by=["split"]).select(F.col("split").alias("__split"), F.get("marks", F.lit(0)).alias("median"))
    stats = stats.join(F.broadcast(middle), F.col("split").eqNullSafe(F.col("__split")))
    return stats.join(by_kind, "split").select("split", "n", "mean", "std", "median", (F.col("top") / F.col("n")).alias("top_share"))


def training_mean(rows: DataFrame, c: str) -> DataFrame:
    """One row: the mean of a column over the training part."""
    return rows.where("split = 'train'").agg(F.avg(F.col(c).cast("double")).alias("mean"))


def without_repeated_columns(rows: DataFrame) -> DataFrame:
    """Of columns that share a name, the first stays."""
    fresh, seen = [], set()
    for k, c in enumerate(rows.columns):
        fresh.append(f"__{k}")
        seen.add(c)
    named = rows.toDF(*fresh)
    first = {c: f"__{k}" for k, c in reversed(list(enumerate(rows.columns)))}
    return named.select(*[F.col(first[c]).alias(c) for c in dict.fromkeys(rows.columns)])


def feature_table(rows: DataFrame, keys: list[str], predictors: list[str], flag: str, targets: list[str]) -> DataFrame:
    """Keys, predictors, the terminal flag and targets, in this order; a missing column is refused by name."""
    wanted = [*keys, *predictors, flag, *targets]
    if lost := [c for c in wanted if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return without_repeated_columns(rows).select(*wanted)


def write_task_files(features: DataFrame, folder: str, tasks: dict[str, list[str]]) -> None:
    """One file set for each task, without the other tasks' targets."""
    for task, own in tasks.items():
        others = [c for t, cols in tasks.items() for c in cols if t != task and c not in own]
        features.drop(*others).write.mode("overwrite").option("header", True).csv(f"{folder}/{task}")


def latest_by_split(rows: DataFrame, key: str, month: str) -> DataFrame:
    """The last row of each key of a split table."""
    w = Window.partitionBy(key).orderBy(F.desc(month))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
