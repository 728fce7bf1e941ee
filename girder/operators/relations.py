"""Join shapes of the engine: current status, orphans, duplicates, scoped sets and aligned sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators.panel import latest_row


def current_status(projects: DataFrame, snapshots: DataFrame, status: str, key: str = "pid", month: str = "midx") -> DataFrame:
    """Every project with the status of its latest snapshot, "Unknown" without one."""
    now = latest_row(snapshots, [status], key, month).select(key, F.col(status).alias("current_status"))
    return projects.join(now, key, "left").withColumn("current_status", F.coalesce("current_status", F.lit("Unknown")))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def outside(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed (what a scoped delete leaves)."""
    return rows.join(ids.select(key), key, "left_anti")


def touching(pairs: DataFrame, ids: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """Pairs with either side in a set, once each: both sides are looked up in one pass, so the pairs are made once."""
    held = ids.where(F.col(key).isNotNull()).select(F.col(key)).distinct()
    out = pairs
    for side in (left, right):
        out = out.join(held.select(F.col(key).alias(side), F.lit(True).alias(f"__{side}")), side, "left")
    return out.where(F.coalesce(f"__{left}", f"__{right}", F.lit(False))).select(*pairs.columns)


def aligned(spine: DataFrame, live: DataFrame, portfolio: DataFrame, key: str, value: str) -> DataFrame:
    """One row for each spine key with both sides' value; agrees is null where a side is missing."""
    rows = spine.join(live.select(key, F.col(value).alias("live")), key, "left").join(portfolio.select(key, F.col(value).alias("portfolio")), key, "left")
    return rows.withColumn("agrees", F.col("live") == F.col("portfolio"))


def divergences(alignment: DataFrame, order: str, limit: int = 2) -> DataFrame:
    """The first rows whose sides are both known and differ."""
    return alignment.where("agrees = false").orderBy(order).limit(limit)


def search(rows: DataFrame, text: str | None, columns: list[str]) -> DataFrame:
    """Case-insensitive substring in any column; wildcards are plain characters, blank text filters nothing."""
    text = (text or "").strip().lower()
    if not text:
        return rows
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text)), F.lit(False))
    return rows.where(found)


def where_equal(rows: DataFrame, **wanted) -> DataFrame:
    """Equality filters joined by AND; None means any."""
    for c, v in wanted.items():
        if v is not None:
            rows = rows.where(F.col(c) == v)
    return rows


def page(rows: DataFrame, order: list[str], number: int = 1, size: int = 20) -> DataFrame:
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("page from 1, size 1 to 100")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def up_to_month(rows: DataFrame, month: str, value, key: str, key_value) -> DataFrame:
    """A project's history up to a month that must exist."""
    own = rows.where((F.col(key) == key_value) & (F.col(month) <= value))
    if own.where(F.col(month) == value).isEmpty():
        raise LookupError(f"no snapshot of {key_value} in {value}")
    return own


def top_ids_with_order(rows: DataFrame, identity: str, position: str, limit: int) -> DataFrame:
    """Distinct values in first-seen order, capped."""
    return rows.groupBy(identity).agg(F.min(position).alias(position)).orderBy(position).limit(limit)


def families(frames: list[DataFrame], position: str, limit: int = 8) -> DataFrame:
    """Ordered families one after the other, cut to the first rows."""
    made = None
    for k, f in enumerate(frames):
        f = f.withColumn("family", F.lit(k))
        made = f if made is None else made.unionByName(f)
    return made.orderBy("family", position).limit(limit)
