"""Row operators over a monthly panel: latest rows, increments, trailing windows, runs and ratio features.

All take the panel's key and month columns by name; windows run inside a key, so they need one hash shuffle on it and
share it. Frames count rows, not months: a gap in months does not widen a trailing window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP, FLOOR = 5.0, 1e-6


def latest_open_month(snapshots: DataFrame, key: str = "pid", month: str = "midx", terminal: str = "is_terminal") -> DataFrame:
    """(key, m): the largest month that is not terminal; keys without one are absent."""
    return snapshots.where(~F.col(terminal)).groupBy(key).agg(F.max(month).alias("m"))


def latest_row(snapshots: DataFrame, columns: list[str], key: str = "pid", month: str = "midx") -> DataFrame:
    """The given columns of each key's largest month, in one aggregate and without a self join."""
    return snapshots.groupBy(key).agg(F.max(month).alias(month), *[F.max_by(c, month).alias(c) for c in columns])


def first_known(rows: DataFrame, columns: list[str], key: str, month: str) -> DataFrame:
    """Each column's first non-null value in month order, column by column."""
    return rows.groupBy(key).agg(*[F.expr(f"min_by(`{c}`, `{month}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in columns])


def by_month(key: str = "pid", month: str = "midx"):
    return Window.partitionBy(key).orderBy(month)


def increment(c: str, w) -> Column:
    """Difference to the row before; the first row's is its level. Null where either is null, and then the level."""
    return F.coalesce(F.col(c) - F.lag(c).over(w), F.col(c))


def trailing_mean(c: Column | str, w, rows: int = 3) -> Column:
    return F.avg(c).over(w.rowsBetween(1 - rows, 0))


def trailing_sum(c: Column | str, w, rows: int = 3) -> Column:
    return F.sum(c).over(w.rowsBetween(1 - rows, 0)).cast("double")


def run_length(rows: DataFrame, flag: str, out: str, key: str = "pid", month: str = "midx") -> DataFrame:
    """Adds the length of the run of ones that ends at each row (0 at a zero)."""
    w = by_month(key, month)
    island = F.sum(F.lit(1) - F.col(flag)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy(key, "__island").orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__island", island).withColumn(out, F.sum(flag).over(inside)).drop("__island")


def rising(c: str, w) -> Column:
    """1 where c rose against the row before, 0 elsewhere and where c is null. After a null the level itself counts."""
    return F.coalesce((increment(c, w) > 0).cast("int"), F.lit(0))


def capped_ratio(a: Column, b: Column, cap: float = CAP, floor: float = FLOOR) -> Column:
    """a / max(b, floor), at most cap; null where a or b is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a / F.greatest(b, F.lit(floor)), F.lit(cap)))


def strict_total(columns: list[str]) -> Column:
    """The sum of the columns, null where any is null."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c)
    return total


def strict_count_positive(columns: list[str]) -> Column:
    """How many columns are over zero, null where any is null."""
    known, n = F.lit(True), F.lit(0)
    for c in columns:
        known, n = known & F.col(c).isNotNull(), n + F.coalesce((F.col(c) > 0).cast("int"), F.lit(0))
    return F.when(known, n)


def months_between_starts(start: Column, month: Column) -> Column:
    """Calendar months from a start date to a yyyy-MM month, days ignored."""
    return (F.substring(month, 1, 4).cast("int") - F.year(start)) * 12 + F.substring(month, 6, 2).cast("int") - F.month(start)


def pressure(done_pct: Column, months_left: Column) -> Column:
    return F.when(done_pct.isNotNull() & months_left.isNotNull(), (F.lit(100.0) - done_pct) / F.greatest(months_left.cast("double"), F.lit(1.0)))


def s_curve(month: Column, duration: Column) -> Column:
    f = F.least(month / duration, F.lit(1.0))
    return F.lit(100.0) * (3 * f * f - 2 * f * f * f)


#: The ten delay factor columns of a snapshot.
DELAY_FACTORS = [
    "land_acquisition_delay_days", "utility_shifting_delay_days", "environment_clearance_delay_days", "material_delay_days", "labour_shortage_days",
    "traffic_diversion_delay_days", "design_change_delay_days", "approval_delay_days", "equipment_unavailability_days", "weather_disruption_days",
]


def snapshot_features(panel: DataFrame, key: str = "project_id", month: str = "reporting_month") -> DataFrame:
    """History-only features of a snapshot panel; a prefix of a project's history gives the same values."""
    w = by_month(key, month)
    c = F.col
    rows = panel.withColumns(
        {
            "expenditure_gap": c("actual_expenditure_inr_cr") - c("planned_expenditure_inr_cr"),
            "cost_tracking_gap": c("actual_cost_to_date_inr_cr") - c("planned_cost_to_date_inr_cr"),
            "delay_factor_total": strict_total(DELAY_FACTORS),
            "delay_factor_count": strict_count_positive(DELAY_FACTORS),
            "months_remaining": c("planned_duration_months") - c("months_since_start"),
            "age_ratio": c("months_since_start") / c("planned_duration_months"),
            "progress_efficiency": capped_ratio(c("actual_physical_progress_pct"), c("planned_physical_progress_pct")),
            "cost_growth_rate": capped_ratio(c("actual_cost_to_date_inr_cr"), c("planned_cost_to_date_inr_cr")),
        }
    )
    rows = rows.withColumn("schedule_pressure", pressure(c("actual_physical_progress_pct"), c("months_remaining")))
    rows = rows.withColumns({"progress_increment": increment("actual_physical_progress_pct", w), "cost_increment": increment("actual_cost_to_date_inr_cr", w), "adverse": rising("delay_factor_total", w), "__under": F.coalesce((c("actual_physical_progress_pct") < c("planned_physical_progress_pct")).cast("int"), F.lit(0))})
    rows = rows.withColumns({"progress_trend_3m": trailing_mean("progress_increment", w), "cost_trend_3m": trailing_mean("cost_increment", w), "adverse_3m": trailing_sum("adverse", w)})
    return run_length(rows, "__under", "under_run", key, month).drop("__under", "adverse")


def days_to_month(month: Column, day: Column) -> Column:
    """Days from a date to the first of a yyyy-MM month (negative where the date is later)."""
    return F.datediff(F.to_date(month, "yyyy-MM"), day)
