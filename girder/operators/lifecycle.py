"""Project records over their life: creation, partial updates, archiving and guarded monthly appends.

Tables are DataFrames in and out; the caller writes them (see girder.sources.tables). Guards are one pass that labels
each candidate row, so a batch of appends and a single one take the same path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.operators.panel import months_between_starts

USER = "USER_ENTERED"


def next_id(projects: DataFrame, prefix: str = "USER-") -> str:
    """The largest numeric suffix plus one, four digits or more."""
    n = F.try_to_number(F.regexp_extract("project_id", rf"^{prefix}(\d+)$", 1), F.lit("9" * 12))
    last = projects.agg(F.max(n).alias("n")).first()["n"]
    return f"{prefix}{int(last or 0) + 1:04d}"


def created(projects: DataFrame, row: dict, prefix: str = "USER-") -> DataFrame:
    """projects with one more row of the user's; an id that exists is refused."""
    row = dict(row)
    row.setdefault("project_id", next_id(projects, prefix))
    if not projects.where(F.col("project_id") == row["project_id"]).isEmpty():
        raise ValueError(f"{row['project_id']} exists")
    row |= {"data_provenance": USER, "is_archived": False, "archived_at": None}
    one = projects.sparkSession.createDataFrame([tuple(row.get(c) for c in projects.columns)], projects.schema)
    return projects.unionByName(one)


def updated(projects: DataFrame, project_id: str, changes: dict, required: tuple[str, ...] = ("project_name", "state", "project_type")) -> DataFrame:
    """Only the named fields change; an explicit None clears a field, and is refused where a value is required."""
    if cleared := [c for c in required if c in changes and changes[c] is None]:
        raise ValueError(f"required: {', '.join(cleared)}")
    own = F.col("project_id") == project_id
    return projects.withColumns({c: F.when(own, F.lit(v).cast(projects.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})


def archived(projects: DataFrame, project_id: str, on: bool = True) -> DataFrame:
    """Archive or reactivate; archiving again keeps the first time."""
    own = F.col("project_id") == project_id
    now = F.to_timestamp_ntz(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss"))
    at = F.when(own & F.lit(not on), F.lit(None)).when(own & ~F.col("is_archived"), now.cast(projects.schema["archived_at"].dataType)).otherwise(F.col("archived_at"))
    return projects.withColumn("archived_at", at).withColumn("is_archived", F.when(own, F.lit(on)).otherwise(F.col("is_archived")))


OUTCOMES = ["final_delay_days", "significant_delay", "final_cost_overrun_pct", "cost_overrun"]


def judged_appends(new: DataFrame, snapshots: DataFrame, projects: DataFrame) -> DataFrame:
    """new with derived columns and `refused`: the first guard that a row fails, or null.

    Guards in order: unknown project, finished project (before, or earlier in the batch), month already there (or twice in the batch), month before the start,
    a finished row without outcomes, an open row with outcomes. Of rows that repeat a month, the one of the least hash of all columns counts.
    """
    ended = snapshots.where("is_terminal_snapshot").select("project_id").distinct().withColumn("__ended", F.lit(True))
    there = snapshots.select("project_id", "reporting_month").distinct().withColumn("__there", F.lit(True))
    starts = projects.select("project_id", F.col("planned_start_date").alias("__start"))
    rows = new.join(starts, "project_id", "left").join(ended, "project_id", "left").join(there, ["project_id", "reporting_month"], "left")
    twice = F.row_number().over(Window.partitionBy("project_id", "reporting_month").orderBy(F.xxhash64(*sorted(new.columns)))) > 1
    done = F.col("project_status") == "Completed"
    known = lambda f: f([F.col(c).isNotNull() for c in OUTCOMES])

    def all_of(x):
        out = F.lit(True)
        for c in x:
            out = out & c
        return out

    def any_of(x):
        out = F.lit(False)
        for c in x:
            out = out | c
        return out

    since = months_between_starts(F.col("__start"), F.col("reporting_month"))
    refused = (
        F.when(F.col("__start").isNull(), "unknown project")
        .when(F.col("__ended") | F.coalesce(F.col("reporting_month") > F.col("__end"), F.lit(False)), "project has ended")
        .when(F.col("__there") | F.col("__twice"), "month exists")
        .when(since < 0, "month before start")
        .when(done & ~known(all_of), "outcomes missing")
        .when(~done & known(any_of), "outcomes before the end")
    )
    end = F.min(F.when(done & known(all_of), F.col("reporting_month"))).over(Window.partitionBy("project_id"))
    out = rows.withColumns({"__twice": twice, "__end": end}).withColumns({"months_since_start": since.cast("int"), "is_terminal_snapshot": done, "refused": refused})
    gap = lambda a, b: F.col(a) - F.col(b)
    derived = {"physical_progress_variance_pct": ("actual_physical_progress_pct", "planned_physical_progress_pct"), "financial_progress_variance_pct": ("actual_financial_progress_pct", "planned_financial_progress_pct"), "expenditure_variance_pct": ("actual_financial_progress_pct", "planned_financial_progress_pct")}
    out = out.withColumns({c: gap(*p) for c, p in derived.items() if set(p) <= set(new.columns)})
    return out.drop("__start", "__ended", "__there", "__twice", "__end")


def appended(new: DataFrame, snapshots: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots with the accepted rows, refused rows with reasons)."""
    judged = judged_appends(new, snapshots, projects)
    good = judged.where("refused IS NULL").drop("refused")
    return snapshots.unionByName(good.select(*[c for c in good.columns if c in snapshots.columns]), allowMissingColumns=True), judged.where("refused IS NOT NULL")


def project_report(projects: DataFrame, snapshots: DataFrame, risk: DataFrame, project_id) -> DataFrame:
    """One nested row: the project, its history in order, and its risk entry if any."""
    p = projects.where(F.col("pid") == project_id)
    h = snapshots.where(F.col("pid") == project_id).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("midx", "month", "cost", "n_orders"))).alias("history"))
    r = risk.where(F.col("pid") == project_id).select("pid", F.struct("score", "level").alias("risk"))
    return p.join(h, "pid", "left").join(r, "pid", "left")
