"""Descriptive statistics, data-quality checks and model metrics, each one aggregate pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.operators.order import running
from girder.operators.quantiles import median_of, quantiles


def long_form(one: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """A one-row frame with columns <name>__<field> as a row for each name."""
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), *[F.col(f"{n}__{f}").alias(f) for f in fields]) for n in names])))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std (n - 1), min, 5/25/50/75/95 % and max of each column, exact."""
    fields = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "lo": F.min, "hi": F.max}
    aggs = [f(c).cast("double").alias(f"{c}__{k}") for c in columns for k, f in fields.items()]
    marks = (0.05, 0.25, 0.5, 0.75, 0.95)
    rest = quantiles(rows, columns, marks).select("column", *[F.get("marks", F.lit(k)).alias(f"p{int(p * 100)}") for k, p in enumerate(marks)])
    return long_form(rows.agg(*aggs), columns, list(fields)).join(F.broadcast(rest), "column")


def null_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage of nulls of the columns that have any."""
    one = rows.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"{c}__pct") for c in columns])
    return long_form(one, columns, ["pct"]).where("pct > 0").select("column", F.round("pct", 4).alias("pct"))


def ranges(rows: DataFrame, columns: list[str]) -> DataFrame:
    """min, max and number of known values of each column."""
    aggs = [f(c).cast("double").alias(f"{c}__{k}") for c in columns for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    return long_form(rows.agg(*aggs), columns, ["lo", "hi", "n"])


def shares(rows: DataFrame, c: str, top: int = 5) -> DataFrame:
    """The most frequent values with their shares of all rows."""
    n = rows.agg(F.count("*").alias("__n"))
    out = rows.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).join(F.broadcast(n))
    return out.select("value", "n", F.round(F.col("n") / F.col("__n"), 4).alias("share")).orderBy(F.desc("n"), "value").limit(top)


def correlations(rows: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Pearson correlation with the target over rows where both are known."""
    one = rows.agg(*[F.corr(c, target).alias(f"{c}__r") for c in columns])
    return long_form(one, columns, ["r"])


# ---------------------------------------------------------------- quality checks


def check(name: str, faults: Column, what: str, warn: bool = False) -> tuple[str, Column, str, bool]:
    return name, faults, what, warn


def run_checks(rows: DataFrame, checks: list[tuple[str, Column, str, bool]]) -> DataFrame:
    """(check, status, faults, message): every aggregate of the list in one pass over rows."""
    one = rows.agg(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c, _, _ in checks])
    made = [F.struct(F.lit(n).alias("check"), F.when(F.col(n) == 0, "PASS").otherwise("WARN" if warn else "FAIL").alias("status"), F.col(n).alias("faults"), F.lit(what).alias("message")) for n, _, what, warn in checks]
    return one.select(F.inline(F.array(*made)))


def missing_columns(rows: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in rows.columns]


def panel_checks(pct: list[str], amounts: list[str], key: str = "project_id", month: str = "reporting_month", ids: str = r"^[A-Z]+(-[A-Z]+)*-\d{4,}$") -> list:
    """The row-level checks of a snapshot panel (percentages, amounts, formats, derived values, labels, extremes)."""
    c, bad = F.col, F.count_if
    anyof = lambda tests: bad(F.coalesce(tests, F.lit(False)))

    def or_all(items: list[Column]) -> Column:
        total = F.lit(False)
        for x in items:
            total = total | F.coalesce(x, F.lit(False))
        return total

    parts = c("material_cost_inr_cr") + c("labour_cost_inr_cr") + c("equipment_cost_inr_cr") + c("delay_related_cost_inr_cr") + F.coalesce("variation_cost_inr_cr", F.lit(0.0))
    return [
        check("id_format", bad(~c(key).rlike(ids) | ~c(month).rlike(r"^\d{4}-(0[1-9]|1[0-2])$")), "ids and months have their formats"),
        check("known_ids", bad(c(key).isNull() | c(month).isNull() | c("significant_delay").isNull() | c("cost_overrun").isNull()), "ids and targets are known"),
        check("pct_range", anyof(or_all([(c(x) < 0) | (c(x) > 100) for x in pct])), "percentages lie in 0 to 100"),
        check("non_negative", anyof(or_all([c(x) < 0 for x in amounts]) | (c("original_contract_value_inr_cr") <= 0)), "amounts are not negative"),
        check("dates", anyof(c("planned_completion_date") <= c("planned_start_date")), "completion follows start"),
        check("variance", anyof(F.abs(c("physical_progress_variance_pct") - (c("actual_physical_progress_pct") - c("planned_physical_progress_pct"))) > 0.05), "variance is actual less planned"),
        check("cost_parts", anyof(F.abs(parts - c("actual_cost_to_date_inr_cr")) > 0.02 + 0.01 * F.abs(c("actual_cost_to_date_inr_cr"))), "cost components add up"),
        check("labels", anyof((c("significant_delay") != (c("final_delay_days") > 60).cast("int")) | (c("cost_overrun") != (c("final_cost_overrun_pct") > 10.0).cast("int"))), "labels follow their thresholds"),
        check("extremes", anyof((c("project_length_km") > 500) | (c("original_contract_value_inr_cr") > 15000) | (F.abs(c("final_delay_days")) > 3000) | (c("planned_duration_months") > 120)), "no extreme values", warn=True),
        check("provenance", F.count_distinct("data_provenance") - 1, "one provenance"),
        check("target_shares", bad(F.lit(False)) + F.when(F.avg("significant_delay").between(0.02, 0.98) & F.avg("cost_overrun").between(0.02, 0.98), 0).otherwise(1), "targets have both classes", warn=True),
    ]


def panel_report(rows: DataFrame, pct: list[str], amounts: list[str], key: str = "project_id", month: str = "reporting_month", leak: list[str] | None = None) -> DataFrame:
    """All checks of a panel as one frame; those about groups and correlations beside the row-level pass."""
    one = run_checks(rows, panel_checks(pct, amounts, key, month))
    twice = rows.groupBy(key, month).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("double").alias("f"))
    steady = rows.groupBy(key).agg(F.count_distinct("final_delay_days", "final_cost_overrun_pct").alias("n")).agg(F.count_if(F.col("n") > 1).cast("double").alias("f"))
    share = [F.avg(F.col(c).isNull().cast("double")) for c in rows.columns]
    empty = rows.agg(F.greatest(*share).alias("m")).select(F.when(F.col("m") > 0.15, 1.0).otherwise(0.0).alias("f"))

    def as_row(df: DataFrame, name: str, what: str, worst: str) -> DataFrame:
        return df.select(F.lit(name).alias("check"), F.when(F.col("f") == 0, "PASS").otherwise(worst).alias("status"), F.col("f").alias("faults"), F.lit(what).alias("message"))

    out = one.union(as_row(twice, "duplicates", "one row a project and month", "FAIL")).union(as_row(steady, "constant_targets", "targets are constant in a project", "FAIL")).union(as_row(empty, "missing", "no column misses over 15 %", "WARN"))
    if leak:
        r = [F.abs(F.corr(c, t)) for c in leak for t in ("final_delay_days", "final_cost_overrun_pct")]
        high = rows.agg(F.greatest(*[F.coalesce(x, F.lit(0.0)) for x in r], F.lit(0.0)).alias("m")).select(F.when(F.col("m") > 0.95, 1.0).otherwise(0.0).alias("f"))
        out = out.union(as_row(high, "leakage", "no predictor follows a target", "FAIL"))
    return out


# ---------------------------------------------------------------- model metrics


def regression_metrics(rows: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    mean = rows.agg(F.avg(y).alias("__m"))
    out = rows.join(F.broadcast(mean)).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("__sse"), F.sum((F.col(y) - F.col("__m")) * (F.col(y) - F.col("__m"))).alias("__sst")
    )
    out = out.join(F.broadcast(median_of(rows, F.abs(e), "median_ae")))
    return out.select("mae", "rmse", F.when(F.col("__sst") > 0, 1 - F.col("__sse") / F.col("__sst")).alias("r2"), "median_ae")


def classification_metrics(rows: DataFrame, y: str, predicted: str) -> DataFrame:
    """Confusion counts and rates; 0 where a denominator is 0."""
    t, p = F.col(y) == 1, F.col(predicted) == 1
    out = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def ranking_metrics(rows: DataFrame, y: str, score: str) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; null with a single class.

    Rows shrink to one for each distinct score first; the sums up to each are taken in ranges of scores.
    """
    per = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    per = running(per, ["s"], {"neg": "neg_to", "pos": "pos_to"})
    whole = per.agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__q"))
    per = per.join(F.broadcast(whole))
    per = per.withColumns({"neg_below": F.col("neg_to") - F.col("neg"), "pos_over": F.col("__p") - F.col("pos_to") + F.col("pos"), "neg_over": F.col("__q") - F.col("neg_to") + F.col("neg")})
    per = per.withColumn("all_over", F.col("pos_over") + F.col("neg_over"))
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    hits = F.sum(F.col("pos") * F.col("pos_over") / F.col("all_over"))
    out = per.agg(area.alias("area"), hits.alias("hits"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return out.select(F.when(both, F.col("area") / (F.col("p") * F.col("n"))).alias("roc_auc"), F.when(both, F.col("hits") / F.col("p")).alias("avg_precision"))


def chronological_split(keys: DataFrame, start: str, key: str, train: float = 0.70, valid: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds split: the earliest starts train, the next validate, the rest test; equal starts by a seeded hash of the key.

    Sizes round half to even.
    """
    from girder.operators import splits

    return splits.chronological_split(keys, start, key, train, valid, tie=F.xxhash64(F.lit(seed), key))
