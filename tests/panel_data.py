"""A deterministic panel in the snapshot file's schema, for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators.panel import DELAY_FACTORS, s_curve
from girder.sources.schemas import SNAPSHOT_FILE, names


def generate_panel(spark: SparkSession, projects: int, seed: int = 42, months: int = 24) -> DataFrame:
    """A deterministic panel in the snapshot file's schema: draws are hashes of (seed, project, month), whatever the partitions."""
    u = lambda *key: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.lit(k) if isinstance(k, str) else k for k in key]), 11).cast("double") / float(1 << 53)
    p = spark.range(projects).withColumnRenamed("id", "k")
    states = F.array(*[F.lit(s) for s in ("Gujarat", "Kerala", "Punjab", "Assam", "Odisha")])
    types = F.array(*[F.lit(s) for s in ("Four Laning", "Six Laning", "Bypass")])
    p = p.withColumns({"value": F.round(200 + 1800 * u("value", F.col("k")), 2), "duration": (12 + F.floor(u("dur", F.col("k")) * (months - 12))).cast("int"), "skill": 0.8 + 0.4 * u("skill", F.col("k")), "start": F.add_months(F.lit("2018-01-01").cast("date"), (u("start", F.col("k")) * 36).cast("int"))})
    p = p.withColumns({"state": F.get(states, F.floor(u("state", F.col("k")) * 5).cast("int")), "ptype": F.get(types, F.floor(u("type", F.col("k")) * 3).cast("int")), "actual_months": F.ceil(F.col("duration") / F.col("skill")).cast("int")})
    r = p.select("*", F.explode(F.sequence(F.lit(1), F.col("actual_months"))).alias("m"))
    planned = F.round(s_curve(F.col("m").cast("double"), F.col("duration").cast("double")), 2)
    actual = F.round(s_curve(F.col("m").cast("double"), F.col("actual_months").cast("double")), 2)
    late = F.datediff(F.add_months("start", F.col("actual_months")), F.add_months("start", F.col("duration")))
    over = F.round(25 * u("over", F.col("k")) - 5, 2)
    cost = F.round(F.col("value") * actual / 100 * (1 + over / 100), 4)
    joint = u("joint", F.col("k"), F.col("m")) >= 0.04
    hole = lambda name, share, c: F.when(u(name, F.col("k"), F.col("m")) >= share, c)
    cols = {
        "project_id": F.format_string("PRJ-%04d", F.col("k") + 1), "data_provenance": F.lit("SYNTHETIC"), "project_name": F.concat(F.lit("Project "), F.col("k").cast("string")), "highway_number": F.concat(F.lit("NH-"), (F.col("k") % 90 + 1).cast("string")),
        "state": F.col("state"), "project_type": F.col("ptype"), "project_status": F.when(F.col("m") == F.col("actual_months"), "Completed").otherwise("In Progress"), "contractor": hole("contractor", 0.01, F.concat(F.lit("C"), (F.col("k") % 40).cast("string"))),
        "reporting_month": F.date_format(F.add_months("start", F.col("m")), "yyyy-MM"), "planned_start_date": F.col("start"), "planned_completion_date": F.add_months("start", F.col("duration")), "planned_duration_months": F.col("duration"), "months_since_start": F.col("m"),
        "project_length_km": F.round(10 + 90 * u("km", F.col("k")), 2), "original_contract_value_inr_cr": F.col("value"), "planned_physical_progress_pct": planned, "actual_physical_progress_pct": actual, "physical_progress_variance_pct": F.round(actual - planned, 2),
        "planned_financial_progress_pct": planned, "actual_financial_progress_pct": F.when(joint, actual), "financial_progress_variance_pct": F.when(joint, F.round(actual - planned, 2)), "actual_expenditure_inr_cr": F.when(joint, cost), "expenditure_variance_pct": F.when(joint, F.round(actual - planned, 2)),
        "planned_expenditure_inr_cr": F.round(F.col("value") * planned / 100, 4), "planned_cost_to_date_inr_cr": F.round(F.col("value") * planned / 100, 4), "actual_cost_to_date_inr_cr": cost, "material_cost_inr_cr": F.round(cost * 0.5, 4), "labour_cost_inr_cr": F.round(cost * 0.3, 4),
        "equipment_cost_inr_cr": F.round(cost * 0.15, 4), "delay_related_cost_inr_cr": F.round(cost * 0.05, 4), "variation_cost_inr_cr": hole("variation", 0.03, F.lit(0.0)),
    }
    for i, c in enumerate(DELAY_FACTORS):
        days = F.round(F.greatest(F.lit(0.0), 12 * u(c, F.col("k"), F.col("m")) - 6 - i % 3), 1)
        cols[c] = hole(f"{c}?", 0.03, days) if c in ("equipment_unavailability_days", "weather_disruption_days") else days
    cols |= {"contractor_productivity_factor": F.round(F.col("skill"), 4), "final_delay_days": late.cast("int"), "significant_delay": (late > 60).cast("int"), "final_cost_overrun_pct": over, "cost_overrun": (over > 10.0).cast("int")}
    return r.select(*[cols[c].alias(c) for c in names(SNAPSHOT_FILE)])
