import random

import pytest
from pyspark.sql import functions as F

from girder.operators import measures
from tests.panel_data import generate_panel

PCT = ["planned_physical_progress_pct", "actual_physical_progress_pct"]
AMOUNTS = ["actual_cost_to_date_inr_cr", "planned_expenditure_inr_cr"]


@pytest.fixture(scope="module")
def panel(spark):
    return generate_panel(spark, 30, seed=1).cache()


def status(rows):
    return {r["check"]: r["status"] for r in measures.panel_report(rows, PCT, AMOUNTS, leak=["project_length_km"]).collect()}


def test_generated_panels_are_clean(panel):
    assert {c: s for c, s in status(panel).items() if s == "FAIL"} == {}


#: SQL expressions that break one check each.
FAULTS = {
    "pct_range": ("actual_physical_progress_pct", "101.0"),
    "id_format": ("reporting_month", "'2020-13'"),
    "non_negative": ("planned_expenditure_inr_cr", "-1.0"),
    "labels": ("significant_delay", "1 - significant_delay"),
    "variance": ("physical_progress_variance_pct", "77.0"),
    "cost_parts": ("material_cost_inr_cr", "material_cost_inr_cr * 2 + 1"),
    "dates": ("planned_completion_date", "planned_start_date"),
    "extremes": ("project_length_km", "501.0"),
    "provenance": ("data_provenance", "if(project_id = 'PRJ-0001', 'X', 'Y')"),
    "constant_targets": ("final_delay_days", "months_since_start"),
    "missing": ("contractor", "cast(null as string)"),
    "leakage": ("project_length_km", "final_cost_overrun_pct * 2"),
    "duplicates": ("reporting_month", "'2020-01'"),
}


@pytest.mark.parametrize("name", FAULTS)
def test_each_check_sees_its_fault(panel, name):
    column, fault = FAULTS[name]
    assert status(panel.withColumn(column, F.expr(fault)))[name] != "PASS"


def test_missing_columns(panel):
    assert measures.missing_columns(panel, ["state", "nothing"]) == ["nothing"]


def test_ranking_metrics_equal_pair_counts(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), rng.randint(0, 6) / 6) for _ in range(80)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap = 0.0
    for s in set(x for _, x in rows):
        over = [y for y, x in rows if x >= s]
        ap += sum(y for y, x in rows if x == s) * sum(over) / len(over)
    got = measures.ranking_metrics(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    assert got["roc_auc"] == pytest.approx(auc) and got["avg_precision"] == pytest.approx(ap / len(pos))
    assert measures.ranking_metrics(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()["roc_auc"] is None


def test_zero_denominators(spark):
    got = measures.classification_metrics(spark.createDataFrame([(0, 0), (0, 0)], "y int, p int"), "y", "p").first()
    assert (got["accuracy"], got["precision"], got["recall"], got["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_split_sizes_and_order(spark):
    keys = spark.createDataFrame([(k, k // 3) for k in range(50)], "key int, start int")
    got = measures.chronological_split(keys, "start", "key").collect()
    sizes = {s: sum(r["split"] == s for r in got) for s in ("train", "validation", "test")}
    assert sizes == {"train": 35, "validation": round(7.5), "test": 50 - 35 - round(7.5)}
    assert max(r["start"] for r in got if r["split"] == "train") <= min(r["start"] for r in got if r["split"] == "test")
