"""Splits, scoring and decision support on small tables."""

import pytest
from pyspark.sql import functions as F

from girder.operators import decisions, order, scoring, splits


def test_numbers_and_running_sums(spark):
    rows = spark.createDataFrame([(k * 7919 % 101, k) for k in range(101)], "a long, b long").repartition(7)
    got = {r["a"]: r["rn"] for r in order.numbered(rows, ["a"]).collect()}
    assert got == {k: k + 1 for k in range(101)}
    sums = {r["a"]: r["upto"] for r in order.running(rows, ["a"], {"a": "upto"}).collect()}
    assert sums == {k: k * (k + 1) // 2 for k in range(101)}
    assert order.numbered(rows.where("a < 0"), ["a"]).collect() == []


def test_splits_are_refused_where_they_are_unsafe(spark):
    keys = spark.createDataFrame([(f"p{k}", k // 3) for k in range(20)], "pid string, start int")
    s = splits.chronological_split(keys, "start", "pid")
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 14, "validation": 3, "test": 3}
    with pytest.raises(ValueError, match="no split"):
        splits.assigned(spark.createDataFrame([("p99",)], "pid string"), s, "pid")
    with pytest.raises(ValueError, match="empty split"):
        splits.chronological_split(keys.limit(2), "start", "pid")
    both = s.select("pid", "split").union(spark.createDataFrame([("p0", "test")], "pid string, split string"))
    assert [r["pid"] for r in splits.split_overlaps(both, "pid").collect()] == ["p0"]


def test_feature_tables_and_task_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0, False, 0, 1.5)], "pid int, x double, is_terminal boolean, late int, cost double")
    table = splits.feature_table(rows, ["pid"], ["x"], "is_terminal", ["late", "cost"])
    assert table.columns == ["pid", "x", "is_terminal", "late", "cost"]
    with pytest.raises(ValueError, match="missing columns: y"):
        splits.feature_table(rows, ["pid"], ["y"], "is_terminal", [])
    splits.write_task_files(table, str(tmp_path), {"delay": ["late"], "cost": ["cost"]})
    assert spark.read.option("header", True).csv(f"{tmp_path}/delay").columns == ["pid", "x", "is_terminal", "late"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/cost").columns == ["pid", "x", "is_terminal", "cost"]


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(k, 1, float(k % 10), "a" if k % 3 else "b", int(k % 10 > 4), 2.0 * (k % 10) + 1, int(k % 7 > 3), float(k % 5)) for k in range(120)]
    return spark.createDataFrame(rows, "pid int, m int, x double, kind string, late int, days double, over int, pct double")


def test_registry_scores_four_tasks_and_fails_loudly(spark, panel, tmp_path):
    targets = {"significant_delay": "late", "final_delay_days": "days", "cost_overrun": "over", "final_cost_overrun_pct": "pct"}
    registry = scoring.fit_tasks(panel, ["x"], ["kind"], targets)
    out = scoring.score_tasks(panel, registry).collect()
    assert len(out) == 120 and all(abs(r["delay_days_pred"] - r["days"]) < 1e-3 and r["delay_class"] == r["late"] for r in out)
    registry.save(str(tmp_path), spark)
    again = scoring.Registry.load(str(tmp_path), spark)
    assert {r["pid"]: round(r["delay_p"], 6) for r in scoring.score_tasks(panel, again).collect()} == {r["pid"]: round(r["delay_p"], 6) for r in out}
    with pytest.raises(FileNotFoundError):
        scoring.Registry.load(f"{tmp_path}/none", spark)
    holes = panel.withColumn("x", F.when(F.col("pid") != 3, F.col("x")))
    eligible = panel.where("pid < 10").select("pid", "m")
    done, failed = scoring.batch_scores(holes, eligible, registry, "pid", "m", ["x"])
    assert done.count() == 9 and [tuple(r) for r in failed.collect()] == [(3, 1, "x is missing")]
    for n in (9, 4):
        assert scoring.reload_cache(done.limit(n), f"{tmp_path}/cache") == n


def test_attributions_of_fitted_tasks_add_up(spark, panel):
    import math

    targets = {"significant_delay": "late", "final_delay_days": "days", "cost_overrun": "over", "final_cost_overrun_pct": "pct"}
    families = {"significant_delay": "logistic", "final_delay_days": "linear", "cost_overrun": "boosted", "final_cost_overrun_pct": "forest"}
    panel = panel.withColumns({"x": F.when(F.col("pid") != 3, F.col("x")), "kind": F.when(F.col("pid") != 4, F.col("kind"))})
    registry = scoring.fit_tasks(panel, ["x"], ["kind"], targets, families)
    scored = {r["pid"]: r for r in scoring.score_tasks(panel, registry).collect()}
    margin = {
        "significant_delay": lambda r: math.log(r["delay_p"] / (1 - r["delay_p"])), "final_delay_days": lambda r: r["delay_days_pred"],
        "cost_overrun": lambda r: math.log(r["cost_p"] / (1 - r["cost_p"])), "final_cost_overrun_pct": lambda r: r["cost_pct_pred"],
    }
    for task in targets:
        rows = scoring.task_attributions(panel, registry, task, "pid", panel).collect()
        assert sorted({r["feature"] for r in rows}) == ["kind", "x"] and len(rows) == 240
        total = {}
        for r in rows:
            total[r["pid"]] = total.get(r["pid"], 0.0) + r["attribution"]
        scale = 0.5 if task == "cost_overrun" else 1.0  # the probability of Spark's boosted trees is that of twice their sum
        rest = [scale * margin[task](scored[k]) - v for k, v in total.items()]
        assert max(rest) - min(rest) < 1e-6, task  # every row is as far from the same base
        if families[task] == "linear":
            assert abs(rest[0] - sum(margin[task](r) for r in scored.values()) / len(scored)) < 1e-6
    assert scoring.task_attributions(panel.where("pid < 0"), registry, "significant_delay", "pid", panel).count() == 0


def test_scenarios_of_fitted_tasks(spark, panel):
    registry = scoring.fit_tasks(panel, ["x"], ["kind"], {"significant_delay": "late", "final_delay_days": "days"})
    got = {r["pid"]: r for r in scoring.scenario_scores(panel, registry, "final_delay_days", "pid", panel, ["delay_days_pred"]).collect()}
    before = {r["pid"]: r["delay_days_pred"] for r in scoring.score_tasks(panel, registry).collect()}
    at_mean = {r["pid"]: r["delay_days_pred"] for r in scoring.score_tasks(panel.withColumn("x", F.lit(4.5)), registry).collect()}
    assert len(got) == 120
    for k, r in got.items():
        assert (r["field"], r["reference"]) == ("x", 4.5)
        assert abs(r["delay_days_pred_base"] - before[k]) < 1e-9 and abs(r["delay_days_pred_new"] - at_mean[k]) < 1e-9


def test_simulation_keeps_the_baseline(spark, panel):
    score = lambda rows: rows.withColumn("s", F.col("x") * 2)
    out = scoring.simulated(panel.where("pid < 3"), {"x": 10.0}, score, "pid", ["s"])
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0.0, 20.0, 20.0), (1, 2.0, 20.0, 18.0), (2, 4.0, 20.0, 16.0)]


def test_scenarios_skip_texts(spark):
    rows = spark.createDataFrame([(1,), (2,)], "pid int")
    a = spark.createDataFrame([(1, "x", 3.0), (1, "y", -4.0), (2, "state_A", 9.0), (2, "x", 1.0)], "pid int, feature string, attribution double")
    means = spark.createDataFrame([(5.0, 6.0)], "x double, y double")
    got = {r["pid"]: (r["field"], r["reference"]) for r in scoring.scenarios(rows, a, means, "pid", ["x", "y"]).collect()}
    assert got == {1: ("y", 6.0), 2: (None, None)}


def test_guards_of_wording_and_dispatch(spark):
    rows = spark.createDataFrame([("may differ",), ("This IS WRONG",)], "t string")
    assert [r[0] for r in rows.select(decisions.unhedged(F.col("t"))).collect()] == [False, True]
    with pytest.raises(ValueError, match="unhedged"):
        decisions.hedged(rows, "t")
    calls = []
    engine = {"overview": lambda named, message: calls.append((named["intent"], message))}
    decisions.answered("how is the portfolio", {"intent": "portfolio"}, engine)
    assert calls == [("portfolio", "how is the portfolio")] and decisions.answered("?", {"intent": "unsupported"}, engine) is None


def test_overview_without_scores(spark):
    none = spark.createDataFrame([], "pid int, p_delay double, p_cost double, delay_pred double, cost_pred double, level string, score double")
    r = decisions.predicted_overview(none).first()
    assert r["status"] == "cache_unavailable" and r["n_scored"] == 0 and r["mean_p_delay"] is None and r["n_high"] == 0


def test_tasks_are_explained_in_one_pass(spark, panel):
    """Tasks that share their preparation read rows and background once, and give what each gives alone."""
    targets = {"significant_delay": "late", "final_delay_days": "days", "cost_overrun": "over", "final_cost_overrun_pct": "pct"}
    families = {"significant_delay": "logistic", "final_delay_days": "linear", "cost_overrun": "logistic", "final_cost_overrun_pct": "forest"}
    registry = scoring.fit_tasks(panel, ["x"], ["kind"], targets, families)
    linear = scoring.attributions(panel, registry, list(targets)[:3], "pid", panel)
    assert linear._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    both = {(r["pid"], r["task"], r["feature"]): r["attribution"] for r in scoring.attributions(panel, registry, list(targets), "pid", panel).collect()}
    assert len(both) == 120 * 4 * 2
    for task in targets:
        alone = scoring.task_attributions(panel, registry, task, "pid", panel).collect()
        assert {(r["pid"], task, r["feature"]): r["attribution"] for r in alone} == {k: v for k, v in both.items() if k[1] == task}


def test_the_training_rows_are_the_background_by_default(spark, panel):
    registry = scoring.fit_tasks(panel, ["x"], ["kind"], {"final_delay_days": "days"})
    given, default = [{(r["pid"], r["feature"]): r["attribution"] for r in scoring.attributions(panel, registry, ["final_delay_days"], "pid", *b).collect()} for b in ([panel], [])]
    assert given.keys() == default.keys() and all(abs(v - default[k]) < 1e-9 for k, v in given.items())
    registry.ready = None
    with pytest.raises(ValueError, match="name a background"):
        scoring.attributions(panel, registry, ["final_delay_days"], "pid")


def test_panel_of_the_models_is_written_once(spark, small):
    """Orders are not behind the panel any more; splits, outcomes, projects and latest months are those of the joins."""
    from girder.plans import decisions as plans
    from girder.plans.views import eligible, outcomes, projects

    rows = plans._features(spark, small)
    assert "o_custkey" not in (plan := rows._jdf.queryExecution().analyzed().toString()) and "Join" not in plan
    known = projects(spark, small).select("pid", "ptype").join(outcomes(spark, small).drop("midx"), "pid")
    want = plans.split_rows(spark, small).drop("start").join(known, "pid").join(eligible(spark, small), "pid", "left")
    columns = ["pid", "midx", "n_orders", "cost", "done", "severity", "is_terminal", "split", "ptype", "delayed", "overrun", "delay_days", "overrun_pct"]
    table = lambda df: sorted(map(repr, (tuple(r) for r in df.withColumns({c: F.col(c).cast("double") for c in ("n_orders", "done", "severity", "delay_days")}).select(*columns, "latest").collect())))
    got = table(rows.withColumn("latest", F.coalesce("is_latest", F.lit(False))))
    assert got and got == table(want.withColumn("latest", F.coalesce(F.col("midx") == F.col("m"), F.lit(False))))


def test_scenarios_prepare_and_read_rows_once(spark, panel):
    """Tasks prepared alike share their features, and both sides of a what-if come from one reading of the rows."""
    registry = scoring.fit_tasks(panel, ["x"], ["kind"], {"significant_delay": "late", "final_delay_days": "days"})
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    both = scoring.score_tasks(panel, registry)
    assert both.columns == [*panel.columns, "delay_model", "delay_class", "delay_p", "delay_days_model", "delay_days_pred"]
    apart = scoring.fit_tasks(panel, ["x"], ["kind"], {"final_delay_days": "days"})
    mixed = scoring.Registry(registry.numeric, registry.text, registry.fitted | apart.fitted, registry.medians)
    assert sorted(map(tuple, scoring.score_tasks(panel, mixed).collect())) == sorted(map(tuple, both.collect()))
    out = scoring.simulated(panel, {"x": F.col("x") * 2}, lambda rows: scoring.score_tasks(rows, registry), "pid", ["delay_p", "delay_days_pred"])
    assert plan(out).count("LogicalRDD") == 1 and "Union" not in plan(out) and plan(out).count("AS __num") == 1
    again = {r["pid"]: r["delay_days_pred"] for r in scoring.score_tasks(panel.withColumn("x", F.col("x") * 2), registry).collect()}
    assert all(abs(r["delay_days_pred_new"] - again[r["pid"]]) < 1e-9 for r in out.collect())
