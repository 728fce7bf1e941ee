import pytest
from pyspark.sql import functions as F

from girder.operators import panel


def series(spark, values, name="v", kind="int"):
    return spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], f"pid string, midx int, {name} {kind}")


def column(df, c):
    return [r[c] for r in df.orderBy("midx").collect()]


def test_run_length_vector(spark):
    rows = series(spark, [1, 1, 0, 1, 1, 1, 0, 0, 1])
    assert column(panel.run_length(rows, "v", "run"), "run") == [1, 2, 0, 1, 2, 3, 0, 0, 1]


def test_rising_counts_the_level_after_a_null(spark):
    rows = series(spark, [5, 5, None, 5, 6])
    assert column(rows.withColumn("e", panel.rising("v", panel.by_month())), "e") == [1, 0, 0, 1, 1]


def test_trailing_windows_count_rows(spark):
    rows = spark.createDataFrame([("a", 1, 10.0), ("a", 9, 20.0), ("a", 10, 60.0), ("a", 30, 100.0)], "pid string, midx int, v double")
    w = panel.by_month()
    got = rows.withColumn("i", panel.increment("v", w)).withColumn("t", panel.trailing_mean("i", w))
    assert column(got, "i") == [10.0, 10.0, 40.0, 40.0]
    assert column(got, "t") == pytest.approx([10.0, 10.0, 20.0, 30.0])


def test_ratio_is_capped_and_null_safe(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 2.0), (2.0, None)], "a double, b double")
    assert [r[0] for r in df.select(panel.capped_ratio(F.col("a"), F.col("b"))).collect()] == [5.0, 0.5, None, None]


def test_strict_totals(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None)], "a double, b double")
    assert [tuple(r) for r in df.select(panel.strict_total(["a", "b"]), panel.strict_count_positive(["a", "b"])).collect()] == [(1.0, 1), (None, None)]


def test_first_known_is_column_by_column(spark):
    rows = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, "q", None), ("b", 1, None, None)], "pid string, midx int, c string, d string")
    got = {r["pid"]: (r["c"], r["d"]) for r in panel.first_known(rows, ["c", "d"], "pid", "midx").collect()}
    assert got == {"a": ("q", "x"), "b": (None, None)}


def test_features_of_a_prefix_equal_the_full_file(spark):
    from tests.panel_data import generate_panel

    rows = generate_panel(spark, 6, seed=7).cache()
    full = panel.snapshot_features(rows).where("reporting_month <= '2019-12'")
    cut = panel.snapshot_features(rows.where("reporting_month <= '2019-12'"))
    assert full.count() > 20 and full.exceptAll(cut).isEmpty() and cut.exceptAll(full).isEmpty()


def test_month_difference_ignores_days(spark):
    df = spark.createDataFrame([("2020-01-31", "2020-03"), ("2020-05-01", "2019-12")], "s string, m string")
    assert [r[0] for r in df.select(panel.months_between_starts(F.col("s").cast("date"), F.col("m"))).collect()] == [2, -5]


def test_latest_rows(spark):
    rows = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 5, True)], "pid string, midx int, is_terminal boolean")
    assert [tuple(r) for r in panel.latest_open_month(rows).collect()] == [("a", 1)]
    assert sorted(tuple(r) for r in panel.latest_row(rows, ["is_terminal"]).collect()) == [("a", 2, True), ("b", 5, True)]
