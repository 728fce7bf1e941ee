import pytest
from pyspark.sql import functions as F

from girder.operators import portfolio

SCORES = "pid long, delay_pred double, cost_pred double, p_delay double, c_delay int, p_cost double, c_cost int"


def scored(spark, rows):
    return {r["pid"]: r for r in portfolio.risk_scores(spark.createDataFrame(rows, SCORES)).collect()}


def test_two_rows_span_the_scale(spark):
    got = scored(spark, [(1, 0.0, 0.0, 0.0, 0, 0.0, 0), (2, 100.0, 10.0, 1.0, 1, 1.0, 1)])
    assert (got[1]["score"], got[2]["score"]) == (0.0, 100.0)


def test_four_rows_get_four_levels(spark):
    got = scored(spark, [(k, 100 * k / 3, 10 * k / 3, k / 3, 0, k / 3, 0) for k in range(4)])
    assert [got[k]["level"] for k in range(4)] == list(portfolio.LEVELS)


def test_equal_predictions_count_half(spark):
    got = scored(spark, [(k, 50.0, 5.0, 0.5, 0, 0.5, 0) for k in range(2)])
    assert got[0]["score"] == 50.0 and got[0]["level"] == "LOW"


def test_missing_probability_falls_back_to_the_class(spark):
    got = scored(spark, [(1, 50.0, 5.0, None, 1, None, 0)])
    assert got[1]["score"] == 100 * ((1 + 0.5) / 2 + (0 + 0.5) / 2) / 2 and got[1]["level"] == "LOW"


def test_no_rows(spark):
    assert scored(spark, []) == {}
    assert portfolio.overview(spark.createDataFrame([], "delayed int, overrun int, delay_days int, overrun_pct double")).first()["delay_rate"] == 0.0


@pytest.mark.parametrize("n", [2, 3, 5, 8, 11, 40])
def test_quartiles_are_inclusive(spark, n):
    import statistics

    v = [float((k * 37) % 101) for k in range(n)]
    got = portfolio.quartile_cuts(spark.createDataFrame([(x,) for x in v], "x double"), "x").first()
    assert [got["q1"], got["q2"], got["q3"]] == pytest.approx(statistics.quantiles(v, n=4, method="inclusive"))


def test_positions_share_the_upper_value_on_ties(spark):
    v = [1.0, 2.0, 2.0, 3.0, 5.0, 5.0, 5.0, 9.0]
    risk = spark.createDataFrame(list(enumerate(v)), "pid int, score double")
    for r in portfolio.positions(risk).collect():
        assert r["percentile"] == pytest.approx(100 * sum(x <= r["score"] for x in v) / len(v))


def test_bands_keep_empty_ones_and_drop_nulls(spark):
    rows = spark.createDataFrame([(0.0,), (0.24,), (0.75,), (1.0,), (None,)], "p double")
    assert {r["band"]: r["n"] for r in portfolio.probability_bands(rows, "p").collect()} == {0: 2, 1: 0, 2: 0, 3: 2}


def test_pages_filter_after_scoring(spark):
    risk = portfolio.risk_scores(spark.createDataFrame([(k, float(k), float(k), 0.5, 0, 0.5, 0) for k in range(8)], SCORES))
    page = portfolio.risk_page(risk, 1, 1, level="CRITICAL").collect()
    assert [(r["pid"], r["total"]) for r in page] == [(6, 2)]
    with pytest.raises(ValueError):
        portfolio.risk_page(risk, level="AWFUL")


def test_unknown_dimension_is_refused():
    with pytest.raises(ValueError):
        portfolio.check_dimension("colour")


def test_level_map_has_no_absent_levels(spark):
    df = spark.createDataFrame([(3, 0)], "a int, b int").select(portfolio.level_map({"LOW": "a", "HIGH": "b"}).alias("m"))
    assert df.first()["m"] == {"LOW": 3}


def test_top_segment_breaks_ties_by_size_then_name(spark):
    rows = spark.createDataFrame([("b", 20, 0.5, False), ("a", 20, 0.5, False), ("c", 30, 0.5, False), ("d", 99, 0.9, True)], "value string, n_hist long, delay_rate double, small_sample boolean")
    assert portfolio.top_segment(rows, "delay_rate").first()["value"] == "c"
    assert portfolio.top_segment(rows.where("value <> 'c'"), "delay_rate").first()["value"] == "a"


def test_histogram_clamps_the_last_bin(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("v"))
    assert {r["bin"]: r["n"] for r in portfolio.histogram(df, "v", 2.0, 3).collect()} == {0: 2, 1: 2, 2: 6}
