import pytest
from pyspark.sql import functions as F

from girder.operators import assist


def each(spark, messages, f):
    df = spark.createDataFrame([(k, m) for k, m in enumerate(messages)], "k int, m string")
    return [r[1] for r in df.select("k", f(F.col("m"))).orderBy("k").collect()]


def test_intents_in_order(spark):
    cases = {"What happens if cost rises by 5%?": "whatif", "How do I archive a project?": "support", "Why is PRJ-0001 high risk?": "risk", "Which projects are late by state?": "portfolio", "Tell me about PRJ-0001": "project", "What does the document say?": "document", "Hello": "unsupported", None: "unsupported"}
    assert each(spark, cases, assist.intent) == list(cases.values())


def test_entities(spark):
    a, b, c = each(spark, ["Why is prj-0012 in 2024-03 critical or high?", "statement of low flow", None], assist.entities)
    assert tuple(a) == ("PRJ-0012", "2024-03", "CRITICAL", None)
    assert tuple(b) == (None, None, "LOW", "state") and tuple(c) == (None, None, None, None)


def test_whatif_phrases(spark):
    got = each(spark, ["what if financial progress drops by 5%", "what if progress improves 10 %", "what if cost rises", "what if 10%", "cost 7.5% worsens then improves"], assist.whatif)
    assert tuple(got[0]) == ("actual_financial_progress_pct", "additive", 5.0, "down")
    assert tuple(got[1]) == ("actual_physical_progress_pct", "additive", 10.0, "up")
    assert got[2] is None and got[3] is None
    assert got[4]["direction"] == "down" and got[4]["magnitude"] == 7.5


def test_moves_are_clamped(spark):
    df = spark.createDataFrame([(95.0, "additive", 10.0, "up"), (3.0, "additive", 10.0, "down"), (50.0, "multiplicative", 10.0, "down")], "b double, m string, x double, d string")
    assert [r[0] for r in df.select(assist.moved(F.col("b"), F.col("m"), F.col("x"), F.col("d"))).collect()] == [100.0, 0.0, 45.0]


def test_overrides_are_checked():
    got = assist.check_overrides({"a": 1, "b": True, "c": "x", "d": 2, "e": 5}, {"a", "b"}, {"c", "d"})
    assert got == {"b": "not a number", "d": "not a text", "e": "unknown field"}


def test_overlay_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, 10.0, "x"), (2, None, "y")], "k int, v double, s string")
    got = assist.overlay(df, {"v": 12, "s": "z"}).orderBy("k").collect()
    assert [(r["v"], r["s"], r["v__delta"], r["s__delta"]) for r in got] == [(12.0, "z", 2.0, None), (12.0, "z", None, None)]


def test_support_topics_and_routes(spark):
    assert each(spark, ["how do i reactivate it", "how do i archive it", "?"], assist.support_topic) == ["reactivate", "archive", "default"]
    assert assist.route("", {"intent": "portfolio", "risk_level": "HIGH"}) == "risk_page"
    assert assist.route("", {"intent": "nonsense"}) == "unsupported"


@pytest.mark.parametrize(("value", "n"), [(5.0, 0), (-1.0, 1), (11.0, 1)])
def test_extrapolation(spark, value, n):
    values = spark.createDataFrame([("a", value), ("unknown", 99.0)], "field string, value double")
    bounds = spark.createDataFrame([("a", 0.0, 10.0)], "column string, lo double, hi double")
    assert assist.extrapolation(values, bounds).count() == n
