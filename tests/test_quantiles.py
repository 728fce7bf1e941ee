import random

import pytest
from pyspark.sql import functions as F

from girder.operators import measures, models, portfolio, quantiles, splits

MARKS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def plain(values, p):
    known = sorted(v for v in values if v is not None)
    if not known:
        return None
    at = p * (len(known) - 1)
    low = int(at)
    high = min(low + 1, len(known) - 1) if at > low else low
    return known[low] if low == high else (high - at) * known[low] + (at - low) * known[high]


def near(a, b):
    return a is b or (a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(a)))


@pytest.fixture
def narrow(monkeypatch):
    """Brackets that leave most rows of a small table out."""
    monkeypatch.setattr(quantiles, "ACCURACY", 200)


def test_equal_to_sorting_by_column_and_group(spark, narrow):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None, "none"]), rng.gauss(0, 9), rng.choice([1, 1, 1, 2, 3, None])) for _ in range(6_000)]
    rows = [(g, None if g == "none" else x, y) for g, x, y in rows]
    df = spark.createDataFrame(rows, "c string, x double, y int").repartition(7)
    got = {r["column"]: (r["n"], r["marks"]) for r in quantiles.quantiles(df, ["x", "y"], MARKS).collect()}
    for i, c in ((1, "x"), (2, "y")):
        values = [r[i] for r in rows]
        assert got[c][0] == sum(v is not None for v in values)
        assert all(near(a, plain(values, p)) for a, p in zip(got[c][1], MARKS, strict=True))
    got = {(r["c"], r["column"]): r["marks"] for r in quantiles.quantiles(df, ["x", "y"], MARKS, by=["c"]).collect()}
    assert len(got) == 8
    for (g, c), marks in got.items():
        values = [r[1 if c == "x" else 2] for r in rows if r[0] == g]
        assert all(near(a, plain(values, p)) for a, p in zip(marks, MARKS, strict=True)), (g, c)


def test_only_values_near_a_rank_are_ordered(spark, narrow, monkeypatch):
    seen = []
    monkeypatch.setattr(quantiles, "running", lambda rows, *a: seen.append(rows.count()) or real(rows, *a))
    from girder.operators.order import running as real

    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("x"))
    assert quantiles.median_of(df, F.col("x"), "m").first()["m"] == 24_999.5
    assert 0 < seen[0] < 50_000 * 0.08


def test_joined_brackets_give_the_same(spark, narrow, monkeypatch):
    df = spark.range(3_000).select((F.col("id") % 5).alias("g"), (F.col("id") * 37 % 1_000).cast("double").alias("x"))
    want = sorted(map(str, quantiles.quantiles(df, ["x"], MARKS, by=["g"]).collect()))
    monkeypatch.setattr(quantiles, "BRACKETS", 0)
    assert sorted(map(str, quantiles.quantiles(df, ["x"], MARKS, by=["g"]).collect())) == want


@pytest.mark.parametrize("accuracy", [50, 2_000])
def test_every_small_size(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    sizes = [1, 2, 3, 4, 5, 8, 11, 49, 50, 51, 52, 99, 100, 101, 199]
    rows = [(n, float((k * 37) % 211)) for n in sizes for k in range(n)]
    got = {r["n"]: r["marks"] for r in quantiles.quantiles(spark.createDataFrame(rows, "g int, x double"), ["x"], MARKS, by=["g"]).collect()}
    for n in sizes:
        values = [v for g, v in rows if g == n]
        assert all(near(a, plain(values, p)) for a, p in zip(got[n], MARKS, strict=True)), n


def test_empty_null_and_odd_values(spark):
    none = spark.createDataFrame([], "x double, g string")
    assert [(r["column"], r["n"], r["marks"]) for r in quantiles.quantiles(none, ["x"], [0.5]).collect()] == [("x", 0, [None])]
    assert quantiles.quantiles(none, ["x"], [0.5], by=["g"]).collect() == []
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(-inf,), (1.0,), (2.0,), (inf,), (nan,), (None,)], "x double")
    low, mid, high, top = quantiles.quantiles(df, ["x"], [0.0, 0.5, 0.75, 1.0]).first()["marks"]
    assert (low, mid, high) == (-inf, 2.0, inf) and top != top
    one = spark.createDataFrame([(3.0,)] * 9, "x double")
    assert quantiles.quantiles(one, ["x"], MARKS).first()["marks"] == [3.0] * len(MARKS)


def test_callers_agree_with_percentile(spark):
    df = spark.range(999).select("id", F.pow(F.col("id") - 400, F.lit(2)).cast("double").alias("y"), (F.col("id") * 3.0).alias("p"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"), (F.col("id") % 3).alias("kind"))
    want = df.agg(F.percentile("y", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])).alias("q"), F.percentile(F.abs(F.col("y") - F.col("p")), F.lit(0.5)).alias("e")).first()
    cuts = portfolio.quartile_cuts(df, "y").first()
    assert [cuts["q1"], cuts["q2"], cuts["q3"]] == want["q"] and cuts["n"] == 999
    assert measures.regression_metrics(df, "y", "p").first()["median_ae"] == want["e"]
    assert models.medians(df, ["y"]) == {"y": want["q"][1]}
    row = models.baselines(df.withColumn("y", F.col("id") % 4), "y").first()
    assert (row["majority"], row["median"]) == (0, 1.0)
    by = {r["split"]: r["median"] for r in splits.cohort_diagnostic(df, "y", "kind").collect()}
    assert by == {r["split"]: r["m"] for r in df.groupBy("split").agg(F.percentile("y", F.lit(0.5)).alias("m")).collect()}
    empty = portfolio.quartile_cuts(df.where("id < 0"), "y").first()
    assert (empty["n"], empty["q1"], empty["q3"]) == (0, 0.0, 0.0)
