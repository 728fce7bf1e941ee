"""Portfolio analytics: outcomes, cohort-relative risk scores, segments, bands, trends and positions.

A score's parts are normalised over the whole cohort, so filters come after scoring, never before. Cohort statistics are
one-row aggregates, broadcast: an unpartitioned window would move every row to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.operators.order import running
from girder.operators.quantiles import quantiles
from girder.sources.staging import staged

MIN_SAMPLE = {"state": 15, "ptype": 15, "contractor": 8}
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
DIMENSIONS = ("state", "ptype", "contractor")


def check_dimension(name: str) -> None:
    if name not in DIMENSIONS:
        raise ValueError(f"unknown dimension {name!r}; known are {', '.join(DIMENSIONS)}")


# ---------------------------------------------------------------- outcomes


def group_counts(rows: DataFrame, c: str) -> DataFrame:
    """Counts by a column; null is a group."""
    return rows.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))


def overview(outcomes: DataFrame) -> DataFrame:
    """Counts, rates and means of recorded outcomes; zeros without rows."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return outcomes.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("delayed") == 1).alias("n_delayed"),
        F.count_if(F.col("overrun") == 1).alias("n_overrun"),
        zero(F.avg("delayed")).alias("delay_rate"),
        zero(F.avg("overrun")).alias("overrun_rate"),
        zero(F.avg("delay_days")).alias("mean_delay"),
        zero(F.avg("overrun_pct")).alias("mean_overrun"),
    )


# ---------------------------------------------------------------- risk scores


def normalized(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi == lo, F.lit(0.5)).otherwise((v - lo) / (hi - lo))


def quartile_cuts(rows: DataFrame, c: str) -> DataFrame:
    """n, q1, q2, q3 by linear interpolation between order statistics."""
    return quantiles(rows, [c], [0.25, 0.5, 0.75]).select("n", *[F.coalesce(F.get("marks", F.lit(k)), F.lit(0.0)).alias(f"q{k + 1}") for k in range(3)])


def level_of(score: Column) -> Column:
    """A value on a cut belongs below it; a cohort of fewer than two rows is LOW."""
    return F.when((F.col("n") < 2) | (score <= F.col("q1")), "LOW").when(score <= F.col("q2"), "MEDIUM").when(score <= F.col("q3"), "HIGH").otherwise("CRITICAL")


def risk_scores(scores: DataFrame) -> DataFrame:
    """Adds score (0-100) and level. A missing probability falls back to the predicted class."""
    span = scores.agg(F.min("delay_pred").alias("dlo"), F.max("delay_pred").alias("dhi"), F.min("cost_pred").alias("clo"), F.max("cost_pred").alias("chi"))
    rows = scores.join(F.broadcast(span))
    pd = F.coalesce("p_delay", F.col("c_delay").cast("double"))
    pc = F.coalesce("p_cost", F.col("c_cost").cast("double"))
    nd = normalized(F.col("delay_pred"), F.col("dlo"), F.col("dhi"))
    nc = normalized(F.col("cost_pred"), F.col("clo"), F.col("chi"))
    rows = rows.withColumn("score", 100 * ((pd + nd) / 2 + (pc + nc) / 2) / 2).drop("dlo", "dhi", "clo", "chi")
    rows = staged(rows, "risk")  # the cuts read it twice
    cut = rows.join(F.broadcast(quartile_cuts(rows, "score")))
    return cut.withColumn("level", level_of(F.col("score"))).drop("n", "q1", "q2", "q3")


def positions(risk: DataFrame) -> DataFrame:
    """Adds percentile: 100 x the share of scores that are not larger; ties share the larger value.

    Ranks come from counts of distinct scores, summed within ranges: no row ever meets all others in one task.
    """
    n = risk.select(F.count("*").alias("__n"))
    per = risk.groupBy("score").agg(F.count("*").alias("__here"))
    table = running(per, ["score"], {"__here": "__upto"}).select("score", "__upto")
    return risk.join(table, "score").join(F.broadcast(n)).withColumn("percentile", 100.0 * F.col("__upto") / F.col("__n")).drop("__upto", "__n")


def risk_page(risk: DataFrame, limit: int = 20, offset: int = 0, **equal: str | None) -> DataFrame:
    """Ranked rows after optional filters, with the total before paging; ties by id."""
    level = equal.get("level")
    if level is not None and level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    for c, v in equal.items():
        if v is not None:
            risk = risk.where(F.col(c) == v)
    total = risk.agg(F.count("*").alias("total"))
    return risk.orderBy(F.desc("score"), "pid").offset(offset).limit(limit).join(F.broadcast(total))


# ---------------------------------------------------------------- segments


def historical_segments(outcomes: DataFrame, dimension: str) -> DataFrame:
    check_dimension(dimension)
    rows = outcomes.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("value"))
    return rows.agg(F.count("*").alias("n_hist"), F.avg("delayed").alias("delay_rate"), F.avg("overrun").alias("overrun_rate"), F.avg("delay_days").alias("mean_delay"), F.avg("overrun_pct").alias("mean_overrun"))


def predicted_segments(risk: DataFrame, dimension: str) -> DataFrame:
    """Means (a missing probability counts as 0) and the number of rows on each level."""
    check_dimension(dimension)
    rows = risk.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("value"))
    levels = [F.count_if(F.col("level") == x).alias(f"n_{x.lower()}") for x in LEVELS]
    return rows.agg(F.count("*").alias("n_pred"), F.avg(F.coalesce("p_delay", F.lit(0.0))).alias("mean_p_delay"), F.avg(F.coalesce("p_cost", F.lit(0.0))).alias("mean_p_cost"), F.avg("score").alias("mean_score"), *levels)


def level_map(counts: dict[str, str]) -> Column:
    """A map of the levels that occur; absent levels are missing keys."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in counts.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0))


def segment_report(outcomes: DataFrame, risk: DataFrame, dimension: str, minimum: int | None = None) -> DataFrame:
    """History and prediction side by side; small_sample by the larger of what is known."""
    minimum = MIN_SAMPLE[dimension] if minimum is None else minimum
    rows = historical_segments(outcomes, dimension).join(predicted_segments(risk, dimension), "value", "full_outer")
    return rows.withColumn("small_sample", F.coalesce("n_hist", F.lit(0)) < minimum)


def all_segments(risk: DataFrame) -> DataFrame:
    """The three dimensions in one pass; a real null contractor is not the rolled-up one."""
    flat = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS]))
    rows = risk.select(flat.alias("d"), "p_delay", "score", "level").select("d.dimension", "d.value", "p_delay", "score", "level").where("value IS NOT NULL")
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.count_if(F.col("level") == "CRITICAL").alias("n_critical"))


def ordered_segments(report: DataFrame) -> DataFrame:
    return report.orderBy(F.coalesce("n_hist", F.lit(0)).desc(), "value")


def top_segment(report: DataFrame, rate: str) -> DataFrame:
    """The segment of the highest rate among those of a sufficient sample; ties go to the larger, then the first name."""
    rows = report.where(~F.col("small_sample") & F.col(rate).isNotNull())
    return rows.orderBy(F.desc(rate), F.desc("n_hist"), "value").limit(1)


# ---------------------------------------------------------------- bands and trends


def probability_bands(rows: DataFrame, c: str, width: float = 0.25) -> DataFrame:
    """Counts by fixed-width band; empty bands are reported, nulls are not counted."""
    n = int(round(1 / width))
    bands = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("band"))
    found = rows.where(F.col(c).isNotNull()).groupBy(F.least(F.floor(F.col(c) / width), F.lit(n - 1)).cast("int").alias("band")).agg(F.count("*").alias("n"))
    return bands.join(F.broadcast(found), "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


def quartile_bands(rows: DataFrame, c: str) -> DataFrame:
    rows = rows.where(F.col(c).isNotNull())
    cuts = quartile_cuts(rows, c)
    v = F.col(c)
    band = F.when(v <= F.col("q1"), 1).when(v <= F.col("q2"), 2).when(v <= F.col("q3"), 3).otherwise(4)
    return rows.join(F.broadcast(cuts)).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def histogram(rows: DataFrame, c: str, width: float, bins: int) -> DataFrame:
    """Counts in [k * width, (k + 1) * width); the last bin takes what lies beyond; empty bins are dropped."""
    k = F.least(F.floor(F.col(c) / width), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(c).isNotNull()).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def historical_trend(outcomes: DataFrame, year: Column, minimum: int = 15) -> DataFrame:
    rows = outcomes.groupBy(year.alias("year")).agg(F.count("*").alias("n"), F.avg("delayed").alias("delay_rate"), F.avg("overrun").alias("overrun_rate"))
    return rows.withColumn("small_sample", F.col("n") < minimum)


def predicted_trend(risk: DataFrame, year: Column, minimum: int = 15) -> DataFrame:
    rows = risk.groupBy(year.alias("year")).agg(F.count("*").alias("n"), F.avg(F.coalesce("p_delay", F.lit(0.0))).alias("mean_p_delay"), F.avg("score").alias("mean_score"))
    return rows.withColumn("small_sample", F.col("n") < minimum)


# ---------------------------------------------------------------- text


def insights(outcomes: DataFrame, risk: DataFrame) -> DataFrame:
    """Sentences over the portfolio, as rows in order: history, predictions, then each dimension's top segment."""
    pct = lambda c: F.format_string("%.1f%%", c * 100)
    outcomes, risk = staged(outcomes, "outcomes"), staged(risk, "risk")  # three reports and three sentences read them
    o = overview(outcomes)
    past = o.where("n > 0").select(F.lit(1).alias("pos"), F.concat(F.lit("Of "), F.col("n").cast("string"), F.lit(" finished projects "), pct(F.col("delay_rate")), F.lit(" ended with a significant delay.")).alias("text"))
    cost = o.where("n > 0").select(F.lit(2).alias("pos"), F.concat(F.lit("Of "), F.col("n").cast("string"), F.lit(" finished projects "), pct(F.col("overrun_rate")), F.lit(" ended with a cost overrun.")).alias("text"))
    now = risk.agg(F.count("*").alias("n"), F.count_if(F.col("level").isin("HIGH", "CRITICAL")).alias("k")).where("n > 0")
    now = now.select(F.lit(3).alias("pos"), F.concat(F.col("k").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" scored projects are HIGH or CRITICAL.")).alias("text"))
    made = past.union(cost).union(now)
    for pos, (d, rate) in enumerate((("state", "delay_rate"), ("ptype", "overrun_rate"), ("contractor", "overrun_rate")), 4):
        top = top_segment(segment_report(outcomes, risk, d), rate)
        text = F.concat(F.lit(f"Highest observed {rate} by {d}: "), F.col("value"), F.lit(" ("), pct(F.col(rate)), F.lit(", n="), F.col("n_hist").cast("string"), F.lit(")."))
        made = made.union(top.select(F.lit(pos).alias("pos"), text.alias("text")))
    return made
