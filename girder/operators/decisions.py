"""Decision support: overview with degradation, peer context, recommendation families and the routing of questions to the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from girder.operators import assist, portfolio
from girder.operators.panel import latest_row
from girder.sources.staging import staged

ELEVATION, PEERS, DRIVERS, FLAGS = 0.10, 2, 3, 3
ELEVATED = ("HIGH", "CRITICAL")
NOT_AVAILABLE = "Not available"

# Phrases that no generated sentence may hold, raw categorical columns, topics of features.
PROHIBITED = (
    "confirmed contradiction", "contradiction detected", "confirmed error", "is false", "is wrong", "incorrect figure",
    "factual error", "definitely wrong", "proven false", "one of them is wrong",
)
CATEGORICAL = ("state", "project_type", "contractor")
TOPICS = {
    "state": "state highway project", "project_type": "highway project type", "contractor": "contractor performance",
    "planned_duration_months": "project duration", "project_length_km": "highway project length",
    "original_contract_value_inr_cr": "project contract value outlay", "contractor_productivity_factor": "contractor productivity performance",
    "delay_factor_count": "project delay factors", "schedule_pressure": "project schedule delay", "cost_growth_rate": "cost overrun growth",
}


# ---------------------------------------------------------------- overview


def predicted_overview(risk: DataFrame) -> DataFrame:
    """One row: status ok or cache_unavailable, the number of scores, their means (null without any) and levels (0 where none)."""
    levels = [F.count_if(F.col("level") == x).alias(f"n_{x.lower()}") for x in portfolio.LEVELS]
    known = lambda c: F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    out = risk.agg(F.count("*").alias("n_scored"), known("p_delay").alias("mean_p_delay"), known("p_cost").alias("mean_p_cost"), F.avg("delay_pred").alias("mean_delay_pred"), F.avg("cost_pred").alias("mean_cost_pred"), *levels)
    return out.withColumn("status", F.when(F.col("n_scored") > 0, "ok").otherwise("cache_unavailable"))


def portfolio_overview(projects: DataFrame, outcomes: DataFrame, risk: DataFrame) -> DataFrame:
    """One row: all projects, recorded outcomes, predictions, and the ids of the five highest scores in order."""
    total = projects.agg(F.count("*").alias("n_projects"))
    top = risk.orderBy(F.desc("score"), "pid").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pid"))).alias("t"))
    top = top.select(F.array_join(F.transform("t", lambda x: x["pid"].cast("string")), ",").alias("top_risks"))
    past = portfolio.overview(outcomes).withColumnRenamed("n", "n_finished")
    return total.join(F.broadcast(past)).join(F.broadcast(predicted_overview(risk))).join(F.broadcast(top))


def project_lookup(snapshots: DataFrame, status: str, key: str = "pid", month: str = "midx", terminal: str = "is_terminal") -> DataFrame:
    """(key, n_snapshots, has_terminal, current_status, latest, latest_open) of every project."""
    return snapshots.groupBy(key).agg(
        F.count("*").alias("n_snapshots"), F.bool_or(terminal).alias("has_terminal"), F.max_by(status, month).alias("current_status"),
        F.max(month).alias("latest"), F.max(F.when(~F.col(terminal), F.col(month))).alias("latest_open"),
    )


# ---------------------------------------------------------------- peers


def peer_context(projects: DataFrame, outcomes: DataFrame, risk: DataFrame, key: str = "pid") -> DataFrame:
    """(key, dimension, value, status, n_hist, delay_rate, overrun_rate, small_sample): a row for each project and dimension.

    A project without a value, or whose value no segment has, is unavailable there. Segments are aggregates, joined by value.
    """
    parts = None
    outcomes, risk = staged(outcomes, "outcomes"), staged(risk, "risk")  # three reports read them
    for d in portfolio.DIMENSIONS:
        own = portfolio.segment_report(outcomes, risk, d).select(F.lit(d).alias("dimension"), "value", "n_hist", "delay_rate", "overrun_rate", "small_sample")
        parts = own if parts is None else parts.unionByName(own)
    flat = projects.select(key, F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in portfolio.DIMENSIONS])))
    out = flat.join(parts.withColumn("found", F.lit(True)), ["dimension", "value"], "left")
    status = F.when(F.col("value").isNull(), "no value").when(F.col("found"), "ok").otherwise("not in the report")
    return out.select(key, "dimension", "value", status.alias("status"), "n_hist", "delay_rate", "overrun_rate", "small_sample")


def spreads(peers: DataFrame, overview: DataFrame, key: str = "pid") -> DataFrame:
    """(key, dimension, value, metric, rate, spread): each peer group's rates against the whole portfolio's."""
    whole = overview.select(F.col("delay_rate").alias("__d"), F.col("overrun_rate").alias("__o"))
    rows = peers.where((F.col("status") == "ok") & ~F.col("small_sample") & F.col("n_hist").isNotNull()).join(F.broadcast(whole))
    one = lambda m, c, w: F.struct(F.lit(m).alias("metric"), F.col(c).alias("rate"), (F.col(c) - F.col(w)).alias("spread"))
    return rows.select(key, "dimension", "value", F.inline(F.array(one("delay_rate", "delay_rate", "__d"), one("overrun_rate", "overrun_rate", "__o"))))


def peer_elevation(spread: DataFrame, risk: DataFrame, key: str = "pid", least: float = ELEVATION, limit: int = PEERS) -> DataFrame:
    """The most elevated peer groups of each HIGH or CRITICAL project, by spread; ties keep the order of dimensions, delay before cost."""
    at = F.array_position(F.array(*[F.lit(d) for d in portfolio.DIMENSIONS]), F.col("dimension"))
    rows = spread.where(F.col("spread") >= least).join(risk.where(F.col("level").isin(*ELEVATED)).select(key, "level"), key)
    w = Window.partitionBy(key).orderBy(F.desc("spread"), at, "metric")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


# ---------------------------------------------------------------- recommendations


def feature_identity(raw: Column) -> Column:
    """A model feature's column: numeric__x is x, categorical__state_Assam is state; other names stay."""
    plain = F.regexp_replace(raw, "^(numeric|categorical)__", "")
    out = plain
    for c in CATEGORICAL:
        out = F.when(raw.startswith(f"categorical__{c}_"), F.lit(c)).otherwise(out)
    return out


def topic(feature: Column) -> Column:
    """A feature's topic phrase; unknown ones are their names with spaces."""
    known = F.create_map(*[F.lit(x) for kv in TOPICS.items() for x in kv])
    return F.coalesce(F.element_at(known, feature), F.replace(feature, F.lit("_"), F.lit(" ")))


def driver_recommendations(drivers: DataFrame, key: str = "pid", limit: int = DRIVERS) -> DataFrame:
    """(key, identity, tasks, place): each task's strongest driver, grouped by what it is, in the order of tasks, capped.

    drivers: key, task, task_order, rank, feature.
    """
    top = drivers.where("rank = 1").withColumn("identity", feature_identity(F.col("feature")))
    made = top.groupBy(key, "identity").agg(F.array_join(F.array_sort(F.collect_set("task")), ", ").alias("tasks"), F.min("task_order").alias("first"))
    w = Window.partitionBy(key).orderBy("first", "identity")
    return made.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("first")


def citation(document: Column, page: Column) -> Column:
    return F.concat(F.lit("["), document.cast("string"), F.lit(", p. "), page.cast("string"), F.lit("]"))


def evidence_recommendations(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, citations): the citations of each query that found something, in rank order. hits: query, rank, citation."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "citation")))
    return hits.groupBy(query).agg(F.array_join(F.transform(ranked, lambda x: x["citation"]), ", ").alias("citations"))


def merged_flags(flags: DataFrame, keys: list[str], flag: str = "flag_id", limit: int | None = FLAGS) -> DataFrame:
    """One row for each combination of keys with its flags' ids joined; those of the first ids, in their order."""
    out = flags.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(flag)), ", ").alias("flags"), F.min(flag).alias("first"))
    out = out.orderBy("first")
    return (out if limit is None else out.limit(limit)).drop("first")


def scenario_recommendations(scenario: DataFrame, ranges: DataFrame, key: str = "pid") -> DataFrame:
    """(key, basis, field): one row for each scenario, and one more where its value lies outside the training range."""
    known = scenario.where("field IS NOT NULL")
    warned = assist.extrapolation(known.select(key, "field", F.col("reference").alias("value")), ranges)
    return known.select(key, F.lit("scenario").alias("basis"), "field").unionByName(warned.select(key, F.lit("extrapolation").alias("basis"), "field"))


def evidence_strength(found: Column, inconsistent: Column) -> Column:
    return F.when(found & ~inconsistent, "high").when(found, "moderate").otherwise("limited")


def unhedged(text: Column) -> Column:
    """Whether a text holds a phrase that states as certain what is only possible."""
    hit = F.lit(False)
    for p in PROHIBITED:
        hit = hit | F.contains(F.lower(text), F.lit(p))
    return hit


def hedged(rows: DataFrame, text: str) -> DataFrame:
    """rows, refused as a whole if any text is unhedged."""
    if not (bad := rows.where(unhedged(F.col(text))).select(text).limit(1)).isEmpty():
        raise ValueError(f"unhedged: {bad.first()[0]!r}")
    return rows


def shown(value: Column, suffix: str = "") -> Column:
    """A value as text, or what stands for none."""
    return F.coalesce(F.concat(value.cast("string"), F.lit(suffix)), F.lit(NOT_AVAILABLE))


def table_text(cells: list[Column]) -> Column:
    """A table row as one line; empty cells stay."""
    return F.array_join(F.array(*[F.trim(F.coalesce(c.cast("string"), F.lit(""))) for c in cells]), " | ")


# ---------------------------------------------------------------- summaries


def risk_summary(states: DataFrame, risk: DataFrame, drivers: DataFrame, evidence: DataFrame, flagged: DataFrame, key: str = "pid", every: bool = False) -> DataFrame:
    """One row for each project's latest snapshot, or with `every` for each snapshot: status, score and level, tasks' drivers, strength of evidence.

    states: key, midx, status; drivers: of driver_recommendations; evidence: key, found; flagged: keys whose evidence a flag touches.
    Finished projects keep their recorded outcome and have no drivers.
    """
    now = states.select(key, "midx", "status") if every else latest_row(states, ["status"], key)
    rows = now.join(risk.select(key, "score", "level"), key, "left").join(drivers.where("place = 1").select(key, F.col("identity").alias("driver"), "tasks"), key, "left")
    rows = rows.join(evidence.select(key, "found"), key, "left").join(flagged.select(key).distinct().withColumn("__flag", F.lit(True)), key, "left")
    strength = evidence_strength(F.coalesce("found", F.lit(False)), F.coalesce("__flag", F.lit(False)))
    modelled = F.col("status") == "model_prediction"
    return rows.select(key, "midx", "status", "score", "level", F.when(modelled, F.col("driver")).alias("driver"), F.when(modelled, F.col("tasks")).alias("tasks"), strength.alias("evidence_strength"))


def decision_summary(risk: DataFrame, peers: DataFrame, elevated: DataFrame, key: str = "pid") -> DataFrame:
    """One row for each scored project: score, level, percentile, peer groups that are known and elevated, and the first elevated one."""
    known = peers.groupBy(key).agg(F.count_if(F.col("status") == "ok").alias("n_peers"))
    high = elevated.groupBy(key).agg(F.count("*").alias("n_elevated"), F.min_by("value", "rank").alias("first_elevated"))
    rows = portfolio.positions(risk).select(key, "score", "level", "percentile").join(known, key, "left").join(high, key, "left")
    return rows.select(key, "score", "level", "percentile", F.coalesce("n_peers", F.lit(0)).alias("n_peers"), F.coalesce("n_elevated", F.lit(0)).alias("n_elevated"), "first_elevated")


def cached_vectors(queries: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], text: str = "query") -> DataFrame:
    """queries with their vectors: those of the cache whose text is equal byte for byte, the others embedded now."""
    wanted = queries.select(text).distinct()
    hit = wanted.join(cache.select(text, "embedding"), text).withColumn("cached", F.lit(True))
    fresh = embed(wanted.join(cache.select(text), text, "left_anti")).select(text, "embedding").withColumn("cached", F.lit(False))
    return queries.join(hit.unionByName(fresh), text)


def answered(message: str, named: dict, engine: dict[str, Callable[..., DataFrame]]) -> DataFrame | None:
    """Call the engine function that answers a message; None where none does.

    engine: functions by the names that assist.route gives, each taking the named entities and the message.
    """
    name = assist.route(message, named)
    return engine[name](named, message) if name in engine else None
