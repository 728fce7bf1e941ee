"""Named queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators import assist, evidence, lifecycle, measures, models, panel, portfolio, relations
from girder.operators.quantiles import median_of
from girder.sources.staging import staged
from girder.plans.views import eligible, outcomes, projects, scores, snapshots, sql, table
from girder.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; its SQL sees the views."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            SQL[name] = sql(oracle)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def risk(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.risk_scores(scores(spark, d))


def with_project(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return rows.join(projects(spark, d), "pid")


# ---------------------------------------------------------------- 2.4 and 2.5: joins and aggregates


@query("agg2_group_counts", "SELECT contractor AS value, count(*) AS n FROM projects GROUP BY contractor")
def _(spark, d):
    return portfolio.group_counts(projects(spark, d), "contractor")


@query("agg3_status_counts", "SELECT st AS value, count(*) AS n FROM (SELECT pid, CASE WHEN arg_max(done, midx) = arg_max(n_orders, midx) THEN 'Completed' ELSE 'Open' END AS st FROM snapshots GROUP BY pid) GROUP BY st")
def _(spark, d):
    now = panel.latest_row(snapshots(spark, d), ["done", "n_orders"])
    return portfolio.group_counts(now.withColumn("st", F.when(F.col("done") == F.col("n_orders"), "Completed").otherwise("Open")), "st")


@query("agg5_overview", "SELECT count(*) AS n, count(*) FILTER (WHERE delayed = 1) AS n_delayed, count(*) FILTER (WHERE overrun = 1) AS n_overrun, round(avg(delayed), 6) AS delay_rate, round(avg(overrun), 6) AS overrun_rate, round(avg(delay_days), 6) AS mean_delay, round(avg(overrun_pct), 6) AS mean_overrun FROM outcomes")
def _(spark, d):
    return rounded(portfolio.overview(outcomes(spark, d)))


def _segments(name: str) -> str:
    return f"""SELECT coalesce(h.value, p.value) AS value, n_hist, delay_rate, overrun_rate, n_pred, mean_p_delay, mean_score, n_low, n_critical, coalesce(n_hist, 0) < {portfolio.MIN_SAMPLE[name]} AS small_sample
FROM (SELECT {name} AS value, count(*) AS n_hist, round(avg(delayed), 6) AS delay_rate, round(avg(overrun), 6) AS overrun_rate FROM outcomes JOIN projects USING (pid) WHERE {name} IS NOT NULL GROUP BY 1) h
FULL OUTER JOIN (SELECT {name} AS value, count(*) AS n_pred, round(avg(coalesce(p_delay, 0)), 6) AS mean_p_delay, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE level = 'LOW') AS n_low, count(*) FILTER (WHERE level = 'CRITICAL') AS n_critical FROM risk WHERE {name} IS NOT NULL GROUP BY 1) p ON h.value = p.value"""


def _segment_query(name: str):
    @query(f"jn8_segments_{name}", _segments(name))
    def _(spark, d):
        rows = portfolio.segment_report(with_project(outcomes(spark, d), spark, d), risk(spark, d), name)
        return rounded(rows.select("value", "n_hist", "delay_rate", "overrun_rate", "n_pred", "mean_p_delay", "mean_score", "n_low", "n_critical", "small_sample"))


for _name in portfolio.DIMENSIONS:
    _segment_query(_name)


@query("agg9_segments_all", " UNION ALL ".join(f"SELECT '{x}' AS dimension, {x} AS value, count(*) AS n, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE level = 'CRITICAL') AS n_critical FROM risk WHERE {x} IS NOT NULL GROUP BY {x}" for x in portfolio.DIMENSIONS))
def _(spark, d):
    return rounded(portfolio.all_segments(risk(spark, d)))


@query("agg10_predicted_overview", "SELECT count(*) AS n, round(avg(coalesce(p_delay, 0)), 6) AS mean_p_delay, round(avg(coalesce(p_cost, 0)), 6) AS mean_p_cost, round(avg(delay_pred), 2) AS mean_delay, round(avg(cost_pred), 2) AS mean_cost FROM scores")
def _(spark, d):
    one = scores(spark, d).agg(F.count("*").alias("n"), F.avg(F.coalesce("p_delay", F.lit(0.0))).alias("mean_p_delay"), F.avg(F.coalesce("p_cost", F.lit(0.0))).alias("mean_p_cost"), F.round(F.avg("delay_pred"), 2).alias("mean_delay"), F.round(F.avg("cost_pred"), 2).alias("mean_cost"))
    return rounded(one)


@query("agg11_trend_start_year", "SELECT CAST(y AS VARCHAR) AS year, count(*) AS n, round(avg(delayed), 6) AS delay_rate, round(avg(overrun), 6) AS overrun_rate, count(*) < 15 AS small_sample FROM outcomes JOIN (SELECT pid, min(midx) // 12 AS y FROM snapshots GROUP BY pid) USING (pid) GROUP BY y")
def _(spark, d):
    start = snapshots(spark, d).groupBy("pid").agg(F.floor(F.min("midx") / 12).alias("y"))
    return rounded(portfolio.historical_trend(outcomes(spark, d).join(start, "pid"), F.col("y").cast("string")))


@query("agg12_trend_reporting_year", "SELECT substr(month, 1, 4) AS year, count(*) AS n, round(avg(coalesce(p_delay, 0)), 6) AS mean_p_delay, round(avg(score), 6) AS mean_score, count(*) < 15 AS small_sample FROM risk GROUP BY 1")
def _(spark, d):
    return rounded(portfolio.predicted_trend(risk(spark, d), F.substring("month", 1, 4)))


@query("agg13_prob_bands", "SELECT CAST(b.band AS INTEGER) AS band, count(s.p_delay) AS n FROM (SELECT unnest(range(4)) AS band) b LEFT JOIN scores s ON least(floor(p_delay / 0.25), 3) = b.band GROUP BY 1")
def _(spark, d):
    return portfolio.probability_bands(scores(spark, d), "p_delay")


@query("agg14_quartile_bands", "SELECT CASE WHEN delay_pred <= q1 THEN 1 WHEN delay_pred <= q2 THEN 2 WHEN delay_pred <= q3 THEN 3 ELSE 4 END AS band, count(*) AS n, min(delay_pred) AS lo, max(delay_pred) AS hi FROM scores, (SELECT quantile_cont(delay_pred, 0.25) AS q1, quantile_cont(delay_pred, 0.5) AS q2, quantile_cont(delay_pred, 0.75) AS q3 FROM scores) GROUP BY 1")
def _(spark, d):
    return portfolio.quartile_bands(scores(spark, d), "delay_pred")


@query("agg16_cache_metadata", "SELECT max(month) AS computed_at, count(*) AS n FROM scores")
def _(spark, d):
    return scores(spark, d).agg(F.max("month").alias("computed_at"), F.count("*").alias("n"))


@query("agg17_latest_open_month", "SELECT pid, m FROM eligible")
def _(spark, d):
    return eligible(spark, d)


@query("agg18_duplicates", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return relations.duplicates(table(spark, d, "events"), ["user_id", "event_type"])


@query("agg21_null_report", "SELECT * FROM (SELECT 'severity' AS \"column\", round(avg(CASE WHEN severity IS NULL THEN 100.0 ELSE 0 END), 4) AS pct FROM snapshots UNION ALL SELECT 'cost', round(avg(CASE WHEN cost IS NULL THEN 100.0 ELSE 0 END), 4) FROM snapshots) WHERE pct > 0")
def _(spark, d):
    return measures.null_report(snapshots(spark, d), ["severity", "cost"])


@query("agg22_describe", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS lo, max({c}) AS hi, round(quantile_cont({c}, 0.05), 4) AS p5, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(quantile_cont({c}, 0.95), 4) AS p95 FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def _(spark, d):
    return rounded(measures.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), 4)


@query("agg23_shares", "SELECT flag AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 4) AS share FROM (SELECT l_returnflag AS flag FROM lineitem) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, d):
    return measures.shares(table(spark, d, "lineitem"), "l_returnflag")


@query("agg24_correlations", "SELECT 'l_quantity' AS \"column\", round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_discount', round(corr(l_discount, l_extendedprice), 6) FROM lineitem")
def _(spark, d):
    return rounded(measures.correlations(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]))


@query("agg25_ranges", "SELECT 'l_extendedprice' AS \"column\", min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, CAST(count(l_extendedprice) AS DOUBLE) AS n FROM lineitem UNION ALL SELECT 'l_quantity', min(l_quantity), max(l_quantity), CAST(count(*) AS DOUBLE) FROM lineitem")
def _(spark, d):
    return measures.ranges(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])


@query("agg31_regression_metrics", "SELECT round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / sum((y - m) * (y - m)), 6) AS r2, round(quantile_cont(abs(e), 0.5), 4) AS median_ae FROM (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1500 AS e, avg(l_extendedprice) OVER () AS m FROM lineitem)")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    out = measures.regression_metrics(rows, "y", "p")
    return out.select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("median_ae", 4).alias("median_ae"))


def _labelled(spark, d):
    return table(spark, d, "labels").select(F.col("quality").alias("y"), (F.col("doc_id") % 7 > 2).cast("int").alias("c"), ((F.col("doc_id") * 37 % 101) / 100.0 + 0.2 * F.col("quality")).alias("s"))


@query("agg32_classification_metrics", "SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM (SELECT count(*) FILTER (WHERE quality = 1 AND doc_id % 7 > 2) AS tp, count(*) FILTER (WHERE quality <> 1 AND doc_id % 7 > 2) AS fp, count(*) FILTER (WHERE quality = 1 AND NOT doc_id % 7 > 2) AS fn, count(*) FILTER (WHERE quality <> 1 AND NOT doc_id % 7 > 2) AS tn FROM labels)")
def _(spark, d):
    return rounded(measures.classification_metrics(_labelled(spark, d), "y", "c"))


@query("agg33_ranking_metrics", """, l AS (SELECT quality AS y, (doc_id * 37 % 101) / 100.0::DOUBLE + 0.2::DOUBLE * quality AS s FROM labels),
r AS (SELECT y, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM l),
ap AS (SELECT s, sum(y) AS pos, count(*) AS n FROM l GROUP BY s),
cum AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS nn FROM ap)
SELECT round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc,
(SELECT round(sum(pos * tp / nn) / sum(pos), 6) FROM cum) AS avg_precision FROM r""")
def _(spark, d):
    return rounded(measures.ranking_metrics(_labelled(spark, d), "y", "s"))


@query("agg34_baselines", "SELECT 1 AS majority, round(avg(quality), 6) AS mean, quantile_cont(quality, 0.5) AS median FROM labels")
def _(spark, d):
    return rounded(models.baselines(table(spark, d, "labels"), "quality"))


@query("agg38_histogram", "SELECT CAST(least(floor(delay_days / 20), 9) AS INTEGER) AS bin, count(*) AS n FROM outcomes GROUP BY 1")
def _(spark, d):
    return portfolio.histogram(outcomes(spark, d), "delay_days", 20, 10)


@query("agg39_snapshots_per_project", "SELECT round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, min(n) AS lo, max(n) AS hi FROM (SELECT count(*) AS n FROM snapshots GROUP BY pid)")
def _(spark, d):
    n = snapshots(spark, d).groupBy("pid").agg(F.count("*").alias("n"))
    n = staged(n, "snapshots-per-project")
    out = n.agg(F.avg("n").alias("mean"), F.min("n").alias("lo"), F.max("n").alias("hi")).join(F.broadcast(median_of(n, F.col("n"), "median")))
    return rounded(out.select("mean", "median", "lo", "hi"))


@query("jn1_terminal_outcomes", "SELECT pid, state, delay_days, overrun_pct, delayed, overrun FROM outcomes JOIN projects USING (pid)")
def _(spark, d):
    return with_project(outcomes(spark, d), spark, d).select("pid", "state", "delay_days", "overrun_pct", "delayed", "overrun")


@query("jn3_current_status", "SELECT p.pid, coalesce(s.month, 'Unknown') AS current_status FROM projects p LEFT JOIN (SELECT pid, arg_max(month, midx) AS month FROM snapshots GROUP BY pid) s ON p.pid = s.pid")
def _(spark, d):
    return relations.current_status(projects(spark, d), snapshots(spark, d), "month").select("pid", "current_status")


@query("jn4_orphans", "SELECT pid, midx FROM snapshots WHERE pid NOT IN (SELECT pid FROM projects WHERE contractor IS NOT NULL)")
def _(spark, d):
    return relations.orphans(snapshots(spark, d), projects(spark, d).where("contractor IS NOT NULL"), "pid").select("pid", "midx")


@query("jn5_outside", "SELECT pid FROM projects WHERE pid NOT IN (SELECT pid FROM eligible)")
def _(spark, d):
    return relations.outside(projects(spark, d), eligible(spark, d), "pid").select("pid")


PAIR_THRESHOLD = 0.40
_PAIRS = f"SELECT a.vec_id AS chunk_a, b.vec_id AS chunk_b, a.label AS document_a, b.label AS document_b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {PAIR_THRESHOLD}"


def _pairs(spark, d):
    return evidence.similar_pairs(table(spark, d, "embeddings"), PAIR_THRESHOLD)


@query("jn9_similar_pairs", _PAIRS)
def _(spark, d):
    return rounded(_pairs(spark, d))


@query("jn11_touching", f"SELECT chunk_a, chunk_b FROM ({_PAIRS}) WHERE chunk_a % 5 = 0 OR chunk_b % 5 = 0")
def _(spark, d):
    ids = table(spark, d, "embeddings").where("vec_id % 5 = 0")
    return relations.touching(_pairs(spark, d), ids, "chunk_a", "chunk_b", "vec_id").select("chunk_a", "chunk_b")


@query("jn12_alignment", "SELECT s.n_name AS key, CAST(l.c AS BIGINT) AS live, CAST(p.c AS BIGINT) AS portfolio, l.c = p.c AS agrees FROM nation s LEFT JOIN (SELECT state, count(*) AS c FROM projects WHERE acct > 0 GROUP BY 1) l ON l.state = s.n_name LEFT JOIN (SELECT state, count(*) AS c FROM projects WHERE acct > 9000 GROUP BY 1) p ON p.state = s.n_name")
def _(spark, d):
    p = projects(spark, d)
    side = lambda lim: p.where(F.col("acct") > lim).groupBy(F.col("state").alias("key")).agg(F.count("*").alias("c"))
    return relations.aligned(table(spark, d, "nation").select(F.col("n_name").alias("key")), side(0), side(9000), "key", "c")


# ---------------------------------------------------------------- 2.6: windows


@query("win1_trends", """SELECT pid, midx, round(inc, 4) AS inc, round(avg(inc) OVER (PARTITION BY pid ORDER BY midx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS trend3
FROM (SELECT pid, midx, coalesce(cost - lag(cost) OVER (PARTITION BY pid ORDER BY midx), cost) AS inc FROM snapshots)""")
def _(spark, d):
    w = panel.by_month()
    rows = snapshots(spark, d).withColumn("inc", panel.increment("cost", w)).withColumn("trend3", panel.trailing_mean("inc", w))
    return rounded(rows.select("pid", "midx", "inc", "trend3"), 4)


@query("win3_adverse", """SELECT pid, midx, adverse, CAST(sum(adverse) OVER (PARTITION BY pid ORDER BY midx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS adverse_3
FROM (SELECT pid, midx, coalesce(CAST(coalesce(severity - lag(severity) OVER (PARTITION BY pid ORDER BY midx), severity) > 0 AS INTEGER), 0) AS adverse FROM snapshots)""")
def _(spark, d):
    w = panel.by_month()
    rows = snapshots(spark, d).withColumn("adverse", panel.rising("severity", w)).withColumn("adverse_3", panel.trailing_sum("adverse", w))
    return rows.select("pid", "midx", "adverse", "adverse_3")


@query("win4_run_length", """SELECT pid, midx, f, CAST(sum(f) OVER (PARTITION BY pid, g ORDER BY midx) AS BIGINT) AS run
FROM (SELECT *, sum(1 - f) OVER (PARTITION BY pid ORDER BY midx) AS g FROM (SELECT pid, midx, CAST(cost > 150000 AS INTEGER) AS f FROM snapshots))""")
def _(spark, d):
    rows = snapshots(spark, d).select("pid", "midx", (F.col("cost") > 150000).cast("int").alias("f"))
    return panel.run_length(rows, "f", "run")


@query("win6_risk_levels", "SELECT pid, round(score, 6) AS score, level FROM risk")
def _(spark, d):
    return rounded(risk(spark, d).select("pid", "score", "level"))


@query("win7_latest_snapshot", "SELECT pid, max(midx) AS midx, arg_max(month, midx) AS month, arg_max(cost, midx) AS cost FROM snapshots GROUP BY pid")
def _(spark, d):
    return panel.latest_row(snapshots(spark, d), ["month", "cost"])


@query("win10_chronological_split")
def _(spark, d):
    starts = snapshots(spark, d).groupBy("pid").agg(F.min("midx").alias("start"))
    return measures.chronological_split(starts, "start", "pid")


@query("agg20_percentiles", "SELECT pid, round(100 * cume_dist() OVER (ORDER BY score), 6) AS percentile FROM risk")
def _(spark, d):
    return rounded(portfolio.positions(risk(spark, d)).select("pid", "percentile"))


# ---------------------------------------------------------------- 2.3 and 2.7: filters, order, top-k


@query("prj1_first_known", "SELECT pid, arg_min(severity, midx) FILTER (WHERE severity IS NOT NULL) AS severity, arg_min(month, midx) AS month FROM snapshots GROUP BY pid")
def _(spark, d):
    return panel.first_known(snapshots(spark, d), ["severity", "month"], "pid", "midx")


@query("flt1_list_page", "SELECT pid, name FROM projects WHERE state = 'NATION_17' AND ptype = 'BUILDING' ORDER BY pid LIMIT 20 OFFSET 0")
def _(spark, d):
    return relations.page(relations.where_equal(projects(spark, d), state="NATION_17", ptype="BUILDING", contractor=None), ["pid"]).select("pid", "name")


@query("flt2_search", "SELECT pid FROM projects WHERE contains(lower(name), '#00000010') OR contains(lower(state), 'an') OR contains(lower(contractor), 'k4')")
def _(spark, d):
    return relations.search(projects(spark, d), " AN ", ["state"]).select("pid").union(relations.search(projects(spark, d), "#00000010", ["name"]).select("pid")).union(relations.search(projects(spark, d), "K4", ["contractor"]).select("pid")).distinct()


@query("flt6_prefix_month", "SELECT pid, midx, month FROM snapshots WHERE pid = 7 AND midx <= (SELECT max(midx) FROM snapshots WHERE pid = 7)")
def _(spark, d):
    s = snapshots(spark, d)
    last = s.where("pid = 7").agg(F.max("midx").alias("m")).first()["m"]
    return relations.up_to_month(s, "midx", last, "pid", 7).select("pid", "midx", "month")


@query("ord1_risk_page", "SELECT pid, round(score, 6) AS score, level, (SELECT count(*) FROM risk WHERE level = 'HIGH') AS total FROM risk WHERE level = 'HIGH' ORDER BY score DESC, pid LIMIT 20")
def _(spark, d):
    return rounded(portfolio.risk_page(risk(spark, d), 20, level="HIGH").select("pid", "score", "level", "total"))


@query("cmp3_risk_projects", "SELECT pid, state, ptype, contractor, round(score, 6) AS score, level FROM risk")
def _(spark, d):
    return rounded(risk(spark, d).select("pid", "state", "ptype", "contractor", "score", "level"))


@query("ord6_top_segment", f"SELECT value, n_hist, delay_rate FROM ({_segments('state')}) WHERE NOT small_sample ORDER BY delay_rate DESC, n_hist DESC, value LIMIT 1")
def _(spark, d):
    rows = portfolio.segment_report(with_project(outcomes(spark, d), spark, d), risk(spark, d), "state")
    return rounded(portfolio.top_segment(rows, "delay_rate").select("value", "n_hist", "delay_rate"))


def _query_vector(spark, d) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@query("ord8_nearest", "SELECT vec_id, round(s, 6) AS similarity, CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM (SELECT vec_id, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 5")
def _(spark, d):
    return rounded(evidence.nearest(table(spark, d, "embeddings"), _query_vector(spark, d)))


@query("flt8_nearest_over_threshold", "SELECT vec_id, round(s, 6) AS similarity, CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM (SELECT vec_id, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings) WHERE s >= 0.35 ORDER BY s DESC, vec_id LIMIT 20")
def _(spark, d):
    return rounded(evidence.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 20, evidence.RELEVANT))


@query("cmp20_evidence", "SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS INTEGER) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.35) WHERE rank <= 3")
def _(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(evidence.nearest_each(v, q))


@query("ord4_segments_in_order", f"SELECT value, n_hist FROM ({_segments('state')}) ORDER BY coalesce(n_hist, 0) DESC, value")
def _(spark, d):
    return portfolio.ordered_segments(portfolio.segment_report(with_project(outcomes(spark, d), spark, d), risk(spark, d), "state")).select("value", "n_hist")


# ---------------------------------------------------------------- 2.8 and 2.9: sets, scalars, text


@query("set9_first_seen", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1 ORDER BY 2 LIMIT 2")
def _(spark, d):
    return relations.top_ids_with_order(table(spark, d, "events"), "event_type", "event_id", 2)


@query("sc3_ratios", "SELECT pid, midx, CASE WHEN severity IS NULL THEN NULL ELSE round(least(severity / greatest(done, 0.000001), 5.0), 6) END AS ratio, round((100.0 - done) / greatest(n_orders, 1.0), 6) AS pressure FROM snapshots")
def _(spark, d):
    rows = snapshots(spark, d)
    return rounded(rows.select("pid", "midx", panel.capped_ratio(F.col("severity"), F.col("done")).alias("ratio"), panel.pressure(F.col("done"), F.col("n_orders")).alias("pressure")))


@query("sc20_month_difference", "SELECT o_orderkey, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 3 AS INTEGER) AS months FROM orders")
def _(spark, d):
    rows = table(spark, d, "orders")
    return rows.select("o_orderkey", panel.months_between_starts(F.lit("1995-03-31").cast("date"), F.date_format("o_orderdate", "yyyy-MM")).alias("months"))


@query("sc43_text_quality", r"SELECT doc_id, round(CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \t\n\v\f\r]', '', 'g') <> '')) > 0 THEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r] {3,}[^ \t\n\v\f\r]'))) / len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \t\n\v\f\r]', '', 'g') <> '')) ELSE 0 END, 6) AS irregular_share, round(CASE WHEN length(regexp_replace(text, '[ \t\n\v\f\r]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^0-9]', '', 'g')) / length(regexp_replace(text, '[ \t\n\v\f\r]', '', 'g')) ELSE 0 END, 6) AS numeric_density FROM documents")
def _(spark, d):
    q = evidence.text_quality(F.col("text"))
    return rounded(table(spark, d, "documents").select("doc_id", q["irregular_share"].alias("irregular_share"), q["numeric_density"].alias("numeric_density")))


_T = r"regexp_replace(coalesce(text, ''), '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')"
_W = rf"list_filter(regexp_split_to_array({_T}, '[ \t\n\v\f\r]+'), lambda w: w <> '')"


@query("sc44_ocr_class", rf"SELECT doc_id, CASE WHEN length({_T}) = 0 THEN 'empty_ocr_output' WHEN length(regexp_replace({_T}, '[^\p{{L}}]', '', 'g')) < 0.6 * length(regexp_replace({_T}, '[ \t\n\v\f\r]', '', 'g')) OR len(list_filter({_W}, lambda w: length(w) <= 2)) > 0.4 * len({_W}) THEN 'suspicious_text' WHEN length({_T}) < 30 THEN 'low_ocr_quality' END AS quality FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", evidence.ocr_class(F.col("text")).alias("quality"))


_STOP = ", ".join(f"'{w}'" for w in evidence.STOP_WORDS)


@query("sc37_content_words", f"SELECT conv_id, turn, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda w: NOT list_contains([{_STOP}], w)))) AS INTEGER) AS n_words FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(evidence.content_words(F.col("text"))).alias("n_words"))


@query("set6_overlap", f"""SELECT item_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS jaccard
FROM (SELECT x.item_id, list_distinct(list_filter(regexp_extract_all(lower(x.text), '[a-z]{{4,}}'), lambda w: NOT list_contains([{_STOP}], w))) AS a,
list_distinct(list_filter(regexp_extract_all(lower(y.text), '[a-z]{{4,}}'), lambda w: NOT list_contains([{_STOP}], w))) AS b FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1)""")
def _(spark, d):
    b = table(spark, d, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return rounded(b.join(nxt, "item_id").select("item_id", evidence.overlap(evidence.content_words(F.col("text")), evidence.content_words(F.col("other"))).alias("jaccard")))


@query("sc41_chunks")
def _(spark, d):
    return evidence.chunk_documents(table(spark, d, "documents"), "doc_id").drop("chunk_text", "page")


@query("sc36_claims")
def _(spark, d):
    return evidence.extract_claims(table(spark, d, "documents"), "doc_id", "source")


@query("cmp12_flags")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "text")
    claims = staged(evidence.extract_claims(docs), "claims")
    with_claims = evidence.hashed_embedding(docs.join(claims.select("chunk_id").distinct(), "chunk_id", "left_semi"), "text")
    pairs = evidence.similar_pairs(with_claims, evidence.PAIRED, "chunk_id", "document_id")
    return evidence.flags(evidence.compare_claims(pairs, claims)).select("flag_id", "chunk_a", "chunk_b", "claim_type", "description")


@query("sc65_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


# ---------------------------------------------------------------- 2.10 to 2.13: models, checks, assistance, streams


@query("ml11_linear_attribution", "SELECT l_orderkey, l_linenumber, feature, round(attribution, 4) AS attribution FROM (SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_tax']) AS feature, unnest([2.5 * (l_quantity - (SELECT avg(l_quantity) FROM lineitem)), -40.0 * (l_tax - (SELECT avg(l_tax) FROM lineitem))]) AS attribution FROM lineitem)")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("k"), "l_quantity", "l_tax")
    out = models.linear_attribution(rows, "k", {"l_quantity": 2.5, "l_tax": -40.0}, rows)
    return out.select("k.l_orderkey", "k.l_linenumber", "feature", F.round("attribution", 4).alias("attribution"))


@query("ml9_logistic_scores")
def _(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", " ")).cast("double").alias("n_words")), "doc_id")
    fitted, med = models.fitted(rows, models.classifier("logistic", "quality", rows.count()), ["n_chars", "n_words"], ["lang"])
    return fitted.transform(models.filled(rows, med, ["lang"])).select("doc_id", F.col("quality").alias("y"), models.probability().alias("p"), "prediction")


@query("dq_checks", "SELECT 'quantity' AS \"check\", CASE WHEN f = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(f AS DOUBLE) AS faults FROM (SELECT count(*) FILTER (WHERE l_quantity <= 0) AS f FROM lineitem) UNION ALL SELECT 'discount', CASE WHEN f = 0 THEN 'PASS' ELSE 'WARN' END, CAST(f AS DOUBLE) FROM (SELECT count(*) FILTER (WHERE l_discount > 0.09) AS f FROM lineitem)")
def _(spark, d):
    c = F.col
    checks = [measures.check("quantity", F.count_if(c("l_quantity") <= 0), "positive"), measures.check("discount", F.count_if(c("l_discount") > 0.09), "at most 9 %", warn=True)]
    return measures.run_checks(table(spark, d, "lineitem"), checks).select("check", "status", "faults")


@query("sc49_intents", "SELECT conv_id, turn, CASE WHEN " + " WHEN ".join("(" + " OR ".join(f"regexp_matches(lower(text), '{p}')" for p in ps) + f") THEN '{n}'" for n, ps in assist.INTENTS) + " ELSE 'unsupported' END AS intent FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", assist.intent(F.col("text")).alias("intent"))


@query("sc48_entities", r"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\bcritical\b') THEN 'CRITICAL' WHEN regexp_matches(lower(text), '\bhigh\b') THEN 'HIGH' WHEN regexp_matches(lower(text), '\bmedium\b') THEN 'MEDIUM' WHEN regexp_matches(lower(text), '\blow\b') THEN 'LOW' END AS risk_level, CASE WHEN contains(lower(text), 'contractor') THEN 'contractor' WHEN contains(lower(text), 'project type') THEN 'project_type' WHEN contains(lower(text), 'state') THEN 'state' END AS dimension FROM conversations")
def _(spark, d):
    e = assist.entities(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", e["risk_level"].alias("risk_level"), e["dimension"].alias("dimension"))


@query("sc63_overlay", "SELECT c_custkey, 100.0::DOUBLE AS c_acctbal, round(100.0 - c_acctbal, 6) AS c_acctbal__delta FROM customer")
def _(spark, d):
    return rounded(assist.overlay(table(spark, d, "customer"), {"c_acctbal": 100.0}).select("c_custkey", "c_acctbal", "c_acctbal__delta"))


@query("flt13_extrapolation", "SELECT c_custkey, 'acct' AS field, c_acctbal AS value FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
def _(spark, d):
    values = table(spark, d, "customer").select("c_custkey", F.lit("acct").alias("field"), F.col("c_acctbal").alias("value"))
    bounds = spark.createDataFrame([("acct", 0.0, 9000.0, 1)], "column string, lo double, hi double, n int")
    return assist.extrapolation(values, bounds).select("c_custkey", "field", "value")


@query("jn16_report")
def _(spark, d):
    return lifecycle.project_report(projects(spark, d), snapshots(spark, d), risk(spark, d), 7).withColumn("months", F.size("history")).drop("history", "risk")


@query("cmp6_insights")
def _(spark, d):
    return portfolio.insights(with_project(outcomes(spark, d), spark, d), risk(spark, d))


def _ntz(rows: DataFrame) -> DataFrame:
    """Window starts as the tables' own kind of time."""
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return _ntz(streams.drained(streams.bucketed(streams.event_stream(spark, d)), "tumbling"))


@query("stream_sliding", "SELECT start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 DAY]) AS start FROM events) GROUP BY 1, 2")
def _(spark, d):
    return _ntz(streams.drained(streams.bucketed(streams.event_stream(spark, d), "2 days", "1 day"), "sliding"))


@query("stream_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, g")
def _(spark, d):
    return _ntz(streams.drained(streams.sessions(streams.event_stream(spark, d)), "sessions"))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return streams.drained(streams.deduplicated(streams.event_stream(spark, d), ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "dedup", "append")
