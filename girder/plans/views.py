"""Project, snapshot and score views over the order tables, for queries and their SQL.

A customer is a project, a customer's orders of a month are a monthly snapshot, the last month is the terminal one.
NULLs are injected by key, since the tables hold none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(F.broadcast(n.select("n_nationkey", "n_name")), c["c_nationkey"] == n["n_nationkey"])
    contractor = F.when(F.col("c_custkey") % 97 != 0, F.concat(F.lit("K"), (F.col("c_custkey") % 50).cast("string")))
    return rows.select(F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"), F.col("n_name").alias("state"), F.col("c_mktsegment").alias("ptype"), contractor.alias("contractor"), F.col("c_acctbal").alias("acct"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    midx = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    # dealt by customer once, for months and windows alike: a customer has hardly more orders than months
    rows = o.select(F.col("o_custkey").alias("pid"), midx.alias("midx"), "o_orderdate", "o_totalprice", "o_orderstatus").repartition("pid").groupBy("pid", "midx").agg(
        F.min("o_orderdate").alias("first_date"),
        F.count("*").alias("n_orders"),
        F.round(F.sum("o_totalprice"), 2).alias("cost"),
        F.count_if(F.col("o_orderstatus") == "F").alias("done"),
    )
    rows = rows.select("pid", "midx", F.date_format("first_date", "yyyy-MM").alias("month"), "n_orders", "cost", "done")
    last = F.max("midx").over(Window.partitionBy("pid"))
    severity = F.when((F.col("pid") + F.col("midx")) % 13 != 0, F.floor(F.col("cost") / 50000))
    return rows.withColumn("is_terminal", F.col("midx") == last).withColumn("severity", severity)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal rows with recorded outcomes."""
    return with_outcomes(snapshots(spark, sf_dir).where("is_terminal")).select("pid", "midx", "delay_days", "overrun_pct", "delayed", "overrun")


def with_outcomes(rows: DataFrame) -> DataFrame:
    delay = (F.col("n_orders") * 40 - F.col("done") * 15).cast("int")
    over = F.round(F.col("cost") / 20000, 2)
    rows = rows.withColumns({"delay_days": delay, "overrun_pct": over})
    return rows.withColumns({"delayed": (F.col("delay_days") > 60).cast("int"), "overrun": (F.col("overrun_pct") > 10.0).cast("int")})


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    from girder.operators.panel import latest_open_month

    return latest_open_month(snapshots(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored row for each project with a month before its terminal one."""
    s, e, p = snapshots(spark, sf_dir), eligible(spark, sf_dir), projects(spark, sf_dir)
    rows = s.join(e, (s["pid"] == e["pid"]) & (s["midx"] == e["m"])).drop(e["pid"]).join(p, "pid")
    prob = F.when(F.col("pid") % 11 != 0, F.col("n_orders") * 0.25 - F.floor(F.col("n_orders") * 0.25))
    return rows.select(
        "pid", "m", "month", "state", "ptype", "contractor", "n_orders", F.col("cost").alias("delay_pred"), F.col("acct").alias("cost_pred"),
        prob.alias("p_delay"), (F.col("pid") % 2).cast("int").alias("c_delay"), ((F.col("pid") % 101) / 100.0).alias("p_cost"), ((F.col("pid") + 1) % 2).cast("int").alias("c_cost"),
    )


VIEWS = """
projects AS (SELECT c_custkey AS pid, c_name AS name, n_name AS state, c_mktsegment AS ptype,
  CASE WHEN c_custkey % 97 <> 0 THEN 'K' || CAST(c_custkey % 50 AS VARCHAR) END AS contractor, c_acctbal AS acct
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
months AS (SELECT o_custkey AS pid, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS midx, min(strftime(o_orderdate, '%Y-%m')) AS month,
  count(*) AS n_orders, round(sum(o_totalprice), 2) AS cost, count(*) FILTER (WHERE o_orderstatus = 'F') AS done
  FROM orders GROUP BY 1, 2),
snapshots AS (SELECT *, midx = max(midx) OVER (PARTITION BY pid) AS is_terminal,
  CASE WHEN (pid + midx) % 13 <> 0 THEN CAST(floor(cost / 50000) AS BIGINT) END AS severity FROM months),
outcomes0 AS (SELECT pid, midx, CAST(n_orders * 40 - done * 15 AS INTEGER) AS delay_days, round(cost / 20000, 2) AS overrun_pct FROM snapshots WHERE is_terminal),
outcomes AS (SELECT *, CAST(delay_days > 60 AS INTEGER) AS delayed, CAST(overrun_pct > 10.0 AS INTEGER) AS overrun FROM outcomes0),
eligible AS (SELECT pid, max(midx) AS m FROM snapshots WHERE NOT is_terminal GROUP BY pid),
scores AS (SELECT s.pid, e.m, s.month, p.state, p.ptype, p.contractor, s.n_orders, s.cost AS delay_pred, p.acct AS cost_pred,
  CASE WHEN s.pid % 11 <> 0 THEN s.n_orders * 0.25 - floor(s.n_orders * 0.25) END::DOUBLE AS p_delay, CAST(s.pid % 2 AS INTEGER) AS c_delay,
  (s.pid % 101) / 100.0::DOUBLE AS p_cost, CAST((s.pid + 1) % 2 AS INTEGER) AS c_cost
  FROM snapshots s JOIN eligible e ON s.pid = e.pid AND s.midx = e.m JOIN projects p ON p.pid = s.pid),
stats AS (SELECT min(delay_pred) AS dlo, max(delay_pred) AS dhi, min(cost_pred) AS clo, max(cost_pred) AS chi FROM scores),
parts AS (SELECT s.*, coalesce(p_delay, c_delay) AS pd, coalesce(p_cost, c_cost) AS pc,
  CASE WHEN dhi = dlo THEN 0.5 ELSE (delay_pred - dlo) / (dhi - dlo) END AS nd,
  CASE WHEN chi = clo THEN 0.5 ELSE (cost_pred - clo) / (chi - clo) END AS nc FROM scores s, stats),
scored AS (SELECT *, 100 * ((pd + nd) / 2 + (pc + nc) / 2) / 2 AS score FROM parts),
cuts AS (SELECT count(*) AS n, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS q2, quantile_cont(score, 0.75) AS q3 FROM scored),
risk AS (SELECT s.*, CASE WHEN n < 2 OR score <= q1 THEN 'LOW' WHEN score <= q2 THEN 'MEDIUM' WHEN score <= q3 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM scored s, cuts)"""


def sql(body: str) -> str:
    """The views, then a query that may open with further views after a comma."""
    return f"WITH {VIEWS.strip()}\n{body}"
