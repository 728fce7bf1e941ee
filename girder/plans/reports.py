"""The contradiction pass on yearly supplier reports that are made from lineitem.

A report has four pages: outlay (planned in odd years, incurred in even ones), progress with its date, works under way, and
toll receipts with their date. Pages of one supplier and number meet across years, so every kind of claim meets its own kind. The
SQL computes from the figures what the pass must read back out of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators import evidence
from girder.plans.catalog import query, rounded
from girder.plans.views import table
from girder.sources.staging import staged

_FIGURES = """figures AS (SELECT l_suppkey AS s, year(l_shipdate) AS y, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS outlay, count(*) AS n,
(100 * count(*) FILTER (WHERE l_linestatus = 'F')) // count(*) AS progress, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS tolls, max(l_shipdate) AS last
FROM lineitem WHERE l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1, 2)"""

_CLAIMS = f""", {_FIGURES}, read AS (
SELECT s, y, 1 AS page, 1 AS k, 'currency' AS claim_type, CAST(outlay AS DOUBLE) AS num, NULL AS iso, 'Rs. ' || outlay || ' crore' AS raw FROM figures
UNION ALL SELECT s, y, 2, 1, 'percentage', progress, NULL, progress || '%' FROM figures UNION ALL SELECT s, y, 2, 2, 'date', NULL, strftime(last, '%Y-%m-%d'), strftime(last, '%d/%m/%Y') FROM figures
UNION ALL SELECT s, y, 3, 1, 'count', n, NULL, n || ' projects' FROM figures WHERE n < 1000
UNION ALL SELECT s, y, 4, 1, 'currency', tolls / 100.0, NULL, 'Rs. ' || tolls || ' lakh' FROM figures UNION ALL SELECT s, y, 4, 2, 'date', NULL, strftime(last, '%Y-%m-%d'), strftime(last, '%d/%m/%Y') FROM figures),
claims AS (SELECT *, 'S' || s || '_' || y AS doc, 'S' || s || '_' || y || '_p' || page AS chunk, 'S' || s || '_' || y || '_p' || page || '_claim00' || k AS claim FROM read)"""

_COMPARED = f"""{_CLAIMS}, gaps AS (SELECT a.chunk AS chunk_a, b.chunk AS chunk_b, a.doc AS document_id_a, b.doc AS document_id_b, a.claim AS claim_id_a, b.claim AS claim_id_b, a.raw AS raw_a, b.raw AS raw_b, a.claim_type, a.page,
a.page = 1 AND a.y % 2 <> b.y % 2 AS worded, a.page = 4 AND a.claim_type = 'currency' AND x.iso <> z.iso AS apart, a.iso <> b.iso AS other, abs(a.num - b.num) AS gap, abs(a.num - b.num) / greatest(a.num, b.num, 1e-9) * 100 AS share
FROM claims a JOIN claims b ON b.s = a.s AND b.page = a.page AND b.claim_type = a.claim_type AND b.y > a.y
LEFT JOIN claims x ON x.chunk = a.chunk AND x.claim_type = 'date' LEFT JOIN claims z ON z.chunk = b.chunk AND z.claim_type = 'date'),
compared AS (SELECT *, CASE WHEN worded THEN 'planned_vs_actual_wording' WHEN apart THEN 'different_reporting_cutoff_dates' END AS reason,
CASE WHEN worded OR apart THEN 'contextual_difference' WHEN CASE claim_type WHEN 'percentage' THEN gap > 1 WHEN 'date' THEN other ELSE share > 5 END THEN 'flagged' ELSE 'not_flagged' END AS status,
CASE WHEN worded OR apart THEN NULL WHEN claim_type = 'percentage' THEN gap WHEN claim_type = 'date' THEN CASE WHEN other THEN 1.0 END ELSE share END AS difference FROM gaps)"""


def pages(spark, d) -> DataFrame:
    """(document_id, chunk_id, supplier, page, year, text): four pages for each supplier and year of shipping."""
    rows = table(spark, d, "lineitem").where("l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL")
    whole = lambda c: F.sum(F.floor(c).cast("long"))
    figures = rows.groupBy(F.col("l_suppkey").alias("supplier"), F.year("l_shipdate").alias("year")).agg(
        whole("l_extendedprice").alias("outlay"), F.count("*").alias("n"), whole("l_quantity").alias("tolls"), F.max("l_shipdate").alias("last"),
        F.expr("100 * count_if(l_linestatus = 'F') div count(*)").alias("progress"),
    )
    last = F.date_format("last", "dd/MM/yyyy")
    texts = F.array(
        F.format_string("Corridor outlay %s: Rs. %d crore.", F.when(F.col("year") % 2 == 0, "incurred").otherwise("planned"), "outlay"),
        F.format_string("Physical progress stood at %d%% until %s.", F.col("progress"), last),
        F.format_string("Works under way: %d projects.", F.col("n")),
        F.format_string("Toll receipts came to Rs. %d lakh until %s.", F.col("tolls"), last),
    )
    out = figures.select("supplier", "year", F.posexplode(texts).alias("page", "text")).withColumn("page", F.col("page") + 1)
    ids = {"document_id": F.format_string("S%s_%d", F.col("supplier").cast("string"), "year"), "chunk_id": F.format_string("S%s_%d_p%d", F.col("supplier").cast("string"), "year", "page")}
    return out.withColumns(ids)


def compared(spark, d) -> DataFrame:
    """The comparisons of all claims on pages of one supplier and number."""
    rows = staged(pages(spark, d), "pages")
    a, b = (rows.select("supplier", "page", F.col("year").alias(f"year_{s}"), F.col("chunk_id").alias(f"chunk_{s}")) for s in "ab")
    pairs = a.join(b, ["supplier", "page"]).where("year_a < year_b")
    return evidence.compare_claims(pairs, staged(evidence.extract_claims(rows), "claims"))


@query("cmp12_report_comparisons", f"{_COMPARED} SELECT chunk_a, chunk_b, claim_type, claim_id_a, claim_id_b, status, reason, round(difference, 6) AS difference, CASE WHEN reason IS NULL THEN 'high' END AS confidence, CASE WHEN worded THEN 0.5 ELSE 1.0 END AS jaccard FROM compared")
def _(spark, d):
    return rounded(compared(spark, d).select("chunk_a", "chunk_b", "claim_type", "claim_id_a", "claim_id_b", "status", "reason", "difference", "confidence", "jaccard"))


@query("cmp12_report_flags", f"""{_COMPARED} SELECT printf('FLAG-%04d', row_number() OVER (ORDER BY claim_type, document_id_a, document_id_b, chunk_a, chunk_b, claim_id_a, claim_id_b)) AS flag_id, chunk_a, chunk_b, claim_type,
'Possible inconsistency: ' || raw_a || ' in one source and ' || raw_b || ' in another; please review both.' AS description FROM compared WHERE status = 'flagged'""")
def _(spark, d):
    return evidence.flags(compared(spark, d)).select("flag_id", "chunk_a", "chunk_b", "claim_type", "description")


@query("agg27_claim_counts", f"{_CLAIMS} SELECT claim_type, count(*) AS n FROM claims GROUP BY claim_type")
def _(spark, d):
    return evidence.claim_counts(evidence.extract_claims(pages(spark, d)))


@query("agg28_chunk_dates", f"{_CLAIMS} SELECT chunk AS chunk_id, iso AS dates FROM claims WHERE claim_type = 'date'")
def _(spark, d):
    return evidence.chunk_dates(evidence.extract_claims(pages(spark, d))).select("chunk_id", F.array_join("dates", ",").alias("dates"))


@query("sc36_report_claims", f"{_CLAIMS} SELECT claim AS claim_id, chunk AS chunk_id, doc AS document_id, claim_type, raw, round(num, 6) AS num_value, iso AS date_iso FROM claims")
def _(spark, d):
    return rounded(evidence.extract_claims(pages(spark, d)).select("claim_id", "chunk_id", "document_id", "claim_type", "raw", "num_value", "date_iso"))
