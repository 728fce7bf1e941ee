"""Readers and writers: snapshot files, document chunks, JSON artifacts, vectors, and the loaded tables.

Reads have explicit schemas (no inference pass). Loads overwrite only the partition of their provenance, so that user rows
survive; the tables are written beside the old ones and counted before they take their place.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators.panel import first_known
from girder.operators.relations import duplicates, orphans
from girder.sources.schemas import CHUNK_FILE, PROJECT_COLUMNS, SNAPSHOT_FILE, names, require_columns
from girder.sources.staging import staged


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The wide snapshot file; NaN becomes null. A file without a required column is refused by name."""
    head = spark.read.option("header", True).csv(path)
    require_columns(head, names(SNAPSHOT_FILE))
    types = dict(f.split() for f in SNAPSHOT_FILE.replace("\n", " ").split(","))
    rows = head.select(*[F.col(c).cast(t).alias(c) if t != "double" else F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c, t in types.items()])
    return rows


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """An all-text file whose blanks stay empty texts."""
    return spark.read.option("header", True).csv(path).na.fill("")


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(usable chunks, those with no text)."""
    from girder.operators.evidence import meaningful

    rows = spark.read.schema(CHUNK_FILE).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    good = meaningful(F.col("chunk_text"))
    return rows.where(good), rows.where(~good)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """(task, rank, feature, mean_abs) of a JSON artifact: task -> {global_feature_ranking: [{feature, mean_abs_shap}]}."""
    kind = "map<string, struct<label:string, model_family_explained:string, global_feature_ranking:array<struct<feature:string, mean_abs_shap:double>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("task", "v"))
    return rows.select("task", F.posexplode("v.global_feature_ranking").alias("p", "f")).select("task", (F.col("p") + 1).alias("rank"), F.col("f.feature").alias("feature"), F.col("f.mean_abs_shap").alias("mean_abs"))


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(column, lo, hi, n) of a training-range artifact."""
    text = spark.read.text(path, wholetext=True)
    inner = F.from_json(F.get_json_object("value", "$.features"), "map<string, struct<min:double, max:double, n_non_null:long>>")
    return text.select(F.explode(inner).alias("column", "r")).select("column", F.col("r.min").alias("lo"), F.col("r.max").alias("hi"), F.col("r.n_non_null").alias("n"))


def read_vectors(spark: SparkSession, path: str, size: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A vector table, refused as a whole if any vector has another size or a value that is no number."""
    rows = spark.read.parquet(path).select(key, vector)
    broken = (F.size(vector) != size) | ~F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    if not rows.where(F.coalesce(broken, F.lit(True))).isEmpty():
        raise ValueError("vectors of another size or with values that are no numbers")
    return rows


def missing_files(spark: SparkSession, manifest: DataFrame, folder: str, column: str = "local_filename") -> DataFrame:
    """Manifest rows that name a file which is not in the folder; blank names are skipped."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split("path", "/"), -1).alias(column)).distinct()
    return manifest.where(F.trim(F.col(column)) != "").join(there, column, "left_anti")


def projects_of(rows: DataFrame) -> DataFrame:
    """One row a project: each attribute's first known value in month order."""
    return first_known(rows, PROJECT_COLUMNS, "project_id", "reporting_month").withColumns({"is_archived": F.lit(False), "archived_at": F.lit(None).cast("timestamp_ntz")})


def snapshots_of(rows: DataFrame) -> DataFrame:
    moved = [c for c in rows.columns if c not in PROJECT_COLUMNS or c == "data_provenance"]
    return rows.select(*moved).withColumn("is_terminal_snapshot", F.coalesce(F.col("project_status") == "Completed", F.lit(False)))


def rejoined(projects: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Project and snapshot columns side by side again."""
    return snapshots.join(projects.drop("data_provenance", "is_archived", "archived_at"), "project_id")


def write_partition(rows: DataFrame, path: str, by: str = "data_provenance") -> None:
    """Replace only the partitions that rows have."""
    rows.write.mode("overwrite").partitionBy(by).option("partitionOverwriteMode", "dynamic").parquet(path)


def load(spark: SparkSession, csv: str, folder: str) -> dict[str, int | bool]:
    """Load a snapshot file into the project and snapshot tables and reconcile the counts.

    The new rows are written and counted beside the tables first; only if the counts agree do they replace their partitions.
    """
    raw = read_snapshots(spark, csv)
    p, s = staged(projects_of(raw), "projects"), staged(snapshots_of(raw), "snapshots")
    out = {"rows": raw.count(), "projects": p.count(), "snapshots": s.count(), "orphans": orphans(s, p, "project_id").count(), "duplicates": duplicates(s, ["project_id", "reporting_month"]).count()}
    out["reconciled"] = out["rows"] == out["snapshots"] and not out["orphans"] and not out["duplicates"] and out["projects"] == raw.select("project_id").distinct().count()
    if out["reconciled"]:
        write_partition(p, f"{folder}/projects")
        write_partition(s, f"{folder}/snapshots")
    return out


def validated(spark: SparkSession, csv: str, pct: list[str], amounts: list[str]) -> tuple[bool, DataFrame | None]:
    """(whether no check fails, the report); without a readable file, (False, None)."""
    from girder.operators.measures import panel_report

    try:
        rows = read_snapshots(spark, csv)
    except AnalysisException:
        return False, None
    report = panel_report(rows, pct, amounts)
    return report.where("status = 'FAIL'").isEmpty(), report


# ---------------------------------------------------------------- chunks, indexes, caches and small artifacts


def chunk_counts(chunks: DataFrame, included: Column) -> DataFrame:
    """One row: how many chunks there are, are kept and are left out."""
    return chunks.agg(F.count("*").alias("total"), F.count_if(F.coalesce(included, F.lit(False))).alias("included"), F.count_if(~F.coalesce(included, F.lit(False))).alias("excluded"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small artifact (metrics, ranges) as one JSON text."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The artifact, or None where there is none."""
    try:
        return json.loads(spark.read.text(path).first()[0])
    except AnalysisException:
        return None


def table_digest(rows: DataFrame, columns: list[str]) -> str:
    """A digest of a table's rows whatever their order: their number, and the sum and the parity of two row hashes."""
    a, b = F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)
    r = rows.agg(F.count("*").alias("n"), F.sum(a.cast("decimal(38,0)")).cast("string").alias("s"), F.bit_xor(b).alias("x")).first()
    return f"{r['n']}:{r['s']}:{r['x']}"


def build_index(chunks: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], model: str, size: int, key: str = "chunk_id", text: str = "text", force: bool = False) -> bool:
    """Embed every chunk into `path`, unless its chunks and model are those of the index that is there; whether it was built.

    Repeated ids, lost chunks and vectors of another size are refused before anything is replaced.
    """
    spark = chunks.sparkSession
    about = {"model": model, "size": size, "digest": table_digest(chunks, [key, text])}
    there = read_json(spark, f"{path}/about")
    if not force and there is not None and {k: there.get(k) for k in about} == about:
        return False
    if not duplicates(chunks, [key]).isEmpty():
        raise ValueError(f"repeated {key}")
    made = staged(embed(chunks), "index")
    if made.count() != chunks.count():
        raise ValueError("the index does not hold every chunk")
    if not made.where((F.size("embedding") != size) | F.col("embedding").isNull()).isEmpty():
        raise ValueError(f"vectors of another size than {size}")
    made.write.mode("overwrite").parquet(f"{path}/vectors")
    write_json(spark, f"{path}/about", about | {"count": made.count()})
    return True


def read_index(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The vectors of an index; refused if it is of another model or does not hold as many vectors as it says."""
    about = read_json(spark, f"{path}/about")
    if about is None or about["model"] != model:
        raise ValueError(f"no index of {model} in {path}")
    rows = spark.read.parquet(f"{path}/vectors")
    if rows.count() != about["count"]:
        raise ValueError("the index has lost vectors")
    return rows


def write_query_cache(queries: list[DataFrame], embed: Callable[[DataFrame], DataFrame], path: str, text: str = "query") -> int:
    """Embed the distinct texts of all query sets once, in order, into a cache table; their number."""
    whole = queries[0].select(text)
    for q in queries[1:]:
        whole = whole.union(q.select(text))
    embed(whole.distinct()).select(text, "embedding").orderBy(text).write.mode("overwrite").parquet(path)
    return whole.sparkSession.read.parquet(path).count()
