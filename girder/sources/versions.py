"""Tables that are replaced together: each load goes to a folder of its own, and one row of a manifest table makes it the current one.

The manifest is only ever appended to, by a Spark job whose commit is a rename, so a load that is killed at any step leaves no row and readers stay
on the tables before it. Folders of loads that never got a row, and of old versions, are removed by `vacuum`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = "version long, folder string, about string"


def history(spark: SparkSession, path: str) -> list[dict]:
    """All versions, the latest first (a row for each load)."""
    try:
        rows = spark.read.schema(_ROW).parquet(f"{path}/manifest").orderBy(F.desc("version"), F.desc("folder")).collect()
    except AnalysisException:
        return []
    return [{"version": r["version"], "folder": r["folder"], "about": json.loads(r["about"])} for r in rows]


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], about: dict | None = None, by: dict[str, list[str]] | None = None) -> int:
    """Write all tables (partitioned as `by` says) and then make them current at once; the new version's number."""
    folder = f"data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.partitionBy(*(by or {}).get(name, [])).parquet(f"{path}/{folder}/{name}")
    last = history(spark, path)
    version = last[0]["version"] + 1 if last else 1
    row = spark.createDataFrame([(version, folder, json.dumps((about or {}) | {"tables": sorted(tables)}))], _ROW)
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def current(spark: SparkSession, path: str) -> dict | None:
    found = history(spark, path)
    return found[0] if found else None


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the current version; refused where there is none."""
    now = current(spark, path)
    if now is None or name not in now["about"]["tables"]:
        raise FileNotFoundError(f"no {name} in {path}")
    return spark.read.parquet(f"{path}/{now['folder']}/{name}")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove the folders of all but the last `keep` versions, and of loads that were not finished; their number. Not while a load runs."""
    kept = {v["folder"].rpartition("/")[2] for v in history(spark, path)[:keep]}
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName() not in kept] if fs.exists(top) else []
    return sum(bool(fs.delete(p, True)) for p in gone)
