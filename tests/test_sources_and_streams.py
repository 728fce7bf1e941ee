import json
import shutil

import pytest
from pyspark.sql import functions as F

from girder.operators import relations
from girder.sources import tables
from girder.streaming import events


def test_json_artifacts(spark, tmp_path):
    (tmp_path / "rank.json").write_text(json.dumps({"delay": {"label": "x", "global_feature_ranking": [{"feature": "a", "mean_abs_shap": 0.5}, {"feature": "b", "mean_abs_shap": 0.1}]}}))
    assert [tuple(r) for r in tables.read_ranking(spark, str(tmp_path / "rank.json")).collect()] == [("delay", 1, "a", 0.5), ("delay", 2, "b", 0.1)]
    (tmp_path / "ranges.json").write_text(json.dumps({"features": {"a": {"min": 0, "max": 2.5, "n_non_null": 7}}}))
    assert [tuple(r) for r in tables.read_ranges(spark, str(tmp_path / "ranges.json")).collect()] == [("a", 0.0, 2.5, 7)]


def test_text_tables_and_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("document_id,local_filename\nD1,a.pdf\nD2,\nD3,gone.pdf\n")
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.pdf").write_bytes(b"x")
    m = tables.read_text_table(spark, str(tmp_path / "m.csv"))
    assert m.where("local_filename = ''").count() == 1
    assert [r["document_id"] for r in tables.missing_files(spark, m, str(tmp_path / "files")).collect()] == ["D3"]


def test_vectors_are_all_or_nothing(spark, tmp_path):
    good = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id int, embedding array<double>")
    good.write.parquet(f"{tmp_path}/v")
    assert tables.read_vectors(spark, f"{tmp_path}/v", 2).count() == 1
    good.union(spark.createDataFrame([(2, [float("nan"), 0.0])], good.schema)).write.parquet(f"{tmp_path}/w")
    with pytest.raises(ValueError):
        tables.read_vectors(spark, f"{tmp_path}/w", 2)


def test_relations(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4), (2, 1), (5, 6)], "a int, b int")
    ids = spark.createDataFrame([(1,), (4,)], "id int")
    assert sorted(tuple(r) for r in relations.touching(pairs, ids, "a", "b", "id").select("a", "b").collect()) == [(1, 2), (2, 1), (3, 4)]
    rows = spark.createDataFrame([("50%_x", None), ("abc", "Q")], "n string, c string")
    assert relations.search(rows, "%_", ["n", "c"]).count() == 1 and relations.search(rows, "  ", ["n"]).count() == 2
    with pytest.raises(ValueError):
        relations.page(rows, ["n"], 1, 101)
    spine = spark.createDataFrame([("d",), ("c",), ("x",)], "key string")
    live = spark.createDataFrame([("d", "f1"), ("c", "f2")], "key string, v string")
    port = spark.createDataFrame([("d", "f1"), ("c", "f9")], "key string, v string")
    got = relations.aligned(spine, live, port, "key", "v")
    assert {r["key"]: r["agrees"] for r in got.collect()} == {"d": True, "c": False, "x": None}
    assert [r["key"] for r in relations.divergences(got, "key").collect()] == ["c"]


def test_streams_equal_batches(spark, small, tmp_path):
    batch = spark.read.parquet(f"{small}/events.parquet")
    stream = events.event_stream(spark, small)
    out = f"{tmp_path}/out"
    events.run_once(events.bucketed(stream), out, f"{tmp_path}/cp")
    closed = {tuple(r) for r in spark.read.parquet(out).collect()}
    full = {tuple(r) for r in events.bucketed(batch.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert closed <= full and len(closed) >= len(full) * 0.8
    events.run_once(events.deduplicated(events.event_stream(spark, small).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "60 days"), f"{tmp_path}/d", f"{tmp_path}/dcp")
    assert spark.read.parquet(f"{tmp_path}/d").count() == batch.select("user_id", "event_type").distinct().count()


def test_appending_runs_each_batch_once(spark, small, tmp_path):
    seen = []
    q = events.appending(events.event_stream(spark, small), lambda df, k: seen.append((k, df.count())), f"{tmp_path}/cp")
    q.awaitTermination()
    again = events.appending(events.event_stream(spark, small), lambda df, k: seen.append((k, df.count())), f"{tmp_path}/cp")
    again.awaitTermination()
    assert len(seen) == 1 and seen[0][1] == spark.read.parquet(f"{small}/events.parquet").select(F.count("*")).first()[0]


def test_monthly_appends_are_guarded_on_a_stream(spark, tmp_path):
    from girder.sources.tables import projects_of, snapshots_of
    from tests.panel_data import generate_panel

    raw = generate_panel(spark, 20, seed=5).cache()
    projects, whole = projects_of(raw).cache(), snapshots_of(raw).drop("is_terminal_snapshot", "months_since_start").cache()
    months = sorted(r[0] for r in whole.select("reporting_month").distinct().collect())
    cut = months[len(months) // 2]
    base = snapshots_of(raw).where(F.col("reporting_month") < cut)
    one, two = [r[0] for r in whole.groupBy("project_id").agg(F.max("reporting_month").alias("m"), F.min("reporting_month").alias("n")).where((F.col("n") < cut) & (F.col("m") > cut)).orderBy(F.desc("m"), "project_id").limit(2).collect()]
    late = base.where(F.col("project_id") == one).orderBy("reporting_month").limit(1)
    store, feed = f"{tmp_path}/store", f"{tmp_path}/feed"
    base.join(late.select("project_id", "reporting_month"), ["project_id", "reporting_month"], "left_anti").write.parquet(f"{store}/snapshots/batch=-1")
    outcomes = ("final_delay_days", "significant_delay", "final_cost_overrun_pct", "cost_overrun")
    rows = whole.withColumns({c: F.when(F.col("project_status") == "Completed", F.col(c)) for c in outcomes})
    going = F.col("project_id").isin(one, two)
    new = rows.where((F.col("reporting_month") >= cut) & ~(going & (F.col("project_status") == "Completed")))
    new.coalesce(1).write.parquet(f"{feed}/a")
    late_row = rows.join(late.select("project_id", "reporting_month"), ["project_id", "reporting_month"], "left_semi").select(*new.columns)
    after = new.where("project_status = 'Completed'").limit(1).withColumns({"reporting_month": F.lit("2035-01"), "project_status": F.lit("In Progress"), **{c: F.lit(None).cast(new.schema[c].dataType) for c in outcomes}})
    late_row.unionByName(new.where(F.col("project_id") == two).limit(2)).unionByName(after).coalesce(1).write.parquet(f"{feed}/b")
    for part in ("a", "b", "b"):  # the second time, the checkpoint has nothing left to read
        stream = spark.readStream.schema(new.schema).parquet(f"{feed}/{part}")
        events.guarded_appends(stream.withColumn("__k", F.lit(0)).drop("__k"), projects, f"{store}", f"{tmp_path}/cp-{part}").awaitTermination()
        if part == "a":
            first = spark.read.parquet(f"{store}/snapshots").count()
    assert first == base.count() - 1 + new.count()
    refused = spark.read.parquet(f"{store}/refused").where("refused IS NOT NULL").groupBy("refused").count().collect()
    assert {r["refused"]: r["count"] for r in refused} == {"month exists": 2, "project has ended": 1}
    assert spark.read.parquet(f"{store}/snapshots").count() == whole.count() - 2
    shutil.rmtree(tmp_path / "cp-b")  # a fresh checkpoint of the same name reads everything again: all is refused, nothing is lost
    events.guarded_appends(spark.readStream.schema(new.schema).parquet(f"{feed}/b"), projects, store, f"{tmp_path}/cp-b").awaitTermination()
    assert spark.read.parquet(f"{store}/snapshots").count() == whole.count() - 2
    assert events.latest_features(spark.read.parquet(f"{store}/features")).groupBy("project_id", "reporting_month").count().where("count > 1").isEmpty()


def test_indexes_and_caches(spark, tmp_path):
    from girder.operators.evidence import hashed_embedding

    chunks = spark.createDataFrame([("a", "one two"), ("b", "three")], "chunk_id string, text string")
    embed = lambda rows: hashed_embedding(rows, "text", 16)
    path = f"{tmp_path}/index"
    assert tables.build_index(chunks, path, embed, "hash", 16) and not tables.build_index(chunks.orderBy("text"), path, embed, "hash", 16)
    assert tables.build_index(chunks, path, embed, "hash", 16, force=True) and tables.read_index(spark, path, "hash").count() == 2
    assert tables.build_index(chunks.where("chunk_id = 'a'"), path, embed, "hash", 16)
    for bad, size in ((chunks.union(chunks), 16), (chunks, 17)):
        with pytest.raises(ValueError):
            tables.build_index(bad, path, embed, "hash", size, force=True)
    with pytest.raises(ValueError):
        tables.read_index(spark, path, "other")
    q = spark.createDataFrame([("x",), ("y",), ("x",)], "query string")
    assert tables.write_query_cache([q, q], lambda rows: hashed_embedding(rows, "query", 8), f"{tmp_path}/cache") == 2
    counts = tables.chunk_counts(chunks, F.col("text") == "three").first()
    assert tuple(counts) == (2, 1, 1)
    tables.write_json(spark, f"{tmp_path}/m", {"a": 1})
    assert tables.read_json(spark, f"{tmp_path}/m") == {"a": 1} and tables.read_json(spark, f"{tmp_path}/none") is None
    assert tables.validated(spark, f"{tmp_path}/none", [], []) == (False, None)
