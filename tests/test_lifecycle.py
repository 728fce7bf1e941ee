import pytest
from pyspark.sql import functions as F

from girder.operators import lifecycle
from girder.sources import tables
from girder.sources.tables import projects_of, snapshots_of
from tests.panel_data import generate_panel


@pytest.fixture(scope="module")
def store(spark):
    raw = generate_panel(spark, 5, seed=2).cache()
    return projects_of(raw).cache(), snapshots_of(raw).cache()


def test_ids_grow_past_four_digits(spark):
    p = spark.createDataFrame([("USER-9999",), ("PRJ-0001",)], "project_id string")
    assert lifecycle.next_id(p) == "USER-10000"
    assert lifecycle.next_id(p.where("project_id = 'PRJ-0001'")) == "USER-0001"


def test_create_update_archive(store):
    p, _ = store
    p = lifecycle.created(p, {"project_name": "Mine", "state": "Goa"})
    own = p.where("project_id = 'USER-0001'").first()
    assert own["data_provenance"] == lifecycle.USER and not own["is_archived"]
    with pytest.raises(ValueError):
        lifecycle.created(p, {"project_id": "USER-0001"})
    p = lifecycle.updated(p, "USER-0001", {"contractor": None, "state": "Kerala"})
    assert p.where("project_id = 'USER-0001'").first()["state"] == "Kerala"
    with pytest.raises(ValueError):
        lifecycle.updated(p, "USER-0001", {"state": None})
    once = lifecycle.archived(p, "USER-0001")
    assert once.where("is_archived").count() == 1
    assert lifecycle.archived(once, "USER-0001", False).where("is_archived OR archived_at IS NOT NULL").count() == 0


def test_guards(spark, store):
    p, s = store
    p = lifecycle.created(p, {"project_name": "Mine", "state": "Goa"}).withColumn("planned_start_date", F.coalesce("planned_start_date", F.lit("2020-05-01").cast("date")))
    done = s.where("is_terminal_snapshot").first()
    mine = "USER-0001"
    cases = [
        (mine, "2020-06", "In Progress", None, None),
        (mine, "2020-04", "In Progress", None, "month before start"),
        (done["project_id"], "2031-01", "In Progress", None, "project has ended"),
        ("PRJ-404", "2020-06", "In Progress", None, "unknown project"),
        (mine, "2020-07", "Completed", None, "outcomes missing"),
        (mine, "2020-08", "In Progress", 5, "outcomes before the end"),
        (mine, "2020-09", "Completed", 5, None),
    ]
    schema = "project_id string, reporting_month string, project_status string, final_delay_days int, significant_delay int, final_cost_overrun_pct double, cost_overrun int, actual_physical_progress_pct double, planned_physical_progress_pct double"
    new = spark.createDataFrame([(i, m, st, o, o and 0, o and 1.0, o and 0, 10.0, 12.0) for i, m, st, o, _ in cases], schema)
    got = {(r["project_id"], r["reporting_month"]): r for r in lifecycle.judged_appends(new, s, p).collect()}
    assert {k: r["refused"] for k, r in got.items()} == {(i, m): w for i, m, _, _, w in cases}
    assert got[mine, "2020-06"]["physical_progress_variance_pct"] == -2.0 and got[mine, "2020-06"]["months_since_start"] == 1
    twice = new.limit(1).union(new.limit(1))
    assert sorted(str(r["refused"]) for r in lifecycle.judged_appends(twice, s, p).collect()) == ["None", "month exists"]


def test_reload_keeps_user_rows(spark, tmp_path):
    csv, folder = f"{tmp_path}/in", f"{tmp_path}/store"
    generate_panel(spark, 4, seed=3).write.option("header", True).csv(csv)
    first = tables.load(spark, csv, folder)
    assert first["reconciled"] and first["projects"] == 4
    mine = lifecycle.created(spark.read.parquet(f"{folder}/projects"), {"project_name": "Mine", "state": "Goa"}).where(F.col("data_provenance") == lifecycle.USER)
    tables.write_partition(mine, f"{folder}/projects")
    for _ in range(2):
        assert tables.load(spark, csv, folder)["reconciled"]
    assert spark.read.parquet(f"{folder}/projects").where(F.col("data_provenance") == lifecycle.USER).count() == 1
    with pytest.raises(ValueError, match="missing columns"):
        spark.range(3).write.option("header", True).csv(f"{tmp_path}/bad")
        tables.read_snapshots(spark, f"{tmp_path}/bad")
