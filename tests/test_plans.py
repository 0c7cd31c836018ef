"""Shape of the physical plans: what must hold at any size."""

import re
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetledger.functions.ids import snowflake_floor
from fleetledger.operators import changelog as C
from fleetledger.operators import links as L
from fleetledger.operators import rollout as R
from fleetledger.plans.registry import registered

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not supplied")
# These run jobs while they are built; their parts are looked at elsewhere.
EAGER = re.compile("stream|archive_rewrite|archive_segments|links_rank|links_reconcile|links_alerts|log_events|log_parse|log_sql|log_catalog|rollout_o")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
@pytest.mark.parametrize("name", sorted(n for n in registered() if not EAGER.search(n)))
def test_no_pairing_of_all_rows(spark, name):
    plan = plan_of(registered()[name][0](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@needs_tables
@pytest.mark.parametrize("name", ["links_best", "links_leader", "links_dup", "links_led", "log_replay", "archive_compact", "archive_resume"])
def test_groups_are_combined_before_the_shuffle(spark, name):
    plan = plan_of(registered()[name][0](spark, FOLDER))
    assert "partial_" in plan and "Window" not in plan


def test_only_bounded_windows_are_global(spark):
    shards = spark.range(10).selectExpr(
        "id as shardId", "'s' as schemaName", "'d' as shardDSN", "0 as version", "cast(null as string) as taskName",
        "cast(null as timestamp) as lastTaskHb", "timestamp'2024-01-01' as lastUpdate",
    )
    versions = spark.range(1, 5).selectExpr("id as version", "'c' as command", "'sql' as cmdType", "'t' as tableName")
    picked = plan_of(R.shards_to_upgrade(shards, versions, 3))
    assert "TakeOrderedAndProject(limit=3" in picked and "Window" not in picked
    claim = plan_of(R.claim(shards, versions, "t", datetime(2024, 1, 1), 3, 5))
    assert "TakeOrderedAndProject(limit=5" in claim


def test_shards_at_one_version_are_many_keys(spark):
    shards = spark.range(200).selectExpr("id as shardId", "'s' as schemaName", "'u:p@tcp(h:1)' as shardDSN", "cast(id % 1 as int) as version")
    versions = spark.range(1, 4).selectExpr("id as version", "'c' as command", "'sql' as cmdType", "'t' as tableName")
    plan = R.migration_plan(shards, versions)
    joined = [line for line in plan_of(plan).splitlines() if "Join" in line and "_from" in line]
    assert joined and all("_copy" in line for line in joined)
    assert plan.count() == 600 and plan.select("shardId", "step").distinct().count() == 600


def test_a_small_change_set_leaves_the_base_where_it_is(spark):
    base = spark.range(1000).selectExpr("id", "'old' as v")
    changes = spark.range(3).selectExpr("1L as file_no", "id as pos", "0 as row_no", "'UPDATE' as op", "struct(id, 'old' as v) as before", "struct(id, 'new' as v) as after")
    result = C.apply_changes(base, changes, ["id"])
    plan = plan_of(result)
    before_join = plan[plan.index("LeftAnti"):] if "LeftAnti" in plan else ""
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "Exchange hashpartitioning(id" not in before_join.split("BroadcastExchange")[0]
    assert sorted(r.v for r in result.collect())[:3] == ["new"] * 3 and result.count() == 1000


def test_time_tests_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr(
        "id as shardId", "'t' as taskName", "timestamp_seconds(id) as lastTaskHb", "id as sid", "'c' as connectionName",
        "cast(id as string) as host", "'Yes' as isSlave", "timestamp_seconds(id) as lastHeartbeat",
    ).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    table = spark.read.parquet(path)
    now = datetime(2024, 1, 1)
    assert "LessThan(lastTaskHb," in plan_of(R.stalled(table, now, 60))
    assert "GreaterThanOrEqual(lastHeartbeat," in plan_of(L.duplicate_leaders(table, now))
    assert "GreaterThanOrEqual(sid," in plan_of(table.where(F.col("sid") >= snowflake_floor(F.lit(now))))
    scan = plan_of(L.links_led(table))
    assert "ReadSchema: struct<host:string,isSlave:string>" in scan


@needs_tables
def test_operators_behind_queries_that_run_jobs(spark, tmp_path):
    """The operators of the queries that are left out above, on input that needs no job."""
    from fleetledger.operators import archive as A
    from fleetledger.plans.event_rendering import order_dump, order_log
    from fleetledger.sources.ddl_text import schema_catalog
    from fleetledger.sources.event_text import read_events

    events, catalog = order_log(spark, FOLDER), schema_catalog(order_dump(spark, FOLDER))
    (tmp_path / "bin.000001").write_text("# at 4\n#170921 20:28:37 server id 1  end_log_pos 9 \tQuery\n")
    frames = {
        "script": C.statements(events, catalog),
        "script of a small catalog": C.statements(events, catalog, small_catalog=True),
        "rejoined": read_events(spark, str(tmp_path), rejoin=True),
        "to archive": A.finished(spark.range(1).selectExpr("concat('s', id) as source", "concat('bin.', id) as name", "id as seq")),
        "best": L.best_candidates(spark.range(1).selectExpr(
            "concat('h', id) as host", "0 as weight", "0 as localIndex", "'Yes' as isSlave", "timestamp'2024-01-01' as lastUpdate",
            "timestamp'2024-01-01' as lastHeartbeat", "concat('c', id) as connectionName"), datetime(2024, 1, 1)),
    }
    for name, frame in frames.items():
        plan = plan_of(frame)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "EvalPython" not in plan, name
    assert plan_of(frames["script"]).count("FileScan parquet") == 2  # the events are read once, and the catalog
    assert "BroadcastHashJoin" in plan_of(frames["script of a small catalog"])


def test_changes_of_one_table_are_many_keys(spark):
    """With a catalog that is not broadcast, and with one that is."""
    one = spark.range(64).selectExpr("'f' as file", "1L as file_no", "id as pos", "0 as row_no", "'INSERT' as op", "'d' as db", "'t' as table",
                                     "'INSERT INTO `d`.`t`\n### SET\n###   @1=1' as block", "true as valid")
    catalog = spark.createDataFrame([("d", "t", 1, "id")], "db string, `table` string, ordinal int, `column` string")
    found = C.resolve_columns(C.row_images(one), catalog)
    assert found.where("rejected is null and after[0].column = 'id'").count() == 64
    spread = [line for line in plan_of(C.resolve_columns(C.row_images(one), catalog)).splitlines() if "SortMergeJoin" in line]
    assert spread and all("_copy" in line for line in spread)
    assert "BroadcastHashJoin" in plan_of(C.resolve_columns(C.row_images(one), catalog, small=True))
