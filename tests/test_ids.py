import pytest
from pyspark.sql import functions as F

from fleetledger.functions.ids import create_sql_functions, snowflake, snowflake_floor, snowflake_parts
from fleetledger.operators.ids import with_bulk_snowflake_id, with_snowflake_id
from fleetledger.operators.sequence import number_within


@pytest.mark.parametrize(
    "ts, machine, seq, expected",
    [
        ("2024-05-31 20:10:39.373", 1, 11, 1796635423003381771),
        ("2010-11-04 01:42:54.657", 0, 0, 0),
        ("2010-11-04 01:42:54.657", None, 0, 4096),
        ("2010-11-04 01:42:54.658", 1025, 0, 4198400),
        ("2010-11-04 01:42:54.657", -1, 0, 4190208),
        ("2010-11-04 01:42:54.657499", 0, 0, 0),
        ("2010-11-04 01:42:54.657500", 0, 0, 4194304),
    ],
)
def test_documented_values(spark, ts, machine, seq, expected):
    df = spark.createDataFrame([(ts, machine, seq)], "t string, m long, s int")
    row = df.select(snowflake(F.col("t").cast("timestamp"), F.col("m"), F.col("s")).alias("id")).first()
    assert row.id == expected


def test_parts_invert_compose(spark):
    df = spark.range(5000).select(
        F.timestamp_millis(F.lit(1700000000000) + F.col("id") * 977).alias("ts"),
        (F.col("id") * 7).alias("m"),
        (F.col("id") * 13 % 4096).alias("s"),
    )
    parts = df.select("ts", "m", "s", snowflake_parts(snowflake(F.col("ts"), F.col("m"), F.col("s"))).alias("p"))
    wrong = parts.where(
        (F.col("p.ts") != F.col("ts")) | (F.col("p.machine") != F.col("m") % 1024) | (F.col("p.seq") != F.col("s"))
    )
    assert wrong.count() == 0
    floor = df.where(snowflake_floor(F.col("ts")) > snowflake(F.col("ts"), F.col("m"), F.col("s")))
    assert floor.count() == 0


def test_event_time_ids_are_unique_and_full_millisecond_fits(spark):
    df = spark.range(8192).select("id", F.lit("2024-01-01").cast("timestamp").alias("ts"), (F.col("id") % 2).alias("m"))
    out = with_snowflake_id(df, F.col("ts"), F.col("m"), [F.col("id")], "sid")
    assert out.select("sid").distinct().count() == 8192


def test_overfull_millisecond_is_an_error(spark):
    df = spark.range(4097).select("id", F.lit("2024-01-01").cast("timestamp").alias("ts"))
    with pytest.raises(Exception, match="more than 4096"):
        with_snowflake_id(df, F.col("ts"), 1, [F.col("id")], "sid").agg(F.max("sid")).collect()
    with pytest.raises(Exception, match="more than 4096"):
        with_snowflake_id(spark.range(10_000).withColumn("ts", F.lit("2024-01-01").cast("timestamp")), F.col("ts"), 1, [F.col("id")]).count()


def test_sequence_numbers_do_not_wrap(spark):
    ts = F.lit("2024-01-01").cast("timestamp")
    for number in (-1, 4096):
        with pytest.raises(Exception, match="is not in 0..4095"):
            spark.range(1).select(snowflake(ts, 1, number)).collect()
    assert spark.range(1).select(snowflake(ts, 1, F.lit(None))).first()[0] is None


def test_bulk_ids_are_unique_across_many_partitions(spark):
    df = spark.range(0, 30000, 1, 1500)
    out = with_bulk_snowflake_id(df, 1700000000000, "sid")
    assert out.select("sid").distinct().count() == 30000
    big = with_bulk_snowflake_id(spark.range(0, 20000, 1, 3), 1700000000000, "sid")
    assert big.select("sid").distinct().count() == 20000


@pytest.mark.parametrize("sliced", [True, False])
def test_number_within_matches_brute_force_on_a_hot_group(spark, sliced):
    rows = [("hot" if i % 3 else f"k{i % 11}", (i * 7919) % 500, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, t long, n long")
    order = [F.col("t").desc(), F.col("n").asc()]
    out = number_within(df, ["k"], order, "pos", slice_by=-F.floor(F.col("t") / 50) if sliced else None)
    expected = {}
    for key in {r[0] for r in rows}:
        for pos, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            expected[r[2]] = pos
    assert {r.n: r.pos for r in out.collect()} == expected


def test_sql_function_equals_the_column_form(spark):
    create_sql_functions(spark)
    rows = spark.range(2000).selectExpr("timestamp_micros(1700000000000000 + id * 1234567) as ts", "nullif(id - 1000, 5) as m", "id * 2 as s")
    both = rows.select(
        snowflake(F.col("ts"), F.col("m"), F.col("s")).alias("a"), F.expr("snowflake_id(ts, m, s)").alias("b"),
        snowflake(F.col("ts")).alias("c"), F.expr("snowflake_id(ts)").alias("d"),
    )
    assert both.where("a <> b or c <> d").count() == 0
