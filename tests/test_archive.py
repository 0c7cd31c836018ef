from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetledger.operators import archive as A
from fleetledger.sources.event_text import read_events
from fleetledger.sources.segments import segments
from fleetledger.streaming.ingest import ingest_stream

NOW = "2024-03-01 12:00:00"
SCHEMA = "source string, name string, seq long, mtime timestamp, bytes long"


def inventory(spark, names, age=timedelta(days=1)):
    when = datetime.fromisoformat(NOW) - age
    rows = [(s, n, int(n.split(".")[1]), when, 10) for s, n in names]
    return spark.createDataFrame(rows, SCHEMA)


def test_retention_counts_whole_days(spark):
    for age, kept in [(timedelta(days=30, hours=23), 1), (timedelta(days=31), 0), (timedelta(days=31, seconds=-1), 1)]:
        segs = inventory(spark, [("a", "bin.000001")], age)
        assert A.retain(segs, 30, NOW, "bin").count() == kept
        assert A.expired(segs, 30, NOW, "bin").count() == 1 - kept
        assert A.retain(segs, 30, NOW, "other").count() == 1


def test_finished_segments(spark):
    segs = inventory(
        spark,
        [("a", "bin.000001.xz"), ("a", "bin.000002"), ("a", "bin.000003"), ("a", "other.000001"), ("b", "bin.000009"), ("b", "bin.000010")],
    )
    assert sorted((r.source, r.name) for r in A.finished(segs, "bin.").collect()) == [("a", "bin.000002"), ("b", "bin.000009")]


def test_resume_point(spark):
    segs = inventory(spark, [("a", "bin.000009"), ("a", "bin.000010"), ("b", "bin.000001.xz")])
    reported = spark.createDataFrame([("a", "bin.000001"), ("c", "bin.000077")], "source string, name string")
    rows = {r.source: r.name for r in A.last_segment(segs, reported).collect()}
    assert rows == {"a": "bin.000010", "b": "bin.000001.xz", "c": "bin.000077"}
    assert A.last_segment(segs).count() == 2


def write_segment(folder, number, positions):
    body = "".join(f"# at {p}\n#170921 20:28:37 server id 1  end_log_pos {p} \tX\npayload {p}\n" for p in positions)
    (folder / f"bin.{number:06d}").write_text(body)


def test_inventory_and_compaction_keep_every_event(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    for n in (1, 2, 3):
        write_segment(source, n, range(n * 10 + 1, n * 10 + 5))
    (source / "else.000001").write_text("# at 1\n")
    segs = segments(spark, str(source), "bin")
    assert sorted((r.source, r.name, r.seq) for r in segs.collect()) == [("src", f"bin.{n:06d}", n) for n in (1, 2, 3)]
    events = read_events(spark, str(source)).withColumn("source", F.lit("src"))
    A.compact(events, segs, str(tmp_path / "archive"), "bin")
    back = A.read_archive(spark, str(tmp_path / "archive"))
    assert back.where("file_no is null").count() == 0
    A.compact(events.where("false"), segs, str(tmp_path / "archive"), "bin", A.archived_segments(spark, str(tmp_path / "archive")))
    assert {r.file for r in back.select("file").distinct().collect()} == {"bin.000001", "bin.000002"}
    old = events.where("file in ('bin.000001','bin.000002')").select("file", "pos", "record")
    assert old.exceptAll(back.select("file", "pos", "record")).count() == 0
    assert back.count() == 8


def test_ingest_resumes_after_the_segments_already_taken(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    write_segment(source, 1, [1, 2])
    write_segment(source, 2, [3])
    ingest_stream(spark, str(source), out, mark).awaitTermination()
    first = spark.read.parquet(out)
    assert first.count() == 3
    write_segment(source, 3, [7, 8])
    ingest_stream(spark, str(source), out, mark).awaitTermination()
    both = spark.read.parquet(out)
    assert both.where("file = 'bin.000003'").count() == 2
    batch = read_events(spark, str(source))
    assert both.count() == batch.count() == 5
    assert batch.select("file", "pos", "record").exceptAll(both.select("file", "pos", "record")).count() == 0


def test_folders_of_equal_last_names_are_different_sources(spark, tmp_path):
    for centre, numbers in (("dc1", (1, 2, 3)), ("dc2", (1, 2))):
        (tmp_path / centre / "binlog").mkdir(parents=True)
        for n in numbers:
            write_segment(tmp_path / centre / "binlog", n, [4])
    found = segments(spark, str(tmp_path), "bin", recursive=True)
    assert sorted((r.source, r.name) for r in A.last_segment(found).collect()) == [("dc1/binlog", "bin.000003"), ("dc2/binlog", "bin.000002")]
    assert A.finished(found, "bin").count() == 3
