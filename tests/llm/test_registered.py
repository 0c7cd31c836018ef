"""Registered queries: whole tables, SQL counterparts, URL rules and the pipeline."""

from pathlib import Path

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from fleetledger.llm import host_reputation
from fleetledger.llm.queries import QUERIES, RULES

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not supplied")


@needs_tables
@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_and_its_sql(spark, name):
    query, sql = QUERIES[name]
    assert differences(spark, connect(FOLDER), FOLDER, query, sql) is None


@needs_tables
@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_query_covers_its_table(spark, name):
    got = QUERIES[name][0](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    if name.startswith("op12"):
        words = got.collect()
        assert 0 < len(words) == len({r.word for r in words}) and all(r.n >= 3 for r in words)
    elif name.startswith("op13"):
        last = got.groupBy("doc_id").agg(F.max(F.col("start") + F.col("length")).alias("n"))
        counts = QUERIES["op9_forced_boundary_bpe"][0](spark, FOLDER).select("doc_id", (F.col("n_tokens") + 1).alias("n"))
        assert last.exceptAll(counts).count() == 0 == counts.exceptAll(last).count()
    elif name.startswith("op5"):
        assert got.join(docs, "doc_id", "left_anti").count() == 0 < got.count()
    else:
        assert got.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0 and got.count() == docs.count()


def test_urls(spark):
    urls = [None, "no scheme", "HTTP://A.Example.ORG", "http://a.example.org/es/1?x", "http://example.org/en/12#a/b", "https://xexample.org/es/1", "http://sub.b.com/de/?q#f", "http://b.com?x/de/", "a://b://c/d", "http:///p", "http://example.org/en/2"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h"), (None, urls[3], "h")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge_urls(pages, RULES).collect()}
    assert got[0][:3] == got[1][:3] == ("", "", None)
    assert got[2][:3] == ("a.example.org", "", None)
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5] == ("xexample.org", "/es/1", "org/", "allow") and got[6] == ("sub.b.com", "/de/", "com/de/", "block")
    assert got[7][:3] == ("b.com", "", None) and got[8][:3] == ("b:", "//c/d", None) and got[9][:3] == ("", "/p", None) and got[10][3] == "allow"
    assert host_reputation.judge_urls(pages, RULES).count() == 13 and host_reputation.judge_urls(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in host_reputation.judge_urls(pages, {}).collect()} == {"allow"}


def test_reputation_shrinks_towards_domain_and_suffix(spark):
    rows = [("bad.x.com", 1)] * 50 + [("good.x.com", 0)] * 50 + [("new.x.com", None)] + [("y.net", 1)] * 40 + [("z.y.net", 1)] + [("lone.org", 1)] + [(f"h{i}.org", 0) for i in range(30)]
    got = {r.host: r for r in host_reputation.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.x.com"].blocked and not got["good.x.com"].blocked and not got["new.x.com"].blocked
    assert got["y.net"].blocked and not got["lone.org"].blocked
    assert got["z.y.net"].bound > got["lone.org"].bound  # one bad page each; the domain decides
    # One page in twenty is bad: a host with a third of bad ones is blocked, far below one half; a host like the others is not.
    rows = [(f"h{i % 40}.a.net", int(i % 20 == i // 200 % 20)) for i in range(4000)] + [("worse.a.net", int(i % 3 == 0)) for i in range(120)]
    got = {r.host: r for r in host_reputation.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["worse.a.net"].blocked and got["worse.a.net"].bound < 0.4 and sum(r.blocked for r in got.values()) == 1
    domain = lambda h: spark.range(1).select(host_reputation.registered_domain(F.lit(h))).first()[0]
    assert [domain(h) for h in ("a.b.co.uk", "co.uk", "x.y.com", "com", "", "a.b.gov.uk", "www.x.com.cn", "a.b.ne.jp", "a.com.museum")] == ["b.co.uk", "co.uk", "y.com", "com", "", "b.gov.uk", "x.com.cn", "b.ne.jp", "com.museum"]

    sizes = Path(FOLDER).parent / "sf0.1"
    if sizes.exists():  # the verdict of the method is not the same for all pages
        verdicts = QUERIES["op4_host_reputation"][0](spark, str(sizes)).where("rule is null").groupBy("verdict").count().collect()
        assert {r.verdict for r in verdicts} == {"allow", "block"}


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stage = dict(pipeline.STAGES)
    kept = stage["quality_rules"](spark, docs, FOLDER)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and not any(labels.get(i) == 0 for i in left)
    twice = docs.limit(20).unionByName(docs.limit(20).withColumn("doc_id", F.col("doc_id") + 1000))
    for name in ("line_dedup", "near_dedup"):
        got = stage[name](spark, twice, FOLDER)
        assert got.columns == docs.columns and not {r.doc_id for r in got.collect()} & set(range(1000, 1020)) - {1000 + r.doc_id for r in docs.limit(20).where("n_chars < 30").collect()}
    clean = stage["decontamination"](spark, docs, FOLDER)
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert {r.doc_id for r in docs.collect() if not any(t in r.text for t in items)} == {r.doc_id for r in clean.collect()}
    result = pipeline.run(spark, FOLDER)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < result.count() < docs.count()
    nothing = docs.limit(0)
    for _, f in pipeline.STAGES:
        assert f(spark, nothing, FOLDER).count() == 0
