"""Operators over DataFrames: batches, streams, crawls, sitemaps, changes, records, completions and SQL names."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions import sql
from tidemill.functions.urls import file_name, normalize, origin_key, registrable_domain, root_domain
from tidemill.functions.predicates import approx_tokens, glob_match, is_public_url, matches_fact
from tidemill.operators import changes, completions, crawl, extraction, records, reports
from tidemill.sources import sinks

PAGE = "<html><head><title>T</title></head><body><article><h1>T</h1><p>Some text of {}.</p><a href='/n'>next</a></article></body></html>"


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, v {kind}")
    return [r.out for r in df.select("k", make(F.col("v")).alias("out")).orderBy("k").collect()]


def test_urls(spark):
    given = ["https://example.com/page#section", "https://example.com/docs/", "https://Example.COM/Path", "https://u:p@e.com:443/", None]
    want = ["https://example.com/page", "https://example.com/docs", "https://example.com/Path", "https://e.com/", None]
    assert column(spark, given, normalize) == want
    assert column(spark, ["https://example.com:8443/foo", "https://www.e.com/"], origin_key) == ["https://example.com:8443", "https://e.com"]
    assert column(spark, ["https://blog.example.co.uk/", "https://deep.er.still.harbour.org/", "https://blog.abc.com/"], root_domain) == ["example.co.uk", "harbour.org", "blog.abc.com"]
    assert column(spark, ["blog.example.co.uk", "a.b.example.com"], registrable_domain) == ["example.co.uk", "example.com"]
    assert column(spark, ["https://e.com/a/../b?x=1", "https://www.e.com/"], lambda c: file_name(c, "md")) == ["a/b_x_1.md", "e_com/index.md"]


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [("/api/*", "/api/users", True), ("/api/*", "/api/users/1", False), ("/api/**", "/api/users/1", True), ("/nets/*/mended", "/nets/old/new/mended", False), ("/blog*", "/blog/post", False), ("", "", True), ("", "/", False), ("/a?", "/ab", True)],
)
def test_globs(spark, glob, path, want):
    assert column(spark, [path], lambda c: glob_match(c, glob)) == [want]


def test_public_addresses_and_facts(spark):
    assert column(spark, ["http://127.0.0.1/", "http://10.1.2.3/x", "http://[::1]/", "https://8.8.8.8/", "ftp://e.com/"], is_public_url) == [False, False, False, True, False]
    df = spark.createDataFrame([("the Rust book", "rust"), ("trusted", "rust"), ("a C++ book", "C++")], "t string, f string")
    assert [r.m for r in df.select(matches_fact(F.col("t"), F.col("f")).alias("m")).collect()] == [True, False, True]


def test_tokens_of_odd_texts(spark):
    assert column(spark, ["", None, "abcde", "文" * 5, "文文文" + "x" * 7], approx_tokens) == [0, None, 2, 3, 3]


def pages(spark):
    rows = [(1, "https://e.com/a", PAGE.format("one")), (2, "https://e.com/b", ""), (3, "not a url", PAGE.format("x")), (4, None, None), (5, None, PAGE.format("five"))]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"markdown": F.lit("clash"), "error": F.lit("clash")})


def test_failed_pages_are_rows(spark):
    rows = {r.page_id: r for r in extraction.extract_pages(pages(spark)).collect()}
    assert [rows[k].error_kind for k in range(1, 6)] == [None, "no_content", "invalid_url", "no_content", None]
    assert rows[1].metadata.title == "T" and "Some text of one." in rows[1].content.markdown and rows[1].error is None
    assert extraction.extract_pages(pages(spark).limit(0)).collect() == []
    counted = reports.counters(extraction.extract_pages(pages(spark), parts=("metadata", "content"))).first()
    assert (counted.total, counted.ok, counted.errors) == (5, 2, 3)
    lines = [json.loads(r.value) for r in sinks.batch_lines(extraction.extract_pages(pages(spark))).collect()]
    assert sum(x["ok"] for x in lines) == 2


def test_one_parse_serves_many_columns(spark):
    plan = extraction.extract_pages(pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_extraction_of_a_stream_equals_that_of_a_batch(spark, tmp_path):
    source = pages(spark).drop("markdown", "error").filter("page_id < 4")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    got = extraction.extract_pages(stream, parts=("content",)).select("page_id", "content.markdown", "error_kind")
    query = got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    query.trigger(availableNow=True).start().awaitTermination()
    want = extraction.extract_pages(source, parts=("content",)).select("page_id", "content.markdown", "error_kind")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def corpus(spark):
    link = {"/": ["/a", "/b", "/a#x", "https://other.com/"], "/a": ["/c", "/"], "/b": ["/missing", "/i.png"], "/c": ["/d"], "/d": []}
    rows = [(f"https://e.com{p}", [x if x.startswith("http") else f"https://e.com{x}" for x in to]) for p, to in link.items()]
    return spark.createDataFrame(rows, "url string, links array<string>")


def test_crawl(spark, tmp_path):
    paths = lambda df: sorted((r.url.removeprefix("https://e.com"), r.depth) for r in df.collect())
    got = crawl.crawl(corpus(spark), "https://e.com/", crawl.CrawlConfig(max_depth=2, max_pages=None))
    assert paths(got.pages) == [("/", 0), ("/a", 1), ("/b", 1), ("/c", 2), ("/missing", 2)] and got.counts == {"total": 5, "ok": 4, "errors": 1}
    first = crawl.crawl(corpus(spark), "https://e.com/", crawl.CrawlConfig(max_depth=3, max_pages=1))
    assert paths(first.pages) == [("/", 0)] and set(paths(first.frontier)) == {("/a", 1), ("/b", 1)}
    sinks.save_crawl(first, str(tmp_path / "state"))
    rest = crawl.crawl(corpus(spark), "https://e.com/", crawl.CrawlConfig(max_depth=3, max_pages=None), state=sinks.load_crawl(spark, str(tmp_path / "state")))
    assert paths(rest.pages) == [("/a", 1), ("/b", 1), ("/c", 2), ("/d", 3), ("/missing", 2)]
    seen = []
    last = crawl.crawl(corpus(spark), "https://e.com/", crawl.CrawlConfig(max_depth=3, max_pages=None), on_level=lambda df: seen.append(df.count()), keep_pages=False, cancelled=lambda: len(seen) == 2)
    assert seen == [1, 2] and last.pages.isEmpty() and last.counts["total"] == 3


def test_changes(spark):
    html = PAGE.format
    of = lambda *texts: changes.snapshot(extraction.extract_pages(spark.createDataFrame([(k, "https://e.com/", t) for k, t in enumerate(texts)], "id long, url string, html string"), parts=("metadata", "content")))
    rows = {r.id: r for r in changes.diff(of(html("a"), html("a"), html("a")), of(html("a"), html("b c d"), html("a").replace("<title>T", "<title>U")), "id").collect()}
    assert [rows[k].status for k in range(3)] == ["Same", "Changed", "Changed"]
    assert rows[0].text_diff is None and rows[1].word_count_delta == 2 and rows[2].text_diff is None and rows[2].metadata_changes[0].new == "U"


def test_records_and_their_kind_agree_with_the_python_patterns(spark):
    from test_functions import NONE, URLS

    given = [u for us in URLS.values() for u in us] + NONE + [None]
    want = [name for name, us in URLS.items() for _ in us] + [None] * (len(NONE) + 1)
    assert column(spark, given, records.kind) == want
    df = spark.createDataFrame([("https://crates.io/crates/c", '{"crate": {"id": "c"}}'), ("https://crates.io/crates/c", "x"), ("https://e.com/", "{}"), (None, None)], "url string, payload string")
    rows = records.records(df).collect()
    assert len(rows) == 2 and json.loads(next(r.record for r in rows if r.record))["name"] == "c" and any(r.error for r in rows)
    assert sum(r.error is not None for r in records.records(df, "crates_io").collect()) == 3


def test_completions(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "bad")], "k long, text string")

    def complete(request):
        if request.user == "bad":
            raise completions.CompletionError("down")
        return json.dumps({"n": len(request.user)})

    rows = {r.k: r for r in completions.extract_by_instruction(df, "text", "count", complete).collect()}
    assert rows[1].json == '{"n":3}' and rows[2].json == '{"n":0}' and rows[3].json is None and rows[3].error == "down"


def test_sql_names(spark):
    sql.register(spark)
    pages(spark).select("page_id", "url", "html").createOrReplaceTempView("p")
    rows = {r.page_id: r for r in spark.sql("select page_id, page_markdown(html, url) as md, llm_text(html, url) as t from p").collect()}
    assert "Some text of one." in rows[1].md and rows[1].t.startswith("> URL: ") and rows[2].md is None
    links = spark.sql("select p.page_id, l.* from p, lateral page_links(p.html) l where p.page_id in (1, 5)").collect()
    assert {(r.page_id, r.text, r.href) for r in links} == {(1, "next", "/n"), (5, "next", "/n")}


def test_only_small_inputs_are_spread(spark, monkeypatch):
    from tidemill.operators import batches

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    stored = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert "Exchange" in plan(batches.spread(stored))
    monkeypatch.setattr(batches, "SMALL_TASK", 1)
    assert "Exchange" not in plan(batches.spread(stored))


def test_filters_and_columns_reach_the_scan(spark):
    stored = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").filter("page_id < 5")
    plan = extraction.extract_pages(stored, parts=("metadata",)).select("page_id", "metadata.title")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(page_id,5)" in plan
    words = stored.select("page_id", normalize(F.col("url")).alias("url"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in words


def test_facts_of_all_texts_equal_the_keyed_rule(spark, monkeypatch):
    facts = ["rust", "C++", "the book", "Ärger", "", None, "rust", "a1", "he"]
    texts = [(1, "Trust the Book, not rust."), (2, "c++ and ärger"), (3, None), (4, ""), (5, "a1b a1"), (6, "the hero"), (6, "he")]
    t, f = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame([(x,) for x in facts], "fact string")
    got = {r.k: (r.found, r.total) for r in reports.fact_hits(t, f, "k").collect()}
    keyed = t.select("k").distinct().crossJoin(f)
    want = {r.k: (r.found, r.total) for r in reports.fact_hits(t, keyed, "k").collect()}
    assert got == want and want[1] == (3, 9) and want[6] == (1, 18)
    monkeypatch.setattr(reports, "BROADCAST_BYTES", 20)
    assert {r.k: (r.found, r.total) for r in reports.fact_hits(t, f, "k").collect()} == want
    assert reports.fact_hits(t, f.limit(0), "k").collect() == []
    plan = reports.fact_hits(t, f, "k")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_crawls_of_many_sites_equal_a_walk(spark):
    rng = __import__("random").Random(3)
    pages = [f"https://s{h}.com/p{n}" for h in range(4) for n in range(12)]
    links = {p: rng.sample(pages, 3) + [f"{p}#x", f"{p.rsplit('/', 1)[0]}/lost{rng.randint(0, 3)}"] for p in pages}
    corpus_ = spark.createDataFrame([(p, to) for p, to in links.items()], "url string, links array<string>")
    seeds = spark.createDataFrame([("https://s0.com/p0",), ("https://s1.com/p5",), ("https://gone.com/x",)], "seed string")
    want = set()
    for seed in ("https://s0.com/p0", "https://s1.com/p5", "https://gone.com/x"):
        seen, level, depth = {seed}, [seed], 0
        while level:
            want |= {(seed, p, depth, p in links) for p in level}
            host = seed.split("/")[2]
            level = sorted({x.partition("#")[0] for p in level for x in links.get(p, ()) if x.split("/")[2] == host} - seen)
            seen |= set(level)
            depth += 1
    got = {tuple(r) for r in crawl.crawl_sites(corpus_, seeds, crawl.CrawlConfig(max_depth=-1, max_pages=None)).select("seed", "url", "depth", "ok").collect()}
    assert got == want
    near = crawl.crawl_sites(corpus_, seeds, crawl.CrawlConfig(max_depth=1, max_pages=None)).select("seed", "url", "depth", "ok").collect()
    assert {tuple(r) for r in near} == {w for w in want if w[2] <= 1}


def test_sitemap_order_survives(spark):
    sitemap = spark.createDataFrame([(f"https://e.com/p{k:02}", 100 - k) for k in range(12)], "url string, seq long")
    got = crawl.crawl(corpus(spark).limit(0), "https://e.com/", crawl.CrawlConfig(max_depth=0, max_pages=5), sitemap=sitemap.repartition(4))
    assert {r.url for r in got.pages.collect()} == {"https://e.com/", *(f"https://e.com/p{k:02}" for k in (8, 9, 10, 11))}


def test_rows_are_spread_before_anything_is_made_of_them(spark):
    """A single file of customers is made into pages, replies and documents over all cores, and made texts are not moved."""
    from tidemill.plans import case_queries, made_queries

    some = {**case_queries.QUERIES, **made_queries.QUERIES}
    for name in ("vx_reddit", "md_plain", "xlsx_documents", "completion_failures"):
        plan = some[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        moved = plan.split("REPARTITION_BY_NUM")
        assert len(moved) == 2 and "MapInArrow" not in moved[1] and "Paragraph" not in moved[1] and "<html>" not in moved[1], name


def test_records_of_a_small_input_are_read_over_all_cores(spark, tmp_path):
    spark.createDataFrame([(f"https://pypi.org/project/p{k}/", "{}") for k in range(8)], "url string, payload string").coalesce(1).write.parquet(f"{tmp_path}/r")
    assert records.records(spark.read.parquet(f"{tmp_path}/r")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_filters_on_what_is_made_of_rows_run_after_they_are_spread(spark):
    from tidemill.plans import made_queries

    plan = made_queries.QUERIES["body_ceiling"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[plan.index("Repartition") :] and "octet_length" in plan


MADE_OVER_ALL_CORES = (
    "vx_crates_io",
    "vx_ecommerce_product",
    "vx_arxiv",
    "vx_chronopost",
    "vx_shopify_product",
    "vx_huggingface_model",
    "ext_only_main",
    "ext_noise_forms",
    "md_links",
    "json_ld",
)


@pytest.mark.parametrize("name", MADE_OVER_ALL_CORES)
def test_one_file_of_customers_is_read_by_all_cores(spark, name):
    from tidemill.plans import case_queries

    made = case_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    above, below = made._jdf.queryExecution().optimizedPlan().toString().split("Repartition ")
    assert "MapInArrow" in above and "MapInArrow" not in below
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_pages_of_a_stream_are_made_by_all_cores(spark, monkeypatch):
    from tidemill.plans import made_queries

    kept, saved = [], made_queries.saved
    monkeypatch.setattr(made_queries, "saved", lambda df, name: kept.append(saved(df, name)) or kept[-1])
    got = made_queries.QUERIES["batch_stream"](spark, "/root/testdata/sf0.001")
    assert len(kept[0].inputFiles()) == spark.sparkContext.defaultParallelism and got.count() == kept[0].count() > 0
