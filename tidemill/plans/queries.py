"""Registered queries of the extraction and crawl operators, with SQL for those that SQL can express.

Where the given tables lack what an operator reads, such as robots files, it is made from whole tables by the same
expressions on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.functions import predicates, urls
from tidemill.functions.urls import PATTERN
from tidemill.operators import changes, completions, crawl, extraction, records, reports, site
from tidemill.plans.tables import saved, shared_folder
from tidemill.sources import documents, scans, sinks
from tidemill.streaming.watch import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


_P = PATTERN.replace("'", "''")
_HOST = f"lower(regexp_extract(url, '{_P}', 2))"
_SCHEME = f"lower(regexp_extract(url, '{_P}', 1))"
_PATH = f"regexp_extract(url, '{_P}', 4)"
_QUERY = f"regexp_extract(url, '{_P}', 5)"
_PORT = f"(case when regexp_extract(url, '{_P}', 3) in ('', '80', '443') then '' else ':' || regexp_extract(url, '{_P}', 3) end)"
_BARE = f"regexp_replace({_HOST}, '^www\\.', '')"
_NORMAL = f"""({_SCHEME} || '://' || {_HOST} || {_PORT} ||
    case when {_PATH} = '' then '/' when length({_PATH}) > 1 and {_PATH} like '%/' then left({_PATH}, length({_PATH}) - 1) else {_PATH} end || {_QUERY})"""


def _tail(host: str, n: int) -> str:
    return f"array_to_string(list_slice(string_split({host}, '.'), -{n}, -1), '.')"


def _likes(column: str, marks: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, '{m}')" for m in marks) + ")"


def _kinds() -> str:
    from tidemill.functions.page import SOURCE_KINDS, URL_KINDS

    rules = [(_likes("lower(url)", m), k) for k, m in URL_KINDS] + [(_likes("lower(html)", m), k) for k, m in SOURCE_KINDS]
    return "case " + " ".join(f"when {c} then '{k}'" for c, k in rules) + " else 'generic' end"


# URLs


@query(f"select page_id, {_kinds()} as domain_type from pages")
def domain_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", predicates.domain_type(F.col("url"), F.col("html")).alias("domain_type"))


@query(f"select page_id, {_NORMAL} as normalized from pages")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.normalize(F.col("url")).alias("normalized"))


@query(f"select page_id, {_HOST} as host, {_SCHEME} || '://' || {_BARE} || {_PORT} as origin_key from pages")
def url_origin_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.origin_key(F.col("url")).alias("origin_key"))


@query(
    f"""select page_id, case when len(string_split({_BARE}, '.')) <= 2 then {_BARE}
    when length(string_split({_BARE}, '.')[-2]) <= 3 then {_tail(_BARE, 3)} else {_tail(_BARE, 2)} end as root_domain from pages"""
)
def url_root_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.root_domain(F.col("url")).alias("root_domain"))


@query(
    f"""select page_id, case when len(string_split({_HOST}, '.')) >= 3 and {_tail(_HOST, 2)} in ({", ".join(f"'{s}'" for s in urls.SUFFIXES)})
    then {_tail(_HOST, 3)} else {_tail(_HOST, 2)} end as registrable_domain from pages"""
)
def registrable_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.registrable_domain(urls.host(F.col("url"))).alias("registrable_domain"))


_TLDS = tuple("com de fr uk jp br se tw mx at".split())
_LANGUAGE = " ".join(f"when tld in ({', '.join(repr(t) for t in tlds.split())}) then '{lang}'" for lang, tlds in urls.LANGUAGES.items())


@query(
    f"""with t as (select page_id, (['{"', '".join(_TLDS)}'])[1 + page_id % {len(_TLDS)}] as tld from pages)
    select page_id, tld, case {_LANGUAGE} else '{urls.DEFAULT_LANGUAGE}' end as accept_language from t"""
)
def accept_language(spark: SparkSession, d: str) -> DataFrame:
    tld = F.element_at(F.array(*map(F.lit, _TLDS)), (F.col("page_id") % len(_TLDS)).cast("int") + 1)
    rows = table(spark, d, "pages").select("page_id", "url", tld.alias("tld"))
    moved = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url")), F.lit("."), "tld", urls.path(F.col("url")))
    return rows.select("page_id", "tld", urls.accept_language(moved).alias("accept_language"))


@query(f"select page_id, {_SCHEME} || '://' || {_HOST} || {_PORT} || '/' as homepage from pages")
def homepage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.homepage(F.col("url")).alias("homepage"))


@query(
    f"""select page_id, regexp_replace(case when ltrim({_PATH}, '/') = '' then replace({_BARE}, '.', '_') || '/index' else
    array_to_string(list_filter(string_split({_PATH}, '/'), lambda x: x not in ('', '.', '..')), '/') end || regexp_replace({_QUERY}, '^\\?', '_'),
    '[^\\p{{L}}\\p{{N}}\\-_./]', '_', 'g') || '.md' as out_path from pages"""
)
def file_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.file_name(F.col("url"), "md").alias("out_path"))


@query("select page_id, rtrim(url) like '%&' or (contains(url, '?') and not contains(regexp_extract(url, '\\?([^#]*)', 1), '=')) as truncated from pages")
def looks_truncated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.looks_truncated(F.col("url")).alias("truncated"))


@query(
    f"""select page_id, regexp_matches({_PATH}, '^/en/[^/]*$') as segment, regexp_matches({_PATH}, '^/en/.*') as across,
    regexp_matches({_PATH}, '^/../1[^/]*$') as single from pages"""
)
def glob_filters(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", PATTERN, 4)
    globs = {"segment": "/en/*", "across": "/en/**", "single": "/??/1*"}
    return table(spark, d, "pages").select("page_id", *(predicates.glob_match(path, g).alias(n) for n, g in globs.items()))


@query(
    """with a as (select c_custkey, (c_custkey * 37) % 256 as a, (c_custkey * 11) % 256 as b, (c_custkey * 5) % 256 as c from customer)
    select c_custkey, a in (0, 10, 127) or a >= 224 or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168)
    or (a = 100 and b between 64 and 127) or (a = 192 and b = 0 and c in (0, 2)) or (a = 198 and b between 18 and 19)
    or (a = 198 and b = 51 and c = 100) or (a = 203 and b = 0 and c = 113) as blocked from a"""
)
def public_ip_guard(spark: SparkSession, d: str) -> DataFrame:
    octet = lambda n: ((F.col("c_custkey") * n) % 256).cast("string")
    address = F.concat_ws(".", octet(37), octet(11), octet(5), F.lit("9"))
    return table(spark, d, "customer").select("c_custkey", predicates.is_blocked_ipv4(address).alias("blocked"))


_ROOT = f"""(case when len(string_split({_BARE}, '.')) <= 2 then {_BARE}
    when length(string_split({_BARE}, '.')[-2]) <= 3 then {_tail(_BARE, 3)} else {_tail(_BARE, 2)} end)"""


@query(
    f"""with p as (select page_id, url, {_ROOT} as root, {_SCHEME} || '://' || {_BARE} || {_PORT} as origin, {_PATH} as path from pages),
    s as (select root, min_by(origin, page_id) as seed from p group by root)
    select page_id, origin = seed as same, true as below, path like '/en/%' as prefixed, origin = seed and not regexp_matches(path, '^/../1[^/]*$') as filtered from p join s using (root)"""
)
def crawl_scope(spark: SparkSession, d: str) -> DataFrame:
    """Every page against the first page of its root domain as seed, in four kinds of scope."""
    pages = table(spark, d, "pages").withColumn("root", urls.root_domain(F.col("url")))
    seeds = pages.groupBy("root").agg(F.min_by(urls.homepage(F.col("url")), "page_id").alias("seed"))
    scope = lambda **kind: predicates.in_crawl_scope(F.col("url"), F.col("seed"), **kind)
    kinds = {"same": {}, "below": {"subdomains": True}, "prefixed": {"external": True, "prefix": "/en/"}, "filtered": {"include": ("/**",), "exclude": ("/??/1*",)}}
    return pages.join(seeds, "root").select("page_id", *(scope(**kind).alias(name) for name, kind in kinds.items()))


# pages


@query(
    """select page_id, nullif(trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '') as title,
    nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') as language from pages"""
)
def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    return extraction.metadata_only(table(spark, d, "pages")).select("page_id", "metadata.title", "metadata.language")


@query(
    """with a as (select page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as h,
    regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as t from pages),
    n as (select page_id, h, t, unnest(range(len(h))) as k from a)
    select page_id, k::int as pos, h[k + 1] as href, t[k + 1] as text from n"""
)
def anchor_links(spark: SparkSession, d: str) -> DataFrame:
    return reports.anchors(table(spark, d, "pages"), "page_id")


@query(
    """with t as (select page_id, lower(html) as h, octet_length(encode(html)) as n from pages) select page_id,
    (contains(h, 'just a moment') or contains(h, 'checking your browser')) and contains(h, 'cf-spinner') or contains(h, '_cf_chl_opt') as blocked,
    n between 1 and 15000 and contains(h, '<title>challenge page</title>') as challenge from t"""
)
def bot_protected(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", predicates.is_bot_protected(html).alias("blocked"), predicates.is_challenge(html).alias("challenge"))


@query(
    """select page_id, words < 50 and size > 5000 as needs_js from (select page_id, octet_length(encode(html)) as size, contains(html, '<script') as s,
    len(list_filter(regexp_split_to_array(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+'), lambda x: x <> '')) as words from pages)"""
)
def needs_js(spark: SparkSession, d: str) -> DataFrame:
    words = predicates.word_count(F.regexp_replace("html", "<[^>]*>", " "))
    return table(spark, d, "pages").select("page_id", predicates.needs_js(words, F.col("html")).alias("needs_js"))


def extracted(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract_pages(table(spark, d, "pages"))


@query()
def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    c = "content.{}".format
    return extracted(spark, d).select("page_id", "url", "metadata", c("markdown"), c("plain_text"), c("links"), "domain_type", "structured_data", "error_kind")


@query()
def llm_text(spark: SparkSession, d: str) -> DataFrame:
    return extracted(spark, d).select("page_id", "llm_text")


@query()
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the whole body, those in its furniture too."""
    options = extraction.Options(include=("body",))
    return extraction.links(extraction.extract_pages(table(spark, d, "pages"), options, parts=("content",)), "page_id")


@query()
def score_nodes(spark: SparkSession, d: str) -> DataFrame:
    return extraction.score_nodes(table(spark, d, "pages"), "page_id")


@query()
def best_nodes(spark: SparkSession, d: str) -> DataFrame:
    return extraction.best_nodes(extraction.score_nodes(table(spark, d, "pages"), "page_id"), "page_id")


@query()
def included_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    options = extraction.Options(include=("article p",), exclude=("nav", ".ad"))
    rows = extraction.extract_pages(table(spark, d, "pages"), options, parts=("content",))
    return rows.select("page_id", "content.markdown")


@query()
def domain_summary(spark: SparkSession, d: str) -> DataFrame:
    """Pages, those of 200 words or more, mean words and mean token saving of each kind of site."""
    pages = table(spark, d, "pages").withColumn("raw_tokens", predicates.approx_tokens(F.col("html")))
    rows = extraction.extract_pages(pages.withColumn("source", F.col("html")), parts=("metadata", "content", "domain_type", "llm_text"))
    saved_share = 100 * (1 - predicates.approx_tokens(F.col("llm_text")) / F.col("raw_tokens"))
    words = F.col("metadata.word_count")
    return rows.groupBy("domain_type").agg(
        F.count("*").alias("pages"), F.count_if(words >= 200).alias("long_pages"), F.round(F.avg(words), 2).alias("mean_words"),
        F.round(F.avg(saved_share), 2).alias("mean_reduction_pct"),
    )


@query()
def output_files(spark: SparkSession, d: str) -> DataFrame:
    return sinks.files(extracted(spark, d), "llm")


@query()
def batch_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.batch_lines(extracted(spark, d))


@query("select count(*) as total, count(*) as ok, 0::bigint as errors from pages")
def batch_counters(spark: SparkSession, d: str) -> DataFrame:
    return reports.counters(extraction.extract_pages(table(spark, d, "pages"), parts=("metadata", "content")))


@query()
def brand_identity(spark: SparkSession, d: str) -> DataFrame:
    return site.brand_pages(table(spark, d, "pages"), "page_id").select("page_id", "identity")


@query("select page_id, 1::int as rank, '#' || upper(lpad(to_hex((page_id * 7919 + 123457) % 16777216), 6, '0')) as hex, 'Text' as usage, 1::bigint as n from pages")
def brand_colors(spark: SparkSession, d: str) -> DataFrame:
    code = F.lpad(F.hex((F.col("page_id") * 7919 + 123457) % 16777216), 6, "0")
    pages = table(spark, d, "pages").withColumn("html", F.concat(F.lit("<style>h1{color:#"), code, F.lit("}</style>"), "html"))
    return site.brand_colors(site.brand_pages(pages, "page_id"), "page_id")


@query("select page_id, '/api/v1/items/' || page_id as value, 'relative_path' as kind, true as first_party, 'inline' as source from pages")
def endpoints(spark: SparkSession, d: str) -> DataFrame:
    call = F.concat(F.lit('<script>fetch("/api/v1/items/'), "page_id", F.lit('")</script>'))
    pages = table(spark, d, "pages").withColumn("html", F.concat(call, "html"))
    return site.endpoint_rows(site.endpoint_reports(pages), "page_id")


@query()
def token_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.token_report(table(spark, d, "pages"), "page_id")


@query(
    """with s as (select octet_length(encode(html)) as n from pages)
    select (sum(n) // count(n))::bigint as mean, quantile_disc(n, 0.5)::int as p50, quantile_disc(n, 0.9)::int as p90, quantile_disc(n, 0.99)::int as p99, max(n)::int as max from s"""
)
def percentile_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.percentiles(table(spark, d, "pages").select(F.octet_length("html").alias("size")), "size")


# crawl, sitemaps, maps


_GRAPH = f"""n as (select {_NORMAL} as url, {_SCHEME} || '://' || {_BARE} || {_PORT} as origin, min(page_id) as id from pages group by all),
    o as (select url, origin, row_number() over (partition by origin order by id) - 1 as k from n)"""


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Pages of which the n-th of an origin links to those of 2n + 1 and 2n + 2, to the one that links to it, and to the
    first page of the next origin."""
    url = F.col("url")
    rows = table(spark, d, "pages").groupBy(urls.normalize(url).alias("url"), urls.origin_key(url).alias("origin")).agg(F.min("page_id").alias("id"))
    rows = saved(rows.withColumn("k", F.row_number().over(Window.partitionBy("origin").orderBy("id")) - 1), "pages-of-origin")
    steps = rows.select("url", "origin", F.explode(F.array(2 * F.col("k") + 1, 2 * F.col("k") + 2, F.floor((F.col("k") - 1) / 2).cast("int"))).alias("to"))
    links = steps.join(rows.select("origin", F.col("k").alias("to"), F.col("url").alias("href")), ["origin", "to"]).groupBy("url").agg(F.collect_list("href").alias("links"))
    return rows.join(links, "url", "left").select("url", "origin", "id", F.coalesce("links", F.array().cast("array<string>")).alias("links"))


@query(f"with {_GRAPH} select url, floor(log2(k + 1))::int as depth, true as ok from o")
def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    """From the first page of every origin until no frontier has a page."""
    corpus = saved(_corpus(spark, d), "corpus")
    seeds = corpus.groupBy("origin").agg(F.min_by("url", "id").alias("seed"))
    return crawl.crawl_sites(corpus.select("url", "links"), seeds, crawl.CrawlConfig(max_depth=-1, max_pages=None)).select("url", "depth", "ok")


_SHORT = _NORMAL.removesuffix(")").rpartition(" || ")[0] + ")"


@query(
    f"""with n as (select {_NORMAL} as url, {_SHORT} as short from pages), m as (select distinct short as url from n),
    x as (select distinct url from n where url not in (select url from m)) select url, 0 as source from m union all select url, 1 as source from x"""
)
def map_union(spark: SparkSession, d: str) -> DataFrame:
    """Every page's URL without its query as sitemaps of all origins, and all URLs as what was discovered."""
    pages = table(spark, d, "pages")
    short = saved(pages.select(urls.normalize(F.regexp_replace("url", r"[?#].*", "")).alias("url")).distinct(), "map-short")
    none = lambda kind: F.lit(None).cast(kind)
    sitemap = short.select("url", none("string").alias("last_modified"), none("double").alias("priority"), none("string").alias("change_freq"))
    return crawl.map_union(sitemap, pages.select("url", F.col("page_id").alias("seq"))).select("url", "source")


@query(
    """select page_id, k::int as pos, regexp_replace(url, '#.*', '') || case k when 0 then '' else 'x' end as sitemap
    from pages, (select unnest([0, 1]) as k)"""
)
def robots_sitemaps(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("User-agent: *\n# none\nSitemap: "), F.regexp_replace("url", "#.*", ""), F.lit(" # main\nsitemap : "), F.regexp_replace("url", "#.*", ""), F.lit("x\nSitemap: /rel.xml\n"))
    rows = table(spark, d, "pages").select("page_id", text.alias("text"))
    return rows.select("page_id", F.posexplode(predicates.robots_sitemaps(F.col("text"))).alias("pos", "sitemap"))


@query("select page_id, 'urlset' as kind, 0::int as pos, url as loc, (page_id % 10) / 10.0::double as priority from pages")
def sitemap_entries(spark: SparkSession, d: str) -> DataFrame:
    loc = F.replace("url", F.lit("&"), F.lit("&amp;"))
    xml = F.concat(F.lit("<urlset><url><loc>"), loc, F.lit("</loc><priority>"), (F.col("page_id") % 10 / 10.0).cast("string"), F.lit("</priority></url></urlset>"))
    bodies = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("url"), xml.cast("binary").alias("body"))
    rows = crawl.sitemap_entries(bodies)
    return rows.select(F.col("sitemap").cast("long").alias("page_id"), "kind", "pos", F.col("url").alias("loc"), "priority")


@query(
    f"""with h as (select {_HOST} as query, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, url as link, page_id from pages)
    select query, (row_number() over (partition by query order by page_id))::int as position, title, link, '' as snippet from h where page_id % 7 <> 0"""
)
def search_results(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("page_id") % 7 != 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    hits = table(spark, d, "pages").select(urls.host(F.col("url")).alias("query"), F.struct("page_id", title.alias("title"), F.col("url").alias("link")).alias("hit"))
    replies = hits.groupBy("query").agg(F.to_json(F.struct(F.sort_array(F.collect_list("hit")).alias("organic"))).alias("response"))
    return scans.search_results(replies)


# changes


@query(
    """select page_id, 'title' as field, regexp_extract(html, '<title>([^<]*)</title>', 1) as old,
    case when page_id % 3 = 0 then null else 'New ' || regexp_extract(html, '<title>([^<]*)</title>', 1) end as new from pages where page_id % 3 <> 2"""
)
def metadata_diff(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    new = F.when(F.col("page_id") % 3 == 0, None).when(F.col("page_id") % 3 == 1, F.concat(F.lit("New "), title)).otherwise(title)
    of = lambda value: F.struct(*((value if f == "title" else F.lit(None).cast("string")).alias(f) for f in schemas.METADATA_FIELDS))
    rows = table(spark, d, "pages").select("page_id", F.explode(changes.metadata_changes(of(title), of(new))).alias("c"))
    return rows.select("page_id", "c.*")


@query(
    """with a as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) as href from pages),
    o as (select distinct page_id, href from a), n as (select page_id, href from o where length(href) % 2 = 0 union select page_id, '/new' from pages)
    select page_id, 'added' as change, href from n where (page_id, href) not in (select page_id, href from o)
    union all select page_id, 'removed' as change, href from o where (page_id, href) not in (select page_id, href from n)"""
)
def link_diff(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    old = saved(reports.anchors(pages, "page_id").select("page_id", "href", F.lit("").alias("text")).distinct(), "links")
    new = old.filter(F.length("href") % 2 == 0).union(pages.select("page_id", F.lit("/new"), F.lit("")))
    return changes.link_changes(old, new, "page_id").select("page_id", "change", "href")


@query()
def page_diff(spark: SparkSession, d: str) -> DataFrame:
    """Each page against itself with its last paragraph gone from two of three pages."""
    pages = table(spark, d, "pages")
    cut = pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.regexp_replace("html", r"<p>(?:(?!<p>).)*$", "")))
    parts = ("metadata", "content")
    old, new = (changes.snapshot(extraction.extract_pages(x, parts=parts)) for x in (pages, cut))
    return changes.diff(old, new, "page_id")


@query(
    """with e as (select user_id, ts, max(event_type) as m from events group by all),
    l as (select user_id, ts, m, lag(m) over (partition by user_id order by ts) as o from e)
    select user_id, count(*)::bigint as changes from l where o is not null and o <> m group by user_id"""
)
def watch_stream(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each user's event type, as a watched page: a file stream, run to its end, with keyed state."""
    one = table(spark, d, "events").groupBy("user_id", "ts").agg(F.max("event_type").alias("markdown"))
    meta = F.struct(*(F.lit(None).cast("string").alias(f) for f in schemas.METADATA_FIELDS), F.lit(1).cast("long").alias("word_count"))
    rows = saved(one.select(F.col("user_id").cast("string").alias("url"), "ts", "markdown", meta.alias("metadata")), "snapshots")
    stream = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rpartition("/")[0])
    folder = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    out = watch(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("url string, ts timestamp, status string").parquet(f"{folder}/out")
    return found.groupBy(F.col("url").cast("long").alias("user_id")).agg(F.count("*").alias("changes"))


# texts


@query(
    """with t as (select doc_id, length(text) as n, length(regexp_replace(text, '[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{AC00}-\\x{D7AF}\\x{3400}-\\x{4DBF}]', '', 'g')) as m from documents)
    select doc_id, case when (n - m) / n > 0.3 then ceil(n / 2) else ceil(n / 4) end::bigint as tokens from t"""
)
def approx_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", predicates.approx_tokens(F.col("text")).alias("tokens"))


@query("select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::bigint as words from documents")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", predicates.word_count(F.col("text")).alias("words"))


_PRINT = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[^\\p{L}\\p{N} ]', '', 'g'), ' +', ' ', 'g'))"


@query(f"select min(doc_id) as doc_id, count(*)::bigint as n from (select doc_id, {_PRINT} as f from documents) group by f")
def fingerprint_dedup(spark: SparkSession, d: str) -> DataFrame:
    return reports.dedup_by_fingerprint(table(spark, d, "documents"))


@query(f"select min(doc_id) as doc_id, count(*)::bigint as n from (select doc_id, string_split({_PRINT}, ' ') as w from documents) group by array_to_string(w[1:10], ' '), least(len(w), 10)")
def prefix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return reports.dedup_by_fingerprint(table(spark, d, "documents"), words=10)


def _decode_sql() -> str:
    out = "text || ' &amp;lt; &copy;'"
    for name, c in predicates._ENTITY_ORDER:
        out = f"replace({out}, '&{name};', '{c.replace(chr(39), chr(39) * 2)}')"
    return out


@query(f"select doc_id, {_decode_sql()} as text from documents")
def html_entity_decode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", predicates.decode_named_entities(F.concat("text", F.lit(" &amp;lt; &copy;"))).alias("text"))


@query("select doc_id, regexp_replace(text || chr(8203) || 'x' || chr(65279), '[\\x{200B}-\\x{200F}\\x{FEFF}\\x{00AD}\\x{2060}\\x{2062}-\\x{2064}\\x{034F}]', '', 'g') as text from documents")
def invisible_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", predicates.strip_invisible(F.concat("text", F.lit("​x﻿"))).alias("text"))


@query("select doc_id, count(*) filter (where contains(lower(text), lower(fact)))::bigint as found, count(*)::bigint as total from documents, (select text as fact from benchmark) group by doc_id")
def fact_hits(spark: SparkSession, d: str) -> DataFrame:
    return reports.fact_hits(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("text").alias("fact")), "doc_id")


@query("select conv_id, turn, trim(replace(regexp_replace(text, '/think', '', 'g'), '</think>', '')) as reply from conversations")
def strip_thinking(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("<think>first\nthen</think>"), "text", F.lit("</think>"))
    return table(spark, d, "conversations").select("conv_id", "turn", predicates.strip_thinking(text).alias("reply"))


@query("select conv_id, turn, length(text)::int as n, role from conversations")
def json_replies(spark: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.struct(F.length("text").alias("n"), "role"))
    reply = predicates.json_reply(F.concat(F.lit("<think>x</think>```json\n"), body, F.lit("\n```")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.from_json(reply, "n int, role string").alias("r")).select("conv_id", "turn", "r.*")


@query()
def compact_documents(spark: SparkSession, d: str) -> DataFrame:
    return extraction.compact_text(table(spark, d, "documents").select("doc_id", F.col("text").alias("markdown")))


# site records, threads, documents, completions


def _packages(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    version = F.concat("page_id", F.lit(".0.0"))
    doc = F.struct(
        title.alias("description"), F.create_map(F.lit("latest"), version).alias("dist-tags"),
        F.create_map(version, F.struct(F.lit("MIT").alias("license"))).alias("versions"),
    )
    url = F.concat(F.lit("https://www.npmjs.com/package/p"), "page_id")
    return table(spark, d, "pages").select("page_id", url.alias("url"), F.to_json(doc).alias("payload"))


@query(
    """select page_id, 'npm' as vertical, 'p' || page_id as name, regexp_extract(html, '<title>([^<]*)</title>', 1) as description,
    page_id || '.0.0' as latest_version, 'MIT' as license, 1::bigint as release_count from pages"""
)
def vertical_records(spark: SparkSession, d: str) -> DataFrame:
    """Package records read from replies made of each page."""
    read = records.records(_packages(spark, d))
    fields = F.from_json("record", "name string, description string, latest_version string, license string, release_count long")
    return read.select("page_id", "vertical", fields.alias("r")).select("page_id", "vertical", "r.*")


@query()
def vertical_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return records.catalogue(spark)


@query(
    """select conv_id, turn as id, case when turn > 0 then turn - 1 end as parent_id, text, turn::int as depth from
    (select conv_id, text, row_number() over (partition by conv_id order by turn, text) - 1 as turn from conversations)"""
)
def news_comments(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as discussions in which each turn answers the one before, flattened again."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    turns = table(spark, d, "conversations").select("conv_id", "text", (F.row_number().over(w) - 1).alias("id"))
    own = F.concat(F.lit('{"type":"comment","id":'), "id", F.lit(',"parent_id":'), F.when(F.col("id") > 0, F.col("id") - 1).cast("string"))
    own = F.coalesce(own, F.concat(F.lit('{"type":"comment","id":'), "id"))
    body = F.concat(own, F.lit(","), F.substr(F.to_json(F.struct("text")), F.lit(2), F.length(F.to_json(F.struct("text"))) - 2), F.lit(',"children":['))
    threads = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("id", body.alias("body")))).alias("t"))
    nested = F.concat(F.lit('{"id":0,"type":"story","children":['), F.array_join("t.body", ""), F.repeat(F.lit("]}"), F.size("t")), F.lit("]}"))
    replies = threads.select("conv_id", F.concat(F.lit("https://news.ycombinator.com/item?id="), "conv_id").alias("url"), nested.alias("payload"))
    return records.news_comments(records.records(replies), "conv_id").select("conv_id", "id", "parent_id", "text", "depth")


@query(
    """select p_brand, count(*)::bigint as products, min(p_retailprice) as price_min, max(p_retailprice + 1) as price_max, bool_or(p_size % 2 = 0) as any_available,
    (count(*) * 2)::bigint as variants from part group by p_brand"""
)
def price_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Parts as products with two variants each."""
    price = lambda more: (F.col("p_retailprice") + more).cast("string").alias("price")
    variants = F.array(F.struct(price(0), (F.col("p_size") % 2 == 0).alias("available")), F.struct(price(1), F.lit(False).alias("available")))
    url = F.concat(F.lit("https://shop.test/products/"), "p_partkey")
    payload = F.to_json(F.struct(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), variants.alias("variants")).alias("product")))
    rows = table(spark, d, "part").select("p_brand", url.alias("url"), payload.alias("payload"))
    return records.price_ranges(records.records(rows, "shopify_product"), "p_brand")


@query(
    """select c_custkey, 'csv' as kind, '| name | segment |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | a, ' || c_mktsegment || ' |' as markdown from customer"""
)
def csv_documents(spark: SparkSession, d: str) -> DataFrame:
    content = F.concat(F.lit("name,segment\r\n"), "c_name", F.lit(',"a, '), "c_mktsegment", F.lit('"\n'))
    files = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("f"), "c_custkey", F.lit(".csv")).alias("path"), content.cast("binary").alias("content"))
    return documents.documents(files).select("c_custkey", "kind", "markdown")


def _echo(request: completions.Request) -> str:
    """A completer that reports the length of the text."""
    return f'<think>no</think>{{"length": {len(request.user)}}}' if request.json_mode else request.user.split(".")[0]


@query("select conv_id, turn, length(text)::bigint as length from conversations")
def completion_json(spark: SparkSession, d: str) -> DataFrame:
    """Each turn through a stand-in completer that answers with JSON."""
    rows = completions.extract_by_schema(table(spark, d, "conversations"), "text", {"length": "integer"}, completions.Chain([("echo", _echo)]))
    return rows.select("conv_id", "turn", F.from_json("json", "length long").alias("r")).select("conv_id", "turn", "r.length")


@query("select conv_id, turn, trim(string_split(text, '.')[1]) as summary from conversations")
def completion_summary(spark: SparkSession, d: str) -> DataFrame:
    return completions.summarize(table(spark, d, "conversations"), "text", _echo).select("conv_id", "turn", "summary")


def _add_cases() -> None:
    from tidemill.plans import case_queries, made_queries

    for more in (case_queries, made_queries):
        QUERIES.update(more.QUERIES)
        ORACLES.update(more.ORACLES)


_add_cases()
