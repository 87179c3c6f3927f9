"""Breadth-first crawls over a stored corpus, sitemaps, and maps of a site."""

from __future__ import annotations

import gzip
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any
from xml.parsers import expat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import schemas
from tidemill.functions import predicates, urls
from tidemill.operators.batches import flat_map_rows
from tidemill.plans.tables import appended, dropped, numbered, saved

#: With trim, an uncapped crawl keeps half of so many links of a level.
UNCAPPED = 500_000
FALLBACK_PATHS = tuple(
    f"/{p}" for p in "sitemap.xml sitemap_index.xml sitemap-index.xml sitemap1.xml sitemaps.xml sitemap/index.xml wp-sitemap.xml sitemap/sitemap-index.xml".split()
)
DEEPEST_INDEX = 5


@dataclass(frozen=True)
class CrawlConfig:
    """max_pages None crawls all; strict drops what a level's cap leaves over, as the original does, else it stays in the frontier;
    trim cuts a long frontier to its first links, as the original does, else none is lost."""

    max_depth: int = 1
    max_pages: int | None = 50
    external: bool = False
    subdomains: bool = False
    prefix: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    strict: bool = True
    trim: bool = False


@dataclass
class CrawlResult:
    """pages: url, depth, seq, ok, error. visited: url. frontier: url, depth, seq. counts: total, ok, errors."""

    pages: DataFrame
    visited: DataFrame
    frontier: DataFrame
    counts: dict[str, int]


def qualifies(url: Column, seed: str, config: CrawlConfig) -> Column:
    return predicates.in_crawl_scope(
        url, F.lit(seed), external=config.external, subdomains=config.subdomains, prefix=config.prefix, include=config.include, exclude=config.exclude
    )


def crawl(
    corpus: DataFrame, seed: str, config: CrawlConfig = CrawlConfig(), sitemap: DataFrame | None = None,  # noqa: B008
    state: tuple[DataFrame, DataFrame] | None = None, on_level: Callable[[DataFrame], None] | None = None, keep_pages: bool = True,
    cancelled: Callable[[], bool] = lambda: False,
) -> CrawlResult:
    """Level by level over a corpus of url (normalized), links (array of href) and, if it has it, error.

    A page that the corpus lacks, or that has an error, counts as failed and links nowhere. Each level is a few joins
    on URL and is saved, so plans don't grow with depth, and visited URLs are written once. sitemap (url and, for its
    order, seq) seeds the first level; state, the visited and frontier of an earlier result, resumes it, with its counts
    from 0. on_level gets the pages of each level as it ends; without keep_pages only the counts stay. cancelled is asked
    between levels, and what is left is the frontier. At every size a level is in the order of the pages that link to it,
    then of their links.
    """
    spark = corpus.sparkSession
    error = F.col("error") if "error" in corpus.columns else F.lit(None).cast("string")
    known = corpus.select("url", "links", error.alias("error"), F.lit(True).alias("found"))
    if state is None:
        visited = spark.createDataFrame([], "url string")
        first = spark.range(1).select(urls.normalize(F.lit(seed)).alias("url"), F.lit(0).alias("depth"), F.lit(-1).cast("long").alias("seq"))
        if sitemap is not None:
            order = [c for c in sitemap.columns if c == "seq"] or ["url"]
            rows = numbered(sitemap.filter(qualifies(F.col("url"), seed, config)).select("url", *order), *order, name="crawl-sitemap")
            first = first.union(rows.select(urls.normalize(F.col("url")), F.lit(0), "seq"))
        frontier = first.filter("url is not null")
    else:
        visited, frontier = state
    visited, seen = appended(visited, "crawl-visited")
    levels: list[DataFrame] = []
    counts = {"total": 0, "ok": 0, "errors": 0}
    while (config.max_pages is None or counts["total"] < config.max_pages) and not cancelled():
        once = frontier.groupBy("url").agg(F.min(F.struct("seq", "depth")).alias("m")).select("url", "m.depth", "m.seq")
        todo = saved(once.join(visited, "url", "left_anti"), "crawl-todo")
        size = todo.count()
        if not size:
            frontier = todo
            break
        room = size if config.max_pages is None else config.max_pages - counts["total"]
        batch = todo if size <= room else todo.orderBy("seq", "url").limit(room)
        level = batch.join(known, "url", "left").withColumn("ok", F.coalesce(F.col("found") & F.col("error").isNull(), F.lit(False)))
        level = saved(level.withColumn("error", F.when(~F.col("ok"), F.coalesce("error", F.lit("not in the corpus")))).drop("found"), "crawl-level")
        rest = None if size <= room or config.strict else todo.join(level.select("url"), "url", "left_anti")
        tally = level.agg(F.count("*").alias("n"), F.count_if("ok").alias("ok")).first()
        counts = {"total": counts["total"] + tally.n, "ok": counts["ok"] + tally.ok, "errors": counts["errors"] + tally.n - tally.ok}
        if on_level:
            on_level(level.drop("links"))
        if keep_pages:
            levels.append(level.drop("links"))
        visited, _ = appended(level.select("url"), "crawl-visited", seen)
        out = level.filter(F.col("ok") & (F.col("depth") < config.max_depth)).select("depth", "seq", F.posexplode("links").alias("pos", "href"))
        out = out.filter(qualifies(F.col("href"), seed, config)).select(urls.normalize(F.col("href")).alias("url"), (F.col("depth") + 1).alias("depth"), "seq", "pos")
        found = numbered(out.join(visited, "url", "left_anti").withColumnRenamed("seq", "of"), "of", "pos", name="crawl-frontier").drop("of", "pos")
        if config.trim:
            cap, keep = (UNCAPPED, UNCAPPED // 2) if config.max_pages is None else (max(10 * config.max_pages, 100), max(5 * config.max_pages, 50))
            if found.count() > cap:
                found = found.filter(F.col("seq") < keep)
        frontier = found.select("url", "depth", "seq")
        if rest is not None:
            frontier = saved(rest.select("url", "depth", "seq").union(frontier.withColumn("seq", F.col("seq") + (1 << 40))), "crawl-rest")
        dropped(todo)
        if not keep_pages:
            dropped(level)
    pages = levels[0] if levels else spark.createDataFrame([], "url string, depth int, seq long, error string, ok boolean")
    for level in levels[1:]:
        pages = pages.unionByName(level)
    return CrawlResult(pages, visited, frontier, counts)


def crawl_sites(corpus: DataFrame, seeds: DataFrame, config: CrawlConfig = CrawlConfig(max_pages=None)) -> DataFrame:  # noqa: B008
    """Crawls from many seeds (seed) side by side, each in its own scope: seed, url, depth and ok of each page.

    One level of all crawls is one set of joins, so a thousand sites take as many rounds as the deepest one. There is no
    cap on pages or links; a crawl ends when its frontier is empty or at max_depth (negative: no end but that).
    """
    known = corpus.select("url", "links", F.lit(True).alias("ok"))
    start = seeds.select("seed").distinct().select("seed", urls.normalize(F.col("seed")).alias("url"))
    todo, depth = saved(start.filter("url is not null"), "sites-todo"), 0
    pages = visited = path = None
    while not todo.isEmpty():
        level = saved(todo.join(known, "url", "left").select("seed", "url", F.lit(depth).alias("depth"), F.coalesce("ok", F.lit(False)).alias("ok"), "links"), "sites-level")
        pages, path = appended(level.drop("links"), "sites-pages", path)
        visited = pages.select("seed", "url")
        if depth == config.max_depth:
            break
        out = level.select("seed", F.explode("links").alias("href"))
        keep = predicates.in_crawl_scope(
            F.col("href"), F.col("seed"), external=config.external, subdomains=config.subdomains, prefix=config.prefix, include=config.include, exclude=config.exclude
        )
        out = out.filter(keep).select("seed", urls.normalize(F.col("href")).alias("url")).distinct()
        after = saved(out.join(visited, ["seed", "url"], "left_anti"), "sites-todo")
        dropped(todo, level)
        todo, depth = after, depth + 1
    return pages if pages is not None else start.select("seed", "url", F.lit(0).alias("depth"), F.lit(False).alias("ok"))


# sitemaps


def decode_body(body: bytes | None) -> str | None:
    """Text of a sitemap body, unzipped if it is gzip; None if that fails."""
    if body is None:
        return None
    if body[:2] != b"\x1f\x8b":
        return body.decode("utf-8", "replace")
    try:
        return gzip.decompress(body).decode("utf-8")
    except (OSError, EOFError, UnicodeDecodeError):
        return None


def read_sitemap(text: str) -> tuple[str, list[dict[str, Any]]]:
    """urlset, index or unknown, and the entries; broken XML gives what came before the break."""
    kind, rows, row = "unknown", [], {}
    field: list[str] = []
    inside = False
    names = {"loc": "url", "lastmod": "last_modified", "priority": "priority", "changefreq": "change_freq"}
    piece: list[str] = []

    def start(name: str, _: dict[str, str]) -> None:
        nonlocal kind, inside, row
        name = name.rpartition(":")[2]
        flush()
        if kind == "unknown" and name in ("urlset", "sitemapindex"):
            kind = "urlset" if name == "urlset" else "index"
        elif name in ("url", "sitemap"):
            inside, row = (kind == "urlset") == (name == "url") or inside, {}
        field[:] = [names[name]] if inside and name in names else []

    def flush() -> None:
        text = "".join(piece).strip()
        piece.clear()
        if field and text:
            row[field[0]] = text

    def end(name: str) -> None:
        nonlocal inside
        name = name.rpartition(":")[2]
        flush()
        field.clear()
        if name in ("url", "sitemap"):
            if inside and "url" in row:
                rows.append(dict(row))
            inside = False

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, piece.append
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError:
        pass
    for r in rows:
        try:
            r["priority"] = float(r["priority"]) if kind == "urlset" and "priority" in r else None
        except ValueError:
            r["priority"] = None
    return kind, rows if kind == "urlset" else [{"url": r["url"]} for r in rows] if kind == "index" else []


_ENTRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("pos", T.IntegerType()), *schemas.SITEMAP_ENTRY])


def sitemap_entries(bodies: DataFrame) -> DataFrame:
    """A row for each entry of stored sitemaps (url, body): sitemap, kind, pos and the entry."""

    def one(body: bytes | None) -> list[dict[str, Any]]:
        kind, rows = read_sitemap(decode_body(bytes(body) if body is not None else None) or "")
        return [{"kind": kind, "pos": k} | r for k, r in enumerate(rows)]

    return flat_map_rows(bodies.select(F.col("url").alias("sitemap"), "body"), ["body"], one, _ENTRY, ["sitemap"])


def robots_rows(robots: DataFrame) -> DataFrame:
    """A row for each sitemap that a robots file (url, text) names, in order."""
    return robots.select("url", F.posexplode(predicates.robots_sitemaps(F.col("text"))).alias("pos", "sitemap"))


def discover(bodies: DataFrame, site: str, robots: DataFrame | None = None) -> DataFrame:
    """Entries of a site's sitemaps over a table of bodies (url, body), the first of each URL, in order by seq.

    From the robots file (url, text) and the usual paths, through indexes to a depth of five.
    """
    spark, base = bodies.sparkSession, site.rstrip("/")
    entries = saved(sitemap_entries(bodies), "sitemap-entries")
    usual = spark.createDataFrame([(1_000 + k, f"{base}{p}") for k, p in enumerate(FALLBACK_PATHS)], "pos int, sitemap string")
    todo = usual
    if robots is not None:
        todo = robots_rows(robots.filter(F.col("url") == f"{base}/robots.txt")).select("pos", "sitemap").union(usual)
    # of a sitemap named twice the first counts, except among those that robots files name
    todo = todo.groupBy("sitemap").agg(F.min("pos").alias("pos")).select("sitemap", F.array("pos").alias("path"))
    found = None
    for _ in range(DEEPEST_INDEX + 1):
        rows = saved(todo.join(entries, "sitemap").withColumn("path", F.concat("path", F.array("pos"))), "sitemap-level")
        urls_ = rows.filter("kind = 'urlset'").select("path", *schemas.SITEMAP_ENTRY.fieldNames())
        found = urls_ if found is None else found.unionByName(urls_)
        todo = rows.filter("kind = 'index'").select(F.col("url").alias("sitemap"), "path")
        if todo.isEmpty():
            break
    first = found.groupBy("url").agg(F.min(F.struct("path", "last_modified", "priority", "change_freq")).alias("m"))
    first = first.select("url", "m.*")
    return first.select(*schemas.SITEMAP_ENTRY.fieldNames(), F.transform("path", lambda p: F.lpad(p.cast("string"), 10, "0")).alias("seq"))


# maps


@dataclass(frozen=True)
class MapConfig:
    """max_urls holds only where the crawl is used: a rich sitemap is given whole."""

    max_pages: int = 150
    depth: int = 2
    least_sitemap: int = 200
    fallback: bool = True
    max_urls: int | None = None


def _sortable(df: DataFrame) -> Column:
    """seq as text that sorts as it does: arrays joined, numbers padded."""
    kind = df.schema["seq"].dataType
    if isinstance(kind, T.ArrayType):
        return F.concat_ws("-", "seq")
    return F.col("seq") if isinstance(kind, T.StringType) else F.lpad(F.col("seq").cast("string"), 20, "0")


def map_union(sitemap: DataFrame, discovered: DataFrame, site: str | None = None) -> DataFrame:
    """Sitemap entries as they are, then discovered URLs (url, seq) of the site's origin that they lack, once each.

    Without a site those of all origins are taken. seq, a text, has the order within each source: that of the sitemap's seq, or
    of its URLs if it has none.
    """
    norm = urls.normalize(F.col("url"))
    if site is not None:
        discovered = discovered.filter(urls.origin_key(F.col("url")) == urls.origin_key(F.lit(site)))
    new = discovered.select(norm.alias("url"), _sortable(discovered).alias("seq")).filter("url is not null")
    new = new.groupBy("url").agg(F.min("seq").alias("seq")).join(sitemap.select(norm.alias("url")), "url", "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    rows = new.select("url", none("string").alias("last_modified"), none("double").alias("priority"), none("string").alias("change_freq"), F.lit(1).alias("source"), "seq")
    place = _sortable(sitemap) if "seq" in sitemap.columns else F.col("url")
    own = sitemap.select(*schemas.SITEMAP_ENTRY.fieldNames(), F.lit(0).alias("source"), place.alias("seq"))
    return own.unionByName(rows)


def map_site(corpus: DataFrame, site: str, bodies: DataFrame, robots: DataFrame | None = None, config: MapConfig = MapConfig()) -> DataFrame:  # noqa: B008
    """URLs of a site: from its sitemaps and, where those are few, a short crawl and all links it met."""
    entries = saved(discover(bodies, site, robots), "map-sitemap")
    if not config.fallback or entries.count() >= config.least_sitemap:
        return entries.select(*schemas.SITEMAP_ENTRY.fieldNames(), F.lit(0).alias("source"), _sortable(entries).alias("seq"))
    got = crawl(corpus, site, CrawlConfig(max_depth=config.depth, max_pages=config.max_pages))
    links = got.pages.filter("ok").select("url", "seq", "depth").join(corpus.select("url", "links"), "url")
    place = lambda k, *by: F.concat_ws("-", F.lit(str(k)), *(F.lpad(F.greatest(F.col(b), F.lit(0)).cast("string"), 12, "0") for b in by)).alias("seq")
    found = got.pages.select("url", place(0, "depth", "seq"))
    found = found.union(links.select("depth", "seq", F.posexplode("links").alias("pos", "url")).select("url", place(1, "depth", "seq", "pos")))
    found = found.union(got.frontier.select("url", place(2, "seq")))
    out = map_union(entries, found, site)
    return out if config.max_urls is None else out.orderBy("source", "seq").limit(config.max_urls)
