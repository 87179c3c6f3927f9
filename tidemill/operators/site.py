"""Brand, endpoint, thread and caption rows of pages."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import schemas
from tidemill.functions import brand, endpoints, sites
from tidemill.operators.batches import flat_map_rows, map_rows, spread

_s = T.StringType()
IDENTITY = schemas.fields(name=_s, logo_url=_s, favicon_url=_s, og_image=_s, logos=T.ArrayType(schemas.fields(url=_s, kind=_s)))
MENTION = schemas.fields(kind=_s, value=_s, usage=_s)
ENDPOINT = schemas.fields(value=_s, kind=_s, first_party=T.BooleanType(), source=_s)
REPORT = schemas.fields(endpoints=T.ArrayType(ENDPOINT), hosts=T.ArrayType(_s), bundles_scanned=T.IntegerType(), truncated=T.BooleanType())


def brand_pages(pages: DataFrame, key: str, stylesheets: DataFrame | None = None) -> DataFrame:
    """One parse of each page: key, identity, and mentions of colours and fonts as an array.

    stylesheets (page url, src, text) of fetched sheets join by page and are read after the page's own, in the order of src.
    """
    if stylesheets is not None:
        sheets = stylesheets.groupBy("url").agg(F.sort_array(F.collect_list(F.struct("src", "text"))).alias("sheets"))
        css = F.concat(F.lit("<style>"), F.array_join("sheets.text", "\n"), F.lit("</style>"))
        pages = pages.join(sheets, "url", "left").withColumn("html", F.concat("html", F.coalesce(css, F.lit(""))))
    schema = schemas.fields(identity=IDENTITY, mentions=T.ArrayType(MENTION))

    def one(html: str | None, url: str | None) -> dict[str, Any]:
        about, rows = brand.read(html or "", url)
        return {"identity": about, "mentions": rows}

    return map_rows(spread(pages), ["html", "url"], one, schema, [key])


def brand_colors(read: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """key, rank, hex, usage and n of the commonest colours of each page; equal ones by hex.

    A colour's usage is its commonest. The palette of a sign-in button goes where three of its colours are, unless the
    brand is that company's; the first unknown usages become Primary and Secondary.
    """
    rows = read.select(key, F.lower(F.coalesce("identity.name", F.lit(""))).alias("brand"), F.explode("mentions").alias("m")).filter("m.kind = 'color'")
    uses = rows.groupBy(key, "brand", F.col("m.value").alias("hex"), F.col("m.usage").alias("usage")).agg(F.count("*").alias("n"))
    order = F.struct("n", F.transform(F.split("usage", ""), lambda c: -F.ascii(c)))
    found = uses.groupBy(key, "brand", "hex").agg(F.sum("n").alias("n"), F.max_by("usage", order).alias("usage"))
    button = F.col("hex").isin(*sorted(brand.SIGN_IN))
    hits = F.sum(button.cast("int")).over(Window.partitionBy(key))
    found = found.withColumn("hits", hits).filter(~(button & (F.col("hits") >= 3) & ~F.col("brand").contains("google")))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "hex")))
    unknown = F.col("usage") == "Unknown"
    nth = F.sum(unknown.cast("int")).over(Window.partitionBy(key).orderBy("rank"))
    usage = F.when(unknown & (nth == 1), "Primary").when(unknown & (nth == 2), "Secondary").otherwise(F.col("usage"))
    return found.withColumn("usage", usage).filter(F.col("rank") <= limit).select(key, "rank", "hex", "usage", "n")


def brand_fonts(read: DataFrame, key: str) -> DataFrame:
    """key, font and n, commonest first by rank; equal ones by name."""
    rows = read.select(key, F.explode("mentions").alias("m")).filter("m.kind = 'font'")
    found = rows.groupBy(key, F.col("m.value").alias("font")).agg(F.count("*").alias("n"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "font")))


def endpoint_reports(pages: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """The report of each page; bundles (page url, src, text) of fetched scripts join by page."""
    if bundles is not None:
        texts = bundles.groupBy("url").agg(F.sort_array(F.collect_list(F.struct(F.col("src").alias("url"), "text"))).alias("bundles"))
        pages = pages.join(texts, "url", "left")
    else:
        pages = pages.withColumn("bundles", F.lit(None).cast("array<struct<url:string,text:string>>"))
    pages = pages.withColumn("_url", F.col("url"))
    return map_rows(spread(pages), ["html", "_url", "bundles"], lambda h, u, b: endpoints.report(h or "", u or "", b), REPORT)


def endpoint_rows(reports: DataFrame, *keep: str) -> DataFrame:
    return reports.select(*keep, F.explode("endpoints").alias("e")).select(*keep, "e.*")


def endpoint_hosts(reports: DataFrame) -> DataFrame:
    """Every host that any script names, with the number of pages."""
    return reports.select("url", F.explode("hosts").alias("host")).distinct().groupBy("host").agg(F.count("*").alias("pages"))


def script_sources(pages: DataFrame, *keep: str) -> DataFrame:
    found = flat_map_rows(
        spread(pages), ["html", "url"], lambda h, u: [{"src": x} for x in endpoints.script_sources(h or "", u or "")], schemas.fields(src=_s), [*keep, "url"]
    )
    return found


def thread_comments(pages: DataFrame, *keep: str) -> DataFrame:
    """A row for each comment of thread pages, its path the place at each level."""

    def one(html: str | None, url: str | None) -> list[dict[str, Any]]:
        got = sites.thread(html or "", url or "")
        return sites.flat_comments(got[1]) if got else []

    threads = pages.filter(F.col("url").contains("/comments/"))
    return flat_map_rows(spread(threads), ["html", "url"], one, schemas.COMMENT, [*keep, "url"])


def descendants(comments: DataFrame, *keys: str) -> DataFrame:
    """Comments of each thread, at any depth."""
    return comments.groupBy(*keys).agg(F.count("*").alias("n_comments"), F.max("depth").alias("deepest"))


def caption_tracks(pages: DataFrame, *keep: str) -> DataFrame:
    return flat_map_rows(spread(pages), ["html"], lambda h: sites.caption_tracks(h or ""), schemas.fields(url=_s, lang=_s, name=_s), list(keep))
