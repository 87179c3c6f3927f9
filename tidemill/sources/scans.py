"""Stored pages, URL lists and search replies as DataFrames. Nothing here goes to the network."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import predicates, urls

BODY_CEILING = 50 * 1024 * 1024


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def within_ceiling(pages: DataFrame, column: str = "html") -> DataFrame:
    return pages.filter(F.octet_length(column) < BODY_CEILING)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """Local pages: path and html; their URL is unknown."""
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return rows.select("path", F.lit(None).cast("string").alias("url"), F.col("value").alias("html"))


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """url and file_name of a list with a URL a line, maybe with a comma and a name; # begins a comment line."""
    return url_lines(spark.read.text(path))


def url_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    line = F.trim(column)
    parts = F.split(line, ",", 2)
    name = F.trim(F.get(parts, F.lit(1)))
    rows = lines.filter((line != "") & ~line.startswith("#"))
    return rows.select(urls.with_scheme(F.get(parts, F.lit(0))).alias("url"), F.when(name != "", name).alias("file_name"))


def routed(log: DataFrame) -> DataFrame:
    """A fetch log (url, status, headers, html, elapsed_ms) with route: how each row is to be read.

    retry, challenge and blocked rows need another fetch; pdf and the document kinds go to the document readers.
    """
    kind = F.coalesce(F.col("headers")["content-type"], F.lit(""))
    mime = F.trim(F.lower(F.split(kind, ";")[0]))
    document = predicates.document_kind(kind, F.col("url"))
    route = (
        F.when(~predicates.is_http_url(F.col("url")), "invalid_url").when(predicates.is_retryable_status(F.col("status")), "retry")
        .when(F.octet_length("html") >= BODY_CEILING, "too_large").when(predicates.is_challenge(F.col("html")), "challenge")
        .when(predicates.is_bot_protected(F.col("html"), F.col("headers")), "blocked").when(mime == "application/pdf", "pdf")
        .when(document.isNotNull(), document).when(predicates.is_linkedin_post(F.col("url")), "post").otherwise("page")
    )
    return log.withColumn("route", route)


def within_budget(log: DataFrame, attempt_ms: int = 12_000, total_ms: int = 24_000) -> DataFrame:
    """Attempts of a fetch log (url, attempt, elapsed_ms) that ended in time: each within its own limit, and all up to it
    within that of the whole fetch."""
    spent = F.sum("elapsed_ms").over(Window.partitionBy("url").orderBy("attempt").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = log.withColumn("_spent", spent)
    return rows.filter((F.col("elapsed_ms") <= attempt_ms) & (F.col("_spent") <= total_ms)).drop("_spent")


SERPER = "organic array<struct<title:string,link:string,snippet:string>>"


def search_results(replies: DataFrame) -> DataFrame:
    """query, position, title, link and snippet of stored search replies (query, response); hits without title or link go."""
    hits = replies.select("query", F.posexplode(F.from_json("response", SERPER)["organic"]).alias("pos", "hit"))
    hits = hits.filter("hit.title is not null and hit.link is not null")
    place = F.row_number().over(Window.partitionBy("query").orderBy("pos"))
    return hits.select("query", place.alias("position"), "hit.title", "hit.link", F.coalesce("hit.snippet", F.lit("")).alias("snippet"))


def with_content(results: DataFrame, extracted: DataFrame, limit: int = 10) -> DataFrame:
    """Search results with the markdown of stored pages, null where there is none."""
    pages = extracted.select(F.col("url").alias("link"), F.col("content.markdown").alias("content"))
    return results.filter(F.col("position") <= limit).join(pages, "link", "left")


def proxy_url(line: str) -> str | None:
    """host:port or host:port:user:password as a proxy URL; None for anything else."""
    parts = line.strip().split(":", 3)
    if line.strip().startswith("#"):
        return None
    if len(parts) == 2:
        return f"http://{parts[0]}:{parts[1]}"
    if len(parts) == 4:
        return f"http://{parts[2]}:{parts[3]}@{parts[0]}:{parts[1]}"
    return None


def pick(n: int, sticky: bool = True):
    """Client number of each row: the same for a host, or at random."""
    return F.pmod(F.xxhash64(urls.host(F.col("url"))), F.lit(n)) if sticky else F.floor(F.rand() * n)


def safe_name(name: str) -> str:
    """A relative output name, or ValueError."""
    if not name or name.startswith("/") or re.match(r"[A-Za-z]:", name) or ".." in name.split("/"):
        raise ValueError(f"not a safe relative name: {name!r}")
    return name
