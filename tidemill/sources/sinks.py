"""Output formats of extracted pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import urls

EXTENSIONS = {"markdown": "md", "llm": "md", "json": "json", "text": "txt", "html": "html"}


def frontmatter() -> Column:
    names = {"title": "title", "author": "author", "date": "published_date", "source": "url"}
    lines = [F.when(F.col(f"metadata.{f}").isNotNull(), F.concat(F.lit(f'{n}: "'), F.col(f"metadata.{f}"), F.lit('"'))) for n, f in names.items()]
    count = F.when(F.col("metadata.word_count") > 0, F.concat(F.lit("word_count: "), F.col("metadata.word_count")))
    return F.concat_ws("\n", F.lit("---"), *lines, count, F.lit("---\n"))


def rendered(kind: str, with_frontmatter: bool = False) -> Column:
    """The page in a format: markdown, json, text, llm or html."""
    if kind == "markdown":
        data = F.when(
            F.size("structured_data") > 0,
            F.concat(F.lit("\n\n## Structured Data\n\n```json\n["), F.array_join("structured_data", ","), F.lit("]\n```")),
        )
        return F.concat(frontmatter() if with_frontmatter else F.lit(""), F.concat(F.lit("\n") if with_frontmatter else F.lit(""), F.col("content.markdown")), F.coalesce(data, F.lit("")))
    if kind == "json":
        return F.to_json(F.struct("metadata", "content", F.col("domain_type"), F.when(F.size("structured_data") > 0, F.col("structured_data")).alias("structured_data")))
    if kind == "text":
        return F.col("content.plain_text")
    if kind == "llm":
        return F.col("llm_text")
    if kind == "html":
        return F.coalesce("content.raw_html", "content.markdown")
    raise ValueError(kind)


def files(extracted: DataFrame, kind: str) -> DataFrame:
    """out_path and body of each page that did not fail. Equal paths of two hosts collide, as names leave the host out."""
    ok = extracted.filter("error_kind is null")
    return ok.select(urls.file_name(F.col("url"), EXTENSIONS[kind]).alias("out_path"), rendered(kind).alias("body"))


def batch_lines(extracted: DataFrame) -> DataFrame:
    """One JSON text a page: url, ok, and metadata and markdown or the error."""
    ok = F.to_json(F.struct("url", F.lit(True).alias("ok"), "metadata", F.col("content.markdown").alias("markdown")))
    failed = F.to_json(F.struct("url", F.lit(False).alias("ok"), "error"))
    return extracted.select(F.when(F.col("error_kind").isNull(), ok).otherwise(failed).alias("value"))


def response(extracted: DataFrame, *formats: str) -> DataFrame:
    """Only the formats asked for, by name."""
    return extracted.select("url", *(rendered(f).alias(f) for f in formats), "error_kind", "error")


def save_crawl(result, folder: str) -> None:
    """Visited and frontier of a crawl, to be resumed from."""
    result.visited.write.mode("overwrite").parquet(f"{folder}/visited")
    result.frontier.write.mode("overwrite").parquet(f"{folder}/frontier")


def load_crawl(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/visited"), spark.read.parquet(f"{folder}/frontier")
