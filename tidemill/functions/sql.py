"""The page and text functions under SQL names: Arrow-batched, so no row crosses to Python alone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidemill.functions import cleanup, compact, verticals
from tidemill.functions.page import ExtractError, Page, extract
from tidemill.functions.tree import parse


LINKS = StructType([StructField("pos", IntegerType()), StructField("text", StringType()), StructField("href", StringType())])


def _page(html: str | None, url: str | None) -> Page | None:
    try:
        return extract(html, url) if html else None
    except ExtractError:
        return None


PARTS = StructType([StructField(c, StringType()) for c in ("markdown", "plain_text", "llm_text", "title")])


@F.pandas_udf(PARTS)
def page_parts(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    """All texts of a page by one parse: what wants several of them takes them from here."""

    def one(h: str | None, u: str | None) -> tuple[str | None, ...]:
        p = _page(h, u)
        return (None,) * 4 if p is None else (p.content.markdown, p.content.plain_text, compact.llm_text(p, u), p.metadata["title"])

    return pd.DataFrame([one(h, u) for h, u in zip(html, url, strict=True)], columns=PARTS.fieldNames(), dtype=object)


@F.pandas_udf(StringType())
def page_markdown(html: pd.Series, url: pd.Series) -> pd.Series:
    got = (_page(h, u) for h, u in zip(html, url, strict=True))
    return pd.Series([p and p.content.markdown for p in got], dtype=object)


@F.pandas_udf(StringType())
def page_text(html: pd.Series, url: pd.Series) -> pd.Series:
    got = (_page(h, u) for h, u in zip(html, url, strict=True))
    return pd.Series([p and p.content.plain_text for p in got], dtype=object)


@F.pandas_udf(StringType())
def llm_text(html: pd.Series, url: pd.Series) -> pd.Series:
    got = ((_page(h, u), u) for h, u in zip(html, url, strict=True))
    return pd.Series([p and compact.llm_text(p, u) for p, u in got], dtype=object)


@F.pandas_udf(StringType())
def compact_markdown(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else cleanup.process_body(t)[0] for t in text], dtype=object)


@F.pandas_udf(StringType())
def site_record(url: pd.Series, payload: pd.Series) -> pd.Series:
    """The record of the URL's vertical; null for no vertical or a payload that it cannot read."""
    return pd.Series([verticals.record(verticals.by_url(u or ""), u, p)[0] for u, p in zip(url, payload, strict=True)], dtype=object)


@F.udtf(returnType=LINKS)
class PageLinks:
    """Every anchor with a target, as written."""

    def eval(self, html: str) -> Iterator[tuple[int, str, str]]:
        anchors = (a for a in parse(html or "").elements("a") if "href" in a.attrs)
        for k, a in enumerate(anchors):
            yield k, a.words, a.attrs["href"]


def register(spark: SparkSession) -> None:
    for function in (page_parts, page_markdown, page_text, llm_text, compact_markdown, site_record):
        spark.udf.register(function.__name__, function)
    spark.udtf.register("page_links", PageLinks)
