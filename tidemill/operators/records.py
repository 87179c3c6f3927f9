"""Typed site records of stored replies, and rows of what they hold."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import schemas
from tidemill.functions import verticals
from tidemill.functions.structured import loads
from tidemill.operators.batches import flat_map_rows, map_rows, spread

_s, _n = T.StringType(), T.LongType()
RECORD = schemas.fields(record=_s, error=_s)
NEWS_COMMENT = schemas.fields(id=_n, parent_id=_n, author=_s, text=_s, created_at=_s, depth=T.IntegerType(), path=T.ArrayType(T.IntegerType()))


def _native(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


def is_kind(url: Column, name: str) -> Column:
    return url.rlike(_native(verticals.VERTICALS[name].pattern))


def kind(url: Column) -> Column:
    """The vertical of a URL, of those found by URL alone, in the order of the catalogue; native, so that it can be pushed below the reader."""
    return F.coalesce(*(F.when(is_kind(url, v.name), v.name) for v in verticals.VERTICALS.values() if v.auto))


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(v.name, v.auto, v.pattern) for v in verticals.VERTICALS.values()]
    return spark.createDataFrame(rows, "name string, auto boolean, pattern string")


def records(replies: DataFrame, name: str | None = None) -> DataFrame:
    """vertical, record (JSON) and error for each stored reply (url, payload and perhaps second).

    With a name all rows are read as that vertical, and other URLs are error rows; without one each row is read as
    its URL's, and rows of no vertical go.
    """
    replies = spread(replies)
    rows = replies if "second" in replies.columns else replies.withColumn("second", F.lit(None).cast("string"))
    rows = rows.withColumn("vertical", F.lit(name) if name else kind(F.col("url")))
    rows = rows.filter("vertical is not null").withColumns({"_kind": F.col("vertical"), "_url": F.col("url")})

    def one(kind_: str, url: str | None, payload: str | None, second: str | None) -> dict[str, Any]:
        record, error = verticals.record(kind_, url, payload, second)
        return {"record": record, "error": error}

    return map_rows(rows, ["_kind", "_url", "payload", "second"], one, RECORD)


def news_comments(read: DataFrame, *keep: str) -> DataFrame:
    """A row for each comment of discussion records, its path the place at each level."""

    def walk(comments: list[dict[str, Any]], path: tuple[int, ...]) -> list[dict[str, Any]]:
        out: list[dict[str, Any]] = []
        for k, c in enumerate(comments):
            out.append({f: c.get(f) for f in ("id", "parent_id", "author", "text", "created_at")} | {"depth": len(path), "path": [*path, k]})
            out += walk(c["replies"], (*path, k))
        return out

    rows = read.filter("vertical = 'hackernews' and record is not null")
    return flat_map_rows(rows, ["record"], lambda r: walk(loads(r)["comments"], ()), NEWS_COMMENT, list(keep))


def price_ranges(read: DataFrame, *keys: str) -> DataFrame:
    """Products, cheapest and dearest price and whether any can be had, of product records."""
    product = F.from_json("record", "price_min double, price_max double, any_available boolean, variant_count long")
    rows = read.filter("vertical = 'shopify_product' and record is not null").select(*keys, product.alias("p"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("products"), F.min("p.price_min").alias("price_min"), F.max("p.price_max").alias("price_max"),
        F.bool_or("p.any_available").alias("any_available"), F.sum("p.variant_count").alias("variants"),
    )
