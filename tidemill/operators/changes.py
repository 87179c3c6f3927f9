"""Differences between snapshots of pages."""

from __future__ import annotations

import difflib
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import schemas

METADATA_CHANGE = "array<struct<field:string,old:string,new:string>>"


def unified(old: str | None, new: str | None) -> str | None:
    """Line diff with three lines of context; None if the texts are equal."""
    if old == new:
        return None
    a, b = ((t or "").splitlines(keepends=True) for t in (old, new))
    out = []
    for line in difflib.unified_diff(a, b, "old", "new", n=3):
        line = line.replace("\t\n", "\n") if line.startswith(("---", "+++")) else line
        out.append(line if line.endswith("\n") else f"{line}\n\\ No newline at end of file\n")
    return "".join(out) or None


@F.pandas_udf(T.StringType())
def text_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([unified(a, b) for a, b in zip(old, new, strict=True)], dtype=object)


def metadata_changes(old: Column, new: Column) -> Column:
    """Fields that differ, nulls being values, in their fixed order."""
    each = [F.struct(F.lit(f).alias("field"), old[f].alias("old"), new[f].alias("new")) for f in schemas.METADATA_FIELDS]
    return F.filter(F.array(*each), lambda c: ~c["old"].eqNullSafe(c["new"]))


def links_without(links: Column, others: Column) -> Column:
    """Links whose target the others lack; order and repeats stay. The others' targets are listed once a page."""
    targets = F.array(F.array_distinct(F.transform(others, lambda o: o["href"])))
    return F.transform(targets, lambda known: F.filter(links, lambda x: ~F.coalesce(F.array_contains(known, x["href"]), F.lit(False))))[0]


def compare(old: Column, new: Column) -> list[Column]:
    """status, text_diff, metadata_changes, links_added, links_removed and word_count_delta of two snapshots.

    A snapshot is a struct of markdown, links and metadata. Links alone leave the status Same.
    """
    md = lambda s: F.coalesce(s["markdown"], F.lit(""))
    none = F.array().cast("array<struct<text:string,href:string>>")
    links = lambda s: F.coalesce(s["links"], none)
    words = lambda s: F.coalesce(s["metadata"]["word_count"], F.lit(0))
    changed = metadata_changes(old["metadata"], new["metadata"])
    same = (md(old) == md(new)) & (F.size(changed) == 0)
    return [
        F.when(same, "Same").otherwise("Changed").alias("status"),
        F.when(md(old) != md(new), text_diff(md(old), md(new))).alias("text_diff"),
        changed.alias("metadata_changes"),
        links_without(links(new), links(old)).alias("links_added"),
        links_without(links(old), links(new)).alias("links_removed"),
        (words(new) - words(old)).alias("word_count_delta"),
    ]


def snapshot(extracted: DataFrame) -> DataFrame:
    """A snapshot column of extracted pages, other columns kept."""
    parts = F.struct(F.col("content.markdown").alias("markdown"), F.col("content.links").alias("links"), F.col("metadata"))
    return extracted.withColumn("snapshot", parts)


def diff(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """Changes of each page in both frames of key and snapshot; with status New for one that only the new has."""
    a, b = old.select(key, F.col("snapshot").alias("_old")), new.select(key, F.col("snapshot").alias("_new"))
    rows = b.join(a, key, "left")
    parts = compare(F.col("_old"), F.col("_new"))
    status = F.when(F.col("_old").isNull(), "New").otherwise(parts[0]).alias("status")
    return rows.select(key, status, *parts[1:])


def history(snapshots: DataFrame, key: str = "url", at: str = "ts") -> DataFrame:
    """Each snapshot against the one before it of the same page, the first as New."""
    w = Window.partitionBy(key).orderBy(at)
    rows = snapshots.withColumn("_old", F.lag("snapshot").over(w))
    parts = compare(F.col("_old"), F.col("snapshot"))
    status = F.when(F.col("_old").isNull(), "New").otherwise(parts[0]).alias("status")
    return rows.select(key, at, status, *parts[1:])


def link_changes(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """Rows of key, change, text, href from link rows: anti joins on the target alone."""
    added = new.join(old.select(key, "href").distinct(), [key, "href"], "left_anti").withColumn("change", F.lit("added"))
    removed = old.join(new.select(key, "href").distinct(), [key, "href"], "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed).select(key, "change", "text", "href")


def as_dict(row: Any) -> dict[str, Any]:
    return row.asDict(recursive=True)
