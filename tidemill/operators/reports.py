"""Counters, percentiles, token savings and fact checks over frames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import schemas
from tidemill.functions import predicates
from tidemill.functions.tree import parse
from tidemill.operators.batches import flat_map_rows, spread
from tidemill.operators.extraction import extract_pages


#: Bytes of facts that go to all tasks at once.
BROADCAST_BYTES = 16 << 20


def counters(extracted: DataFrame, *keys: str) -> DataFrame:
    """total, ok and errors."""
    failed = F.count_if(F.col("error_kind").isNotNull())
    return extracted.groupBy(*keys).agg(F.count("*").alias("total"), (F.count("*") - failed).alias("ok"), failed.alias("errors"))


def percentiles(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Whole-number mean, nearest-rank p50, p90 and p99, and the greatest value."""
    kind = df.schema[column].dataType
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by {column})").cast(kind)
    mean = F.expr(f"sum({column}) div count({column})")
    return df.groupBy(*keys).agg(mean.alias("mean"), *(at(q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)), F.max(column).alias("max"))


def median_of_runs(runs: DataFrame, site: str, value: str) -> DataFrame:
    """Mean over sites of each site's median."""
    return runs.groupBy(site).agg(F.median(value).alias("median")).agg(F.avg("median").alias("mean_of_medians"))


def token_report(pages: DataFrame, key: str) -> DataFrame:
    """Tokens and bytes of source and compact text, and the share saved, rounded to a tenth of a percent.

    The source is measured before it is extracted, so a page is read once and none of it is joined.
    """
    raw = predicates.approx_tokens(F.col("html")).alias("raw_tokens"), F.octet_length("html").alias("raw_bytes")
    rows = extract_pages(pages.select(key, "url", "html", *raw), parts=("llm_text",)).filter("error_kind is null")
    small = predicates.approx_tokens(F.col("llm_text")).alias("llm_tokens"), F.octet_length("llm_text").alias("llm_bytes")
    rows = rows.select(key, "raw_tokens", "raw_bytes", *small)
    return rows.withColumn("reduction_pct", F.round(F.when(F.col("raw_tokens") > 0, 100 * (1 - F.col("llm_tokens") / F.col("raw_tokens"))).otherwise(0.0), 1))


_WORD = re.compile("[a-z][a-z0-9]*")
_FOUND = re.compile("[A-Za-z0-9]")


def _counter(facts: list[tuple[str, int]]) -> Callable[[str], int]:
    """How many of the facts, each so many times, a text in lower case has, by one walk over it."""
    machine = ahocorasick.Automaton()
    for fact, n in facts:
        if fact:
            machine.add_word(fact, (fact, n, _WORD.fullmatch(fact) is not None))
    machine.make_automaton() if len(machine) else None

    def count(text: str) -> int:
        hit: dict[str, int] = {}
        for end, (fact, n, word) in machine.iter(text) if len(machine) else ():
            if fact in hit:
                continue
            begin = end - len(fact)
            if word and (begin >= 0 and _FOUND.match(text[begin]) or _FOUND.match(text, end + 1)):
                continue
            hit[fact] = n
        return sum(hit.values())

    return count


def fact_hits(texts: DataFrame, facts: DataFrame, key: str, text: str = "text", fact: str = "fact") -> DataFrame:
    """found and total facts of each text: facts by key, or, without the key in them, all facts for all texts.

    Facts for all texts go to all tasks as one automaton, in portions of BROADCAST_BYTES, and each text is walked once a
    portion, however many facts there are.
    """
    if key in facts.columns:
        hit = predicates.matches_fact(F.col(text), F.col(fact))
        return texts.join(facts, key).groupBy(key).agg(F.count_if(hit).alias("found"), F.count("*").alias("total"))
    each = facts.groupBy(F.lower(fact).alias("fact")).agg(F.count("*").alias("n"))
    size = each.agg(F.sum(F.octet_length("fact") + 16).alias("bytes"), F.sum("n").alias("n")).first()
    portions = -(-(size["bytes"] or 0) // BROADCAST_BYTES) or 1
    rows = spread(texts.select(key, F.lower(text).alias("_text")))
    parts = []
    for k in range(portions):
        some = each.filter("fact is not null").filter(F.pmod(F.xxhash64("fact"), F.lit(portions)) == k).collect()
        sent = texts.sparkSession.sparkContext.broadcast([(r.fact, r.n) for r in some])
        parts.append(_counted(rows, key, sent))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    total = F.count("*") * F.lit(size["n"] or 0) / F.lit(portions)
    return found.groupBy(key).agg(F.sum("found").alias("found"), total.cast("long").alias("total")).filter("total > 0")


def _counted(rows: DataFrame, key: str, sent: Broadcast[list[tuple[str, int]]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(sent.value)
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], names=[key, "found"])

    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("found", T.LongType())]))


def anchors(pages: DataFrame, *keep: str) -> DataFrame:
    """Every anchor with a target in a page, furniture or not, as written: pos, href, text."""
    schema = schemas.fields(pos=T.IntegerType(), href=T.StringType(), text=T.StringType())

    def one(html: str | None) -> list[dict[str, Any]]:
        found = [a for a in parse(html or "").elements("a") if "href" in a.attrs]
        return [{"pos": k, "href": a.attrs["href"], "text": a.words} for k, a in enumerate(found)]

    return flat_map_rows(spread(pages), ["html"], one, schema, list(keep))


def dedup_by_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """The first document, by key, of each fingerprint, or of each first so many words; shorter texts count whole."""
    print_ = predicates.fingerprint(F.col(text))
    if words:
        print_ = F.coalesce(predicates.prefix_fingerprint(print_, words), print_)
    # only a hash of the fingerprint moves
    rows = docs.select(key, F.xxhash64(print_).alias("h1"), F.hash(print_).alias("h2"))
    return rows.groupBy("h1", "h2").agg(F.min(key).alias(key), F.count("*").alias("n")).select(key, "n")
