"""A query for each case: the operator over the made inputs of all rows, against the results that its templates give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import extraction, records
from tidemill.operators.batches import spread
from tidemill.plans.cases import CASES, Case

Query = Callable[[SparkSession, str], DataFrame]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, k and w of every customer, over all cores before anything is made of them.

    Columns that count as nondeterministic keep filters on what is made of them from moving below, to the few tasks of the file.
    """
    key = F.col("c_custkey")
    made = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("row"), (key + 10000).cast("string").alias("k"), F.lower("c_mktsegment").alias("w"))
    return spread(made).select(*(F.when(F.spark_partition_id() >= 0, F.col(c)).alias(c) for c in made.columns))


def _pages(made: DataFrame, case: Case, names: list[str]) -> DataFrame:
    options = extraction.Options(**{k: v for k, v in case.options.items() if k in ("include", "exclude", "only_main")})
    asked = {"title": "metadata", "words": "metadata", "metadata": "metadata", "domain_type": "domain_type", "structured_data": "structured_data", "llm_text": "llm_text"}
    parts = tuple(dict.fromkeys(["content", *(asked.get(name, "content") for name in names)]))  # a count of words is that of the content
    got = extraction.extract_pages(made, options, parts)
    of = {
        "markdown": F.col("content.markdown"), "plain_text": F.col("content.plain_text"), "llm_text": F.col("llm_text"), "domain_type": F.col("domain_type"),
        "title": F.col("metadata.title"), "words": F.col("metadata.word_count").cast("string"), "metadata": F.to_json("metadata"),
        "structured_data": F.to_json("structured_data"), **{c: F.to_json(f"content.{c}") for c in ("links", "images", "code_blocks")},
    }
    return got.select("row", *(of[name].alias(name) for name in names))


def _run(case: Case) -> Query:
    names = list(dict.fromkeys(k for _, want in case.variants for k in want))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = rows(spark, sf_dir).select("row", *(c.alias(name) for name, c in case.inputs().items()))
        if case.kind == "page":
            return _pages(made, case, names)
        if case.kind == "body":
            return extraction.compact_text(made, "text").select("row", "llm_text", F.to_json("links").alias("links"))
        return records.records(made, case.options["vertical"]).select("row", "record", "error")

    query.__name__, query.__doc__ = case.name, f"{case.covers}: {case.kind} made of each customer."
    return query


QUERIES: dict[str, Query] = {case.name: _run(case) for case in CASES}
ORACLES: dict[str, str] = {case.name: case.sql() for case in CASES}
