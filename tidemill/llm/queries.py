"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontam, html_diff, lm, minhash, packing, pfor, quality, simhash, toxicity, url_filter
from tidemill.llm.space import labels_of, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), labels_of(spark, sf_dir, "quality"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.classify(pages, url_filter.labelled_pages(pages, labels_of(spark, sf_dir, "quality")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), labels_of(spark, sf_dir, "quality"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), labels_of(spark, sf_dir, "toxic"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extracted(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_pfor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.encoded(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_url_filter": op2_url_filter,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_minhash": op7_minhash,
    "op8_html": op8_html,
    "op9_packing": op9_packing,
    "op10_pfor": op10_pfor,
}
ORACLES: dict[str, str] = {}
