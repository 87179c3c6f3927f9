"""Pages to metadata, content, structured data and compact text, and their parts as rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import schemas
from tidemill.functions import page as pages_
from tidemill.functions.compact import llm_text
from tidemill.functions.head import extract_metadata
from tidemill.functions.markdown import plain
from tidemill.functions.noise import NoiseMap
from tidemill.functions.page import ExtractError, Options
from tidemill.functions.structured import dumps
from tidemill.functions.tree import parse
from tidemill.operators.batches import flat_map_rows, map_rows, spread

BODY_CEILING = 50 * 1024 * 1024
PARTS = ("metadata", "content", "domain_type", "structured_data", "llm_text")


def as_row(page: pages_.Page, url: str | None, parts: tuple[str, ...]) -> dict[str, Any]:
    c = page.content
    pairs = lambda items, *names: [dict(zip(names, x, strict=True)) for x in items]
    return {
        "metadata": page.metadata,
        "content": {
            "markdown": c.markdown, "plain_text": c.plain_text, "links": pairs(c.links, "text", "href"),
            "images": pairs(c.images, "alt", "src"), "code_blocks": pairs(c.code_blocks, "language", "code"), "raw_html": c.raw_html,
        },
        "domain_type": page.domain_type,
        "structured_data": [dumps(v) for v in page.structured_data],
        "llm_text": llm_text(page, url) if "llm_text" in parts else None,
    }


def extract_pages(pages: DataFrame, options: Options = Options(), parts: tuple[str, ...] = PARTS, html: str = "html", url: str = "url") -> DataFrame:  # noqa: B008
    """Each page with the parts asked for, error_kind and error; the page source goes, other columns stay.

    One parse per page serves all parts, and parts not asked for are not worked out: metadata alone needs no
    content. Failures are rows: no_content, invalid_url, too_large.
    """
    unknown = set(parts) - set(PARTS)
    if unknown:
        raise ValueError(f"unknown parts: {sorted(unknown)}")
    schema = T.StructType([f for f in schemas.EXTRACTED if f.name in (*parts, "error_kind", "error")])

    def one(source: str | None, address: str | None) -> dict[str, Any]:
        if source is None or source == "":
            return {"error_kind": "no_content", "error": "the page is empty"}
        if len(source) >= BODY_CEILING or len(source) * 4 >= BODY_CEILING and len(source.encode()) >= BODY_CEILING:
            return {"error_kind": "too_large", "error": "the page is over the body ceiling"}
        if parts == ("metadata",):
            return {"metadata": extract_metadata(parse(source), address) | {"word_count": None}}
        try:
            return as_row(pages_.extract(source, address, options), address, parts)
        except ExtractError as e:
            return {"error_kind": e.kind, "error": str(e)}

    rows = spread(pages).withColumn("_url", F.col(url))
    return map_rows(rows, [html, "_url"], one, schema)


def links(extracted: DataFrame, *keep: str) -> DataFrame:
    """A row for each link, with its place: pos, text, href."""
    return extracted.select(*keep, F.posexplode("content.links").alias("pos", "link")).select(*keep, "pos", "link.*")


def images(extracted: DataFrame, *keep: str) -> DataFrame:
    return extracted.select(*keep, F.posexplode("content.images").alias("pos", "image")).select(*keep, "pos", "image.*")


def code_blocks(extracted: DataFrame, *keep: str) -> DataFrame:
    return extracted.select(*keep, F.posexplode("content.code_blocks").alias("pos", "block")).select(*keep, "pos", "block.*")


_FEATURES = schemas.fields(
    node=T.IntegerType(), tag=T.StringType(), text_bytes=T.LongType(), main_tag=T.BooleanType(), main_role=T.BooleanType(),
    good_class=T.BooleanType(), good_id=T.BooleanType(), paragraphs=T.LongType(), link_bytes=T.LongType(),
)


def score_nodes(pages: DataFrame, *keep: str, html: str = "html") -> DataFrame:
    """A row for each content candidate: its features, and the score worked out of them by native expressions."""

    def one(source: str | None) -> list[dict[str, Any]]:
        doc = parse(source or "")
        return [{"node": n.index, "tag": n.tag} | pages_.features(n) for n in pages_.candidates(doc, NoiseMap())]

    found = flat_map_rows(spread(pages), [html], one, _FEATURES, list(keep))
    return found.withColumn("score", node_score())


def node_score() -> Column:
    flag = lambda name, points: F.when(F.col(name), points).otherwise(0.0)
    total = F.log("text_bytes") + flag("main_tag", 50.0) + flag("main_role", 50.0) + flag("good_class", 25.0) + flag("good_id", 25.0) + 3.0 * F.col("paragraphs")
    density = F.col("link_bytes") / F.col("text_bytes")
    main = F.when(density > 0.7, 0.3).when(density > 0.5, 0.5).otherwise(1.0)
    other = F.when(density > 0.5, 0.1).when(density > 0.3, 0.5).otherwise(1.0)
    return F.when(F.col("text_bytes") < 50, 0.0).otherwise(total * F.when(F.col("main_tag") | F.col("main_role"), main).otherwise(other))


def best_nodes(scored: DataFrame, *keys: str) -> DataFrame:
    """The best candidate of each page, the first of equals."""
    return scored.filter("score > 0").groupBy(*keys).agg(F.max_by(F.struct("node", "tag", "score"), F.struct("score", -F.col("node"))).alias("best")).select(*keys, "best.*")


def to_plain(df: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Markdown column replaced by its plain text, as plain_text."""
    return map_rows(df, [markdown], lambda m: {"plain_text": None if m is None else plain(m)}, schemas.fields(plain_text=T.StringType()))


def compact_text(df: DataFrame, markdown: str = "markdown") -> DataFrame:
    """The body pipeline alone: llm_text and the links it took out."""
    from tidemill.functions.cleanup import process_body

    def one(text: str | None) -> dict[str, Any]:
        body, taken = process_body(text or "")
        return {"llm_text": body, "links": [{"text": t, "href": h} for t, h in taken]}

    return map_rows(spread(df), [markdown], one, schemas.fields(llm_text=T.StringType(), links=T.ArrayType(schemas.LINK)))


def metadata_only(pages: DataFrame) -> DataFrame:
    return extract_pages(pages, parts=("metadata",))
