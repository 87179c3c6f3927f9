"""Schemas of the extraction results."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _n, _i = T.StringType(), T.LongType(), T.IntegerType()


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


LINK = fields(text=_s, href=_s)
IMAGE = fields(alt=_s, src=_s)
CODE = fields(language=_s, code=_s)
METADATA = fields(
    title=_s, description=_s, author=_s, published_date=_s, language=_s, url=_s, site_name=_s, image=_s, favicon=_s, word_count=_n
)
CONTENT = fields(
    markdown=_s, plain_text=_s, links=T.ArrayType(LINK), images=T.ArrayType(IMAGE), code_blocks=T.ArrayType(CODE), raw_html=_s
)
EXTRACTED = fields(
    metadata=METADATA, content=CONTENT, domain_type=_s, structured_data=T.ArrayType(_s), llm_text=_s, error_kind=_s, error=_s
)
COMMENT = fields(
    id=_s, parent_id=_s, author=_s, body=_s, score=_n, depth=_i, is_op=T.BooleanType(), created_utc=_s, path=T.ArrayType(_i)
)
SITEMAP_ENTRY = fields(url=_s, last_modified=_s, priority=T.DoubleType(), change_freq=_s)
METADATA_FIELDS = [f for f in METADATA.fieldNames() if f != "word_count"]
