"""Main text of pages by differencing with the nearest page of the same host.

A page's text lines are what its markup leaves: script, style, template and head content and comments go, block tags
end lines, entities are decoded, white space is single. Pages of a host are put in the order of their URL path
(then page_id, then a row number); the nearest page is the one before or after, whichever shares the longer prefix of
the path, the one before if both do alike. The lines of the two are aligned by a longest common subsequence, and
the lines of the page that are on it, which the site repeats, are deleted.

Neighbours are found by a range-partitioned sort of the paths alone, numbered by partition; no host is held by one
task. Lines are compared by 64-bit hashes, so only hashes move between neighbours; the lines stay where they are
written, and the places to keep come to them.

Defined cases: null, empty and markup-only html has no lines and gives an empty text; a null or host-less URL has
the empty host, and a null path is the empty one; the only page of a host keeps all its lines; repeated rows are
pages of their own, so copies next to each other lose all their lines; pages of one path are in the order of page_id, nulls
first, and then of their rows; very long pages are compared whole, in time bounded by their numbers of lines; an empty
table gives no rows. Only page_id, url and html are read, so other columns may have any names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.space import BROADCAST_BYTES, forget, written
from tidemill.llm.tokens import col, slices

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|head|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html"
    r"|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", re.I
)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")
_SPACE = re.compile(r"[^\S\n]+")


def lines_of(page: str | None) -> list[str]:
    if not page:
        return []
    text = _TAG.sub("", _BREAK.sub("\n", _DROP.sub("\n", page).replace("\n", " ")))
    return [line for line in (x.strip() for x in _SPACE.sub(" ", html.unescape(text)).split("\n")) if line]


#: Bits of rows kept at once while a subsequence is traced; longer inputs are halved first.
TRACE_BITS = 1 << 28


def _row(v: int, places: dict, line: object, full: int) -> int:
    """The next row of the bit-parallel table: bit j is 0 where the longest common subsequence grows at b[j]."""
    match = v & places.get(line, 0)
    return ((v + match) | (v - match)) & full


def _places(b: list) -> dict:
    at: dict[object, int] = {}
    for j, line in enumerate(b):
        at[line] = at.get(line, 0) | 1 << j
    return at


def _lengths(a: list, b: list) -> list[int]:
    """For each prefix of b the length of its longest common subsequence with a."""
    full, at = (1 << len(b)) - 1, _places(b)
    v = full
    for line in a:
        v = _row(v, at, line, full)
    out, bits = [0], bin(v | 1 << len(b))[:2:-1]
    for bit in bits:
        out.append(out[-1] + (bit == "0"))
    return out


def _traced(a: list, b: list, first: int, on: list[bool]) -> None:
    """Mark the places from first on of a's lines that are on a longest common subsequence with b."""
    if not a or not b:
        return
    if len(a) > 1 and len(a) * len(b) > TRACE_BITS:
        half = len(a) // 2
        head, tail = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: head[j] + tail[j])
        _traced(a[:half], b[:cut], first, on)
        _traced(a[half:], b[cut:], first + half, on)
        return
    full, at, rows = (1 << len(b)) - 1, _places(b), []
    v = full
    for line in a:
        v = _row(v, at, line, full)
        rows.append(bin(v | 1 << len(b))[:2:-1] if len(b) < 64 else v.to_bytes(len(b) // 8 + 1, "little"))
    grows = (lambda i, j: rows[i][j] == "0") if len(b) < 64 else lambda i, j: not rows[i][j >> 3] >> (j & 7) & 1
    i, j = len(a), len(b)
    while i and j:
        if not grows(i - 1, j - 1):
            j -= 1
        else:
            i -= 1
            if not i or not grows(i - 1, j - 1):
                j -= 1
                on[first + i] = True


def common(a: list, b: list) -> list[bool]:
    """Which of a's lines are on a longest common subsequence with b: of equal ones, that of a's last lines before b's.

    Equal ends are cut off, and lines that only one has; the rest goes through the bit-parallel table, a machine word of
    b's lines at once, so the cost is bounded by the lengths, however often a line is repeated.
    """
    on = [False] * len(a)
    low, high_a, high_b = 0, len(a), len(b)
    while low < min(high_a, high_b) and a[low] == b[low]:
        on[low] = True
        low += 1
    while high_a > low and high_b > low and a[high_a - 1] == b[high_b - 1]:
        high_a, high_b = high_a - 1, high_b - 1
        on[high_a] = True
    in_a, in_b = set(a[low:high_a]), set(b[low:high_b])
    at = [i for i in range(low, high_a) if a[i] in in_b]
    marks = [False] * len(at)
    _traced([a[i] for i in at], [x for x in b[low:high_b] if x in in_a], 0, marks)
    for i, mark in zip(at, marks, strict=True):
        on[i] = mark
    return on


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit(""))
    return host, path


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["rid", "page_id", "host", "path", "lines", "hashes"]
    for batch in batches:
        for part in slices(batch, "html"):
            lines = [lines_of(x) for x in col(part, "html").to_pylist()]
            hashes = [[xxhash.xxh64_intdigest(x) - (1 << 63) for x in page] for page in lines]
            keep = [col(part, c) for c in names[:4]]
            yield pa.record_batch([*keep, pa.array(lines, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))], names=names)


def neighbours(pages: DataFrame) -> DataFrame:
    """rid, and near: the rid of the nearest page of the host, for each page of a host of several."""
    ordered = pages.select("host", "path", "page_id", "rid")
    n = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = ordered.repartitionByRange(n, "host", "path", "page_id", "rid").sortWithinPartitions("host", "path", "page_id", "rid")
    ordered = ordered.withColumn("part", F.spark_partition_id()).withColumn("local", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ordered = written(ordered, "html-order")
    offset, base = [], 0
    sizes = dict(ordered.groupBy("part").count().collect())
    for part in range(max(sizes, default=-1) + 1):
        offset.append(base)
        base += sizes.get(part, 0)
    place = F.col("local") + F.array(*map(F.lit, offset or [0]))[F.col("part")]
    at = written(ordered.select("rid", "host", "path", place.alias("at")), "html-places")
    forget(ordered)
    beside = at.select(F.col("at").alias("beside"), F.col("rid").alias("near"), F.col("host").alias("h"), F.col("path").alias("p"))
    steps = at.select("rid", "host", "path", "at", F.explode(F.array(F.lit(-1), F.lit(1))).alias("step")).withColumn("beside", F.col("at") + F.col("step"))
    both = steps.join(beside, "beside").filter("host = h")
    shared = _shared_prefix(F.col("path"), F.col("p"))
    return both.groupBy("rid").agg(F.max_by("near", F.struct(shared, -F.col("step"))).alias("near"))


def _shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    size = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), size), lambda k: F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1)))
    return F.when(size > 0, F.coalesce(F.get(differ, F.lit(0)) - 1, size)).otherwise(0)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [common(a, b) for a, b in zip(col(batch, "hashes").to_pylist(), col(batch, "other").to_pylist(), strict=True)]
        yield pa.record_batch([col(batch, "rid"), col(batch, "near_id"), pa.array(shared, pa.list_(pa.bool_()))], names=["rid", "near_id", "shared"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, near_id (page_id of the nearest page, or null), n_lines, n_shared and text of each row."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", host.alias("host"), path.alias("path"), "html")
    schema = "rid long, page_id long, host string, path string, lines array<string>, hashes array<long>"
    lined = written(rows.mapInArrow(_lined, schema), "html-lines")
    near = written(neighbours(lined), "html-near")
    other = lined.select(F.col("rid").alias("near"), F.col("page_id").alias("near_id"), F.col("hashes").alias("other"))
    pairs = near.join(other, "near").join(lined.select("rid", "hashes"), "rid").select("rid", "near_id", "hashes", "other")
    shared = written(pairs.mapInArrow(_aligned, "rid long, near_id long, shared array<boolean>"), "html-shared")
    forget(near)
    size = shared.agg(F.sum(F.size("shared") + 64)).first()[0] or 0  # what a row takes grows with its lines
    out = lined.select("rid", "page_id", "lines").join(F.broadcast(shared) if size <= BROADCAST_BYTES else shared, "rid", "left")
    gone = F.coalesce("shared", F.array().cast("array<boolean>"))
    kept = F.filter("lines", lambda _, k: ~F.coalesce(F.get(gone, k), F.lit(False)))
    n_shared = F.size(F.filter(gone, lambda x: x))
    return out.select("page_id", "near_id", F.size("lines").alias("n_lines"), n_shared.alias("n_shared"), F.array_join(kept, "\n").alias("text"))
