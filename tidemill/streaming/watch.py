"""Watching pages: a stream of snapshots, and the changes against the last that differed.

State for each page is one snapshot. It is replaced only when the page changes, and rows older than it are dropped;
failed fetches (a null markdown) are skipped. The first snapshot of a page is kept silently, or reported as New.

The keyed state is that of a bucket of pages, as Spark hands a key to Python at the cost of some milliseconds, and all that
of a bucket is read and written at once: buckets should be many enough that the snapshots of one fit a worker's memory.
Their number is part of the checkpoint, and must stay as it was when the stream began.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill import schemas
from tidemill.operators.changes import unified

OUTPUT = "url string, at long, status string, text_diff string, metadata_changes string, word_count_delta long"
STATE = "snapshots binary"
BUCKETS = 4096


def _changes(old: str, new: str) -> str:
    a, b = json.loads(old), json.loads(new)
    return json.dumps([{"field": f, "old": a.get(f), "new": b.get(f)} for f in schemas.METADATA_FIELDS if a.get(f) != b.get(f)], ensure_ascii=False)


def watch(snapshots: DataFrame, report_new: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Change rows of a stream, or a batch, of url, ts, markdown, metadata (struct)."""

    def step(_: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last: dict[str, tuple[int, str, str, int]] = pickle.loads(state.get[0]) if state.exists else {}
        rows = [r for b in batches for r in zip(*(b[c].tolist() for c in ("url", "at", "markdown", "about", "words")), strict=True)]
        out, moved = [], False
        for url, at, markdown, about, words in sorted(rows, key=lambda r: r[1]):
            kept = last.get(url)
            if kept is not None and (at < kept[0] or (markdown, about) == kept[1:3]):
                continue
            if kept is not None:
                out.append((url, at, "Changed", unified(kept[1], markdown), _changes(kept[2], about), words - kept[3]))
            elif report_new:
                out.append((url, at, "New", None, "[]", 0))
            last[url], moved = (at, markdown, about, words), True
        if moved:
            state.update((pickle.dumps(last),))
        yield pd.DataFrame(out, columns=["url", "at", "status", "text_diff", "metadata_changes", "word_count_delta"])

    about = F.to_json(F.struct(*(F.col(f"metadata.{f}") for f in schemas.METADATA_FIELDS)), {"ignoreNullFields": "false"})
    words = F.coalesce(F.col("metadata.word_count").cast("long"), F.lit(0)) if "word_count" in snapshots.schema["metadata"].dataType.names else F.lit(0)
    rows = snapshots.filter("url is not null and ts is not null and markdown is not null").select(
        F.pmod(F.xxhash64("url"), F.lit(buckets)).alias("bucket"), "url", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "markdown", about.alias("about"),
        words.cast("long").alias("words"),
    )
    found = rows.groupBy("bucket").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    return found.select("url", F.timestamp_micros("at").alias("ts"), "status", "text_diff", "metadata_changes", "word_count_delta")


def on_change(changes: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Run act on each batch of changes: a webhook, a command, a table. Off unless called. A batch is worked out once."""

    def some(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                act(batch, epoch)
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(some).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
