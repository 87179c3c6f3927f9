"""Watching pages: keyed state over runs of a stream, and actions on changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.streaming.watch import on_change, watch


def snapshots(spark, path, rows):
    meta = F.struct(*((F.col("title") if f == "title" else F.lit(None).cast("string")).alias(f) for f in schemas.METADATA_FIELDS), F.col("words").alias("word_count"))
    df = spark.createDataFrame(rows, "url string, at long, markdown string, title string, words long")
    df.select("url", F.timestamp_seconds("at").alias("ts"), "markdown", meta.alias("metadata")).write.mode("append").parquet(path)


def test_state_of_buckets_survives_runs_and_each_change_is_worked_out_once(spark, tmp_path):
    path, seen, worked = str(tmp_path / "in"), [], spark.sparkContext.accumulator(0)

    def run():
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

        def counted(batches):
            for b in batches:
                worked.add(b.num_rows)
                yield b

        found = watch(stream, report_new=True, buckets=2)
        found = found.mapInArrow(counted, found.schema)
        on_change(found, lambda batch, _: seen.extend(batch.collect()), str(tmp_path / "state")).awaitTermination()
        got = sorted((r.url, r.ts.second, r.status, r.word_count_delta) for r in seen)
        seen.clear()
        return got

    first = [(f"p{k}", 1, f"text {k}", "t", 2) for k in range(7)]
    snapshots(spark, path, [*first, ("p0", 3, "later", "t", 1), ("p0", 2, "text 0", "t", 2), ("p1", 2, None, "t", 9), (None, 1, "x", "t", 1)])
    assert run() == sorted([*((f"p{k}", 1, "New", 0) for k in range(7)), ("p0", 3, "Changed", -1)])
    snapshots(spark, path, [("p0", 2, "too old", "t", 5), ("p0", 4, "later", "t", 1), ("p1", 4, "text 1", "u", 2), ("p7", 4, "x", "t", 1), ("p6", 4, "now", None, 1)])
    assert run() == [("p1", 4, "Changed", 0), ("p6", 4, "Changed", -1), ("p7", 4, "New", 0)]
    snapshots(spark, path, [("p6", 5, "now", None, 1), ("p1", 5, "text 1", "u", 2)])
    assert run() == []
    assert worked.value == 8 + 3
