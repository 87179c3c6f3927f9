"""Groups of linked rows: verified pairs, and connected components by repeated star joins, each round cut by a written table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.space import checked, forget, written
from tidemill.llm.tokens import col


def components(edges: DataFrame, name: str = "groups") -> DataFrame:
    """node and root (the least node of its component) for every node that differs from its root.

    edges has columns a and b, of one integer type, in any order and with repeats. Alternating large-star and
    small-star rounds: the number of rounds grows with the logarithm of the longest chain, and each is two
    shuffles of the edges, which never outnumber those given.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, name)
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = written(small.filter("a <> b").distinct(), name)
        forget(e)
        e = after
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if mark == before or mark[0] == mark[2] and not _chained(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark


def _chained(e: DataFrame) -> bool:
    """Whether some root is itself linked to a lesser node."""
    return not e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def similar(near: DataFrame, texts_of: Callable[[DataFrame], DataFrame], sets_of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], least: float, name: str) -> DataFrame:
    """Of written pairs (a, hash_a, b, hash_b) those whose sets have at least that Jaccard similarity, as a and b, written.

    texts_of gives doc_id and text of the wanted doc_ids; sets_of gives doc_id, hash and set, sorted distinct 32-bit values
    as bytes, from those. Only texts in pairs are read into sets; sets move by a, then with a by b, and never both together.
    """
    wanted = near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct()
    sets = written(texts_of(wanted).mapInArrow(sets_of, "doc_id long, hash long, set binary"), f"{name}-sets")
    if not sets.groupBy("doc_id", "hash").count().filter("count > 1").isEmpty():
        sets = sets.dropDuplicates(["doc_id", "hash"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (p, q) in enumerate(zip(col(batch, "p"), col(batch, "q"), strict=True)):
                both = np.concatenate([np.frombuffer(p.as_buffer(), np.uint32), np.frombuffer(q.as_buffer(), np.uint32)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[k] = common >= least * (len(both) - common)
            mask = pa.array(keep)
            yield pa.record_batch([col(batch, "a").filter(mask), col(batch, "b").filter(mask)], names=["a", "b"])

    p, q = (sets.select(F.col("doc_id").alias(side), F.col("hash").alias(f"hash_{side}"), F.col("set").alias(as_)) for side, as_ in ("ap", "bq"))
    both = near.join(p, ["a", "hash_a"]).join(q, ["b", "hash_b"]).select("a", "b", "p", "q")
    out = written(both.mapInArrow(verify, "a long, b long"), f"{name}-true")
    forget(sets)
    return out
