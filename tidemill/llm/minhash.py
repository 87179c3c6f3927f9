"""Document fingerprints by MinHash, with banded joins and verified groups.

The signature of a document is, for each of HASHES universal hash functions (a * x + b, high half), the least
value over its shingles, runs of WIDTH words. Signatures are cut into bands of ROWS values; documents that share
a band are candidates. In each band bucket every member is paired with the least one, so a bucket of n gives
n - 1 pairs and not n * n; pairs are deduplicated and verified, the least-numbered of each document first, by the sizes and
then by the Jaccard similarity of the whole shingle sets (at least SIMILAR). Every pair within a bucket that the groups found so far still keep apart is then
verified as well: the groups are the connected components of all verified candidate pairs.

Documents of one shingle set are one from the start. Defined cases: null doc_ids are left out; null and wordless
texts have no shingles, a null signature and a group of their own; a text shorter than a shingle has one, of all
its words; rows that repeat a doc_id count as one document, of its least set hash; ties go to the least doc_id; very long
texts are read whole, in slices of bytes; an empty table gives no rows. Only doc_id and text are read, so other columns may
have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.groups import components, similar
from tidemill.llm.space import checked, forget, written
from tidemill.llm.tokens import Words, col, distinct, mix64, slices, words_of

HASHES, ROWS, WIDTH, SIMILAR = 100, 5, 3, 0.7
_RANDOM = np.random.default_rng(1997)
_A = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signatures(shingles: np.ndarray, cut: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """HASHES values for each document, of its shingles from cut[d] to cut[d + 1]; the greatest value where there are none."""
    out = np.full((HASHES, len(cut) - 1), 0xFFFFFFFF, np.uint32)
    d = 0
    while d < len(cut) - 1:
        e = max(d + 1, int(np.searchsorted(cut, cut[d] + step, "right")) - 1)
        x, has = shingles[cut[d] : cut[e]], np.flatnonzero(np.diff(cut[d : e + 1])) + d
        if len(has):
            starts = cut[has] - cut[d]
            for k in range(HASHES):
                out[k, has] = np.minimum.reduceat(((x * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), starts)
        d = e
    return out.T


def shingle_sets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, in 48 bits, and each document's bounds in them."""
    h, cut = w.shingles(WIDTH)
    doc, x, _ = distinct(np.repeat(np.arange(w.n_docs), np.diff(cut)), h, 48)
    return x, np.searchsorted(doc, np.arange(w.n_docs + 1))


def set_hashes(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One hash of each set of scrambled shingles."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(x)])
    return mix64((total[cut[1:]] - total[cut[:-1]]) ^ np.diff(cut).astype(np.uint64)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=1 << 20):
            x, cut = shingle_sets(words_of(col(part, "text")))
            x, n = mix64(x), np.diff(cut)
            whole = set_hashes(x, cut)
            signed = pa.FixedSizeListArray.from_arrays(pa.array(signatures(x, cut).view(np.int32).ravel()), HASHES).cast(pa.list_(pa.int32()))
            yield pa.record_batch([col(part, "doc_id"), pa.array(whole), pa.array(n), signed], names=["doc_id", "set_hash", "n_shingles", "signature"])


def signed(docs: DataFrame) -> DataFrame:
    rows = docs.filter("doc_id is not null").select("doc_id", F.lower("text").alias("text"))
    return rows.mapInArrow(_signed, "doc_id long, set_hash long, n_shingles long, signature array<int>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x, cut = shingle_sets(words_of(col(part, "text")))
            x = mix64(x)
            narrow = x.astype(np.uint32)
            sets = [np.unique(narrow[cut[d] : cut[d + 1]]).tobytes() for d in range(len(cut) - 1)]
            yield pa.record_batch([col(part, "doc_id"), pa.array(set_hashes(x, cut)), pa.array(sets, pa.binary())], names=["doc_id", "hash", "set"])


def one_each(prints: DataFrame) -> DataFrame:
    """One row of each doc_id, that of the least set hash; only rows of repeated ids move."""
    repeated = prints.groupBy("doc_id").agg(F.min("set_hash").alias("least"), F.count("*").alias("n")).filter("n > 1")
    repeated = written(repeated.select("doc_id", "least"), "minhash-repeated")
    if repeated.isEmpty():
        return prints
    once = prints.join(checked(repeated), "doc_id", "left_anti")
    chosen = prints.join(checked(repeated), "doc_id").filter("set_hash = least").dropDuplicates(["doc_id"])
    return once.unionByName(chosen.select(*prints.columns))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, signature, group_id (the least doc_id of its group), group_size and n_links, the verified links of
    the document, for each doc_id."""
    prints = one_each(written(signed(docs), "minhash-prints"))
    some = prints.filter("n_shingles > 0")
    same = some.groupBy("set_hash", "n_shingles").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).filter("n > 1")
    pairs = some.select("doc_id", "set_hash", "n_shingles").join(same.drop("n"), ["set_hash", "n_shingles"])
    copies = written(pairs.filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b"), "minhash-copies")
    sets = some.join(checked(copies.select(F.col("a").alias("doc_id"))), "doc_id", "left_anti")
    bands = F.array(*(F.xxhash64(F.lit(k), F.slice("signature", k * ROWS + 1, ROWS)) for k in range(HASHES // ROWS)))
    whole = Window.partitionBy("bucket")
    shared = sets.select("doc_id", "set_hash", "n_shingles", F.explode(bands).alias("bucket"))
    least = F.struct("doc_id", "set_hash", "n_shingles")
    shared = shared.withColumns({"least": F.min(least).over(whole), "most": F.max("doc_id").over(whole)})
    of_least = [F.col(f"least.{c}").alias(n) for c, n in (("doc_id", "b"), ("set_hash", "hash_b"), ("n_shingles", "n_b"))]
    shared = shared.filter("least.doc_id < most").select("bucket", "doc_id", "set_hash", "n_shingles", *of_least)
    shared = written(shared, "minhash-buckets")
    # sets of such a similarity can't differ more in size: an exact test that needs no set
    fits = lambda m, n: (F.col(m) >= SIMILAR * F.col(n)) & (F.col(n) >= SIMILAR * F.col(m))
    def texts_of(wanted: DataFrame) -> DataFrame:
        return docs.select("doc_id", F.lower("text").alias("text")).join(checked(wanted), "doc_id", "left_semi")

    # one link of each document is tried first: of a group of near copies it leaves little to try
    tried = shared.filter((F.col("doc_id") != F.col("b")) & fits("n_shingles", "n_b")).groupBy(F.col("doc_id").alias("a"), F.col("set_hash").alias("hash_a"))
    tried = written(tried.agg(F.min(F.struct("b", "hash_b")).alias("m")).select("a", "hash_a", "m.*"), "minhash-tried")
    true = similar(tried, texts_of, _sets, SIMILAR, "minhash-star")

    # pairs that share a bucket and that no chain of verified pairs joins yet
    found = components(true)
    rooted = shared.join(checked(found.select(F.col("node").alias("doc_id"), "root")), "doc_id", "left")
    rooted = rooted.select("bucket", "doc_id", "set_hash", "n_shingles", F.coalesce("root", "doc_id").alias("root"))
    rooted = rooted.withColumns({"low": F.min("root").over(whole), "high": F.max("root").over(whole)}).filter("low < high")
    x, y = (rooted.select("bucket", F.struct("doc_id", "set_hash").alias(k), F.col("root").alias(f"root_{k}"), F.col("n_shingles").alias(f"n_{k}")) for k in "xy")
    apart = x.join(y, "bucket").filter((F.col("root_x") < F.col("root_y")) & fits("n_x", "n_y")).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    apart = apart.select(*(F.col(c).alias(n) for c, n in (("x.doc_id", "a"), ("x.set_hash", "hash_a"), ("y.doc_id", "b"), ("y.set_hash", "hash_b"))))
    apart = written(apart.join(tried, ["a", "b"], "left_anti").select("a", "hash_a", "b", "hash_b"), "minhash-apart")
    rest = similar(apart, texts_of, _sets, SIMILAR, "minhash-rest")
    edges = written(true.unionByName(rest).unionByName(copies).distinct(), "minhash-links")
    roots = components(edges)
    for done in (copies, shared, tried, true, apart, rest, found):
        forget(done)
    sizes = roots.groupBy(F.col("root").alias("group_id")).agg((F.count("*") + 1).alias("size"))
    out = prints.join(checked(roots.withColumnRenamed("node", "doc_id")), "doc_id", "left").withColumn("group_id", F.coalesce("root", "doc_id"))
    out = out.join(checked(sizes), "group_id", "left").withColumn("group_size", F.coalesce("size", F.lit(1)))
    ends = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("links"))
    out = out.join(checked(ends), "doc_id", "left").withColumn("n_links", F.coalesce("links", F.lit(0).cast("long")))
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("signature")).alias("signature"), "group_id", "group_size", "n_links")
