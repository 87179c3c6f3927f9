"""Near-duplicate groups by SimHash and meet-in-the-middle ball hashing.

A document's fingerprint is BLOCKS * BITS signs of random projections of its distinct words, each weighted by the root
of its count and by the logarithm of how few documents have it, so that texts that share only common words have
unlike fingerprints. Two fingerprints are candidates if some block of BITS bits differs in at most RADIUS places: every
distinct block emits all values within half the radius of it, which are shuffled; two blocks within the radius share
one. In each bucket every member is paired with the least one, so a bucket of n gives n - 1 pairs and not n * n; pairs
are deduplicated and verified, the nearest-numbered of each text first, by the whole fingerprint (at most FAR bits
apart) and by the Jaccard similarity of the word pairs of the whole texts (at least SIMILAR). Then every pair within a
bucket that the groups found so far still keep apart is verified as well: the groups are the connected components of
all verified candidate pairs, no pair being left out.

Frequencies are of all documents, in SLOTS slots of word hashes: common words stand out of a slot's rare ones at every
size of the corpus. Texts of the same words in the same order are one text from the start, by a 64-bit hash and the
number of words. Documents are told apart by doc_id and a hash of the text; one whose doc_id is null, or was taken by
another text of a lesser hash, goes by a number over 2**62 made of both.

Defined cases: a null doc_id takes part like any other; null and wordless texts are in groups of their own, never
compared; rows that repeat both doc_id and text are one document, rows that repeat a doc_id with other texts are
documents of their own; ties between copies go to the least doc_id; very long texts are read whole, in slices of
bytes; an empty table gives no rows; columns of docs other than doc_id and text are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.groups import components, similar
from tidemill.llm.space import checked, forget, written
from tidemill.llm.tokens import Words, col, mix64, slices, words_of

BLOCKS, BITS, RADIUS = 9, 30, 2
FAR, SIMILAR = BLOCKS * BITS * 3 // 10, 0.5
SLOTS = 1 << 16
#: Least weight of a word, as a share of the greatest: the words of a group that holds a third of all rows still count.
COMMON = 0.4
_WORDS = -(-BLOCKS * BITS // 64)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """BLOCKS * BITS random bits of each hash, as 0 and 1."""
    seeds = mix64(np.arange(1, _WORDS + 1, dtype=np.uint64))
    bits = np.unpackbits(mix64(hashes[:, None] ^ seeds[None, :]).view(np.uint8).reshape(len(hashes), 8 * _WORDS), axis=1)
    return bits[:, : BLOCKS * BITS]


def _slot(word: np.ndarray) -> np.ndarray:
    return (word % np.uint64(SLOTS)).astype(np.int64)


def rarity(docs: DataFrame) -> np.ndarray:
    """For each slot the logarithm of how few documents have a word of it, over all documents, and COMMON of the greatest at least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            for part in slices(batch):
                _, word, _ = words_of(col(part, "text")).distinct()
                n[:SLOTS] += np.bincount(_slot(word), minlength=SLOTS)
                n[SLOTS] += part.num_rows
        yield pa.record_batch([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["slot", "n"])

    rows = docs.select(F.lower("text").alias("text")).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    n = np.zeros(SLOTS + 1)
    for slot, k in rows.collect():  # at most SLOTS + 1
        n[slot] = k
    rare = np.log((n[SLOTS] + 1) / np.maximum(n[:SLOTS], 1)).clip(1e-3)
    return np.maximum(rare, COMMON * rare.max()).astype(np.float32)


def fingerprints(w: Words, rare: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """BLOCKS integers of BITS bits for each document; zeros for one without words."""
    doc, word, count = w.distinct()
    weight = np.sqrt(count).astype(np.float32) * rare[_slot(word)]
    out = np.zeros((w.n_docs, BLOCKS * BITS), np.float32)
    cut = np.searchsorted(doc, np.arange(w.n_docs + 1))
    d = 0
    while d < w.n_docs:
        e = max(d + 1, int(np.searchsorted(cut, cut[d] + step, "right")) - 1)
        signs = _signs(word[cut[d] : cut[e]]).astype(np.float32)
        signs -= np.float32(0.5)
        for k in range(d, e):
            out[k] = weight[cut[k] : cut[k + 1]] @ signs[cut[k] - cut[d] : cut[k + 1] - cut[d]]
        d = e
    up = (out > 0).reshape(w.n_docs, BLOCKS, BITS)
    return up @ (np.int64(1) << np.arange(BITS, dtype=np.int64))


def text_hashes(w: Words) -> np.ndarray:
    """A hash of each document's words in their order."""
    local = np.arange(len(w.hashes)) - np.repeat(w.offsets[:-1], w.counts)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(w.hashes + np.uint64(0x9E3779B97F4A7C15) * local.astype(np.uint64)))])
    return mix64((total[w.offsets[1:]] - total[w.offsets[:-1]]) ^ w.counts.astype(np.uint64)).view(np.int64)


def printed(docs: DataFrame, rare: np.ndarray) -> DataFrame:
    """doc_id, content (a hash of the text as it is), text_hash, n_words and prints of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "content", "text_hash", "n_words", "prints"]
        for batch in batches:
            for part in slices(batch):
                w = words_of(col(part, "text"))
                prints = pa.FixedSizeListArray.from_arrays(pa.array(fingerprints(w, rare).ravel()), BLOCKS).cast(pa.list_(pa.int64()))
                yield pa.record_batch([col(part, "doc_id"), col(part, "content"), pa.array(text_hashes(w)), pa.array(w.counts), prints], names=names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("content"), F.lower("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, content long, text_hash long, n_words long, prints array<long>")


def nodes(docs: DataFrame) -> DataFrame:
    """One row for each document: id, doc_id, content, n_rows, text_hash, n_words and prints; written."""
    rows = printed(docs, rarity(docs)).groupBy("doc_id", "content")
    rows = rows.agg(F.first(F.struct("text_hash", "n_words", "prints")).alias("s"), F.count("*").alias("n_rows"))
    rows = written(rows.select("doc_id", "content", "n_rows", "s.*"), "simhash-rows")
    taken = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("content").alias("least"), F.count("*").alias("n"))
    taken = written(taken.filter("n > 1").select("doc_id", "least"), "simhash-taken")
    made = F.shiftrightunsigned(F.xxhash64("doc_id", "content"), 2).bitwiseOR(F.lit(1 << 62))
    other = F.col("doc_id").isNull() | F.coalesce(F.col("content") != F.col("least"), F.lit(False))
    out = rows.join(checked(taken), "doc_id", "left").withColumn("id", F.when(other, made).otherwise(F.col("doc_id"))).drop("least")
    out = written(out, "simhash-prints")
    forget(rows)
    forget(taken)
    return out


def _distance(p: Column, q: Column) -> Column:
    return sum((F.bit_count(p[k].bitwiseXOR(q[k])) for k in range(1, BLOCKS)), F.bit_count(p[0].bitwiseXOR(q[0])))


def ball() -> list[int]:
    """All masks of at most RADIUS // 2 of BITS bits."""
    masks, last = [0], [(0, -1)]
    for _ in range(RADIUS // 2):
        last = [(m | 1 << b, b) for m, top in last for b in range(top + 1, BITS)]
        masks += [m for m, _ in last]
    return masks


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct 32-bit hashes of each text's word pairs, as bytes."""
    for batch in batches:
        for part in slices(batch):
            w = words_of(col(part, "text"))
            h, cut = w.shingles(2)
            h = h.astype(np.uint32)
            sets = [np.unique(h[cut[d] : cut[d + 1]]).tobytes() for d in range(len(cut) - 1)]
            yield pa.record_batch([col(part, "doc_id"), pa.array(text_hashes(w)), pa.array(sets, pa.binary())], names=["doc_id", "hash", "set"])


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of candidate pairs those whose whole fingerprints are near, with both text hashes."""
    of = lambda side: texts.select(*(F.col(c).alias(f"{n}{side}") for c, n in (("id", ""), ("prints", "prints_"), ("text_hash", "hash_"))))
    near = pairs.join(of("a"), "a").join(of("b"), "b").filter(_distance(F.col("prints_a"), F.col("prints_b")) <= FAR)
    return near.select("a", "b", "hash_a", "hash_b")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes() table, root of each id that is not the least of its group, and the links: verified pairs and copies."""
    known = nodes(docs)
    some = known.filter("n_words > 0").select("id", "text_hash", "n_words", "prints")
    same = some.groupBy("text_hash", "n_words").agg(F.min("id").alias("b"))
    copies = written(some.join(same, ["text_hash", "n_words"]).filter("id <> b").select(F.col("id").alias("a"), "b"), "simhash-copies")
    texts = written(some.join(copies.select(F.col("a").alias("id")), "id", "left_anti"), "simhash-texts")

    def texts_of(wanted: DataFrame) -> DataFrame:
        chosen = known.select(F.col("id").alias("doc_id"), F.col("doc_id").alias("own_id"), "content").join(checked(wanted), "doc_id", "left_semi")
        chosen = checked(written(chosen, "simhash-chosen"), 40)
        rows = docs.select(F.col("doc_id").alias("own"), F.xxhash64("text").alias("held"), F.lower("text").alias("text"))
        return rows.join(chosen, F.col("own").eqNullSafe(F.col("own_id")) & (F.col("held") == F.col("content"))).select("doc_id", "text")

    blocks = texts.select("id", F.posexplode("prints").alias("block", "value"))
    blocks = blocks.withColumn("b", F.min("id").over(Window.partitionBy("block", "value")))
    members = written(blocks, "simhash-members")  # a distinct block is named by its least text, b, and emits once
    masks = F.array(*(F.lit(m).cast("long") for m in ball()))
    bucket = F.col("value").bitwiseXOR(F.col("mask")).bitwiseOR(F.shiftleft(F.col("block").cast("long"), BITS))
    spread = members.filter("id = b").select("block", "b", "value", F.explode(masks).alias("mask")).select(bucket.alias("bucket"), "b")
    whole = Window.partitionBy("bucket")
    shared = spread.withColumns({"least": F.min("b").over(whole), "most": F.max("b").over(whole)}).filter("least < most")
    shared = written(shared.select("bucket", "b", "least"), "simhash-buckets")
    star = shared.select(F.col("b").alias("a"), F.col("least").alias("b"))
    star = star.unionByName(members.select(F.col("id").alias("a"), "b")).filter("a <> b").distinct()
    # one link of each text is tried first: of a group of near copies it leaves little to try
    tried = _near(star, texts).groupBy("a", "hash_a").agg(F.min(F.struct("b", "hash_b")).alias("m")).select("a", "hash_a", "m.*")
    tried = written(tried, "simhash-tried")
    true = similar(tried, texts_of, _pairs_of, SIMILAR, "simhash-star")

    # pairs of texts that share a bucket and that no chain of verified pairs joins yet
    found = components(true)
    rooted = members.join(checked(found.select(F.col("node").alias("id"), "root")), "id", "left")
    rooted = written(rooted.select("block", "b", "id", F.coalesce("root", "id").alias("root")), "simhash-rooted")
    kinds = rooted.select("block", "b", "root").distinct()
    where = shared.select("bucket", "b", F.shiftright("bucket", BITS).cast("int").alias("block")).join(kinds, ["block", "b"])
    where = where.withColumns({"low": F.min("root").over(whole), "high": F.max("root").over(whole)}).filter("low < high")
    where = written(where.select("bucket", "block", "b", "root"), "simhash-where")
    side = lambda t, k, *keys: t.select(*keys, F.col("b").alias(f"b{k}"), F.col("root").alias(f"root{k}"))
    met = side(where, 1, "bucket", "block").join(side(where, 2, "bucket"), "bucket").filter("root1 < root2").drop("bucket")
    alone = side(kinds, 1, "block").join(kinds.select("block", F.col("b").alias("b1"), F.col("root").alias("root2")), ["block", "b1"])
    alone = alone.filter("root1 < root2").withColumn("b2", F.col("b1"))
    met = written(met.unionByName(alone).distinct(), "simhash-met")
    of = lambda k, doc: rooted.select("block", F.col("b").alias(f"b{k}"), F.col("root").alias(f"root{k}"), F.col("id").alias(doc))
    apart = met.join(of(1, "x"), ["block", "b1", "root1"]).join(of(2, "y"), ["block", "b2", "root2"])
    apart = apart.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    apart = written(_near(apart.join(tried, ["a", "b"], "left_anti"), texts), "simhash-apart")
    rest = similar(apart, texts_of, _pairs_of, SIMILAR, "simhash-rest")
    edges = written(true.unionByName(rest).unionByName(copies).distinct(), "simhash-links")
    roots = components(edges)
    for done in (texts, copies, members, shared, tried, true, where, met, apart, rest, found, rooted):
        forget(done)
    return known, roots, edges


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id (the least id of its group), keep (whether it is that one) and n_links, the verified links of
    the document, for each document."""
    known, roots, edges = links(docs)
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    out = known.select("id", "doc_id").join(roots.withColumnRenamed("node", "id"), "id", "left").join(ends, "id", "left")
    keep, n = F.col("root").isNull().alias("keep"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    return out.select("doc_id", F.coalesce("root", "id").alias("group_id"), keep, n)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one of each group, and one of rows that repeat doc_id and text."""
    known, roots, edges = links(docs)
    forget(edges)
    gone = known.select("id", F.col("doc_id").alias("own_id"), "content", "n_rows").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    gone = written(gone.filter("root is not null or n_rows > 1").select("own_id", "content", F.col("root").isNotNull().alias("dropped")), "simhash-gone")
    forget(known)
    same = lambda side: docs["doc_id"].eqNullSafe(side["own_id"]) & (F.xxhash64(docs["text"]) == side["content"])
    dropped, repeated = (gone.filter(q) for q in ("dropped", "not dropped"))
    if repeated.isEmpty():
        return docs.join(checked(dropped, 40), same(dropped), "left_anti")
    both = checked(gone, 40)
    once = checked(repeated, 40)
    return docs.join(both, same(both), "left_anti").unionByName(docs.join(once, same(once), "left_semi").dropDuplicates(["doc_id", "text"]))
