"""Cross-entropy difference by matched n-gram models.

Target is the documents labelled quality 1, background all documents. Both models have one vocabulary, the words of
all documents, one order, two, and one smoothing:
    p(w | v) = A * pairs(v, w) / follow(v) + B * words(w) / words + C / V
where follow(v) is the number of words after v, V the number of different words in the background, and the first word
of a document, or one after a word that the model has not seen followed, has (A + B) in place of B. A document's
score is its mean loss under the target less that under the background: the lower, the more like the target.

Every word and word pair of the corpus is counted, by 64-bit hashes, in tables that grow with the input; none are
sampled and none share a slot. Texts are read once, in chunks of CHUNK_BYTES, and kept as places in each chunk's sorted
different words. A chunk asks for the counts of its different words and pairs once, whatever their number in it: it
sends them, sorted, to the parts that own ranges of hashes; a part adds up what all chunks have of a hash, and answers
each chunk in the order in which it asked, so that no hash travels back. A hot word or pair is one entry a chunk.
Labels meet the ids of documents, never their texts. No table is collected or held whole by a task.

Defined cases: null, empty and wordless texts have no tokens and null losses and score; repeated rows are counted
and scored each for itself; a null doc_id is background only. Without target documents p is C / V in the target. A text
longer than a chunk is a chunk of its own, read in slices. Ties need no order, as each row is scored alone. An empty
table gives no rows. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.space import BROADCAST_BYTES, checked, forget, written
from tidemill.llm.tokens import Words, col, mix64, slices, words_of

A, B, C = 0.6, 0.35, 0.05
CHUNK_BYTES = 1 << 22
#: Words of the corpus for each part that adds up counts.
PART_WORDS = 1_000_000
SCORES = "doc_id long, n_words long, loss_target double, loss_background double, score double"


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v * np.uint64(0x9E3779B97F4A7C15) + w)


def slots(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word; for each word but the first of a document, its place and its pair's hash."""
    place = _inner(w.counts)
    return w.hashes, place, _pair(w.hashes[place - 1], w.hashes[place])


def _inner(counts: np.ndarray) -> np.ndarray:
    """Places of words that another word of their document precedes."""
    inner = np.ones(int(counts.sum()), bool)
    inner[(np.cumsum(counts) - counts)[counts > 0]] = False
    return np.flatnonzero(inner)


def planes(x: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones, and so on: small values leave runs of zeros to the codec."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids: list[pa.Array] = []
    hashes: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def whole() -> pa.RecordBatch:
        word, at = np.unique(np.concatenate(hashes), return_inverse=True)
        n, own = np.concatenate(counts), pa.concat_arrays(ids)
        one = [pa.array([number]), pa.array([len(at)]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)]
        one += [pa.array([x], pa.binary()) for x in (planes(n.astype(np.int32)), planes(word), planes(at.astype(np.int32)))]
        return pa.record_batch(one, names=["chunk", "n_words", "doc_ids", "counts", "words", "stream"])

    size = 0
    for batch in batches:
        for part in slices(batch):
            w = words_of(col(part, "text"))
            if size and size + len(w.data) > CHUNK_BYTES:
                yield whole()
                number, size = number + 1, 0
                ids, hashes, counts = [], [], []
            ids.append(col(part, "doc_id"))
            hashes.append(w.hashes)
            counts.append(w.counts)
            size += max(len(w.data), 1)
    if ids:
        yield whole()


def _opened(batch: pa.RecordBatch | pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Words per document, different words, place of each word in them, places of words after another; and of the pairs
    there the different ones, one place of each, and which each is."""
    read = lambda name, kind: unplaned(batch.column(name)[k].as_py(), kind)
    counts, word, at = read("counts", np.int32).astype(np.int64), read("words", np.uint64), read("stream", np.int32)
    place = _inner(counts)
    return counts, word, at, place, np.unique(_pair(word[at[place - 1]], word[at[place]]), return_index=True, return_inverse=True)


def requests(chunks: DataFrame, parts: int) -> DataFrame:
    """part, chunk, keys and counts: what each chunk has of the words (parts from 0) and pairs (from parts on) of a range."""
    edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    names = ["part", "chunk", "keys", "counts"]

    def cut(first: int, chunk: int, keys: np.ndarray, counts: list[np.ndarray]) -> Iterator[tuple]:
        bounds = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            run = slice(bounds[p], bounds[p + 1])
            yield first + p, chunk, planes(keys[run]), planes(np.concatenate([c[run] for c in counts]).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                counts, word, at, place, (pair, _, which) = _opened(batch, k)
                target = np.zeros(len(counts), bool)
                target[batch.column("marked")[k].as_py() or []] = True
                target = np.repeat(target, counts)
                n = lambda x, size: [np.bincount(x, minlength=size)]
                of_words = n(at, len(word)) + n(at[target], len(word)) + n(at[place - 1], len(word)) + n(at[place - 1][target[place]], len(word))
                of_pairs = n(which, len(pair)) + n(which[target[place]], len(pair))
                chunk = batch.column("chunk")[k].as_py()
                rows = [*cut(0, chunk, word, of_words), *cut(parts, chunk, pair, of_pairs)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    return chunks.select("chunk", "counts", "words", "stream", "marked").mapInArrow(run, "part int, chunk long, keys binary, counts binary")


def answers(asked: DataFrame, parts: int) -> DataFrame:
    """For each request chunk, part and totals, in its order; and for each part of words its sums, with a null chunk."""

    def run(group: pa.Table) -> pa.Table:
        part, chunks = group.column("part")[0].as_py(), group.column("chunk").to_pylist()
        keys = [unplaned(x.as_py(), np.uint64) for x in group.column("keys")]
        counts = [unplaned(x.as_py(), np.int32).reshape(-1, len(k)) for x, k in zip(group.column("counts"), keys, strict=True)]
        uniq, which = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.stack([np.bincount(which, c, len(uniq)).astype(np.int64) for c in np.concatenate(counts, axis=1)])
        ends = np.cumsum([len(k) for k in keys])
        told = [planes(totals[:, which[e - len(k) : e]].ravel()) for k, e in zip(keys, ends, strict=True)]
        sums = [None] * 3
        if part < parts:
            chunks, told, sums = [*chunks, None], [*told, None], [len(uniq), int(totals[0].sum()), int(totals[1].sum())]
        rows = {"chunk": pa.array(chunks, pa.int64()), "part": pa.array([part] * len(chunks), pa.int32()), "told": pa.array(told, pa.binary())}
        blank = [None] * (len(chunks) - 1)
        return pa.table(rows | {name: pa.array([*blank, x], pa.int64()) for name, x in zip(("size", "n", "n_target"), sums, strict=True)})

    return asked.groupBy("part").applyInArrow(run, "chunk long, part int, told binary, size long, n long, n_target long")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background and score, their difference, of each row."""
    rows = docs.select("doc_id", F.lower("text").alias("text"))
    schema = "chunk long, n_words long, doc_ids array<long>, counts binary, words binary, stream binary"
    chunks = written(rows.mapInArrow(_chunked, schema), "lm-chunks", "zstd")
    parts = max(1, -(-(chunks.agg(F.sum("n_words")).first()[0] or 0) // PART_WORDS))
    good = labels.filter("label = 1").select("doc_id").distinct()
    marks = chunks.select("chunk", F.posexplode("doc_ids").alias("place", "doc_id")).join(checked(good), "doc_id", "left_semi")
    marks = written(marks.groupBy("chunk").agg(F.collect_list("place").alias("marked")), "lm-marks")
    size = marks.agg(F.sum(F.size("marked") * 4 + 32)).first()[0] or 0
    marked = chunks.join(F.broadcast(marks) if size <= BROADCAST_BYTES else marks, "chunk", "left")
    got = written(answers(requests(marked, parts), parts), "lm-answers", "zstd")
    forget(marks)
    sums = got.filter("chunk is null").agg(*(F.sum(c).alias(c) for c in ("size", "n", "n_target"))).first()
    base = C / max(sums["size"] or 0, 1)
    total = {"_target": max(sums["n_target"] or 0, 1), "": max(sums["n"] or 0, 1)}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), *((c, pa.float64()) for c in ("loss_target", "loss_background", "score"))])
        if not left.num_rows:
            return schema.empty_table()
        counts, word, at, place, (pair, first, which) = _opened(left, 0)
        told = sorted(zip(right.column("part").to_pylist(), right.column("told"), strict=True), key=lambda x: x[0])
        whole = lambda some, k: np.concatenate([unplaned(x.as_py(), np.int64).reshape(k, -1) for x in some] or [np.zeros((k, 0), np.int64)], axis=1)
        n, n_target, follow, follow_target = whole([x for p, x in told if p < parts], 4)
        met, met_target = whole([x for p, x in told if p >= parts], 2)
        v, w = at[place - 1][first], at[place][first]

        def losses(n: np.ndarray, follow: np.ndarray, met: np.ndarray, total: int) -> np.ndarray:
            unigram, after = n / total, follow[v]
            p = np.where(after > 0, A * met / np.maximum(after, 1) + B * unigram[w], (A + B) * unigram[w])
            out = -np.log((A + B) * unigram + base)[at]
            out[place] = -np.log(p + base)[which]
            some, means = counts > 0, np.zeros(len(counts))
            means[some] = np.add.reduceat(out, (np.cumsum(counts) - counts)[some]) / counts[some] if some.any() else 0
            return means

        target = losses(n_target, follow_target, met_target, total["_target"])
        back = losses(n, follow, met, total[""])
        none = counts == 0
        columns = [pa.array(x, mask=none) for x in (target, back, target - back)]
        return pa.table([left.column("doc_ids").combine_chunks().flatten(), pa.array(counts), *columns], schema=schema)

    of_chunk = got.filter("chunk is not null").select("chunk", "part", "told").groupBy("chunk")
    return chunks.select("chunk", "doc_ids", "counts", "words", "stream").groupBy("chunk").cogroup(of_chunk).applyInArrow(run, SCORES)
