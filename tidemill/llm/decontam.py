"""Benchmark decontamination by a distributed positional inverted index.

Training texts are indexed in segments of about SEGMENT_BYTES, each by the task that reads it: for every term, a word's
64-bit hash, the ordered places of its occurrences, a place being the number of words before it in the segment. The
index holds the postings of all terms, not only of those of one benchmark, so it is written to the shared folder once
and serves any number of benchmarks; it is searched segment by segment, and only the lists of the terms asked for
are unpacked. For the search a place is moved by a gap for each document before it, in 64 bits, so that no phrase or
window reaches over the end of a document, whatever the length of the longest item.

Phrase: a run of PHRASE words of an item (all of it, if shorter) occurs in a document, word for word. The lists of
the run's terms, each moved back by the term's offset, are intersected from the shortest on. matched is the
longest run of the item's words that such phrases at one alignment make up.
Proximity, of items of NEAR words or more (fewer words would have to occur all, next to each other, as a phrase does):
at least SHARE of an item's distinct terms occur within SPAN times its length. Every such window holds one of the
rarest terms, as many as may be missing and one more; only around their places is the rest looked up. matched is the
most distinct terms in a window.

Defined cases: items without words (so null and empty ones) or with a null item_id are not searched, all others are,
of one word too; null and empty texts hold nothing; documents with a null doc_id are indexed and found, as null; rows
that repeat a doc_id or an item_id give one row for each pair and kind, of the greatest matched and then the least
place; clean() tells rows apart by doc_id and text, so of rows that share a doc_id only those with a match go. Very long
texts and items are read whole: a text longer than a segment is a segment of its own. An empty table gives no matches.
Columns of docs other than doc_id and text are passed on by clean(), whatever their names.

The benchmark's items are sent to all tasks, in portions of PORTION characters: a larger one takes more passes over the
index, not over the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.space import checked, forget, written
from tidemill.llm.tokens import col, slices, words_of

PHRASE, NEAR = 8, 5
SHARE, SPAN = 0.8, 1.5
PORTION = 8_000_000
SEGMENT_BYTES = 1 << 23
INDEX = "doc_ids array<long>, contents array<long>, starts array<int>, terms array<long>, sizes array<int>, steps binary"
FOUND = "doc_id long, content long, item_id long, kind string, matched int, place int"


@dataclass
class Items:
    """Distinct terms of the benchmark, sorted, and each item's id and terms in order, as numbers of those."""

    vocabulary: np.ndarray
    ids: list[int]
    terms: list[np.ndarray]

    @property
    def longest(self) -> int:
        return max(map(len, self.terms), default=0)

    @classmethod
    def of(cls, ids: list[int], texts: list[str]) -> Items:
        w = words_of(pa.array(texts, pa.string()))
        use = [k for k in range(len(ids)) if w.counts[k]]
        parts = [w.hashes[w.offsets[k] : w.offsets[k + 1]] for k in use]
        vocabulary = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]))
        return cls(vocabulary, [ids[k] for k in use], [np.searchsorted(vocabulary, p) for p in parts])


def packed(x: np.ndarray, step: int = 1 << 18) -> bytes:
    """Non-negative numbers, seven bits to a byte, the lowest first; the last byte of each has its high bit set."""
    return b"".join(_packed(x[k : k + step].astype(np.uint64)) for k in range(0, len(x), step))


def _packed(x: np.ndarray) -> bytes:
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        size += x >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(size.max())):
        some = size > k
        out[(ends - size)[some] + k] = (x[some] >> np.uint64(7 * k)).astype(np.uint8) & 127
    out[ends - 1] |= 128
    return out.tobytes()


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data & 128)
    if len(last) == len(data):
        return (data & 127).astype(np.int64)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first)


def segment(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Starts of the documents, the different terms, the number of places of each, and the lists as packed steps."""
    hashes, counts = [], []
    for part in slices(pa.record_batch([column], names=["text"])):
        w = words_of(part.column(0))
        hashes.append(w.hashes)
        counts.append(w.counts)
    hashes, counts = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)])
    order = np.argsort(hashes, kind="stable")
    term = hashes[order]
    del hashes
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    kinds, sizes = term[first], np.diff(np.append(first, len(term))).astype(np.int32)
    del term
    steps = np.diff(order, prepend=0)
    steps[first] = order[first]
    return (np.cumsum(counts) - counts).astype(np.int32), kinds, sizes, packed(steps)


def lists_of(vocabulary: np.ndarray, terms: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> dict[int, np.ndarray]:
    """Places of each number of the vocabulary that occurs in a segment; other terms' lists are passed over unread."""
    if not len(terms):
        return {}
    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
    known = np.flatnonzero(terms[at] == vocabulary)
    last = np.flatnonzero(steps & 128) + 1  # where each number ends
    ends = np.cumsum(sizes)
    cut = np.append(0, last)
    out = {}
    for number, k in zip(known.tolist(), at[known].tolist(), strict=True):
        e, n = int(ends[k]), int(sizes[k])
        out[number] = np.cumsum(unpacked(steps[cut[e - n] : cut[e]]))
    return out


def _aligned(lists: list[np.ndarray], k: int, width: int) -> np.ndarray:
    """Where an item starts of which the words from k on, so many, stand next to each other."""
    order = sorted(range(k, k + width), key=lambda o: len(lists[o]))
    found = lists[order[0]] - order[0]
    for o in order[1:]:
        if not len(found):
            break
        at = np.searchsorted(lists[o], found + o)
        found = found[(at < len(lists[o])) & (lists[o][np.minimum(at, len(lists[o]) - 1)] == found + o)]
    return found


def _phrases(lists: list[np.ndarray]) -> dict[int, tuple[int, int]]:
    """Start of the item at each alignment with a match, and the longest run of its words there, with its offset."""
    width = min(PHRASE, len(lists))
    hits: dict[int, list[int]] = {}
    k, missing = 0, [o for o, x in enumerate(lists) if not len(x)]
    while k <= len(lists) - width:
        while missing and missing[0] < k:
            missing.pop(0)
        if missing and missing[0] < k + width:  # a term that the segment lacks: the next run starts after it
            k = missing[0] + 1
            continue
        for start in _aligned(lists, k, width).tolist():
            hits.setdefault(start, []).append(k)
        k += 1
    best: dict[int, tuple[int, int]] = {}
    for start, offsets in hits.items():
        run = first = offsets[0]
        top = (0, 0)
        for k in [*offsets[1:], None]:
            if k is None or k != run + 1:
                top = max(top, (run - first + width, -first))
                first = k
            run = k
        best[start] = (top[0], -top[1])
    return best


def _proximities(terms: np.ndarray, lists: dict[int, np.ndarray]) -> list[tuple[int, int]]:
    """Place and number of distinct terms of windows with enough of them, the best around each group of seeds."""
    kinds = sorted(set(terms.tolist()), key=lambda t: (len(lists[t]), t))
    need, span = int(np.ceil(SHARE * len(kinds))), int(SPAN * len(terms))
    misses = len(kinds) - need
    seeds = np.unique(np.concatenate([lists[t] for t in kinds[: misses + 1]]))
    missed = np.zeros(len(seeds), np.int64)
    for t in kinds:
        if not len(seeds):
            return []
        x = lists[t]
        missed += np.searchsorted(x, seeds - span + 1) == np.searchsorted(x, seeds + span)
        seeds, missed = seeds[missed <= misses], missed[missed <= misses]
    out = []
    for seed in seeds.tolist():
        near = [(p, t) for t in kinds for p in lists[t][slice(*np.searchsorted(lists[t], [seed - span + 1, seed + span]))].tolist()]
        near.sort()
        inside: dict[int, int] = {}
        best, low = (0, 0), 0
        for p, t in near:
            inside[t] = inside.get(t, 0) + 1
            while near[low][0] <= p - span:
                inside[near[low][1]] -= 1
                if not inside[near[low][1]]:
                    del inside[near[low][1]]
                low += 1
            best = max(best, (len(inside), -near[low][0]))
        if best[0] >= need:
            out.append((-best[1], best[0]))
    return out


def search(starts: np.ndarray, lists: dict[int, np.ndarray], items: Items) -> list[tuple[int, int, str, int, int]]:
    """Number of the document in its segment, item_id, kind, matched and place of every match, the best of each document,
    item and kind."""
    gap = int(items.longest * (SPAN + 1)) + 2
    # a document without words starts where the next one does: a place belongs to the last document that starts by it
    moved = {t: x + gap * (np.searchsorted(starts, x, "right").astype(np.int64)) for t, x in lists.items()}
    begins = starts.astype(np.int64) + gap * np.arange(1, len(starts) + 1)
    none = np.zeros(0, np.int64)
    best: dict[tuple[int, int, str], tuple[int, int]] = {}

    def note(place: int, item: int, kind: str, matched: int) -> None:
        doc = int(np.searchsorted(begins, place, "right")) - 1
        key, value = (doc, item, kind), (matched, -(place - int(begins[doc])))
        best[key] = max(best.get(key, value), value)

    for item, own in zip(items.ids, items.terms, strict=True):
        found = [moved.get(t, none) for t in own.tolist()]
        if len(own) <= PHRASE:  # all matches are of the whole item: the first in each document is the best
            places = _aligned(found, 0, len(own))
            docs, first = np.unique(np.searchsorted(begins, places, "right") - 1, return_index=True)
            for doc, place in zip(docs.tolist(), places[first].tolist(), strict=True):
                best[doc, item, "phrase"] = max(best.get((doc, item, "phrase"), (0, 0)), (len(own), -(place - int(begins[doc]))))
        else:
            for start, (matched, offset) in _phrases(found).items():
                note(start + offset, item, "phrase", matched)
        if len(own) >= NEAR:
            for place, matched in _proximities(own, dict(zip(own.tolist(), found, strict=True))):
                note(place, item, "proximity", matched)
    return [(*key, matched, -place) for key, (matched, place) in best.items()]


def _lists(x: np.ndarray | pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x) if isinstance(x, np.ndarray) else x)


def built(docs: DataFrame) -> DataFrame:
    """The index of all documents, one row for each segment, written to the shared folder."""
    names = [field.split()[0] for field in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SEGMENT_BYTES):
                starts, terms, sizes, steps = segment(col(part, "text"))
                row = [col(part, "doc_id"), col(part, "content"), starts, terms.view(np.int64), sizes]
                yield pa.record_batch([*map(_lists, row), pa.array([steps], pa.binary())], names=names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("content"), F.lower("text").alias("text"))
    return written(rows.mapInArrow(run, INDEX), "postings", "zstd")


def searched(index: DataFrame, items: Items) -> DataFrame:
    """doc_id, content (a hash of the text), item_id, kind, matched and place of each match of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                starts, terms, sizes = (np.asarray(col(batch, c).slice(k, 1).flatten()) for c in ("starts", "terms", "sizes"))
                steps = np.frombuffer(col(batch, "steps")[k].as_buffer(), np.uint8)
                found = search(starts, lists_of(items.vocabulary, terms.view(np.uint64), sizes, steps), items)
                doc, *rest = list(zip(*found, strict=True)) or [[]] * 5
                own = [col(batch, c).slice(k, 1).flatten().take(pa.array(doc, pa.int64())) for c in ("doc_ids", "contents")]
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32())
                columns = [*own, *(pa.array(c, t) for c, t in zip(rest, kinds, strict=True))]
                yield pa.record_batch(columns, names=["doc_id", "content", "item_id", "kind", "matched", "place"])

    return index.mapInArrow(run, FOUND)


def found(docs: DataFrame, benchmark: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Every match of every row, written; from an index built() before, if given."""
    bench = benchmark.filter("item_id is not null and text is not null").select("item_id", F.lower("text").alias("text"))
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    portions, out = -(-size // PORTION) or 1, None
    own = built(docs) if index is None else index
    for k in range(portions):
        rows = bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(portions)) == k).orderBy("item_id", "text").collect()
        some = searched(own, Items.of([r.item_id for r in rows], [r.text for r in rows]))
        out = some if out is None else out.unionByName(some)
    out = written(out, "matches")
    if index is None:
        forget(own)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """doc_id, item_id, kind, matched and place for each document and item that match, by phrase and by proximity."""
    top = F.max_by(F.struct("matched", "place"), F.struct("matched", -F.col("place"))).alias("top")
    rows = found(docs, benchmark, index).groupBy("doc_id", "item_id", "kind").agg(top)
    return rows.select("doc_id", "item_id", "kind", "top.*")


def clean(docs: DataFrame, benchmark: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The rows of docs that match no item."""
    bad = found(docs, benchmark, index).select(F.col("doc_id").alias("own_id"), "content").distinct()
    bad = checked(written(bad, "leaks"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["own_id"]) & (F.xxhash64(docs["text"]) == bad["content"]), "left_anti")
