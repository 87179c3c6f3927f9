"""Best-fit packing of documents into training windows of a fixed number of tokens, by large-item matching.

Pieces: a document longer than the window is cut into full windows, which are bins of their own, and a rest.
Pieces above a third of the window are matched greedily, the longest first, each with the longest other that
still fits, so at most two share a bin. Smaller pieces follow, the longest first, each in the gap that it
fills best; where none is wide enough a bin is opened.

Which piece of a length goes where does not matter, so the plan is made on the number of pieces of each length:
it is exact over all documents, and its size depends on the window and not on the corpus. It says, for each
length, which ranks go to which run of bins; ranks are by doc_id, within a length.

Defined cases: null, empty and tokenless texts have no piece and one row with null bin_id; a null doc_id is
packed like any other, ranked first; repeated rows are packed each for itself; pieces of one length and one doc_id are
alike, so which of them goes first is left open; very long texts are encoded whole, in pieces cut at white space; an
empty table gives no rows. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.space import written
from tidemill.llm.tokens import col, slices

WINDOW = 4096
#: Full windows are numbered within so many hash classes of doc_id, so that no one task ranks them all.
SALTS = 1024
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def ranks_in(vocabulary: str = VOCABULARY) -> bytes:
    """The rank file, read on the driver; it is sent to the workers, which need no such file."""
    with open(vocabulary, "rb") as lines:
        return lines.read()


@lru_cache(maxsize=2)
def encoder(ranks: bytes):
    """A public byte-level tokenizer from its rank file; special tokens' strings are ordinary text."""
    import tiktoken

    known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})


#: Longer texts are encoded in pieces cut before white space, as the pattern cuts there anyway.
PIECE = 1 << 16


def pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PIECE:
        cut = text.rfind(" ", start + 1, start + PIECE)
        while cut > start + 1 and (text[cut - 1].isspace() or cut + 1 < len(text) and text[cut + 1].isspace()):
            cut = text.rfind(" ", start + 1, cut)
        if cut <= start:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode(text: str, ranks: bytes) -> np.ndarray:
    """Token ids of the whole text."""
    coder = encoder(ranks)
    parts = [coder.encode_to_numpy(p, disallowed_special=()) for p in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of each row."""
    ranks = docs.sparkSession.sparkContext.broadcast(ranks_in(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):  # as strings, one slice at a time
                n = [len(encode(t, ranks.value)) if t else 0 for t in col(part, "text").to_pylist()]
                yield pa.record_batch([col(part, "doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def plan(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, ranks, first bin, place in the bin) and the number of bins.

    counts has the number of pieces of each length from 1 to window - 1.
    """
    runs, used, n_bins = [], dict.fromkeys(counts, 0), 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    widths: list[int] = []

    def take(length: int, n: int, first_bin: int, place: int) -> None:
        runs.append((length, used[length], n, first_bin, place))
        used[length] += n

    def leave(gap: int, first_bin: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(widths, gap)
            gaps[gap].append((first_bin, n))

    large = sorted(k for k, n in counts.items() if n and 3 * k > window)
    left = {k: counts[k] for k in large}
    while large:
        k = large[-1]
        at = bisect_left(large, window - k + 1) - 1
        mate = large[at] if at >= 0 else None
        if mate == k and left[k] == 1:
            mate = large[at - 1] if at > 0 else None
        n = left[k] if mate is None else left[k] // 2 if mate == k else min(left[k], left[mate])
        take(k, n, n_bins, 0)
        left[k] -= n
        if mate is not None:
            take(mate, n, n_bins, k)
            left[mate] -= n
        leave(window - k - (mate or 0), n_bins, n)
        n_bins += n
        large = [x for x in large if left[x]]
    for k in sorted((k for k, n in counts.items() if n and 3 * k <= window), reverse=True):
        n = counts[k]
        while n:
            at = bisect_left(widths, k)
            if at == len(widths):
                fit = window // k
                full, rest = divmod(n, fit)
                for size, bins in ((fit, full), (rest, 1)):
                    if size and bins:
                        for j in range(size):
                            take(k, bins, n_bins, j * k)
                        leave(window - size * k, n_bins, bins)
                        n_bins += bins
                n = 0
                continue
            gap = widths[at]
            first, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                widths.pop(at)
            some = min(n, bins)
            take(k, some, first, window - gap)
            n -= some
            leave(gap - k, first, some)
            if some < bins:
                leave(gap, first + some, bins - some)
    return runs, n_bins


def ranked(rows: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """The rows of doc_id, piece and n_tokens in the order of n_tokens and doc_id, written, with part and local; and for each
    part and length the rank of its first row less its local: a row's rank within its length is local and that.

    A range-partitioned sort: a length that many pieces have is split over parts like any other run of rows.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = rows.repartitionByRange(n, "n_tokens", "doc_id").sortWithinPartitions("n_tokens", "doc_id")
    order = order.withColumn("part", F.spark_partition_id()).withColumn("local", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    order = written(order, "packing-order")
    met: dict[int, int] = {}
    shift = {}
    # one row for each part and each length that starts in it: as many as there are parts and lengths together
    runs = order.groupBy("part", "n_tokens").agg(F.min("local").alias("first"), F.count("*").alias("n")).orderBy("n_tokens", "part").collect()
    for r in runs:
        shift[r.part, r.n_tokens] = met.get(r.n_tokens, 0) - r.first
        met[r.n_tokens] = met.get(r.n_tokens, 0) + r.n
    return order, shift


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, place: where each piece of each document goes.

    Bins of full windows have numbers after the others; those of one document follow one another.
    """
    rows = written(lengths(docs, vocabulary), "packing")
    rest = F.col("n_tokens") % window
    sizes = {r.k: r.n for r in rows.groupBy(rest.alias("k")).agg(F.count("*").alias("n")).collect()}
    runs, n_bins = plan({k: n for k, n in sizes.items() if k}, window)
    runs.sort()
    where = np.array(runs, np.int64).reshape(-1, 5)
    key = where[:, 0] << 40 | where[:, 1]
    short = rows.filter(rest > 0).select("doc_id", F.floor(F.col("n_tokens") / window).alias("piece"), rest.alias("n_tokens"))
    order, shift = ranked(short)
    codes = np.array(sorted(p << 32 | k for p, k in shift), np.int64)
    shifts = np.array([shift[int(c) >> 32, int(c) & 0xFFFFFFFF] for c in codes], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(col(b, "n_tokens"))
            rank = np.asarray(col(b, "local")) + shifts[np.searchsorted(codes, np.asarray(col(b, "part")).astype(np.int64) << 32 | size)]
            run = where[np.searchsorted(key, size << 40 | rank, "right") - 1]
            out = pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])
            yield pa.record_batch([col(b, "doc_id"), col(b, "piece"), col(b, "n_tokens"), *out], names=["doc_id", "piece", "n_tokens", "bin_id", "place"])

    short = order.mapInArrow(place, "doc_id long, piece long, n_tokens long, bin_id long, place long")
    full = F.floor(F.col("n_tokens") / window)
    long = rows.filter(full > 0).select("doc_id", full.alias("n"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    firsts = [0] * SALTS
    for salt, n in sorted(long.groupBy("salt").agg(F.sum("n")).collect()):
        firsts[salt] = n_bins
        n_bins += n
    earlier = Window.partitionBy("salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.array(*map(F.lit, firsts))[F.col("salt")])
    long = long.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("piece"), "first")
    long = long.select("doc_id", "piece", F.lit(window).cast("long").alias("n_tokens"), (F.col("first") + F.col("piece")).alias("bin_id"), F.lit(0).cast("long").alias("place"))
    none = F.lit(None).cast("long")
    empty = rows.filter("n_tokens = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), "n_tokens", none.alias("bin_id"), none.alias("place"))
    return short.unionByName(long).unionByName(empty)
