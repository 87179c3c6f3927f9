"""Token ids as patched frame-of-reference blocks.

The ids of a document are cut into blocks of BLOCK. Each block keeps its minimum, subtracts it, and packs every
value into the width that SHARE of the block's values fit; the high bits of those that do not fit go to an
exception list. Layout of a block, little endian:
    minimum uint32 | values uint16 | width uint8 | exceptions uint8
    packed low bits: values * width, rounded up to bytes
    exceptions: places uint8 each, then high bits uint32 each
block_starts holds the byte where each block begins, so any block is decoded without those before it.

Defined cases: null, empty and tokenless texts have no blocks and an empty payload; rows are encoded alone, so
repeated rows and null doc_ids are like any others, and ties need no order; very long texts are encoded whole, STEP blocks
at once; an empty table gives no rows. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.packing import VOCABULARY, encode, ranks_in
from tidemill.llm.tokens import col, slices

BLOCK, SHARE = 128, 0.9
#: Blocks packed at once, so that a very long text takes no more memory than others.
STEP = 1 << 12
_HEAD = np.dtype([("minimum", "<u4"), ("n", "<u2"), ("width", "u1"), ("exceptions", "u1")])
_BIT = np.arange(32, dtype=np.uint32)


def _needed(x: np.ndarray) -> np.ndarray:
    """Bits that each value takes, 0 for 0."""
    return np.frexp(x.astype(np.float64))[1]


def pack(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents d has ids[bounds[d]:bounds[d + 1]]. Payload bytes, their bounds, block starts within each
    document's payload, and the bounds of those."""
    sizes = np.diff(bounds)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    local = np.arange(first_block[-1]) - first_block[owner]
    start = bounds[owner] + local * BLOCK
    n = np.minimum(bounds[owner + 1] - start, BLOCK)
    if not len(owner):
        return np.zeros(0, np.uint8), np.zeros(len(sizes) + 1, np.int64), np.zeros(0, np.int32), first_block
    parts = [_packed(ids, start[k : k + STEP], n[k : k + STEP]) for k in range(0, len(start), STEP)]
    ends = np.cumsum(np.concatenate([size for _, size in parts]))
    payload = np.concatenate([[0], ends])[first_block]
    begin = np.concatenate([[0], ends[:-1]])
    return np.concatenate([out for out, _ in parts]), payload, (begin - payload[owner]).astype(np.int32), first_block


def _packed(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the blocks of n ids from start on, and the size of each."""
    at = np.minimum(start[:, None] + np.arange(BLOCK), len(ids) - 1)
    live = np.arange(BLOCK) < n[:, None]
    grid = ids[at].astype(np.uint32)
    least = np.where(live, grid, np.uint32(0xFFFFFFFF)).min(axis=1)
    grid = np.where(live, grid - least[:, None], 0).astype(np.uint32)
    bits = _needed(grid)
    order = np.sort(np.where(live, bits, 64), axis=1)
    width = order[np.arange(len(n)), np.ceil(SHARE * n).astype(int) - 1].astype(np.uint8)
    over = (bits > width[:, None]) & live
    exceptions = over.sum(axis=1)
    packed = (n * width.astype(np.int64) + 7) // 8
    size = _HEAD.itemsize + packed + 5 * exceptions
    ends = np.cumsum(size)
    begin = ends - size
    out = np.zeros(ends[-1], np.uint8)
    head = np.zeros(len(n), _HEAD)
    head["minimum"], head["n"], head["width"], head["exceptions"] = least, n, width, exceptions
    out[(begin[:, None] + np.arange(_HEAD.itemsize)).ravel()] = head.view(np.uint8)
    for w in np.unique(width[width > 0]):
        some = np.flatnonzero(width == w)
        flat = ((grid[some, :, None] >> _BIT[:w]) & 1).astype(np.uint8).reshape(len(some), -1)
        rows = np.packbits(flat, axis=1, bitorder="little")
        inside = np.arange(rows.shape[1]) < packed[some, None]
        out[(begin[some, None] + _HEAD.itemsize + np.arange(rows.shape[1]))[inside]] = rows[inside]
    block, place = np.nonzero(over)
    rank = np.arange(len(block)) - np.repeat(np.concatenate([[0], np.cumsum(exceptions)[:-1]]), exceptions)
    base = (begin + _HEAD.itemsize + packed)[block]
    out[base + rank] = place
    high = (grid[block, place] >> width[block]).astype("<u4")
    out[((base + exceptions[block] + 4 * rank)[:, None] + np.arange(4)).ravel()] = high.view(np.uint8)
    return out, size


def unpack_block(payload: bytes, start: int) -> np.ndarray:
    """The ids of the block that begins there."""
    head = np.frombuffer(payload, _HEAD, 1, start)[0]
    n, w, k = int(head["n"]), int(head["width"]), int(head["exceptions"])
    at = start + _HEAD.itemsize
    size = (n * w + 7) // 8
    low = np.zeros(n, np.uint32)
    if w:
        bits = np.unpackbits(np.frombuffer(payload, np.uint8, size, at), bitorder="little")[: n * w].reshape(n, w)
        low = (bits.astype(np.uint32) << _BIT[:w]).sum(axis=1, dtype=np.uint32)
    if k:
        place = np.frombuffer(payload, np.uint8, k, at + size)
        low[place] |= np.frombuffer(payload, "<u4", k, at + size + k) << np.uint32(w)
    return low + head["minimum"]


def unpack(payload: bytes, block_starts: list[int]) -> np.ndarray:
    """All ids of a document."""
    parts = [unpack_block(payload, s) for s in block_starts]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, block_starts and payload of each row."""
    names = ["doc_id", "n_tokens", "block_starts", "payload"]
    ranks = docs.sparkSession.sparkContext.broadcast(ranks_in(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = [encode(t, ranks.value) if t else np.zeros(0, np.uint32) for t in col(part, "text").to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                data, cut, starts, start_cut = pack(np.concatenate(ids), np.concatenate([[0], np.cumsum(n)]))
                payload = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data)])
                index = pa.ListArray.from_arrays(pa.array(start_cut.astype(np.int32)), pa.array(starts))
                yield pa.record_batch([col(part, "doc_id"), pa.array(n), index, payload], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, block_starts array<int>, payload binary")
