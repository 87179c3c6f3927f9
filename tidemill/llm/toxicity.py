"""Toxicity by a factorization machine over hashed terms.

Terms of a document are its distinct words, and the first 4 and 6 bytes of its longer words, hashed to 2**BITS
slots. With x the set of terms, the logit is
    bias + sum_i w_i + sum_(i<j) <v_i, v_j>
so pairs of terms count beyond the terms alone. It is fitted by Adagrad on logistic loss, until it does not suit held-out
documents better, and the bias then set where those part best; a few epochs of all documents follow. Slots take part by document frequency alone,
however they are labelled: pairs may tell where their members don't. Those that stay at nothing are left out of scoring.

Bounds: fitted on at most FIT_ROWS toxic and twice as many other labelled documents, those with the least hash
of doc_id. Defined cases: a null or empty text has no terms and scores the bias; very long texts are read whole; a null
doc_id has no label and is scored like any other; rows are scored alone, so repeated rows get the same score and ties need
no order; with no toxic or no other labelled documents there is nothing to learn from and nothing is toxic; an empty table
gives no rows. kept() passes on all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.space import checked, only
from tidemill.llm.tokens import Words, col, distinct, hash_spans, mix64, slices, words_of

FIT_ROWS = 10_000
BITS, RANK, STEMS, EPOCHS = 20, 8, (4, 6), 25
#: A slot takes part if so many sampled documents have it, however they are labelled: pairs may tell where their members don't.
LEAST_DOCS = 4
#: So many of the most frequent slots go through matrix products, the others one by one.
DENSE = 2048
PATIENCE, MORE = 2, 3
_STEM_SALT = 0xA24BAED4963EE407


def terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Document and slot of each distinct term."""
    owner = w.doc_of_word()
    docs, hashes = [owner], [w.hashes]
    for size in STEMS:
        long = (w.ends - w.starts) > size
        docs.append(owner[long])
        hashes.append(mix64(hash_spans(w.data, w.starts[long], w.starts[long] + size) ^ np.uint64(_STEM_SALT * size & (1 << 64) - 1)))
    doc, slot, _ = distinct(np.concatenate(docs), np.concatenate(hashes), BITS)
    return doc, slot.astype(np.int64)


@dataclass
class Machine:
    """Weights of the slots that matter: where[slot] is the row of w and v, the last row being of nothing."""

    bias: float
    where: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def logits(self, doc: np.ndarray, slot: np.ndarray, n_docs: int) -> np.ndarray:
        row = self.where[slot]
        live = row < len(self.w) - 1
        doc, row = doc[live], row[live]
        v = self.v[row]
        out = self.bias + np.bincount(doc, self.w[row], n_docs)
        for f in range(v.shape[1]):
            out += 0.5 * (np.bincount(doc, v[:, f], n_docs) ** 2 - np.bincount(doc, v[:, f] ** 2, n_docs))
        return out


@dataclass
class Sample:
    """Documents as runs of slot numbers: d has row[first[d]:first[d + 1]], those below DENSE being the most frequent slots.

    seen has the slot of each number; all have been met in LEAST_DOCS documents at least.
    """

    first: np.ndarray
    row: np.ndarray
    seen: np.ndarray
    toxic: np.ndarray

    @classmethod
    def of(cls, starts: np.ndarray, slot: np.ndarray, toxic: np.ndarray) -> Sample:
        """Document d has the slots from starts[d] to starts[d + 1]. Slots take part however they are labelled."""
        df = np.bincount(slot, minlength=1 << BITS)
        seen = np.argsort(-df, kind="stable")[: int((df >= LEAST_DOCS).sum())]
        number = np.full(1 << BITS, -1, np.int32)
        number[seen] = np.arange(len(seen))
        row, size = np.empty(int(df[seen].sum()), np.int32), np.zeros(len(toxic), np.int64)
        at = 0
        for d in range(0, len(toxic), 1024):  # the driver's memory is small: no second copy of all slots
            e = min(d + 1024, len(toxic))
            part = number[slot[starts[d] : starts[e]]]
            size[d:e] = np.bincount(np.repeat(np.arange(e - d), np.diff(starts[d : e + 1]))[part >= 0], minlength=e - d)
            part = part[part >= 0]
            row[at : at + len(part)] = part
            at += len(part)
        return cls(np.concatenate([[0], np.cumsum(size)]), row, seen, toxic)

    def batch(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these documents: a matrix of which frequent slots each has, and place and number of each other slot."""
        size = np.diff(self.first)[ids]
        cut = np.concatenate([[0], np.cumsum(size)])
        r = self.row[np.repeat(self.first[ids] - cut[:-1], size) + np.arange(cut[-1])]
        local = np.repeat(np.arange(len(ids)), size)
        often = r < min(DENSE, len(self.seen))
        dense = np.zeros((len(ids), min(DENSE, len(self.seen))), np.float32)
        dense[local[often], r[often]] = 1
        return dense, local[~often], r[~often]


def _outputs(w: np.ndarray, v: np.ndarray, dense: np.ndarray, local: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits without bias, and the sum of the vectors, of each document of a batch."""
    k = dense.shape[1]
    alone = lambda a, b: np.column_stack([a - 0.5 * (b**2).sum(axis=1), b])
    sums = dense @ alone(w[:k], v[:k])
    if len(r):
        begin = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
        sums[local[begin]] += np.add.reduceat(alone(w[r], v[r]), begin, axis=0)
    return sums[:, 0] + 0.5 * (sums[:, 1:] ** 2).sum(axis=1), sums[:, 1:]


@dataclass
class State:
    """Weights of the slots of a sample, with the sums of squared slopes that Adagrad keeps, after so many epochs."""

    w: np.ndarray
    v: np.ndarray
    bias: float
    gw: np.ndarray
    gv: np.ndarray
    epochs: int = 0

    @classmethod
    def new(cls, m: int, share: float, rng: np.random.Generator) -> State:
        v = rng.normal(0, 0.01, (m, RANK)).astype(np.float32)
        return cls(np.zeros(m, np.float32), v, float(np.log(share / (1 - share))), np.full(m, 1e-4, np.float32), np.full((m, RANK), 1e-4, np.float32))

    def copy(self) -> State:
        return State(self.w.copy(), self.v.copy(), self.bias, self.gw.copy(), self.gv.copy(), self.epochs)


def fit(data: Sample, among: np.ndarray, held: np.ndarray, epochs: int, start: State | None = None, batch: int = 256, rate: float = 0.1, seed: int = 7) -> tuple[State, np.ndarray]:
    """What is learned from the documents among, from start on, at the epoch of the least loss over those held, and their
    logits then. It ends PATIENCE epochs after the least loss, or after so many epochs if none are held."""
    rng = np.random.default_rng(seed)
    m, toxic = len(data.seen), data.toxic
    at_ = State.new(m, toxic[among].mean(), rng) if start is None else start
    w, v, gw, gv, bias = at_.w, at_.v, at_.gw, at_.gv, at_.bias
    scale = 1 / np.sqrt(np.maximum(np.diff(data.first), 1))  # steps are by document length, scores are not
    least, best, logits = np.inf, at_, np.zeros(0)

    def move(at: np.ndarray, back: np.ndarray) -> None:
        g = back[:, 0] + 1e-5 * w[at]
        gw[at] += g * g
        h = back[:, 1:] - back[:, :1] * v[at] + 1e-4 * v[at]
        gv[at] += h * h
        w[at] -= rate * g / np.sqrt(gw[at])
        v[at] -= 0.2 * rate * h / np.sqrt(gv[at])

    for epoch in range(epochs):
        order = among[rng.permutation(len(among))]
        for j in range(0, len(order), batch):
            ids = order[j : j + batch]
            dense, local, r = data.batch(ids)
            z, total = _outputs(w, v, dense, local, r)
            d = (1 / (1 + np.exp(-np.clip(z + bias, -30, 30))) - toxic[ids]) / len(ids)
            dr = (d * scale[ids]).astype(np.float32)
            back = np.column_stack([dr, dr[:, None] * total])
            met = np.zeros(m, bool)
            met[r] = True
            uniq = np.flatnonzero(met)
            inv = (np.cumsum(met) - 1)[r]
            other = np.column_stack([np.bincount(inv, x[local], len(uniq)) for x in back.T]).astype(np.float32)
            live = np.flatnonzero(dense.any(axis=0))
            move(live, (dense.T @ back)[live])
            move(uniq, other)
            bias -= 0.05 * d.sum()
        at_.bias, at_.epochs = bias, at_.epochs + 1
        if len(held):
            z = np.concatenate([_outputs(w, v, *data.batch(held[j : j + batch]))[0] for j in range(0, len(held), batch)]) + bias
            loss = float(np.logaddexp(0, np.where(toxic[held] > 0, -z, z)).mean())
            if loss < least:
                least, best, logits = loss, at_.copy(), z
            elif at_.epochs >= best.epochs + PATIENCE:
                break
    return best, logits


def _mixed(ids: pa.ChunkedArray) -> np.ndarray:
    return mix64(np.asarray(ids).astype(np.uint64))


def cut(z: np.ndarray, toxic: np.ndarray) -> float:
    """The score that parts toxic from other documents with the greatest F1; of equal ones, one nearer to the toxic."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + max(toxic.sum(), 1))
    f1[:-1][z[order][:-1] == z[order][1:]] = 0
    best = np.flatnonzero(f1 == f1.max())[-1]
    low = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1
    return float(0.7 * z[order][best] + 0.3 * low)


def fit_cut(starts: np.ndarray, slot: np.ndarray, toxic: np.ndarray) -> Machine:
    """A machine of four documents in five, fitted until it does not suit the others better, and then for MORE epochs of all
    of them; its bias is moved by the cut() of the others before those."""
    data, every = Sample.of(starts, slot, toxic), np.arange(len(toxic))
    held, move, at = every % 5 == 4, 0.0, None
    if 0 < toxic[held].sum() < held.sum() and 0 < toxic[~held].sum() < (~held).sum():
        at, z = fit(data, np.flatnonzero(~held), np.flatnonzero(held), EPOCHS)
        move = cut(z, toxic[held])
    at, _ = fit(data, every, every[:0], EPOCHS if at is None else MORE, at)
    live = np.flatnonzero((np.abs(at.w) > 1e-3) | (np.abs(at.v).max(axis=1, initial=0) > 1e-2))
    where = np.full(1 << BITS, len(live), np.int32)
    where[data.seen[live]] = np.arange(len(live))
    return Machine(float(at.bias) - move, where, np.append(at.w[live], 0), np.concatenate([at.v[live], np.zeros((1, RANK))]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            w = words_of(col(part, "text"))
            doc, slot = terms(w)
            offsets = pa.array(np.searchsorted(doc, np.arange(w.n_docs + 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(slot.astype(np.int32)))
            yield pa.record_batch([col(part, "doc_id"), col(part, "label"), lists], names=["doc_id", "label", "slots"])


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine | None:
    """The machine from documents and labels (doc_id, label); None if either class is missing."""
    order = [F.xxhash64("doc_id"), "doc_id"]
    kinds = [labels.filter(q).orderBy(*order).limit(k) for q, k in (("label = 1", fit_rows), ("label = 0", 2 * fit_rows))]
    sample = checked(kinds[0].unionByName(kinds[1]))
    rows = docs.select("doc_id", F.lower("text").alias("text")).join(sample, "doc_id")
    got = rows.mapInArrow(_features, "doc_id long, label int, slots array<int>").toArrow()
    got = got.take(np.argsort(_mixed(got.column("doc_id")), kind="stable"))
    toxic = np.asarray(got.column("label")).astype(float)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    lists = got.column("slots").combine_chunks()
    del got
    starts = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()), dtype=np.int64)])
    return fit_cut(starts, np.asarray(lists.flatten()), toxic)


def kept(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """The rows of docs that are not toxic, by one pass that moves nothing between executors."""

    def mask(texts: pa.Array) -> np.ndarray:
        w = words_of(texts)
        return machine.logits(*terms(w), w.n_docs) <= 0

    return only(docs, F.lower("text"), mask) if machine else docs


def _only(batches: Iterator[pa.RecordBatch], machine: Machine | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            w = words_of(col(part, "text"))
            z = machine.logits(*terms(w), w.n_docs) if machine else np.full(w.n_docs, -np.inf)
            yield pa.record_batch([col(part, "doc_id"), pa.array(z), pa.array(z > 0)], names=["doc_id", "toxic_score", "toxic"])


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, toxic_score and toxic for each document."""
    machine = learn(docs, labels, fit_rows)
    rows = docs.select("doc_id", F.lower("text").alias("text"))
    return rows.mapInArrow(lambda b: _only(b, machine), "doc_id long, toxic_score double, toxic boolean")
