"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled quality 1; unlabelled are those without a label. A first
logistic model tells the two apart; its scores over every positive and every unlabelled document give the
class prior (least ratio of tails); each half of the documents, by hash, is scored by the model of the other
half, so that fitting to a half doesn't lower it. The classifier then minimises the non-negative unbiased risk
    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])
with the sigmoid loss l(g) = 1 / (1 + exp(g)), over one-hot bins of a few dense measures of the text. A document is kept if
g >= 0.

All positives and all unlabelled documents count in each of the fits: executors keep the bins, and give sums of slopes
(and curvatures, for the logistic models, which Newton's method fits) at each step. The risk is lowered from where the
logistic models and the prior put the even odds, by steps scaled with their curvature, as long as they lower it. Bin
edges, from histograms, are of all of them too. Nothing is sampled.

Defined cases: a null or empty text has all measures 0 and is scored like any other; very long texts are measured
whole; a null doc_id has no label and takes part as unlabelled; rows are scored alone, so repeated rows get the same score
and ties need no order; with no trusted positives or no unlabelled documents there is nothing to learn from and every
document scores 0 and is kept; an empty table gives no rows. kept() passes on all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.space import checked, forget, only, written
from tidemill.llm.tokens import Words, col, distinct, hash_spans, slices, words_of

BINS, RIDGE, SMALL_RIDGE = 12, 1e-3, 1e-4
#: The greater of nothing and the negative risk is taken smoothly, within so much.
SMOOTH = 1e-3
#: Cells of the histogram of each measure, and groups in which executors add up what tasks give.
CELLS, ADDERS = 1024, 64
MEASURES = (
    "log_words", "mean_word", "distinct_words", "top_word", "repeated_next", "upper", "digits", "marks", "loud",
    "stops", "bars", "lines", "distinct_lines", "non_ascii", "short_words",
)


def _class(chars: str) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(chars.encode("latin-1"))] = True
    return lut


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_MARKS, _LOUD, _STOPS, _BARS = _class("#$%&*@^~_=+<>{}[]\\/"), _class("!?"), _class(".,;:"), _class("|")
_HIGH = np.arange(256) >= 192


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    at = np.searchsorted(np.flatnonzero(flags), bounds)
    return np.diff(at).astype(float)


def _line_share(w: Words) -> tuple[np.ndarray, np.ndarray]:
    cut = w.data == 10
    cut[w.bounds[1:][np.diff(w.bounds) > 0] - 1] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    doc = np.searchsorted(w.bounds, starts, "right") - 1
    lines = np.bincount(doc, minlength=w.n_docs).astype(float)
    kinds = np.bincount(distinct(doc, hash_spans(w.data, starts, ends))[0], minlength=w.n_docs)
    return lines, kinds / np.maximum(lines, 1)


def measures(w: Words) -> np.ndarray:
    """One row of MEASURES for each document. Upper-case letters count, so the column is not lowered first."""
    size, n = np.maximum(np.diff(w.bounds), 1).astype(float), np.maximum(w.counts, 1).astype(float)
    doc, _, count = w.distinct()
    top = np.zeros(w.n_docs)
    np.maximum.at(top, doc, count)
    owner = w.doc_of_word()
    same = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, bool)
    lines, distinct_lines = _line_share(w)
    length = w.ends - w.starts
    columns = [
        np.log1p(w.counts), np.bincount(owner, length, w.n_docs) / n, np.bincount(doc, minlength=w.n_docs) / n, top / n,
        np.bincount(owner[1:][same], minlength=w.n_docs) / n, _sums(_UPPER[w.data], w.bounds) / size,
        *(_sums(lut[w.data], w.bounds) / n for lut in (_DIGIT, _MARKS, _LOUD, _STOPS, _BARS)),
        lines / n, distinct_lines, _sums(_HIGH[w.data], w.bounds) / size, np.bincount(owner, length <= 2, w.n_docs) / n,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Model:
    """Bin edges of each measure, and a weight for each bin; prior is that of good text among the unlabelled."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") + k * BINS for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(axis=1) + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _losses(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


N_WEIGHTS = len(MEASURES) * BINS + 1


def parts_at(bins: np.ndarray, theta: np.ndarray, step: int = 1 << 13) -> np.ndarray:
    """Of rows with these bins: their number, sums of l(g), l(-g), x, sigmoid(g) * x and of the curvature, x being the
    one-hot bins and a last 1."""
    n, m = len(MEASURES), N_WEIGHTS
    out = np.zeros(3 + 2 * m + m * m)
    for k in range(0, len(bins), step):
        b = bins[k : k + step].astype(np.int64) + BINS * np.arange(n)
        x = np.zeros((len(b), m), np.float32)
        np.put_along_axis(x, b, 1, axis=1)
        x[:, -1] = 1
        z = theta[b].sum(axis=1) + theta[-1]
        s = _sigmoid(z)
        out[:3] += len(b), _losses(z).sum(), _losses(-z).sum()
        out[3 : 3 + m] += x.sum(axis=0, dtype=np.float64)
        out[3 + m : 3 + 2 * m] += s.astype(np.float32) @ x
        out[3 + 2 * m :] += ((x * (s * (1 - s)).astype(np.float32)[:, None]).T @ x).ravel()
    return out


def _read(sums: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray, np.ndarray]:
    """Means of l(g), l(-g), x, sigmoid(g) * x and curvature."""
    m = N_WEIGHTS
    mean = sums[1:] / max(sums[0], 1)
    return mean[0], mean[1], mean[2 : 2 + m], mean[2 + m : 2 + 2 * m], mean[2 + 2 * m :].reshape(m, m)


def logistic_risk(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Risk of telling labelled from unlabelled, each half of the weight, its slope and curvature, from parts_at()."""
    (lp, _, xp, sp, hp), (_, lu, _, su, hu) = _read(positive), _read(unlabelled)
    return 0.5 * (lp + lu), 0.5 * (sp - xp + su), 0.5 * (hp + hu)


def slopes_at(bins: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Of rows with these bins: their number, the sum of sigmoid(g) and its slope."""
    b = bins.astype(np.int64) + BINS * np.arange(len(MEASURES))
    s = _sigmoid(theta[b].sum(axis=1) + theta[-1])
    d = s * (1 - s)
    return np.concatenate([[len(b), s.sum()], np.bincount(b.ravel(), np.repeat(d, b.shape[1]), N_WEIGHTS - 1), [d.sum()]])


def nnpu_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """The non-negative unbiased risk, with a small ridge, and its slope, from slopes_at()."""
    (yes, up), (all_, over) = ((x[1] / max(x[0], 1), x[2:] / max(x[0], 1)) for x in (positive, unlabelled))
    negative = all_ - prior * yes
    share = _sigmoid(np.array(negative / SMOOTH)).item()
    slope = -prior * up + share * (over - prior * up) + SMALL_RIDGE * theta
    return prior * (1 - yes) + SMOOTH * float(np.logaddexp(0, negative / SMOOTH)) + 0.5 * SMALL_RIDGE * float(theta @ theta), slope


class Newton:
    """Damped steps to the least of risk(theta) + ridge; tell() takes what the risk is at theta."""

    def __init__(self) -> None:
        self.theta = self.best = np.zeros(N_WEIGHTS)
        self.step, self.value, self.done = np.zeros(N_WEIGHTS), np.inf, False
        self.ridge = np.full(N_WEIGHTS, RIDGE)
        self.ridge[-1] = RIDGE / 100

    def tell(self, value: float, slope: np.ndarray, curvature: np.ndarray) -> None:
        if self.done:
            return
        value += 0.5 * float(self.ridge @ self.theta**2)
        if value > self.value + 1e-9:  # too far: half the step
            self.step /= 2
        else:
            self.done = self.value - value < 1e-7
            self.best, self.value = self.theta, value
            self.step = -np.linalg.solve(curvature + np.diag(self.ridge), slope + self.ridge * self.theta)
        self.done |= bool(np.abs(self.step).max() < 1e-4)
        self.theta = self.best if self.done else self.best + self.step


class Descent:
    """Steps against the slope, scaled by a fixed curvature, halved until they lower the risk and doubled when they do."""

    def __init__(self, theta: np.ndarray, curvature: np.ndarray) -> None:
        self.theta = self.best = theta
        self.scale = np.linalg.inv(curvature + np.diag(np.full(len(theta), RIDGE)))
        self.value, self.size, self.done, self.small = np.inf, 1.0, False, 0

    def tell(self, value: float, slope: np.ndarray) -> None:
        if value < self.value:
            self.small = self.small + 1 if self.value - value < 2e-5 else 0
            self.best, self.value, self.size = self.theta, value, 2 * self.size
            self.way = -self.scale @ slope
        else:
            self.size /= 4
        self.done = self.small >= 3 or self.size < 1e-4
        self.theta = self.best if self.done else self.best + self.size * self.way


MOST_STEPS = 60


def _grid(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x.astype(np.float64), 0)
    return np.minimum(np.sqrt(x / (1 + x)) * CELLS, CELLS - 1).astype(np.int64)


def edges_from(counts: np.ndarray) -> np.ndarray:
    """BINS - 1 edges of each measure from histograms (group, measure, cell), each group half of the weight: quantiles, and
    quantiles of the different cells met, for measures that are mostly 0."""
    half = (BINS - 1) // 2
    edges = np.empty((len(MEASURES), BINS - 1), np.float32)
    for k in range(len(MEASURES)):
        share = (counts[:, k] / np.maximum(counts[:, k].sum(axis=1, keepdims=True), 1)).sum(axis=0)
        below, met = np.cumsum(share) / max(share.sum(), 1e-12), np.flatnonzero(share)
        some = np.searchsorted(below, np.linspace(0, 1, half + 2)[1:-1] - 1e-9)
        other = met[(np.linspace(0, 1, BINS - half + 1)[1:-1] * (len(met) - 1)).astype(int)] if len(met) else np.zeros(BINS - 1 - half)
        t = (np.sort(np.concatenate([some, other])) + 1) / CELLS  # the upper end of the cell
        edges[k] = np.minimum(t, 1 - 1e-9) ** 2 / (1 - np.minimum(t, 1 - 1e-9) ** 2)
    return edges


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """From histograms of the scores of all positives and all unlabelled, by rising score: the least ratio of the
    unlabelled tail to the positive tail, over tails that hold at least that share of the positives."""
    p, u = positive[::-1].cumsum() / positive.sum(), unlabelled[::-1].cumsum() / unlabelled.sum()
    return float(np.clip((u[p >= least] / p[p >= least]).min(), 0.01, 0.99))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x = measures(words_of(col(part, "text")))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(MEASURES)).cast(pa.list_(pa.float32()))
            yield pa.record_batch([col(part, "doc_id"), flat], names=["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_measured, "doc_id long, x array<float>")


def _added(table: DataFrame, of_batch, size: int) -> np.ndarray:
    """The sum over all batches of of_batch(batch), a vector: tasks add their own, executors those of groups of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of_batch(batch)
        part = TaskContext.get().partitionId() % ADDERS
        yield pa.record_batch([pa.array([part]), pa.array([total.tobytes()], pa.binary())], names=["adder", "total"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in group.column("total")], axis=0)
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    rows = table.mapInArrow(run, "adder long, total binary").groupBy("adder").applyInArrow(add, "total binary").collect()
    return np.sum([np.frombuffer(r.total) for r in rows], axis=0) if rows else np.zeros(size)


def _rows(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return np.asarray(col(batch, name).flatten()).reshape(-1, len(MEASURES))


def train(table: DataFrame, labels: DataFrame) -> Model | None:
    """The model from a measured() table and labels (doc_id, label). None without positives or unlabelled."""
    rows = table.join(checked(labels), "doc_id", "left").filter("label is null or label = 1")
    fold = F.abs(F.xxhash64("doc_id", "x") % 2).cast("int")
    rows = written(rows.select("x", F.col("label").isNotNull().cast("int").alias("grp"), fold.alias("fold")), "quality-rows")
    n = len(MEASURES)

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        cell = _grid(_rows(batch)) + CELLS * np.arange(n) + CELLS * n * np.asarray(col(batch, "grp"))[:, None]
        return np.bincount(cell.ravel(), minlength=2 * n * CELLS)

    counts = _added(rows, histogram, 2 * n * CELLS).reshape(2, n, CELLS)
    size = counts[:, 0].sum(axis=1)
    if not size.all():
        forget(rows)
        return None
    model = Model(edges_from(counts), np.zeros(N_WEIGHTS - 1), 0.0, 1.0)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, kind = model.bins(_rows(b)) - BINS * np.arange(n), 2 * np.asarray(col(b, "fold")) + np.asarray(col(b, "grp"))
            kinds = [k for k in range(4) if (kind == k).any()]
            data = [x[kind == k].astype(np.uint8).tobytes() for k in kinds]
            yield pa.record_batch([pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], names=["kind", "bins"])

    bins = written(rows.mapInArrow(binned, "kind int, bins binary"), "quality-bins")
    forget(rows)

    def sums(at: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int, thetas: list[np.ndarray]) -> np.ndarray:
        """parts_at() or slopes_at() of each fold and group, each fold at its own theta."""

        def one(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((4, size))
            for kind, data in zip(col(batch, "kind").to_pylist(), col(batch, "bins"), strict=True):
                out[kind] += at(np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, n), thetas[kind // 2])
            return out.ravel()

        return _added(bins, one, 4 * size).reshape(2, 2, size)

    first = [Newton(), Newton()]
    for _ in range(MOST_STEPS):
        got = sums(parts_at, 3 + 2 * N_WEIGHTS + N_WEIGHTS**2, [f.theta for f in first])
        for f, (u, p) in zip(first, got, strict=True):
            f.tell(*logistic_risk(p, u))
        if all(f.done for f in first):
            break
    cells = 400

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((2, cells))
        for kind, data in zip(col(batch, "kind").to_pylist(), col(batch, "bins"), strict=True):
            theta = first[1 - kind // 2].best
            z = theta[np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, n) + BINS * np.arange(n)].sum(axis=1) + theta[-1]
            out[kind % 2] += np.bincount(np.clip((_sigmoid(z) * cells).astype(int), 0, cells - 1), minlength=cells)
        return out.ravel()

    unlabelled, positive = _added(bins, scores, 2 * cells).reshape(2, cells)
    model.prior = prior_of(positive, unlabelled)
    odds = (first[0].best + first[1].best) / 2  # of labelled to unlabelled: good to bad is even where 2 * prior of it is
    odds[-1] += np.log(2 * model.prior)
    last = Descent(odds, _read(got.sum(axis=0)[0])[4])
    for _ in range(MOST_STEPS):
        u, p = sums(slopes_at, 1 + N_WEIGHTS + 1, [last.theta, last.theta]).sum(axis=0)
        last.tell(*nnpu_risk(p, u, model.prior, last.theta))
        if last.done:
            break
    forget(bins)
    model.weights, model.bias = last.best[:-1], float(last.best[-1])
    return model


def kept(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that the model keeps, by one pass that moves nothing between executors."""

    def mask(texts: pa.Array) -> np.ndarray:
        return model.score(measures(words_of(texts))) >= 0

    return only(docs, F.col("text"), mask) if model else docs


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    table = written(measured(docs), "quality")
    try:
        return train(table, labels)
    finally:
        forget(table)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality_score and keep for each document."""
    table = written(measured(docs), "quality")
    model = train(table, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(col(b, "x").flatten()).reshape(-1, len(MEASURES))
            z = model.score(x).astype(float) if model else np.zeros(b.num_rows)
            yield pa.record_batch([col(b, "doc_id"), pa.array(z), pa.array(z >= 0)], names=["doc_id", "quality_score", "keep"])

    return table.mapInArrow(run, "doc_id long, quality_score double, keep boolean")
