"""URL filter: logistic regression on hashed character n-grams of host and path.

The host (lower case) and the path with what follows it are cut into all runs of SIZES bytes, each with marks for its
ends, hashed to 2**BITS slots apart for host and path; a URL's features are its distinct slots, each of weight one
over the root of their number. The model is fitted by Adagrad on logistic loss, on a small table of labelled URLs.

The labelled URLs are those of pages that show a labelled document: the path numbers the document that the page shows, so
its label is that of what the URL leads to.

Bounds: fitted on at most FIT_ROWS labelled URLs, those with the least hash. Defined cases: a null or empty URL, or one
without a host, has the features of the parts it has; a URL without any scores the bias; very long URLs are read whole;
rows are scored alone, so repeated rows get the same score and ties need no order; a null page_id is scored like any
other; with labels of one kind only there is nothing to learn from and every URL scores 0 and is kept; an empty table gives
no rows. Only page_id and url are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.space import checked
from tidemill.llm.tokens import col, distinct, mix64, raw_text, slices

FIT_ROWS, BITS, SIZES, EPOCHS = 20_000, 18, (3, 4, 5), 10
_LETTER = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host in lower case and all after it, with marks at the ends; a URL without scheme and host is all path."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return tuple(F.when(F.length(p) > 0, F.concat(F.lit("^"), p, F.lit("$"))).otherwise("") for p in (host, path))


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Document and slot of each distinct n-gram of the columns host and path."""
    docs, grams = [], []
    for salt, name in enumerate(("host", "path")):
        data, bounds = raw_text(col(batch, name))
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        left = bounds[1:][owner] - np.arange(len(data))
        for size in SIZES:
            at = np.flatnonzero(left >= size)
            h = np.full(len(at), 2 * size + salt, np.uint64)
            for k in range(size):
                h = h * np.uint64(0x9E3779B97F4A7C15) + _LETTER[data[at + k]]
            docs.append(owner[at])
            grams.append(mix64(h))
    doc, slot, _ = distinct(np.concatenate(docs), np.concatenate(grams), BITS)
    return doc, slot.astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        size = np.maximum(np.bincount(doc, minlength=n), 1)
        return self.bias + np.bincount(doc, self.weights[slot], n) / np.sqrt(size)


def fit(doc: np.ndarray, slot: np.ndarray, good: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.2, decay: float = 1e-4) -> Model:
    """doc is sorted."""
    n, model = len(good), Model(np.zeros(1 << BITS, np.float32), 0.0)
    grown, grown_bias = np.full(1 << BITS, 1e-4), 1e-4
    cut = np.searchsorted(doc, np.arange(n + 1))
    order = np.random.default_rng(3).permutation(n)
    for _ in range(epochs):
        for k in range(0, n, batch):
            ids = order[k : k + batch]
            size = np.diff(cut)[ids]
            local = np.repeat(np.arange(len(ids)), size)
            s = slot[np.repeat(cut[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            d = 1 / (1 + np.exp(-np.clip(model.score(local, s, len(ids)), -30, 30))) - good[ids]
            g = np.bincount(s, d[local] / np.sqrt(np.maximum(size, 1))[local], 1 << BITS) / len(ids)
            live = np.unique(s)
            step = g[live] + decay * model.weights[live]
            grown[live] += step**2
            model.weights[live] -= (rate * step / np.sqrt(grown[live])).astype(np.float32)
            grown_bias += d.mean() ** 2
            model.bias -= float(rate * d.mean() / np.sqrt(grown_bias))
    return model


def learn(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """From a table of url and label (1 good, 0 bad); rows with a null in either don't count."""
    rows = labelled.select("url", "label").dropna().orderBy(F.xxhash64("url"), "url", "label").limit(fit_rows)
    host, path = parts_of(F.col("url"))
    got = rows.select(host.alias("host"), path.alias("path"), F.col("label").cast("int").alias("label")).toArrow().combine_chunks()
    good = np.asarray(got.column("label")).astype(float)
    if not len(good) or good.min() == good.max():
        return None
    return fit(*features(got.to_batches()[0]), good)


def classify(urls: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """page_id, url, url_score and keep for each row of urls."""
    model = learn(labelled, fit_rows)
    names = ["page_id", "url", "url_score", "keep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "path", 1 << 18):
                z = model.score(*features(part), part.num_rows) if model else np.zeros(part.num_rows)
                yield pa.record_batch([col(part, "page_id"), col(part, "url"), pa.array(z), pa.array(z >= 0)], names=names)

    host, path = parts_of(F.col("url"))
    rows = urls.select("page_id", "url", host.alias("host"), path.alias("path"))
    return rows.mapInArrow(run, "page_id long, url string, url_score double, keep boolean")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and label of the pages that show a labelled document, which their path numbers: the labelled URL table."""
    doc_id = F.regexp_extract("url", r"^[^:]+://[^/]+/[a-z]+/(\d{1,18})", 1).try_cast("long")
    return pages.select("url", doc_id.alias("doc_id")).join(checked(labels), "doc_id").select("url", "label")
