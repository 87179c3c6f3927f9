import random

import numpy as np
import pyarrow as pa
from llm.cases import awkward, empty, prose, wide

from tidemill.llm import quality
from tidemill.llm.tokens import words_of


def junk(seed):
    rng = random.Random(seed)
    kind = seed % 3
    text = prose(seed, 80)
    if kind == 0:
        return " ".join(w + rng.choice(("***", "%%%", "$$$")) for w in text.split())
    return text.upper().replace(" ", "!! ") + "!!" if kind == 1 else " ".join([text.split()[0]] * 80)


def corpus():
    return [(k, junk(k) if k % 5 == 0 else prose(k, 60 + k % 90).capitalize() + ".") for k in range(600)]


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(300) if k % 5], "doc_id long, label int")
    got = {r.doc_id: r.keep for r in quality.classify(docs, labels).collect()}
    good, bad = [got[k] for k in range(300, 600) if k % 5], [got[k] for k in range(300, 600) if k % 5 == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def test_prior_of_known_mixture():
    rng = np.random.default_rng(0)
    cells = lambda z: np.bincount(np.clip((z * 40).astype(int), 0, 39), minlength=40)
    positive = cells(rng.beta(6, 2, 50_000))
    unlabelled = cells(np.concatenate([rng.beta(6, 2, 35_000), rng.beta(1, 9, 15_000)]))
    assert abs(quality.prior_of(positive, unlabelled) - 0.7) < 0.03


def test_measures_ignore_neighbours():
    texts = ["One two. Two!", "", "AAA AAA AAA", "x | y | z\nx | y | z\n"]
    together = quality.measures(words_of(pa.array(texts)))
    alone = np.concatenate([quality.measures(words_of(pa.array([t]))) for t in texts])
    assert np.allclose(together, alone)
    assert together[1].sum() == 0
    names = dict(zip(quality.MEASURES, together.T, strict=True))
    assert names["repeated_next"][2] > 0.6 and names["distinct_lines"][3] == 0.5 and names["top_word"][2] == 1


def test_awkward_rows(spark):
    docs = wide(awkward(spark))
    labels = spark.createDataFrame([(k, 1) for k in (1, 2, 3, 4, 10)], "doc_id long, label int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 17 and len({r.quality_score for r in rows if r.doc_id == 13}) == 1
    model = quality.learn(docs, labels)
    out = quality.kept(docs, model)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in rows if r.keep)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert quality.classify(empty(spark), none).collect() == []
    rows = quality.classify(awkward(spark), none).collect()
    assert all(r.keep and r.quality_score == 0 for r in rows)
    assert quality.kept(awkward(spark), None).count() == 17


def test_risk_is_as_low_as_by_brute_force(spark):
    """The risk written out over all documents, lowered by many small steps from nothing."""
    rows, known = corpus(), {k for k in range(300) if k % 5}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame([(k, 1) for k in known], "doc_id long, label int"))
    bins = model.bins(quality.measures(words_of(pa.array([t for _, t in rows]))))
    good = np.array([k in known for k, _ in rows])
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def risk(theta):
        z = theta[bins].sum(axis=1) + theta[-1]
        p, u = sigmoid(z[good]), sigmoid(z[~good])
        return model.prior * (1 - p).mean() + max(0, u.mean() - model.prior * p.mean()) + 0.5 * quality.SMALL_RIDGE * theta @ theta

    def slope(theta):
        s = sigmoid(theta[bins].sum(axis=1) + theta[-1])
        d, n = s * (1 - s), good.sum()
        over = s[~good].mean() > model.prior * s[good].mean()
        by = np.where(good, -(1 + over) * model.prior * d / n, over * d / (len(good) - n))
        return np.append(np.bincount(bins.ravel(), np.repeat(by, bins.shape[1]), len(theta) - 1), by.sum()) + quality.SMALL_RIDGE * theta

    theta, best = np.append(model.weights, model.bias), np.zeros(len(model.weights) + 1)
    for _ in range(20_000):
        best = best - 0.5 * slope(best)
    assert risk(theta) <= risk(best) + 0.01
    decide = lambda t: t[bins].sum(axis=1) + t[-1] >= 0
    assert np.mean(decide(theta) == decide(best)) > 0.97


def test_every_unlabelled_document_counts(spark):
    """Twice the unlabelled junk halves the prior: nothing is sampled."""
    rows = corpus()
    labels = spark.createDataFrame([(k, 1) for k in range(300) if k % 5], "doc_id long, label int")
    more = rows + [(1000 + k, junk(k)) for k in range(0, 300)]
    one, two = (quality.learn(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, more))
    assert 0.55 < one.prior < 0.9 and 0.3 < two.prior < 0.55
