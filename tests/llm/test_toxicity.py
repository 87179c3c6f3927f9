import random

import numpy as np
from llm.cases import awkward, empty, prose, wide

from tidemill.llm import toxicity


def made(n, seed):
    """Toxic where an insult meets a group word; either alone is not."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = prose(seed * n + k, 40).split() + ["insulting"] * insult + ["grouplings"] * group
        rng.shuffle(text)
        rows.append((k, " ".join(text), int(insult and group)))
    return rows


def test_pairs_are_learned(spark):
    train, test = made(2500, 1), made(600, 2)
    docs = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in train], "doc_id long, label int")
    machine = toxicity.learn(docs, labels)
    assert np.abs(machine.v[:-1]).max() > 0.1
    got = toxicity.kept(spark.createDataFrame([r[:2] for r in test], "doc_id long, text string"), machine)
    clean = {r.doc_id for r in got.collect()}
    assert np.mean([(r[0] in clean) == (r[2] == 0) for r in test]) > 0.95


def test_logits_by_brute_force():
    rng = np.random.default_rng(1)
    where = np.arange(1 << toxicity.BITS, dtype=np.int32).clip(0, 5)
    m = toxicity.Machine(0.3, where, np.append(rng.normal(size=5), 0), np.concatenate([rng.normal(size=(5, 8)), np.zeros((1, 8))]))
    doc, slot = np.array([0, 0, 0, 2]), np.array([0, 3, 4, 2])
    want = [0.3 + m.w[[0, 3, 4]].sum() + sum(m.v[i] @ m.v[j] for i, j in ((0, 3), (0, 4), (3, 4))), 0.3, 0.3 + m.w[2]]
    assert np.allclose(m.logits(doc, slot, 3), want)


def test_awkward_rows(spark):
    docs = wide(awkward(spark))
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 15)], "doc_id long, label int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 17 and len({r.toxic_score for r in rows if r.doc_id == 13}) == 1
    out = toxicity.kept(docs, toxicity.learn(docs, labels))
    assert out.columns == docs.columns and out.count() == sum(not r.toxic for r in rows)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert toxicity.classify(empty(spark), none).collect() == []
    assert not any(r.toxic for r in toxicity.classify(awkward(spark), none).collect())
    assert toxicity.kept(awkward(spark), None).count() == 17


def either(n, seed):
    """Toxic where both of a pair of words or neither is the first: each word alone is as frequent in clean texts."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = prose(seed * n + k, 40).split() + ["insulting" if a else "praising", "grouplings" if b else "neighbours"]
        rng.shuffle(text)
        rows.append((k, " ".join(text), int(a == b)))
    return rows


def test_pairs_without_marginal_effect_are_learned(spark):
    train, test = either(2500, 1), either(600, 2)
    docs = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in train], "doc_id long, label int")
    got = toxicity.kept(spark.createDataFrame([r[:2] for r in test], "doc_id long, text string"), toxicity.learn(docs, labels))
    clean = {r.doc_id for r in got.collect()}
    assert np.mean([(r[0] in clean) == (r[2] == 0) for r in test]) > 0.95
