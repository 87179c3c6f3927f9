import itertools

import numpy as np
import pyarrow as pa
from llm.cases import awkward, empty, wide
from llm.test_simhash import near_copies, roots

from tidemill.llm import minhash
from tidemill.llm.tokens import words_of


def sets(texts):
    x, cut = minhash.shingle_sets(words_of(pa.array(texts)))
    return [frozenset(x[cut[k] : cut[k + 1]].tolist()) for k in range(len(texts))]


def jaccard(a, b):
    return len(a & b) / max(len(a | b), 1)


def test_groups_equal_brute_force(spark):
    rows = near_copies()
    own = sets([t for _, t in rows])
    x, cut = minhash.shingle_sets(words_of(pa.array([t for _, t in rows])))
    signed = minhash.signatures(minhash.mix64(x), cut).reshape(len(rows), -1, minhash.ROWS)
    pairs = list(itertools.combinations(range(len(rows)), 2))
    edges = [(a, b) for a, b in pairs if (signed[a] == signed[b]).all(axis=1).any() and jaccard(own[a], own[b]) >= minhash.SIMILAR]
    got = {r.doc_id: r for r in minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = roots(range(len(rows)), edges)
    assert {k: r.group_id for k, r in got.items()} == want
    assert all((r.n_links > 0) == (r.group_size > 1) for r in got.values())
    assert all(r.group_size == sum(g == r.group_id for g in want.values()) for r in got.values())
    close = [(a, b) for a, b in pairs if jaccard(own[a], own[b]) >= minhash.SIMILAR]
    assert np.mean([want[a] == want[b] for a, b in close]) >= 0.9


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    common, one, two = (rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in (600, 200, 200))
    a, b = np.concatenate([common, one]), np.concatenate([common, two])
    s = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15
    by_hand = ((a[None, :] * minhash._A[:, None] + minhash._B[:, None]) >> np.uint64(32)).min(axis=1)
    assert (s[0] == by_hand).all()


def test_awkward_rows(spark):
    rows = {r.doc_id: r for r in minhash.fingerprints(wide(awkward(spark))).collect()}
    assert len(rows) == 14 and None not in rows
    assert rows[1].group_id == rows[2].group_id == rows[3].group_id == 1 and rows[3].group_size == 3
    assert rows[10].group_id == rows[11].group_id == 10
    assert all(rows[k].signature is None and rows[k].n_shingles == 0 for k in (5, 6, 7))
    assert all(rows[k].group_size == 1 for k in (4, 5, 6, 7, 8, 9, 13, 14, 15)) and rows[15].n_shingles == 1


def test_empty(spark):
    assert minhash.fingerprints(empty(spark)).collect() == []
