import itertools
import random

import numpy as np
import pyarrow as pa
from llm.cases import awkward, edited, empty, prose, wide

from tidemill.llm import simhash
from tidemill.llm.tokens import words_of


def near_copies():
    """Thirty originals; of each some copies with up to 4 % of the words changed; and texts of their own."""
    rows, k = [], 0
    for seed in range(30):
        text = prose(seed, 200)
        for c in range(seed % 4 + 1):
            rows.append((k, text if c == 0 else edited(text, k, 0.01 * c)))
            k += 1
    return rows + [(k + j, prose(1000 + j, 150)) for j in range(40)]


def similarity(a, b):
    x, y = (set(zip(t.split(), t.split()[1:], strict=False)) for t in (a, b))
    return len(x & y) / len(x | y)


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_groups_equal_brute_force_over_fingerprints(spark):
    rows = near_copies()
    rare = simhash.rarity(spark.createDataFrame(rows, "doc_id long, text string"))
    prints = simhash.fingerprints(words_of(pa.array([t for _, t in rows])), rare)
    distance = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :])
    edges = [
        (a, b) for a, b in itertools.combinations(range(len(rows)), 2)
        if distance[a, b].min() <= simhash.RADIUS and distance[a, b].sum() <= simhash.FAR and similarity(rows[a][1], rows[b][1]) >= simhash.SIMILAR
    ]
    got = {r.doc_id: r.group_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == roots(range(len(rows)), edges)
    close = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if similarity(rows[a][1], rows[b][1]) >= 0.8]
    assert np.mean([got[a] == got[b] for a, b in close]) >= 0.9


def test_recall_of_groups_of_two(spark):
    """Against all pairs within FAR and SIMILAR, whether or not a block of theirs is near."""
    rows = [(2 * k + c, edited(prose(k, 200), k, 0.01 + 0.09 * k / 200) if c else prose(k, 200)) for k in range(200) for c in (0, 1)]
    prints = simhash.fingerprints(words_of(pa.array([t for _, t in rows])), simhash.rarity(spark.createDataFrame(rows, "doc_id long, text string")))
    far = 0.3 * simhash.BLOCKS * simhash.BITS
    distance = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2)
    edges = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if distance[a, b] <= far and similarity(rows[a][1], rows[b][1]) >= simhash.SIMILAR]
    assert all(b == a + 1 and a % 2 == 0 for a, b in edges) and len(edges) > 150
    got = {r.doc_id: r.group_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[a] == got[b] for a, b in edges]) >= 0.9


def test_ball_is_half_the_radius():
    masks = simhash.ball()
    assert len(set(masks)) == len(masks) == 1 + simhash.BITS and all(m.bit_count() <= 1 for m in masks)
    a, b = 0b1011, 0b1000
    assert {a ^ m for m in masks} & {b ^ m for m in masks}


def test_fingerprints_ignore_neighbours():
    texts = ["a b c", "", prose(3), "a a b"]
    rare = np.random.default_rng(1).random(simhash.SLOTS).astype(np.float32)
    together = simhash.fingerprints(words_of(pa.array(texts)), rare)
    alone = np.concatenate([simhash.fingerprints(words_of(pa.array([t])), rare) for t in texts])
    assert (together == alone).all() and (together[1] == 0).all()


def test_awkward_rows(spark):
    docs = wide(awkward(spark))
    found = simhash.groups(docs).collect()
    assert len(found) == 16 and sorted(r.n_links for r in found if r.doc_id in (1, 2, 3)) == [1, 1, 2]
    rows = {r.doc_id: (r.group_id, r.keep) for r in found if r.doc_id is not None}
    assert [r.keep for r in found if r.doc_id is None] == [True, True]
    assert rows[1] == (1, True) and rows[2] == (1, False) and rows[3] == (1, False)
    assert rows[10] == (10, True) and rows[11] == (10, False)
    assert all(rows[k] == (k, True) for k in (4, 5, 6, 7, 8, 9, 13, 14, 15)) and len(rows) == 14
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(None) == 2 and sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 13, 14, 15]


def test_empty(spark):
    assert simhash.groups(empty(spark)).collect() == []
    assert simhash.deduplicated(empty(spark)).collect() == []


def test_null_and_repeated_ids_are_compared(spark):
    rows = [(None, prose(1)), (None, prose(1)), (None, prose(1) + " tail"), (7, prose(2)), (7, prose(3)), (7, prose(3)), (8, prose(3)), (9, prose(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.deduplicated(docs).collect()
    assert sum(r.doc_id is None for r in kept) == 1
    assert sorted(r.text for r in kept if r.doc_id) == sorted([prose(2), prose(3), prose(4)])
    assert len(simhash.groups(docs).collect()) == 6


def test_near_copies_of_a_third_of_all_rows(spark):
    """Their own words are in so many documents that they would count as common, and the words that differ as rare."""
    text, rng = prose(5, 200).split(), random.Random(1)
    copies = [" ".join(f"own{k}x{j}" if rng.random() < 0.03 else word for j, word in enumerate(text)) for k in range(60)]
    rows = list(enumerate(copies + [prose(2000 + k, 150) for k in range(120)]))
    found = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert np.mean([r.group_id == 0 for r in found if r.doc_id < 60]) >= 0.95
    assert all(r.keep for r in found if r.doc_id >= 60)


def test_components(spark):
    from tidemill.llm.groups import components

    chain = [(k + 1, k) for k in range(40)] + [(100, 200), (200, 300), (5, 5), (300, 100), (100, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {200: 100, 300: 100}
