import re

import numpy as np
from llm.cases import awkward, empty, prose, wide

from tidemill.llm import decontam

ITEMS = [(1, prose(100, 20)), (2, prose(101, 15)), (3, prose(102, 30)), (4, "too short"), (5, None), (6, ""), (7, "single"), (8, "one of four words")]


def words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def brute(docs, items):
    """Phrases and windows by looking at every place."""
    found = set()
    for doc, text in docs:
        w = words(text)
        for item, phrase in items:
            t = words(phrase)
            if not t:
                continue
            n = min(decontam.PHRASE, len(t))
            grams = {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
            if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                found.add((doc, item, "phrase"))
            need, span = -(-len(set(t)) * 8 // 10), int(decontam.SPAN * len(t))
            if len(t) >= decontam.NEAR and any(len(set(w[k : k + span]) & set(t)) >= need for k in range(len(w))):
                found.add((doc, item, "proximity"))
    return found


def leaky():
    item1, item2, item3 = (words(t) for _, t in ITEMS[:3])
    rows = [(k, prose(k, 150)) for k in range(20)]
    rows.append((20, prose(20, 50) + " " + " ".join(item1) + " " + prose(21, 50)))
    rows.append((21, prose(22, 40) + ". " + " ".join(item2[3:12]).upper() + "! " + prose(23, 40)))  # part of an item
    rows.append((22, prose(24, 30) + " " + " ".join(x for w in item3 for x in (w, "um")[: 1 + (hash(w) % 3 == 0)]) + " " + prose(25, 30)))  # with words between
    rows.append((23, " ".join(item1[:7])))  # a word short of a phrase
    rows.append((24, " ".join(reversed(item2))))
    rows += [(25, "it is too short, too short"), (26, "too long and short"), (27, "A single! one of four"), (28, "of one of four words"), (29, "words one of four")]
    rows += [(None, "single"), (None, "nothing"), (30, ""), (31, None), (32, "single")]
    return rows


def test_matches_brute_force(spark):
    docs = spark.createDataFrame(leaky(), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontam.matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in rows} == brute(leaky(), ITEMS)
    exact = next(r for r in rows if (r.doc_id, r.item_id, r.kind) == (20, 1, "phrase"))
    assert (exact.matched, exact.place) == (20, 50)
    part = next(r for r in rows if (r.doc_id, r.item_id, r.kind) == (21, 2, "phrase"))
    assert (part.matched, part.place) == (9, 40)


def test_portions_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(leaky(), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = {tuple(r) for r in decontam.matches(docs, bench).collect()}
    monkeypatch.setattr(decontam, "PORTION", 100)
    assert {tuple(r) for r in decontam.matches(docs, bench).collect()} == whole


def test_clean_and_awkward(spark):
    docs = wide(awkward(spark))
    bench = spark.createDataFrame([(1, " ".join(prose(4).split()[10:40])), (None, prose(13)), (2, None), (1, "dup " + " ".join(prose(4).split()[10:40]))], "item_id long, text string")
    out = decontam.clean(docs, bench)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 4 not in ids and len(ids) == 16
    assert decontam.clean(empty(spark), bench).collect() == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.clean(docs, nothing).count() == 17


def test_index_serves_another_benchmark(spark):
    docs = spark.createDataFrame(leaky(), "doc_id long, text string")
    index = decontam.built(docs)
    for items in (ITEMS[:1], ITEMS[1:]):
        bench = spark.createDataFrame(items, "item_id long, text string")
        assert {(r.doc_id, r.item_id, r.kind) for r in decontam.matches(docs, bench, index).collect()} == brute(leaky(), items)


def test_very_long_item(spark):
    """With gaps of 2.5 lengths of the longest item, places of a segment pass 2**31."""
    item = [f"t{k}" for k in range(100_000)]
    rows = [(k, f"x{k} y{k} z") for k in range(30_000)]
    planted = list(range(0, 30_000, 1_000))
    for k in planted:
        rows[k] = (k, f"before {' '.join(item[k : k + 9])} after")
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = decontam.matches(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.kind, r.matched, r.place) for r in got) == [(k, "phrase", 9, 1) for k in planted]


def test_packed_numbers():
    x = np.array([0, 1, 127, 128, 300, 1 << 31, (1 << 40) + 5, 0])
    assert decontam.unpacked(np.frombuffer(decontam.packed(x), np.uint8)).tolist() == x.tolist()
    assert decontam.packed(x[:0]) == b""


def test_rows_of_one_doc_id_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "clean words"), (1, ITEMS[0][1]), (None, ITEMS[0][1]), (None, "other")], "doc_id long, text string")
    out = decontam.clean(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted(r.text for r in out.collect()) == ["clean words", "other"]
