import math
from collections import Counter

import pyarrow as pa
from llm.cases import awkward, empty, prose, wide

from tidemill.llm import lm
from tidemill.llm.tokens import words_of


def labels(spark, ids):
    return spark.createDataFrame([(i, 1) for i in ids], "doc_id long, label int")


def brute(texts, target):
    """Losses by dictionaries of the same hashed slots."""
    models = []
    for marked in (target, [True] * len(texts)):
        uni, follow, pair = Counter(), Counter(), Counter()
        for text, m in zip(texts, marked, strict=True):
            if m:
                word, place, pairs = lm.slots(words_of(pa.array([text])))
                uni.update(word.tolist())
                follow.update(word[place - 1].tolist())
                pair.update(pairs.tolist())
        models.append((uni, follow, pair))
    size = len(models[1][0])
    out = []
    for text in texts:
        word, place, pairs = (x.tolist() for x in lm.slots(words_of(pa.array([text]))))
        losses = []
        for uni, follow, pair in models:
            total, n = max(sum(uni.values()), 1), 0.0
            by_place = dict(zip(place, pairs, strict=True))
            for k, w in enumerate(word):
                p = (lm.A + lm.B) * uni[w] / total
                if k in by_place and follow[word[k - 1]]:
                    p = lm.A * pair[by_place[k]] / follow[word[k - 1]] + lm.B * uni[w] / total
                n -= math.log(p + lm.C / size)
            losses.append(n / max(len(word), 1))
        out.append(losses)
    return out


def test_matches_brute_force(spark):
    texts = [prose(k % 4, 60 + k) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, labels(spark, [0, 4, 8])).collect()}
    for k, (target, background) in enumerate(brute(texts, [k in (0, 4, 8) for k in range(12)])):
        assert abs(got[k].loss_target - target) < 1e-5 and abs(got[k].loss_background - background) < 1e-5
    assert min(got[k].score for k in (1, 2, 3)) > max(got[k].score for k in (0, 4, 8))


def test_awkward_rows(spark):
    rows = lm.score(wide(awkward(spark)), labels(spark, [1, 4, 10])).collect()
    assert len(rows) == 17
    assert all((r.score is None) == (r.n_words == 0) for r in rows)
    assert len({(r.n_words, r.score) for r in rows if r.doc_id == 13}) == 1


def test_no_target_and_empty(spark):
    rows = lm.score(awkward(spark), labels(spark, [])).collect()
    assert all(r.loss_target > r.loss_background for r in rows if r.n_words and r.n_words > 1)
    assert lm.score(empty(spark), labels(spark, [1])).collect() == []


def test_words_that_share_leading_hash_bits_are_counted_apart(spark):
    """Losses by dictionaries of the words themselves: of so many, some agree in the first 18 bits of their hashes."""
    texts = [" ".join(f"w{j}" for j in range(500 * k, 500 * k + 1000)) for k in range(8)] + ["w1 w2 w1 w2 w9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, labels(spark, [0, 8])).collect()}
    size = len({w for t in texts for w in t.split()})
    for name, used in (("loss_target", [texts[0], texts[8]]), ("loss_background", texts)):
        words = Counter(w for t in used for w in t.split())
        follow = Counter(w for t in used for w in t.split()[:-1])
        pairs = Counter(p for t in used for p in zip(t.split(), t.split()[1:], strict=False))
        total = sum(words.values())
        for k, text in enumerate(texts):
            n, last = 0.0, None
            for w in text.split():
                p = lm.A * pairs[last, w] / follow[last] + lm.B * words[w] / total if follow[last] else (lm.A + lm.B) * words[w] / total
                n -= math.log(p + lm.C / size)
                last = w
            assert abs(got[k][name] - n / len(text.split())) < 1e-5
