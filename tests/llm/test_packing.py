import random
from collections import Counter, defaultdict

from llm.cases import awkward, empty, wide

from tidemill.llm import packing


def one_by_one(lengths, window):
    """The same rules on single pieces."""
    large = sorted(x for x in lengths if 3 * x > window)
    bins = []
    while large:
        k = large.pop()
        fits = [x for x in large if x <= window - k]
        if fits:
            large.remove(fits[-1])
        bins.append([k, *fits[-1:]])
    for k in sorted((x for x in lengths if 3 * x <= window), reverse=True):
        room = [b for b in bins if window - sum(b) >= k]
        if room:
            min(room, key=lambda b: window - sum(b)).append(k)
        else:
            bins.append([k])
    return Counter(tuple(sorted(b)) for b in bins), len(bins)


def by_plan(lengths, window):
    runs, n = packing.plan(Counter(lengths), window)
    bins, used = defaultdict(list), defaultdict(list)
    for length, rank, count, first, place in runs:
        used[length] += range(rank, rank + count)
        for j in range(count):
            bins[first + j].append((place, length))
    assert all(sorted(ranks) == list(range(len(ranks))) for ranks in used.values())
    for b in bins.values():
        at = 0
        for place, length in sorted(b):
            assert place == at
            at += length
        assert at <= window
    return bins, n


def test_plan_holds_all_and_pairs_large_as_brute_force():
    rng = random.Random(4)
    for trial in range(40):
        lengths = [rng.randint(1, 59) for _ in range(rng.randint(0, 120))]
        bins, n = by_plan(lengths, 60)
        assert n == len(bins) and sorted(x for b in bins.values() for _, x in b) == sorted(lengths)
        want, count = one_by_one(lengths, 60)
        pairs = lambda c: Counter(tuple(x for x in b if x > 20) for b in c if any(x > 20 for x in b))
        got = Counter(tuple(sorted(x for _, x in b)) for b in bins.values())
        assert pairs(got.elements()) == pairs(want.elements()) and n == count, trial
        assert all(sum(x > 20 for _, x in b) <= 2 for b in bins.values())


def test_pack(spark):
    docs = wide(awkward(spark))
    rows = packing.pack(docs, window=100).collect()
    tokens = {(r.doc_id, r.n_tokens) for r in packing.lengths(docs).collect()}
    total = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.n_tokens
        if r.bin_id is None:
            assert r.n_tokens == 0 and r.place is None
        else:
            bins[r.bin_id].append((r.place, r.n_tokens))
    want = defaultdict(int)
    for d, n in tokens:
        want[d] += n * (2 if d == 13 else 1)
    assert dict(total) == dict(want)
    for b in bins.values():
        at = 0
        for place, n in sorted(b):
            assert place == at
            at += n
        assert at <= 100
    assert sorted(bins) == list(range(len(bins)))
    assert sum(r.bin_id is None for r in rows) == 3


def test_empty(spark):
    assert packing.pack(empty(spark)).collect() == []


def test_pieces_tokenize_alike():
    rng = random.Random(1)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "it's", " 12", "!?", "é"]) for _ in range(60_000))
    assert packing.encode(text, packing.ranks_in()).tolist() == packing.encoder(packing.ranks_in()).encode_ordinary(text)


def test_equal_lengths_and_ids_are_ranked_once(spark):
    """A third of the pieces have one length and one doc_id, and their ranks are split over parts."""
    docs = spark.createDataFrame([(7, "the same words") for _ in range(300)] + [(k, "one " * (k % 5 + 1)) for k in range(600)] + [(None, "the same words")] * 20, "doc_id long, text string")
    rows = packing.pack(docs, window=64).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append((r.place, r.n_tokens))
    assert len(rows) == 920
    for b in bins.values():
        at = 0
        for place, n in sorted(b):
            assert place == at
            at += n
        assert at <= 64
