import random

import numpy as np
import pyarrow as pa
from tidemill.llm import url_filter

BAD, GOOD = ("casino", "cheap-pills", "win-prize", "xxx"), ("news", "docs", "library", "science")


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        label = k % 2
        words = (BAD, GOOD)[label]
        rows.append((k, f"https://{rng.choice(words)}{rng.randint(0, 99)}.example.com/{rng.choice(words)}/{rng.randint(0, 9999)}", label))
    return rows


def test_held_out_accuracy(spark):
    train = spark.createDataFrame(made(400, 1), "page_id long, url string, label int")
    test = spark.createDataFrame(made(200, 2), "page_id long, url string, label int")
    got = {r.page_id: r.keep for r in url_filter.classify(test, train).collect()}
    assert sum(got[k] == bool(label) for k, _, label in made(200, 2)) >= 190


def test_awkward_urls(spark):
    train = spark.createDataFrame(made(100, 1), "page_id long, url string, label int")
    urls = [(1, None), (2, ""), (3, "not a url"), (4, "https://h.example.com"), (None, "https://news.example.com/docs"), (5, "x" * 300_000), (6, "é://ü/ä"), (6, "é://ü/ä")]
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(urls, "page_id long, url string").select("*", F.lit(1).alias("host"), F.lit(2).alias("path"), F.lit(3).alias("keep"))
    rows = url_filter.classify(pages, train).collect()
    assert len(rows) == 8 and all(r.url_score is not None for r in rows)
    assert next(r.keep for r in rows if r.page_id is None)


def test_one_kind_of_label_and_empty(spark):
    one = spark.createDataFrame([(1, "https://a.b/c", 1)], "page_id long, url string, label int")
    assert [tuple(r)[2:] for r in url_filter.classify(one, one).collect()] == [(0.0, True)]
    none = spark.createDataFrame([], "page_id long, url string, label int")
    assert url_filter.classify(none, none).collect() == []


def test_labels_by_document_number(spark):
    pages = spark.createDataFrame([(1, "http://h.net/fr/25"), (2, "https://h.net/en/7.html?x=1"), (3, "https://h.net/"), (4, None)], "page_id long, url string")
    labels = spark.createDataFrame([(25, 1), (7, 0)], "doc_id long, label int")
    assert {(r.url[-2:], r.label) for r in url_filter.labelled_pages(pages, labels).collect()} == {("25", 1), ("=1", 0)}


def grams(url):
    """The same n-grams, as strings."""
    scheme, _, rest = url.partition("://")
    host, slash, path = rest.partition("/")
    out = set()
    for kind, part in (("host", host.lower()), ("path", slash + path)):
        marked = f"^{part}$" if part else ""
        out |= {(kind, marked[k : k + n]) for n in url_filter.SIZES for k in range(len(marked) - n + 1)}
    return out


def test_fit_agrees_with_brute_force(spark):
    """Logistic regression on the n-grams themselves, not hashed, by full steps."""
    train, test = made(300, 5), made(300, 6)
    vocabulary = {g: k for k, g in enumerate(sorted({g for _, u, _ in train for g in grams(u)}))}

    def matrix(rows):
        x = np.zeros((len(rows), len(vocabulary)))
        for i, (_, u, _) in enumerate(rows):
            own = grams(u)
            x[i, [vocabulary[g] for g in own if g in vocabulary]] = 1 / np.sqrt(len(own))
        return x

    x, y = matrix(train), np.array([label for _, _, label in train])
    w, bias = np.zeros(len(vocabulary)), 0.0
    for _ in range(2000):
        d = 1 / (1 + np.exp(-(x @ w + bias))) - y
        w -= 2.0 * (x.T @ d / len(y) + 1e-4 * w)
        bias -= 0.5 * d.mean()
    want = matrix(test) @ w + bias
    schema = "page_id long, url string, label int"
    got = {r.page_id: r.url_score for r in url_filter.classify(spark.createDataFrame(test, schema), spark.createDataFrame(train, schema)).collect()}
    score = np.array([got[k] for k, _, _ in test])
    assert np.mean((score >= 0) == (want >= 0)) > 0.97 and np.corrcoef(score, want)[0, 1] > 0.9


def test_features_are_the_grams():
    urls = [u for _, u, _ in made(50, 7)]
    parts = [u.split("://")[1].partition("/") for u in urls]
    batch = pa.record_batch([pa.array([f"^{h}$" for h, _, _ in parts]), pa.array([f"^{s}{p}$" for _, s, p in parts])], names=["host", "path"])
    doc, slot = url_filter.features(batch)
    for k, u in enumerate(urls):
        n = len(np.unique(slot[doc == k]))
        assert len(grams(u)) - 2 <= n <= len(grams(u))
