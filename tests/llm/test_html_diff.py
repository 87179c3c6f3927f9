import itertools
import os
import random
import time

from pyspark.sql import functions as F

from tidemill.llm import html_diff


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in "xy")
        on = html_diff.common(a, b)
        kept = [x for x, k in zip(a, on, strict=True) if k]
        rest = iter(b)
        assert sum(on) == lcs(a, b) and all(x in rest for x in kept)


def test_halved_table_gives_a_longest_one(monkeypatch):
    monkeypatch.setattr(html_diff, "TRACE_BITS", 40)
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in "xy")
        on = html_diff.common(a, b)
        rest = iter(b)
        assert sum(on) == lcs(a, b) and all(x in rest for x, k in zip(a, on, strict=True) if k)


def test_many_repeated_lines_take_bounded_time():
    a, b = (["x", "y"] * 4_000, ["y", "x", "x"] * 3_000)
    began = time.perf_counter()
    assert sum(html_diff.common(a, b)) >= 5_000
    assert time.perf_counter() - began < 5


def test_lines():
    page = "<head><title>t</title></head><body><script>var t='</p>'</script><nav><li>Home</li><li>A&amp;B</li></nav><p>one <b>two</b><br>three<!-- x --></p> <style>p{}</style>"
    assert html_diff.lines_of(page) == ["Home", "A&B", "one two", "three"]
    assert html_diff.lines_of(None) == html_diff.lines_of("") == html_diff.lines_of("<br><p>") == []


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        host = rng.choice(["a.example.com", "A.example.com", "b.example.com", "c.example.com"])
        body = "".join(f"<p>{w}</p>" for w in ["menu", "login", *(f"own {k} {j}" for j in range(rng.randint(0, 4))), f"host {host.lower()}", "footer"])
        rows.append((k, f"https://{host}/{rng.choice(['x', 'y'])}/{rng.randint(0, 30)}?q={k}", body))
    return rows


def brute(rows):
    pages = sorted((html_host(u), html_path(u), k, h) for k, u, h in rows)
    out = {}
    for n, (host, path, k, h) in enumerate(pages):
        beside = [pages[m] for m in (n - 1, n + 1) if 0 <= m < len(pages) and pages[m][0] == host]
        lines = html_diff.lines_of(h)
        if not beside:
            out[k] = (None, len(lines), 0)
            continue
        best = max(beside, key=lambda p: len(os.path.commonprefix([p[1], path])))
        out[k] = (best[2], len(lines), lcs(lines, html_diff.lines_of(best[3])))
    return out


def html_host(url):
    return url.split("/")[2].lower()


def html_path(url):
    return "/" + url.split("/", 3)[3].split("?")[0]


def test_matches_brute_force(spark):
    rows = made(60, 1) + [(99, "https://alone.example.com/z", "<p>one</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in html_diff.extracted(pages).collect()}
    assert {k: (r.near_id, r.n_lines, r.n_shared) for k, r in got.items()} == brute(rows)
    assert all(len(r.text.split("\n")) * bool(r.text) == r.n_lines - r.n_shared for r in got.values())
    assert got[99].text == "one"


def test_awkward_rows(spark):
    long = "".join(f"<p>line {k}</p>" for k in range(20_000))
    rows = [(1, None, "<p>a</p>"), (2, "https://h.net/1", None), (3, "https://h.net/2", ""), (None, "https://h.net/3", long), (4, "https://h.net/4", long), (4, "https://h.net/4", long), (5, "junk", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit(1).alias(c) for c in ("rid", "host", "path", "lines", "near", "text")))
    got = html_diff.extracted(pages).collect()
    assert len(got) == 7
    assert [(r.n_lines, r.n_shared, r.text) for r in got if r.page_id == 4] == [(20_000, 20_000, "")] * 2
    assert next(r.n_lines for r in got if r.page_id == 2) == 0
    assert html_diff.extracted(pages.limit(0)).collect() == []
