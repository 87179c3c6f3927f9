"""Cases of the page, text, site and completion functions, without Spark."""

from __future__ import annotations

import json
import re

import pytest

from tidemill.functions import cleanup, compact, markdown, sites, structured, verticals
from tidemill.functions.page import Converter, ExtractError, Extractor, Options, extract, most_words
from tidemill.functions.select import select
from tidemill.functions.tree import parse
from tidemill.operators import changes, completions
from tidemill.operators.crawl import decode_body, read_sitemap
from tidemill.sources import documents, scans

BASE = "https://example.com/page"


def page(body: str, url: str | None = BASE, **options):
    return extract(f"<html><body>{body}</body></html>", url, Options(**options))


def md(body: str, url: str | None = BASE, **options) -> str:
    return page(f"<article>{body}</article>", url, **options).content.markdown


# pages


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<p>Plain, <strong>bold</strong>, <em>slanted</em>.</p>", "Plain, **bold**, *slanted*."),
        ("<p><a href='/team'>Team</a></p>", "[Team](https://example.com/team)"),
        ("<h2>Title</h2><p>Text</p>", "## Title\n\n\nText"),
        ("<pre><code class='language-rust'>let x = 1;</code></pre>", "```rust\nlet x = 1;\n```"),
        ("<ul><li>a</li><li>b<ol><li>c</li></ol></li></ul>", "- a\n- b\n  1. c"),
        ("<blockquote><p>said</p></blockquote>", "> said"),
        ("<p>one</p><hr><p>two</p>", "one\n\n\n---\n\n\ntwo"),
        ("<p>use <code>x</code></p>", "use `x`"),
    ],
)
def test_markdown(body, want):
    assert want in md(body)


def test_tables():
    assert "| k | v |\n| --- | --- |\n| x | y |" in md("<table><tr><th>k</th><th>v</th></tr><tr><td>x</td><td>y</td></tr></table>")
    assert "|" not in md("<table><tr><td><div><p>block</p></div></td><td><h2>more</h2></td></tr></table>")


def test_code_blocks_links_and_images_keep_their_order():
    got = page('<article><p><a href="/a">A</a> <a href="/b">B</a><img src="/i.png" alt="I"></p><pre><code class="lang-py">x</code></pre></article>').content
    assert [href for _, href in got.links][:2] == ["https://example.com/a", "https://example.com/b"]
    assert got.images[0][1] == "https://example.com/i.png" and got.code_blocks[0][0] in ("py", "python")


def test_unclosed_bold_is_reopened_in_later_paragraphs():
    text = md("<p><b>one<br><p>two</p><p>three</p>")
    assert "**two**" in text and "**three**" in text


def test_noise_goes_but_its_links_stay():
    got = page('<nav><a href="/home">Home</a></nav><article><p>Main text here.</p></article><div class="ad">Buy</div><footer>Foot</footer>').content
    assert "Main text" in got.markdown and not any(x in got.markdown for x in ("Home", "Buy", "Foot"))
    assert ("Home", "https://example.com/home") in got.links


def test_include_and_exclude():
    body = "<nav>Nav</nav><article><h1>T</h1><p>Keep</p><div class='x'>Drop</div></article><p>Other</p>"
    got = page(body, include=("article",), exclude=(".x", "[[bad"))
    assert "Keep" in got.content.markdown and not any(x in got.content.markdown for x in ("Drop", "Other", "Nav"))


def test_errors():
    for html, url, kind in (("", BASE, "no_content"), ("<p>x</p>", "not a url", "invalid_url")):
        with pytest.raises(ExtractError) as e:
            extract(html, url)
        assert e.value.kind == kind
    assert extract("<p>x</p>", None).content.markdown == "x"


def test_deep_nesting_ends():
    assert "deep" in extract("<div>" * 3000 + "deep" + "</div>" * 3000, BASE).content.markdown


def test_selectors():
    doc = parse('<div id="a" class="x y"><p data-k="v1">1</p><span><p>2</p></span></div><p>3</p>')
    texts = lambda s: [n.text for n in select(doc, s)]
    assert texts("div p") == ["1", "2"] and texts("div > p") == ["1"] and texts("#a.x.y p[data-k^=v]") == ["1"] and texts("p, span") == ["1", "2", "2", "3"]


def test_structured_data():
    ld = '<script type="application/ld+json">{}</script>'.format
    assert structured.json_ld(ld('{"@type":"A"}') + ld('[{"@type":"B"},{"@type":"C"}]')) == [{"@type": "A"}, {"@type": "B"}, {"@type": "C"}]
    assert structured.json_ld(ld("{bad")) == [] and structured.json_ld(ld('{"a":"x\ny"}')) == [{"a": "x\ny"}]


# texts


@pytest.mark.parametrize(
    ("step", "text", "want"),
    [
        (cleanup.decode_entities, "a &amp; b &lt;c&gt; &#65; &unknown;", "a & b <c> A &unknown;"),
        (cleanup.decode_entities, "&amp;lt;", "&lt;"),
        (cleanup.strip_invisible, "a​b﻿", "ab"),
        (cleanup.collapse_phrases, "go home go home go home", "go home"),
        (cleanup.dedup_comma_lists, "Apple, apple, Banana, banana", "Apple, Banana"),
        (cleanup.dedup_comma_lists, "A, B, C", "A, B, C"),
        (cleanup.strip_emphasis, "**bold** and *it*", "bold and it"),
        (cleanup.strip_empty_code, "a\n```\n```\nb", "a\nb"),
    ],
)
def test_cleanup_steps(step, text, want):
    assert step(text).strip() == want


def test_repeated_sections_by_level():
    text = "## Features\n\nfirst text here\n\n## Features\n\nfirst text here"
    assert cleanup.drop_repeated_sections(text).count("## Features") == 1
    both = cleanup.drop_repeated_sections("## Foo\n\nx\n\n### Foo\n\ny")
    assert "## Foo" in both and "### Foo" in both


def test_body_is_stable_under_a_second_run():
    text = "# T\n\nSome words of text, with **bold** and [a link](https://e.com/x).\n\n- one\n- two\n"
    once, _ = cleanup.process_body(text)
    assert cleanup.process_body(once)[0] == once


def test_llm_text_has_header_body_and_links():
    got = compact.llm_text(page('<article><h1>T</h1><p>Body text and <a href="/docs">Docs page</a>.</p></article>'), BASE)
    assert got.startswith("> URL: https://example.com/page") and "Body text and Docs page." in got and "https://example.com/docs" in got


def test_plain_text():
    assert markdown.plain("# T\n\n[a](http://x) **b** `c` ![i](j)") == "T\n\na b c i"


# changes


def test_unified_diff():
    assert changes.unified("a\n", "a\n") is None
    got = changes.unified("a\nb\n", "a\nc\n")
    assert got.startswith("--- old\n+++ new\n@@ ") and "-b\n" in got and "+c\n" in got


# sitemaps and documents


def test_sitemaps():
    import gzip

    one = "<url><loc>https://e.com/{}</loc>{}</url>".format
    body = f"<urlset>{one('a', '<priority>0.5</priority>')}{one('b', '')}</urlset>".encode()
    kind, rows = read_sitemap(decode_body(gzip.compress(body)))
    assert kind == "urlset" and [r["url"] for r in rows] == ["https://e.com/a", "https://e.com/b"] and rows[0]["priority"] == 0.5
    kind, rows = read_sitemap("<sitemapindex><sitemap><loc>https://e.com/s.xml</loc></sitemap></sitemapindex>")
    assert kind == "index" and rows[0]["url"] == "https://e.com/s.xml"
    assert len(read_sitemap("<urlset><url><loc>https://e.com/a</loc></url><url><loc>")[1]) == 1
    assert decode_body(gzip.compress(body)[:30]) is None


def test_csv_docx_xlsx_pdf():
    import io
    import zipfile

    assert documents.csv_markdown(b'a,b\r\n"x, ""y""",2\n,\n') == '| a | b |\n| --- | --- |\n| x, "y" | 2 |'
    assert documents.csv_markdown(b"") == "(empty CSV)"
    w = f'xmlns:w="{"/".join(("http://schemas.openxmlformats.org", "wordprocessingml", "2006", "main"))}"'
    p = lambda style, text: f"<w:p><w:pPr><w:pStyle w:val='{style}'/></w:pPr> <w:r><w:t>{text}</w:t></w:r> </w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Heading2', 'Head')}{p('Normal', 'Text')}</w:body></w:document>")
    assert documents.read_document("docx", out.getvalue())["markdown"] == "## Head\n\nText"
    assert documents.read_document("docx", b"junk")["error_kind"] == "document"
    assert documents.read_document("pdf", b"not a pdf")["error_kind"] == "document"
    assert "error" in documents.read_document("xls", b"x")


def test_proxies_and_names():
    assert scans.proxy_url("h:1") == "http://h:1" and scans.proxy_url("h:1:u:p") == "http://u:p@h:1" and scans.proxy_url("# x:1") is None
    with pytest.raises(ValueError):
        scans.safe_name("../x")


# sites


def test_video_page():
    state = {"videoDetails": {"title": "T", "author": "Fireship", "lengthSeconds": "120", "viewCount": "1200000", "shortDescription": "D"}}
    html = f"<script>var ytInitialPlayerResponse = {json.dumps(state)};</script>"
    got = sites.video_page(html)
    assert "2:00" in got and "**Channel:** Fireship" in got and "1.2M" in got
    rec, error = verticals.record("youtube_video", "https://youtu.be/abc?t=1", html)
    assert error is None and json.loads(rec)["video_id"] == "abc" and json.loads(rec)["length_seconds"] == 120


URLS = {
    "reddit": ["https://www.reddit.com/r/x/comments/1/t/"], "hackernews": ["https://news.ycombinator.com/item?id=1", "https://hn.algolia.com/api/v1/items/7"],
    "github_repo": ["https://github.com/o/r", "https://www.github.com/o/r/?tab=x"], "pypi": ["https://pypi.org/project/requests/2.0/"],
    "npm": ["https://www.npmjs.com/package/@a/b"], "github_pr": ["https://github.com/o/r/pull/12/files"], "github_issue": ["https://github.com/o/r/issues/3"],
    "github_release": ["https://github.com/o/r/releases/tag/v1"], "crates_io": ["https://crates.io/crates/serde"],
    "huggingface_model": ["https://huggingface.co/o/m"], "huggingface_dataset": ["https://huggingface.co/datasets/o/d", "https://huggingface.co/datasets/d"],
    "arxiv": ["https://arxiv.org/abs/2401.1v2", "https://arxiv.org/pdf/2401.1.pdf"], "docker_hub": ["https://hub.docker.com/_/redis", "https://hub.docker.com/r/a/b"],
    "dev_to": ["https://dev.to/a/b"], "stackoverflow": ["https://stackoverflow.com/questions/5/t"], "linkedin_post": ["https://www.linkedin.com/posts/x-123456789012345-ab"],
    "instagram_post": ["https://www.instagram.com/reel/X/"], "instagram_profile": ["https://www.instagram.com/someone/"],
    "amazon_product": ["https://www.amazon.co.uk/T/dp/B0ABCDEFGH?x=1"], "ebay_listing": ["https://www.ebay.com/itm/title/123456789"],
    "etsy_listing": ["https://www.etsy.com/uk/listing/1234567/slug-here"], "trustpilot_reviews": ["https://www.trustpilot.com/review/e.com"],
    "youtube_video": ["https://www.youtube.com/watch?v=a", "https://youtube.com/shorts/a"], "chronopost": ["https://www.chronopost.fr/suivi?langue=fr&listeNumerosLT=XY1"],
}
NONE = [
    "https://github.com/settings/x", "https://github.com/o", "https://github.com/o/r/wiki/x", "https://example.com/", "https://huggingface.co/docs/x", "https://dev.to/t/x",
    "https://www.instagram.com/explore/", "https://www.amazon.com.evil.com/dp/B0ABCDEFGH", "https://notgithub.com/o/r", "https://stackoverflow.com/questions/tagged/x",
    "https://www.chronopost.fr/suivi?langue=fr", "https://www.etsy.com/listing/12", "https://shop.test/products/x", "https://hub.docker.com/search",
]


@pytest.mark.parametrize("name", list(URLS))
def test_vertical_by_url(name):
    assert [verticals.by_url(u) for u in URLS[name]] == [name] * len(URLS[name])


def test_urls_of_no_vertical():
    assert [u for u in NONE if verticals.by_url(u)] == []
    assert len(verticals.VERTICALS) == 29 and sum(not v.auto for v in verticals.VERTICALS.values()) == 5


def read(name, url, payload, second=None):
    out, error = verticals.record(name, url, payload if isinstance(payload, str) else json.dumps(payload), second and json.dumps(second))
    assert error is None, error
    return json.loads(out)


def test_code_records():
    got = read("github_repo", "https://github.com/o/r", {"name": "r", "owner": {"login": "o"}, "license": {"name": "MIT License", "spdx_id": "MIT"}, "stargazers_count": 5})
    assert (got["owner"], got["license"], got["stars"], got["topics"], got["forks"]) == ("o", "MIT", 5, [], None)
    got = read("github_pr", "https://github.com/o/r/pull/2", {"number": 2, "labels": [{"name": "a"}, {}], "head": {"ref": "h", "sha": "s"}})
    assert (got["repo"], got["labels"], got["head_ref"], got["head_sha"]) == ("r", ["a"], "h", "s")
    assert verticals.record("github_issue", "https://github.com/o/r/issues/2", '{"pull_request": {}}')[0] is None
    got = read("github_release", "https://github.com/o/r/releases/tag/v1", {"tag_name": "v1", "assets": [{"download_count": 3}, {"download_count": None}]})
    assert got["total_downloads"] == 3 and got["asset_count"] == 2
    info = {"name": "p", "version": "1.0", "classifiers": ["License :: A", "License :: A :: B", "X"]}
    got = read("pypi", "https://pypi.org/project/p/", {"info": info, "releases": {"1.0": [{"upload_time": "2020"}, {"upload_time": "2021"}], "0.9": []}})
    assert (got["license_classifier"], got["release_count"], got["latest_release_date"]) == ("License :: A :: B", 2, "2021")
    doc = {"dist-tags": {"latest": "2.0"}, "versions": {"1.0": {}, "2.0": {"license": "MIT", "devDependencies": {"a": "1"}}}, "time": {"2.0": "t"}}
    got = read("npm", "https://npmjs.com/package/@a/b", doc, {"downloads": 9})
    assert (got["name"], got["license"], got["weekly_downloads"], got["dev_dependencies"], got["latest_release_date"]) == ("@a/b", "MIT", 9, {"a": "1"}, "t")
    got = read("crates_io", "https://crates.io/crates/c", {"crate": {"id": "c"}, "versions": [{"yanked": True}, {"license": "MIT", "created_at": "t"}]})
    assert (got["name"], got["latest_license"], got["release_count"]) == ("c", "MIT", 2)
    got = read("huggingface_model", "https://huggingface.co/o/m", {"id": "o/m", "cardData": {"license": "mit"}, "siblings": [{"rfilename": "f", "size": 1}]})
    assert (got["license"], got["file_count"], got["files"][0]["size"]) == ("mit", 1, 1)
    got = read("docker_hub", "https://hub.docker.com/_/redis", {"name": "redis", "pull_count": 4})
    assert got["is_official"] and got["full_name"] == "library/redis"


def test_discussion_records():
    item = {"id": 1, "type": "story", "children": [{"id": 2, "type": "comment", "children": [{"id": 3, "type": "comment"}]}, {"type": "poll"}]}
    got = read("hackernews", "https://news.ycombinator.com/item?id=1", item)
    assert got["post"]["comment_count"] == 2 and got["comments"][0]["replies"][0]["id"] == 3
    got = read("stackoverflow", "https://stackoverflow.com/questions/5/x", {"items": [{"question_id": 5, "owner": {"display_name": "n"}}]}, {"items": [{"answer_id": 1, "is_accepted": False}, {"answer_id": 2, "is_accepted": True}]})
    assert got["accepted_answer"]["answer_id"] == 2 and got["author"] == "n" and len(got["top_answers"]) == 2
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id> http://arxiv.org/abs/1 </id><title>T</title><summary>a\n b</summary><author><name>N</name></author>' \
        '<category term="cs.X"/><link href="u" rel="alternate"/><link href="p" type="application/pdf"/></entry></feed>'  # fmt: skip
    got = read("arxiv", "https://arxiv.org/abs/2401.00001v3", atom)
    assert (got["id"], got["abstract"], got["authors"], got["primary_category"], got["pdf_url"], got["abs_url"]) == ("2401.00001", "a b", ["N"], "cs.X", "p", "u")


def product(**more):
    thing = {"@type": "Product", "name": "N", "brand": {"name": "B"}, "image": [{"url": "i"}], "offers": [{"price": 9.5, "priceCurrency": "EUR", "availability": "http://schema.org/" + "InStock"}]}
    return f'<script type="application/ld+json">{json.dumps({"@graph": [thing | more]})}</script>'


def test_shop_records():
    got = read("amazon_product", "https://www.amazon.com/dp/B0ABCDEFGH", product())
    assert (got["asin"], got["title"], got["brand"], got["image"], got["price"], got["availability"]) == ("B0ABCDEFGH", "N", "B", "i", "9.5", "InStock")
    got = read("etsy_listing", "https://www.etsy.com/listing/1234567/blue-mug", '<meta property="og:title" content="Etsy"><a href="/shop/Mine">')
    assert got["title"] == "Blue Mug" and got["shop_url"] == "https://www.etsy.com/shop/Mine"
    got = read("ebay_listing", "https://www.ebay.com/itm/123456789", product(aggregateRating={"ratingValue": 4}))
    assert got["item_id"] == "123456789" and got["aggregate_rating"]["rating_value"] == "4"
    got = read("ecommerce_product", "https://x.test/p", product(gtin13="1"))
    assert got["data_source"] == "jsonld" and got["gtin"] == "1" and got["images"] == ["i"] and got["offers"][0]["currency"] == "EUR"
    got = read("ecommerce_product", "https://x.test/p", '<meta property="product:price:amount" content="5"><meta property="og:title" content="T">')
    assert got["data_source"] == "og_fallback" and got["offers"][0]["price"] == "5"
    assert verticals.record("ecommerce_product", "https://x.test/p", "<p>nothing</p>")[0] is None
    got = read("shopify_product", "https://s.test/products/x?v=1", {"product": {"id": 1, "variants": [{"price": "3.5", "available": True}, {"price": "2"}, {"price": "?"}]}})
    assert (got["price_min"], got["price_max"], got["any_available"], got["json_url"]) == (2.0, 3.5, True, "https://s.test/products/x.json?v=1")
    got = read("shopify_collection", "https://s.test/collections/c/", {"collection": {"id": 1}}, {"products": [{"id": 2, "variants": [{"price": "1"}], "images": [{"src": "i"}]}]})
    assert got["products"][0]["price"] == "1" and got["products_in_page"] == 1 and got["meta_json_url"] == "https://s.test/collections/c.json"
    got = read("woocommerce_product", "https://s.test/product/x/", [{"id": 1, "prices": {"price": "100", "currency_code": "EUR"}, "categories": [{"name": "c"}]}])
    assert got["currency"] == "EUR" and got["categories"] == ["c"] and "slug=x" in got["api_url"]


def test_post_records():
    api = {"data": {"user": {"username": "u", "edge_followed_by": {"count": 3}, "edge_owner_to_timeline_media": {"count": 1, "edges": [{"node": {"shortcode": "s", "__typename": "GraphVideo", "is_video": True}}]}}}}
    got = read("instagram_profile", "https://www.instagram.com/u/", api)
    assert got["follower_count"] == 3 and got["recent_posts"][0]["kind"] == "video" and got["data_completeness"] == "api"
    got = read("instagram_profile", "https://www.instagram.com/u/", '<meta property="og:description" content="1.5M Followers, 2 Following, 3,000 Posts"><meta property="og:title" content="U (@u)">')
    assert (got["follower_count"], got["post_count"], got["full_name"]) == (1_500_000, 3000, "U")
    got = read("instagram_post", "https://www.instagram.com/reels/C/", '<div class="Caption"><a class="CaptionUsername" href="#">me</a> hi &amp; bye</div>')
    assert (got["kind"], got["author_username"], got["caption"], got["canonical_url"]) == ("reel", "me", "hi & bye", "https://www.instagram.com/reel/C/")
    got = read("linkedin_post", "https://www.linkedin.com/feed/update/urn:li:activity:12/", "<title>x | Ann</title>")
    assert got["urn"] == "urn:li:activity:12" and got["author_name"] == "Ann" and got["site_name"] == "LinkedIn"
    got = read("substack_post", "https://x.substack.com/p/s", {"id": 1, "audience": "only_paid", "publication": {"name": "P"}})
    assert got["has_paywall"] and got["publication"]["name"] == "P" and got["slug"] == "s"
    got = read("substack_post", "https://x.test/p/s", '<script type="application/ld+json">{"@type":"NewsArticle","headline":"H","author":[{"name":"A","url":"https://x/@a?x"}]}</script>')
    assert got["title"] == "H" and got["authors"] == [{"name": "A", "handle": "a"}] and got["data_source"] == "html_fallback"
    column = lambda n, c: {"csvw:name": n, "csvw:cells": [{"csvw:value": c, "csvw:notes": ["1%"]}]}
    table = {"@type": "Dataset", "about": {"@id": "/Organization/e.com"}, "name": "E", "mainEntity": {"csvw:tableSchema": {"csvw:columns": [column("1 star", "1"), column("5 stars", "3"), column("Total", "4")]}}}
    got = read("trustpilot_reviews", "https://www.trustpilot.com/review/e.com", f'<script type="application/ld+json">{json.dumps(table)}</script>')
    assert (got["business_name"], got["average_rating"], got["review_count"]) == ("E", "4.0", 4)
    top = '{}<div class="ch-suivi-colis-light-text">On its way</div></div>'.format('<div class="ch-suivi-colis-light-info active">')
    tab = "<tr><td>Mon<br>10:00</td><td>Paris<br/>Sorted</td><td>d</td></tr><tr><td>x</td></tr>"
    got = read("chronopost", "https://www.chronopost.fr/x?listeNumerosLT=XY1", {"top": top, "tab": tab})
    assert got["status"] == "On its way" and got["events"] == [{"date": "Mon", "time": "10:00", "office": "Paris", "event": "Sorted", "details": "d"}] and got["language"] == "en"


def test_records_of_bad_input():
    for name in verticals.VERTICALS:
        for payload in ("", "{", "[]", "null", '"x"', "<p>"):
            for url in (None, "", *URLS.get(name, ())):
                out, error = verticals.record(name, url, payload)
                assert (out is None) != (error is None)
    assert verticals.record("nope", "x", "y")[1]


# completions


def failing(_):
    raise completions.CompletionError("down")


def test_chain():
    ok = lambda r: "text"
    assert completions.Chain([("a", failing), ("b", ok)])(completions.summary_request("x")) == "text"
    with pytest.raises(completions.CompletionError, match="a: down; b: down"):
        completions.Chain([("a", failing), ("b", failing)])(completions.summary_request("x"))


def test_answers():
    assert completions.without_thinking("<think>a</think>hello <think>b</think>world") == "hello world"
    assert completions.without_thinking("good<think>open") == "good" and completions.without_thinking("x /think") == "x"
    assert completions.json_answer('<think>m</think>\n```json\n{"k": 1}\n```') == {"k": 1}
    with pytest.raises(completions.CompletionError):
        completions.json_answer("no json")


@pytest.mark.parametrize(
    ("style", "reply"),
    [
        ("chat", {"choices": [{"message": {"content": "hi"}}]}), ("messages", {"content": [{"text": "hi"}]}), ("local", {"message": {"content": "<think>x</think>hi"}}),
        ("generate", {"candidates": [{"content": {"parts": [{"text": "hi"}]}}]}),
    ],
)
def test_services(style, reply):
    service = completions.Service(style, "http://x.test", "m", "k")
    address, _, body = service.shaped(completions.schema_request("text", {"type": "object"}))
    assert address.startswith("http://x.test/") and "text" in json.dumps(body)
    assert service.answer(json.dumps(reply).encode()) == "hi"
    with pytest.raises(completions.CompletionError):
        service.answer(b"{}")


def test_lists_of_a_parsed_tree_give_what_a_walk_gives():
    from tidemill.functions.tree import parse

    def walked(node):
        for c in node.children:
            yield c
            yield from walked(c)

    for html in ("<table><b><tr><td>x</b>y<p>z</table><a href=/q>t", "<b><p>1</b>2</p><i><div>3</i>4</div><h2>5", "", "text", "<svg><a><p>x</svg><li>b<li>c<ul><li>d"):
        doc = parse(html)
        assert doc._order is not None
        for node in (doc, *walked(doc)):
            below = list(walked(node))
            assert list(node.walk()) == below and list(node.elements()) == [n for n in below if n.tag is not None]
            assert list(node.elements("li", "p", "b")) == [n for n in below if n.tag in ("li", "p", "b")]
            assert node.text == "".join(n.data for n in below if n.tag is None)


def test_no_part_of_a_page_has_more_words_than_its_bound():
    import random

    rnd = random.Random(3)
    marks = "<p> </p> <b> </b> <i> <em> </i> <a> </a> <a href='x y'> <div> </div> <ul> <ol> <li> </ul> <h1> </h1> <h3> <pre> </pre> <code> </code> <br> <hr> <nav> <script> </script>"
    marks = [*re.findall("<[^>]*>", marks), "<img src='a b' alt='c d e'>", "<img srcset='u 1x, v w 2x' alt=z>", "**", "[l](u)", "```", "\n", "&nbsp;", "# "]
    for _ in range(1500):
        html = "".join(rnd.choice(marks) if rnd.random() < 0.6 else " ".join(rnd.choices(["one", " two", "three\n"], k=3)) for _ in range(rnd.randrange(1, 40)))
        doc = parse(html)
        whole = Extractor(doc, None).content(Options(include=("body",)))
        assert whole.words <= most_words(doc, 1 << 30), html


def test_a_second_conversion_is_left_out_where_it_cannot_be_chosen(monkeypatch):
    """A page whose main part has more than half of its words is converted once."""
    calls = []
    convert = Converter.convert
    monkeypatch.setattr(Converter, "convert", lambda self, root: calls.append(root.tag) or convert(self, root))
    text = "word " * 40
    assert extract(f"<body><article><p>{text}</p></article><p>{text}</p></body>").metadata["word_count"] == 40
    assert calls == ["article"]
    assert extract(f"<body><article><p>{text}</p></article><p>{text}{text}</p></body>").metadata["word_count"] == 120
    assert calls == ["article", "article", "body"]


def test_a_payload_is_decoded_once(monkeypatch):
    texts = []
    monkeypatch.setattr(verticals, "loads", lambda text: texts.append(text) or structured.loads(text))
    got = read("crates_io", "https://crates.io/crates/c", {"crate": {"id": "c"}, "versions": [{"license": "MIT"}]})
    assert got["latest_license"] == "MIT" and len(texts) == 1


def test_properties_of_a_product_page_are_found_in_one_walk(monkeypatch):
    names = []
    monkeypatch.setattr(verticals, "meta", lambda html, name, *more: names.append(name))
    tags = {"product:price:amount": "5", "og:price:currency": "EUR", "product:availability": "in stock", "product:brand": "B"}
    html = "".join(f'<meta property="{k}" content="{v}"><meta property="{k}" content="later">' for k, v in tags.items())
    got = read("ecommerce_product", "https://s.example.com/p", html)
    offer = got["offers"][0]
    assert (offer["price"], offer["currency"], offer["availability"], got["brand"]) == ("5", "EUR", "in stock", "B") and not names


def test_elements_of_a_feed_are_named_once(monkeypatch):
    from xml.etree import ElementTree

    seen = []

    class Counted(ElementTree.Element):
        @property
        def tag(self):
            name = ElementTree.Element.tag.__get__(self)
            seen.append(name)
            return name

    parser = lambda: ElementTree.XMLParser(target=ElementTree.TreeBuilder(element_factory=Counted))
    monkeypatch.setattr(verticals.ElementTree, "fromstring", lambda text: ElementTree.XML(text, parser()))
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>1</id><title>T</title><title>U</title><summary/><published>2020</published><link href="u" rel="alternate"/></entry></feed>'
    got = read("arxiv", "https://arxiv.org/abs/2401.00001", atom)
    assert (got["title"], got["abstract"], got["published"], got["abs_url"]) == ("T", "", "2020", "u")
    assert sum(name.endswith("}link") for name in seen) == 1


def test_parcel_texts_without_references_are_not_searched_for_each(monkeypatch):
    texts, decoded = [], verticals.decoded
    monkeypatch.setattr(verticals, "decoded", lambda text, *more: texts.append(text) or decoded(text, *more))
    tab = "<TR></TR><tr><td>1/2<BR/>10:00</td><td>Paris<br>L&#39;&amp;lt; <b>x</b>’s</td><td>d</td></tr>"
    got = read("chronopost", "https://www.chronopost.fr/t?listeNumerosLT=X1", {"top": "", "tab": tab})
    assert got["events"] == [{"date": "1/2", "time": "10:00", "office": "Paris", "event": "L'&lt; x 's", "details": "d"}]
    assert texts == ["L&#39;&amp;lt;  x ’s"]


def test_a_list_of_fields_is_split_once():
    class Spec(str):
        splits = 0

        def split(self, *by):
            Spec.splits += 1
            return super().split(*by)

    spec = Spec("a b=c.d e[] f=g[].h i[]=j[].k.l")
    value = {"a": 1, "c": {"d": 2}, "e": [3, None], "g": [{"h": 4}, {}, None], "j": [{"k": {"l": 5}}, {"k": 6}]}
    got = [verticals.pick(x, spec) for x in (value, None, value, [])]
    assert got[0] == got[2] == {"a": 1, "b": 2, "e": [3, None], "f": [4], "i": [5]}
    assert got[1] == got[3] == {"a": None, "b": None, "e": [], "f": [], "i": []} and Spec.splits == 1


def test_fields_of_one_key_are_read_without_a_walk(monkeypatch):
    walks, at = [], verticals.at
    monkeypatch.setattr(verticals, "at", lambda value, *keys: walks.append(keys) or at(value, *keys))
    got = verticals.pick({"id": "m", "modelId": None, "cardData": {"license": "mit"}}, "id model_id=modelId sha license=cardData.license tags[]")
    assert got == {"id": "m", "model_id": None, "sha": None, "license": "mit", "tags": []}
    assert walks == [("cardData", "license"), ("tags",)]
