"""Extraction of a page: metadata, main content as markdown and plain text, and what lies around it.

Stages, in order: site fast paths; one parse; metadata; content by selectors, by the first main element, or by score,
with recovery of headings, banners and footers that scoring loses; two retries for thin results; text from embedded
data; the kind of site; structured data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from tidemill.functions import islands, scripts, sites, structured
from tidemill.functions.head import extract_metadata
from tidemill.functions.markdown import Converter, Link, resolve
from tidemill.functions.noise import NoiseMap
from tidemill.functions.select import select
from tidemill.functions.text import size, word_count
from tidemill.functions.tree import Node, parse
from tidemill.functions.whatwg import Url
from tidemill.functions.whatwg import parse as parse_url

MOST_SELECTORS = 100


@dataclass(frozen=True)
class Options:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    only_main: bool = False
    raw_html: bool = False


@dataclass
class Content:
    markdown: str = ""
    plain_text: str = ""
    links: list[Link] = field(default_factory=list)
    images: list[tuple[str, str]] = field(default_factory=list)
    code_blocks: list[tuple[str | None, str]] = field(default_factory=list)
    raw_html: str | None = None

    @property
    def words(self) -> int:
        return max(word_count(self.plain_text), word_count(self.markdown))


@dataclass
class Page:
    metadata: dict[str, Any]
    content: Content
    domain_type: str
    structured_data: list[Any]


class ExtractError(Exception):
    """kind is no_content or invalid_url."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


# scoring


def is_semantic(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("role") == "main"


def features(node: Node) -> dict[str, float]:
    """What the score is made of."""
    classes, name = node.attrs.get("class", "").lower(), node.attrs.get("id", "").lower()
    return {
        "text_bytes": size(node.text),
        "main_tag": node.tag in ("article", "main"),
        "main_role": node.attrs.get("role") == "main",
        "good_class": any(w in classes for w in ("article", "content", "entry", "post")),
        "good_id": any(w in name for w in ("article", "content", "main", "post")),
        "paragraphs": sum(1 for _ in node.elements("p")),
        "link_bytes": sum(size(a.text) for a in node.elements("a")),
    }


def score(f: dict[str, float]) -> float:
    if f["text_bytes"] < 50:
        return 0.0
    total = math.log(f["text_bytes"]) + 50 * f["main_tag"] + 50 * f["main_role"] + 25 * f["good_class"] + 25 * f["good_id"] + 3 * f["paragraphs"]
    density = f["link_bytes"] / f["text_bytes"]
    if f["main_tag"] or f["main_role"]:
        return total * (0.3 if density > 0.7 else 0.5 if density > 0.5 else 1)
    return total * (0.1 if density > 0.5 else 0.5 if density > 0.3 else 1)


def candidates(doc: Node, noise: NoiseMap) -> Iterator[Node]:
    for n in doc.elements():
        if (n.tag in ("article", "div", "main", "section", "td") or n.attrs.get("role") == "main") and not noise.on_path(n):
            yield n


def best_node(doc: Node, noise: NoiseMap) -> Node | None:
    best, top = None, 0.0
    for n in candidates(doc, noise):
        value = score(features(n))
        if value > top:
            best, top = n, value
    return best


# content


class Extractor:
    def __init__(self, doc: Node, base: Url | None):
        self.doc, self.base, self.noise = doc, base, NoiseMap()

    def content(self, options: Options) -> Content:
        excluded = frozenset(
            n.index for text in options.exclude[:MOST_SELECTORS] for top in select(self.doc, text) for n in (top, *top.elements())
        )
        converter = Converter(self.base, self.noise, excluded)
        if options.include:
            return self.included(converter, options)
        if options.only_main:
            top = next((n for n in self.doc.elements() if is_semantic(n)), None)
            if top is not None:
                return self.converted(converter, top, options)
        top = best_node(self.doc, self.noise) or next(self.doc.elements("body"), None) or self.doc.children[0]
        out = self.converted(converter, top, options)
        self.recover(out)
        return out

    def converted(self, converter: Converter, top: Node, options: Options) -> Content:
        text, flat, assets = converter.convert(top)
        return Content(text, flat, assets.links, assets.images, assets.code, top.outer() if options.raw_html else None)

    def included(self, converter: Converter, options: Options) -> Content:
        parts = [
            self.converted(converter, n, options) for text in options.include for n in select(self.doc, text) if n.index not in converter.excluded
        ]
        return Content(
            "\n\n".join(p.markdown for p in parts if p.markdown),
            "\n".join(p.plain_text for p in parts if p.plain_text),
            *([x for p in parts for x in getattr(p, name)] for name in ("links", "images", "code_blocks")),
            "".join(p.raw_html for p in parts) if options.raw_html else None,
        )

    # recovery of what scoring leaves out

    def recover(self, out: Content) -> None:
        h1 = next(self.doc.elements("h1"), None)
        if h1 is not None:
            text = h1.text.strip()
            while text and not text[-1].isalnum():
                text = text[:-1]
            text = text.strip()
            if text and text not in out.markdown:
                out.markdown = f"# {text}\n\n{out.markdown}"
                self.hero(h1, out)
        self.announcements(out)
        self.headings(out)
        self.eyebrows(out)
        for footer in list(self.doc.elements("footer")):
            self.calls(footer, out)
        for footer in self.doc.elements("footer"):
            self.sitemap(footer, out)

    def hero(self, h1: Node, out: Content) -> None:
        """The first fitting paragraph near the heading, after its line."""
        for _, parent in zip(range(4), h1.ancestors(), strict=False):
            for p in parent.elements("p"):
                text = p.words
                if 40 <= size(text) <= 300 and text not in out.markdown:
                    head, mark, tail = out.markdown.partition("\n")
                    out.markdown = f"{head}{mark}\n{text}\n{tail}"
                    return

    def announcements(self, out: Content) -> None:
        for n in self.doc.elements():
            if n.attrs.get("role") != "region" or "announcement" not in n.attrs.get("aria-label", "").lower():
                continue
            text = n.words
            if text and text not in out.markdown:
                out.links.extend(link for a in n.elements("a") if all(link := self.target(a)))
                out.markdown = f"> **{text}**\n\n{out.markdown}"

    def target(self, a: Node) -> Link:
        return a.text.strip(), resolve(a.attrs["href"], self.base) if "href" in a.attrs else ""

    def headings(self, out: Content) -> None:
        for h2 in self.doc.elements("h2"):
            text = h2.text.strip()
            if not text or find(out.markdown, text) >= 0 or in_furniture(h2):
                continue
            anchor = self.anchor(h2, out.markdown)
            if anchor is not None:
                line = out.markdown.rfind("\n", 0, find(out.markdown, anchor)) + 1
                at = before_orphans(out.markdown, line)
                out.markdown = f"{out.markdown[:at]}## {text}\n\n{out.markdown[at:]}"

    def anchor(self, heading: Node, markdown: str) -> str | None:
        """Text of the heading's section that the markdown has."""
        section = next((n for n in heading.ancestors() if n.tag in ("article", "body", "main", "section")), None)
        own = heading.text
        for n in section.elements("h3", "h4", "p") if section is not None else ():
            text = n.words
            if text and text not in own and size(text) > 15 and find(markdown, text) >= 0:
                return text
        return None

    def eyebrows(self, out: Content) -> None:
        """Short paragraphs just before a heading."""
        for h2 in self.doc.elements("h2"):
            title = h2.text.strip()
            if not title or find(out.markdown, title) < 0 or h2.parent is None:
                continue
            for n in h2.parent.children:
                if n is h2:
                    break
                text = n.text.strip() if n.tag == "p" else ""
                if not text or size(text) > 80 or text.startswith("/") or text in out.markdown.replace("*", ""):
                    continue
                at = find(out.markdown, title)
                if at >= 0:
                    line = out.markdown.rfind("\n", 0, at) + 1
                    out.markdown = f"{out.markdown[:line]}*{text}*\n\n{out.markdown[line:]}"

    def calls(self, footer: Node, out: Content) -> None:
        """Footer headings, and links to documentation, applications and interfaces."""
        for h2 in footer.elements("h2"):
            text, classes = h2.text.strip(), h2.attrs.get("class", "").lower()
            hidden = any(c in classes for c in ("screen-reader", "sr-only", "visually-hidden"))
            if text and text not in out.markdown and text.lower() not in ("footer", "navigation", "site map") and not hidden:
                out.markdown += f"\n\n## {text}\n\n"
        for a in footer.elements("a"):
            text, href = self.target(a)
            if text and href and text not in out.markdown and any(w in href.lower() for w in ("/app", "/docs", "api.", "app.", "docs.")):
                out.markdown += f"[{text}]({href})\n\n"
                out.links.append((text, href))

    def sitemap(self, footer: Node, out: Content) -> None:
        found = []
        for h in footer.elements("h2", "h3", "h4", "h5", "h6"):
            text = h.text.strip()
            if text and size(text) <= 50 and text.lower() != "footer" and text not in out.markdown:
                links = self.beside(h)
                if 2 <= len(links) <= 20:
                    found.append((text, links))
        if len(found) >= 3:
            out.markdown += "\n\n---\n\n" + "".join(f"**{text}**: {', '.join(t for t, _ in links)}\n" for text, links in found)
            out.links.extend(link for _, links in found for link in links)

    def beside(self, heading: Node) -> list[Link]:
        for _, parent in zip(range(2), heading.ancestors(), strict=False):
            anchors = list(parent.elements("a"))
            if len(anchors) >= 2:
                links = [self.target(a) for a in anchors]
                return [(t, h) for t, h in links if h and 1 < size(t) < 60 and t.lower() not in ("click", "here", "link", "more")]
        return []


#: Words that an element's marks alone can add to its markdown.
_MARK_WORDS = dict.fromkeys("b em h1 h2 h3 h4 h5 h6 hr i li strong".split(), 1) | {"code": 2, "pre": 2}


def most_words(doc: Node, enough: int) -> int:
    """No fewer words than the markdown of any part of the page has, found without converting it. Quotes and tables, whose marks
    depend on lines and widths, count as more than enough."""
    most = 0
    for n in doc.walk():
        tag = n.tag
        if tag is None:
            most += len(n.data.split())
        elif tag in ("blockquote", "table"):
            return enough + 1
        elif tag in ("a", "img"):
            most += 1 + sum(len(v.split()) + v.count(",") for v in n.attrs.values())
        else:
            most += _MARK_WORDS.get(tag, 0)
        if most > enough:
            return most
    return most


def in_furniture(n: Node) -> bool:
    return any(a.tag in ("aside", "footer", "header", "nav") or a.attrs.get("role") in ("contentinfo", "navigation") for a in n.ancestors())


def find(markdown: str, needle: str) -> int:
    """The first place of needle outside an image's description; -1 if none."""
    at = markdown.find(needle)
    while at >= 0 and in_image(markdown, at):
        at = markdown.find(needle, at + max(len(needle), 1))
    return at


def in_image(markdown: str, at: int) -> bool:
    shut = markdown.rfind(")", 0, at)
    opened = markdown.find("![", max(shut, 0), at)
    return opened >= 0 and "](" in markdown[at:]


def before_orphans(markdown: str, at: int) -> int:
    """Back over empty and very short lines."""
    while at:
        end = at - 1
        begin = markdown.rfind("\n", 0, end) + 1
        line = markdown[begin:end].strip()
        if line and (line[0] in "#>" or size(line) > 25):
            break
        at = begin
    return at


def domain_type(url: str | None, html: str) -> str:
    """Kind of site, by marks in the URL and then in the source."""
    if url is not None:
        lower = url.lower()
        for kind, marks in URL_KINDS:
            if any(m in lower for m in marks):
                return kind
    lower = html.lower()
    for kind, marks in SOURCE_KINDS:
        if any(m in lower for m in marks):
            return kind
    return "generic"


URL_KINDS = (
    ("git_hub", ("github.com", "gitlab.com")),
    ("documentation", tuple("/docs/ /documentation/ developer.apple.com/documentation developer.mozilla.org devdocs.io doc.rust-lang.org docs. docusaurus gitbook readthedocs".split())),
    ("forum", tuple("community. discourse forum news.ycombinator.com reddit.com stackexchange.com stackoverflow.com".split())),
    ("social", tuple("bsky.app facebook.com instagram.com linkedin.com mastodon twitter.com x.com".split())),
    ("e_commerce", tuple("/cart /product/ /shop/ amazon. ebay. etsy.com shopify.".split())),
)
SOURCE_KINDS = (("article", ("<article", "schema.org/article")), ("documentation", ("doc-content", "docsearch", "sidebar-nav")))


def extract(html: str, url: str | None = None, options: Options = Options()) -> Page:  # noqa: B008
    if not html:
        raise ExtractError("no_content", "the page is empty")
    if url is not None and sites.is_reddit(url):
        thread = sites.thread_page(html, url)
        if thread is not None:
            metadata, text, flat = thread
            return Page(metadata, Content(text, flat), "social", [])
        if "/comments/" in url:
            raise ExtractError("no_content", "the thread could not be read")
    if url is not None and sites.is_video(url) and (video := sites.video_page(html)) is not None:
        metadata = extract_metadata(parse(html), url) | {"word_count": word_count(video)}
        flat = "\n".join(x for x in video.split("\n") if not x.startswith(("#", "**"))).strip()
        return Page(metadata, Content(video, flat), "social", structured.json_ld(html))
    if url is not None and sites.is_post(url) and (post := sites.post_page(html, url)) is not None:
        return Page(post[0], Content(post[1]), "social", [])
    doc = parse(html)
    base = None
    if url is not None:
        base = parse_url(url)
        if base is None:
            raise ExtractError("invalid_url", f"not a URL: {url}")
    metadata = extract_metadata(doc, url)
    extractor = Extractor(doc, base)
    content = extractor.content(options)
    words = content.words
    if options.only_main and words < 30:
        retry = extractor.content(replace(options, only_main=False))
        if retry.words > words:
            content, words = retry, retry.words
    if words < 200 and not options.include and most_words(doc, max(2 * words, 50)) > max(2 * words, 50):
        retry = extractor.content(Options(include=("body",), exclude=options.exclude))
        if retry.words > 2 * words and retry.words > 50:
            content, words = retry, retry.words
    for more in (islands.text_of(doc, words, content.markdown), scripts.text_of(doc, html)):
        if more:
            content.markdown += f"\n\n{more}"
            words = word_count(content.markdown)
    metadata["word_count"] = words
    return Page(metadata, content, domain_type(url, html), structured.structured(html))
