"""Elements to markdown, and markdown to plain text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tidemill.functions.noise import NoiseMap
from tidemill.functions.text import lines, squeeze
from tidemill.functions.tree import Node
from tidemill.functions.whatwg import Url, parse

DEEPEST = 200
BLOCKS = frozenset("article aside blockquote div footer h1 h2 h3 h4 h5 h6 header hr nav ol p pre section table ul".split())
_CLOSING, _OPENING = frozenset(".,;:!?)]}%'’\"”"), frozenset('([{"“')
_LANGUAGES = frozenset(
    "bash c clojure console cpp csharp css dart diff dockerfile elixir erlang fish go graphql haskell html java javascript json "
    "jsx kotlin less lua makefile markdown matlab md nim perl php plaintext protobuf python r ruby rust sass scala scss shell "
    "sql svelte swift text toml tsx typescript vue wasm xml yaml yml zig zsh".split()
)
_ALIASES = {"js": "javascript ", "ts": "typescript ", "python": "py ", "csharp": "cs c# ", "cpp": "c++ ", "bash": "shell zsh sh ", "yaml": "yml ", "markdown": "md ", "text": "plaintext "}
_CANONICAL = {other: name for name, others in _ALIASES.items() for other in others.split()}

Link = tuple[str, str]


@dataclass
class Assets:
    links: list[Link] = field(default_factory=list)
    images: list[tuple[str, str]] = field(default_factory=list)
    code: list[tuple[str | None, str]] = field(default_factory=list)


def resolve(href: str, base: Url | None) -> str:
    if href.startswith(("http://", "https://", "//")) or base is None:
        return href
    got = parse(href, base)
    return href if got is None else str(got)


def separated(left: str, right: str) -> bool:
    """Whether two chunks that meet need a space between them."""
    a, b = left[-1:] or " ", right[:1] or " "
    if a.isspace() or b.isspace() or b in _CLOSING or a in _OPENING:
        return False
    return not (a in "`)" and _suffix(right))


def _suffix(text: str) -> bool:
    """A possessive or plural after code: it stays attached."""
    text = text.lstrip("*_")
    if text[:1] in ("'", "’"):
        return True
    return text[:1] in ("s", "S") and (len(text) == 1 or text[1].isspace() or text[1] in _CLOSING or text[1] in "*_")


def language_of(classes: str) -> str | None:
    for name in classes.split():
        for head in ("language-", "lang-", "highlight-"):
            rest = name[len(head) :]
            if name.startswith(head) and 0 < len(rest.encode()) < 20:
                return _canonical(rest)
        for bare in ([name[3:]] if name.startswith("sp-") else []) + [name]:
            if bare.lower() in _LANGUAGES:
                return _canonical(bare)
    return None


def _canonical(name: str) -> str:
    return _CANONICAL.get(name.lower(), name.lower())


def best_source(srcset: str) -> str | None:
    best, top = None, 0
    for entry in srcset.split(","):
        parts = entry.split()
        if not parts or parts[0].startswith(("data:", "blob:")):
            continue
        digits = re.sub(r"[^0-9]+\Z", "", parts[1]) if len(parts) > 1 else ""
        width = int(digits) if digits.isascii() and digits.isdigit() and int(digits) < 1 << 32 else 1
        if width > top:
            best, top = parts[0], width
    return best


class Converter:
    """Conversion of elements of one document; excluded elements give nothing."""

    def __init__(self, base: Url | None, noise: NoiseMap, excluded: frozenset[int] = frozenset()):
        self.base, self.noise, self.excluded = base, noise, excluded
        self.assets = Assets()
        self._blocky: dict[int, bool] = {}

    def convert(self, root: Node) -> tuple[str, str, Assets]:
        self.assets = Assets()
        text = self.node(root, 0, 0)
        return tidy(text), tidy(plain(text)), self.assets

    def blocky(self, node: Node) -> bool:
        got = self._blocky.get(node.index)
        if got is None:
            got = self._blocky[node.index] = node.tag in BLOCKS or any(n.tag in BLOCKS for n in node.walk())
        return got

    def node(self, n: Node, nesting: int, depth: int) -> str:
        if n.index in self.excluded:
            return ""
        if depth > DEEPEST:
            return n.text
        if self.noise.on_path(n):
            self.from_noise(n)
            return ""
        tag = n.tag
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            return f"\n\n{'#' * int(tag[1])} {self.inline(n, depth)}\n\n"
        handler = _HANDLERS.get(tag)
        return handler(self, n, nesting, depth) if handler else self.children(n, nesting, depth)

    def children(self, n: Node, nesting: int, depth: int) -> str:
        out, last = [], ""
        for child in n.children:
            chunk = child.data if child.tag is None else self.node(child, nesting, depth + 1)
            if chunk:
                if last and separated(last, chunk):
                    out.append(" ")
                out.append(chunk)
                last = chunk
        return "".join(out)

    def inline(self, n: Node, depth: int) -> str:
        return squeeze(self.children(n, 0, depth))

    def paragraph(self, n: Node, nesting: int, depth: int) -> str:
        return f"\n\n{self.inline(n, depth)}\n\n"

    def link(self, n: Node, nesting: int, depth: int) -> str:
        text = self.inline(n, depth)
        href = resolve(n.attrs["href"], self.base) if "href" in n.attrs else ""
        if text and href:
            self.assets.links.append((text, href))
            return f"[{text}]({href})"
        return text

    def image(self, n: Node, nesting: int, depth: int) -> str:
        alt = n.attrs.get("alt", "")
        raw = next((n.attrs[k] for k in ("src", "data-src", "data-lazy-src", "data-original") if k in n.attrs), "")
        src = "" if raw.startswith(("data:", "blob:")) else resolve(raw, self.base)
        if not src and (best := best_source(n.attrs.get("srcset", ""))):
            src = resolve(best, self.base)
        if not src:
            return ""
        self.assets.images.append((alt, src))
        return f"![{alt}]({src})"

    def strong(self, n: Node, nesting: int, depth: int) -> str:
        return self.children(n, nesting, depth) if self.blocky(n) else f"**{self.inline(n, depth)}**"

    def emphasis(self, n: Node, nesting: int, depth: int) -> str:
        return self.children(n, nesting, depth) if self.blocky(n) else f"*{self.inline(n, depth)}*"

    def code(self, n: Node, nesting: int, depth: int) -> str:
        if not n.text or any(a.tag == "pre" for a in n.ancestors()):
            return n.text
        return f"`{n.text}`"

    def pre(self, n: Node, nesting: int, depth: int) -> str:
        inner = next(n.elements("code"), None)
        language = language_of(inner.attrs.get("class", "")) if inner else None
        language = language or language_of(n.attrs.get("class", ""))
        code = preformatted(inner or n, depth).strip("\n")
        self.assets.code.append((language, code))
        return f"\n\n```{language or ''}\n{code}\n```\n\n"

    def quote(self, n: Node, nesting: int, depth: int) -> str:
        return "\n\n" + "\n".join(f"> {x}" for x in lines(self.children(n, nesting, depth).strip())) + "\n\n"

    def bullets(self, n: Node, nesting: int, depth: int) -> str:
        return f"\n\n{self.items(n, nesting, depth)}\n\n"

    def items(self, n: Node, nesting: int, depth: int) -> str:
        out, number = [], 0
        for item in n.children:
            if item.tag != "li" or item.index in self.excluded:
                continue
            number += 1
            own, below = [], []
            for child in item.children:
                if child.tag is None:
                    own.append(child.data)
                elif child.index in self.excluded:
                    continue
                elif child.tag in ("ul", "ol"):
                    below.append(self.items(child, nesting + 1, depth + 1))
                else:
                    own.append(self.node(child, nesting, depth + 1))
            mark = f"{number}." if n.tag == "ol" else "-"
            out.append(f"{'  ' * nesting}{mark} {squeeze(''.join(own))}\n" + "".join(below))
        return "".join(out).rstrip("\n")

    def item(self, n: Node, nesting: int, depth: int) -> str:
        return f"- {self.inline(n, depth)}\n"

    def table(self, n: Node, nesting: int, depth: int) -> str:
        return f"\n\n{self.rows(n, depth)}\n\n"

    def rows(self, n: Node, depth: int) -> str:
        rows = []
        for row in n.elements("tr"):
            if row.index not in self.excluded:
                cells = [c for c in row.children if c.tag in ("td", "th") and c.index not in self.excluded]
                if cells:
                    rows.append(cells)
        if any(self.blocky(c) for row in rows for c in row):  # a layout, not data
            return "\n\n".join(filter(None, (self.children(c, 0, depth).strip() for row in rows for c in row)))
        if not rows:
            return ""
        grid = [[self.inline(c, depth) for c in row] for row in rows]
        width = max(map(len, grid))
        written = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in grid]
        headed = any(c.tag == "th" for row in rows for c in row)
        return "\n".join([written[0], f"| {' | '.join(['---'] * width)} |", *written[headed:]]).rstrip()

    def from_noise(self, n: Node) -> None:
        """Furniture still gives its described images and its web links."""
        for img in n.elements("img"):
            alt, src = img.attrs.get("alt"), img.attrs.get("src")
            if alt and src is not None and (src := resolve(src, self.base)):
                self.assets.images.append((alt, src))
        for a in n.elements("a"):
            if "href" in a.attrs:
                href, text = resolve(a.attrs["href"], self.base), a.text.strip()
                if text and href.startswith("http"):
                    self.assets.links.append((text, href))


_HANDLERS = {
    "p": Converter.paragraph, "a": Converter.link, "img": Converter.image, "strong": Converter.strong, "b": Converter.strong,
    "em": Converter.emphasis, "i": Converter.emphasis, "code": Converter.code, "pre": Converter.pre, "blockquote": Converter.quote,
    "ul": Converter.bullets, "ol": Converter.bullets, "li": Converter.item, "table": Converter.table,
    "hr": lambda *_: "\n\n---\n\n", "br": lambda *_: "\n",
}


def preformatted(n: Node, depth: int = 0) -> str:
    """Text with its line breaks; br, div and p make lines."""
    if depth > DEEPEST:
        return n.text
    out = ""
    for child in n.children:
        if child.tag is None:
            out += child.data
        elif child.tag == "br":
            out += "\n"
        elif child.tag in ("div", "p"):
            if out and not out.endswith("\n"):
                out += "\n"
            out += preformatted(child, depth + 1)
            if not out.endswith("\n"):
                out += "\n"
        else:
            out += preformatted(child, depth + 1)
    return out


_EMPTIES = re.compile("\n{4,}")


def tidy(text: str) -> str:
    """At most two empty lines together, no space at line ends; fenced code keeps its lines."""
    if "```" not in text:
        return _EMPTIES.sub("\n\n\n", "\n".join([line.rstrip() for line in text.split("\n")])).strip()
    out: list[str] = []
    empty, fenced = 0, False
    for line in lines(text):
        line, opens = line.rstrip(), line.lstrip().startswith("```")
        if opens:
            fenced = not fenced
        if opens or not fenced:
            empty = 0 if line or opens else empty + 1
        if opens or fenced or line or empty <= 2:
            out.append(line)
    return "\n".join(out).strip()


_LINK = r"\[([^\]]*)\]" + r"\([^)]*\)"
#: A mark that the text must have, the pattern and what comes in its place.
_INLINE = [
    (mark, re.compile(p), r"\1")
    for mark, p in (("![", f"!{_LINK}"), ("[", _LINK), *((m.replace("\\", ""), rf"{m}([^{m[-1]}]+){m}") for m in (r"\*\*", r"\*", "`")))
] + [("#", re.compile("(?m)" + r"^#{1,6}\s+"), "")]
_DASHES = r"\|\s*:?-{2,}:?\s*"
_RULE = re.compile(rf"{_DASHES}({_DASHES})*\|")


def plain(text: str) -> str:
    """Markdown without its marks; table rows become tab-separated, fence lines go."""
    for mark, pattern, to in _INLINE:
        if mark in text:
            text = pattern.sub(to, text)
    if "|" not in text and "```" not in text:
        return "\n".join(lines(text))
    out = []
    for line in lines(text):
        bare = line.strip()
        if line.lstrip().startswith("```") or _RULE.fullmatch(bare):
            continue
        if len(bare) >= 2 and bare[0] == bare[-1] == "|":
            line = "\t".join(c.strip() for c in bare[1:-1].split("|"))
        out.append(line)
    return "\n".join(out)
