"""A small HTML5 tree builder.

Covers what stored pages depend on: implied html, head and body; raw text and escapable raw text; void elements;
implied end tags; reconstruction of active formatting elements with the limit of three alike; the adoption agency for
misnested formatting; table sections with foster parenting. Scripting counts as on, so noscript holds raw text.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections.abc import Iterator
from operator import attrgetter

VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("textarea title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = (
    frozenset(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup "
        "main menu nav ol p search section summary ul pre listing form hr table plaintext xmp li dd dt".split()
    )
    | HEADINGS
)
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details "
    "dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext "
    "pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul "
    "wbr xmp".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())

_TOKEN = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|--!>|\Z)|(?P<bogus>[!?][^>]*)(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<start>[a-zA-Z][^\s/>]*))", re.S)
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?", re.S)
_CLOSE = re.compile(r"[\s/]*>?")


_PLACE = attrgetter("index")


class Node:
    """An element, or a text where tag is None."""

    __slots__ = ("tag", "attrs", "children", "parent", "data", "index", "last", "_order", "_text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, data: str = ""):
        self.tag, self.attrs, self.data = tag, attrs or {}, data
        self.children: list[Node] = []
        self.parent: Node | None = None
        self._text: str | None = None
        self.index = self.last = 0
        self._order: dict[str, list[Node]] | None = None

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def append(self, child: Node) -> None:
        if child.parent is not None:
            child.parent.children.remove(child)
        child.parent = self
        self.children.append(child)

    def insert_before(self, child: Node, mark: Node) -> None:
        if child.parent is not None:
            child.parent.children.remove(child)
        child.parent = self
        self.children.insert(self.children.index(mark), child)

    def walk(self) -> Iterator[Node]:
        """All elements and texts below, in document order."""
        if self._order is not None:
            yield from self._order[""][self.index : self.last]
            return
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self, *tags: str) -> Iterator[Node]:
        """Elements below, in document order; of a whole tree from the lists that parse() makes, without a walk."""
        if self._order is None:
            return (n for n in self.walk() if n.tag is not None and (not tags or n.tag in tags))
        found = [n for tag in dict.fromkeys(tags or ("*",)) for n in self._below(tag)]
        return iter(sorted(found, key=_PLACE) if len(tags) > 1 else found)

    def _below(self, kind: str) -> list[Node]:
        nodes = self._order.get(kind, [])
        if self.parent is None:  # the document
            return nodes
        first = bisect_right(nodes, self.index, key=_PLACE)
        return nodes[first : bisect_right(nodes, self.last, first, key=_PLACE)]

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None and node.tag != "#document":
            yield node
            node = node.parent

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = "".join(n.data for n in (self.walk() if self._order is None else self._below("#text")) if n.tag is None)
        return self._text

    @property
    def words(self) -> str:
        """The text with single spaces."""
        return " ".join(self.text.split())

    def outer(self) -> str:
        """The element written as HTML."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag is None:
                raw = node.parent is not None and node.parent.tag in RAW
                out.append(node.data if raw else _html.escape(node.data, quote=False).replace("\xa0", "&nbsp;"))
            else:
                attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(0xA0), "&nbsp;").replace(chr(34), "&quot;")}"' for k, v in node.attrs.items())
                out.append(f"<{node.tag}{attrs}>")
                if node.tag not in VOID:
                    stack.append(f"</{node.tag}>")
                    stack.extend(reversed(node.children))
        return "".join(out)


class _Builder:
    def __init__(self) -> None:
        self.document = Node("#document")
        self.stack: list[Node] = []
        self.active: list[Node | None] = []
        self.html = self.head = self.body = None
        self.head_done = False
        self.foster = False
        self.form: Node | None = None

    # insertion

    @property
    def current(self) -> Node:
        return self.stack[-1]

    def place(self) -> tuple[Node, Node | None]:
        """Where the next node goes: a parent, and what it comes before."""
        target = self.stack[-1]
        if self.foster and target.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag == "table":
                    table = self.stack[k]
                    if table.parent is not None:
                        return table.parent, table
                    return self.stack[k - 1], None
        return target, None

    def insert(self, node: Node) -> None:
        parent, mark = self.place()
        if mark is not None and mark.parent is parent:
            parent.insert_before(node, mark)
        else:
            parent.append(node)

    def push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.insert(node)
        self.stack.append(node)
        return node

    def text(self, data: str) -> None:
        parent, mark = self.place()
        siblings = parent.children
        at = siblings.index(mark) if mark is not None and mark.parent is parent else len(siblings)
        if at and siblings[at - 1].tag is None:
            siblings[at - 1].data += data
            return
        node = Node(None, data=data)
        node.parent = parent
        siblings.insert(at, node)

    # scopes

    def in_scope(self, *tags: str, extra: frozenset[str] = frozenset()) -> bool:
        for node in reversed(self.stack):
            if node.tag in tags:
                return True
            if node.tag in SCOPE or node.tag in extra:
                return False
        return False

    def in_table_scope(self, *tags: str) -> bool:
        for node in reversed(self.stack):
            if node.tag in tags:
                return True
            if node.tag in ("html", "table", "template"):
                return False
        return False

    def imply(self, but: str = "") -> None:
        while (tag := self.stack[-1].tag) in IMPLIED and tag != but:
            self.stack.pop()

    def pop_to(self, *tags: str) -> None:
        while len(self.stack) > 1 and self.stack.pop().tag not in tags:
            pass

    def close_p(self) -> None:
        for node in reversed(self.stack):
            tag = node.tag
            if tag == "p":
                self.imply("p")
                self.pop_to("p")
                return
            if tag in SCOPE or tag == "button":
                return

    # formatting

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        k = len(self.active) - 1
        while k > 0 and self.active[k - 1] is not None and self.active[k - 1] not in self.stack:
            k -= 1
        for j in range(k, len(self.active)):
            old = self.active[j]
            self.active[j] = self.push(old.tag, dict(old.attrs))

    def remember(self, node: Node) -> None:
        alike = 0
        for k in range(len(self.active) - 1, -1, -1):
            other = self.active[k]
            if other is None:
                break
            if other.tag == node.tag and other.attrs == node.attrs:
                alike += 1
                if alike == 3:
                    del self.active[k]
                    break
        self.active.append(node)

    def clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, tag: str) -> None:
        if self.current.tag == tag and self.current not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            found = None
            for node in reversed(self.active):
                if node is None:
                    break
                if node.tag == tag:
                    found = node
                    break
            if found is None:
                self.any_end(tag)
                return
            if found not in self.stack:
                self.active.remove(found)
                return
            at = self.stack.index(found)
            if not self.in_scope(tag):
                return
            furthest = next((n for n in self.stack[at + 1 :] if n.tag in SPECIAL), None)
            if furthest is None:
                del self.stack[at:]
                self.active.remove(found)
                return
            above = self.stack[at - 1]
            mark = self.active.index(found)
            last, where = furthest, self.stack.index(furthest)
            inner = 0
            while True:
                where -= 1
                node = self.stack[where]
                if node is found:
                    break
                inner += 1
                if inner > 3 and node in self.active:
                    if self.active.index(node) < mark:
                        mark -= 1
                    self.active.remove(node)
                if node not in self.active:
                    del self.stack[where]
                    continue
                copy = Node(node.tag, dict(node.attrs))
                self.active[self.active.index(node)] = copy
                self.stack[where] = copy
                if last is furthest:
                    mark = self.active.index(copy) + 1
                copy.append(last)
                last = copy
            if above.tag in ("table", "tbody", "tfoot", "thead", "tr"):
                keep, self.foster = self.foster, True
                kept = self.stack
                self.stack = self.stack[:at]
                self.insert(last)
                self.stack, self.foster = kept, keep
            else:
                above.append(last)
            copy = Node(found.tag, dict(found.attrs))
            for child in furthest.children[:]:
                copy.append(child)
            furthest.append(copy)
            at_active = self.active.index(found)
            self.active.remove(found)
            self.active.insert(mark - (at_active < mark), copy)
            self.stack.remove(found)
            self.stack.insert(self.stack.index(furthest) + 1, copy)

    def any_end(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            node = self.stack[k]
            if node.tag == tag:
                self.imply(tag)
                if k < len(self.stack):
                    del self.stack[k:]
                return
            if node.tag in SPECIAL:
                return

    # document structure

    def need_html(self, attrs: dict[str, str] | None = None) -> None:
        if self.html is None:
            self.html = Node("html", attrs or {})
            self.document.append(self.html)
            self.stack = [self.html]

    def need_head(self, attrs: dict[str, str] | None = None) -> None:
        self.need_html()
        if self.head is None:
            self.head = self.push("head", attrs or {})

    def need_body(self, attrs: dict[str, str] | None = None) -> None:
        self.need_head()
        if self.body is None:
            self.stack = [self.html]
            self.head_done = True
            self.body = self.push("body", attrs or {})

    def characters(self, data: str) -> None:
        if self.body is None:
            rest = data.lstrip(" \t\n\f\r")
            if not rest:
                if self.head is not None and self.current is not self.html:
                    self.text(data)
                return
            self.need_body()
            data = rest
        if self.stack[-1].tag in ("table", "tbody", "tfoot", "thead", "tr"):
            if data.isspace():
                self.text(data)
                return
            self.foster = True
            self.reconstruct()
            self.text(data)
            self.foster = False
            return
        self.reconstruct()
        self.text(data)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag == "html":
            if self.html is None:
                self.need_html(attrs)
            else:
                for k, v in attrs.items():
                    self.html.attrs.setdefault(k, v)
            return
        if tag == "head":
            if self.head is None:
                self.need_head(attrs)
            return
        if tag == "body":
            if self.body is None:
                self.need_body(attrs)
            else:
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
            return
        if self.body is None and tag in HEAD_ONLY:
            self.need_head()
            late = self.head_done
            if late:
                self.stack.append(self.head)
            self.push(tag, attrs)
            if tag in VOID:
                self.stack.pop()
            if late:
                self.stack.remove(self.head)
            return
        self.need_body()
        if tag in TABLE_PARTS or tag == "table":
            self.table_start(tag, attrs)
            return
        if self.current.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            if tag in ("script", "style", "template"):
                self.push(tag, attrs)
                return
            if tag == "input" and attrs.get("type", "").lower() == "hidden":
                self.insert(Node(tag, attrs))
                return
            self.foster = True
            self.body_start(tag, attrs)
            self.foster = False
            return
        self.body_start(tag, attrs)

    def body_start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in HEAD_ONLY:
            if tag in VOID:
                self.insert(Node(tag, attrs))
            else:
                self.push(tag, attrs)
            return
        if tag in HEADINGS:
            self.close_p()
            if self.current.tag in HEADINGS:
                self.stack.pop()
            self.push(tag, attrs)
            return
        if tag == "form":
            if self.form is not None:
                return
            self.close_p()
            self.form = self.push(tag, attrs)
            return
        if tag in ("li", "dd", "dt"):
            alike = ("li",) if tag == "li" else ("dd", "dt")
            for node in reversed(self.stack):
                if node.tag in alike:
                    self.imply(node.tag)
                    self.pop_to(node.tag)
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.push(tag, attrs)
            return
        if tag in CLOSES_P:
            self.close_p()
            if tag == "hr":
                self.insert(Node(tag, attrs))
            else:
                self.push(tag, attrs)
            return
        if tag == "button":
            if self.in_scope("button"):
                self.imply()
                self.pop_to("button")
            self.reconstruct()
            self.push(tag, attrs)
            return
        if tag == "a":
            for node in reversed(self.active):
                if node is None:
                    break
                if node.tag == "a":
                    self.adopt("a")
                    if node in self.active:
                        self.active.remove(node)
                    if node in self.stack:
                        self.stack.remove(node)
                    break
            self.reconstruct()
            self.remember(self.push(tag, attrs))
            return
        if tag in FORMATTING:
            self.reconstruct()
            if tag == "nobr" and self.in_scope("nobr"):
                self.adopt("nobr")
                self.reconstruct()
            self.remember(self.push(tag, attrs))
            return
        if tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.push(tag, attrs)
            self.active.append(None)
            return
        if tag == "image":
            tag = "img"
        if tag in VOID:
            if tag not in ("param", "source", "track"):
                self.reconstruct()
            self.insert(Node(tag, attrs))
            return
        if tag in ("option", "optgroup"):
            if self.current.tag == "option":
                self.stack.pop()
            if tag == "optgroup" and self.current.tag == "optgroup":
                self.stack.pop()
            self.reconstruct()
            self.push(tag, attrs)
            return
        if tag in RAW or tag in ESCAPABLE:
            self.push(tag, attrs)
            return
        self.reconstruct()
        self.push(tag, attrs)

    # tables

    def back_to(self, *tags: str) -> None:
        while self.current.tag not in (*tags, "html", "template"):
            self.stack.pop()

    def close_cell(self) -> None:
        self.imply()
        self.pop_to("td", "th")
        self.clear_to_marker()

    def table_start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "table":
            if self.current.tag in ("table", "tbody", "tfoot", "thead", "tr") and self.in_table_scope("table"):
                self.pop_to("table")
            else:
                self.close_p()
            self.push("table", attrs)
            return
        if not self.in_table_scope("table"):
            return
        if self.in_table_scope("td", "th") and not (self.in_table_scope("caption")):
            self.close_cell()
        if self.in_table_scope("caption"):
            self.imply()
            self.pop_to("caption")
            self.clear_to_marker()
        if tag == "caption":
            self.back_to("table")
            self.push(tag, attrs)
            self.active.append(None)
        elif tag in ("colgroup", "col"):
            if tag == "col" and self.current.tag != "colgroup":
                self.back_to("table")
                self.push("colgroup", {})
            elif tag == "colgroup":
                self.back_to("table")
            if tag == "col":
                self.insert(Node(tag, attrs))
            else:
                self.push(tag, attrs)
        elif tag in ("tbody", "thead", "tfoot"):
            self.back_to("table")
            self.push(tag, attrs)
        elif tag == "tr":
            self.back_to("tbody", "thead", "tfoot", "table")
            if self.current.tag == "table":
                self.push("tbody", {})
            self.push(tag, attrs)
        else:
            self.back_to("tr", "tbody", "thead", "tfoot", "table")
            if self.current.tag == "table":
                self.push("tbody", {})
            if self.current.tag != "tr":
                self.push("tr", {})
            self.push(tag, attrs)
            self.active.append(None)

    def end(self, tag: str) -> None:
        if self.body is None:
            if tag == "head" and self.head is not None:
                self.stack = [self.html]
                self.head_done = True
            elif self.stack and self.current.tag == tag and tag not in ("html",):
                self.stack.pop()
            elif tag in ("body", "html", "br"):
                self.need_body()
                if tag == "br":
                    self.insert(Node("br"))
            elif tag == "p":
                self.need_body()
                self.end("p")
            return
        if tag in ("body", "html"):
            return
        if tag in ("td", "th"):
            if self.in_table_scope(tag):
                self.imply()
                self.pop_to(tag)
                self.clear_to_marker()
        elif tag in ("table", "tbody", "thead", "tfoot", "tr", "caption"):
            if self.in_table_scope(tag):
                if tag == "caption" or self.in_table_scope("td", "th") and tag != "caption":
                    self.imply()
                    inside = next((n.tag for n in reversed(self.stack) if n.tag in ("td", "th", "caption", "table")), "")
                    if inside in ("td", "th", "caption"):
                        self.clear_to_marker()
                self.pop_to(tag)
        elif tag == "p":
            if self.stack[-1].tag == "p":
                self.stack.pop()
                return
            if not self.in_scope("p", extra=frozenset(["button"])):
                self.close_p()
                self.push("p", {})
            self.close_p()
        elif tag == "br":
            self.reconstruct()
            self.insert(Node("br"))
        elif tag in HEADINGS:
            if self.in_scope(*HEADINGS):
                self.imply()
                self.pop_to(*HEADINGS)
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and node in self.stack and self.in_scope("form"):
                self.imply()
                if node in self.stack:
                    self.stack.remove(node)
        elif tag == "li":
            if self.in_scope("li", extra=frozenset(["ol", "ul"])):
                self.imply("li")
                self.pop_to("li")
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in CLOSES_P or tag in ("button",):
            if self.in_scope(tag):
                self.imply(tag if tag in ("dd", "dt") else "")
                self.pop_to(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope(tag):
                self.imply()
                self.pop_to(tag)
                self.clear_to_marker()
        else:
            self.any_end(tag)


def parse(source: str) -> Node:
    """The document node of an HTML text."""
    b, at, size = _Builder(), 0, len(source)
    source = source.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")
    size = len(source)
    lower: str | None = None
    while at < size:
        found = source.find("<", at)
        if found < 0:
            found = size
        m = _TOKEN.match(source, found) if found < size else None
        while found < size and m is None:
            found = source.find("<", found + 1)
            found = size if found < 0 else found
            m = _TOKEN.match(source, found) if found < size else None
        if found > at:
            data = source[at:found]
            b.characters(_html.unescape(data) if "&" in data else data)
        if m is None:
            break
        at = m.end()
        kind = m.lastgroup
        if kind == "end":
            b.end(m[kind].lower())
        elif kind == "start":
            tag, attrs = m[kind].lower(), {}
            if source.startswith(">", at):
                slashed, at = False, at + 1
            else:
                while (a := _ATTRIBUTE.match(source, at)) and a.end() > at:
                    name, *values = a.groups()
                    value = next((v for v in values if v is not None), "")
                    attrs.setdefault(name.lower(), _html.unescape(value) if "&" in value else value)
                    at = a.end()
                closing = _CLOSE.match(source, at)
                slashed, at = "/" in closing[0], closing.end()
            before = b.stack[-1] if b.stack else None
            b.start(tag, attrs, slashed)
            if (tag in RAW or tag in ESCAPABLE) and b.stack and b.current is not before and b.current.tag == tag:
                lower = lower if lower is not None else source.lower()
                stop = lower.find(f"</{tag}", at)
                stop = size if stop < 0 else stop
                data = source[at:stop]
                if tag == "textarea" and data.startswith("\n"):
                    data = data[1:]
                if data:
                    b.text(_html.unescape(data) if tag in ESCAPABLE and "&" in data else data)
                at = stop
                if stop == size:
                    b.stack.pop()
            elif tag in ("pre", "listing") and source.startswith("\n", at):
                at += 1
            if tag == "svg" and b.stack and b.current.tag == "svg" and slashed:
                b.stack.pop()
    b.need_body()
    nodes = list(b.document.walk())
    order: dict[str, list[Node]] = {"": nodes, "*": [n for n in nodes if n.tag is not None]}
    for k, node in enumerate(nodes, 1):
        node.index = k
        kind = node.tag or "#text"
        if kind in order:
            order[kind].append(node)
        else:
            order[kind] = [node]
    b.document.index = 0
    for node in (*reversed(nodes), b.document):
        node.last = node.children[-1].last if node.children else node.index
        node._order = order
    return b.document
