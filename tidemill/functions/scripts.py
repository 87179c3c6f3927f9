"""Readable text in script state. No script is run: state assigned as plain JSON, and pushed page fragments, are read."""

from __future__ import annotations

import json
import re
from typing import Any

from tidemill.functions.structured import balanced, loads
from tidemill.functions.text import lines, size
from tidemill.functions.tree import Node

MARKS = ("__NEXT_DATA__", "__NUXT__", "application/json", "self.__next", "window.")
_ASSIGNED = re.compile(r"(?:window|self|globalThis)\s*(?:\.\s*(__\w+)|\[\s*[\"'](__\w+)[\"']\s*\])\s*=\s*(?=[{\[])|(?:^|[;\s])var\s+(__\w+)\s*=\s*(?=[{\[])")
_PUSHED = re.compile(r"self\.__next_f\s*(?:=\s*self\.__next_f\s*\|\|\s*\[\]\s*\))?\.push\(\s*(?=\[)")
_MARKUP = re.compile(r"<[^>]+>")
_FILES = (".css", ".jpg", ".js", ".png", ".svg", ".woff2")
_LAYOUT = ("1fr", "divider-h-", "divider-v-", "grid-", "max-content")


def blobs(doc: Node) -> list[tuple[str, Any]]:
    """Names and values of the state that inline scripts assign, longer than 100 bytes as JSON; the last of a name counts."""
    found: dict[str, Any] = {}
    pushed: list[Any] = []
    for script in doc.elements("script"):
        if "src" in script.attrs or script.attrs.get("type") == "module":
            continue
        for pattern in (_ASSIGNED, _PUSHED):
            for m in pattern.finditer(script.text):
                literal = balanced(script.text, m.end())
                try:
                    value = loads(literal) if literal else None
                except ValueError:
                    continue
                if pattern is _PUSHED:
                    pushed.append(value)
                elif value is not None:
                    found[m[1] or m[2] or m[3]] = value
    if pushed:
        found["__next_f"] = pushed
    return [(k, v) for k, v in found.items() if size(json.dumps(v, separators=(",", ":"), ensure_ascii=False)) > 100]


def text_of(doc: Node, html: str) -> str | None:
    if not any(m in html for m in MARKS):
        return None
    texts: dict[str, None] = {}
    for name, value in blobs(doc):
        if name == "__next_f":
            fragments(value, texts)
        else:
            collect(value, texts, 15)
    return "## Additional Content\n\n" + "\n\n".join(texts) if texts else None


def fragments(entries: Any, out: dict[str, None]) -> None:
    """Pushed strings of kind 1 are one wire text; each line's part after the first bar may be JSON."""
    if not isinstance(entries, list):
        return
    wire = "".join(e[1] for e in entries if isinstance(e, list) and len(e) >= 2 and e[0] == 1 and isinstance(e[1], str))
    for line in lines(wire) if wire else ():
        _, bar, payload = line.partition("|")
        if bar:
            try:
                collect(loads(payload), out, 20)
            except ValueError:
                continue


def collect(value: Any, out: dict[str, None], depth: int) -> None:
    if depth < 0:
        return
    if isinstance(value, str):
        text = readable(value)
        if text is not None:
            out.setdefault(text)
    elif isinstance(value, list):
        for v in value:
            collect(v, out, depth - 1)
    elif isinstance(value, dict):
        for key in sorted(value, key=lambda k: (k != "children" or depth > 20, k)) if "children" in value else sorted(value):
            collect(value[key], out, depth - 1)


def readable(text: str) -> str | None:
    """The text without markup if it reads like prose and not like an address, a style or data."""
    text = text.strip()
    if size(text) <= 15 or text.startswith(("http://", "https://", "/", "./", "../")) or '"' in text or " " not in text:
        return None
    if "{" in text and "}" in text and (":" in text or ";" in text) or any(w in text for w in _LAYOUT) or text.endswith(_FILES):
        return None
    words = text.split()
    if sum("-" in w and any(c.isnumeric() and c.isascii() for c in w) for w in words) >= 2:
        return None
    if not any(c.isupper() for c in text) and all(re.fullmatch(r"\.|[a-z0-9-]{1,20}", w) for w in words):
        return None
    if all(w.endswith(("px", "em", "%")) or w == "0" for w in words):
        return None
    bare = _MARKUP.sub("", text).strip()
    if text.count("<") > 3 and text.count(">") > 3 and size(bare) < 15 or size(bare) <= 15:
        return None
    return bare if sum(c.isalpha() or c.isspace() for c in text) / size(text) >= 0.6 else None
