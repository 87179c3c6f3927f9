"""Text in embedded JSON scripts, for pages whose elements hold little: rich-text nodes, content entries, quotes."""

from __future__ import annotations

from typing import Any

from tidemill.functions.structured import loads
from tidemill.functions.text import size
from tidemill.functions.tree import Node

SPARSE, MOST, DEEPEST = 500, 1000, 15
Chunk = tuple[str | None, str]
_HEADINGS = ("heading", "title", "headline")
_BODIES = ("description", "subheading", "body", "text")


def text_of(doc: Node, words: int, markdown: str) -> str | None:
    if words >= SPARSE:
        return None
    found: list[Chunk] = []
    for script in doc.elements("script"):
        if len(found) >= MOST:
            break
        if script.attrs.get("type") == "application/json" and size(script.text) >= 50:
            try:
                walk(loads(script.text), found, 0)
            except ValueError:
                continue
    known, seen, out = markdown.lower(), set(), []
    for heading, body in found[:MOST]:
        key = body or heading
        if key and key not in seen:
            seen.add(key)
            if key.lower() not in known:
                out.append((f"\n## {heading}\n\n" if heading is not None else "") + f"{body}\n\n")
    return "".join(out).strip() or None


def walk(value: Any, out: list[Chunk], depth: int) -> None:
    if depth > DEEPEST:
        return
    if isinstance(value, list):
        texts = [v for v in value if isinstance(v, str) and size(v) > 10 and " " in v]
        if len(texts) >= 2:
            out.append((None, " | ".join(texts)))
            return
        for v in value:
            walk(v, out, depth + 1)
    elif isinstance(value, dict):
        chunk = rich_node(value) or entry(value) or quote(value)
        if chunk:
            out.append(chunk)
            return
        orphan(value, out)
        for key in sorted(value):
            if not is_media(key):
                walk(value[key], out, depth + 1)


def rich_node(node: Any) -> Chunk | None:
    kind = node.get("nodeType") if isinstance(node, dict) else None
    if not isinstance(kind, str):
        return None
    if kind == "document":
        children = node.get("content")
        chunks = [c for c in map(rich_node, children) if c] if isinstance(children, list) else []
        parts = [p for h, b in chunks for p in ([f"## {h}"] if h is not None else []) + ([b] if b else [])]
        return (None, "\n\n".join(parts)) if parts else None
    if kind in ("blockquote", "paragraph", "text") or kind.startswith("heading-"):
        text = collected(node)
        if kind.startswith("heading-"):
            return (text, "") if text else None
        return (None, f"> {text}" if kind == "blockquote" else text) if is_prose(text) else None
    return None


def collected(node: dict[str, Any]) -> str:
    own, children = node.get("value"), node.get("content")
    text = own if isinstance(own, str) else ""
    for child in children if isinstance(children, list) else ():
        if isinstance(child, dict):
            text += collected(child)
    return text.strip()


def is_entry(node: dict[str, Any]) -> bool:
    return any(k in node for k in _HEADINGS) and any(k in node for k in _BODIES)


def entry(node: dict[str, Any]) -> Chunk | None:
    if not is_entry(node):
        return None
    heading = first_field(node, _HEADINGS)
    if heading is None or is_internal(heading) or size(heading) <= 5:
        return None
    body = first_field(node, _BODIES) or ""
    return (heading, body) if is_prose(heading) or is_prose(body) else None


def quote(node: dict[str, Any]) -> Chunk | None:
    text = first_field(node, ("quote", "quoteText"))
    if text is None or not is_prose(text):
        return None
    by = first_field(node, ("position", "author", "name"))
    return None, f"> {text}" + (f"\n> — {by}" if by else "")


def orphan(node: dict[str, Any], out: list[Chunk]) -> None:
    if is_entry(node):
        return
    for keys, is_heading in ((_HEADINGS, True), (("body", "description", "subheading", "eyebrow", "children"), False)):
        for key in keys:
            text = first_field(node, (key,))
            if text is not None and is_prose(text):
                out.append((text, "") if is_heading else (None, text))
                return


def first_field(node: dict[str, Any], keys: tuple[str, ...]) -> str | None:
    for key in keys:
        value = node.get(key)
        text = value.strip() if isinstance(value, str) else collected(value) if isinstance(value, dict) else ""
        if text:
            return text
    return None


def is_media(key: str) -> bool:
    key = key.lower()
    return key in ("alt", "href", "src", "url") or any(w in key for w in ("icon", "image", "logo", "poster", "thumbnail", "video"))


def is_internal(title: str) -> bool:
    words = title.split()
    labels = {"asset", "icon", "image", "logo", "poster", "thumbnail"}
    return title.startswith(("/home ", "/page ")) or len(words) >= 3 and not labels.isdisjoint(words)


def is_prose(text: str) -> bool:
    text = text.strip()
    if size(text) < 15 or text.startswith(("http", "/", "{", "[")) or " " not in text:
        return False
    return sum(c.isalnum() for c in text) / size(text) >= 0.6
