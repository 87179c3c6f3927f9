"""Structured data in page sources: JSON-LD, and the state that two web frameworks embed."""

from __future__ import annotations

import json
import re
from typing import Any

from tidemill.functions.text import size


def _refuse(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_refuse)


def loads(text: str) -> Any:
    """JSON as strictly as a Rust reader takes it: no NaN; ValueError otherwise."""

    try:
        return _DECODER.decode(text) if isinstance(text, str) and not text.startswith("\ufeff") else json.loads(text, parse_constant=_refuse)
    except RecursionError as deep:
        raise ValueError("too deep") from deep


_ENCODER = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def dumps(value: Any) -> str:
    """Compact JSON with keys in order."""
    return _ENCODER.encode(value)


_SCRIPT, _END = re.compile(r"<script[^>]*>"), re.compile(r"</script>", re.I)


def json_ld(html: str) -> list[Any]:
    out: list[Any] = []
    at = 0
    while m := _SCRIPT.search(html, at):
        at = m.end()
        if "application/ld+json" not in m[0].lower():
            continue
        stop = _END.search(html, at)
        if stop is None:
            continue
        text, at = html[at : stop.start()].strip(), stop.end()
        for attempt in (lambda t: t, escaped_breaks):
            try:
                value = loads(attempt(text)) if text else []
            except ValueError:
                continue
            out.extend(value if isinstance(value, list) else [value])
            break
    return out


def escaped_breaks(text: str) -> str:
    """Raw line breaks and tabs within strings, escaped."""
    out, inside, skip = [], False, False
    for c in text:
        if skip:
            skip = False
        elif c == "\\" and inside:
            skip = True
        elif c == '"':
            inside = not inside
        elif inside and c in "\n\r\t":
            c = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c]
        out.append(c)
    return "".join(out)


def next_data(html: str) -> list[Any]:
    """pageProps of the embedded page state if it has any, else the whole state."""
    mark = html.find("__NEXT_DATA__")
    tag = html.rfind("<script", 0, mark) if mark >= 0 else -1
    begin = html.find(">", tag) if tag >= 0 else -1
    stop = html.find("</script>", begin + 1) if begin >= 0 else -1
    text = html[begin + 1 : stop].strip() if stop >= 0 else ""
    if size(text) < 20:
        return []
    try:
        state = loads(text)
    except ValueError:
        return []
    if not isinstance(state, dict):
        return []
    props = state.get("props")
    inner = props.get("pageProps") if isinstance(props, dict) else None
    return [inner] if isinstance(inner, dict) and inner else [state]


def svelte_data(html: str) -> list[Any]:
    """The data array of a kit.start call, its elements unwrapped of data."""
    call = html.find("kit.start(")
    mark = html.find("data: [", call) if call >= 0 else -1
    text = balanced(html, mark + 6) if mark >= 0 else None
    if text is None or size(text) < 50:
        return []
    try:
        items = loads(quoted_keys(text))
    except ValueError:
        return []
    inner = lambda v: v["data"] if isinstance(v, dict) and isinstance(v.get("data"), dict | list) else v
    return [inner(v) for v in items if isinstance(v, dict | list)] if isinstance(items, list) else []


def balanced(text: str, at: int) -> str | None:
    """From the bracket at that place to the one that closes it, strings skipped."""
    opening = text[at : at + 1]
    closing = {"[": "]", "{": "}"}.get(opening)
    if closing is None:
        return None
    depth, inside, skip = 0, False, False
    for k in range(at, len(text)):
        c = text[k]
        if skip:
            skip = False
        elif c == "\\" and inside:
            skip = True
        elif c == '"':
            inside = not inside
        elif not inside:
            depth += (c == opening) - (c == closing)
            if not depth:
                return text[at : k + 1]
    return None


_PIECE = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|(?P<open>[{,\[])(?P<gap>\s*)(?P<key>[A-Za-z_][A-Za-z0-9_]*)(?P<tail>\s*(?P<colon>:)?)', re.S)


def quoted_keys(text: str) -> str:
    """Object literals with bare keys, as JSON."""

    def fix(m: re.Match[str]) -> str:
        if m["open"] is None:
            return m[0]
        key = f'"{m["key"]}"' if m["colon"] else m["key"]
        return m["open"] + m["gap"] + key + (m["colon"] or "")

    return _PIECE.sub(fix, text)


def structured(html: str) -> list[Any]:
    return json_ld(html) + next_data(html) + svelte_data(html)
