"""A page as compact text for a language model: header, cleaned body, links, structured data."""

from __future__ import annotations

import json
import re
from typing import Any

from tidemill.functions.cleanup import EXTERNAL, OPENS, STOP, process_body
from tidemill.functions.page import Page
from tidemill.functions.structured import dumps
from tidemill.functions.text import size

MOST_JSON, MOST_UNTYPED, LONG_FIELD, DEEPEST = 16 * 1024, 4 * 1024, 500, 64
_HEADER = (("Title", "title"), ("Description", "description"), ("Author", "author"), ("Published", "published_date"), ("Language", "language"))
_MARKS = re.compile("|".join((r"#{1,6}\s+", r"\*{1,2}", "_{1,2}", "`")))
_CHROME = re.compile(rf"\s*,?\s*(?:{OPENS}){STOP}|\s*,\s*{EXTERNAL}{STOP}|\s+{EXTERNAL}{STOP}$", re.I)


def header(metadata: dict[str, Any], url: str | None = None) -> str:
    url = url if url is not None else metadata.get("url")
    out = f"> URL: {url}\n" if url is not None else ""
    out += "".join(f"> {name}: {metadata[key]}\n" for name, key in _HEADER if metadata.get(key))
    return out + (f"> Word count: {metadata['word_count']}\n" if metadata.get("word_count") else "")


def clean_label(raw: str) -> str:
    label = once(" ".join(_CHROME.sub("", _MARKS.sub("", raw)).split()))
    if size(label) <= 80:
        return label
    ends = [0]
    for c in label:
        ends.append(ends[-1] + size(c))
    cut = max((k for k in range(1, len(label)) if ends[k] <= 80 and label[k - 1] == " "), default=None)
    if cut is None:
        cut = next((k for k in range(len(label)) if ends[k] >= 80), len(label))
    return label[:cut].rstrip() + "..."


def once(label: str) -> str:
    """A label that says the same thing twice, once."""
    if size(label) >= 8:
        for m in re.finditer(" ", label):
            left, right = label[: m.start()].strip(), label[m.end() :].strip()
            if size(left) >= 4 and left.encode().lower() == right.encode().lower():
                return left
    return label


def is_useful(value: Any) -> bool:
    """Structured data that says more than that this is a page of a site."""
    if isinstance(value, dict) and "@type" in value:
        kind = value["@type"]
        kinds = [kind] if isinstance(kind, str) else [k for k in kind if isinstance(k, str)] if isinstance(kind, list) else []
        return any(k.lower() not in ("sitenavigationelement", "webpage", "website") for k in kinds)
    return isinstance(value, dict | list) and size(dumps(value)) <= MOST_UNTYPED


def scrubbed(value: Any, depth: int = 0) -> Any:
    """Without article bodies and long texts, which the body has already."""
    if depth >= DEEPEST:
        return value
    if isinstance(value, list):
        return [scrubbed(v, depth + 1) for v in value]
    if not isinstance(value, dict):
        return value
    long = lambda k, v: k in ("body", "description", "text") and isinstance(v, str) and size(v) >= LONG_FIELD
    return {k: scrubbed(v, depth + 1) for k, v in value.items() if k != "articleBody" and not long(k, v)}


def pretty(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2)


def llm_text(page: Page, url: str | None = None) -> str:
    out = header(page.metadata, url)
    body, links = process_body(page.content.markdown)
    if body:
        out += ("\n" if out else "") + body
    if links:
        out += "\n\n## Links\n" + "".join(f"- {label}: {href}\n" for text, href in links if (label := clean_label(text)))
    useful = [scrubbed(v) for v in page.structured_data if is_useful(v)]
    if useful and size(written := pretty(useful)) <= MOST_JSON:
        out += f"\n\n## Structured Data\n\n```json\n{written}\n```"
    return out.strip()
