"""Page metadata from the document head, each field by its chain of sources."""

from __future__ import annotations

from tidemill.functions.tree import Node

FIELDS = ("title", "description", "author", "published_date", "language", "url", "site_name", "image", "favicon")


def _content(node: Node | None) -> str | None:
    """The first tag that matches decides, even if its content is empty."""
    return (node.attrs.get("content") or "").strip() or None if node else None


def extract_metadata(doc: Node, url: str | None) -> dict[str, str | None]:
    metas = list(doc.elements("meta"))
    prop = lambda name: _content(next((m for m in metas if m.attrs.get("property") == name), None))
    name = lambda want: _content(next((m for m in metas if m.attrs.get("name", "").lower() == want and "name" in m.attrs), None))
    title = next(doc.elements("title"), None)
    root = next(doc.elements("html"), None)
    icon = next((n for n in doc.elements("link") if "icon" in n.attrs.get("rel", "")), None)
    return {
        "title": prop("og:title") or name("twitter:title") or (title.text.strip() if title else "") or None,
        "description": prop("og:description") or name("twitter:description") or name("description"),
        "author": name("author") or prop("article:author"),
        "published_date": prop("article:published_time") or name("date") or name("publication_date"),
        "language": root.attrs.get("lang") if root else None,
        "url": url,
        "site_name": prop("og:site_name"),
        "image": prop("og:image") or name("twitter:image"),
        "favicon": icon.attrs.get("href") if icon else None,
    }
