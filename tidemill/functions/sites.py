"""Pages of three sites with layouts of their own: discussion threads, videos and professional posts."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from typing import Any

from tidemill.functions.select import select
from tidemill.functions.structured import loads
from tidemill.functions.text import lines, word_count
from tidemill.functions.tree import Node, parse

REDDIT_HOSTS = ("new.reddit.com", "np.reddit.com", "old.reddit.com", "reddit.com", "www.reddit.com")
OLD_REDDIT = "https://old.reddit.com"


def host_of(url: str) -> str:
    rest = url.split("://")[1] if "://" in url else url
    return re.split(r"[/?#]", rest, maxsplit=1)[0]


def is_reddit(url: str) -> bool:
    return host_of(url) in REDDIT_HOSTS


def is_video(url: str) -> bool:
    url = url.lower()
    return "youtu.be/" in url or "youtube.com/watch" in url


def is_post(url: str) -> bool:
    host = (url.split("://")[1] if "://" in url else url).split("/")[0]
    return host in ("linkedin.com", "www.linkedin.com") and any(p in url for p in ("/feed/update/", "/posts/"))


# threads


@dataclass
class Post:
    id: str | None
    title: str
    author: str
    subreddit: str | None
    score: int
    body: str | None
    num_comments: int
    permalink: str
    url: str | None
    is_self: bool
    flair: str | None
    created_utc: str | None


@dataclass
class Comment:
    id: str | None
    author: str
    body: str
    score: int | None
    depth: int
    is_op: bool
    created_utc: str | None
    replies: list[Comment] = field(default_factory=list)


def has_class(n: Node, name: str) -> bool:
    return name in n.attrs.get("class", "").lower().split()


def _child(n: Node | None, name: str) -> Node | None:
    return next((c for c in n.children if c.tag and has_class(c, name)), None) if n else None


def _inside(n: Node | None, name: str) -> Node | None:
    return next((c for c in n.elements() if has_class(c, name)), None) if n else None


def _first(n: Node | None, selector: str) -> Node | None:
    return next(iter(select(n, selector)), None) if n else None


def _integer(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"[+-]?[0-9]+", text) else None


def _id(n: Node, head: str) -> str | None:
    name = n.attrs.get("data-fullname")
    while name is not None and name.startswith(head):
        name = name[len(head) :]
    return name


def thread(html: str, url: str) -> tuple[Post | None, list[Comment]] | None:
    """Post and comments of an old-layout thread page; None if it isn't one."""
    if "/comments/" not in url:
        return None
    doc = parse(html)
    post = _post(doc)
    listing = _first(doc, ".commentarea .sitetable.nestedlisting") or _first(doc, ".sitetable.nestedlisting")
    comments = _comments(listing, post.author if post else "", 0)
    return (post, comments) if post or comments else None


def _post(doc: Node) -> Post | None:
    n = _first(doc, "#siteTable .thing.link")
    heading = _first(n, ".title a.title")
    title = heading.text.strip() if heading else ""
    if not n or not title:
        return None
    a = n.attrs
    is_self = has_class(n, "self") or a.get("data-domain", "").startswith("self.")
    flair, when = _first(n, ".linkflairlabel"), _first(n, "time[datetime]")
    body = _inside(_inside(_inside(_child(n, "entry"), "expando"), "usertext-body"), "md")
    return Post(
        id=_id(n, "t3_"), title=title, author=a.get("data-author", "[deleted]"), subreddit=a.get("data-subreddit"),
        score=_integer(a.get("data-score")) or 0, body=rich_text(body) or None if body else None,
        num_comments=max(_integer(a.get("data-comments-count")) or 0, 0), permalink=OLD_REDDIT + a.get("data-permalink", ""),
        url=None if is_self else a.get("data-url"), is_self=is_self, flair=(flair.text.strip() if flair else "") or None,
        created_utc=when.attrs["datetime"] if when else None,
    )


def _comments(listing: Node | None, op: str, depth: int) -> list[Comment]:
    return [_comment(n, op, depth) for n in listing.children if n.tag and _is_comment(n)] if listing else []


def _is_comment(n: Node) -> bool:
    return has_class(n, "comment") and has_class(n, "thing") and not has_class(n, "morechildren") and n.attrs.get("data-type") != "morechildren"


def _comment(n: Node, op: str, depth: int) -> Comment:
    deleted, author, entry = has_class(n, "deleted"), n.attrs.get("data-author") or "[deleted]", _child(n, "entry")
    body, when = _inside(_inside(entry, "usertext-body"), "md"), _first(entry, "time[datetime]")
    return Comment(
        id=_id(n, "t1_"), author=author, body=(rich_text(body) if body else "") or ("[removed]" if deleted else ""), score=_score(entry),
        depth=depth, is_op=not deleted and author not in ("[deleted]", "") and author == op,
        created_utc=when.attrs["datetime"] if when else None, replies=_comments(_child(_child(n, "child"), "sitetable"), op, depth + 1),
    )


def _score(entry: Node | None) -> int | None:
    """None where the score is hidden, which is not 0."""
    n = _first(entry, "span.score.unvoted")
    if n is None:
        return None
    got = _integer(n.attrs["title"].strip()) if "title" in n.attrs else None
    words = n.text.split()
    return got if got is not None else _integer(words[0].replace("−", "-")) if words else None


_MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}


def rich_text(n: Node) -> str:
    return _rich(n).strip()


def _rich(n: Node) -> str:
    return "".join(c.data if c.tag is None else _rich_node(c) for c in n.children)


def _rich_node(n: Node) -> str:
    tag, text = n.tag, n.text.strip()
    if tag in ("div", "p"):
        inner = _rich(n).strip()
        return f"{inner}\n\n" if inner else ""
    if tag in _MARKS:
        return f"{_MARKS[tag]}{text}{_MARKS[tag]}" if text else ""
    if re.fullmatch(r"h[1-6]", tag):
        return f"{'#' * int(tag[1])} {text}\n\n" if text else ""
    if tag in ("ol", "ul"):
        return _rich_list(n, 0) + "\n"
    if tag == "a":
        href = n.attrs.get("href", "")
        full = href if href.startswith(("http://", "https://")) else OLD_REDDIT + href if href.startswith("/") else ""
        return (f"[{text}]({full})" if full else text) if text else ""
    if tag == "pre":
        return "```\n" + n.text.rstrip("\n") + "\n```\n\n"
    if tag == "blockquote":
        return "".join(f"> {x}\n" if x else ">\n" for x in lines(_rich(n).strip())) + "\n"
    return {"br": "\n", "hr": "---\n\n", "code": f"`{text}`", "sup": text}.get(tag) or _rich(n)


def _rich_list(n: Node, indent: int) -> str:
    out, items = "", [c for c in n.children if c.tag == "li"]
    for k, item in enumerate(items):
        own = "".join(c.data if c.tag is None else _rich_node(c) for c in item.children if c.tag not in ("ol", "ul"))
        out += f"{'  ' * indent}{f'{k + 1}. ' if n.tag == 'ol' else '- '}{own.strip()}\n"
        out += "".join(_rich_list(c, indent + 1) for c in item.children if c.tag in ("ol", "ul"))
    return out


def _points(score: int | None) -> str:
    return "score hidden" if score is None else f"{score} pt" if score in (1, -1) else f"{score} pts"


def thread_markdown(post: Post | None, comments: list[Comment]) -> str:
    out = ""
    if post:
        n = post.num_comments
        about = f" · {n} comment{'s' if n > 1 else ''}" if n else ""
        out = f"# {post.title}\n\n**u/{post.author}** · r/{'?' if post.subreddit is None else post.subreddit} · {_points(post.score)}{about}\n\n"
        out += f"{post.body}\n\n" if post.body else ""
        out += f"[Link]({post.url})\n\n" if post.url is not None and not post.is_self else ""
        out += "---\n\n"
    if comments:
        out += "## Comments\n\n" + "".join(map(_comment_markdown, comments))
    return re.sub(r"\n{3,}", "\n\n", out.rstrip())


def _comment_markdown(c: Comment) -> str:
    head = "> " * c.depth
    out = f"{head}**u/{c.author}{' [OP]' if c.is_op else ''}** · {_points(c.score)}\n"
    out += "".join(f"{head}{x}\n" if x else ">" * c.depth + "\n" for x in lines(c.body))
    return out + "\n" + "".join(map(_comment_markdown, c.replies))


def thread_plain(markdown: str) -> str:
    return "\n".join(re.sub(r"\*\*|~~|[*`]", "", re.sub(r"^> ?", "", x.lstrip()).lstrip("#").lstrip()) for x in lines(markdown))


def thread_page(html: str, url: str) -> tuple[dict[str, Any], str, str] | None:
    got = thread(html, url)
    if got is None:
        return None
    post, comments = got
    text = thread_markdown(post, comments)
    metadata: dict[str, Any] = dict.fromkeys(("title", "description", "author", "published_date", "language", "url", "site_name", "image", "favicon"))
    metadata |= {"language": "en", "url": url, "word_count": word_count(text)}
    if post:
        metadata |= {"title": post.title, "author": post.author, "site_name": post.subreddit}
    return metadata, text, thread_plain(text)


def flat_comments(comments: list[Comment], path: tuple[int, ...] = (), parent: str | None = None) -> list[dict[str, Any]]:
    """Comments as rows in reading order: path holds the place at each level."""
    out = []
    for k, c in enumerate(comments):
        row = asdict(c) | {"path": [*path, k], "parent_id": parent}
        del row["replies"]
        out += [row, *flat_comments(c.replies, (*path, k), c.id)]
    return out


# videos

_STATE = r"(\{.+?\})"
_PLAYER = re.compile(rf"var\s+ytInitialPlayerResponse\s*=\s*{_STATE}\s*;")


def player(html: str) -> dict[str, Any] | None:
    """The player state, up to the first brace before a semicolon; None if that isn't JSON."""
    m = _PLAYER.search(html)
    try:
        got = loads(m[1]) if m else None
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def at(value: Any, *keys: str) -> Any:
    for key in keys:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def text_at(value: Any, *keys: str) -> str | None:
    got = at(value, *keys)
    return got if isinstance(got, str) else None


def video_page(html: str) -> str | None:
    state = player(html)
    details = state.get("videoDetails") if state else None
    if state is None or details is None:
        return None
    about = at(state, "microformat", "playerMicroformatRenderer")
    date = about.get("uploadDate", about.get("publishDate")) if isinstance(about, dict) else None
    views, seconds = text_at(details, "viewCount"), text_at(details, "lengthSeconds")
    text = f"# {_or(text_at(details, 'title'), 'Untitled')}\n\n**Channel:** {_or(text_at(details, 'author'), 'Unknown')}"
    text += f" | **Views:** {'N/A' if views is None else shortened(views)} | **Published:** {date if isinstance(date, str) else 'Unknown'}"
    text += f" | **Duration:** {clock(_integer(seconds) or 0)}\n\n"
    description = text_at(details, "shortDescription")
    return text + (f"## Description\n\n{description}\n" if description else "")


def _or(text: str | None, other: str) -> str:
    return other if text is None else text


def clock(seconds: int) -> str:
    hours, rest = divmod(max(seconds, 0), 3600)
    return f"{hours}:{rest // 60:02}:{rest % 60:02}" if hours else f"{rest // 60}:{rest % 60:02}"


def shortened(count: str) -> str:
    n = _integer(count)
    if n is None or n < 0:
        return count
    return f"{n / 1e6:.1f}M" if n >= 1_000_000 else f"{n / 1e3:.1f}K" if n >= 1000 else str(n)


def caption_tracks(html: str) -> list[dict[str, str]]:
    tracks = at(player(html), "captions", "playerCaptionsTracklistRenderer", "captionTracks")
    out = []
    for t in tracks if isinstance(tracks, list) else ():
        url, lang = text_at(t, "baseUrl"), _or(text_at(t, "languageCode"), "en")
        if url is not None:
            out.append({"url": url, "lang": lang, "name": _or(text_at(t, "name", "simpleText"), lang)})
    return out


def timed_text(xml: str) -> str:
    found = (m.strip() for m in re.findall(r"<text[^>]*>([^<]*)</text>", xml))
    pairs = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("\n", " "))
    out = []
    for text in filter(None, found):
        for a, b in pairs:
            text = text.replace(a, b)
        out.append(text)
    return " ".join(out)


def dumps_thread(post: Post | None, comments: list[Comment]) -> str:
    return json.dumps({"post": asdict(post) if post else None, "comments": [asdict(c) for c in comments]}, ensure_ascii=False, sort_keys=True)


# professional posts


def post_page(source: str, url: str) -> tuple[dict[str, Any], str] | None:
    """Metadata and markdown from the largest embedded entity list; None without one or without a post in it."""
    best: list[Any] = []
    for block in re.findall(r"<code[^>]*>(.*?)</code>", source, re.S):
        if len(block.encode()) > 1000:
            try:
                found = at(loads(_unescaped(block)), "included")
            except ValueError:
                continue
            if isinstance(found, list) and len(found) > len(best):
                best = found
    kind = lambda x: _or(text_at(x, "$type"), "")
    people = {}
    for x in best:
        first = _or(text_at(x, "firstName"), "")
        if "Profile" in kind(x) and first:
            people[_or(text_at(x, "entityUrn"), "")] = (f"{first} {_or(text_at(x, 'lastName'), '')}".strip(), _or(text_at(x, "headline"), ""))
    out = author = headline = ""
    for x in best:
        if "Update" not in kind(x):
            continue
        actor = at(x, "actor")
        if isinstance(actor, dict):
            by = actor.get("*author", actor.get("author"))
            author, headline = people.get(by, (author, headline)) if isinstance(by, str) else (author, headline)
            author = author or _or(text_at(actor, "name", "text"), "")
            headline = headline or _or(text_at(actor, "description", "text"), "")
        text = text_at(x, "commentary", "text", "text")
        if text is not None:
            out += (f"# {author}\n\n" if author else "") + (f"*{headline}*\n\n" if headline else "") + "---\n\n" + text.replace("\\n", "\n") + "\n\n"
    if not out:
        return None
    notes = [(_or(text_at(x, "commenter", "title", "text"), "Someone"), text_at(x, "commentary", "text")) for x in best if "Comment" in kind(x)]
    notes = [f"- **{name}**: {text}\n\n" for name, text in notes if text]
    out += "---\n\n## Comments\n\n" + "".join(notes) if notes else ""
    metadata: dict[str, Any] = dict.fromkeys(("title", "description", "author", "published_date", "language", "url", "site_name", "image", "favicon"))
    metadata |= {"url": url, "site_name": "LinkedIn", "word_count": word_count(out)}
    return metadata | ({"author": author, "title": f"{author}'s LinkedIn Post"} if author else {}), out


def _unescaped(text: str) -> str:
    names = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "quot": '"'}

    def one(m: re.Match[str]) -> str:
        if m[1].startswith("#"):
            code = int(m[1][1:]) if m[1][1:].isdigit() else 0x110000
            return chr(code) if code < 0xD800 or 0xE000 <= code < 0x110000 else m[0]
        return names.get(m[1], m[0])

    return re.sub(r"&([^;]{1,10});", one, text)
