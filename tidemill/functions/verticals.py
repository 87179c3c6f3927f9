"""Typed records of 29 kinds of sites, from the stored reply of each site's interface or page.

A vertical has a URL pattern, which Spark and Python both read, and a reader from the pattern's groups and the payload
to the record. Values keep the type that the payload gives them. Where a site needs two replies, the second one, of
downloads, answers or products, comes as `second` and may be missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from typing import Any
from urllib.parse import parse_qsl, urlsplit
from xml.etree import ElementTree

from tidemill.functions import sites
from tidemill.functions.sites import at, text_at
from tidemill.functions.structured import dumps, json_ld, loads

Record = dict[str, Any]


class VerticalError(Exception):
    """A payload or URL that its vertical cannot read."""


@dataclass(frozen=True)
class Page:
    url: str
    ids: dict[str, str | None]
    payload: str
    second: str | None = None

    @cached_property
    def json(self) -> Any:
        return parsed(self.payload)

    def reply(self, key: str | None = None) -> Record:
        got = self.json
        got = got.get(key) if key and isinstance(got, dict) else got
        if not isinstance(got, dict):
            raise VerticalError(f"no object{f' {key!r}' if key else ''} in the payload")
        return got


@dataclass(frozen=True)
class Vertical:
    name: str
    pattern: str
    read: Callable[[Page], Record]
    auto: bool = True


VERTICALS: dict[str, Vertical] = {}


def vertical(name: str, pattern: str, auto: bool = True) -> Callable[[Callable[[Page], Record]], Callable[[Page], Record]]:
    def add(read: Callable[[Page], Record]) -> Callable[[Page], Record]:
        VERTICALS[name] = Vertical(name, pattern, read, auto)
        return read

    return add


# reading values


def parsed(text: str | None) -> Any:
    try:
        return loads(text or "")
    except ValueError as bad:
        raise VerticalError(f"the payload is not JSON: {bad}") from bad


def items(value: Any) -> list[Any]:
    return value if isinstance(value, list) else []


Steps = tuple[list[str], bool, list[str]]


def _steps(path: str) -> Steps:
    """Keys to the value, whether it is a list to go through, and keys within each of its items."""
    head, each, rest = path.partition("[]")
    return head.split("."), bool(each), rest[1:].split(".") if rest else []


def _walk(value: Any, head: list[str], each: bool, rest: list[str]) -> Any:
    got = at(value, *head)
    if not each:
        return got
    return [x for x in (at(i, *rest) for i in items(got)) if x is not None] if rest else items(got)


def follow(value: Any, path: str) -> Any:
    """The value at a dotted path; after [], that of each item of a list, without nulls."""
    return _walk(value, *_steps(path))


@cache
def _fields(spec: str) -> list[tuple[str, str | None, Steps]]:
    """Name, key if that is all of the path, and steps of each word; the specs are those of this module, so they are few."""
    pairs = [(name.removesuffix("[]"), _steps(path or name)) for name, _, path in (word.partition("=") for word in spec.split())]
    return [(name, head[0] if len(head) == 1 and not each else None, (head, each, rest)) for name, (head, each, rest) in pairs]


def pick(value: Any, spec: str) -> Record:
    """Fields named by words `name` or `name=path`."""
    known = value if isinstance(value, dict) else {}
    return {name: _walk(known, *steps) if key is None else known.get(key) for name, key, steps in _fields(spec)}


def first(*values: Any) -> Any:
    return next((v for v in values if v is not None), None)


def scalar(value: Any, key: str) -> str | None:
    """A text or a number as text."""
    got = at(value, key)
    if isinstance(got, bool) or not isinstance(got, (str, int, float)):
        return None
    return got if isinstance(got, str) else dumps(got)


def whole(text: Any) -> int | None:
    if isinstance(text, bool):
        return None
    if isinstance(text, int):
        return text
    return int(text) if isinstance(text, str) and re.fullmatch(r"[+-]?[0-9]+", text) else None


def squeezed(text: str) -> str:
    return " ".join(text.split())


def group(pattern: str, text: str, flags: int = re.S) -> str | None:
    m = re.search(pattern, text, flags)
    return m[1] if m else None


# markup

_VALUE, _WITHIN = '"([^"]+)"', "[^>]+"


def _tag(name: str, *attributes: str) -> str:
    """Pattern of a tag with these attributes in this order; a bare name takes its value."""
    return f"<{name}{_WITHIN}" + _WITHIN.join(a if "=" in a else f"{a}={_VALUE}" for a in attributes)


def _holding(mark: str, inner: str = "([^<]+)") -> str:
    """Pattern of the text after the tag that mark is in."""
    return f"{mark}[^>]*>{inner}<"


_PROPERTY = re.compile(_tag("meta", "property", "content"), re.I)
_NAMED = re.compile(_tag("meta", "name", "content"), re.I)
_OPEN_GRAPH = re.compile(_tag("meta", 'property="og:([a-z_]+)"', "content"), re.I)
_BASIC = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_MORE = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#064;", "@"), ("&#x2022;", "•"), ("&hellip;", "…"))


def _classed(name: str) -> str:
    return f'class="[^"]*{name}[^"]*"'


def decoded(text: str | None, names: Iterable[tuple[str, str]] = _MORE) -> str | None:
    for entity, c in names if text else ():
        text = text.replace(entity, c)
    return text


def open_graph(html: str, lower: bool = False) -> dict[str, str]:
    """The first of each og: property of lower-case letters."""
    out: dict[str, str] = {}
    for m in _OPEN_GRAPH.finditer(html):
        out.setdefault(m[1].lower() if lower else m[1], m[2])
    return out


def properties(html: str) -> dict[str, str]:
    """The first of each property, of one walk over the page."""
    out: dict[str, str] = {}
    for m in _PROPERTY.finditer(html):
        out.setdefault(m[1], m[2])
    return out


def meta(html: str, name: str, pattern: re.Pattern[str] = _PROPERTY) -> str | None:
    return next((m[2] for m in pattern.finditer(html) if m[1] == name), None)


def untagged(html: str, by: str = " ") -> str:
    return re.sub(r"<[^>]+>", by, html)


def typed(value: Any, kinds: Iterable[str]) -> bool:
    kind = at(value, "@type")
    return any(k in kinds for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str))


def entities(value: Any) -> Iterator[Any]:
    """A block, then what its graph or list holds, depth first."""
    yield value
    for inner in items(at(value, "@graph")) or items(value):
        yield from entities(inner)


def entity(html: str, *kinds: str) -> Any:
    return next((e for block in json_ld(html) for e in entities(block) if typed(e, kinds)), None)


PRODUCT = ("Product", "ProductGroup", "IndividualProduct")


def brand_of(product: Any) -> str | None:
    return first(text_at(product, "brand"), text_at(product, "brand", "name"))


def image_of(thing: Any) -> str | None:
    got = at(thing, "image")
    for x in got if isinstance(got, list) else [got]:
        found = x if isinstance(x, str) else text_at(x, "url")
        if found is not None:
            return found
    return None


def offer_of(product: Any) -> Any:
    got = at(product, "offers")
    got = got[0] if isinstance(got, list) and got else got
    return got if isinstance(got, dict) else None


def plain_term(text: str | None) -> str | None:
    """A schema.org term without its address."""
    return None if text is None else re.sub(r"https?://schema\.org/", "", text)


def rating_of(thing: Any, names: str = "rating review best") -> Record | None:
    got = at(thing, "aggregateRating")
    keys = {"rating": ("rating_value", "ratingValue"), "review": ("review_count", "reviewCount"), "best": ("best_rating", "bestRating"),
            "worst": ("worst_rating", "worstRating"), "count": ("rating_count", "ratingCount")}
    return None if got is None else {keys[n][0]: scalar(got, keys[n][1]) for n in names.split()}


# URLs


def site(hosts: str) -> str:
    """Start of a URL pattern for these hosts, with www. or without."""
    return rf"^(?:[^/?#]*?://)?(?:www\.)?(?:{hosts})(?=/)"


END = r"/*(?:[?#]|$)"
CUT = r"(?:[/?#]|$)"


def host_of(url: str) -> str:
    return (url.split("://")[1] if "://" in url else url).split("/")[0]


def scheme_of(url: str) -> str:
    return "http" if url.startswith("http://") else "https"


# discussions


@vertical("reddit", r"^(?:[^/?#]*?://)?(?:(?:new|np|old|www)\.)?reddit\.com/.*/?comments/")
def _reddit(page: Page) -> Record:
    got = sites.thread(page.payload, page.url)
    if got is None:
        raise VerticalError("no thread in the page")
    return loads(sites.dumps_thread(*got)) | {"url": page.url}


_NEWS = "id author text created_at created_at_unix=created_at_i"


def _news_comments(item: Any) -> list[Record]:
    replies = (c for c in items(at(item, "children")) if at(c, "type") == "comment")
    return [pick(c, f"{_NEWS} parent_id story_id") | {"replies": _news_comments(c)} for c in replies]


def _size(comments: list[Record]) -> int:
    return sum(1 + _size(c["replies"]) for c in comments)


@vertical("hackernews", r"^(?:[^/?#]*?://)?(?:news\.ycombinator\.com/.*item(?:\?|%3F)id=|hn\.algolia\.com/(?:.*/)?items/)(?P<id>[0-9]+)?")
def _hackernews(page: Page) -> Record:
    item = page.reply()
    comments = _news_comments(item)
    post = pick(item, f"{_NEWS} type title url points")
    link = None if post["id"] is None else f"https://news.ycombinator.com/item?id={post['id']}"
    return {"url": page.url, "post": post | {"comment_count": _size(comments), "permalink": link}, "comments": comments}


# code


_NOT_OWNERS = "about|collections|events|explore|issues|join|login|marketplace|new|notifications|organizations|pulls|search|settings|sponsors|topics|trending"
_GITHUB = site(r"github\.com")
_REPO = r"/+(?P<owner>[^/?#]+)/+(?P<repo>[^/?#]+)"


@vertical("github_repo", rf"{_GITHUB}(?!/+(?:{_NOT_OWNERS})/){_REPO}{END}")
def _repository(page: Page) -> Record:
    counts = "stars=stargazers_count forks=forks_count watchers=subscribers_count open_issues=open_issues_count size_kb=size"
    flags = "archived fork is_template has_issues has_wiki has_pages has_discussions"
    about = "owner=owner.login name full_name description homepage language topics[] license=license.spdx_id license_name=license.name default_branch"
    return {"url": page.url} | pick(page.reply(), f"{about} {counts} {flags} created_at updated_at pushed_at html_url")


@vertical("pypi", site(r"pypi\.org") + r".*?/project/+(?P<name>[^/?#]+)(?:/+(?P<version>[^/?#]+))?")
def _pypi(page: Page) -> Record:
    info, releases = page.reply("info"), at(page.json, "releases")
    spec = "name version summary homepage=home_page license author author_email maintainer requires_python requires_dist keywords classifiers yanked yanked_reason project_urls"
    licenses = [c for c in items(info.get("classifiers")) if isinstance(c, str) and c.startswith("License ::")]
    longest = max(enumerate(licenses), key=lambda p: (len(p[1].encode()), p[0]), default=(0, None))[1]
    times = follow(releases, f"{info.get('version')}[].upload_time") if isinstance(releases, dict) and "." not in str(info.get("version")) else [
        f["upload_time"] for f in items(releases.get(info.get("version")) if isinstance(releases, dict) else None) if at(f, "upload_time") is not None
    ]
    more = {"license_classifier": longest, "release_count": len(releases or {}), "latest_release_date": max(times, default=None)}
    return {"url": page.url} | pick(info, spec) | more


@vertical("npm", site(r"npmjs\.com") + r".*?/package/+(?P<name>@[^/?#]+/+[^/?#]+|[^@/?#][^/?#]*)")
def _npm(page: Page) -> Record:
    doc = page.reply()
    versions, dates = doc.get("versions") or {}, doc.get("time") or {}
    latest = first(at(doc, "dist-tags", "latest"), max(versions, default=None))
    manifest = versions.get(latest)
    try:
        weekly = at(parsed(page.second), "downloads") if page.second else None
    except VerticalError:
        weekly = None
    out = pick(doc, "description homepage repository=repository.url keywords")
    out |= pick(manifest, "license dependencies dev_dependencies=devDependencies peer_dependencies=peerDependencies deprecated")
    people = doc.get("maintainers")
    return out | {
        "url": page.url, "name": first(doc.get("name"), page.ids["name"]), "latest_version": latest, "release_count": len(versions),
        "latest_release_date": dates.get(latest), "weekly_downloads": weekly,
        "maintainers": None if people is None else [pick(p, "name email") for p in items(people)],
    }


_DATES = "created_at updated_at closed_at html_url"


@vertical("github_pr", rf"{_GITHUB}{_REPO}/+pulls?/+(?P<number>[0-9]+){CUT}")
def _pull(page: Page) -> Record:
    about = "number title body state draft merged merged_at merge_commit_sha author=user.login labels=labels[].name milestone=milestone.title"
    refs = "head_ref=head.ref base_ref=base.ref head_sha=head.sha"
    counts = "additions deletions changed_files commits comments review_comments"
    return {"url": page.url} | pick(page.ids, "owner repo") | pick(page.reply(), f"{about} {refs} {counts} {_DATES}")


@vertical("github_issue", rf"{_GITHUB}{_REPO}/+issues/+(?P<number>[0-9]+){CUT}")
def _issue(page: Page) -> Record:
    issue = page.reply()
    if issue.get("pull_request") is not None:
        raise VerticalError("a pull request, not an issue")
    spec = "number title body state state_reason author=user.login labels=labels[].name assignees=assignees[].login milestone=milestone.title comments locked"
    return {"url": page.url} | pick(page.ids, "owner repo") | pick(issue, f"{spec} {_DATES}")


@vertical("github_release", rf"{_GITHUB}{_REPO}/+releases/+tag/+(?P<tag>[^/?#]+)")
def _release(page: Page) -> Record:
    release = page.reply()
    files = [pick(a, "name size download_count browser_download_url content_type created_at updated_at") for a in items(release.get("assets"))]
    out = pick(release, "tag_name name body draft prerelease author=author.login created_at published_at html_url")
    totals = {"asset_count": len(files), "total_downloads": sum(f["download_count"] or 0 for f in files), "assets": files}
    return {"url": page.url} | pick(page.ids, "owner repo") | out | totals


@vertical("crates_io", site(r"crates\.io") + r".*?/crates/+(?P<name>[^/?#]+)")
def _crate(page: Page) -> Record:
    crate, versions = page.reply("crate"), items(at(page.json, "versions"))
    last = next((v for v in versions if not at(v, "yanked")), versions[0] if versions else None)
    out = pick(crate, "name=id description homepage documentation repository max_stable_version max_version newest_version downloads recent_downloads")
    out |= pick(crate, "categories[] keywords[] created_at updated_at") | {"url": page.url, "release_count": len(versions)}
    return out | pick(last, "latest_release_date=created_at latest_license=license latest_rust_version=rust_version latest_yanked=yanked")


_HUB = site(r"huggingface\.co")
_NOT_SPACES = "api|blog|datasets|docs|join|login|models|new|organizations|papers|pricing|search|settings|spaces|tasks"
_CARD = "private gated downloads downloads_30d=downloadsAllTime likes tags[] license=cardData.license language=cardData.language created_at=createdAt last_modified=lastModified sha"


def _hub(page: Page, spec: str) -> Record:
    got = page.reply()
    files = [pick(f, "rfilename size") for f in items(got.get("siblings"))]
    return {"url": page.url} | pick(got, f"id {_CARD} {spec}") | {"file_count": len(files), "files": files}


@vertical("huggingface_model", rf"{_HUB}(?!/+(?:{_NOT_SPACES})/)/+(?P<owner>[^/?#]+)/+(?P<name>[^/?#]+){END}")
def _model(page: Page) -> Record:
    card = "datasets=cardData.datasets base_model=cardData.base_model model_type=cardData.model_type"
    return _hub(page, f"model_id=modelId library_name pipeline_tag {card}")


@vertical("huggingface_dataset", rf"{_HUB}/+datasets/+(?P<path>[^/?#]+(?:/+[^/?#]+)?){END}")
def _dataset(page: Page) -> Record:
    return _hub(page, " ".join(f"{k}=cardData.{k}" for k in "task_categories size_categories annotations_creators configs".split()))


_ATOM = "{http://www.w3.org/2005/Atom}"


@vertical("arxiv", site(r"arxiv\.org") + r".*?/(?:abs|pdf)/(?P<id>[^?#]+)")
def _paper(page: Page) -> Record:
    number = re.sub(r"v[0-9]*$", "", re.sub(r"(?:\.pdf)+$", "", (page.ids["id"] or "").rstrip("/")))
    try:
        feed = ElementTree.fromstring(page.payload)
    except ElementTree.ParseError as bad:
        raise VerticalError(f"the payload is not XML: {bad}") from bad
    tag = lambda x: x.tag.rpartition("}")[2]
    entry = next((x for x in feed.iter() if tag(x) == "entry"), None)
    if entry is None:
        raise VerticalError("no entry in the feed")
    parts = [(tag(x), x) for x in entry]
    texts: dict[str, str] = {}
    for name, x in parts:
        texts.setdefault(name, x.text or "")
    of = texts.get
    trimmed = lambda name: None if of(name) is None else of(name).strip()
    if of("title") is None and of("summary") is None:
        raise VerticalError("an empty entry")
    terms = [x.get("term") for name, x in parts if name in ("category", "primary_category") and x.get("term") is not None and x.tag.startswith(_ATOM)]
    terms = terms or [x.get("term") for name, x in parts if name == "category" and x.get("term") is not None]
    links = [x for name, x in parts if name == "link" and x.get("href")]
    last = lambda key, value: next((x.get("href") for x in reversed(links) if x.get(key) == value), None)
    names = [(n.text or "").strip() for name, a in parts if name == "author" for n in a if tag(n) == "name"]
    return {
        "url": page.url, "id": number, "arxiv_id": trimmed("id"), "title": of("title"), "authors": names,
        "abstract": None if of("summary") is None else squeezed(of("summary")), "published": trimmed("published"), "updated": trimmed("updated"),
        "primary_category": terms[0] if terms else None, "categories": terms, "doi": None, "comment": None,
        "pdf_url": last("type", "application/pdf"), "abs_url": last("rel", "alternate"),
    }


@vertical("docker_hub", r"^(?:[^/?#]*?://)?hub\.docker\.com(?=/).*?/(?:_/(?P<name>[^/?#]+)|r/+(?P<space>[^/?#]+)/+(?P<image>[^/?#]+))")
def _image(page: Page) -> Record:
    space, name = (page.ids["space"], page.ids["image"]) if page.ids["image"] else ("library", page.ids["name"])
    got = page.reply()
    spec = "namespace name pull_count star_count description full_description last_updated date_registered is_private status_description"
    kinds = [pick(c, "name slug") for c in items(got.get("categories"))]
    return {"url": page.url, "full_name": f"{space}/{name}", "is_official": space == "library", "categories": kinds} | pick(got, spec)


# posts


_NOT_PEOPLE = "about|api|code-of-conduct|contact|enter|listings|p|podcasts|privacy|search|settings|shop|signup|sponsors|sponsorships|t|tags|terms|videos"


@vertical("dev_to", site(r"dev\.to") + rf"(?!/+(?:{_NOT_PEOPLE})/)/+(?P<user>[^/?#]+)/+(?P<slug>[^/?#]+){END}")
def _article(page: Page) -> Record:
    got = page.reply()
    text = "id title description body_markdown url_canonical=canonical_url published_at edited_at reading_time_min=reading_time_minutes tags=tag_list cover_image"
    counts = "positive_reactions=positive_reactions_count public_reactions=public_reactions_count comments_count page_views_count"
    author = pick(got.get("user"), "username name twitter=twitter_username github=github_username website=website_url")
    return {"url": page.url, "author": author} | pick(got, f"{text} {counts}")


_BY = "author=owner.display_name author_rep=owner.reputation"


@vertical("stackoverflow", site(r"stackoverflow\.com") + rf".*?/questions/(?P<id>[0-9]+){CUT}")
def _question(page: Page) -> Record:
    found = follow(page.json, "items[]")
    if not found:
        raise VerticalError("no such question")
    replies = follow(parsed(page.second), "items[]") if page.second else []
    answers = [pick(a, f"answer_id is_accepted score body creation_date last_edit_date {_BY}") for a in replies]
    spec = "question_id title body tags[] score view_count answer_count is_answered accepted_answer_id creation_date last_activity_date link"
    best = next((a for a in answers if a["is_accepted"] is True), None)
    return {"url": page.url, "accepted_answer": best, "top_answers": answers} | pick(found[0], f"{spec} {_BY}")


_ALNUM, _EMBED = "[A-Za-z0-9]", "/".join(("https://www.linkedin.com", "embed", "feed", "update"))


@vertical("linkedin_post", r"^(?:[^/?#]*?://)?(?:www\.)?linkedin\.com(?=/).*?/(?:feed/update/urn:li:|posts/)")
def _professional(page: Page) -> Record:
    urn = group(r"(urn:li:[^:/?#]*:[0-9]*(?::[^/?#]*)?)(?=[/?#]|$)", page.url)
    number = None if urn else group(rf"/posts/[^/]*?-([0-9]{{15,}})-{_ALNUM}{{2,}}/?", page.url)
    if not urn and not number:
        raise VerticalError("no post number in the URL")
    urn = urn or f"urn:li:activity:{number}"
    address, graph = f"{_EMBED}/{urn}", open_graph(page.payload, lower=True)
    text = group(_holding(_tag("p", _classed("attributed-text-segment-list__content")), "(.*?)") + "/p>", page.payload)
    title = group("<title>" + r"([^<]+)" + "</title>", page.payload)
    return {
        "url": page.url, "embed_url": address, "urn": urn, "canonical_url": decoded(graph.get("url")) or address, "data_completeness": "embed",
        "title": decoded(graph.get("title")), "body": None if text is None else decoded(untagged(text, "")).strip(),
        "author_name": decoded(title.rpartition("|")[2].strip()) if title and "|" in title else None,
        "image_url": decoded(graph.get("image")), "site_name": decoded(graph.get("site_name")) or "LinkedIn",
    }


_PHOTOS = site(r"instagram\.com")
_NOT_USERS = "about|accounts|ads|api|blog|developer|directory|explore|fragments|login|p|press|privacy|reels?|session|signup|stories|terms|tv"


_USER = 'class="CaptionUsername"'


@vertical("instagram_post", rf"{_PHOTOS}/+(?P<kind>p|reels?|tv)/+(?P<code>[^/?#]+)")
def _photo(page: Page) -> Record:
    kind, code, html = page.ids["kind"].rstrip("s"), page.ids["code"], page.payload
    block = group(_holding(r'<div\s+class="Caption"', "(.*?)") + "/div>", html)
    if block is not None:
        block = untagged(re.sub(_holding(f"<a[^>]*{_USER}", ".*?") + "/a>", "", block, flags=re.S))
        block = squeezed(decoded(block.strip())) or None
    image = first(group(_tag("img", _classed("EmbeddedMediaImage"), "src"), html), open_graph(html).get("image"))
    name = group(_holding(_USER), html)
    return {
        "url": page.url, "embed_url": f"https://www.instagram.com/p/{code}/embed/captioned/", "shortcode": code,
        "kind": "post" if kind == "p" else kind, "data_completeness": "embed", "author_username": decoded(name.strip()) if name else None,
        "caption": block, "thumbnail_url": decoded(image), "canonical_url": f"https://www.instagram.com/{kind}/{code}/",
    }


def _node(n: Any) -> Record:
    kinds = {"GraphSidecar": "carousel", "GraphVideo": "video", "GraphImage": "photo"}
    kind = "reel" if at(n, "product_type") == "clips" else kinds.get(at(n, "__typename"), "post")
    likes = "like_count=edge_media_preview_like.count comment_count=edge_media_to_comment.count"
    out = pick(n, f"shortcode video_views=video_view_count display_url taken_at=taken_at_timestamp alt_text=accessibility_caption product_type {likes}")
    size, texts = at(n, "dimensions"), follow(n, "edge_media_to_caption.edges[].node.text")
    return out | {
        "url": f"https://www.instagram.com/{'reel' if kind == 'reel' else 'p'}/{out['shortcode'] or ''}/", "kind": kind,
        "is_video": bool(at(n, "is_video")), "thumbnail_url": first(at(n, "thumbnail_src"), out["display_url"]),
        "caption": texts[0] if texts else None, "dimensions": None if size is None else pick(size, "width height"),
    }


def _compact(text: str) -> int | None:
    times = {"K": 1_000, "M": 1_000_000, "B": 1_000_000_000}.get(text[-1:], 1)
    try:
        return int(float(text.rstrip("KMB").replace(",", "")) * times)
    except ValueError:
        return None


@vertical("instagram_profile", rf"{_PHOTOS}(?!/+(?:{_NOT_USERS}){END})/+(?P<user>[^/?#]+){END}")
def _profile(page: Page) -> Record:
    name = page.ids["user"]
    out: Record = {"url": page.url, "canonical_url": f"https://www.instagram.com/{name}/", "username": name}
    if page.payload.lstrip().startswith("<"):
        graph = open_graph(page.payload, lower=True)
        n = r"([\d.,]+[KMB]?)"
        m = re.search(rf"{n}\s*Followers,\s*{n}\s*Following,\s*{n}\s*Posts", decoded(decoded(graph.get("description"))) or "", re.I)
        counts = [_compact(x) for x in m.groups()] if m else [None] * 3
        full = (decoded(decoded(graph.get("title"))) or "").split("(")[0].strip()
        out |= dict(zip(("follower_count", "following_count", "post_count"), counts, strict=True))
        return out | {
            "data_completeness": "og_only", "full_name": full or None, "profile_pic_url": decoded(graph.get("image")), "biography": None,
            "is_verified": None, "is_business": None, "recent_posts": [],
        }
    user = at(page.reply("data"), "user")
    if not isinstance(user, dict):
        raise VerticalError("no user in the payload")
    about = "user_id=id full_name biography biography_links=bio_links external_url category=category_name is_verified is_private"
    kinds = "is_business=is_business_account is_professional=is_professional_account"
    counts = "follower_count=edge_followed_by.count following_count=edge_follow.count post_count=edge_owner_to_timeline_media.count"
    return out | pick(user, f"{about} {kinds} {counts}") | {
        "username": first(user.get("username"), name), "data_completeness": "api",
        "profile_pic_url": first(user.get("profile_pic_url_hd"), user.get("profile_pic_url")),
        "recent_posts": [_node(n) for n in follow(user, "edge_owner_to_timeline_media.edges[].node")],
    }


# shops


_AMAZON = r"amazon\.(?:co\.(?:jp|uk)|com(?:\.(?:au|be|br|mx|tr))?|ae|ca|cn|de|eg|es|fr|in|it|nl|pl|sa|se|sg)"
_EBAY = r"ebay\.(?:co\.uk|com(?:\.(?:au|hk|my|sg))?|at|be|ca|ch|de|es|fr|ie|it|nl|ph|pl)"


def _shop(hosts: str) -> str:
    return rf"(?i:^[a-z][a-z0-9+.-]*://(?:www\.)?{hosts}(?::[0-9]+)?)(?=/)"


def _offer(offer: Any) -> Record:
    seller = text_at(offer, "seller", "name")
    return {
        "price": scalar(offer, "price"), "low_price": scalar(offer, "lowPrice"), "high_price": scalar(offer, "highPrice"),
        "currency": scalar(offer, "priceCurrency"), "availability": plain_term(scalar(offer, "availability")), "seller": seller,
        "item_condition": plain_term(scalar(offer, "itemCondition")), "offer_count": scalar(offer, "offerCount"),
    }


def _listed(html: str, graph: dict[str, str]) -> tuple[Any, Record, Record]:
    """The product, the fields that every shop has, and its first offer."""
    product = entity(html, *PRODUCT)
    known = {
        "title": first(scalar(product, "name"), graph.get("title")), "description": first(scalar(product, "description"), graph.get("description")),
        "image": first(image_of(product), graph.get("image")), "brand": brand_of(product), "aggregate_rating": rating_of(product),
        "data_source": "local",
    }
    return product, known, _offer(offer_of(product))


def _some(offer: Record, spec: str) -> Record:
    return pick(offer, spec)


@vertical("amazon_product", _shop(_AMAZON) + rf".*/(?:ASIN|dp|(?:gp/)?product)/(?P<asin>[A-Z0-9]{{10}}){CUT}")
def _amazon(page: Page) -> Record:
    html = page.payload
    graph = {k: decoded(v, _BASIC) for k, v in open_graph(html).items()}
    title = group(_holding('id="productTitle"'), html)
    graph |= {k: v for k, v in (("title", title and title.strip()), ("image", group(f'id="landingImage"{_WITHIN}src={_VALUE}', html))) if v is not None}
    product, known, offer = _listed(html, graph)
    codes = {"asin": page.ids["asin"], "sku": scalar(product, "sku"), "mpn": scalar(product, "mpn")}
    return {"url": page.url} | codes | known | _some(offer, "price currency availability condition=item_condition")


@vertical("ebay_listing", _shop(_EBAY) + rf".*/itm/(?:[^/]+/)?(?P<item>[0-9]{{8,}}){CUT}")
def _ebay(page: Page) -> Record:
    _, known, offer = _listed(page.payload, open_graph(page.payload))
    spec = "price low_price high_price offer_count currency availability condition=item_condition seller"
    return {"url": page.url, "item_id": page.ids["item"]} | known | _some(offer, spec)


def _said_nothing(text: str | None, whole_texts: tuple[str, ...], heads: tuple[str, ...]) -> bool:
    text = (text or "").strip().lower()
    return text in whole_texts or text.startswith(heads)


@vertical("etsy_listing", r"^(?:[^/?#]*?://)?(?:[^/?#]*\.)?etsy\.com(?=/).*?/listing/(?P<item>[0-9]{6,})(?:/(?P<slug>[^/?#]+)|[/?#]|$)")
def _etsy(page: Page) -> Record:
    html, graph = page.payload, open_graph(page.payload)
    heads = ("etsy - ", "etsy.com - ", "etsy uk - ", "this item is unavailable", "sorry, this item is")
    if _said_nothing(graph.get("title"), ("", "etsy", "etsy.com", "www.etsy.com", "item not available - etsy"), heads):
        graph.pop("title", None)
    if _said_nothing(graph.get("description"), ("",), ("sorry, the page you were looking for", "page not found", "find the perfect handmade gift")):
        graph.pop("description", None)
    product, known, offer = _listed(html, graph)
    words = " ".join(w[0].upper() + w[1:] for w in re.split("[-_]", (page.ids["slug"] or "").strip()) if w)
    shop = group(r'href="(/shop/[A-Za-z0-9_-]+)"', html)
    return {"url": page.url, "listing_id": page.ids["item"]} | known | _some(offer, "price low_price high_price currency availability") | {
        "title": first(known["title"], words or None), "item_condition": plain_term(scalar(product, "itemCondition")),
        "shop": first(offer["seller"], known["brand"]), "shop_url": shop and f"https://www.etsy.com{shop}",
    }


_STARS = {"1 star": "one_star", "2 stars": "two_stars", "3 stars": "three_stars", "4 stars": "four_stars", "5 stars": "five_stars"}


_QUOTE = r'[\\"]+'


def _stars(data: Any) -> dict[str, Record] | None:
    out: dict[str, Record] = {}
    for column in items(at(data, "mainEntity", "csvw:tableSchema", "csvw:columns")):
        name, cells = text_at(column, "csvw:name"), items(at(column, "csvw:cells"))
        if name is None or not cells:
            return None
        key = name.strip().lower()
        notes = items(at(cells[0], "csvw:notes"))
        percent = notes[0] if notes and isinstance(notes[0], str) else None
        out[_STARS.get(key, key.replace(" ", "_"))] = {"count": whole(text_at(cells[0], "csvw:value")), "percent": percent}
    return out or None


def _average(stars: dict[str, Record] | None) -> tuple[str | None, int | None]:
    if stars is None:
        return None, None
    counts = [at(stars, k, "count") or 0 for k in _STARS.values()]
    total = first(at(stars, "total", "count"), sum(counts))
    if total == 0:
        return None, 0
    return f"{sum(n * k for k, n in enumerate(counts, 1)) / max(1, sum(counts)):.1f}", total


@vertical("trustpilot_reviews", site(r"trustpilot\.com") + r".*?/review/(?P<domain>[^/?#]+)")
def _reviews(page: Page) -> Record:
    domain, graph = page.ids["domain"], open_graph(page.payload)
    nodes = []
    for block in json_ld(page.payload):
        inner = at(block, "@graph")
        nodes += [block, *(inner if isinstance(inner, list) else [inner] if isinstance(inner, dict) else [])]
    tables = [n for n in nodes if at(n, "@type") == "Dataset"]
    own = [n for n in tables if f"/Organization/{domain}" in (text_at(n, "about", "@id") or "")]
    data = (own or tables or [None])[0]
    summary = next((n for n in nodes if at(n, "aiSummary") is not None), None)
    title, description = (decoded(graph.get(k), _BASIC) or "" for k in ("title", "description"))
    rated = re.search(rf"is rated\s*{_QUOTE}" + r'([^"\\]+)' + rf"{_QUOTE}\s*with\s*" + r"([0-9.]+)" + r"\s*/\s*5", title)
    stars = _stars(data)
    average, total = _average(stars)
    people = "author=consumer.displayName author_country=consumer.countryCode author_review_count=consumer.numberOfReviews verified=consumer.isVerified"
    dates = "date_experienced=dates.experiencedDate date_published=dates.publishedDate"
    recent = [pick(r, f"id rating title text language source likes {people} {dates}") for r in follow(summary, "aiSummaryReviews[]")]
    customers = group("([0-9][0-9,]*)" + r"\s+customers", description)
    return {
        "url": page.url, "domain": domain, "business_name": first(text_at(data, "name"), group("^(.+?)" + r"\s+is rated\b", title), domain),
        "rating_label": rated[1].strip() if rated else None, "average_rating": first(average, rated and rated[2]),
        "review_count": first(total, customers and int(customers.replace(",", ""))), "rating_distribution": stars,
        "ai_summary": text_at(summary, "aiSummary", "summary"), "recent_reviews": recent, "review_count_listed": len(recent), "data_source": "local",
    }


_VIDEO = r"(?i:youtu\.be/|youtube\.com/watch)|youtube\.com/shorts/|youtube-nocookie\.com/embed/"


def _video_id(url: str) -> str | None:
    for mark in ("youtu.be/", "youtube.com/shorts/", "/embed/"):
        found = re.split(r"[?#/]", url.split(mark)[1], maxsplit=1)[0] if mark in url else ""
        if found:
            return found
    for word in url.partition("?")[2].split("&"):
        if word.startswith("v="):
            return re.split("[#/]", word[2:], maxsplit=1)[0] or None
    return None


@vertical("youtube_video", _VIDEO)
def _video(page: Page) -> Record:
    number, html = _video_id(page.url), page.payload
    if number is None:
        raise VerticalError("no video number in the URL")
    state, graph = sites.player(html), open_graph(html)
    details, about = at(state, "videoDetails"), at(state, "microformat", "playerMicroformatRenderer")
    out = pick(details, "title description=shortDescription author channel_id=channelId is_live=isLiveContent is_private=isPrivate allow_ratings=allowRatings keywords[]")
    out |= pick(about, "channel_url=ownerProfileUrl is_unlisted=isUnlisted category upload_date=uploadDate publish_date=publishDate")
    out |= {k: whole(at(details, name)) for k, name in (("view_count", "viewCount"), ("length_seconds", "lengthSeconds"))}
    out |= {"url": page.url, "canonical_url": f"https://www.youtube.com/watch?v={number}", "video_id": number, "data_source": "player_response"}
    if state is not None:
        return out | {"thumbnails": follow(details, "thumbnail.thumbnails[]"), "caption_tracks": sites.caption_tracks(html)}
    picture = graph.get("image")
    return out | {
        "data_source": "og_fallback", "title": graph.get("title"), "description": graph.get("description"), "author": meta(html, "author", _NAMED),
        "thumbnails": [{"url": picture}] if picture else [], "caption_tracks": [],
    }


# parcels

_QUOTES = (*((e, "'") for e in ("&#x27;", "&#39;", "&rsquo;", "&#8217;", "&#x2019;", "’")), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _step(part: str, rest: str) -> str:
    return f'class="ch-suivi-colis-light-{part}{rest}"[^>]*>'


_INFO = re.compile(r'<div[^>]*' + _step("info", r"(\s[^\"]*)?"))
_TEXT = re.compile(_step("text", r"(?:\s[^\"]*)?") + "(.*?)</div>", re.S)
_ROW, _CELL = (re.compile(_holding(mark, "(.*?)") + f"/{mark[1:]}>", re.S) for mark in ("<tr", "<t[dh]"))
_BREAK = re.compile(r"<br\s*/?>", re.I)
_PARCEL = (("&nbsp;", " "), *_QUOTES)


def _words(html: str) -> str:
    text = untagged(html) if "<" in html else html
    return squeezed((decoded(text, _PARCEL) if "&" in text or "’" in text else text) or "")


@vertical("chronopost", r"(?i:^https?://(?:[^/?#@]*@)?(?:www\.)?chronopost\.fr(?::[0-9]+)?)/?[^?#]*\?(?:[^#]*&)?listeNumerosLT=[^&#]")
def _parcel(page: Page) -> Record:
    query = dict(parse_qsl(urlsplit(page.url).query))
    number, language = query.get("listeNumerosLT"), query.get("langue", "en")
    if page.payload.lstrip().startswith("<"):
        raise VerticalError("the payload is a page, not tracking data")
    got = page.reply()
    if (got.get("error") if isinstance(got.get("error"), str) else "").strip():
        raise VerticalError(_words(got["error"]))
    top, rows = text_at(got, "top") or "", text_at(got, "tab") or ""
    steps: list[Record] = []
    heads = list(_INFO.finditer(top))
    for k, head in enumerate(heads):
        part = top[head.end() : heads[k + 1].start() if k + 1 < len(heads) else len(top)]
        text = _TEXT.search(part)
        label = _words(text[1] if text else "")
        kinds = head[1] or ""
        if label and all(s["label"] != label for s in steps):
            steps.append({"label": label, "state": "current" if "active" in kinds else "pending" if "after" in kinds else "completed"})
    events: list[Record] = []
    for row in _ROW.findall(rows):
        cells = _CELL.findall(row)
        if len(cells) > 1:
            (date, time), (office, what) = ([_words(x) for x in (*_BREAK.split(c, maxsplit=1), "")[:2]] for c in cells[:2])
            if date and time:
                events.append({"date": date, "time": time, "office": office, "event": what, "details": _words(cells[2]) if len(cells) > 2 else ""})
    if not steps and not events:
        raise VerticalError("no milestones or events in the payload")
    return {
        "tracking_number": number, "language": language, "status": next((s["label"] for s in steps if s["state"] == "current"), None),
        "steps": steps, "events": events, "event_count": len(events), "source_url": page.url,
    }


# on request only: patterns that many sites fit

_OTHERS = r"aliexpress\.com|amazon\.(?:co\.uk|com|de)|ebay\.com|etsy\.com|github\.com|target\.com|walmart\.com"
_NOT_PRODUCTS = rf"^(?!(?:[^/?#]*?://)?[^/]*(?:{_OTHERS}|amazon\.(?:fr|it)|bestbuy\.com|homedepot\.com|wayfair\.com)(?:/|$))(?!(?:[^:]*://)?/)"
_NOT_COLLECTIONS = rf"^(?!(?:[^/?#]*?://)?[^/]*(?:{_OTHERS}|huggingface\.co)(?:/|$))(?!(?:[^:]*://)?/)"


@vertical("shopify_product", rf"{_NOT_PRODUCTS}.*/products/(?!$)", auto=False)
def _goods(page: Page) -> Record:
    product = page.reply("product")
    path, mark, query = page.url.partition("?")
    path = path.rstrip("/")
    variant = "id title sku barcode price compare_at_price available inventory_quantity position weight weight_unit requires_shipping taxable option1 option2 option3"
    variants = [pick(v, variant) for v in items(product.get("variants"))]
    images = [pick(i, "src width height position alt") for i in items(product.get("images"))]
    prices = []
    for v in variants:
        try:
            prices.append(float(v["price"]))
        except (TypeError, ValueError):
            continue
    out = pick(product, "product_id=id handle title vendor product_type tags description_html=body_html published_at created_at updated_at")
    return out | {
        "url": page.url, "json_url": path + ("" if path.endswith(".json") else ".json") + mark + query, "variant_count": len(variants),
        "image_count": len(images), "any_available": any(v["available"] is True for v in variants), "price_min": min(prices, default=None),
        "price_max": max(prices, default=None), "variants": variants, "images": images,
        "options": [pick(o, "name values[] position") for o in items(product.get("options"))],
    }


@vertical("shopify_collection", rf"{_NOT_COLLECTIONS}.*/collections/(?!$)", auto=False)
def _collection(page: Page) -> Record:
    try:
        products = follow(parsed(page.second), "products[]") if page.second else []
    except VerticalError:
        products = []
    base = re.sub(r"(?:\.json)+$", "", page.url.partition("?")[0].rstrip("/"))
    rows = []
    for p in products:
        variants, images = items(at(p, "variants")), items(at(p, "images"))
        row = pick(p, "id handle title vendor product_type created_at updated_at") | pick(variants[0] if variants else None, "price compare_at_price")
        rows.append(row | {
            "available": any(at(v, "available") is True for v in variants), "variant_count": len(variants), "image": at(images[0], "src") if images else None,
        })
    out = pick(page.reply("collection"), "collection_id=id handle title description_html=body_html published_at updated_at sort_order")
    addresses = {"url": page.url, "meta_json_url": f"{base}.json", "products_json_url": f"{base}/products.json?limit=50"}
    return out | addresses | {"products_in_page": len(rows), "products": rows}


def _tagged_offer(given: dict[str, str]) -> Record | None:
    either = lambda a, b: first(given.get(a), given.get(b))
    price = either("product:price:amount", "og:price:amount")
    if price is None:
        return None
    known = {"price": price, "currency": either("product:price:currency", "og:price:currency"), "availability": either("product:availability", "og:availability")}
    return {**_offer(None), "valid_until": None, "url": None, **known}


@vertical("ecommerce_product", r"^https?://[^/]+", auto=False)
def _any_product(page: Page) -> Record:
    html, graph, tags = page.payload, open_graph(page.payload), properties(page.payload)
    product, tagged = entity(html, *PRODUCT, "Vehicle", "SomeProducts"), _tagged_offer(tags)
    if product is None and tagged is None and graph.get("type", "").lower() not in ("product", "og:product", "product.item"):
        raise VerticalError("no product in the page")
    given = at(product, "offers")
    given = given if isinstance(given, list) else [given] if isinstance(given, dict) else []
    offers = [_offer(o) | {"valid_until": scalar(o, "priceValidUntil"), "url": scalar(o, "url")} for o in given]
    source = "og_fallback" if product is None else "jsonld" if offers or tagged is None else "jsonld+og"
    pictures = at(product, "image")
    pictures = [x if isinstance(x, str) else at(x, "url") for x in (pictures if isinstance(pictures, list) else [pictures])]
    pictures = [x for x in pictures if x is not None] or ([graph["image"]] if "image" in graph else [])
    codes = (scalar(product, k) for k in ("gtin", "gtin13", "gtin12", "gtin8"))
    return {k: scalar(product, k) for k in ("sku", "mpn", "category", "color", "material")} | {
        "url": page.url, "data_source": source, "name": first(scalar(product, "name"), graph.get("title")),
        "description": first(scalar(product, "description"), graph.get("description")), "brand": first(brand_of(product), tags.get("product:brand")),
        "gtin": first(*codes), "product_id": scalar(product, "productID"), "images": pictures, "offers": offers or ([tagged] if tagged else []),
        "aggregate_rating": rating_of(product, "rating best worst count review"),
        "review_count": first(scalar(at(product, "aggregateRating"), "reviewCount"), scalar(product, "reviewCount")),
        "raw_schema_type": scalar(product, "@type"), "raw_jsonld": product,
    }


_STORE = "/wp-json/wc/store" + "/v1/products"


@vertical("woocommerce_product", r"^(?:[^:/?#]*://)?[^/]+(?=/).*?/(?:product|shop|producto|produit)/", auto=False)
def _wares(page: Page) -> Record:
    slug = first(*(group(rf"/{word}/([^/?#]+)", page.url) for word in ("product", "shop", "producto", "produit")))
    if slug is None:
        raise VerticalError("no product name in the URL")
    found = items(page.json)
    if not found:
        raise VerticalError("no such product")
    p = found[0]
    prices = "price=prices.price regular_price=prices.regular_price sale_price=prices.sale_price currency=prices.currency_code currency_minor=prices.currency_minor_unit price_range=prices.price_range"
    about = "product_id=id name slug sku permalink on_sale in_stock=is_in_stock is_purchasable average_rating review_count description short_description"
    images = [pick(i, "src thumbnail alt") for i in items(at(p, "images"))]
    address = f"{scheme_of(page.url)}://{host_of(page.url)}{_STORE}?slug={slug}&per_page=1"
    counts = {"variation_count": len(items(at(p, "variations"))), "image_count": len(images), "images": images}
    return {"url": page.url, "api_url": address} | pick(p, f"{about} {prices} categories=categories[].name tags=tags[].name") | counts


def _writers(article: Any) -> list[Record]:
    got, out = at(article, "author"), []
    for a in got if isinstance(got, list) else [got]:
        if isinstance(a, str):
            out.append({"name": a})
        elif text_at(a, "name") is not None:
            address = text_at(a, "url") or ""
            handle = re.split(r"[/?#]", address.rpartition("@")[2], maxsplit=1)[0] if "@" in address else ""
            out.append({"name": text_at(a, "name"), "handle": handle or None})
    return out


@vertical("substack_post", r"^https?://[^/].*?/p/(?P<slug>[^/?#]+)", auto=False)
def _letter(page: Page) -> Record:
    slug, html = page.ids["slug"], page.payload
    out: Record = {"url": page.url, "api_url": f"{scheme_of(page.url)}://{host_of(page.url)}/api/v1/posts/{slug}"}
    if html.lstrip().startswith("{"):
        p = page.reply()
        spec = "id type title subtitle description canonical_url post_date updated_at audience is_free_preview cover_image word_count=wordcount reactions comment_count body_html"
        return out | pick(p, spec) | {
            "data_source": "api", "slug": first(p.get("slug"), slug), "has_paywall": p.get("audience") in ("only_paid", "founding"),
            "body_text": first(p.get("truncated_body_text"), p.get("body_text")),
            "publication": pick(p.get("publication"), "id name subdomain custom_domain"),
            "authors": [pick(a, "id name handle photo=photo_url") for a in items(p.get("publishedBylines", p.get("published_bylines")))],
        }
    article, graph = entity(html, "Article", "NewsArticle", "BlogPosting", "SocialMediaPosting"), open_graph(html)
    blank = dict.fromkeys("subtitle body_html body_text word_count comment_count reactions has_paywall is_free_preview".split())
    return out | blank | {
        "data_source": "html_fallback", "slug": slug, "title": first(scalar(article, "headline"), graph.get("title")),
        "description": first(scalar(article, "description"), graph.get("description")), "cover_image": first(image_of(article), graph.get("image")),
        "canonical_url": first(group(_tag("link", 'rel="canonical"', "href"), html, re.S | re.I), page.url),
        "post_date": first(scalar(article, "datePublished"), meta(html, "article:published_time")), "updated_at": scalar(article, "dateModified"),
        "publication": {"name": graph.get("site_name")}, "authors": _writers(article), "fetch_source": "local",
    }


# dispatch


def match(name: str, url: str) -> dict[str, str | None] | None:
    m = re.search(VERTICALS[name].pattern, url)
    return m.groupdict() if m else None


def by_url(url: str) -> str | None:
    """The first vertical, of those that are found by URL, whose pattern fits."""
    return next((v.name for v in VERTICALS.values() if v.auto and match(v.name, url) is not None), None)


def record(name: str | None, url: str | None, payload: str | None, second: str | None = None) -> tuple[str | None, str | None]:
    """The record as JSON, or else why there is none."""
    if name not in VERTICALS:
        return None, f"no vertical {name!r}"
    ids = match(name, url or "")
    if ids is None:
        return None, f"the URL does not belong to {name}"
    try:
        return dumps(VERTICALS[name].read(Page(url or "", ids, payload or "", second))), None
    except VerticalError as bad:
        return None, f"{name}: {bad}"
