"""Page and URL tests, and text measures, as native Column expressions."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import urls

SKIPPED = tuple(".avi .css .eot .gif .gz .ico .jpeg .jpg .js .mov .mp3 .mp4 .pdf .png .rss .svg .tar .ttf .webp .woff .woff2 .xml .zip".split())
CHALLENGE_TITLES = tuple(
    "access denied,attention required,bot verification,checking your browser,ddos protection,just a moment,one more step,please wait,"
    "security check,verify you are human".split(",")
)
CONSENT_URLS = tuple("/cmp/ /consent/ /consent? ://consent. collectconsent consentcheck guce.advertising.com".split())
CONSENT_TITLES = tuple(
    "before you continue,consent required,cookie consent,we care about your privacy,we value your privacy,your privacy choices".split(",")
)
APP_MARKS = ('__next_data__', 'id="__next"', 'id="app"', 'id="root"', "ng-app", "nuxt", "react-app")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has_any(text: Column, marks: Iterable[str]) -> Column:
    return any_of(text.contains(m) for m in marks)


def starts_any(text: Column, heads: Iterable[str]) -> Column:
    return any_of(text.startswith(h) for h in heads)


# URLs


def is_http_url(url: Column) -> Column:
    bare = F.trim(url)
    return F.coalesce(urls.scheme(bare).isin("http", "https") & urls.host(bare).isNotNull(), F.lit(False))


def is_blocked_ipv4(address: Column) -> Column:
    """Whether a dotted address is not a public one; null for other text."""
    octet = lambda k: F.regexp_extract(address, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int")
    a, b, c = octet(1), octet(2), octet(3)
    blocked = (
        a.isin(0, 10, 127) | (a >= 224) | (a == 169) & (b == 254) | (a == 172) & b.between(16, 31) | (a == 192) & (b == 168)
        | (a == 100) & b.between(64, 127) | (a == 192) & (b == 0) & c.isin(0, 2) | (a == 198) & b.between(18, 19)
        | (a == 198) & (b == 51) & (c == 100) | (a == 203) & (b == 0) & (c == 113)
    )
    return F.when(a.isNotNull(), blocked)


_BLOCKED = tuple(map(ipaddress.ip_network, ("fc00::/7", "fe80::/10", "ff00::/8", "64:ff9b::/96", "2001:db8::/32", *(
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 "
    "198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3"
).split())))


def blocked_address(text: str) -> bool:
    """As is_blocked_ipv4, for addresses of both kinds; False for names."""
    try:
        ip = ipaddress.ip_address(text.strip("[]"))
    except ValueError:
        return False
    if ip.version == 6 and int(ip) >> 32 in (0, 0xFFFF):
        return int(ip) in (0, 1) or blocked_address(str(ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF)))
    return any(ip in n for n in _BLOCKED if n.version == ip.version)


@F.pandas_udf(T.BooleanType())
def _is_blocked_literal(host: pd.Series) -> pd.Series:
    return host.map(lambda h: h is not None and blocked_address(h))


def is_blocked_host(host: Column) -> Column:
    """Native for names and dotted addresses; only bracketed literals are looked at in Python."""
    literal = host.startswith("[")
    return F.when(literal, _is_blocked_literal(F.when(literal, host))).otherwise(F.coalesce(is_blocked_ipv4(host), F.lit(False)))


def is_public_url(url: Column) -> Column:
    """A web URL whose host is not a private address. Names are not resolved."""
    name = F.regexp_extract(F.trim(url), r"^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return is_http_url(url) & ~is_blocked_host(F.lower(name))


def glob_pattern(glob: str) -> str:
    """An anchored Java pattern: * within a segment, ** across and over one slash after it, ? any one character."""
    if len(glob.encode()) > 1024:
        raise ValueError("a glob has at most 1024 bytes")
    if len(re.findall(r"\*{2,}", glob)) > 4:
        raise ValueError("a glob has at most four **")
    out = ""
    for m in re.finditer(r"(\*{2,})(/?)|(\*)|(\?)|(.)", glob, re.S):
        if m[1]:
            out += "(?=.)(?s:.*)" if m[2] else "(?s:.*)"
        else:
            out += "[^/]*" if m[3] else "(?s:.)" if m[4] else re.escape(m[5])
    return rf"^{out}\z"


def glob_match(text: Column, glob: str) -> Column:
    return text.rlike(glob_pattern(glob))


def in_crawl_scope(
    url: Column, seed: Column, *, external: bool = False, subdomains: bool = False, prefix: str | None = None,
    include: tuple[str, ...] = (), exclude: tuple[str, ...] = (),
) -> Column:
    """Whether a link is to be crawled; what was visited is a join."""
    ok = urls.scheme(url).isin("http", "https")
    if not external:
        same = urls.origin_key(url) == urls.origin_key(seed)
        ok &= (same | (urls.root_domain(url) == urls.root_domain(seed))) if subdomains else same
    path = urls.path(url)
    if prefix is not None:
        ok &= path.startswith(prefix)
    if include:
        ok &= any_of(glob_match(path, g) for g in include)
    for g in exclude:
        ok &= ~glob_match(path, g)
    return F.coalesce(ok & ~any_of(path.endswith(e) for e in SKIPPED), F.lit(False))


def is_reddit(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:.*?://)?([^/?#]*)", 1).isin("new.reddit.com", "np.reddit.com", "old.reddit.com", "reddit.com", "www.reddit.com")


def is_video(url: Column) -> Column:
    return has_any(F.lower(url), ("youtu.be/", "youtube.com/watch"))


def is_linkedin_post(url: Column) -> Column:
    site = F.regexp_extract(url, r"^(?:.*?://)?([^/]*)", 1).isin("linkedin.com", "www.linkedin.com")
    return site & has_any(url, ("/feed/update/", "/posts/"))


def domain_type(url: Column, html: Column) -> Column:
    """Kind of site, by marks in the URL and then in the source."""
    from tidemill.functions.page import SOURCE_KINDS, URL_KINDS

    address, source = F.coalesce(F.lower(url), F.lit("")), F.coalesce(F.lower(html), F.lit(""))
    rules = [(has_any(address, m), k) for k, m in URL_KINDS] + [(has_any(source, m), k) for k, m in SOURCE_KINDS]
    return reduce(lambda c, r: c.when(*r), rules, F.when(F.lit(False), "")).otherwise("generic")


# pages


def is_bot_protected(html: Column, headers: Column | None = None) -> Column:
    """Marks of challenge pages in the source, with the response headers where there are any."""
    text, size = F.lower(html), F.octet_length(html)
    waiting = has_any(text, ("checking your browser", "just a moment"))
    found = has_any(
        text, ("_cf_chl_opt", "aws-waf-client-browser", "awswaf-captcha", "captcha-delivery.com/captcha", "challenge-platform/h/b/orchestrate/",
               "challenge-platform/h/g/orchestrate/", "geo.captcha-delivery.com"),
    )
    found |= waiting & text.contains("cf-spinner")
    found |= has_any(text, ("cf-turnstile", "challenges.cloudflare.com/turnstile")) & (size < 100_000)
    found |= text.contains("interstitial-spinner") & text.contains("verifying your connection") & (size < 10_000)
    found |= text.contains("hcaptcha.com") & text.contains("h-captcha") & (size < 50_000)
    if headers is not None:
        names = F.transform(F.map_keys(headers), F.lower)
        has = lambda name: F.coalesce(F.array_contains(names, name), F.lit(False))
        found |= has("cf-mitigated") | has("cf-ray") & waiting
    return F.coalesce(found, F.lit(False))


def needs_js(words: Column, html: Column) -> Column:
    size, scripts = F.octet_length(html), html.contains("<script")
    thin = (words < 50) & (size > 5_000) & scripts
    app = (words < 800) & (size > 50_000) & scripts & has_any(F.lower(html), APP_MARKS)
    return F.coalesce(thin | app, F.lit(False))


def is_challenge(html: Column) -> Column:
    text, size = F.lower(html), F.octet_length(html)
    found = text.contains("<title>challenge page</title>") | text.contains("bazadebezolkohpepadr") & (size < 5_000)
    return F.coalesce(size.between(1, 15_000) & found, F.lit(False))


def empty_reason(url: Column, title: Column, words: Column, markdown: Column, n_links: Column) -> Column:
    """Why a page came out empty: consent_wall, antibot, js_required or none."""
    lower = F.coalesce(F.lower(title), F.lit(""))
    consent = F.coalesce(has_any(F.lower(url), CONSENT_URLS), F.lit(False)) | (words <= 50) & starts_any(lower, CONSENT_TITLES)
    return (
        F.when(consent, "consent_wall").when((words > 50) | (markdown != ""), "none").when(starts_any(lower, CHALLENGE_TITLES), "antibot")
        .when((words == 0) & (n_links == 0), "js_required").otherwise("none")
    )


def is_retryable_status(status: Column) -> Column:
    return status.isin(429, 502, 503, 504, 520, 521, 522, 523, 524)


def is_ad_class(value: Column) -> Column:
    def ad(token: Column) -> Column:
        return (token == "ad") | token.startswith("ad-") | token.startswith("ad_") | token.endswith("-ad") | token.endswith("_ad")

    return F.exists(F.split(value, r"(?U)\s+"), ad)


# text


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


_CJK = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}\x{3400}-\x{4DBF}]"


def approx_tokens(text: Column) -> Column:
    """A fourth of the characters, or half where over 30 % are Chinese, Japanese or Korean; rounded up. None of an empty text."""
    n = F.length(text)
    cjk = n - F.length(F.regexp_replace(text, _CJK, ""))
    return F.when(F.try_divide(cjk, n) > 0.3, F.ceil(n / 2)).otherwise(F.ceil(n / 4)).cast("long")


def fingerprint(text: Column) -> Column:
    """Letters and digits in lower case, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), r"[^\p{L}\p{N}\p{IsAlphabetic} ]", "")
    return F.trim(F.regexp_replace(bare, " +", " "))


def prefix_fingerprint(fingerprint: Column, words: int = 10) -> Column:
    """Its first words; null if there are fewer."""
    parts = F.split(fingerprint, " ")
    return F.when(F.size(parts) >= words, F.array_join(F.slice(parts, 1, words), " "))


def matches_fact(text: Column, fact: Column) -> Column:
    """A single ASCII word as a word, anything else as it stands; case ignored."""
    low, want = F.lower(text), F.lower(fact)
    word = F.regexp_like(low, F.concat(F.lit("(?<![A-Za-z0-9])"), want, F.lit("(?![A-Za-z0-9])")))
    return F.when(want == "", False).when(want.rlike(r"^[a-z][a-z0-9]*\z"), word).otherwise(low.contains(want))


def strip_thinking(text: Column) -> Column:
    """Without thought blocks, an open one to the end, and stray closing marks."""
    bare = F.regexp_replace(text, r"(?s)<think>.*?(?:</think>|\z)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "</think>", ""), "/think", ""))


def json_reply(text: Column) -> Column:
    """The JSON of a model's reply, without thought and code fence; null if it isn't any."""
    bare = strip_thinking(text)
    inner = F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, r"^```(?:json)?", ""), r"```\z", "")).otherwise(bare)
    inner = F.trim(inner)
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


_ENTITY_ORDER = (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("mdash", "—"), ("ndash", "–"), ("laquo", "«"), ("raquo", "»"), ("copy", "©"), ("reg", "®"), ("trade", "™"), ("hellip", "…"), ("bull", "•"), ("amp", "&"))


def decode_named_entities(text: Column) -> Column:
    """Named entities only, each once: the ampersand is last, so what it makes is not decoded again."""
    return reduce(lambda c, e: F.replace(c, F.lit(f"&{e[0]};"), F.lit(e[1])), _ENTITY_ORDER, text)


def strip_invisible(text: Column) -> Column:
    from tidemill.functions.cleanup import INVISIBLE

    return F.translate(text, INVISIBLE, "")


def robots_sitemaps(text: Column) -> Column:
    """Sitemap URLs of a robots file, in order."""
    found = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_extract(x, r"(?i)^\s*sitemap\s*:\s*([^#]*?://[^#]*?)\s*(?:#.*)?$", 1))
    return F.filter(found, lambda x: x != "")


def document_kind(mime: Column, url: Column) -> Column:
    """docx, xlsx, xls or csv by content type, then by the end of the path; else null."""
    kind = F.trim(F.lower(F.regexp_extract(mime, r"^([^;]*)", 1)))
    ending = F.regexp_extract(F.lower(F.regexp_extract(url, r"^([^?]*)", 1)), r"\.([a-z]+)$", 1)
    return (
        F.when(kind == "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx")
        .when(kind == "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx").when(kind == "application/vnd.ms-excel", "xls")
        .when(kind == "text/csv", "csv").when(ending.isin("csv", "docx", "xls", "xlsx"), ending)
    )
