"""URL functions as native Column expressions. For URLs in ASCII; whatwg.parse covers the rest of the standard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups: scheme, host, port, path, query with its mark. Also used, as it is, in SQL.
PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:@]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?"
SUFFIXES = tuple("ac.uk co.in co.jp co.kr co.nz co.uk co.za com.au com.br com.cn com.mx com.sg com.tr gov.uk me.uk net.au org.au org.uk".split())
LANGUAGES = {
    "en-GB,en;q=0.9": "ie uk", "es-ES,es;q=0.9": "ar cl co es mx pe", "zh-TW,zh;q=0.9": "hk tw", "de-DE,de;q=0.9": "at de",
} | {f"{tag},{tag[:2]};q=0.9": tld for tld, tag in (x.split("=") for x in (
    "br=pt-BR cn=zh-CN cz=cs-CZ dk=da-DK fi=fi-FI fr=fr-FR gr=el-GR it=it-IT jp=ja-JP kr=ko-KR nl=nl-NL no=nb-NO "
    "pl=pl-PL pt=pt-PT ro=ro-RO ru=ru-RU se=sv-SE tr=tr-TR").split())}  # fmt: skip
DEFAULT_LANGUAGE = "en-US,en;q=0.9"


def part(url: Column, group: int) -> Column:
    """One group of PATTERN, empty where the URL has none."""
    return F.regexp_extract(url, PATTERN, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host; null where there is none."""
    return F.nullif(F.lower(part(url, 2)), F.lit(""))


def port_suffix(url: Column) -> Column:
    """The port with its colon, unless it is the scheme's own."""
    port, kind = part(url, 3), scheme(url)
    own = (port == "") | (kind == "http") & (port == "80") | (kind == "https") & (port == "443")
    return F.when(own, "").otherwise(F.concat(F.lit(":"), port))


def path(url: Column) -> Column:
    p = part(url, 4)
    return F.when(p == "", "/").otherwise(p)


def normalize(url: Column) -> Column:
    """Without fragment, user and own port, host in lower case, one slash off the end of all paths but the root."""
    p = path(url)
    bare = F.when((F.length(p) > 1) & p.endswith("/"), p.substr(F.lit(1), F.length(p) - 1)).otherwise(p)
    return F.when(host(url).isNotNull(), F.concat(scheme(url), F.lit("://"), host(url), port_suffix(url), bare, part(url, 5)))


def without_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def origin_key(url: Column) -> Column:
    return F.when(host(url).isNotNull(), F.concat(scheme(url), F.lit("://"), without_www(host(url)), port_suffix(url)))


def root_domain(url: Column) -> Column:
    """The last two labels, or three if the last but one is of at most three letters."""
    name = without_www(host(url))
    labels = F.split(name, r"\.")
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    return F.when(n <= 2, name).when(F.length(F.try_element_at(labels, F.lit(-2))) <= 3, tail(3)).otherwise(tail(2))


def registrable_domain(name: Column) -> Column:
    """The last two labels of a host, or three after a known double suffix."""
    name = F.regexp_replace(F.lower(name), r"\.+$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    return F.when(n < 2, name).when((n >= 3) & tail(2).isin(*SUFFIXES), tail(3)).otherwise(tail(2))


def accept_language(url: Column) -> Column:
    tld = F.regexp_extract(host(url), r"([^.]*)$", 1)
    rules = ((tld.isin(*tlds.split()), language) for language, tlds in LANGUAGES.items())
    return F.when(host(url).isNotNull(), reduce(lambda c, r: c.when(*r), rules, F.when(F.lit(False), "")).otherwise(DEFAULT_LANGUAGE))


def homepage(url: Column) -> Column:
    return F.when(host(url).isNotNull(), F.concat(scheme(url), F.lit("://"), host(url), port_suffix(url), F.lit("/")))


def old_reddit(url: Column) -> Column:
    """Thread URLs on the host with the old layout."""
    return F.when(
        host(url).isin("reddit.com", "www.reddit.com", "np.reddit.com", "new.reddit.com"),
        F.regexp_replace(url, r"^([A-Za-z]+://)[^/?#]*", "$1old.reddit.com"),
    ).otherwise(url)


def with_scheme(text: Column) -> Column:
    bare = F.trim(text)
    return F.when(bare.contains("://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def looks_truncated(url: Column) -> Column:
    """Ends in &, or has a query without any =."""
    bare = F.trim(url)
    query = F.regexp_extract(bare, r"\?([^#]*)", 1)
    return bare.endswith("&") | bare.contains("?") & ~query.contains("=")


def file_name(url: Column, extension: str) -> Column:
    """Relative name for a page's output: path and query, cleaned; for a root, the host. Equal paths of two hosts collide."""
    segments = F.filter(F.split(part(url, 4), "/"), lambda s: ~s.isin("", ".", ".."))
    stem = F.array_join(segments, "/")
    index = F.concat(F.replace(without_www(F.coalesce(host(url), F.lit(""))), F.lit("."), F.lit("_")), F.lit("/index"))
    query = F.regexp_replace(part(url, 5), r"^\?", "_")
    name = F.regexp_replace(F.concat(F.when(stem == "", index).otherwise(stem), query), r"[^\p{L}\p{N}\-_./]", "_")
    return F.concat(name, F.lit(f".{extension}"))
