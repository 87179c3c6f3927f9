"""API addresses in page scripts."""

from __future__ import annotations

import re
from typing import Any

from tidemill.functions.tree import parse
from tidemill.functions.urls import SUFFIXES
from tidemill.functions.whatwg import parse as parse_url

MOST_BYTES, MOST_ENDPOINTS, MOST_SCRIPTS = 8 << 20, 2000, 40
KINDS = ("relative_path", "absolute_url", "graph_ql", "web_socket")
_PLAIN = r"[A-Za-z0-9_\-./]{0,200}"
_RELATIVE = re.compile(rf"[\"'`](/{_PLAIN}?(?:api|discovery|g(?:raph)?ql|/gateway|/internal|/rest|/v[0-9]){_PLAIN})[\"'`]")
_HOST, _STEPS = r"[-.0-9A-Za-z]{1,253}", r"[-./0-9A-Za-z_%]"
_SOCKET = re.compile(f"wss?://{_HOST}(?:/{_STEPS}{{0,256}})?")
_ABSOLUTE = re.compile(f"https?://{_HOST}(?:/{_STEPS}{{0,400}})?")
_FILES = tuple(".css .jpg .js .png .svg .woff2".split())
_NOISE = frozenset("example.com example.net example.org json-schema.org localhost schema.org w3.org".split())


def registrable(host: str) -> str:
    host = host.rstrip(".").lower()
    labels = host.split(".")
    return ".".join(labels[-3:]) if ".".join(labels[-2:]) in SUFFIXES else ".".join(labels[-2:])


def is_host(host: str) -> bool:
    labels = host.rstrip(".").split(".")
    return len(labels) >= 2 and all(labels) and re.fullmatch(r"[A-Za-z]{2,}", labels[-1]) is not None


def script_sources(html: str, url: str) -> list[str]:
    base, out = parse_url(url), {}
    for n in parse(html).elements("script"):
        if len(out) >= MOST_SCRIPTS:
            break
        got = parse_url(n.attrs["src"], base) if "src" in n.attrs else None
        if got and got.scheme in ("http", "https"):
            out.setdefault(str(got))
    return list(out)


class _Scan:
    def __init__(self, url: str):
        base = parse_url(url)
        self.site = registrable(base.host) if base and base.host else ""
        self.found: dict[tuple[str, str], tuple[str, bool]] = {}
        self.hosts: set[str] = set()
        self.left, self.truncated = MOST_BYTES, False

    def text(self, text: str, source: str) -> None:
        raw = text.encode()
        if len(raw) > self.left:
            self.truncated = True
            text = raw[: self.left].decode(errors="ignore")
            raw = text.encode()
        self.left -= len(raw)
        matches = [(m[1], "relative_path") for m in _RELATIVE.finditer(text)]
        matches += [(m[0], "web_socket") for m in _SOCKET.finditer(text)]
        matches += [(m[0], "absolute_url") for m in _ABSOLUTE.finditer(text)]
        for value, kind in matches:
            url = parse_url(value)
            if kind == "absolute_url" and value.lower().endswith(_FILES):
                if url and url.host:
                    self.hosts.add(url.host)
                continue
            if len(self.found) >= MOST_ENDPOINTS:
                self.truncated = True
                return
            lower = value if kind == "relative_path" else value.lower()
            if kind != "web_socket" and ("graphql" in lower or "/gql" in lower):
                kind = "graph_ql"
            first = True
            if url is None:
                bare = value.rstrip("/")
                if len(bare) < 4 or bare in ("/api", "/rest"):
                    continue
            else:
                host = url.host or ""
                if not is_host(host) or registrable(host) in _NOISE or url.path in ("", "/"):
                    continue
                self.hosts.add(host)
                first = host == self.site or host.endswith(f".{self.site}")
            self.found.setdefault((value, source), (kind, first))


def report(html: str, url: str, bundles: list[dict[str, str]] | None = None) -> dict[str, Any]:
    """Endpoints of inline scripts and of the given bundles (url, text), in order of kind, value and source; all hosts."""
    scan, scanned = _Scan(url), 0
    scan.text("".join(f"{n.text}\n" for n in parse(html).elements("script") if "src" not in n.attrs), "inline")
    for b in bundles or ():
        if not scan.left:
            scan.truncated = True
            break
        scanned += 1
        scan.text(b["text"] or "", b["url"])
    rows = [{"value": v, "kind": k, "first_party": f, "source": s} for (v, s), (k, f) in scan.found.items()]
    rows.sort(key=lambda r: (KINDS.index(r["kind"]), r["value"], r["source"]))
    return {"endpoints": rows, "hosts": sorted(scan.hosts), "bundles_scanned": scanned, "truncated": scan.truncated}
