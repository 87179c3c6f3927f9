"""URL parsing and joining as browsers do it: the parts of the URL standard that stored pages need."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_FORBIDDEN = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")


def _encoder(extra: str):
    keep = {c for c in map(chr, range(0x21, 0x7F)) if c not in extra}
    cache: dict[str, str] = {}

    def encode(text: str) -> str:
        if text.isascii() and keep.issuperset(text):
            return text
        out = cache.get(text)
        if out is None:
            out = "".join(c if c in keep else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)
            if len(cache) < 10_000:
                cache[text] = out
        return out

    return encode


_fragment = _encoder('"<>`')
_query = _encoder("\"#<>'")
_plain_query = _encoder('"#<>')
_path = _encoder('"#<>?`{}^')
_opaque = _encoder("")
_user = _encoder("\"#<>?`{}^/:;=@[\\]|")


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str | None
    host: str | None
    port: int | None
    path: str
    query: str | None
    fragment: str | None

    @property
    def authority(self) -> str:
        return (self.user + "@" if self.user else "") + (self.host or "") + (f":{self.port}" if self.port is not None else "")

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host or ''}" + (f":{self.port}" if self.port is not None else "")

    def __str__(self) -> str:
        out = f"{self.scheme}:" + (f"//{self.authority}" if self.host is not None else "") + self.path
        return out + (f"?{self.query}" if self.query is not None else "") + (f"#{self.fragment}" if self.fragment is not None else "")


def _number(text: str) -> int | None:
    try:
        if text[:2] in ("0x", "0X"):
            return int(text[2:] or "0", 16)
        return int(text, 8) if len(text) > 1 and text[0] == "0" else int(text)
    except ValueError:
        return None


def _host(raw: str) -> str | None:
    if raw.startswith("["):
        import ipaddress

        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") else None
        except ValueError:
            return None
    try:
        name = unquote_to_bytes(raw).decode("utf-8") if "%" in raw else raw
        if not name.isascii():
            name = name.lower().encode("idna").decode()
    except (UnicodeError, ValueError):
        return None
    name = name.lower()
    if not name or _FORBIDDEN.search(name):
        return None
    parts = name.rstrip(".").split(".") if name.endswith(".") else name.split(".")
    last = parts[-1]
    if last.isdigit() or re.fullmatch(r"0x[0-9a-f]*", last):
        numbers = [_number(p) for p in parts]
        if len(numbers) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
            return None
        value = sum(n << (8 * (3 - k)) for k, n in enumerate(numbers[:-1])) + numbers[-1]
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    return name


def _dots(path: str, special: bool) -> str:
    out: list[str] = []
    parts = (path.replace("\\", "/") if special else path).split("/")[1:]
    for k, part in enumerate(parts):
        plain, last = part.lower().replace("%2e", "."), k == len(parts) - 1
        if plain == "..":
            del out[-1:]
        if plain in (".", ".."):
            if last:
                out.append("")
        else:
            out.append(_path(part))
    return "/" + "/".join(out)


_BLANKS = "".join(map(chr, range(0x21)))


def parse(text: str, base: Url | None = None) -> Url | None:
    """The URL, resolved against base; None where the standard fails."""
    text = text.strip(_BLANKS).replace("\t", "").replace("\n", "").replace("\r", "")
    m = _SCHEME.match(text)
    scheme, rest = (m[1].lower(), text[m.end() :]) if m else (None, text)
    rest, mark, fragment = rest.partition("#")
    fragment = _fragment(fragment) if mark else None
    if scheme is None or base and scheme == base.scheme and scheme in _PORTS and not rest.replace("\\", "/").startswith("/"):
        if base is None or base.host is None and not base.path.startswith("/"):
            return base and not rest and fragment is not None and Url(base.scheme, None, None, None, base.path, base.query, fragment) or None
        return _relative(rest, fragment, base)
    special = scheme in _PORTS
    rest, mark, query = rest.partition("?")
    query = (_query if special else _plain_query)(query) if mark else None
    if special:
        rest = rest.replace("\\", "/")
    if special and scheme != "file":
        rest = "//" + rest.lstrip("/")
    if not rest.startswith("//"):
        path = _dots(rest, special) if rest.startswith("/") else _opaque(rest)
        return Url(scheme, None, "" if scheme == "file" else None, None, path, query, fragment)
    authority, _, path = rest[2:].partition("/")
    path = "/" + path if len(authority) < len(rest) - 2 else ""
    user, _, place = authority.rpartition("@")
    host, _, port = place.rpartition(":") if re.search(r":\d*$", place) and not place.endswith("]") else (place, "", "")
    if special and scheme != "file" or host:
        name = _host(host) if special else host
        if name is None:
            return None
    else:
        name = ""
    if port and int(port) > 65535 or ":" in host and not host.startswith("["):
        return None
    number = int(port) if port and int(port) != _PORTS.get(scheme) else None
    path = _dots(path or "/", special) if special or path else ""
    return Url(scheme, ":".join(map(_user, user.split(":", 1))) if user else None, name, number, path, query, fragment)


def _relative(rest: str, fragment: str | None, base: Url) -> Url | None:
    special = base.scheme in _PORTS
    if special:
        head, mark, tail = rest.partition("?")
        rest = head.replace("\\", "/") + mark + tail
    if rest.startswith("//"):
        return parse(f"{base.scheme}:{rest}" + (f"#{fragment}" if fragment is not None else ""))
    path, mark, query = rest.partition("?")
    query = (_query if special else _plain_query)(query) if mark else None
    if not path:
        return Url(base.scheme, base.user, base.host, base.port, base.path, query if mark else base.query, fragment)
    if not path.startswith("/"):
        path = base.path.rpartition("/")[0] + "/" + path
    return Url(base.scheme, base.user, base.host, base.port, _dots(path, special), query, fragment)
