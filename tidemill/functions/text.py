"""Line and length conventions shared by the page functions: lengths are of UTF-8 bytes, lines end at \\n alone."""

from __future__ import annotations


def size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def lines(text: str) -> list[str]:
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def squeeze(text: str) -> str:
    return " ".join(text.split())


def word_count(text: str) -> int:
    return len(text.split())
