"""CSS selectors over the tree: type, class, id and attribute tests, :not, position tests, and all four combinators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from tidemill.functions.tree import Node

Test = Callable[[Node], bool]
_NAME = r"-?(?:[_a-zA-Z]|[^\x00-\x7f]|\\.)(?:[-_a-zA-Z0-9]|[^\x00-\x7f]|\\.)*"
_PART = re.compile(
    rf"(?P<type>\*|{_NAME})|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*"
    rf"(?P<value>\"[^\"]*\"|'[^']*'|{_NAME})\s*(?P<flag>[iIsS])?\s*)?\]|:(?P<pseudo>{_NAME})(?:\((?P<arg>[^()]*)\))?"
)
_JOIN = re.compile(r"\s*([>+~])\s*|\s+")


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Test:
    name = name.lower()

    def test(node: Node) -> bool:
        got = node.attrs.get(name)
        if got is None or op is None:
            return got is not None
        want = value
        if fold:
            got, want = got.lower(), want.lower()
        if op == "=":
            return got == want
        if op == "~=":
            return bool(want) and want in got.split()
        if op == "|=":
            return got == want or got.startswith(want + "-")
        return bool(want) and {"^=": got.startswith, "$=": got.endswith, "*=": got.__contains__}[op](want)

    return test


def _siblings(node: Node) -> list[Node]:
    return [n for n in node.parent.children if n.tag] if node.parent else [node]


def _nth(arg: str) -> Callable[[int], bool]:
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.strip().lower(), arg.replace(" ", "").lower())
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not m or not arg:
        raise ValueError(arg)
    step = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    start = int(m[2] or 0)
    return lambda k: k == start if step == 0 else (k - start) % step == 0 and (k - start) // step >= 0


def _pseudo(name: str, arg: str | None) -> Test:
    if name == "not" and arg is not None:
        inner = compile_selector(arg)
        return lambda n: not matches(n, inner)
    if name in ("is", "where") and arg is not None:
        inner = compile_selector(arg)
        return lambda n: matches(n, inner)
    simple: dict[str, Test] = {
        "first-child": lambda n: _siblings(n)[0] is n,
        "last-child": lambda n: _siblings(n)[-1] is n,
        "only-child": lambda n: len(_siblings(n)) == 1,
        "first-of-type": lambda n: next(s for s in _siblings(n) if s.tag == n.tag) is n,
        "last-of-type": lambda n: [s for s in _siblings(n) if s.tag == n.tag][-1] is n,
        "empty": lambda n: not any(c.tag or c.data for c in n.children),
        "root": lambda n: n.tag == "html",
    }
    if name in simple and arg is None:
        return simple[name]
    if name == "nth-child" and arg is not None:
        nth = _nth(arg)
        return lambda n: nth(_siblings(n).index(n) + 1)
    raise ValueError(name)


def _compound(text: str, at: int) -> tuple[list[Test], int]:
    tests: list[Test] = []
    while m := _PART.match(text, at):
        if m["type"]:
            if tests:
                raise ValueError(text)
            if m["type"] != "*":
                tag = m["type"].lower()
                tests.append(lambda n, tag=tag: n.tag == tag)
            else:
                tests.append(lambda n: True)
        elif m["id"]:
            tests.append(lambda n, v=m["id"].replace("\\", ""): n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=m["cls"].replace("\\", ""): v in n.attrs.get("class", "").split())
        elif m["attr"]:
            value = m["value"] or ""
            tests.append(_attribute(m["attr"], m["op"], value[1:-1] if value[:1] in "\"'" and value else value, (m["flag"] or "").lower() == "i"))
        else:
            tests.append(_pseudo(m["pseudo"].lower(), m["arg"]))
        at = m.end()
    if not tests:
        raise ValueError(text)
    return tests, at


@lru_cache(maxsize=512)
def compile_selector(text: str) -> tuple[tuple[tuple[str, tuple[Test, ...]], ...], ...]:
    """Alternatives, each a chain of (combinator to the left, tests) from left to right. ValueError if it isn't one."""
    chains, at, text = [], 0, text.strip()
    while True:
        chain = []
        join = ""
        while True:
            tests, at = _compound(text, at)
            chain.append((join, tuple(tests)))
            stop = re.compile(r"\s*(,|$)").match(text, at)
            if stop:
                at = stop.end()
                break
            m = _JOIN.match(text, at)
            if not m:
                raise ValueError(text)
            join, at = m[1] or " ", m.end()
        chains.append(tuple(chain))
        if stop[1] != ",":
            return tuple(chains)
        at += len(text[at:]) - len(text[at:].lstrip())


def _chain(node: Node, chain, k: int) -> bool:
    join, tests = chain[k]
    if not all(t(node) for t in tests):
        return False
    if k == 0:
        return True
    if join in "+~":
        before = _siblings(node)
        before = before[: before.index(node)]
        return any(_chain(n, chain, k - 1) for n in (before[-1:] if join == "+" else before))
    if join == ">":
        return node.parent is not None and node.parent.tag != "#document" and _chain(node.parent, chain, k - 1)
    return any(_chain(n, chain, k - 1) for n in node.ancestors())


def matches(node: Node, compiled) -> bool:
    return any(_chain(node, chain, len(chain) - 1) for chain in compiled)


def select(root: Node, text: str) -> Iterator[Node]:
    """Elements below root that the selector matches, in document order; none if the selector is invalid."""
    try:
        compiled = compile_selector(text)
    except ValueError:
        return iter(())
    return (n for n in root.elements() if matches(n, compiled))
