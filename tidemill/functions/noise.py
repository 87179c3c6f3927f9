"""Which elements are page furniture, and which text is leaked style classes."""

from __future__ import annotations

from functools import lru_cache

from tidemill.functions.text import size
from tidemill.functions.tree import Node

TAGS = frozenset("aside audio canvas footer header iframe nav noscript script style svg video".split())
ROLES = frozenset("banner complementary contentinfo navigation".split())
CLASSES = frozenset(
    "ad ads advert alert bottom breadcrumb breadcrumbs cookie footer header lang-selector language login-form menu modal navbar "
    "navigation newsletter notification overlay pager pagination popup recommended related-posts search-form share sidebar "
    "signup skip-link social social-links social-media sr-only subscribe toast top visually-hidden widget".split()
)
IDS = frozenset(
    "ad breadcrumbs comments cookie footer header menu modal nav newsletter popup recommended related share sidebar social "
    "subscribe widget".split()
)
FORM_CLASSES = tuple("contact login newsletter search signup subscribe".split())
#: Consent banners: an id that begins so, or a class attribute that has it anywhere. Only lower case can match.
CONSENT = tuple("cc- cmp- consent- cookie-law cookiebot evidon gdpr onetrust optanon ot-sdk qc-cmp sp_message trustarc".split())
STRUCTURAL = tuple("app container mount portal root wrapper".split())
#: Furniture by class or id with more text than this is content after all.
LARGE, SMALL_FORM = 5000, 500

_FUZZY_WHOLE = tuple("alert bottom cookie footer header menu modal nav navbar pager popup share side signup social toast top widget".split())
_FUZZY_PART = tuple(
    "advert advertisement breadcrumb breadcrumbs comment lang-selector language login-form navigation newsletter notification "
    "pagination recommended related-posts search-form sidebar skip-link social-links social-media sr-only subscribe visually-hidden".split()
)
_FUZZY_HEAD = ("banner", "overlay")
_UTILITY = tuple(
    "bg- border- bottom- col- decoration- delay- divide- duration- ease- flex- font- gap- grid- h- inset- leading- left- m- max- "
    "mb- min- ml- mr- mt- mx- my- opacity- origin- outline- overflow- p- pb- pl- pr- pt- px- py- right- ring- rotate- rounded- "
    "row- scale- shadow- space- text- top- tracking- transition- translate- w- z-".split()
)
_STYLE_HEADS = (*_UTILITY, *"2xl- active- dark- disabled- focus- group- hover- lg- md- not- peer- placeholder- sm- sr- xl-".split())
_STYLE_WORDS = frozenset(
    "absolute antialiased block capitalize container fixed flex grid hidden inline invisible isolate italic lowercase "
    "not-sr-only overline prose relative sr-only static sticky truncate underline uppercase visible".split()
)


def is_ad_class(value: str) -> bool:
    return any(t == "ad" or t.startswith(("ad-", "ad_")) or t.endswith(("-ad", "_ad")) for t in value.split())


def is_noise(node: Node) -> bool:
    tag = node.tag
    if tag in ("body", "html"):
        return False
    if tag in TAGS:
        return True
    classes = node.attrs.get("class")
    if tag == "form":
        return size(node.text) < SMALL_FORM or classes is not None and any(c in classes.lower() for c in FORM_CLASSES)
    if not node.attrs:
        return False
    if node.attrs.get("role") in ROLES:
        return True
    if classes is not None:
        tokens = classes.lower().split()
        if any(t in CLASSES or t.startswith(("footer", "header-", "nav-")) for t in tokens) or is_ad_class(classes):
            return size(node.text) <= LARGE
    name = node.attrs.get("id")
    if name is not None:
        name = name.lower()
        if name in IDS and not any(s in name for s in STRUCTURAL):
            return size(node.text) <= LARGE
        if name.startswith(CONSENT):
            return True
    return classes is not None and any(c in classes.lower() for c in CONSENT)


class NoiseMap:
    """is_noise of nodes and of their ancestors, each worked out once."""

    def __init__(self) -> None:
        self._own: dict[int, bool] = {}
        self._path: dict[int, bool] = {}

    def own(self, node: Node) -> bool:
        got = self._own.get(node.index)
        if got is None:
            got = self._own[node.index] = is_noise(node)
        return got

    def on_path(self, node: Node) -> bool:
        """Whether the node or anything above it is noise."""
        todo = []
        at: Node | None = node
        known = False
        while at is not None and at.tag != "#document":
            got = self._path.get(at.index)
            if got is not None:
                known = got
                break
            todo.append(at)
            at = at.parent
        for n in reversed(todo):
            known = known or self.own(n)
            self._path[n.index] = known
        return known


def is_noise_token(token: str) -> bool:
    """Whether a class name names furniture, style utilities aside. Not used by extraction."""
    token = token.lower()
    if "[--" in token or "var(" in token:
        return False
    core = token.rpartition(":")[2]
    if core.startswith(_UTILITY):
        return False
    if any(core == h or core.startswith((f"{h}-", f"{h}_")) for h in _FUZZY_HEAD):
        return True
    padded = "-" + core.replace("_", "-") + "-"
    return any(f"-{p}-" in padded for p in _FUZZY_WHOLE) or any(p in core for p in _FUZZY_PART)


def has_noise_class(value: str) -> bool:
    return any(map(is_noise_token, value.split())) or is_ad_class(value)


@lru_cache(maxsize=1 << 16)
def is_style_word(word: str) -> bool:
    core = word.rpartition(":")[2].lower()
    if "[" in core and "]" in core or core in _STYLE_WORDS or core.startswith(_STYLE_HEADS):
        return True
    return core.startswith("-") and core[1:].startswith(_STYLE_HEADS)


def is_style_text(text: str) -> bool:
    words = text.split()
    return len(words) >= 3 and 2 * sum(map(is_style_word, words)) > len(words)
