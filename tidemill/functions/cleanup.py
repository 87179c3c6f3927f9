"""The text pipeline that makes extracted markdown compact: entities, chrome, images, links and repeats.

Each step takes and gives markdown; STEPS has them in their order, which matters. Lengths are bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from tidemill.functions.noise import is_style_text, is_style_word
from tidemill.functions.text import lines, size

_ENTITIES = {
    "amp": "&", "apos": "'", "bull": "•", "copy": "©", "gt": ">", "hellip": "…", "laquo": "«", "lt": "<",
    "mdash": "—", "nbsp": " ", "ndash": "–", "quot": '"', "raquo": "»", "reg": "®", "trade": "™",
}
_FORMS = "#[xX][0-9a-fA-F]+", "#[0-9]+", "[a-zA-Z]+"
_ENTITY = re.compile(f"&({'|'.join(_FORMS)});")
INVISIBLE = "͏­​‌‍‎‏⁠⁢⁣⁤﻿"


def decode_entities(text: str) -> str:
    def one(m: re.Match[str]) -> str:
        name = m[1]
        if name[0] != "#":
            return _ENTITIES.get(name, m[0])
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


_INVISIBLE = re.compile(f"[{INVISIBLE}]")


def strip_invisible(text: str) -> str:
    return text if text.isascii() else _INVISIBLE.sub("", text)


def _fenced(text: str, change: Callable[[str], str | None], lead: Callable[[str], str] = str.strip) -> list[str]:
    """Lines changed outside code fences; None drops one."""
    out, inside = [], False
    for line in lines(text):
        fence = lead(line).startswith("```")
        inside ^= fence
        new = line if fence or inside else change(line)
        if new is not None:
            out.append(new)
    return out


def _closed(out: list[str], text: str) -> str:
    """Lines as text that ends in a line break if the text did."""
    return "\n".join(out) + ("\n" if out and text.endswith("\n") else "")


def _grown(out: list[str]) -> str:
    """Lines joined, those empty before the first other left out."""
    k = next((k for k, x in enumerate(out) if x), len(out))
    return "\n".join(out[k:])


def _ended(out: list[str]) -> str:
    return "".join(f"{x}\n" for x in out)


def strip_leaked_scripts(text: str) -> str:
    def cut(line: str) -> str:
        return line[: line.find("self.__")].rstrip() if re.search(r"self\.__\w", line) else line

    return _grown(_fenced(text, cut))


OPENS = "|".join(f"opens {what}" for what in ("(?:in )?" + "(?:a )?new (?:tab|window)", "external (?:link|website)"))
EXTERNAL, STOP = "external link", r"\b\.?"
_ANY = f"(?:{OPENS}|{EXTERNAL})"
_CHROME = re.compile(rf"\s*,\s*{_ANY}{STOP}|\s+\({_ANY}\)\.?|\s+{EXTERNAL}{STOP}$", re.I)


def strip_link_chrome(text: str) -> str:
    lower = text.lower()
    if "opens" not in lower and "external" not in lower:
        return "\n".join(lines(text))
    return "\n".join(_fenced(text, lambda line: _CHROME.sub("", line)))


_SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}+(?!\S)")


def collapse_spaced(text: str) -> str:
    """Words spelled with spaces between their letters."""

    def one(m: re.Match[str]) -> str:
        letters = m[0][::2]
        return "".join(f" {c}" if k and c.isupper() and letters[k - 1].islower() else c for k, c in enumerate(letters))

    def change(line: str) -> str:
        bare = line.strip()
        return line if not bare else bare if len(bare) < 7 else _SPACED.sub(one, bare)

    return _closed(_fenced(text, change), text)


LABEL, _TARGET = r"\[([^\]]*)\]", r"\([^)]+\)"
_TAKEN_TARGET = r"\(([^)]+)\)"
_LINKED_IMAGE = re.compile(rf"\[!{LABEL}{_TARGET}\]{_TAKEN_TARGET}")
_IMAGE_LINE = re.compile(rf"!{LABEL}{_TARGET}\s*")
_IMAGE = re.compile(f"!{LABEL}{_TARGET}")
_EMPTY_LINK = re.compile(rf"\[\s*\]{_TARGET}")


def link_linked_images(text: str) -> str:
    return _LINKED_IMAGE.sub(r"[\1](\2)" + "\n", text)


def collapse_logos(text: str) -> str:
    """Runs of image lines become one list of their descriptions; a single one stays only if it says much."""
    rows, out, k = lines(text), [], 0
    while k < len(rows):
        if not _IMAGE_LINE.fullmatch(rows[k].strip()):
            out.append(rows[k])
            k += 1
            continue
        begin, alts = k, []
        while k < len(rows) and (not rows[k].strip() or _IMAGE_LINE.fullmatch(rows[k].strip())):
            m = _IMAGE_LINE.fullmatch(rows[k].strip())
            if m and m[1].strip():
                alts.append(m[1].strip())
            k += 1
        n = len(alts) or k - begin
        if alts and (n >= 2 or size(alts[0]) > 30):
            out.append(", ".join(alts))
    return _ended(out)


def strip_images(text: str) -> str:
    out = []
    for line in lines(text):
        found = [m.strip() for m in _IMAGE.findall(line)]
        if len(found) < 2:
            out.append(_IMAGE.sub(lambda m: alt if size(alt := m[1].strip()) > 30 and not is_asset_label(alt) else "", line))
            continue
        alts = [a for a in found if a not in ("", '""') and not is_asset_label(a)]
        rest = _EMPTY_LINK.sub("", _IMAGE.sub("", line)).strip()
        short = [a for a in alts if size(a) <= 30]
        out += ([rest] if rest else []) + ([", ".join(short)] if short else []) + [a for a in alts if size(a) > 30]
    return _ended(out)


_PICTURES = tuple(".avif .bmp .gif .ico .jpeg .jpg .png .svg .webp".split())


def strip_image_names(text: str) -> str:
    def is_name(line: str) -> bool:
        return bool(line) and not line.startswith(("#", "- ", "* ", "```", "> ")) and " " not in line and line.lower().endswith(_PICTURES)

    return _ended([x for x in lines(text) if not is_name(x.strip())])


_NO_STAR, _NO_LINE = "([^*]+)", "([^_]+)"
_BOLD, _STAR, _UNDER = re.compile(rf"\*\*{_NO_STAR}\*\*|__{_NO_LINE}__"), re.compile(rf"\*{_NO_STAR}\*"), re.compile(rf"\b_{_NO_LINE}_\b")


def strip_emphasis(text: str) -> str:
    def change(line: str) -> str:
        return _UNDER.sub(r"\1", _STAR.sub(r"\1", _BOLD.sub(lambda m: m[1] or m[2], line)))

    return _closed(_fenced(text, change, str.lstrip), text)


_DESCRIBED = tuple(
    f"{x} "
    for x in "a diagram,a graphic,a image of,a photo of,a rendering,a screenshot,an animation,an illustration,an image of,animation of,"
    "illustration,illustration of,image of,interactive animation of,photo of,picture of,screenshot of".split(",")
)


_NAME_ENDS = tuple(f"{x})" for x in _PICTURES if x not in (".bmp", ".ico"))


def is_description(line: str) -> bool:
    """Left-over image descriptions: by their first words, broken references, avatars, rows of one brand."""
    if not line:
        return False
    lower = line.lower()
    if lower.startswith(_DESCRIBED) and len(line.split()) >= 4:
        return True
    if line.endswith(_NAME_ENDS) and all(any(w.endswith(h) and size(w) <= len(h) + 5 for h in _NAME_ENDS) for w in line.split()):
        return True
    if lower.count("twitter image") >= 3 or lower.count("avatar") >= 2 and sum(w.startswith("@") for w in line.split()) >= 3:
        return True
    return is_brand_row(line)


def is_brand_row(line: str) -> bool:
    if line.count(",") < 3:
        return False
    many = [x.split() for x in line.split(",") if len(x.split()) >= 2]
    if len(many) < 4:
        return False
    return 2 * max(Counter(x[0] for x in many).values()) > len(many)


def strip_descriptions(text: str) -> str:
    out, inside = [], False
    for line in lines(text):
        bare = line.strip()
        inside ^= bare.startswith("```")
        if inside or bare.startswith(("#", "-", ">")) or not is_description(bare):
            out.append(line)
    return "\n".join(out)


CONTROLS = frozenset(
    "arrow_back arrow_downward arrow_drop_down arrow_drop_up arrow_forward arrow_left arrow_right arrow_upward chevron_left "
    "chevron_right close close_fullscreen expand_less expand_more first_page fullscreen fullscreen_exit last_page menu more_horiz "
    "more_vert navigate_before navigate_next newer next older open_in_full open_in_new prev previous search share unfold_less "
    "unfold_more « » ‹ › ← ↑ → ↓ ▶ ▸ ▾ ◀ ⏵ ⤓".split()
)


def is_short_number(word: str) -> bool:
    return len(word) < 5 and word.isascii() and word.isdigit()


def is_control(line: str) -> bool:
    bare = line.strip()
    if "your browser does not support" in bare.lower():
        return True
    if len(bare) > 120 or size(bare) > 120:
        return False
    named = False
    for w in bare.split():
        if not is_short_number(w):
            named = True
            if (w.lower() if w.isascii() else w) not in CONTROLS:
                return False
    return named


def strip_controls(text: str) -> str:
    return "\n".join(x for x in lines(text) if not is_control(x))


_LONG = tuple(
    f"{x} "
    for x in "a diagram,a graphic,a photo,a picture,a rendering,a screenshot,an animation,an icon,an illustration,an image,"
    "this element contains,this image depicts,this image shows".split(",")
)
_SENTENCE = r"[^.]*\."
_ELEMENT = re.compile(rf"This element contains {_SENTENCE}{_SENTENCE}(?:\s*{_SENTENCE})*")


def is_long_description(line: str) -> bool:
    bare = line.strip()
    return size(bare) >= 80 and not bare.startswith(("#", "-", ">")) and bare.lower().startswith(_LONG)


def strip_long_descriptions(text: str) -> str:
    return _grown([_ELEMENT.sub("", x).rstrip() for x in lines(text) if not is_long_description(x)])


_RULES = re.compile(r"@(?:font-face|keyframes|layer|media|supports)\s*" + r"[^{]*\{" + r"[^}]*\}?")


def is_style_line(bare: str) -> bool:
    return size(bare) > 10 and all(c in bare for c in "{}:") and " " not in bare and bare[0] != "#"


def strip_styles(text: str) -> str:
    return _grown([_RULES.sub("", x).rstrip() for x in lines(text) if not is_style_line(x.strip())])


PROSE = frozenset(
    "a about also an and are as at be been being but by can did do does for from had has have if in into is it its more no not of "
    "on or our so than that the then these they this to was we were will with you your".split()
)


def dump_start(words: list[str]) -> int | None:
    """Where a list without function words begins that hardly any follow."""
    if len(words) < 25:
        return None
    prose = [w.lower() in PROSE for w in words]
    left = [0] * (len(words) + 1)
    for k in range(len(words) - 1, -1, -1):
        left[k] = left[k + 1] + prose[k]
    run = 0
    for k, p in enumerate(prose):
        run = 0 if p else run + 1
        begin = k - 14
        if run >= 15 and left[begin] / (len(words) - begin) < 0.05:
            return begin
    return None


def collapse_word_lists(text: str) -> str:
    def change(line: str) -> str:
        bare = line.strip()
        words = bare.split()
        if size(bare) < 200 or bare.startswith(("#", "-", ">", "|", "```")) or len(words) < 20:
            return line
        begin = dump_start(words)
        if begin is None or len(words) - begin <= 20:
            return line
        return " ".join(words[:begin]) if begin else f"{' '.join(words[:3])} ... and {len(words) - 3} more"

    return _grown([change(x) for x in lines(text)])


def drop_learn_more(text: str) -> str:
    """A call to learn more that repeats the line before it."""
    rows = lines(text)
    if len(rows) < 3:
        return text
    out, skip = [], False
    for k, line in enumerate(rows):
        if skip:
            skip = False
            continue
        m = re.match(r"(?:Learn|LEARN|learn) (?:more|MORE)", rows[k + 1].strip()) if k + 1 < len(rows) else None
        if m and m[0] in ("Learn more", "LEARN MORE", "learn more"):
            rest = rows[k + 1].strip()[m.end() :].strip().lstrip("*").strip()
            skip = size(rest) > 15 and rest in line.strip()
        out.append(line)
    return _grown(out)


_LINK = re.compile(LABEL + _TAKEN_TARGET)
_ACTIONS = frozenset("favorite flag hide more next prev previous reply unflag vouch yesterday".split()) | {"just now"}
_NOISE_TARGETS = tuple("#comment-stream #comments #disqus /flag?id= /from?site= /hide?id= /user?id=".split())


def is_noise_link(text: str, href: str) -> bool:
    lower = text.lower()
    if lower in _ACTIONS or lower.endswith(" ago") or is_short_number(text):
        return True
    return size(text) == 1 and not text.isalnum() or any(t in href for t in _NOISE_TARGETS)


def take_links(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with links as their text, and the links worth keeping, the first of each target."""
    found: dict[str, str] = {}

    def one(m: re.Match[str]) -> str:
        label, href = m[1].strip(), m[2].strip()
        if label and href and not href.startswith(("#", "javascript:")) and not is_noise_link(label, href):
            found.setdefault(href, label)
        return label

    text = _LINK.sub(one, text)
    return text, [(label, href) for href, label in found.items()]


def strip_lone_numbers(text: str) -> str:
    rows, out, inside = lines(text), [], False
    for k, line in enumerate(rows):
        bare = line.strip()
        fence = bare.startswith("```")
        inside ^= fence
        lone = (k == 0 or not rows[k - 1].strip()) and (k + 1 == len(rows) or not rows[k + 1].strip())
        if fence or inside or not (is_short_number(bare) and lone):
            out.append(line)
    return "\n".join(out)


def long_cycle(words: list[str]) -> str | None:
    """A long line that repeats itself, with one copy left; None if it doesn't."""
    for begin in range(min(15, max(len(words) - 100, 0)) + 1):
        rest = words[begin:]
        n = len(rest)
        if n < 100:
            break
        for copies in range(5, 1, -1):
            cycle, odd = divmod(n, copies)
            if not odd and cycle >= 20 and all(rest[k] == rest[k % cycle] for k in range(cycle, n)):
                return " ".join(words[: begin + cycle])
        for cycle in range(n // 2, max(30, n // 2 - 51) - 1, -1):
            pattern, at = rest[:cycle], cycle
            while rest[at : at + cycle] == pattern:
                at += cycle
            if at > cycle:
                return " ".join(words[: begin + cycle] + rest[at:])
    return None


def collapse_repeats(line: str) -> str:
    """Phrases of 2 to 20 words that follow themselves, once each."""
    words = line.split()
    if len(words) < 4:
        return line
    if len(words) > 100 and (cycle := long_cycle(words)) is not None:
        return cycle
    places: dict[str, list[int]] = {}
    for k, word in enumerate(words):
        places.setdefault(word, []).append(k)
    if len(places) == len(words):
        return " ".join(words)
    out, k, most = [], 0, min(len(words) // 2, 20)
    while k < len(words):
        again = places[words[k]]
        top = min(most, (len(words) - k) // 2)
        for j in range(len(again) - 1, -1, -1):  # where the word comes again, the farthest first
            n = again[j] - k
            if n < 2:
                again = again[:0]
                break
            if n <= top and words[k : k + n] == words[k + n : k + 2 * n]:
                break
        else:
            again = again[:0]
        if again:
            phrase = words[k : k + n]
            out += phrase
            k += n
            while words[k : k + n] == phrase:
                k += n
        else:
            out.append(words[k])
            k += 1
    return " ".join(out)


def collapse_phrases(text: str) -> str:
    return _ended(_fenced(text, lambda x: collapse_repeats(x.strip()) if x.strip() and not x.strip().startswith("#") else x))


_HEADING = re.compile(r"(#{1,6})\s+(.+)")


def heading_of(line: str) -> re.Match[str] | None:
    return _HEADING.fullmatch(line.strip())


def merge_heading_text(text: str) -> str:
    """A heading and next text of which one begins with the other: the longer stays, as the heading."""
    rows, out, k = lines(text), [], 0
    while k < len(rows):
        m = heading_of(rows[k])
        j = k + 1
        while m and j < len(rows) and not rows[j].strip():
            j += 1
        if m and j < len(rows) and not heading_of(rows[j]):
            title, after = m[2].strip(), rows[j].strip()
            a, b = title.lower(), after.lower()
            if a.startswith(b) or b.startswith(a):
                out.append(f"{m[1]} {after if size(after) > size(title) else title}")
                k = j + 1
                continue
        out.append(rows[k])
        k += 1
    return _ended(out)


def drop_heading_texts(text: str) -> str:
    rows = lines(text)
    titles = {m[2].strip().lower() for m in map(heading_of, rows) if m}
    if not titles:
        return text
    return _ended([x for x in rows if not x.strip() or heading_of(x) or x.strip().lower() not in titles])


_MARKED = re.compile(r"[^\w\s]|_")


def fingerprint(text: str) -> str:
    """Lower-case letters and digits, single spaces."""
    return " ".join(_MARKED.sub("", text.lower()).split())


def drop_repeated_sections(text: str) -> str:
    """Later headings of the same level and words, and the first lines below that they share with the first."""
    rows = lines(text)
    places: dict[str, list[int]] = {}
    for k, line in enumerate(rows):
        if m := heading_of(line):
            places.setdefault(f"{m[1]} {fingerprint(m[2].strip())}", []).append(k)

    def below(k: int) -> range:
        k += 1
        while k < len(rows) and not rows[k].strip():
            k += 1
        stop = k
        while stop < len(rows) and rows[stop].strip() and not heading_of(rows[stop]):
            stop += 1
        return range(k, stop)

    skip: set[int] = set()
    for first, *rest in places.values():
        for other in rest:
            skip.add(other)
            for a, b in zip(below(first), below(other), strict=False):
                if fingerprint(rows[a].strip()) != fingerprint(rows[b].strip()):
                    break
                skip.add(b)
    return _ended([x for k, x in enumerate(rows) if k not in skip]) if skip else text


def strip_empty_headings(text: str) -> str:
    def is_empty(line: str) -> bool:
        m = heading_of(line)
        title = m[2].strip() if m else ""
        return bool(m) and (not any(c.isalnum() for c in title) or title.lower() in ("footer", "header", "menu", "navigation", "sidebar"))

    return _ended([x for x in lines(text) if not is_empty(x)])


def _is_statistic(text: str) -> bool:
    text = text.strip()
    marks = ("%", "#", "M+", "K+", "B+", "M ", "K ", "B ")
    return any(m in text for m in marks) or text.endswith("x") and any(c.isdigit() and c.isascii() for c in text)


def is_asset_label(line: str) -> bool:
    """Labels of a content system: short parts with bars, paths to a picture, known words, slugs."""
    if line.startswith("|"):
        return False
    parts = line.split(" | ")
    if len(parts) >= 3 and all(size(p) < 40 for p in parts) and not any(map(_is_statistic, parts)):
        return True
    if " > " in line and size(line) < 80 and any(w in line.lower() for w in ("card", "cover", "image", "logo", "poster", "thumbnail")):
        return True
    if 3 <= len(line.split()) <= 12 and any(w in line for w in ("1x1", "Art Card", "ArtCard", "Card Image", "Cover Image", "SEO")):
        return True
    return " " not in line and "-" in line and 10 < size(line) < 80 and all(c.isalnum() or c in "-_" for c in line)


def strip_asset_labels(text: str) -> str:
    def change(line: str) -> str | None:
        bare = line.strip()
        return line if not bare or bare.startswith(("#", ">")) or not is_asset_label(bare) else None

    return "\n".join(_fenced(text, change))


def strip_style_words(text: str) -> str:
    out, inside = [], False
    for line in lines(text):
        bare = line.strip()
        inside ^= bare.startswith("```")
        if inside or not bare:
            out.append(line)
        elif bare in ("-", "*"):
            continue
        elif bare.startswith(("#", ">", "- ", "* ")):
            out.append(line)
        elif not is_style_text(bare):
            out.append(without_style_tail(bare) or line)
    return _ended(out)


def without_style_tail(line: str) -> str:
    words = line.split()
    n = len(words)
    while len(words) >= 3 and n and is_style_word(words[n - 1]):
        n -= 1
    return " ".join(words[:n]) if len(words) - n >= 2 else line


def collapse_blank(text: str) -> str:
    out: list[str] = []
    for line in lines(text):
        line = line.rstrip()
        if line or not out or out[-1]:
            out.append(line)
    return "\n".join(out).strip()


SHORTEST, PREFIX = 20, 10


class _Seen:
    """Fingerprints, and their first words, that came before."""

    def __init__(self) -> None:
        self.whole: set[str] = set()
        self.prefix: set[str] = set()

    def new(self, text: str) -> bool:
        key = fingerprint(text)
        if key in self.whole:
            return False
        self.whole.add(key)
        words = key.split()
        head = " ".join(words[:PREFIX])
        if len(words) < PREFIX:
            return True
        if head in self.prefix:
            return False
        self.prefix.add(head)
        return True


def is_structural(line: str) -> bool:
    return line.startswith(("#", "- ", "* ", "```", "> "))


def _blocks(blocks: list[str], change: Callable[[str], str | None]) -> str:
    """Blocks changed where no code fence is open or opens in them."""
    out, inside = [], False
    for block in blocks:
        fences = sum(x.lstrip().startswith("```") for x in lines(block))
        new = block if inside or fences else change(block)
        inside ^= bool(fences % 2)
        if new is not None:
            out.append(new)
    return "\n\n".join(out)


def dedup_blocks(text: str) -> str:
    seen = _Seen()

    def change(block: str) -> str | None:
        bare = block.strip()
        short = size(bare) < SHORTEST or len(lines(bare)) == 1 and is_structural(bare)
        return bare if short or seen.new(bare) else None

    return _blocks([b for b in text.split("\n\n") if b.strip()], change)


def dedup_lines(text: str) -> str:
    def change(block: str) -> str:
        rows = lines(block)
        if len(rows) <= 2:
            return block
        seen = _Seen()
        return "\n".join(x for x in rows if size(x.strip()) < SHORTEST or is_structural(x.strip()) or seen.new(x.strip()))

    return _blocks(text.split("\n\n"), change)


def _folded(text: str) -> bytes:
    """The text with its ASCII letters in lower case."""
    return text.encode("utf-8", "surrogatepass").lower()


def dedup_comma_list(line: str) -> str:
    if ", " not in line:
        return line
    items = [x.strip() for x in line.split(", ")]
    n = len(items)
    if n >= 6:
        for cycle in range(1, n // 2 + 1):
            if n % cycle == 0 and all(items[k] == items[k % cycle] for k in range(cycle, n)):
                return ", ".join(items[:cycle])
    kept = [x for k, x in enumerate(items) if k == 0 or _folded(x) != _folded(items[k - 1])]
    return ", ".join(kept) if len(kept) < n else line


def dedup_comma_lists(text: str) -> str:
    return "\n".join(map(dedup_comma_list, lines(text)))


def strip_bare_headings(text: str) -> str:
    """Headings followed by nothing, or by one of their level or above."""
    rows = lines(text)
    level = lambda x: len(x) - len(x.lstrip("#"))
    out: list[str] = []
    after = ""
    for line in reversed(rows):
        bare = line.strip()
        empty = bare.startswith("#") and (not after or after.startswith("#") and level(after) <= level(bare))
        if not empty:
            out.append(line)
        after = bare or after
    return "\n".join(reversed(out))


def strip_empty_code(text: str) -> str:
    rows, out, k = lines(text), [], 0
    while k < len(rows):
        if rows[k].strip().startswith("```"):
            j = k + 1
            while j < len(rows) and not rows[j].strip():
                j += 1
            if j < len(rows) and rows[j].strip().startswith("```"):
                k = j + 1
                continue
        out.append(rows[k])
        k += 1
    return "\n".join(out)


def merge_statistics(text: str) -> str:
    """A short line and the one after a gap, on one line."""
    rows, out, k, inside = lines(text), [], 0, False
    while k < len(rows):
        bare = rows[k].strip()
        fence = bare.startswith("```")
        inside ^= fence
        if not fence and not inside and 0 < size(bare) <= 25 and not is_structural(bare):
            j = k + 1
            while j < len(rows) and not rows[j].strip():
                j += 1
            after = rows[j].strip() if k + 1 < j < len(rows) else ""
            if after and not is_structural(after) and size(bare) + 1 + size(after) <= 120:
                out.append(f"{bare} {after}")
                k = j + 1
                continue
        out.append(rows[k])
        k += 1
    return "\n".join(out).strip()


BEFORE_LINKS: tuple[Callable[[str], str], ...] = (
    decode_entities, strip_invisible, strip_leaked_scripts, strip_link_chrome, collapse_spaced, link_linked_images, collapse_logos,
    strip_images, strip_image_names, strip_emphasis, strip_descriptions, strip_controls, strip_long_descriptions, strip_styles,
    collapse_word_lists, drop_learn_more,
)
AFTER_LINKS: tuple[Callable[[str], str], ...] = (
    strip_lone_numbers, strip_controls, collapse_phrases, merge_heading_text, drop_heading_texts, drop_repeated_sections,
    strip_empty_headings, strip_asset_labels, strip_style_words, collapse_blank, dedup_blocks, dedup_lines, dedup_comma_lists,
    strip_bare_headings, strip_empty_code, collapse_blank, merge_statistics,
)
#: Every step by name, links apart.
STEPS = {f.__name__: f for f in (*BEFORE_LINKS, *AFTER_LINKS)}


def process_body(markdown: str) -> tuple[str, list[tuple[str, str]]]:
    """Compact text and the links taken out of it."""
    text = markdown
    for step in BEFORE_LINKS:
        text = step(text)
    text, links = take_links(text)
    for step in AFTER_LINKS:
        text = step(text)
    return text, links
