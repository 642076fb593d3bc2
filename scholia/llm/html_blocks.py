"""Leaf blocks of an HTML page with their features, from one tolerant pass over its tags."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

#: Elements that begin and end a block of text.
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "label", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
    "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements whose content is no text of the page: scripts, styles, drawings, embedded pages and form fields.
DROPPED = {"script", "style", "title", "noscript", "template", "svg", "iframe", "textarea"}
#: Levels that a missing end tag is looked for; what is beyond is taken as nested.
_LEVELS = 256
#: Levels above a block that are compared with those above the main group.
_UP = 8
#: Elements that an opening tag of the same kind closes, up to the container named.
_SIBLINGS = {"li": {"ul", "ol", "menu"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}

_BEGIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: A value may hold "<" and ">" only in quotes, and a quote counts only behind "=".
_ATTRIBUTES = re.compile(r"(?:[^<>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+")
_BARE_ATTRIBUTES = re.compile(r"[^<>]*+")
_MARKUP = re.compile(r"<[!?/][^<>]*+>")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in DROPPED}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: What names of classes, ids and roles begin with, by kind.
NAME_KINDS = {
    "ad": ["ads", "advert", "sponsor", "promo", "banner", "dfp", "adsense", "outbrain", "taboola"],
    "nav": ["nav", "menu", "breadcrumb", "toolbar", "pagination", "pager", "tabs"],
    "foot": ["foot", "copyright", "legal", "colophon", "contentinfo"],
    "head": ["header", "masthead", "logo", "topbar", "branding"],
    "side": ["side", "aside", "widget", "rail", "related", "recommend", "share", "social", "popular", "trending", "complementary", "more"],
    "note": ["cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscrib", "overlay", "paywall", "warning"],
    "comment": ["comment", "reply", "replies", "discuss", "disqus", "respond"],
    "form": ["form", "search", "login", "signup", "signin", "register", "input"],
    "main": ["article", "content", "main", "post", "entry", "story", "text", "prose"],
}
_EXACT = {"ad": "ad", "ads": "ad"}
_KIND_OF = [(p, kind) for kind, words in NAME_KINDS.items() for p in words]


def name_kinds(attributes: str) -> list[str]:
    """The kinds that the names in a tag's class, id and role speak of."""
    found = []
    for m in _NAMES.finditer(attributes):
        for part in _PART.findall(m[1] or m[2] or m[3] or ""):
            part = part.lower()
            kind = _EXACT.get(part) or next((k for p, k in _KIND_OF if part.startswith(p)), None)
            if kind and kind not in found:
                found.append(kind)
    return found


@dataclass
class Block:
    """A maximal run of text without a block boundary, with its ancestors' features."""

    text: str
    ancestors: tuple[str, ...]
    tag: str
    linked: int
    #: Numbers of the element itself and of those above it, nearest first.
    up: tuple[int, ...] = ()
    features: list[str] = field(default_factory=list)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text): kind is text, open, close or break; text is the text, or a tag's attributes.

    The position never goes back, so the time is linear whatever the page: a tag that is
    cut off by another "<" is text up to there, and once a quote has run to the end of the
    page, quotes count no more.
    """
    at, size, attributes = 0, len(html), _ATTRIBUTES
    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            yield "text", "", html[at:begin]
        if begin == size:
            return
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        tag = _BEGIN.match(html, begin)
        if tag is None:
            markup = _MARKUP.match(html, begin)
            if markup is None:
                yield "text", "", "<"
                at = begin + 1
            else:
                if html[begin + 1] == "!":
                    yield "break", "", ""
                at = markup.end()
            continue
        end = attributes.match(html, tag.end()).end()
        if end >= size and attributes is _ATTRIBUTES:
            # the rest of the page is behind a quote without an end
            attributes = _BARE_ATTRIBUTES
            end = attributes.match(html, tag.end()).end()
        if end >= size or html[end] != ">":
            yield "text", "", html[begin:end]
            at = end
            continue
        name, at = tag[2].lower(), end + 1
        if tag[1]:
            yield "close", name, ""
        elif name in DROPPED:
            done = _END[name].search(html, at)
            at = size if done is None else done.end()
        else:
            yield "open", name, html[tag.end() : end]


def leaf_blocks(html: str) -> list[Block]:
    """The blocks that have text, in page order; white space within each is one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = [("#", ())]
    numbers, count = [0], 0  # of the elements on the stack
    open_ = Counter()  # names on the stack

    def close(i: int) -> None:
        open_.subtract(name for name, _ in stack[i:])
        del stack[i:]
        del numbers[i:]

    parts: list[str] = []
    link, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = unescape(text)
            text = " ".join(text.split())
            if text:
                out.append(Block(text, stack[-1][1], stack[-1][0], linked, tuple(numbers[: -_UP - 1 : -1])))
            parts.clear()
        linked = 0

    for kind, name, text in tokens(html):
        if kind == "text":
            parts.append(text)
            if link:
                linked += len(text)
        elif kind == "break":
            flush()
        elif name == "a":
            link = max(0, link - 1) if kind == "close" else link + (not text.endswith("/"))
        elif name in ("br", "hr", "img", "input"):
            parts.append(" ")
        elif name in BLOCK:
            flush()
            if kind == "close":
                if open_[name] > 0:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
                    link = 0
            else:
                if name in _SIBLINGS:
                    for i in range(len(stack) - 1, max(0, len(stack) - 1 - _LEVELS), -1):
                        if stack[i][0] == name:
                            close(i)
                            break
                        if stack[i][0] in _SIBLINGS[name]:
                            break
                elif stack[-1][0] == "p":
                    close(len(stack) - 1)
                link = 0
                above = stack[-1][1]
                own = ["in:" + name] + ["name:" + k for k in name_kinds(text)] if text else ["in:" + name]
                open_[name] += 1
                count += 1
                stack.append((name, above + tuple(x for x in own if x not in above)))
                numbers.append(count)
    flush()
    return out


#: Words of headings above what isn't the article, by kind.
HEADINGS = {
    "comment": ["comment", "comments", "reply", "replies", "responses", "discussion", "reactions", "kommentare", "commentaires", "comentarios"],
    "side": ["related", "recommended", "popular", "trending", "latest", "share", "follow", "tags", "categories", "archive", "newsletter"],
}
#: Tags and kinds of names that stand around articles.
_AROUND = {"in:nav", "in:footer", "in:aside", "in:form", "in:dialog", "name:ad", "name:nav", "name:foot", "name:side", "name:note", "name:comment", "name:form"}
_HEADING_OF = {word: kind for kind, words in HEADINGS.items() for word in words}
_WORD = re.compile(r"[^\W\d_]+")
_AGO = re.compile(r"\b\d+ (?:min|minute|hour|day|week|month|year)s? ago\b")


def _groups(blocks: list[Block]) -> list[tuple[int, ...]]:
    """The numbers of the elements that each block's own element stands in, nearest first.

    Text that stands loose beside other blocks of its element is in that element.
    """
    holders = {b.up[1] for b in blocks if len(b.up) > 1}
    return [b.up if b.up[0] in holders else b.up[1:] or b.up for b in blocks]


def _place(above: tuple[int, ...], main: tuple[int, ...]) -> str:
    """Where a group is from the main group: how far within, or how far up and down to it."""
    if main[0] in above:
        return f"in{min(2, above.index(main[0]))}"
    for i, number in enumerate(above):
        if number in main:
            return f"out{min(2, i)},{min(3, main.index(number))}"
    return "far"


def _step(value: float, bounds: tuple[float, ...]) -> int:
    return sum(value >= b for b in bounds)


def add_features(blocks: list[Block]) -> list[Block]:
    """Ancestor-tag, text and place features of each block of a page.

    The main group is the element with the most words outside links right below it, and
    half of those one level further down, without what tags and names put around articles.
    """
    weight = [(b.text.count(" ") + 1) * (1 - min(1.0, b.linked / len(b.text))) for b in blocks]
    groups = _groups(blocks)
    mass: dict[int, float] = {}
    for b, above, w in zip(blocks, groups, weight):
        around = _AROUND.isdisjoint(b.ancestors)
        for number, part in zip(above, (w, w / 2)):
            mass[number] = mass.get(number, 0.0) + part * around
    number = max(mass, key=lambda g: (mass[g], -g), default=-1)
    main = next((above for above in groups if above[0] == number), (-1,))
    total = max(1.0, sum(weight))
    own = [i for i, above in enumerate(groups) if number in above]
    under, holder = "", 0
    marked = [k for k in ("in:article", "in:main", "name:main") if any(k in b.ancestors for b in blocks)]
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        share = b.linked / max(1, len(b.text))
        low = b.text.lower()
        length = _step(words, (2, 4, 8, 16, 32, 64))
        linkage = _step(share, (0.01, 0.3, 0.7))
        place, part = _place(groups[i], main), _step(mass[groups[i][0]] / total, (0.05, 0.2, 0.5, 0.8))
        side = "before" if not own or i < own[0] else "after" if i > own[-1] else "within"
        b.features = [
            *b.ancestors,
            "tag:" + b.tag,
            f"words:{length}",
            f"links:{linkage}",
            f"words-links:{length},{linkage}",
            "stop" if b.text[-1] in ".!?:;\"'”’…" else "no-stop",
            f"tag-words:{b.tag},{length}",
            f"place:{_step(i / len(blocks), (0.1, 0.3, 0.7, 0.9))}",
            "from-main:" + place,
            f"side:{side},{place}",
            f"group:{part}",
            f"group-place:{part},{place}",
            f"place-words:{place},{length}",
            "bias",
        ]
        if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "legend", "summary") or (words <= 4 and b.text[-1] not in ".!?,;"):
            kinds = {_HEADING_OF[w] for w in _WORD.findall(low) if w in _HEADING_OF} if words <= 6 else set()
            if kinds:
                under, holder = min(kinds), groups[i][0]
                b.features.append("heading:" + under)
            elif b.tag in ("h1", "h2", "h3"):
                under = ""
        if under and holder in b.up:
            b.features.append("under:" + under)
        if not _AROUND.isdisjoint(b.ancestors):
            b.features += ["around", f"around:{place}"]
        if _AGO.search(low):
            b.features.append("ago")
        if "©" in b.text or "copyright" in low or "all rights" in low:
            b.features.append("rights")
        for k in marked:
            b.features.append("within" if k in b.ancestors else "outside:" + k)
    return blocks
