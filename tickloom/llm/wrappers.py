"""Page structure and union-free wrappers: the token streams behind :mod:`html_text`.

A page becomes a stream of tokens: ``+key`` and ``-key`` for containers that open and close, and
a block name for every run of text. Tandem repeats are folded into repeated groups. A wrapper is
such a folded stream in which every token may be optional; texts are its slots. Two streams are
aligned by their longest common subsequence; what only one of them has becomes optional, and a
token that one of them repeats becomes a repeated group. There are no alternatives.

A node is a string or ``["*", [items]]``; an item is ``[node, optional]``. Slots are the block
tokens of a wrapper, numbered in order.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

# Element names by what they do to the text around them.
CONTAINERS = frozenset(
    "article main section nav aside header footer form div ul ol dl table figure fieldset details dialog menu blockquote".split()
)
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr dt dd pre figcaption caption legend summary hr address".split())
# Script and style are taken out with the comments, before tags are read.
HIDDEN = frozenset("head noscript template svg math iframe object select textarea button canvas video audio".split())
# Containers that never hold the article, and words of class or id that say so.
NOISE_TAGS = frozenset("nav aside footer form menu dialog".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo "
    "promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar "
    "widget widgets".split()
)

# An article may name any of these in its class but the comments.
COMMENT_WORDS = frozenset("comment comments reply".split())

_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)(?![\w-])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.I | re.S)
_TAG = re.compile(r"(<[/a-zA-Z](?:[^'\">]|\"[^\"]*\"|'[^']*')*+>|<[/a-zA-Z][^>]*>)")
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9-]*)")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[a-zA-Z]+")
PERIOD = 64  # the longest repeated group looked for, in tokens


@lru_cache(maxsize=8192)
def _read(tag: str) -> tuple[str, str]:
    """Kind and key of a tag: ``+``, ``-``, ``block``, ``space``, ``link``, ``unlink``, ``hide``, ``unhide``, ``body`` or nothing."""
    found = _NAME.match(tag)
    name = found.group(1).lower() if found else ""
    closing = tag.startswith("</")
    if name in CONTAINERS:
        if closing:
            return "-", name
        known = COMMENT_WORDS if name in ("article", "main") else NOISE_WORDS
        marks = sorted({w.lower() for m in _MARKS.findall(tag) for w in _WORDS.findall(m)} & known)
        return "+", ".".join([name, *marks])
    if name in BLOCKS:
        return "block", "" if closing else name
    if name in HIDDEN:
        return ("unhide" if closing else "" if tag.endswith("/>") else "hide"), name
    if name == "body":
        return ("" if closing else "body"), ""
    if name == "a":
        return ("unlink" if closing else "link"), ""
    return ("space" if name == "br" else ""), ""


def parsed(page: str) -> tuple[list[str], list[tuple[str, int]]]:
    """The token stream, and the text of every block with how much of it is in links.

    White space of a block is one space; character references are decoded; blocks without text
    are no blocks. Elements that are left open end where the page ends. Hidden elements give no
    text: one ends at its closing tag or that of the container it stands in, at once if it closes
    itself, and a head at the body or at the first container or block in it.
    """
    tokens: list[str] = []
    texts: list[tuple[str, int]] = []
    open_: list[str] = []
    hidden: list[str] = []
    inside: list[str] = []  # containers open in the hidden element
    name, held, linked, in_link = "text", [], 0, False

    def close() -> None:
        nonlocal held, linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                tokens.append(name)
                texts.append((text, linked))
        held, linked = [], 0

    for i, part in enumerate(_TAG.split(_GONE.sub("", page))):
        if i % 2 == 0:
            if part and not hidden:
                held.append(part)
                linked += len(part) if in_link else 0
            continue
        kind, key = _read(part)
        if hidden:
            if kind == "unhide" and key in hidden:
                del hidden[hidden.index(key) :], inside[:]
            elif hidden == ["head"] and (kind in ("+", "body") or (kind == "block" and key)):
                hidden.clear()
            elif hidden[0] == "head" and kind == "body":
                del hidden[:], inside[:]
            elif kind == "hide" and hidden == ["head"]:
                hidden.append(key)
            elif kind == "+":
                inside.append(key.split(".")[0])
            elif kind == "-" and key in inside:
                del inside[len(inside) - 1 - inside[::-1].index(key) :]
            elif kind == "-" and any(k.split(".")[0] == key for k in open_):
                del hidden[:], inside[:]
            if hidden or kind == "unhide":
                continue
        if kind == "hide":
            hidden.append(key)
        elif kind == "+":
            close()
            name = "text"
            open_.append(key)
            tokens.append("+" + key)
        elif kind == "-":
            close()
            name = "text"
            if any(k.split(".")[0] == key for k in open_):
                while open_:
                    last = open_.pop()
                    tokens.append("-" + last)
                    if last.split(".")[0] == key:
                        break
        elif kind == "block":
            close()
            name = key or "text"
        elif kind == "space":
            held.append(" ")
        elif kind in ("link", "unlink"):
            in_link = kind == "link"
    close()
    tokens += ["-" + k for k in reversed(open_)]
    return tokens, texts


def is_slot(node) -> bool:
    return isinstance(node, str) and node[0] not in "+-"


def folded(tokens: list[str]) -> tuple[list, list[list[int]]]:
    """The stream with tandem repeats as groups, and for each of its slots the tokens it stands for."""
    entries = [(t, [[i]] if is_slot(t) else []) for i, t in enumerate(tokens)]
    for period in range(1, PERIOD + 1):
        if 2 * period > len(entries):
            break
        out, i, n = [], 0, len(entries)
        while i < n:
            end = i + period
            if end + period <= n and all(entries[i + j][0] == entries[end + j][0] for j in range(period)):
                body = entries[i:end]
                slots = [[list(s) for s in e[1]] for e in body]
                while end + period <= n and all(entries[end + j][0] == body[j][0] for j in range(period)):
                    for j in range(period):
                        for mine, more in zip(slots[j], entries[end + j][1], strict=True):
                            mine.extend(more)
                    end += period
                out.append((["*", [[e[0], False] for e in body]], [s for each in slots for s in each]))
                i = end
            else:
                out.append(entries[i])
                i += 1
        entries = out
    return [[node, False] for node, _ in entries], [s for _, slots in entries for s in slots]


def n_slots(node) -> int:
    return int(is_slot(node)) if isinstance(node, str) else sum(n_slots(x) for x, _ in node[1])


def _body(node) -> list:
    return [[node, False]] if isinstance(node, str) else node[1]


def _head(node) -> str:
    return node if isinstance(node, str) else _head(node[1][0][0])


def _weight(a, b) -> int:
    """How many tokens two nodes share if they become one: 0 unless they are the same token or groups that begin alike."""
    if isinstance(a, str) and isinstance(b, str):
        return int(a == b)
    if isinstance(a, str) or isinstance(b, str):
        group, token = (b, a) if isinstance(a, str) else (a, b)
        return int(len(group[1]) == 1 and group[1][0][0] == token)
    return sum(_weight(a[1][p][0], b[1][q][0]) for p, q in _pairs(a[1], b[1])) if _head(a) == _head(b) else 0


def _pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a heaviest common subsequence of two item lists.

    Equal ends are taken as they are: no node weighs more with another than with its equal, so
    some heaviest subsequence pairs them. Nodes that are merely alike are weighed.
    """
    begin, n, m = 0, len(a), len(b)
    out = []
    while begin < n and begin < m and a[begin][0] == b[begin][0]:
        out.append((begin, begin))
        begin += 1
    tail = 0
    while n - tail > begin and m - tail > begin and a[n - tail - 1][0] == b[m - tail - 1][0]:
        tail += 1
    rows, columns = range(begin, n - tail), range(begin, m - tail)
    weights = [[_weight(a[i][0], b[j][0]) for j in columns] for i in rows]
    best = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
    for i in reversed(range(len(rows))):
        for j in reversed(range(len(columns))):
            here = best[i + 1][j + 1] + weights[i][j]
            best[i][j] = max(here, best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(rows) and j < len(columns):
        if weights[i][j] and best[i][j] == best[i + 1][j + 1] + weights[i][j]:
            out.append((rows[i], columns[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out + [(n - k, m - k) for k in range(tail, 0, -1)]


def merged(a: list, b: list) -> list:
    """The smallest such wrapper of both: the aligned items, and the others as optional ones."""
    out, i, j = [], 0, 0
    for p, q in [*_pairs(a, b), (len(a), len(b))]:
        out += [[node, True] for node, _ in a[i:p]] + [[node, True] for node, _ in b[j:q]]
        if p < len(a):
            x, y = a[p][0], b[q][0]
            node = x if x == y else ["*", merged(_body(x), _body(y))]
            out.append([node, a[p][1] or b[q][1]])
        i, j = p + 1, q + 1
    return out


def slots_of(wrapper: list, stream: list) -> list[int]:
    """For every slot of a folded stream the wrapper's slot it meets, or -1."""
    first, firsts = 0, []
    for node, _ in wrapper:
        firsts.append(first)
        first += n_slots(node)
    met = {q: p for p, q in _pairs(wrapper, stream)}
    out: list[int] = []
    for q, (node, _) in enumerate(stream):
        n, p = n_slots(node), met.get(q)
        if p is None:
            out += [-1] * n
        elif isinstance(node, str) and isinstance(wrapper[p][0], str):
            out += [firsts[p]] * n
        else:
            out += [firsts[p] + s if s >= 0 else -1 for s in slots_of(_body(wrapper[p][0]), _body(node))]
    return out


def contexts(wrapper: list) -> list[tuple[str, ...]]:
    """The containers around every slot, outermost first."""
    out: list[tuple[str, ...]] = []

    def walk(items: list, around: tuple[str, ...]) -> tuple[str, ...]:
        for node, _ in items:
            if not isinstance(node, str):
                around = walk(node[1], around)
            elif node[0] == "+":
                around = (*around, node[1:])
            elif node[0] == "-":
                if node[1:] in around:
                    around = around[: len(around) - 1 - around[::-1].index(node[1:])]
            else:
                out.append(around)
        return around

    walk(wrapper, ())
    return out


def is_noise(around: tuple[str, ...]) -> bool:
    """Whether any container is one that holds no article; a header is none inside an article."""
    inside = False
    for key in around:
        tag, *words = key.split(".")
        if tag in NOISE_TAGS or words or (tag == "header" and not inside):
            return True
        inside = inside or tag in ("article", "main")
    return False


@lru_cache(maxsize=20_000)
def places_of(tokens: tuple[str, ...]) -> list[tuple[bool, bool]]:
    """For every block of a page: whether its containers are an article without noise, and whether they are no noise."""
    around = contexts([[t, False] for t in tokens])
    return [(in_article(c) and not is_noise(c), not is_noise(c)) for c in around]


def in_article(around: tuple[str, ...]) -> bool:
    return any(key.split(".")[0] in ("article", "main") for key in around)
