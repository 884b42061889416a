"""HTML extraction (op8): main text by wrappers that are inferred from pages of the same host.

Union-free regular-expression inference: a page is a stream of tags and text
slots. The wrapper of a host starts as one page's stream; each further sample
page is aligned with it. Where they differ, the mismatch is resolved, in this
order: a repeated group (the differing tag starts the same element that has just
ended: "(...)+"), an optional group (an element that only one side has: "(...)?"),
else a text slot. Elements that meet inside a group are aligned in the same
way, down to their texts.

A text that is the same wherever the wrapper read it, on TEMPLATE pages at least,
is template; every other text slot is data. The main text is read from the data
slots: `region` walks down the wrapper from its root, as long as one container
that is not part of a repeated group holds more than half of the data below its
parent, and stops where text blocks, a repeated group or several containers of one kind hold them. Data in
links, menus, forms and page furniture do not count. Tags that say what they are
(article, main) weigh more, and class or id words like "comments" less; they
decide between containers that hold similar amounts and nothing else.

Every page of the host is then read by its wrapper: blocks of the region, and
headings that stand just before it, but for blocks that consist of template text.
Pages that lack the region, and hosts without wrapper, are read by a rule on
their own: <article>, else <main>, else the element whose own paragraphs hold most
text. Inside a region, an element with a furniture word as its class or id goes
only if it holds less than half of the region's text.

The sample is SAMPLE pages of each host, spread over its layouts (sets of
container tags with their classes), in each the least by a hash of page_id; this bounds
what one task holds, whatever a host's share of all pages. Sample pages are aligned whole.

Null and empty html give an empty text. Null urls are one host. Pages that
repeat a page_id are separate rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import small_batches, stage

SAMPLE = 12  #: pages of a host from which its wrapper is inferred
TEMPLATE = 3  #: readings of a text slot, all the same, from which its text counts as template

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?![a-zA-Z/!?])|[^<]+|<[^>]*>?", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "select", "object", "canvas")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
_OUT = frozenset("nav header footer aside form button input select textarea script style noscript iframe template svg math title head object canvas dialog menu fieldset audio video".split())
_OUT_WORDS = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header menu menubar modal nav navbar navigation newsletter notice pager pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_MAIN = ("article", "main")
_ROOTS = ("html", "body", *_MAIN)
#: elements that are blocks of text, and so no containers of an article
_BARE = ("div", "section", "td", "center")  #: without id and class, these are told apart by what they start with
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd figure figcaption table thead tbody tr th td caption address hr".split())
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
_SPACE = re.compile(r"\s+")
_HEADING = re.compile(r"h[1-6]")


class Node:
    """An element: tag, key (tag with id and first class), children (Node or text), parent. out: never text; doubt: its class or id names page furniture."""

    __slots__ = ("children", "doubt", "key", "out", "parent", "tag")

    def __init__(self, tag: str, key: str, out: bool, doubt: bool, parent: Node | None):
        self.tag, self.key, self.out, self.doubt, self.parent, self.children = tag, key, out, doubt, parent, []


def _start(tag: str, attributes: str) -> tuple[str, bool, bool]:
    key, out, doubt = tag, tag in _OUT, False
    for name, value in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("id", "class"):
            words = value.split()
            if words:
                key += "#" + re.sub(r"[\d.#!~>:]+", "0", words[0]) if name == "id" else "." + re.sub(r"\d{3,}|[.#!~>:]", "0", words[0])
            doubt |= any(w in _OUT_WORDS for w in words)
        elif name == "role":
            doubt |= value in _OUT_ROLES
        elif name == "style":
            out |= bool(re.search(r"display\s*:\s*none", value))
    if tag in _ROOTS:
        return key, False, False
    out |= bool(re.search(r"(^|\s)hidden(\s|=|$)", attributes)) if "hidden" in attributes else False
    return key, out, doubt


def parse(page: str) -> Node:
    """The element tree; tags that are not closed end with their parent, or where HTML closes them."""
    root = at = Node("", "", False, False, None)
    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.match(page, pos)
        if m is None:
            at.children.append(page[pos])
            pos += 1
            continue
        text, pos = m[0], m.end()
        tag = m[2]
        if tag is None:
            if text[0] != "<" or (len(text) == 1):
                at.children.append(text)
            continue
        tag = tag.lower()
        if m[1]:
            up = at
            while up is not root and up.tag != tag:
                if up.tag in ("article", "main", "body") and tag in _INLINE:
                    up = root  # a stray inline end
                    break
                up = up.parent
            if up is not root:
                at = up.parent
            continue
        if tag in _CLOSES or tag not in _INLINE:
            ends = _CLOSES.get(tag, frozenset({"p"}) if tag not in _VOID or tag == "hr" else frozenset())
            up = at
            while up is not root and up.tag in _INLINE:  # a paragraph ends also inside open inline tags
                up = up.parent
            if up.tag in ends and up is not root:
                at = up.parent
        node = Node(tag, *_start(tag, m[3] or ""), at)
        at.children.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(page, pos)
            pos = end.end() if end else n
        elif tag not in _VOID and not (m[3] or "").endswith("/"):
            at = node
        if node.parent.key in _BARE and len(node.parent.children) < 4 and not any(isinstance(x, Node) for x in node.parent.children[:-1]):
            node.parent.key += ">" + ("t" if tag in _TEXT else "a" if tag == "a" else "i" if tag in _INLINE else "c")
    return root


def _plain(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def blocks(node: Node, path: tuple[str, ...] = (), same: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the block elements below node, in page order, without what is out. path: that of node; same: hashes of template texts; a block of template texts alone is left out."""
    out: list[str] = []
    line: list[str] = []
    data = False
    whole = _size(node) if _doubtful(node) else 0

    def end() -> None:
        nonlocal data
        if (text := _plain("".join(line))) and data:
            out.append(text)
        line.clear()
        data = False

    stack: list = [(node, path)]
    while stack:
        x, at = stack.pop()
        if isinstance(x, str):
            line.append(x)
            data = data or (bool(x.strip()) if not same else bool(t := _plain(x)) and _hash(at, t) not in same)
        elif x is None:
            end()
        elif x is not node and (x.out or x.doubt and 2 * _size(x) < whole):
            if x.tag not in _INLINE:
                end()
        elif x.tag == "br":
            line.append(" ")
        else:
            at = at if x is node else (*at, x.key)
            if x.tag not in _INLINE:
                end()
                stack.append((None, at))
            stack.extend((y, at) for y in reversed(x.children))
    end()
    return out


def _doubtful(node: Node) -> bool:
    stack = [x for x in node.children if isinstance(x, Node)]
    while stack:
        x = stack.pop()
        if x.doubt:
            return True
        stack += [y for y in x.children if isinstance(y, Node)]
    return False


def _size(node: Node) -> int:
    """Characters below node that are not out."""
    n, stack = 0, [node]
    while stack:
        x = stack.pop()
        for y in x.children:
            if isinstance(y, str):
                n += len(y.strip())
            elif not y.out:
                stack.append(y)
    return n


def _elements(root: Node) -> Iterator[Node]:
    """Every container that is not out, in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(x for x in reversed(node.children) if isinstance(x, Node) and not x.out and x.tag not in _VOID and x.tag not in _INLINE and x.tag != "p")


# --- wrappers ---------------------------------------------------------------

Token = tuple[str, str]


def stream(root: Node) -> list[Token]:
    """Tags and text slots: ("<", key), (">", key), ("t", text). The key of an element that is out ends in "!", of one in doubt in "~"."""
    out: list[Token] = []
    stack: list = [*reversed(root.children)]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x)
        elif isinstance(x, str):
            if t := _plain(x):
                out.append(("t", t))
        elif x.tag not in _RAW:
            key = x.key + ("!" if x.out else "~" if x.doubt else "")
            out.append(("<", key))
            stack.append((">", key))
            stack.extend(reversed(x.children))
    return out


class Piece:
    """A part of a wrapper: a tag, a text slot, or a group of pieces that is optional or repeated. A slot knows whether its readings differ (data), how many there were, and their characters."""

    __slots__ = ("data", "kind", "mark", "parts", "read", "size")

    def __init__(self, kind: str, mark: str = "", parts: list | None = None):
        self.kind, self.mark, self.parts = kind, mark, parts or []
        self.data, self.read, self.size = False, 1, len(mark) if kind == "t" else 0

    def take(self, text: str) -> None:
        """One more reading of a text slot."""
        self.data |= self.mark != text
        self.read += 1
        self.size += len(text)


def wrapper(tokens: list[Token]) -> list[Piece]:
    return [Piece(k, m) for k, m in tokens]


def _ends(kinds: list[Token]) -> tuple[list[int], list[int]]:
    """For each start tag, where its element ends (after its end tag), and the start of the element that ends just before it (-1: none)."""
    n = len(kinds)
    close, before, stack, last = [0] * n, [-1] * n, [], -1
    for i, (kind, _) in enumerate(kinds):
        if kind == "<":
            before[i] = last
            stack.append(i)
            last = -1
        elif kind == ">":
            last = stack.pop() if stack else -1
            if last >= 0:
                close[last] = i + 1
        else:
            last = -1
    for i in stack:
        close[i] = n
    return close, before


def align(have: list[Piece], tokens: list[Token]) -> list[Piece]:
    """The wrapper that reads what `have` reads, and tokens too."""
    out: list[Piece] = []
    i = j = 0
    marks = [(p.kind, p.mark) for p in have]
    close, before = _ends(tokens)
    have_close, have_before = _ends(marks)
    opens = lambda k: tokens[k][0] == "<"

    def grown(group: Piece, k: int) -> int:
        """Tokens from k that one more reading of the group takes; it learns what it does not read yet."""
        if n := _read(group.parts, tokens, k):
            return n
        if k < len(tokens) and opens(k) and group.parts and (group.parts[0].kind, group.parts[0].mark) == tokens[k]:
            group.parts = align(group.parts, tokens[k : close[k]])
            return close[k] - k
        return 0

    while i < len(have) and j < len(tokens):
        p, t = have[i], tokens[j]
        if p.kind in ("?", "+"):
            n = 0
            while (n == 0 or p.kind == "+") and (used := grown(p, j)):
                j, n = j + used, n + 1
            out.append(p if n or p.kind == "?" else Piece("?", parts=[p]))
            i += 1
        elif p.kind == t[0] == "t":
            p.take(t[1])
            out.append(p)
            i, j = i + 1, j + 1
        elif (p.kind, p.mark) == t:
            out.append(p)
            i, j = i + 1, j + 1
        elif out and out[-1].kind == "+" and (used := grown(out[-1], j)):  # the page repeats a known group once more
            j += used
        elif opens(j) and before[j] >= 0 and tokens[before[j]] == t and (q := _last(out)) and (q.kind, q.mark) == t:  # the page repeats, the wrapper does not yet
            out.append(Piece("+", parts=align(_take(out), tokens[j : close[j]])))
            j = close[j]
        elif p.kind == "<" and have_before[i] >= 0 and marks[have_before[i]] == marks[i] and (q := _last(out)) and ((q.kind, q.mark) == marks[i] or q.kind == "+"):  # the wrapper repeats, the page does not
            group = q if q.kind == "+" else Piece("+", parts=_take(out))
            if group is not q:
                out.append(group)
            group.parts = align(group.parts, _flat(have[i : have_close[i]]))
            i = have_close[i]
        elif p.kind == "<" and have_close[i] < len(have) and _opens(have[have_close[i]], t):
            out.append(Piece("?", parts=have[i : have_close[i]]))
            i = have_close[i]
        elif opens(j) and close[j] < len(tokens) and _opens(p, tokens[close[j]]):
            out.append(Piece("?", parts=wrapper(tokens[j : close[j]])))
            j = close[j]
        elif p.kind == "t":
            out.append(Piece("?", parts=[p]))
            i += 1
        elif t[0] == "t":
            out.append(Piece("?", parts=[Piece(*t)]))
            j += 1
        elif p.kind == "<" and opens(j):
            out += [Piece("?", parts=have[i : have_close[i]]), Piece("?", parts=wrapper(tokens[j : close[j]]))]
            i, j = have_close[i], close[j]
        elif opens(j):  # the page has one more element before the end of the wrapper's
            out.append(Piece("?", parts=wrapper(tokens[j : close[j]])))
            j = close[j]
        elif p.kind == "<":
            out.append(Piece("?", parts=have[i : have_close[i]]))
            i = have_close[i]
        else:  # an end tag without partner
            out.append(Piece("?", parts=[p]))
            i += 1
    while i < len(have):
        if have[i].kind in ("?", "+"):
            out.append(have[i] if have[i].kind == "?" else Piece("?", parts=[have[i]]))
            i += 1
        else:
            k = next((k for k in range(i, len(have)) if have[k].kind in ("?", "+")), len(have))
            out.append(Piece("?", parts=have[i:k]))
            i = k
    if j < len(tokens):
        group = out[-1] if out and out[-1].kind == "+" else None
        while group and j < len(tokens) and (used := grown(group, j)):
            j += used
        if j < len(tokens):
            out.append(Piece("?", parts=wrapper(tokens[j:])))
    return out


def _opens(p: Piece, t: Token) -> bool:
    """Whether a piece can start with the token."""
    return p.kind == t[0] and (p.kind == "t" or p.mark == t[1]) or p.kind in ("?", "+") and bool(p.parts) and _opens(p.parts[0], t)


def _flat(pieces: list[Piece]) -> list[Token]:
    """One reading of pieces that are a wrapper of their own."""
    return [t for p in pieces for t in (_flat(p.parts) if p.kind in ("?", "+") else [(p.kind, p.mark)])]


def _last(out: list[Piece]) -> Piece | None:
    """The start of the last element in out, or the repeated group that it ends in."""
    depth = 0
    for p in reversed(out):
        depth += {">": 1, "<": -1}.get(p.kind, 0)
        if depth == 0:
            return p
        if depth < 0:
            return None
    return None


def _take(out: list[Piece]) -> list[Piece]:
    """Remove the last element from out and return it."""
    depth = 0
    for k in range(len(out) - 1, -1, -1):
        depth += {">": 1, "<": -1}.get(out[k].kind, 0)
        if depth <= 0:
            group = out[k:]
            del out[k:]
            return group
    return []


def _read(parts: list[Piece], tokens: list[Token], j: int) -> int:
    """How many tokens from j the pieces read, or 0; the texts go into their slots."""
    slots: list[tuple[Piece, str]] = []

    def read(parts: list[Piece], at: int) -> int:
        """Where the reading ends, or -1."""
        for p in parts:
            if p.kind in ("?", "+"):
                n = 0
                while n == 0 or p.kind == "+":
                    kept = len(slots)
                    end = read(p.parts, at)
                    if end <= at:
                        del slots[kept:]
                        break
                    at, n = end, n + 1
                if p.kind == "+" and not n:
                    return -1
            elif at < len(tokens) and p.kind == tokens[at][0] and (p.kind == "t" or p.mark == tokens[at][1]):
                if p.kind == "t":
                    slots.append((p, tokens[at][1]))
                at += 1
            elif p.kind != "t":  # a slot can be empty
                return -1
        return at

    end = read(parts, j)
    if end <= j:
        return 0
    for p, text in slots:
        p.take(text)
    return end - j


class Step(NamedTuple):
    """An element of a wrapper on the way to a slot: its key, which of its siblings with that key it is, and whether it is part of a repeated group."""

    key: str
    place: int
    many: bool


def slots(pieces: list[Piece]) -> Iterator[tuple[tuple[Step, ...], Piece]]:
    """Every text slot with the elements around it."""
    path: list[Step] = []
    counts: list[dict[str, int]] = [{}]
    stack: list[tuple[list[Piece], int, bool]] = [(pieces, 0, False)]
    while stack:
        parts, k, many = stack.pop()
        while k < len(parts):
            p = parts[k]
            k += 1
            if p.kind == "<":
                if _tag(p.mark) not in _VOID:
                    place = counts[-1].get(p.mark, 0)
                    counts[-1][p.mark] = place + 1
                    path.append(Step(p.mark, place, many))
                    counts.append({})
            elif p.kind == ">":
                at = next((x for x in range(len(path) - 1, -1, -1) if path[x].key == p.mark), None)
                if at is not None:
                    del path[at:], counts[at + 1 :]
            elif p.kind == "t":
                yield tuple(path), p
            else:
                stack.append((parts, k, many))
                parts, k, many = p.parts, 0, p.kind == "+"


def _is_template(p: Piece) -> bool:
    return not p.data and p.read >= TEMPLATE


def _tag(key: str) -> str:
    return re.split(r"[#.!~>]", key, maxsplit=1)[0]


def region(pieces: list[Piece]) -> tuple[Step, ...] | None:
    """The way to the container of a wrapper that holds the main text, or None if the wrapper has no data."""
    held: dict[tuple[Step, ...], float] = {}  # data below each container that is no repeated one
    own: dict[tuple[Step, ...], float] = {}  # data in its text blocks and repeated groups
    for path, p in slots(pieces):
        tags = [_tag(x.key) for x in path]
        if _is_template(p) or "a" in tags or any(x.key.endswith("!") for x in path):
            continue
        weight = float(p.size)
        for x, tag in zip(path, tags, strict=True):
            weight *= 4 if tag in _MAIN else 0.25 if x.key.endswith("~") else 1
        depth = next((i for i, (x, tag) in enumerate(zip(path, tags, strict=True)) if x.many or tag in _TEXT or tag in _INLINE), len(path))
        if depth < len(path) and _HEADING.fullmatch(tags[depth]) and not path[depth].many:
            weight *= 0.1  # a heading alone keeps no container open
        else:
            own[path[:depth]] = own.get(path[:depth], 0) + weight
        for i in range(depth + 1):
            held[path[:i]] = held.get(path[:i], 0) + weight
    if not held:
        return None
    at: tuple[Step, ...] = ()
    while True:
        below = [p for p in held if len(p) == len(at) + 1 and p[: len(at)] == at]
        best = max(below, key=lambda p: (held[p], p), default=None)
        alike = sum(held[p] for p in below if best is not None and p != best and p[-1].key == best[-1].key)
        if best is None or 2 * held[best] <= held[at] or 10 * own.get(at, 0) > held[at] or 8 * alike > held[at]:
            return at
        at = best


def infer(pages: list[str]) -> tuple[tuple[str, ...] | None, list[int]]:
    """Of a host, the way to the region ("key:place:siblings" of each element) and the hashes of its template texts; None if its pages give no wrapper."""
    streams = [x for x in (stream(parse(p)) for p in pages if p) if x]
    if len(streams) < 2:
        return None, []
    have = wrapper(streams[0])
    for x in streams[1:]:
        have = align(have, x)
    path = region(have)
    if path is None:
        return None, []
    every = list(slots(have))
    inside = [(tuple(x.key.rstrip("!~") for x in way), p) for way, p in every if way[: len(path)] == path and not any(x.key.endswith("!") for x in way)]
    titles = [(tuple(x.key.rstrip("!~") for x in way), p) for way, p in every if path and way[: len(path) - 1] == path[:-1] and len(way) >= len(path) and _HEADING.fullmatch(_tag(way[len(path) - 1].key))]
    fixed = [(keys, p) for keys, p in inside if _is_template(p)]
    if 2 * sum(p.size for _, p in fixed) > sum(p.size for _, p in inside):  # the pages are copies of each other
        fixed = []
    fixed += [(keys, p) for keys, p in titles if _is_template(p)]
    siblings = [1 + max(way[i].place for way, _ in every if len(way) > i and way[:i] == path[:i] and way[i].key == x.key) for i, x in enumerate(path)]
    return tuple(f"{x.key.rstrip('!~')}:{x.place}:{n}" for x, n in zip(path, siblings, strict=True)), sorted({_hash(keys, p.mark) for keys, p in fixed})


def _located(root: Node, path: tuple[str, ...]) -> Node | None:
    """The element of a page that a wrapper's region is: by its place where the page has as many siblings of its kind as the wrapper, else the longest of them."""
    at = root
    for step in path:
        key, place, siblings = step.rsplit(":", 2)
        found = [x for x in at.children if isinstance(x, Node) and x.key == key and not x.out]
        if not found:
            return None
        at = found[int(place)] if len(found) == int(siblings) else max(found, key=_size)
    return at


def _hash(path: tuple[str, ...], text: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join((*path, text)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def text_of(page: str | None, path: tuple[str, ...] | None, same: frozenset[int] = frozenset()) -> str:
    """The main text of a page; path and same: as from `infer`."""
    if not page:
        return ""
    root = parse(page)
    if path is not None and (node := _located(root, path)) is not None:
        keys = tuple(x.rsplit(":", 2)[0] for x in path)
        return "\n\n".join((*_title(node, keys, same), *blocks(node, keys, same)))
    marked, body = [], root
    for node in _elements(root):
        if node.tag in _MAIN and not any(x.tag in _MAIN for x in _above(node)):
            marked.append(node)
        if node.tag == "body":
            body = node
    chosen = [x for x in marked if x.tag == "article"] or marked or [_densest(body)]
    return "\n\n".join(t for x in chosen for t in blocks(x))


def _title(node: Node, path: tuple[str, ...], same: frozenset[int]) -> list[str]:
    """Texts of headings just before the region, in the element around it."""
    if not path or node.parent is None:
        return []
    before = node.parent.children[: next(i for i, x in enumerate(node.parent.children) if x is node)]
    return [t for x in before if isinstance(x, Node) and _HEADING.fullmatch(x.tag) and not x.out and not x.doubt for t in blocks(x, (*path[:-1], x.key), same)]


def _above(node: Node) -> Iterator[Node]:
    while (node := node.parent) is not None:
        yield node


def _densest(body: Node) -> Node:
    """The element below body whose own blocks hold most text outside links."""
    best, most = body, sum(len(t) for t in _own(body))
    for node in _elements(body):
        if (n := sum(len(t) for t in _own(node))) > most:
            best, most = node, n
    return best


def _own(node: Node) -> Iterator[str]:
    """Text directly in node or in its paragraphs, headings and inline elements."""
    for x in node.children:
        if isinstance(x, str):
            if t := x.strip():
                yield t
        elif not x.out and not x.doubt and (x.tag in _INLINE and x.tag != "a" or re.fullmatch(r"p|h\d|blockquote|pre", x.tag)):
            yield from _own(x)


def host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][-+.a-zA-Z0-9]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def layout(html) -> F.Column:
    """A hash of the different container tags of a page, with their attributes but for digits."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<((?:div|section|article|main|table|body|form|aside)\b[^<>]{0,200})>"), F.lit(1))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, lambda x: F.regexp_replace(x, r"\d+", "0")))))


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    pages = small_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host(F.col("url")))
    order = [F.xxhash64("page_id"), F.col("page_id")]
    ids = pages.where("html IS NOT NULL AND html <> '' AND page_id IS NOT NULL").select("host", "page_id", layout(F.col("html")).alias("layout"))
    part = F.pmod(F.xxhash64("page_id", F.lit(1)), F.lit(64))
    for keys in ([F.col("host"), F.col("layout"), part], [F.col("host"), F.col("layout")]):  # a hot host is first cut down in 64 parts
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= sample)
    for keys in ([F.col("host"), F.pmod("layout", F.lit(64))], [F.col("host")]):  # all layouts before the second page of one
        ids = ids.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("r", *order))).where(F.col("k") <= sample)
    ids = stage(ids.select("host", "page_id"), "sample")  # written, so that Spark knows how small it is and moves no page
    chosen = pages.join(ids.withColumnRenamed("page_id", "i").withColumnRenamed("host", "h"), (F.col("page_id") == F.col("i")) & (F.col("host") == F.col("h"))).select("host", "page_id", "html")

    def learn(table: pa.Table) -> pa.Table:
        t = table.sort_by([("page_id", "ascending"), ("html", "ascending")])
        path, same = infer(list(dict.fromkeys(t.column("html").to_pylist()))[:sample])
        return pa.table({"host": t.column("host").slice(0, 1).cast(pa.string()), "path": pa.array([None if path is None else list(path)], pa.list_(pa.string())), "same": pa.array([same], pa.list_(pa.int64()))})

    wrappers = stage(chosen.groupBy("host").applyInArrow(learn, "host string, path array<string>, same array<long>"), "wrappers")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("html", "path", "same")), strict=True)
            texts = [text_of(x, None if p is None else tuple(p), frozenset(same or ())) for x, p, same in rows]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.join(wrappers, "host", "left").select("page_id", "url", "html", "path", "same").mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
