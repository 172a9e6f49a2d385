"""HTML documents as trees and as a table of nodes, with places in the text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.tables import UNREAD, VOID
from tessella.sources.partitions import dealt

# Possessive throughout: a tag is read once, and only the end of the text can leave it unfinished.
_START = re.compile(r"""<([a-zA-Z][^\s/>]*+)(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+>""")
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+""")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
# Which start tags end an open element of which name, and what bounds the search.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    **dict.fromkeys("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), {"p"}),
}
_BOUND = {"html", "body", "ul", "ol", "dl", "table", "div", "section", "article", "button", "td", "th", "select"}
_IMPLIED = frozenset().union(*_ENDS.values())
_HEAD = {"head", "title", "meta", "link", "style", "script", "base"}
# Formatting elements, which open again in the next block if they were not closed, and what they don't cross.
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_MARKERS = frozenset("applet caption marquee object td template th".split())
_BLOCKS = frozenset(_ENDS) | {"html", "head", "body", "tbody", "thead", "tfoot", "caption", "colgroup", "col"}
#: Like elements that open again at once, and the depth at which none do.
ALIKE, DEEPEST = 3, 512


_OPAQUE = frozenset(("component", "spread", "classes"))


@dataclass(eq=False)
class Node:
    """kind: fragment, element, text or comment; spans are (start, end) or None where synthetic."""

    kind: str
    tag: str = ""
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    attrs: list[tuple[str, str | bool, tuple[int, int] | None]] = field(default_factory=list)
    text: str = ""
    open: tuple[int, int] | None = None
    close: tuple[int, int] | None = None
    start: int = 0
    end: int = 0
    whole: dict[str, tuple[int, int]] = field(default_factory=dict)  # each attribute's place with its name
    #: What a component template leaves open: ``component``, ``spread``, ``classes`` (a class list made by code),
    #: ``dynamic`` children, ``ref``, ``raw`` markup; ``island``: its place is one in code.
    flags: frozenset[str] = frozenset()
    segments: list[tuple[int, int]] = field(default_factory=list)  # places of the static parts of a class list
    chunks: list[tuple] | None = None  # the entries of a style object

    def attr(self, name: str) -> str | bool | None:
        return next((v for n, v, _ in self.attrs if n == name), None)

    @property
    def classes(self) -> list[str]:
        v = self.attr("class")
        return v.split() if isinstance(v, str) else []

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if c.kind == "element"]

    @property
    def opaque(self) -> bool:
        return any(n in ("id", "contenteditable") or n.startswith("on") for n, _, _ in self.attrs) or self.open is None or not _OPAQUE.isdisjoint(self.flags)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))


def _attributes(text: str, head: int, end: int, whole: dict[str, tuple[int, int]]) -> list[tuple[str, str | bool, tuple[int, int] | None]]:
    out, seen = [], set()
    for m in _ATTR.finditer(text, head, end):
        name = m[1].lower()
        if name in seen:
            continue
        seen.add(name)
        whole[name] = m.span()
        raw = m[2]
        value = raw[1:-1] if raw and raw[0] in "\"'" else raw or ""
        out.append((name, (html.unescape(value) if "&" in value else value) or True, m.span(2) if raw else None))
    return out


def tokens(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, name, start, end) of the tags and comments of a text, in one pass; what follows the
    start of a tag that never ends is text.  To skip raw text send the place to go on from."""
    at, last, cdata = 0, text.rfind(">"), True
    while (at := text.find("<", at)) >= 0:
        if at > last:  # no tag ends any more, but a comment may run to the end
            if (at := text.find("<!--", at)) >= 0:
                yield "comment", "", at, len(text)
            return
        nxt, go = text[at + 1], None
        if nxt.isascii() and nxt.isalpha():
            m = _START.match(text, at)
            if m is None:  # the text ends inside it
                return
            go = yield "start", m[1].lower(), at, m.end()
            at = m.end()
        elif nxt == "/" and text[at + 2].isascii() and text[at + 2].isalpha():
            end = text.index(">", at) + 1
            go = yield "end", re.match(r"[^\s/>]+", text[at + 2 : end]).group().lower(), at, end
            at = end
        elif text.startswith("<!--", at):
            end = at + 5 if text[at + 4] == ">" else at + 6 if text.startswith("->", at + 4) else text.find("-->", at + 4) + 3
            end = len(text) if end == 2 else end
            go = yield "comment", "", at, end
            at = end
        elif nxt in "!?":
            end = text.find("]]>", at) if cdata and text.startswith("<![CDATA[", at) else -1
            if end < 0 and text.startswith("<![CDATA[", at):
                cdata = False  # none further on either
            end = end + 3 if end >= 0 else text.index(">", at) + 1
            go = yield "other", "", at, end
            at = end
        else:
            at += 1
        if go is not None:
            at = go
            yield "skipped", "", at, at


class _Builder:
    """The open elements of a document, found by name and by role without walking the stack."""

    def __init__(self, text: str):
        self.text, self.root = text, Node("fragment", end=len(text))
        self.page = Node("element", "html", self.root)
        self.root.children.append(self.page)
        self.top: dict[str, Node] = {"html": self.page}
        self.stack: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.marks: list[int] = []  # places of what ends or bounds an implied end
        self.left_open: list[Node | None] = []  # formatting elements to open again, None where a marker stands
        self.reopened, self.tags = 0, 0
        self.push(self.page)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _BOUND or node.tag in _IMPLIED:
            self.marks.append(len(self.stack))
        if node.tag in _MARKERS:
            self.left_open.append(None)
        self.stack.append(node)

    def add(self, node: Node) -> None:
        node.parent = self.stack[-1]
        node.parent.children.append(node)

    def supply(self, name: str) -> Node:
        if name not in self.top:
            self.top[name] = Node("element", name, self.page)
            self.page.children.append(self.top[name])
        return self.top[name]

    def ensure(self, name: str) -> None:
        if len(self.stack) == 1:
            if name == "body":
                self.supply("head")
            self.push(self.supply(name))

    def close_to(self, k: int, at: tuple[int, int] | None, end: int) -> None:
        """Ends the elements from place ``k`` on; ``at`` is the span of that one's own end tag."""
        popped, inner = self.stack[k:], None
        del self.stack[k:]
        for j in range(len(popped) - 1, -1, -1):
            n = popped[j]
            n.end = end
            self.places[n.tag].pop()
            if self.marks and self.marks[-1] == k + j:
                self.marks.pop()
            if n.tag in _MARKERS:
                inner = j
                while self.left_open and self.left_open.pop() is not None:
                    pass
        self.left_open += [n for j, n in enumerate(popped[:inner]) if n.tag in _FORMATTING and (j or not at)]
        if at:
            popped[0].close, popped[0].end = at, at[1]

    def reopen(self, pos: int) -> None:
        """Opens again, without a span of their own, the formatting elements that a block's end cut off."""
        if not self.left_open or self.left_open[-1] is None:
            return
        alike: dict[tuple, int] = {}
        todo: list[Node] = []
        while self.left_open and self.left_open[-1] is not None:
            n = self.left_open.pop()
            key = (n.tag, *((a, v) for a, v, _ in n.attrs))
            alike[key] = alike.get(key, 0) + 1
            if alike[key] <= ALIKE:
                todo.append(n)
        for n in reversed(todo):
            if len(self.stack) < DEEPEST and self.reopened < 4 * self.tags + 100:
                self.reopened += 1
                again = Node("element", n.tag, attrs=[(a, v, None) for a, v, _ in n.attrs], start=pos, end=pos)
                self.add(again)
                self.push(again)

    def forget(self, name: str) -> None:
        """An end tag for a formatting element that is not open now."""
        for j in range(len(self.left_open) - 1, max(len(self.left_open) - DEEPEST, 0) - 1, -1):
            if self.left_open[j] is None:
                return
            if self.left_open[j].tag == name:
                del self.left_open[j]
                return

    def characters(self, s: int, e: int) -> None:
        piece = self.text[s:e]
        blank = piece.isspace()
        if blank and len(self.stack) == 1:
            return
        if not blank:
            if len(self.stack) == 2 and self.stack[1].tag == "head":
                self.close_to(1, None, s)
            self.ensure("body")
        self.reopen(s)
        self.add(Node("text", text=html.unescape(piece) if "&" in piece else piece, start=s, end=e))

    def end_tag(self, name: str, s: int, e: int) -> None:
        if name == "html":
            if len(self.stack) > 1:
                self.close_to(1, None, s)
            self.page.close = (s, e)
            return
        places = self.places.get(name)
        if not places:
            if name in _FORMATTING:
                self.forget(name)
            return
        k = places[-1]
        if name in ("div", "span", "p") and any(self.places.get(x, [-1])[-1:] > [k] for x in ("td", "th", "table")):
            return
        self.close_to(k, (s, e), e)

    def start_tag(self, name: str, s: int, e: int) -> Node | None:
        """The element, unless it is one of html, head and body, which there is once each."""
        self.tags += 1
        whole: dict[str, tuple[int, int]] = {}
        stack, attrs = self.stack, _attributes(self.text, s + 1 + len(name), e - 1, whole)
        if name in ("html", "head", "body"):
            if name == "body" and len(stack) > 1 and stack[1].tag == "head":
                self.close_to(1, None, s)
            if name not in self.top:
                self.ensure(name)
            known = self.supply(name)
            if known.open is None:
                known.open, known.start, known.attrs = (s, e), s, attrs
            return None
        if len(stack) == 1:
            self.ensure("head" if name in _HEAD and "body" not in self.top else "body")
        elif len(stack) == 2 and stack[1].tag == "head" and name not in _HEAD:
            self.close_to(1, None, s)
            self.ensure("body")
        ends = _ENDS.get(name, ())
        for k in reversed(self.marks) if ends else ():
            tag = stack[k].tag
            if tag in ends:
                self.close_to(k, None, s)
                break
            if tag in _BOUND and not (name in ("tr", "td", "th") and tag in ("td", "th")):
                break
        if name in ("a", "nobr"):  # these don't nest
            if (open_ := self.places.get(name)) and not any(self.places.get(x, [-1])[-1:] > open_[-1:] for x in _MARKERS):
                self.close_to(open_[-1], None, s)
            self.forget(name)
        if name not in _BLOCKS and name not in _HEAD:
            self.reopen(s)
        node = Node("element", name, attrs=attrs, open=(s, e), start=s, end=e, whole=whole)
        self.add(node)
        if not (name in VOID or self.text[e - 2] == "/" and name in ("path", "circle", "rect", "use", "line", "g")):
            self.push(node)
        return node


def parse(text: str) -> Node:
    """The tree of a document, in time proportional to its length; html, head and body are supplied
    where the text leaves them out.

    Tags that subtrees of UNREAD elements hold are not looked into.  Formatting elements that the end
    of their block cuts off open again in what follows.
    """
    b, pos, n = _Builder(text), 0, len(text)
    source = tokens(text)
    for kind, name, s, e in source:
        if s > pos:
            b.characters(pos, s)
        pos = e
        if kind == "comment":
            b.add(Node("comment", text=text[s + 4 : e - 3 if text.endswith("-->", s, e) else e], start=s, end=e))
        elif kind == "end":
            b.end_tag(name, s, e)
        elif kind == "start":
            node = b.start_tag(name, s, e)
            if node is not None and b.stack[-1] is node and (name in UNREAD or name in _RAW):
                shut = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(text, e)
                end = shut.start() if shut else n
                if end > e and name not in UNREAD:
                    node.children.append(Node("text", parent=node, text=text[e:end], start=e, end=end))
                b.close_to(len(b.stack) - 1, shut.span() if shut else None, shut.end() if shut else n)
                pos = node.end
                source.send(pos)
    if pos < n:
        b.characters(pos, n)
    for node in b.stack:
        node.end = node.end if node.close else n
    for where in ("head", "body"):
        b.supply(where)
    return b.root


_NODES = "doc_id long, node_id int, parent_id int, ordinal int, depth int, kind string, tag string, text_value string, span_s int, span_e int, classes array<string>, n_elements int, attrs map<string,string>, opaque boolean"


def nodes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each node in pre-order; node 0 is the root fragment.  Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None:
                    continue
                above: dict[Node, tuple[int | None, int, int]] = {}  # parent's number, own place there, depth
                for k, n in enumerate(parse(t).walk()):
                    up, ordinal, depth = above.pop(n, (None, 0, 0))
                    above.update((c, (k, j, depth + 1)) for j, c in enumerate(n.children))
                    rows.append((i, k, up, ordinal, depth, n.kind, n.tag, n.text or None, n.start, n.end, n.classes, len(n.elements), [(a, "" if v is True else v) for a, v, _ in n.attrs], n.kind == "element" and n.opaque))
            types = (pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.map_(pa.string(), pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 14, types)], [x.split()[0] for x in _NODES.split(", ")])

    return dealt(docs.select(F.col(key).cast("long"), F.col(text))).mapInArrow(run, _NODES)


def ancestors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, node_id, ancestor_id, distance, tag): of each element the elements around it, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                number: dict[Node, int] = {}
                for k, n in enumerate(parse(t).walk() if t is not None else ()):
                    number[n] = k
                    up, far = n.parent, 0
                    while n.kind == "element" and up is not None and up.kind == "element":
                        far += 1
                        rows.append((i, k, number[up], far, up.tag))
                        up = up.parent
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], ["doc_id", "node_id", "ancestor_id", "distance", "tag"])

    return dealt(docs.select(F.col(key).cast("long"), F.col(text))).mapInArrow(run, "doc_id long, node_id int, ancestor_id int, distance int, tag string")


def closest(around: DataFrame, tag: str) -> DataFrame:
    """(doc_id, node_id, ancestor_id): of each element the nearest ancestor of a tag."""
    return around.where(F.col("tag") == tag).groupBy("doc_id", "node_id").agg(F.min_by("ancestor_id", "distance").alias("ancestor_id"))
