"""One document at a time: flatten inert wrappers, shorten class lists, splice the edits.

Documents don't depend on each other, so the whole chain is a map without a shuffle.
"""

from __future__ import annotations

import heapq
import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

from tessella.functions.styles import inherits, inline_chunks, is_relative
from tessella.functions.tables import PAINTLESS, VISUAL
from tessella.sources.markup import Node, parse
from tessella.sources.templates import PARSERS
from tessella.sources.stylesheet import BASE, Sheet
from tessella.sources.utilities import Utilities

SWEEPS = 16
#: The name of the class attribute.
_CLASS = {"html": "class", "vue": "class", "astro": "class", "jsx": "className", "tsx": "className"}
UNIVERSE = 20
_VISUAL, _PAINTLESS = frozenset(VISUAL), frozenset(PAINTLESS)
_ALIGN = ("place-self", "align-self", "justify-self")
_NEUTRAL = ("auto", "normal", "auto auto", "")
Style = dict[tuple[str, str], tuple[str, bool]]


def resolve(tokens: list[str], sheet: Sheet | Utilities) -> tuple[Style, list[str]]:
    """The style that a class list resolves to, and its tokens without a rule of their own."""
    return sheet.resolve(tokens)


# ---- cover ----------------------------------------------------------------------------------


def covers(target: Style, sheet: Sheet | Utilities) -> tuple[list[str], bool]:
    """The cheapest classes (length and a space each) whose rules give exactly ``target``; whether they do.

    Conditions share no declaration, so each is solved alone; the union is resolved anew as a proof.
    """
    if not target:
        return [], True
    fitting = sheet.fitting(target)
    found, whole = [], True
    for cond in dict.fromkeys(c for c, _ in target) if all(len({c for (c, _), _ in mine}) == 1 for mine in fitting.values()) else (None,):
        part = {k: d for k, d in target.items() if cond in (None, k[0])}
        own = {t: mine for t, mine in fitting.items() if cond in (None, mine[0][0][0])}
        some, ok = _cover(part, own, sheet.overlap)
        found, whole = found + some, whole and ok
    found = sorted(set(found))
    return found, whole and resolve(found, sheet)[0] == target


def _cover(target: Style, fitting: dict[str, list], overlap: bool) -> tuple[list[str], bool]:
    bit = {(k, d): 1 << n for n, (k, d) in enumerate(target.items())}
    masks = {token: sum(bit[x] for x in mine) for token, mine in fitting.items()}
    best: dict[int, tuple[int, str]] = {}
    for token, mask in masks.items():
        if mask not in best or (len(token) + 1, token) < best[mask]:
            best[mask] = (len(token) + 1, token)
    full = (1 << len(bit)) - 1
    if len(bit) <= UNIVERSE:
        # cheapest way to each set of covered declarations, always covering the lowest missing one next
        cost: dict[int, tuple[int, tuple[str, ...]]] = {0: (0, ())}
        by_bit = [[(m, c, token) for m, (c, token) in best.items() if m >> n & 1] for n in range(len(bit))]
        todo = [0]  # a step only adds bits, so what it reaches comes later in ascending order
        while todo and (mask := heapq.heappop(todo)) != full:
            done, chosen = cost[mask]
            for m, c, token in by_bit[(~mask & (mask + 1)).bit_length() - 1]:
                if mask | m not in cost:
                    heapq.heappush(todo, mask | m)
                elif done + c >= cost[mask | m][0]:
                    continue
                cost[mask | m] = (done + c, (*chosen, token))
        if full in cost:
            return list(cost[full][1]), True
    left, found = full, []
    if not overlap:  # rules with the most declarations first, none of them covered yet
        for token, mask in sorted(masks.items(), key=lambda x: -x[1].bit_count()):
            if mask & left == mask:
                left &= ~mask
                found.append(token)
    while left and overlap:  # the most of what is missing, then the fewest declarations, then the first by name
        token = min(masks, key=lambda t: (-(masks[t] & left).bit_count(), masks[t].bit_count(), t), default=None)
        if token is None or not masks[token] & left:
            break
        left &= ~masks[token]
        found.append(token)
    return found, left == 0


# ---- patterns -------------------------------------------------------------------------------


@dataclass
class Document:
    text: str
    sheet: Sheet | Utilities
    root: Node
    style: dict[Node, Style] = field(default_factory=dict)
    unknown: dict[Node, list[str]] = field(default_factory=dict)
    removed: list[Node] = field(default_factory=list)
    dirty: set[Node] = field(default_factory=set)
    barred: set[Node] = field(default_factory=set)
    lists: dict[Node, list[str]] = field(default_factory=dict)
    inline: dict[Node, list[str]] = field(default_factory=dict)  # what stays of style attributes
    sweeps: int = 0
    nodes: int = 0
    gone: set[Node] = field(default_factory=set)

    kind: str = "html"
    parts: list[tuple[int, int, str]] = field(default_factory=list)  # static parts of class lists, rewritten

    @classmethod
    def of(cls, text: str, sheet: Sheet | Utilities, kind: str = "html") -> Document | None:
        root = PARSERS[kind](text)
        if root is None:
            return None
        doc = cls(text, sheet, root, kind=kind)
        for n in doc.root.walk():
            doc.nodes += 1
            if n.kind == "element":
                doc.style[n], doc.unknown[n] = resolve(n.classes, sheet) if n.attrs else ({}, [])
        return doc

    def values(self, n: Node, prop: str) -> list[tuple[str, str]]:
        return [(c, v) for (c, p), (v, _) in self.style[n].items() if p == prop]

    def coupled(self, n: Node) -> bool:
        return any(self.sheet.coupled(t) for t in n.classes)


def paints(doc: Document, n: Node) -> bool:
    return bool(doc.unknown[n]) or any(p in _VISUAL and v not in _PAINTLESS for (_, p), (v, _) in doc.style[n].items())


def _has(doc: Document, n: Node, **props: str) -> bool:
    return all(doc.style[n].get((BASE, p.replace("_", "-")), ("",))[0] == v for p, v in props.items())


def _bare(n: Node) -> bool:
    return all(a == "class" for a, _, _ in n.attrs)


def _display_in(doc: Document, n: Node, *ok: str) -> bool:
    return all(v in ok for _, v in doc.values(n, "display"))


@dataclass(frozen=True)
class Pattern:
    """name, safety level, tags, further test, and what the child gains in the base condition."""

    name: str
    safety: int
    tags: tuple[str, ...]
    test: Callable[[Document, Node], bool]
    gain: tuple[tuple[str, str], ...] = ()


_CENTRE = (("align-self", "center"), ("justify-self", "center"))
PATTERNS = (
    Pattern("flex-center", 2, ("div",), lambda d, n: _has(d, n, display="flex", align_items="center", justify_content="center") and not paints(d, n), _CENTRE),
    Pattern("grid-center", 2, ("div",), lambda d, n: _has(d, n, display="grid", align_items="center", justify_content="center") and not paints(d, n), _CENTRE),
    Pattern("display-contents", 2, ("div",), lambda d, n: _has(d, n, display="contents") and _bare(n) and not paints(d, n)),
    Pattern("empty-style", 1, ("div",), lambda d, n: _display_in(d, n, "block") and not paints(d, n)),
    Pattern("inherited-only", 2, ("div", "span"), lambda d, n: bool(d.style[n]) and all(inherits(p) for _, p in d.style[n])),
    Pattern("passthrough", 2, ("div",), lambda d, n: _bare(n) and not paints(d, n)),
    Pattern("redundant-inline", 2, ("span",), lambda d, n: _display_in(d, n, "inline") and _bare(n) and not paints(d, n)),
)


#: What keeps an element from being unwrapped, besides opacity.
_UNFIT = frozenset(("ref", "dynamic", "raw"))
_ISLAND = frozenset(("island",))


def first_match(doc: Document, n: Node, ceiling: int, patterns=PATTERNS) -> Pattern | None:
    """The first pattern in order that fits an element which nothing forbids to unwrap."""
    if n.kind != "element" or n.parent is None or len(n.elements) != 1 or any(a.startswith("on") for a, _, _ in n.attrs):
        return None
    if any("component" in c.flags for c in n.elements):
        return None
    if n.flags and (not _UNFIT.isdisjoint(n.flags) or "island" in n.flags and sum(c.kind != "text" or bool(c.text.strip()) for c in n.children) != 1):
        return None
    if doc.coupled(n) or any(doc.coupled(c) for c in n.elements):
        return None
    return next((p for p in patterns if p.safety <= ceiling and n.tag in p.tags and p.test(doc, n)), None)


# ---- the gate -------------------------------------------------------------------------------


def _centring(doc: Document, w: Node, child: Node, before: Style, after: Style) -> bool:
    parent = w.parent
    if parent is None or parent.kind != "element":
        return False
    shown = doc.values(parent, "display")
    if (BASE, "grid") not in shown or any(v != "grid" for _, v in shown):
        return False
    if any(v not in ("normal", "stretch") for p in ("align-items", "justify-items", "place-items") for _, v in doc.values(parent, p)):
        return False
    for (c, p), (v, _) in doc.style[w].items():
        if p == "display":
            fine = c == BASE and v in ("flex", "grid")
        elif p in ("align-items", "justify-content"):
            fine = c == BASE and v == "center"
        elif p in ("position", "transform"):
            fine = v == ("static" if p == "position" else "none")
        else:
            fine = inherits(p) or before.get((c, p), ("",))[0] == v
        if not fine:
            return False
    if any(x.kind == "text" and x.text.strip() for x in w.children):
        return False
    if any(p in _ALIGN and v not in _NEUTRAL for (_, p), (v, _) in before.items()):
        return False
    return all(after.get((BASE, p), ("",))[0] == v for p, v in _CENTRE)


def verdict(doc: Document, w: Node, child: Node, after: Style) -> str:
    """``safe``, or why the unwrap may change what is seen."""
    before = doc.style[child]
    if doc.unknown[w]:
        return "unresolved"
    if _centring(doc, w, child, before, after):
        return "safe"
    for (c, p), (v, _) in doc.style[w].items():
        if p == "display" and v not in ("block", "contents") or p == "position" and v != "static" or p == "transform" and v != "none":
            return "child context"
    for (c, p), (v, _) in doc.style[w].items():
        if p not in ("display", "position", "transform") and not inherits(p) and after.get((c, p), ("",))[0] != v:
            return "drops style"
    gained = any(p in _ALIGN and v not in _NEUTRAL and before.get((c, p), ("",))[0] != v for (c, p), (v, _) in after.items())
    if gained and not any(c == BASE and v in ("flex", "inline-flex", "grid", "inline-grid") for c, v in (doc.values(w.parent, "display") if w.parent.kind == "element" else [])):
        return "parent context"
    return "safe"


def flatten(doc: Document, ceiling: int = 2, patterns=PATTERNS, verdicts: list | None = None, gate: str = "provably-safe") -> None:
    """Sweeps in document order until nothing changes or a tree comes again, SWEEPS at most; a refused
    wrapper is not tried again."""
    tags, seen = {t for p in patterns for t in p.tags}, set()
    left = [n for n in doc.style if n.tag in tags]  # in document order
    while doc.sweeps < SWEEPS:
        doc.sweeps += 1
        gone: dict[Node, list[Node]] = {}
        for w in left:
            if w in doc.barred or (p := first_match(doc, w, ceiling, patterns)) is None:
                continue
            if w.opaque:  # its floor refuses every op
                continue
            child = w.elements[0]
            after = dict(doc.style[child])
            for k, (v, important) in doc.style[w].items():
                if inherits(k[1]) and not is_relative(v):
                    after.setdefault(k, (v, important))
            if p.gain and not child.opaque:
                after |= {(BASE, name): (v, False) for name, v in p.gain}
            why = "safe" if gate == "all" else verdict(doc, w, child, after)
            if why == "safe" and after != doc.style[child] and covers(doc.style[child], doc.sheet)[1] and not covers(after, doc.sheet)[1]:
                why = "residual"
            if verdicts is not None:
                verdicts.append((w, p.name, why))
            if why != "safe":
                doc.barred.add(w)
                continue
            if after != doc.style[child]:
                doc.style[child] = after
                doc.dirty.add(child)
            for c in w.children:
                c.parent = w.parent
                c.flags |= w.flags & _ISLAND
            doc.removed.append(w)
            doc.gone.add(w)
            gone[w] = w.children
        if not gone:
            return
        _put_in_place(doc.root, gone)
        left = [n for n in left if n not in gone]
        if doc.sweeps > 2:  # a tree that was there before would come again
            if (now := fingerprint(doc.root)) in seen:
                return
            seen.add(now)


def unfragment(doc: Document) -> None:
    """Fragments with exactly one child, of any kind, and no flags go."""
    for n in [n for n in doc.root.walk() if n.kind == "fragment" and n is not doc.root]:
        only = [c for c in n.children if c.kind != "text" or c.text.strip()]
        fits = len(only) == 1 and only[0].kind == "element" and (len(n.children) == 1 or "island" in n.flags)
        if fits and not n.attrs and n.parent is not None and n.close and _UNFIT.isdisjoint(n.flags):
            for c in n.children:
                c.parent = n.parent
                c.flags |= n.flags & _ISLAND
            doc.removed.append(n)
            doc.gone.add(n)
            _put_in_place(doc.root, {n: n.children})


def fingerprint(root: Node) -> int:
    """Of a tree's nodes and their order."""
    return hash(tuple((id(n), n.kind) for n in root.walk()))


def _put_in_place(root: Node, gone: dict[Node, list[Node]]) -> None:
    """Each removed wrapper's children in its place, in one pass over the tree."""
    todo = [root]
    while todo:
        n = todo.pop()
        if any(c in gone for c in n.children):
            now, left = [], n.children[::-1]
            while left:
                c = left.pop()
                if c in gone:
                    left += reversed(gone[c])
                else:
                    now.append(c)
            n.children = now
        todo += n.children


def _rewritten(doc: Document, n: Node, target: Style) -> list[str] | None:
    """The element's class list for ``target``: what may not go stays, then the cheapest cover of the rest;
    None unless it resolves to exactly that."""
    own = list(dict.fromkeys(n.classes))
    drop = [t for t in own if doc.sheet.knows(t) and doc.sheet.droppable(t)]
    kept = [t for t in own if t not in drop]
    base = resolve(kept, doc.sheet)[0]
    rest = {k: d for k, d in target.items() if base.get(k) != d}
    emitted, _ = covers(rest, doc.sheet)
    if not emitted and rest:
        return None
    new = [t for t in own if t in kept or t in emitted] + [t for t in emitted if t not in own]
    return new if new and resolve(new, doc.sheet)[0] == target else None


def compress(doc: Document) -> None:
    """Shortest class lists with the same resolved style, kept only if they resolve to it and aren't longer."""
    for n in doc.style:
        dirty = n in doc.dirty
        if not (n.attrs or dirty) or n.opaque or not (n.classes or dirty) or n in doc.gone:
            continue
        if not dirty and not any(doc.sheet.knows(t) and doc.sheet.droppable(t) for t in n.classes):
            continue
        new = _rewritten(doc, n, doc.style[n])
        if new is None or not dirty and len(" ".join(new)) > len(" ".join(n.classes)):
            continue
        if new != n.classes:
            doc.lists[n] = new


def compress_parts(doc: Document) -> None:
    """Static parts of class lists that code puts together, each alone: every token known, the same style, not
    longer, never empty."""
    for n in doc.style:
        for s, e in n.segments:
            own = doc.text[s:e].split()
            style, unknown = resolve(own, doc.sheet)
            if not own or unknown or "component" in n.flags or doc.coupled(n) or not all(doc.sheet.droppable(t) for t in own):
                continue
            emitted, exact = covers(style, doc.sheet)
            new = [t for t in own if t in emitted] + [t for t in emitted if t not in own]
            if exact and new and resolve(new, doc.sheet)[0] == style and len(" ".join(new)) < len(" ".join(own)):
                before, after = re.match(r"\s*", doc.text[s:e])[0], re.search(r"\s*\Z", doc.text[s:e])[0]
                doc.parts.append((s, e, f"{before}{' '.join(new)}{after}"))


def convert(doc: Document) -> None:
    """Declarations of style attributes as classes, where that is shorter and changes nothing.

    A declaration stays inline if it is important, a custom property, set by a class in another
    condition, or by a rule that a class list alone doesn't decide.  Elements are left alone that may
    not be rewritten, have a class without a rule of its own, or a style attribute that can't be read,
    that sets a longhand again, or that is taken part in by a flatten.
    """
    for n in doc.style:
        span = next((s for a, _, s in n.attrs if a == "style"), None) if n.attrs else None
        if n.chunks:
            s, e = n.whole["style"]
            span = (s + len("style="), e)
        if span is None or n in doc.gone or n.opaque or n in doc.dirty or n in doc.lists or doc.unknown[n]:
            continue
        chunks = n.chunks or inline_chunks(str(n.attr("style")))
        if not chunks or len({p for _, decls, _ in chunks for p, _ in decls}) < sum(len(decls) for _, decls, _ in chunks):
            continue
        own = next((s for a, _, s in n.attrs if a == "class"), None)
        if own is None and n.attr("class") is not None:
            continue
        other = {p for c, p in doc.style[n] if c != BASE}
        fits = lambda p: not p.startswith("--") and p not in other and not doc.sheet.competes(n.tag, n.classes, p)  # noqa: B023, E731
        go = [not important and all(fits(p) for p, _ in decls) for _, decls, important in chunks]
        if not any(go):
            continue
        target = doc.style[n] | {(BASE, p): (v, False) for (_, decls, _), ok in zip(chunks, go) if ok for p, v in decls}
        new = _rewritten(doc, n, target)
        if new is None:
            continue
        keep = [text for (text, _, _), ok in zip(chunks, go) if not ok]
        size = lambda text: len(" ".join(text))
        before = (own[1] - own[0] if own else 0) + span[1] - span[0] + len(" style=")
        rest = (len(" style={{}}") + len(", ".join(keep)) if n.chunks else len(' style=""') + len("; ".join(keep))) if keep else 0
        after = (size(new) + 2 if own else size(new) + len(f' {_CLASS[doc.kind]}=""')) + rest
        if after < before:
            doc.lists[n], doc.inline[n], doc.style[n] = new, keep, target


def edits(doc: Document) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, replacement)."""
    kept = sorted((n.start, n.end) for n in doc.root.walk() if n.kind != "fragment" and n.end > n.start) if doc.removed else []
    starts = [s for s, _ in kept]
    least = [*itertools.accumulate((e for _, e in reversed(kept)), min)][::-1]  # end among those that start here or later

    def inside(w: Node) -> bool:
        """Whether a node that stays lies within the wrapper and is not all of it."""
        after, here = bisect_right(starts, w.start), bisect_left(starts, w.start)
        return after < len(starts) and least[after] <= w.end or here < len(starts) and least[here] < w.end

    out = list(doc.parts)
    for w in doc.removed:
        if "island" in w.flags:  # no blanks may come to stand at an expression's start
            only = next(c for c in w.children if c.kind != "text" or c.text.strip())
            out += [(w.start, only.start, ""), (only.end, w.end, "")]
        elif w.close and inside(w):
            out += [(*w.open, ""), (*w.close, "")]
        elif not inside(w):
            out.append((w.start, w.end, ""))
        else:
            out.append((*w.open, ""))
    for n, new in doc.lists.items():
        span = next((s for a, _, s in n.attrs if a == "class"), None)
        if span:
            quote = doc.text[span[0]] if doc.text[span[0]] in "\"'`" else '"'
            out.append((*span, f"{quote}{' '.join(new)}{quote}"))
        elif n.attr("class") is None:
            at = n.open[0] + 1 + len(n.tag)
            out.append((at, at, f' {_CLASS[doc.kind]}="{" ".join(new)}"'))
    for n, keep in doc.inline.items():
        s, e = n.whole["style"]
        if keep and n.chunks:
            out.append((s, e, f"style={{{{{', '.join(keep)}}}}}"))
        elif keep:
            span = next(x for a, _, x in n.attrs if a == "style")
            quote = doc.text[span[0]] if doc.text[span[0]] in "\"'" else '"'
            out.append((*span, f"{quote}{'; '.join(keep)}{quote}"))
        else:
            out.append((s - (doc.text[s - 1].isspace()), e, ""))
    return sorted(out)


def splice(text: str, changes: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, r in changes:
        if s < at:
            continue
        out += [text[at:s], r]
        at = e
    return "".join([*out, text[at:]])


@dataclass(frozen=True)
class Options:
    """ceiling: the greatest safety level; patterns: names of those that may run, None for all."""

    ceiling: int = 2
    patterns: tuple[str, ...] | None = None
    compress: bool = True
    convert: bool = True
    #: ``css``: classes mean what the stylesheet says; ``utility``: what the utility vocabulary says.
    provider: str = "css"
    #: ``provably-safe``: only what the gate proves to change nothing that is seen; ``all``: whatever a pattern asks
    #: for and classes can still say.
    gate: str = "provably-safe"

    def __post_init__(self):
        unknown = set(self.patterns or ()) - {p.name for p in PATTERNS}
        if self.gate not in ("provably-safe", "all"):
            raise ValueError(f"no gate {self.gate!r}")
        if self.provider not in ("css", "utility"):
            raise ValueError(f"no provider {self.provider!r}")
        if unknown or not 0 <= self.ceiling <= 3:
            raise ValueError(f"unknown patterns {sorted(unknown)}" if unknown else f"no safety level {self.ceiling}")


def optimized(text: str, sheet: Sheet | Utilities, options: Options = Options(), kind: str = "html") -> tuple[str, int, int, dict[str, int]]:
    """New text, nodes before, nodes removed, and what each phase did."""
    doc = Document.of(text, sheet, kind)
    if doc is None:
        return text, 0, 0, dict.fromkeys(("flatten", "compress", "convert", "sweeps", "refused"), 0)
    if options.patterns is None:
        unfragment(doc)
    flatten(doc, options.ceiling, PATTERNS if options.patterns is None else [p for p in PATTERNS if p.name in options.patterns], gate=options.gate)
    if options.compress:
        compress(doc)
        compress_parts(doc)
    shorter = len(doc.lists) + len(doc.parts)
    if options.convert and kind not in ("vue", "astro"):
        convert(doc)
    ops = {"flatten": len(doc.removed), "compress": shorter, "convert": len(doc.inline), "sweeps": doc.sweeps, "refused": len(doc.barred)}
    return splice(text, edits(doc)), doc.nodes, len(doc.removed), ops


# ---- fragments ------------------------------------------------------------------------------

_FROZEN = {"script", "style", "template", "pre", "textarea", "svg", "math"}


def _contents_only(style: str) -> bool:
    d = [x.strip() for x in style.split(";") if x.strip()]
    if len(d) != 1:
        return False
    name, colon, value = d[0].partition(":")
    return bool(colon) and name.strip().lower() == "display" and value.strip().lower() == "contents"


def _shielded(n: Node) -> bool:
    return n.tag in _FROZEN or any(a.startswith("on") for a, _, _ in n.attrs)


def _inert(n: Node, only: Node) -> bool:
    """Whether an element with one child, ``only`` once its wrappers are gone, does nothing for it."""
    if n.tag not in ("div", "span") or n.open is None or n.close is None:
        return False
    if n.attrs and not (len(n.attrs) == 1 and n.attrs[0][0] == "style" and _contents_only(str(n.attrs[0][1]))):
        return False
    return only.kind == "element" and not _shielded(only)


def optimize_fragment(text: str | None) -> str | None:
    """A fragment without its inert wrappers, bottom up; unchanged unless its tags all pair and nest,
    if it is a whole document, or if a style element stands in it."""
    if not text or "<" not in text:
        return text
    root = parse(text)
    found = [n for n in root.walk() if n.kind == "element" and n.open]
    if any(n.tag in ("html", "head", "body", "style") for n in found) or not _round_trips(text, root):
        return text
    order, todo = [], [root]
    while todo:  # parents before children; nothing below a shielded element
        n = todo.pop()
        if n.kind != "element" or not _shielded(n):
            order.append(n)
            todo += n.children
    stands_for: dict[Node, Node] = {}
    for n in reversed(order):
        if n.kind == "element" and len(n.children) == 1:
            only = stands_for.get(n.children[0], n.children[0])
            if _inert(n, only):
                stands_for[n] = only
    return splice(text, sorted(itertools.chain.from_iterable(((*n.open, ""), (*n.close, "")) for n in stands_for)))


def _round_trips(text: str, root: Node) -> bool:
    from tessella.functions.tables import VOID

    return all(n.close is not None or n.tag in VOID for n in root.walk() if n.kind == "element" and n.open) and "<!" not in text.replace("<!--", "")
