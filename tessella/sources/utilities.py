"""Utility classes: what a token declares, and the cheapest tokens for a style.

The vocabulary is that of the public defaults of the common utility-class scheme, as far as the tables here
go: display, position, box alignment, spacing, sizes, offsets, gaps, radii, overflow, text and a few plain
colours, with states and breakpoints before them and arbitrary values in brackets.  Any other token is
unknown, so that elements that hold it are left as they are.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from functools import lru_cache

from tessella.functions.styles import canonical, expand
from tessella.functions.tables import CORNERS, SIDES
from tessella.sources.stylesheet import BASE

Tuples = dict[tuple[str, str], tuple[str, bool]]

# Steps of the spacing scale (quarters of a rem), fractions, and what else sizes may be.
STEPS = (0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 24, 28, 32, 36, 40, 44, 48, 52, 56, 60, 64, 72, 80, 96)
FRACTIONS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (1, 5), (2, 5), (3, 5), (4, 5), (1, 6), (5, 6))
SIZES = {"auto": "auto", "full": "100%", "min": "min-content", "max": "max-content", "fit": "fit-content"}
# Stems of one value and the longhands they set; some take auto, some go below zero.
SPACED = {
    "p": [f"padding-{s}" for s in SIDES], "px": ["padding-left", "padding-right"], "py": ["padding-top", "padding-bottom"],
    "pt": ["padding-top"], "pr": ["padding-right"], "pb": ["padding-bottom"], "pl": ["padding-left"],
    "m": [f"margin-{s}" for s in SIDES], "mx": ["margin-left", "margin-right"], "my": ["margin-top", "margin-bottom"],
    "mt": ["margin-top"], "mr": ["margin-right"], "mb": ["margin-bottom"], "ml": ["margin-left"],
    "gap": ["row-gap", "column-gap"], "gap-x": ["column-gap"], "gap-y": ["row-gap"],
    "inset": list(SIDES), "inset-x": ["left", "right"], "inset-y": ["top", "bottom"], "top": ["top"], "right": ["right"], "bottom": ["bottom"], "left": ["left"],
    "scroll-m": [f"scroll-margin-{s}" for s in SIDES], "scroll-p": [f"scroll-padding-{s}" for s in SIDES],
}
SIZED = {"size": ["width", "height"], "w": ["width"], "h": ["height"], "min-w": ["min-width"], "max-w": ["max-width"], "min-h": ["min-height"], "max-h": ["max-height"], "basis": ["flex-basis"]}
RADIUS = {"rounded": [f"border-{c}-radius" for c in CORNERS]}
AUTO = ("m", "mx", "my", "mt", "mr", "mb", "ml", "inset", "inset-x", "inset-y", "top", "right", "bottom", "left")
BELOW_ZERO = (*AUTO, "scroll-m")
RADII = {"none": "0px", "sm": "0.125rem", "": "0.25rem", "md": "0.375rem", "lg": "0.5rem", "xl": "0.75rem", "2xl": "1rem", "3xl": "1.5rem", "full": "9999px"}
TEXT_SIZES = {"xs": ("0.75rem", "1rem"), "sm": ("0.875rem", "1.25rem"), "base": ("1rem", "1.5rem"), "lg": ("1.125rem", "1.75rem"), "xl": ("1.25rem", "1.75rem"), "2xl": ("1.5rem", "2rem"), "3xl": ("1.875rem", "2.25rem"), "4xl": ("2.25rem", "2.5rem")}
COLOURS = {"white": "#fff", "black": "#000", "transparent": "transparent", "current": "currentColor", "inherit": "inherit"}
WEIGHTS = {"thin": 100, "extralight": 200, "light": 300, "normal": 400, "medium": 500, "semibold": 600, "bold": 700, "extrabold": 800, "black": 900}
ALIGNED = {"start": "flex-start", "end": "flex-end", "center": "center", "baseline": "baseline", "stretch": "stretch"}
SPREAD = {"start": "flex-start", "end": "flex-end", "center": "center", "between": "space-between", "around": "space-around", "evenly": "space-evenly", "stretch": "stretch", "normal": "normal"}
# Property and the tokens that set it, each with its value where that differs from the token.
PLAIN = {
    "display": "block inline-block inline flex inline-flex grid inline-grid contents table flow-root list-item hidden=none",
    "position": "static fixed absolute relative sticky",
    "visibility": "visible invisible=hidden collapse",
    "flex-direction": "flex-row=row flex-row-reverse=row-reverse flex-col=column flex-col-reverse=column-reverse",
    "flex-wrap": "flex-wrap=wrap flex-wrap-reverse=wrap-reverse flex-nowrap=nowrap",
    "flex-grow": "grow=1 grow-0=0", "flex-shrink": "shrink=1 shrink-0=0",
    "text-align": "text-left=left text-center=center text-right=right text-justify=justify text-start=start text-end=end",
    "font-style": "italic not-italic=normal", "text-transform": "uppercase lowercase capitalize normal-case=none",
    "white-space": "whitespace-normal=normal whitespace-nowrap=nowrap whitespace-pre=pre whitespace-pre-line=pre-line whitespace-pre-wrap=pre-wrap",
    "box-sizing": "box-border=border-box box-content=content-box", "isolation": "isolate isolation-auto=auto",
    "pointer-events": "pointer-events-none=none pointer-events-auto=auto", "cursor": "cursor-pointer=pointer cursor-default=default cursor-auto=auto",
}
# Variants and the condition that each adds.
MEDIA = {"sm": "(min-width: 640px)", "md": "(min-width: 768px)", "lg": "(min-width: 1024px)", "xl": "(min-width: 1280px)", "2xl": "(min-width: 1536px)", "dark": "(prefers-color-scheme: dark)", "print": "print"}
STATES = ("hover", "focus", "active", "visited", "focus-within", "focus-visible", "disabled", "checked")
#: Most declarations for which an exact cover is sought.
UNIVERSE = 20


def _longhands(*decls: tuple[str, str]) -> dict[str, str]:
    return {p: v for name, value in decls for p, v in expand(name, value)}


def _plain() -> dict[str, dict[str, str]]:
    out = {}
    for prop, tokens in PLAIN.items():
        for t in tokens.split():
            name, _, value = t.partition("=")
            out[name] = _longhands((prop, value or name))
    for k, v in ALIGNED.items():
        out[f"items-{k}"] = _longhands(("align-items", v))
        out[f"self-{k}"] = _longhands(("align-self", v))
    for k, v in SPREAD.items():
        out[f"justify-{k}"] = _longhands(("justify-content", v))
        out[f"content-{k}"] = _longhands(("align-content", v))
    for k in ("start", "end", "center", "stretch"):
        out[f"justify-items-{k}"] = _longhands(("justify-items", k))
        out[f"justify-self-{k}"] = _longhands(("justify-self", k))
        out[f"place-items-{k}"] = _longhands(("place-items", k))
        out[f"place-self-{k}"] = _longhands(("place-self", k))
        out[f"place-content-{k}"] = _longhands(("place-content", k))
    out["self-auto"] = _longhands(("align-self", "auto"))
    for k in ("auto", "hidden", "clip", "visible", "scroll"):
        out[f"overflow-{k}"] = _longhands(("overflow", k))
        out[f"overflow-x-{k}"], out[f"overflow-y-{k}"] = _longhands(("overflow-x", k)), _longhands(("overflow-y", k))
    for k in ("auto", "contain", "none"):
        out[f"overscroll-{k}"] = _longhands(("overscroll-behavior", k))
        out[f"overscroll-x-{k}"], out[f"overscroll-y-{k}"] = _longhands(("overscroll-behavior-x", k)), _longhands(("overscroll-behavior-y", k))
    for k, v in COLOURS.items():
        out[f"bg-{k}"], out[f"text-{k}"] = _longhands(("background-color", v)), _longhands(("color", v))
        out[f"border-{k}"] = _longhands(("border-color", v))
    for k, (size, line) in TEXT_SIZES.items():
        out[f"text-{k}"] = _longhands(("font-size", size), ("line-height", line))
    for k, v in WEIGHTS.items():
        out[f"font-{k}"] = _longhands(("font-weight", str(v)))
    for k in (0, 10, 20, 30, 40, 50):
        out[f"z-{k}"] = _longhands(("z-index", str(k)))
    for k in range(0, 101, 5):
        out[f"opacity-{k}"] = _longhands(("opacity", f"{k / 100:g}"))
    for k, v in {"": "1px", "-0": "0px", "-2": "2px", "-4": "4px", "-8": "8px"}.items():
        out[f"border{k}"] = _longhands(("border-width", v))
    for k, v in RADII.items():
        out["rounded" + (f"-{k}" if k else "")] = _longhands(("border-radius", v))
    return out


def _scaled() -> dict[str, dict[str, str]]:
    """Stems with the steps of the scale."""
    scale = {"0": "0px", "px": "1px"} | {f"{n:g}": f"{n / 4:g}rem" for n in STEPS}
    parts = {f"{a}/{b}": f"{100 * a / b:.6f}".rstrip("0").rstrip(".") + "%" for a, b in FRACTIONS}
    out = {}
    for stem, props in (SPACED | SIZED).items():
        values = dict(scale)
        if stem in SIZED:
            values |= SIZES | parts | {"screen": "100vw" if stem.endswith("w") else "100vh"}
        elif stem in AUTO:
            values |= {"auto": "auto"}
        for step, value in values.items():
            out[f"{stem}-{step}"] = {p: canonical(value) for p in props}
            if stem in BELOW_ZERO and step not in ("auto", "0"):
                out[f"-{stem}-{step}"] = {p: canonical(f"-{value}") for p in props}
    return out


@lru_cache(1)
def vocabulary() -> dict[str, dict[str, str]]:
    """Tokens of the tables and the longhands each sets, without conditions."""
    return _plain() | _scaled()


@lru_cache(1)
def _by_declaration() -> dict[tuple[str, str], list[str]]:
    out: dict[tuple[str, str], list[str]] = {}
    for token, decls in vocabulary().items():
        for d in decls.items():
            out.setdefault(d, []).append(token)
    return out


def split_chain(token: str) -> tuple[list[str], str]:
    """Variants and the utility they stand before, at colons outside brackets."""
    parts, depth, cur = [], 0, ""
    for ch in token:
        depth += (ch in "[(") - (ch in "])")
        if ch == ":" and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    return parts, cur


def condition(chain: list[str]) -> str | None:
    """The condition key of a chain of variants, None if any is unknown or comes twice."""
    if len(set(chain)) < len(chain) or any(v not in MEDIA and v not in STATES for v in chain):
        return None
    return "|".join((" and ".join(MEDIA[v] for v in chain if v in MEDIA), ",".join(sorted(f":{v}" for v in chain if v in STATES)), ""))


_ARBITRARY = re.compile(r"(-?[a-z]+(?:-[a-z]+)?)-\[([^\[\]]+)\]\Z")


@lru_cache(200_000)
def declared(token: str) -> tuple[tuple[tuple[str, str], tuple[str, bool]], ...] | None:
    """((condition, property), (value, important)) of a token, None if it is unknown."""
    chain, root = split_chain(token)
    cond, important = condition(chain), root.startswith("!")
    root = root[important:]
    decls = vocabulary().get(root)
    if decls is None and (m := _ARBITRARY.match(root)):
        props = (SPACED | SIZED | RADIUS).get(m[1])
        value = m[2].replace("_", " ")
        if props and re.fullmatch(r"[\w.%()+*/, -]+", value) and not (m[1] in SPACED and m[1][0] in "pg" and value.startswith("-")):
            decls = {p: canonical(value) for p in props}
    if cond is None or not decls:
        return None
    return tuple(((cond, p), (v, important)) for p, v in decls.items())


def synthesized(block: dict[str, tuple[str, bool]]) -> list[str]:
    """Tokens with arbitrary values whose longhands the block holds, all equal and none important."""
    out = []
    for stem, props in (SPACED | SIZED | RADIUS).items():
        values = {block.get(p) for p in props}
        value, important = next(iter(values)) or (None, True)
        if len(values) == 1 and value and not important and not re.search(r"[\[\]{}'\"`;_]", value):
            out.append(f"{stem}-[{re.sub(r'\s+', '_', value)}]")
    return out


def chain_for(cond: str) -> str | None:
    """The shortest chain of variants for a condition, the first by name if tied."""
    if cond == BASE:
        return ""
    media, states, pseudo = cond.split("|")
    names = [next((k for k, v in MEDIA.items() if v == m), None) for m in media.split(" and ") if m] + [s[1:] for s in states.split(",") if s]
    if pseudo or None in names:
        return None
    fitting = ["".join(f"{v}:" for v in p) for p in itertools.permutations(names)] if len(names) <= 4 else []
    return min((c for c in fitting if condition(c.split(":")[:-1]) == cond), default=None)


class Utilities:
    """The vocabulary in the role of a stylesheet: a later token in a class list wins over an earlier one."""

    complex: frozenset = frozenset()
    overlap = True  # where no exact cover is sought, tokens may declare the same twice

    def knows(self, token: str) -> bool:
        return declared(token) is not None

    def droppable(self, token: str) -> bool:
        """Without conditions, or with such as can be built again."""
        decls = declared(token)
        return decls is not None and chain_for(decls[0][0][0]) is not None

    def coupled(self, token: str) -> bool:
        return False

    def competes(self, tag: str, classes: list[str], prop: str) -> bool:
        return False

    def resolve(self, tokens: list[str]) -> tuple[Tuples, list[str]]:
        style: Tuples = {}
        for t in tokens:
            style.update(declared(t) or ())
        return style, [t for t in tokens if declared(t) is None]

    def fitting(self, target: Tuples) -> dict[str, list]:
        """Tokens whose declarations the target holds, with them, under each condition that has a chain."""
        by: dict[str, dict[str, tuple[str, bool]]] = {}
        for (cond, prop), d in target.items():
            by.setdefault(cond, {})[prop] = d
        out = {}
        for cond, block in by.items():
            chain = chain_for(cond)
            if chain is None:
                continue
            roots = {t for p, (v, _) in block.items() for t in _by_declaration().get((p, v), ())} | set(synthesized(block))
            for root in roots:
                for token in (f"{chain}{root}", f"{chain}!{root}"):
                    decls = declared(token)
                    if decls and all(target.get(k) == d for k, d in decls):
                        out[token] = list(decls)
        return out


def synthetic(block: dict[str, tuple[str, bool]]) -> tuple[str, str]:
    """A class named by its content for what no token says, and its rule; for reports, never put in a list."""
    text = ";".join(f"{p}:{v}{'!important' * i}" for p, (v, i) in sorted(block.items()))
    name = f"u-{hashlib.sha256(text.encode()).hexdigest()[:10]}"
    return name, f".{name}{{{text}}}"
