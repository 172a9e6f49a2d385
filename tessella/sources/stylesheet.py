"""Stylesheets as facts: rules by class, roles of classes in selectors, complex selectors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.styles import expand
from tessella.functions.tables import FUNCTIONAL, LEGACY_ELEMENTS, STRUCTURAL

BASE = "||"
#: How deep rules may stand in one another.
NESTED = 16
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_IMPORTANT = re.compile(r"\s*!\s*important\s*\Z", re.I)
_SIMPLE = re.compile(r"\.(?P<cls>(?:[\w-]|[^\x00-\x7f]|\\.)+)|#(?P<id>[\w-]+)|(?P<attr>\[[^\]]*\])|(?P<pseudo>::?[\w-]+)(?P<args>\()?|(?P<any>\*)|(?P<nest>&)|(?P<tag>[\w-]+)")


@dataclass
class Usage:
    referenced: bool = False
    subject: bool = False
    ancestor: bool = False
    sibling: bool = False
    compound: bool = False
    structural: bool = False
    argument: bool = False
    bearing: bool = False


@dataclass
class Sheet:
    """decls: token -> {(condition, property): (order, value, important)}, later rules over earlier."""

    decls: dict[str, dict[tuple[str, str], tuple[int, str, bool]]] = field(default_factory=dict)
    rules: list[tuple[int, str, str, str, str, bool]] = field(default_factory=list)
    usage: dict[str, Usage] = field(default_factory=dict)
    complex: set[str] = field(default_factory=set)
    #: classes, tags, whether any element, and the longhands, of the rules that a class list alone doesn't decide
    risks: list[tuple[frozenset[str], frozenset[str], bool, frozenset[str]]] = field(default_factory=list)

    overlap = False

    def competes(self, tag: str, classes: list[str], prop: str) -> bool:
        """Whether such a rule may set a property of an element."""
        return any(prop in props and (every or tag in tags or not cls.isdisjoint(classes)) for cls, tags, every, props in self.risks)

    def knows(self, token: str) -> bool:
        return token in self.decls

    def resolve(self, tokens: list[str]) -> tuple[dict, list[str]]:
        """Winner by rule order for each (condition, property), and the tokens without a rule of their own."""
        best: dict[tuple[str, str], tuple[int, str, bool]] = {}
        for t in tokens:
            for k, d in self.decls.get(t, {}).items():
                if k not in best or d[0] >= best[k][0]:
                    best[k] = d
        return {k: (v, i) for k, (_, v, i) in best.items()}, [t for t in tokens if t not in self.decls]

    def fitting(self, target: dict) -> dict[str, list]:
        """Tokens all of whose declarations the target holds, with them."""
        out = {}
        for token, decls in self.decls.items():
            mine = [(k, (v, i)) for k, (_, v, i) in decls.items()]
            if mine and all(target.get(k) == d for k, d in mine):
                out[token] = mine
        return out

    def droppable(self, token: str) -> bool:
        u = self.usage.get(token)
        return u is not None and u.referenced and not u.bearing

    def coupled(self, token: str) -> bool:
        u = self.usage.get(token)
        return bool(self.complex) and u is not None and (u.ancestor or u.sibling or u.argument or u.structural)


def _blocks(css: str):
    """(prelude, body, place) of each rule; strings and nested braces are kept whole."""
    at, n = 0, len(css)
    start = 0
    while at < n:
        ch = css[at]
        if ch in "\"'":
            end = at + 1
            while end < n and css[end] != ch:
                end += 2 if css[end] == "\\" else 1
            at = end + 1
        elif ch == ";":
            at += 1
            start = at
        elif ch == "{":
            depth, end = 1, at + 1
            while end < n and depth:
                c = css[end]
                if c in "\"'":
                    close = end + 1
                    while close < n and css[close] != c:
                        close += 2 if css[close] == "\\" else 1
                    end = close
                depth += (c == "{") - (c == "}")
                end += 1
            yield css[start:at].strip(), css[at + 1 : end - (depth == 0)], (start, end)
            at = start = end
        else:
            at += 1


def split_outside(text: str, mark: str) -> list[str]:
    """Split at a character outside brackets and strings."""
    out, depth, quote, cur = [], 0, "", ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        if ch == mark and not depth and not quote:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def declarations(body: str) -> list[tuple[str, str, bool]]:
    out = []
    for chunk in split_outside(body, ";"):
        name, colon, value = chunk.partition(":")
        if not colon or not name.strip() or "{" in chunk:
            continue
        important = _IMPORTANT.search(value) is not None
        out.append((name.strip(), _IMPORTANT.sub("", value).strip(), important))
    return out


def _compounds(selector: str) -> list[tuple[str, str]]:
    """(combinator to the left, compound) in order."""
    out, comb, cur, depth = [], "", "", 0
    for ch in selector.strip() + "\0":
        depth += (ch in "([") - (ch in ")]")
        if depth == 0 and ch in " \t\n\r\f>+~\0":
            if cur:
                out.append((comb, cur))
                cur, comb = "", " "
            if ch in ">+~":
                comb = ch
        else:
            cur += ch
    return out


def _simple(compound: str):
    """Classes, other simple selectors present, pseudo names with their arguments, tags, whether any is none of these."""
    classes, other, pseudos, tags, untold, at = [], False, [], [], False, 0
    while at < len(compound):
        m = _SIMPLE.match(compound, at)
        if not m:
            other, untold, at = True, True, at + 1
            continue
        at = m.end()
        if m["cls"]:
            classes.append(re.sub(r"\\(.)", r"\1", m["cls"]))
        elif m["pseudo"]:
            arg = ""
            if m["args"]:
                depth, end = 1, at
                while end < len(compound) and depth:
                    depth += (compound[end] == "(") - (compound[end] == ")")
                    end += 1
                arg, at = compound[at : end - 1], end
            pseudos.append((m["pseudo"].lower(), arg))
        else:
            other = True
            tags += [m["tag"].lower()] if m["tag"] else []
            untold |= not m["tag"] and not m["any"]
    return classes, other, pseudos, tags, untold


def _outside_of(text: str, places: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in places:
        out.append(text[at:s])
        at = e
    return ";".join([*out, text[at:]])


def _within(parent: str, child: str) -> str:
    """A nested rule's selector as it would stand outside."""
    child = child.strip()
    return child.replace("&", parent) if "&" in child else f"{parent} {child}"


def utility_selector(selector: str) -> tuple[str, list[str], str] | None:
    """(class, states, pseudo-element) of a selector that is one class with pseudo parts; None if it is any other."""
    found = _compounds(selector)
    classes, other, pseudos, _, _ = _simple(found[0][1]) if len(found) == 1 else ([], True, [], [], True)
    elements = [p for p, _ in pseudos if p.startswith("::") or p in LEGACY_ELEMENTS]
    if len(classes) != 1 or other or len(elements) > 1 or any(p in FUNCTIONAL for p, _ in pseudos):
        return None
    return classes[0], sorted(p for p, _ in pseudos if p not in elements), "::" + elements[0].lstrip(":") if elements else ""


def parse(css: str) -> Sheet:
    """The facts of one stylesheet; what cannot be read contributes nothing."""
    sheet, order = Sheet(), 0

    def walk(text: str, media: str, depth: int = 0):
        nonlocal order
        for prelude, body, _ in _blocks(text) if depth <= NESTED else ():
            if prelude.startswith("@"):
                name = re.match(r"@[\w-]*", prelude)[0].lower()
                if "keyframes" in name or name in ("@font-face", "@page", "@property", "@counter-style"):
                    continue
                query = " ".join(prelude[len(name):].split())
                walk(body, (f"{media} and {query}" if media else query) if name == "@media" else media, depth + 1)
                continue
            nested = list(_blocks(body)) if "{" in body else []
            decls = declarations(_outside_of(body, [place for *_, place in nested]))
            selectors = [x.strip() for x in split_outside(prelude, ",")]
            for selector in selectors:
                _selector(sheet, selector, media, decls, order)
            order += 1
            for inner, held, _ in nested:
                if inner.startswith("@"):  # the rule's own selectors under a condition
                    walk(f"{inner}{{{prelude}{{{held}}}}}", media, depth + 1)
                else:
                    walk(f"{','.join(_within(p, c) for p in selectors for c in split_outside(inner, ','))}{{{held}}}", media, depth + 1)

    walk(_COMMENT.sub("", css or ""), "")
    return sheet


def escaped(token: str) -> str:
    """A class name as it stands in a selector."""
    return "".join(c if c.isalnum() or c in "-_" or not c.isascii() else "\\" + c for c in token)


def emitted(sheet, tokens: list[str]) -> str:
    """CSS text that defines the tokens of a sheet or vocabulary, a rule for each condition, properties in order."""
    out = []
    for token in dict.fromkeys(tokens):
        by: dict[str, list[str]] = {}
        for (cond, prop), (value, important) in sorted(sheet.resolve([token])[0].items()):
            by.setdefault(cond, []).append(f"{prop}:{value}{'!important' * important}")
        for cond, decls in by.items():
            media, states, pseudo = cond.split("|")
            rule = f".{escaped(token)}{states.replace(',', '')}{pseudo}{{{';'.join(decls)}}}"
            out.append(f"@media {media}{{{rule}}}" if media else rule)
    return "\n".join(out)


def _selector(sheet: Sheet, selector: str, media: str, decls, order: int) -> None:
    found = _compounds(selector)
    structural_any = False
    for k, (_, compound) in enumerate(found):
        right = found[k + 1][0] if k + 1 < len(found) else ""
        classes, other, pseudos, tags, untold = _simple(compound)
        elements = [p for p, _ in pseudos if p.startswith("::") or p in LEGACY_ELEMENTS]
        structural = any(p in STRUCTURAL for p, _ in pseudos)
        functional = any(p in FUNCTIONAL for p, _ in pseudos)
        states = sorted(p for p, _ in pseudos if p not in STRUCTURAL and p not in FUNCTIONAL and p not in elements)
        qualified = len(classes) > 1 or other or functional or bool(states)
        structural_any |= structural
        forward = len(found) == 1 and len(classes) == 1 and not other and not structural and not functional and len(elements) <= 1
        if decls and k == len(found) - 1 and not (forward and classes):
            every = untold or not classes and not tags or "*" in compound
            sheet.risks.append((frozenset(classes), frozenset(tags), every, frozenset(p for name, value, _ in decls for p, _ in expand(name, value))))
        for token in classes:
            u = sheet.usage.setdefault(token, Usage())
            u.referenced = True
            u.subject |= k == len(found) - 1
            u.ancestor |= right in (" ", ">") and right != ""
            u.sibling |= right in ("+", "~") and right != ""
            u.compound |= qualified
            u.structural |= structural
            u.bearing |= right != "" or qualified or structural or bool(elements)
            if forward and decls:
                cond = "|".join((media, ",".join(states), "::" + elements[0].lstrip(":") if elements else ""))
                own = sheet.decls.setdefault(token, {})
                for name, value, important in decls:
                    for prop, v in expand(name, value):
                        own[cond, prop] = (order, v, important)
                        sheet.rules.append((order, token, cond, prop, v, important))
        for name, arg in pseudos:
            for token in re.findall(r"\.((?:[\w-]|[^\x00-\x7f])+)", arg):
                u = sheet.usage.setdefault(token, Usage())
                u.referenced = u.bearing = True
                u.argument |= name == ":has"
    if len(found) > 1 or structural_any:
        sheet.complex.add(selector)


_FACTS = (
    "struct<rules:array<struct<ord:int,token:string,cond:string,property:string,value:string,important:boolean>>,"
    "usage:array<struct<token:string,subject:boolean,ancestor:boolean,sibling:boolean,compound:boolean,structural:boolean,argument:boolean,droppable:boolean>>,"
    "complex:array<string>,risks:array<struct<classes:array<string>,tags:array<string>,every:boolean,properties:array<string>>>>"
)


def _facts(css):
    s = parse(css)
    return s.rules, [(t, u.subject, u.ancestor, u.sibling, u.compound, u.structural, u.argument, s.droppable(t)) for t, u in s.usage.items()], sorted(s.complex), [(sorted(c), sorted(t), e, sorted(p)) for c, t, e, p in s.risks]


def parsed_sheets(sheets: DataFrame) -> DataFrame:
    """(set_id, facts): every distinct sheet set is parsed once."""
    return sheets.select("set_id", F.udf(_facts, _FACTS, useArrow=True)("css").alias("facts"))


def rules(parsed: DataFrame) -> DataFrame:
    return parsed.select("set_id", F.posexplode("facts.rules").alias("seq", "r")).select("set_id", "seq", "r.*")


def usage(parsed: DataFrame) -> DataFrame:
    return parsed.select("set_id", F.explode("facts.usage").alias("u")).select("set_id", "u.*")


def complex_selectors(parsed: DataFrame) -> DataFrame:
    return parsed.select("set_id", F.explode("facts.complex").alias("selector")).distinct()


def risks(parsed: DataFrame) -> DataFrame:
    """(set_id, classes, tags, every, property) of the rules that a class list alone doesn't decide."""
    return parsed.select("set_id", F.explode("facts.risks").alias("r")).select("set_id", "r.classes", "r.tags", "r.every", F.explode("r.properties").alias("property"))


# What the text ends in the middle of goes on to its end, so that every character is read once.
_STYLE = r"(?is)<style\b([^>]*+)(?:>|\z)(.*?)(?:</style\s*+>|\z)"
_TYPE = r"""(?i)\btype\s*=\s*["']?([^"'\s>]*)"""
_LINK = r"(?is)<link\b[^>]*+(?:>|\z)"


def own_css(text: Column) -> Column:
    """The CSS of a page's own style blocks in order, made from the page alone."""
    kinds, css = (F.regexp_extract_all(text, F.lit(_STYLE), g) for g in (1, 2))
    read = lambda x: F.lower(F.regexp_extract(x["kind"], _TYPE, 1)).isin("", "text/css")
    return F.array_join(F.transform(F.filter(F.arrays_zip(kinds.alias("kind"), css.alias("css")), read), lambda x: x["css"]), "\n")


def inline_sheets(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, css) of the style blocks that hold CSS."""
    kinds, css = (F.regexp_extract_all(F.col(text), F.lit(_STYLE), g) for g in (1, 2))
    got = pages.select(key, F.posexplode(F.arrays_zip(kinds.alias("kind"), css.alias("css"))).alias("pos", "x"))
    kind = F.lower(F.regexp_extract("x.kind", _TYPE, 1))
    return got.where(kind.isin("", "text/css")).select(key, "pos", F.col("x.css").alias("css"))


def linked_sheets(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, href) of the local stylesheets that a page links, in order, without their query."""
    tag = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(_LINK), 0)).alias("pos", "tag"))
    attr = lambda name: F.regexp_extract("tag", rf"""(?i)\b{name}\s*=\s*["']?([^"'\s>]*)""", 1)
    href = F.regexp_replace(attr("href"), r"[?#].*$", "")
    local = (href != "") & ~href.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:|//)")
    return tag.where((F.lower(attr("rel")) == "stylesheet") & local).select(key, "pos", href.alias("href"))


def beside(path: Column, href: Column) -> Column:
    """The path that a reference names, seen from a file; one from the root stays."""
    joined = F.when(href.startswith("/"), href).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), href))
    none = F.expr("cast(array() as array<string>)")
    step = lambda acc, x: F.when(x == ".", acc).when((x == "..") & (F.size(acc) > 1), F.slice(acc, 1, F.size(acc) - 1)).when(x == "..", acc).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(F.split(joined, "/"), none, step), "/")


def linked_files(pages: DataFrame, key: str, path: str, text: str, files: DataFrame) -> DataFrame:
    """(key, pos, path) of the linked stylesheets that exist, ``files`` (path) being all there are."""
    links = linked_sheets(pages, key, text).join(pages.select(key, F.col(path).alias("page")), key)
    return links.select(key, "pos", beside(F.col("page"), F.col("href")).alias("path")).join(files.select("path").distinct(), "path", "left_semi").select(key, "pos", "path")


def sheet_sets(inline: DataFrame, key: str, linked: DataFrame | None = None, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, set_id), and (set_id, css) once for each distinct set: inline sheets in order, then the linked
    files (key, path), each once, by path.  The text of a file is joined once for each set, not for each page."""
    own = inline.select(key, F.struct("pos", "css").alias("inline"), F.lit(None).cast("string").alias("path"))
    if linked is not None:
        own = own.unionByName(linked.select(key, F.lit(None).cast(own.schema["inline"].dataType).alias("inline"), "path"))
    sheets = F.array_join(F.transform(F.array_sort(F.collect_list("inline")), lambda x: x["css"]), "\n")
    one = own.groupBy(key).agg(sheets.alias("css"), F.array_sort(F.collect_set("path")).alias("paths"))
    keyed = one.withColumn("set_id", F.sha2(F.concat_ws("\x00", "css", "paths"), 256))
    sets = keyed.groupBy("set_id").agg(F.any_value("css").alias("css"), F.any_value("paths").alias("paths"))
    if linked is not None:
        parts = sets.select("set_id", F.posexplode("paths").alias("pos", "path")).join(files.select("path", F.col("css").alias("text")), "path")
        texts = parts.groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("texts"))
        both = F.concat(F.when(F.col("css") != "", F.array("css")).otherwise(F.expr("cast(array() as array<string>)")), F.coalesce("texts", F.expr("cast(array() as array<string>)")))
        sets = sets.join(texts, "set_id", "left").withColumn("css", F.array_join(both, "\n"))
    return keyed.select(key, "set_id"), sets.select("set_id", "css")
