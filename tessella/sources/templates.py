"""Component templates as trees: JSX and TSX, Vue and Astro files, with places in the text.

What a template leaves open until it runs is flagged on the node, so that no edit touches it.
"""

from __future__ import annotations

import html
import re

from tessella.functions.styles import expand
from tessella.functions.tables import UNITLESS, VOID
from tessella.sources import markup
from tessella.sources.markup import Node

_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_ATTRIBUTE = re.compile(r"[A-Za-z_$@:][\w$:.@-]*")
_GENERIC = re.compile(r"<[A-Za-z_$][\w$]*\s*(?:,|extends\b|=)")
_WORD = re.compile(r"[A-Za-z_$][\w$]*\Z")
_LITERAL = re.compile(r"""\s*("(?:[^"\\\n])*"|'(?:[^'\\\n])*'|`(?:[^`\\$])*`)\s*\Z""")
_STRING = re.compile(r"""("(?:[^"\\\n])*"|'(?:[^'\\\n])*'|`(?:[^`\\$])*`)""")
_ENTRY = re.compile(r"""\s*(?:([A-Za-z_$][\w$]*)|"([^"\\]*)"|'([^'\\]*)')\s*:\s*("[^"\\\n]*"|'[^'\\\n]*'|-?\d+(?:\.\d+)?)\s*(,|\Z)""")
# Words after which an expression begins, functions that join class lists.
_BEFORE = {"return", "default", "case", "yield", "await", "else", "do", "typeof", "in", "of", "void", "new", "delete"}
JOINERS = ("cn", "clsx", "classNames", "classnames", "twMerge", "twJoin")


class TemplateError(ValueError):
    pass


class _Scanner:
    def __init__(self, text: str, astro: bool = False):
        self.text, self.n, self.astro = text, len(text), astro

    # code

    def code(self, at: int, until: str, into: Node) -> int:
        """Reads code up to the closing ``until`` at this level (or the end), hanging the elements in it under
        ``into``; the place of what closes."""
        text, n, depth, prev = self.text, self.n, [], ""
        word = ""
        while at < n:
            ch = text[at]
            if ch in " \t\r\n":
                at += 1
                continue
            if ch in "\"'":
                at = self.string(at)
                prev, word = '"', ""
                continue
            if ch == "`":
                at = self.template(at, into)
                prev, word = '"', ""
                continue
            if text.startswith("//", at):
                at = text.find("\n", at)
                at = n if at < 0 else at
                continue
            if text.startswith("/*", at):
                at = text.find("*/", at + 2)
                if at < 0:
                    raise TemplateError("comment without end")
                at += 2
                continue
            operand = not prev or prev in "(,=:?&|;{}[!+-*%~^<>" or word in _BEFORE
            if ch == "/" and operand:
                at = self.pattern(at)
                prev, word = '"', ""
                continue
            if ch == "<" and operand and at + 1 < n and (text[at + 1].isalpha() or text[at + 1] in ">_$") and not _GENERIC.match(text, at):
                at = self.element(at, into, "island")
                prev, word = '"', ""
                continue
            if ch in "([{":
                depth.append({"(": ")", "[": "]", "{": "}"}[ch])
            elif ch in ")]}":
                if not depth:
                    if ch == until:
                        return at
                    raise TemplateError(f"{ch} without its opening")
                if depth.pop() != ch:
                    raise TemplateError(f"{ch} closes another bracket")
            if ch.isalnum() or ch in "_$":
                m = re.compile(r"[\w$]+").match(text, at)
                word = m[0] if _WORD.match(m[0]) else "0"
                prev, at = "a", m.end()
                continue
            prev, word = ch, ""
            at += 1
        if until:
            raise TemplateError(f"no {until}")
        return at

    def string(self, at: int) -> int:
        m = re.compile(r"""\"(?:[^"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'""", re.S).match(self.text, at)
        if not m:
            raise TemplateError("string without end")
        return m.end()

    def pattern(self, at: int) -> int:
        m = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*").match(self.text, at)
        return m.end() if m else at + 1

    def template(self, at: int, into: Node) -> int:
        at += 1
        while at < self.n and self.text[at] != "`":
            if self.text[at] == "\\":
                at += 2
            elif self.text.startswith("${", at):
                at = self.code(at + 2, "}", into) + 1
            else:
                at += 1
        if at >= self.n:
            raise TemplateError("template without end")
        return at + 1

    # elements

    def element(self, at: int, into: Node, *flags: str) -> int:
        """One element with all that it holds; the place after it."""
        stack = [into]
        while True:
            if self.text.startswith("</", at):
                at = self.closing(at, stack)
            elif self.text.startswith("<", at):
                at = self.opening(at, stack, flags if len(stack) == 1 else ())
            else:
                at = self.child(at, stack[-1])
            if len(stack) == 1:
                return at

    def body(self, at: int, end: int, root: Node) -> None:
        """Markup as it stands, elements one after another."""
        stack = [root]
        while at < end:
            if self.text.startswith("<!", at):
                close = self.text.find("-->" if self.text.startswith("<!--", at) else ">", at)
                if close < 0:
                    raise TemplateError("comment without end")
                at = close + (3 if self.text.startswith("<!--", at) else 1)
            elif self.text.startswith("</", at):
                at = self.closing(at, stack)
            elif self.text[at] == "<" and at + 1 < end and (self.text[at + 1].isalpha() or self.text[at + 1] in ">_$"):
                at = self.opening(at, stack, ())
            else:
                at = self.child(at, stack[-1])
        if len(stack) > 1:
            raise TemplateError(f"<{stack[-1].tag}> without end")

    def child(self, at: int, parent: Node) -> int:
        """Text, or an expression with the elements in it."""
        if at >= self.n:
            raise TemplateError("element without end")
        if self.text[at] == "{":
            held = Node("expression", parent=parent, start=at)
            end = self.code(at + 1, "}", held) + 1
            held.end = end
            inner = self.text[at + 1 : end - 1]
            if re.sub(r"/\*.*?\*/", "", inner, flags=re.S).strip():
                parent.flags |= {"dynamic"}
            else:
                held.kind, held.text = "comment", inner
            parent.children.append(held)
            return end
        m = re.compile(r"[^{<]+|<(?![/!A-Za-z_$>])" if self.astro else r"[^{<]+").match(self.text, at)
        if not m:
            raise TemplateError(f"unexpected {self.text[at : at + 10]!r}")
        parent.children.append(Node("text", parent=parent, text=html.unescape(m[0]), start=at, end=m.end()))
        return m.end()

    def closing(self, at: int, stack: list[Node]) -> int:
        m = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(self.text, at)
        if not m or len(stack) == 1 or stack[-1].tag != (m[1] or ""):
            raise TemplateError(f"</{m[1] if m else ''}> without its start")
        node = stack.pop()
        node.close, node.end = m.span(), m.end()
        return m.end()

    def opening(self, at: int, stack: list[Node], flags: tuple[str, ...]) -> int:
        start, text = at, self.text
        node = Node("element", parent=stack[-1], start=start, flags=frozenset(flags))
        m = _NAME.match(text, at + 1)
        at += 1
        if m:
            node.tag, at = m[0], m.end()
            if not node.tag[0].islower() or "." in node.tag:
                node.flags |= {"component"}
            if text.startswith("<", at):
                raise TemplateError("type arguments")
        else:
            node.kind = "fragment"
        stack[-1].children.append(node)
        while True:
            at = re.compile(r"(?:\s|/\*.*?\*/|//[^\n]*)*+", re.S).match(text, at).end()
            if text.startswith("/>", at) or text.startswith(">", at):
                break
            if text.startswith("{", at):  # spread
                at = self.code(at + 1, "}", Node("expression")) + 1
                node.flags |= {"spread"}
                continue
            m = _ATTRIBUTE.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at : at + 10]!r} in a tag")
            at = self.attribute(node, m[0], at, m.end())
        alone = text[at] == "/"
        at += 1 + alone
        node.open, node.end = (start, at), at
        if alone or self.astro and node.tag.lower() in VOID:
            return at
        if self.astro and node.tag in ("script", "style"):
            m = re.compile(rf"</{node.tag}\s*>").search(text, at)
            if not m:
                raise TemplateError(f"<{node.tag}> without end")
            node.close, node.end = m.span(), m.end()
            return m.end()
        stack.append(node)
        return at

    def attribute(self, node: Node, name: str, start: int, at: int) -> int:
        text = self.text
        m = re.compile(r"\s*=\s*").match(text, at)
        if not m:
            node.attrs.append((name, True, None))
            node.whole[name] = (start, at)
            return at
        at = m.end()
        if at < self.n and text[at] in "\"'":
            end = text.find(text[at], at + 1) + 1
            if not end:
                raise TemplateError("value without end")
            value, span = html.unescape(text[at + 1 : end - 1]), (at, end)
        elif text.startswith("{", at):
            end = self.code(at + 1, "}", Node("expression")) + 1
            value, span = self.expression(node, name, at + 1, end - 1)
        elif self.astro and (m := re.compile(r"`[^`]*`|[^\s>\"'{]+").match(text, at)):
            end = m.end()
            value, span = (m[0], m.span()) if m[0][0] != "`" else (None, None)
        else:
            raise TemplateError(f"unexpected {text[at : at + 10]!r} as a value")
        shown = "class" if name in ("className", "class") else name
        if name in ("ref", "key") or name.startswith("on"):
            node.flags |= {"ref"}
        if name in ("dangerouslySetInnerHTML", "set:html", "set:text"):
            node.flags |= {"raw"}
        if shown == "class" and value is None or name in ("class:list", "classList"):
            node.flags |= {"classes"}
        node.whole[shown] = (start, end)
        node.attrs.append((shown, True if value in ("", None) else value, span))
        return end

    def expression(self, node: Node, name: str, start: int, end: int) -> tuple[str | None, tuple[int, int] | None]:
        """The string that an expression is, with its place; else None, and what of it is static on the node."""
        inner = self.text[start:end]
        if m := _LITERAL.match(inner):
            return m[1][1:-1], (start + m.start(1), start + m.end(1))
        if name in ("className", "class"):
            call = re.match(r"\s*([A-Za-z_$][\w$]*)\s*\(", inner)
            if call and call[1] in JOINERS:
                node.segments = [(start + m.start() + 1, start + m.end() - 1) for m in _arguments(inner, call.end())]
        elif name == "style":
            node.chunks = style_entries(inner)
        return None, None


def _arguments(inner: str, at: int):
    """The string literals that are whole arguments of a call."""
    depth, fresh = 0, True
    while at < len(inner):
        ch = inner[at]
        m = _STRING.match(inner, at) if ch in "\"'`" else None
        if m:
            after = inner[m.end() :].lstrip()[:1]
            if fresh and depth == 0 and after in (",", ")"):
                yield m
            at, fresh = m.end(), False
            continue
        depth += (ch in "([{") - (ch in ")]}")
        if depth < 0:
            return
        if ch == "," and depth == 0:
            fresh = True
        elif not ch.isspace():
            fresh = False
        at += 1


def style_entries(inner: str) -> list[tuple[str, tuple[tuple[str, str], ...], bool]] | None:
    """(text, longhands, important) of each entry of a style object of literals; None if it is any other."""
    m = re.fullmatch(r"\s*\{(.*)\}\s*", inner, re.S)
    if not m:
        return None
    body, out, at = m[1], [], 0
    while at < len(body) and body[at:].strip():
        e = _ENTRY.match(body, at)
        if not e:
            return None
        name = e[1] or e[2] or e[3]
        prop = name if name.startswith("--") else re.sub(r"([A-Z])", lambda c: "-" + c[0].lower(), name)
        raw = e[4]
        value = raw[1:-1] if raw[0] in "\"'" else raw if float(raw) == 0 or prop in UNITLESS else raw + "px"
        if "!" in value or not value.strip():
            return None
        out.append((body[e.start() : e.end(4)].strip(), expand(prop, value), False))
        at = e.end()
    return out


def parse_jsx(text: str) -> Node:
    """The elements of a module, wherever they stand in its code, as islands under one root."""
    root = Node("fragment", end=len(text))
    _Scanner(text).code(0, "", root)
    for n in root.walk():
        for c in n.children:
            c.parent = n
    return root


_STYLE_BLOCK = re.compile(r"(?i)<style[\s>]")


def parse_vue(text: str) -> Node | None:
    """The tree of a file's template; None if the file is to be left as it is: without one plain template, or
    with style blocks, whose rules may be scoped to it."""
    if _STYLE_BLOCK.search(text):
        return None
    m = re.search(r"<template(\s[^>]*)?>", text)
    end = text.rfind("</template>")
    if not m or end < m.end() or re.search(r"\b(src|lang)\s*=", m[1] or ""):
        return None
    hidden = re.sub(r"[^\n]", " ", text[: m.end()]) + text[m.end() : end] + re.sub(r"[^\n]", " ", text[end:])
    root = markup.parse(hidden)
    for n in root.walk():
        if n.kind == "element" and n.open:
            raw = re.match(r"[^\s/>]+", text[n.open[0] + 1 :])[0]
            bound = any(a[:2] == "v-" or a[:1] in ":@#" for a, _, _ in n.attrs)
            if n.tag in ("slot", "component", "template", "transition", "keep-alive", "teleport", "suspense") or raw != raw.lower() or "-" in raw:
                n.flags |= {"component"}
            if bound or any(a in ("ref", "key", "is") for a, _, _ in n.attrs):
                n.flags |= {"spread"}
            if any(c.kind == "text" and "{{" in c.text for c in n.children):
                n.flags |= {"dynamic"}
    return root


def parse_astro(text: str) -> Node | None:
    """The tree of a file's markup after its frontmatter; None if it has a style block."""
    if _STYLE_BLOCK.search(text):
        return None
    m = re.match(r"\s*---\r?\n.*?\r?\n---[ \t]*\r?\n?", text, re.S)
    root = Node("fragment", end=len(text))
    _Scanner(text, astro=True).body(m.end() if m else 0, len(text), root)
    for n in root.walk():
        for c in n.children:
            c.parent = n
        if n.kind == "element" and any(a.startswith(("client:", "is:", "set:", "define:", "class:", "transition:")) for a, _, _ in n.attrs):
            n.flags |= {"component"}
    return root


def looks_like(path: str, text: str) -> str | None:
    """The kind of a file by its extension, else by how its text begins."""
    ext = path.split("?")[0].rpartition(".")[2].lower()
    if ext in ("jsx", "tsx"):
        return "jsx"
    if ext in ("html", "htm", "vue", "astro"):
        return {"htm": "html"}.get(ext, ext)
    head = text.lstrip()[:200].lower()
    if head.startswith(("<!doctype html", "<html")):
        return "html"
    return "astro" if head.startswith("---") else "vue" if head.startswith(("<template", "<script setup")) else None


#: Kind -> the tree of a text, None where it is to be left as it is.
PARSERS = {"html": markup.parse, "jsx": parse_jsx, "tsx": parse_jsx, "vue": parse_vue, "astro": parse_astro}
