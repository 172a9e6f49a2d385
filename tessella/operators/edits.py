"""Edits of a document's tree: remove, unwrap, replace, wrap, insert, move, merge, another class list.

A document's edits touch no other document, so they are a map.  Edits of one group are applied
together or not at all; what is refused is reported and the rest goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.markup import Node, parse
from tessella.sources.partitions import dealt

#: ``grp`` null: a group of its own.  ``safety`` above the target's floor (0 if opaque, else 3) is refused.
EDIT = "struct<op:string,target:int,other:int,index:int,markup:string,grp:string,safety:int>"


class Refused(Exception):
    pass


class Tree:
    """Nodes numbered in pre-order; new nodes get the numbers after the last."""

    def __init__(self, text: str):
        self.root = parse(text)
        self.by_id: dict[int, Node] = dict(enumerate(self.root.walk()))
        self.ids: dict[Node, int] = {n: i for i, n in self.by_id.items()}
        self.undo: list[tuple[Node, Node | None, list[Node]]] = []
        self.attrs: list[tuple[Node, list]] = []

    # every change of a node's place goes through these two, so that a group can be taken back

    def hang(self, n: Node, parent: Node | None) -> None:
        self.undo.append((n, n.parent, n.children))
        n.parent = parent

    def children(self, n: Node, now: list[Node]) -> None:
        self.undo.append((n, n.parent, n.children))
        n.children = now

    def take_back(self) -> None:
        while self.undo:
            n, n.parent, n.children = self.undo.pop()
        while self.attrs:
            n, n.attrs = self.attrs.pop()

    def live(self, number: int | None, what: str = "target") -> Node:
        n = up = self.by_id.get(-1 if number is None else number)
        while up is not None and up.parent is not None:
            up = up.parent
        if n is None or up is not self.root:
            raise Refused(f"{what} not found")
        return n

    def slot(self, n: Node, now: list[Node]) -> None:
        """Other nodes in the place of ``n``."""
        if n.parent is None:
            raise Refused("target has no parent")
        up = n.parent
        at = up.children.index(n)
        self.children(up, [*up.children[:at], *now, *up.children[at + 1 :]])
        for k in now:
            self.hang(k, up)
        if n not in now:
            self.hang(n, None)

    def made(self, markup: str | None) -> list[Node]:
        body = next(n for n in parse(markup or "").walk() if n.tag == "body")
        for top in body.children:
            for n in top.walk():
                self.ids[n] = len(self.by_id)
                self.by_id[len(self.by_id)] = n
        if not body.children:
            raise Refused("nothing to insert")
        return body.children


def _holds(n: Node) -> None:
    if n.kind not in ("element", "fragment"):
        raise Refused("not a container")


def _remove(tree: Tree, n: Node, e: dict) -> None:
    tree.slot(n, [])


def _unwrap(tree: Tree, n: Node, e: dict) -> None:
    _holds(n)
    tree.slot(n, n.children)


def _replace(tree: Tree, n: Node, e: dict) -> None:
    tree.slot(n, tree.made(e["markup"]))


def _wrap(tree: Tree, n: Node, e: dict) -> None:
    if n.parent is None:
        raise Refused("target has no parent")
    outer = tree.made(e["markup"])[0]
    _holds(outer)
    tree.slot(n, [outer])
    tree.children(outer, [*outer.children, n])
    tree.hang(n, outer)


def _before(tree: Tree, n: Node, e: dict) -> None:
    tree.slot(n, [*tree.made(e["markup"]), n])


def _after(tree: Tree, n: Node, e: dict) -> None:
    tree.slot(n, [n, *tree.made(e["markup"])])


def _move(tree: Tree, n: Node, e: dict) -> None:
    to = tree.live(e["other"], "new parent")
    _holds(to)
    up = to
    while up is not None:
        if up is n:
            raise Refused("new parent lies in the target")
        up = up.parent
    tree.slot(n, [])
    at = max(0, min(e["index"] or 0, len(to.children)))
    tree.children(to, [*to.children[:at], n, *to.children[at:]])
    tree.hang(n, to)


def _merge(tree: Tree, n: Node, e: dict) -> None:
    second = tree.live(e["other"], "second")
    if second is n or second.parent is not n.parent:
        raise Refused("not siblings")
    _holds(n)
    _holds(second)
    tree.slot(second, [])
    tree.children(n, [*n.children, *second.children])
    for k in second.children:
        tree.hang(k, n)


def _classes(tree: Tree, n: Node, e: dict) -> None:
    if n.kind != "element":
        raise Refused("not an element")
    tree.undo.append((n, n.parent, n.children))
    tree.attrs.append((n, n.attrs))
    kept = [a for a in n.attrs if a[0] != "class"]
    n.attrs = [*kept, ("class", e["markup"], None)] if e["markup"] else kept


EDITS: dict[str, Callable[[Tree, Node, dict], None]] = {
    "remove": _remove, "unwrap": _unwrap, "replace": _replace, "wrap": _wrap,
    "insert_before": _before, "insert_after": _after, "move": _move, "merge": _merge, "classes": _classes,
}


def edited(text: str, edits: list[dict]) -> tuple[Tree, int, list[tuple[str, int, str]]]:
    """The tree, the number of edits applied, and (op, target, reason) of those refused."""
    tree, applied, refused = Tree(text), 0, []
    groups: dict[object, list[dict]] = {}
    for k, e in enumerate(edits):
        groups.setdefault(k if e["grp"] is None else e["grp"], []).append(e)
    for group in groups.values():
        tree.undo.clear()
        tree.attrs.clear()
        try:
            for e in group:
                n = tree.live(e["target"])
                if (e["safety"] or 0) > (0 if n.kind == "element" and n.opaque else 3):
                    raise Refused("above the node's floor")
                if e["op"] not in EDITS:
                    raise Refused("unknown edit")
                EDITS[e["op"]](tree, n, e)
            applied += len(group)
        except Refused as why:
            tree.take_back()
            refused.append((e["op"], e["target"], str(why)))
    return tree, applied, refused


_ROWS = "doc_id long, nodes array<struct<node_id:int,parent_id:int,ordinal:int,kind:string,tag:string,text_value:string,classes:string>>, applied int, refused array<struct<op:string,target:int,reason:string>>"


def edit_documents(docs: DataFrame, key: str, text: str, edits: str) -> DataFrame:
    """(doc_id, nodes in pre-order, applied, refused) of documents with an array of EDIT in a column.

    Null texts have no row; null edits are none.  Node numbers are those of ``markup.nodes``.
    """
    row = pa.schema([
        ("doc_id", pa.int64()), ("nodes", pa.list_(pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("ordinal", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("text_value", pa.string()), ("classes", pa.string())]))),
        ("applied", pa.int32()), ("refused", pa.list_(pa.struct([("op", pa.string()), ("target", pa.int32()), ("reason", pa.string())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, e in zip(*(b.column(k).to_pylist() for k in range(3))):
                tree, applied, refused = edited(t, e or [])
                nodes, place = [], {}
                for n in tree.root.walk():
                    place.update((c, k) for k, c in enumerate(n.children))
                    nodes.append({"node_id": tree.ids[n], "parent_id": tree.ids[n.parent] if n.parent else None, "ordinal": place.get(n, 0), "kind": n.kind, "tag": n.tag, "text_value": n.text or None, "classes": " ".join(n.classes)})
                rows.append({"doc_id": i, "nodes": nodes, "applied": applied, "refused": [dict(zip(("op", "target", "reason"), r)) for r in refused]})
            yield pa.RecordBatch.from_pylist(rows, row)

    own = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(edits).cast(f"array<{EDIT}>").alias("edits"))
    return dealt(own).mapInArrow(run, _ROWS)
