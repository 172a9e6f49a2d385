"""Patterns declared as column predicates over the node table, and the edits they stand for."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.styles import expand
from tessella.functions.tables import PAINTLESS, VISUAL
from tessella.operators import resolve as R
from tessella.operators.edits import EDIT
from tessella.sources.stylesheet import BASE

#: Levels of safety: 0 for what any element may undergo, 3 for what only an unguarded one may.
SAFEST, LOOSEST = 0, 3


# ---- predicates -----------------------------------------------------------------------------


def all_of(*tests: Column) -> Column:
    """True of no tests."""
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(*tests: Column) -> Column:
    """False of no tests."""
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def none_of(*tests: Column) -> Column:
    return ~any_of(*tests)


def is_element(tag: str | None = None) -> Column:
    test = F.col("kind") == "element"
    return test if tag is None else test & (F.lower("tag") == tag.lower())


def only_child() -> Column:
    return F.col("n_elements") == 1


def has_handlers() -> Column:
    return F.exists(F.map_keys("attrs"), lambda a: a.startswith("on"))


def opaque() -> Column:
    return F.col("opaque")


def unresolved() -> Column:
    return F.size("unknown") > 0


def value_of(prop: str, cond: str = BASE) -> Column:
    """The resolved value of a property, null if none."""
    return F.element_at("style", F.struct(F.lit(cond).alias("cond"), F.lit(prop).alias("property")))["value"]


def computed(style: dict[str, str], cond: str = BASE) -> Column:
    """Whether the resolved style holds every one of these declarations, important or not."""
    longhands = [x for prop, value in style.items() for x in expand(prop, value)]
    return all_of(*(F.coalesce(value_of(p, cond) == v, F.lit(False)) for p, v in longhands))


def paints() -> Column:
    """Whether an element may show anything of its own; one with an unknown class may."""
    seen = F.exists(F.map_entries("style"), lambda d: d["key"]["property"].isin(VISUAL) & ~d["value"]["value"].isin(*PAINTLESS))
    return unresolved() | seen


def guarded(change: str) -> Column:
    """What keeps a change from an element, whatever the pattern: handlers, opacity, a selector that reaches it."""
    common = any_of(has_handlers(), F.col("coupled"))
    return common if change == "flatten" else any_of(common, opaque(), unresolved())


# ---- patterns -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Recipe:
    """change: flatten, classes or style; ``edits``: node columns -> an EDIT column."""

    change: str
    edits: Callable[[], Column]


def _edit(op: str, markup: Column | None = None) -> Column:
    fields = (F.lit(op), F.col("node_id"), F.lit(None), F.lit(None), F.lit(None) if markup is None else markup, F.lit(None), F.lit(0))
    return F.struct(*fields).cast(EDIT)


def flatten_into() -> Recipe:
    """The wrapper goes, its children stay."""
    return Recipe("flatten", lambda: _edit("unwrap"))


def rewrite_classes(change: Callable[[Column], Column]) -> Recipe:
    """Another class list, as an array made from the old one."""
    return Recipe("classes", lambda: _edit("classes", F.array_join(change(F.col("classes")), " ")))


def drop_classes(*tokens: str) -> Recipe:
    return rewrite_classes(lambda classes: F.filter(classes, lambda t: ~t.isin(*tokens)))


@dataclass(frozen=True)
class Pattern:
    """A match and what follows from it; ``cases`` are (markup before, markup after) that must hold."""

    name: str
    safety: int
    recipe: Recipe
    tag: str | None = None
    style: dict[str, str] | None = None
    only_child: bool = False
    paints_nothing: bool = False
    where: Callable[[], Column] | None = None
    raw: bool = False  # without the guards
    cases: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self):
        if not re.fullmatch(r"[a-z][a-z0-9]*(-[a-z0-9]+)*", self.name):
            raise ValueError(f"no pattern name: {self.name!r}")
        if not SAFEST <= self.safety <= LOOSEST:
            raise ValueError(f"{self.name}: no safety level {self.safety}")
        if self.tag is None and not self.style and self.where is None:
            raise ValueError(f"{self.name}: matches every element")

    def match(self) -> Column:
        tests = [is_element(self.tag), F.col("parent_id").isNotNull()]
        tests += [computed(self.style)] if self.style else []
        tests += [only_child()] if self.only_child else []
        tests += [~paints()] if self.paints_nothing else []
        tests += [self.where()] if self.where else []
        return all_of(*tests, *([] if self.raw else [~guarded(self.recipe.change)]))


def ordered(patterns: list[Pattern], names: list[str] | None = None) -> list[Pattern]:
    """By safety, then name; those of ``names`` alone if given.  Names are unique."""
    if len({p.name for p in patterns}) < len(patterns):
        raise ValueError("two patterns share a name")
    if names is not None and set(names) - {p.name for p in patterns}:
        raise ValueError(f"unknown patterns {sorted(set(names) - {p.name for p in patterns})}")
    return sorted((p for p in patterns if names is None or p.name in names), key=lambda p: (p.safety, p.name))


def styled(nodes: DataFrame, parsed: DataFrame) -> DataFrame:
    """Nodes (with ``set_id``) and their ``style`` (map of condition and property to value and importance),
    ``unknown`` classes and whether a selector reaches them (``coupled``).

    Class lists are resolved once for each distinct list of a sheet set, then joined back.
    """
    from tessella.sources import stylesheet as C

    lists = nodes.where(F.size("classes") > 0).select("set_id", "classes").distinct().withColumn("key", F.struct("set_id", "classes"))
    tokens = lists.select("key", "set_id", F.explode("classes").alias("token")).distinct()
    decls = R.winners(C.rules(parsed))
    pair = F.struct(F.struct("cond", "property").alias("k"), F.struct("value", "important").alias("v"))
    styles = R.resolved(tokens, decls).groupBy("key").agg(F.map_from_entries(F.collect_list(pair)).alias("style"))
    unknown = R.unknown(tokens, decls).groupBy("key").agg(F.array_sort(F.collect_set("token")).alias("unknown"))
    reached = R.coupled(tokens, C.usage(parsed), C.complex_selectors(parsed)).withColumn("coupled", F.lit(True))
    known = lists.join(styles, "key", "left").join(unknown, "key", "left").join(reached, "key", "left").drop("key")
    none = F.map_from_arrays(F.array(), F.array()).cast(styles.schema["style"].dataType)
    out = nodes.join(known, ["set_id", "classes"], "left")
    return out.withColumns({"style": F.coalesce("style", none), "unknown": F.coalesce("unknown", F.array().cast("array<string>")), "coupled": F.coalesce("coupled", F.lit(False))})


def matches(styled_nodes: DataFrame, patterns: list[Pattern], ceiling: int = 2) -> DataFrame:
    """(doc_id, node_id, pattern, edit): of each node the first pattern in order that fits, within the ceiling."""
    usable = [p for p in ordered(patterns) if p.safety <= ceiling]
    first = F.coalesce(F.lit(None).cast("string"), *(F.when(p.match(), F.lit(p.name)) for p in usable))
    edit = F.coalesce(F.lit(None).cast(EDIT), *(F.when(F.col("pattern") == p.name, p.recipe.edits()) for p in usable))
    return styled_nodes.withColumn("pattern", first).where("pattern is not null").select("doc_id", "node_id", "pattern", edit.alias("edit"))
