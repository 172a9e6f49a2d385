"""Styles of elements put together and compared, by joins on (key, cond, property).

A style is a table (key, cond, property, value, important), one row for each declaration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import inherited, relative

AT = ["key", "cond", "property"]
COLUMNS = [*AT, "value", "important"]
POLICIES = ("target-wins", "source-wins", "abort")


def fold_inherited(wrapper: DataFrame, child: DataFrame) -> DataFrame:
    """The child's style with what it inherits from its wrapper (under the same key) and doesn't set itself.

    Values that depend on the parent's size aren't carried over.
    """
    passed = wrapper.where(inherited(F.col("property")) & ~relative(F.col("value")))
    return child.select(COLUMNS).unionByName(passed.join(child, AT, "left_anti").select(COLUMNS))


def merge_styles(target: DataFrame, source: DataFrame, policy: str) -> DataFrame:
    """The target's style with the source's; ``abort`` leaves a key with any differing value as it is.

    One shuffle by declaration; ``abort`` gathers a key's few declarations in a second one.
    """
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    mark = lambda df, n: df.select(*AT, F.struct("value", "important").alias("d"), F.lit(n).alias("side"))
    both = mark(target, 0).unionByName(mark(source, 1))
    pick = F.min_by if policy == "target-wins" else F.max_by
    if policy != "abort":
        return both.groupBy(AT).agg(pick("d", "side").alias("d")).select(*AT, "d.value", "d.important")
    each = both.groupBy(AT).agg(F.min_by("d", "side").alias("t"), F.max_by("d", "side").alias("s"), F.min("side").alias("side"))
    own = F.collect_list(F.struct("cond", "property", F.col("t.value").alias("value"), F.col("t.important").alias("important"), F.col("s.value").alias("other"), F.col("s.important").alias("other_important"), "side"))
    whole = each.groupBy("key").agg(own.alias("rows"), F.max(F.col("t.value") != F.col("s.value")).alias("clash"))
    rows = whole.select("key", "clash", F.explode("rows").alias("x")).where("not clash or x.side = 0")
    mine = lambda a, b: F.when(F.col("clash"), F.col(f"x.{a}")).otherwise(F.col(f"x.{b}"))
    return rows.select("key", "x.cond", "x.property", mine("value", "other").alias("value"), mine("important", "other_important").alias("important"))


def residual(computed: DataFrame, covered: DataFrame) -> DataFrame:
    """Declarations that the covering ones don't give, with the same value and importance."""
    return computed.join(covered, COLUMNS, "left_anti").select(COLUMNS)


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose styles aren't the same set of declarations."""
    mark = lambda df, n: df.select(*COLUMNS, F.lit(n).alias("side"))
    sides = mark(before, 1).unionByName(mark(after, 2)).groupBy(COLUMNS).agg(F.bit_or("side").alias("sides"))
    return sides.where("sides <> 3").select("key").distinct()
