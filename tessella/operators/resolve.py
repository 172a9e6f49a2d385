"""Styles by joins: class tokens with rules, the later rule winning; what selectors couple."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.sources.utilities import declared


#: Most declarations (some 100 bytes each) that are broadcast; with more, Spark shuffles and splits hot tokens.
BROADCAST_ROWS = 200_000


def _beside(decls: DataFrame) -> DataFrame:
    """Declarations or roles as the smaller side of a join with tokens, broadcast if they are found to be few."""
    return F.broadcast(decls) if decls.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else decls


def winners(rules: DataFrame) -> DataFrame:
    """Of each token, condition and property the last declaration."""
    last = F.max_by(F.struct("value", "important"), F.col("seq"))
    return rules.groupBy("set_id", "token", "cond", "property").agg(last.alias("d"), F.max("seq").alias("seq")).select("set_id", "token", "cond", "property", "d.value", "d.important", "seq")


def resolved(tokens: DataFrame, decls: DataFrame) -> DataFrame:
    """(key, cond, property, value, important) of tokens (key, set_id, token): the greatest rule order wins,
    whatever the order of the tokens."""
    hit = tokens.join(_beside(decls), ["set_id", "token"])
    return hit.groupBy("key", "cond", "property").agg(F.max_by(F.struct("value", "important"), "seq").alias("d")).select("key", "cond", "property", "d.value", "d.important")


def unknown(tokens: DataFrame, decls: DataFrame) -> DataFrame:
    """Tokens without a rule of their own, those that only complex selectors name among them."""
    return tokens.join(_beside(decls.select("set_id", "token").distinct()), ["set_id", "token"], "left_anti")


def coupled(tokens: DataFrame, usage: DataFrame, complex_: DataFrame) -> DataFrame:
    """Keys whose element a combinator or a structural selector reaches."""
    role = usage.where("ancestor or sibling or argument or structural").join(complex_.select("set_id").distinct(), "set_id", "left_semi")
    return tokens.join(_beside(role.select("set_id", "token").distinct()), ["set_id", "token"], "left_semi").select("key").distinct()


def droppable(tokens: DataFrame, usage: DataFrame) -> DataFrame:
    return tokens.join(_beside(usage.where("droppable").select("set_id", "token")), ["set_id", "token"], "left_semi")


def candidates(vocab: DataFrame, target: DataFrame) -> DataFrame:
    """(key, token): entries of a key's own vocabulary (set_id, token, declarations) all of whose declarations
    its target (key, set_id, declarations) holds: relational division."""
    size = vocab.groupBy("set_id", "token").agg(F.count(F.lit(1)).alias("size"))
    hit = target.join(_beside(vocab), ["set_id", "cond", "property", "value", "important"]).groupBy("key", "set_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return hit.join(size, ["set_id", "token"]).where("n = size").select("key", "token")


def competing(inline: DataFrame, risks: DataFrame) -> DataFrame:
    """The declarations of style attributes (key, set_id, tag, classes, property) that some rule which a class
    list alone doesn't decide may set too: for any element, by tag, or by class."""
    every = inline.join(risks.where("every").select("set_id", "property").distinct(), ["set_id", "property"], "left_semi")
    tags = risks.where("not every").select("set_id", "property", F.explode("tags").alias("tag")).distinct()
    by_tag = inline.join(tags, ["set_id", "property", "tag"], "left_semi")
    classes = risks.where("not every").select("set_id", "property", F.explode("classes").alias("token")).distinct()
    by_class = inline.withColumn("token", F.explode("classes")).join(classes, ["set_id", "property", "token"], "left_semi").drop("token")
    return every.unionByName(by_tag).unionByName(by_class).select("key", "property").distinct()


def single_child_wrappers(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'element' and n_elements = 1").select("doc_id", "node_id", "tag")


def siblings(nodes: DataFrame) -> DataFrame:
    """Of each element its place among element siblings (from 1) and its neighbours."""
    by = W.partitionBy("doc_id", "parent_id").orderBy("ordinal")
    return nodes.where("kind = 'element'").select("doc_id", "node_id", "tag", F.row_number().over(by).alias("nth"), F.lag("node_id").over(by).alias("prev"), F.lead("node_id").over(by).alias("next"))


def fingerprints(nodes: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): of a document's nodes in pre-order, by number and kind."""
    node = F.struct("node_id", "kind")
    listed = F.transform(F.array_sort(F.collect_list(node)), lambda n: F.concat_ws(":", n["node_id"].cast("string"), n["kind"]))
    return nodes.groupBy("doc_id").agg(F.sha2(F.array_join(listed, ","), 256).alias("fingerprint"))


_DECLARED = "array<struct<cond:string,property:string,value:string,important:boolean>>"


def utility_declarations(tokens: DataFrame) -> DataFrame:
    """(token, cond, property, value, important) of the distinct tokens of (key, pos, token), read once each."""
    read = F.udf(lambda t: [(c, p, v, i) for (c, p), (v, i) in declared(t) or ()], _DECLARED, useArrow=True)
    each = tokens.select("token").distinct().select("token", F.explode(read("token")).alias("d"))
    return each.select("token", "d.*")


def utility_resolved(tokens: DataFrame, decls: DataFrame) -> DataFrame:
    """(key, cond, property, value, important) of tokens (key, pos, token): of a list the later one wins."""
    hit = tokens.join(_beside(decls), "token")
    return hit.groupBy("key", "cond", "property").agg(F.max_by(F.struct("value", "important"), "pos").alias("d")).select("key", "cond", "property", "d.value", "d.important")
