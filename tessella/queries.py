"""The engine's own queries by name, with SQL for DuckDB to hold them against.

Where ``pages`` would leave an operator idle, markup is made from relational columns by the same
string formula on both sides, and the answer has a closed form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.functions import styles as Y
from tessella.operators import edits as E
from tessella.operators import merge as G
from tessella.operators import resolve as R
from tessella.plans import audit as A
from tessella.sources import files as L
from tessella.sources import markup as M
from tessella.sources import stylesheet as C


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark, d):
    return _table(spark, d, "pages").select("page_id", "url", "html")


# ---- formula corpora ------------------------------------------------------------------------

_NESTED = "concat(repeat('<div>', cast(o_orderkey % 4 as int)), '<span id=\"k', cast(o_orderkey as varchar), '\">', o_orderpriority, '</span>', repeat('</div>', cast(o_orderkey % 4 as int)))"
_INNER = "concat('<span id=\"k', cast(o_orderkey as varchar), '\">', o_orderpriority, '</span>')"
_BARRIER = "concat('<div', case o_custkey % 4 when 1 then ' id=\"w\"' when 2 then ' onclick=\"f()\"' when 3 then ' class=\"nope\"' else '' end, '><p>', o_orderpriority, '</p></div>')"
_BARRIER_OUT = "case o_custkey % 4 when 0 then concat('<p>', o_orderpriority, '</p>') else {} end".format(_BARRIER)
SHEET = ".a{color:red}.b{margin:0px}.c{color:red;margin:0}.d{padding:1px 2px}.e{color:#FFF}.f .g{top:0}.h:hover{color:blue}"
_CLASSES = "case p_size % 6 when 0 then 'a b' when 1 then 'b a' when 2 then 'c' when 3 then 'a e' when 4 then 'd zz' else 'h a' end"
_COVERED = "case p_size % 6 when 0 then 'c' when 1 then 'c' when 2 then 'c' when 3 then 'e' when 4 then 'd zz' else 'h a' end"
_GRID = ".g{display:grid}.x{display:flex}.f{display:flex;align-items:center;justify-content:center}.p{place-self:center}.q{color:red}"
_CENTRE = "concat('<section class=\"', case p_size % 3 when 0 then 'g' when 1 then 'x' else 'q' end, '\"><div class=\"f\"><p class=\"q\">', p_name, '</p></div></section>')"
_CENTRE_OUT = "case p_size % 3 when 0 then concat('<section class=\"g\"><p class=\"q p\">', p_name, '</p></section>') else {} end".format(_CENTRE)


def _spark(sql: str) -> str:
    return sql.replace("varchar", "string")


def _orders(spark, d, formula):
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_spark(formula)).alias("text"))


def _parts(spark, d, formula):
    return _table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_spark(formula)).alias("text"))


def _outputs(docs, css=None):
    return A.optimize_documents(docs, "doc_id", "text", None if css is None else F.lit(css))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents of the nested corpus with the most savable bytes, and its score."""
    stats = A.file_stats(_outputs(_orders(spark, sf_dir, _NESTED)), "doc_id")
    return A.worst(stats, "doc_id").crossJoin(F.broadcast(A.audit_totals(stats).select("score")))  # one row


# ---- queries --------------------------------------------------------------------------------


def class_token_count(spark, d):
    return _pages(spark, d).select("page_id", S.class_token_count(F.col("html")).alias("n_classes"))


def byte_totals(spark, d):
    return _pages(spark, d).agg(F.sum(S.byte_count(F.col("html"))).alias("bytes"), F.count(F.lit(1)).alias("files"))


def tag_histogram(spark, d):
    tags = F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1))
    return _pages(spark, d).select(tags.alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def inline_stylesheets(spark, d):
    return C.inline_sheets(_pages(spark, d), "page_id", "html").select("page_id", F.col("pos").cast("long").alias("pos"), "css")


def sheet_sets(spark, d):
    keyed, sets = C.sheet_sets(C.inline_sheets(_pages(spark, d), "page_id", "html"), "page_id")
    return keyed.join(sets, "set_id").groupBy("set_id", "css").agg(F.count(F.lit(1)).alias("pages"))


_VALUES = ["#FFF", "  0px  auto ", "transparent", "RGBA(0,0,0,.5)", "1.0px", "0%", "#00000000", "#AbCdEf", "calc(0px + 1em)"]
_CANON = ["#ffffff", "0 auto", "rgba(0, 0, 0, 0)", "rgba(0, 0, 0, .5)", "1.0", "0%", "rgba(0, 0, 0, 0)", "#abcdef", "calc(0 + 1em)"]


def canon_values(spark, d):
    raw = F.element_at(F.array(*map(F.lit, _VALUES)), (F.col("p_partkey") % len(_VALUES) + 1).cast("int"))
    return _table(spark, d, "part").select("p_partkey", S.canonical_value(raw).alias("value"))


def shorthand_expand(spark, d):
    value = F.expr("case p_size % 4 when 0 then '1px' when 1 then '1px 2px' when 2 then '1px 2px 3px' else '1px 2px 3px 4px' end")
    got = _table(spark, d, "part").select("p_partkey", F.explode(S.longhands(F.lit("padding"), value)).alias("x"))
    return got.select("p_partkey", "x.property", "x.value")


def condition_keys(spark, d):
    e = _table(spark, d, "events")
    return e.select("event_id", S.condition_key(F.lit(""), F.array(F.lit(":hover"), F.col("event_type")), F.lit("")).alias("cond"))


def _tokens(spark, d):
    sheets = spark.createDataFrame([("s", SHEET)], "set_id string, css string")
    parsed = C.parsed_sheets(sheets)
    p = _table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lit("s").alias("set_id"), F.posexplode(S.tokens(F.expr(_CLASSES))).alias("pos", "token"))
    return p, parsed


def forward_resolve(spark, d):
    tokens, parsed = _tokens(spark, d)
    got = R.resolved(tokens, R.winners(C.rules(parsed)))
    return got.select("key", "cond", "property", "value", "important")


def unknown_tokens(spark, d):
    tokens, parsed = _tokens(spark, d)
    return R.unknown(tokens, R.winners(C.rules(parsed))).select("key", "token")


def cascade_last_wins(spark, d):
    _, parsed = _tokens(spark, d)
    return R.winners(C.rules(parsed)).select("token", "cond", "property", "value")


def selector_usage(spark, d):
    _, parsed = _tokens(spark, d)
    return C.usage(parsed).select("token", "subject", "ancestor", "droppable")


def droppable_tokens(spark, d):
    tokens, parsed = _tokens(spark, d)
    return R.droppable(tokens, C.usage(parsed)).select("key", "token")


def cover_candidates(spark, d):
    tokens, parsed = _tokens(spark, d)
    w = R.winners(C.rules(parsed))
    return R.candidates(w, R.resolved(tokens, w).withColumn("set_id", F.lit("s")))


def single_child_wrappers(spark, d):
    return R.single_child_wrappers(M.nodes(_orders(spark, d, _NESTED), "doc_id", "text")).where("tag = 'div'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("wrappers"))


def nth_child(spark, d):
    docs = _parts(spark, d, "concat('<ul>', repeat('<li>x</li>', cast(p_size % 5 as int)), '</ul>')")
    got = R.siblings(M.nodes(docs, "doc_id", "text")).where("tag = 'li'")
    return got.groupBy("doc_id").agg(F.max("nth").cast("long").alias("last"), F.count("prev").alias("with_prev"), F.count("next").alias("with_next"))


def depths(spark, d):
    got = M.nodes(_orders(spark, d, _NESTED), "doc_id", "text").where("tag = 'span'")
    return got.select("doc_id", F.col("depth").cast("long").alias("depth"))


def flatten_fixpoint(spark, d):
    return _outputs(_orders(spark, d, _NESTED)).select("doc_id", "text_after", "nodes_removed")


def flatten_barriers(spark, d):
    return _outputs(_orders(spark, d, _BARRIER), "").select("doc_id", "text_after")


def centring(spark, d):
    return _outputs(_parts(spark, d, _CENTRE), _GRID).select("doc_id", "text_after")


def compress_classes(spark, d):
    docs = _parts(spark, d, f"concat('<p class=\"', {_CLASSES}, '\">x</p>')")
    return _outputs(docs, SHEET).select("doc_id", "text_after")


def fragment_optimize(spark, d):
    text = "concat('<div>', case o_orderkey % 3 when 0 then '' when 1 then 'x' else '<!-- c -->' end, '<b>', o_orderpriority, '</b></div>')"
    return A.optimize_fragments(_orders(spark, d, text), "doc_id", "text")


def _stats(spark, d):
    return A.file_stats(_outputs(_orders(spark, d, _NESTED)), "doc_id")


def file_stats(spark, d):
    return _stats(spark, d)


def audit_totals(spark, d):
    return A.audit_totals(_stats(spark, d))


def audit_worst5(spark, d):
    return A.worst(_stats(spark, d), "doc_id")


def run_totals(spark, d):
    return A.run_totals(_stats(spark, d))


def build_totals(spark, d):
    return A.build_totals(_stats(spark, d))


def pages_rewritten(spark, d):
    """Whole pages with their own stylesheets, in one map; the tree builder is beyond SQL."""
    return A.file_stats(A.optimize_documents(_pages(spark, d), "page_id", "html", C.own_css(F.col("html"))), "page_id")


_LIST = "concat('<p>a</p><ul><li>', o_orderpriority, '</li></ul>')"
_EDITS = (  # edit, target, other, index, markup, and the outline of the body after it ({} the list's text)
    ("remove", 4, None, None, None, "ul li {}"), ("unwrap", 6, None, None, None, "p a li {}"), ("replace", 4, None, None, "<i>x</i>", "i x ul li {}"), ("wrap", 4, None, None, "<div></div>", "div p a ul li {}"),
    ("insert_before", 4, None, None, "<i>x</i>", "i x p a ul li {}"), ("insert_after", 4, None, None, "<i>x</i>", "p a i x ul li {}"), ("move", 4, 6, 5, None, "ul li {} p a"), ("merge", 4, 6, None, None, "p a li {}"),
)


def tree_edits(spark, d):
    kinds = F.array(*(F.array(F.struct(*map(F.lit, e[:5]), F.lit(None), F.lit(1)).cast(E.EDIT)) for e in _EDITS))
    docs = _table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_LIST).alias("text"), F.get(kinds, (F.col("o_custkey") % len(_EDITS)).cast("int")).alias("edits"))
    names = F.transform(F.filter("nodes", lambda n: n["kind"] != "fragment"), lambda n: F.coalesce(n["text_value"], n["tag"]))
    return E.edit_documents(docs, "doc_id", "text", "edits").select("doc_id", F.array_join(names, " ").alias("outline"), F.col("applied").cast("long").alias("applied"), F.size("refused").cast("long").alias("refused"))


def readable_sizes(spark, d):
    n = F.col("o_orderkey") * F.col("o_orderkey") * 37
    return _table(spark, d, "orders").select("o_orderkey", S.readable_bytes(n).alias("bytes"), S.readable_count(n).alias("count"))


_VARIANTS = (("hover:p-4", "hover:", "p-4"), ("data-[state=open]:p-4", "data-[state=open]:", "p-4"), ("[color:red]", None, None), ("md:hover:bg-[url(http://x)]", "md:hover:", "bg-[url(http://x)]"))


def utility_tokens(spark, d):
    token = F.get(F.array(*(F.lit(v[0]) for v in _VARIANTS)), (F.col("p_size") % len(_VARIANTS)).cast("int"))
    got = _table(spark, d, "part").select("p_partkey", S.variant_split(token).alias("v"), S.arbitrary_value(F.col("p_name")).alias("arbitrary"))
    return got.select("p_partkey", "v.chain", "v.root", "arbitrary")


_PATH = "case event_id % 5 when 0 then '/r/a.TSX?x=1' when 1 then '/r/s/b.html' when 2 then '/s/c.htm' when 3 then '/r/dist/d.jsx' else '/r/e.css' end"


def file_routes(spark, d):
    e = _table(spark, d, "events").select("event_id", F.expr(_PATH).alias("path"))
    return e.select("event_id", L.kind(F.col("path")).alias("kind"), L.destination(F.col("path"), "/r", "/o").alias("mirrored"), L.destination(F.col("path"), "/r", "/r").alias("in_place"))


_AFTER = "case o_custkey % 3 when 0 then concat('a', chr(10), o_orderpriority, chr(10), 'z') when 1 then concat('a', chr(10), 'Y', chr(10), 'z') else concat('a', chr(10), o_orderpriority, chr(10), 'z', chr(10), 'w') end"


def line_diffs(spark, d):
    before = F.expr("concat('a', chr(10), o_orderpriority, chr(10), 'z')")
    return _table(spark, d, "orders").select("o_orderkey", L.line_diff(before, F.expr(_AFTER), F.lit("f")).alias("diff"))


def _style(spark, d, *pairs):
    """A style for each part; a value may be SQL over its columns, null for no declaration."""
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.expr(v).alias("value")) for p, v in pairs)))
    got = _table(spark, d, "part").select(F.col("p_partkey").alias("key"), rows.alias("x")).where("x.value is not null")
    return got.select("key", F.lit("||").alias("cond"), "x.property", "x.value", F.lit(False).alias("important"))


_COLOUR = "case p_size % 2 when 0 then 'red' else 'blue' end"


def _merged_pair(spark, d):
    return _style(spark, d, ("color", "'red'"), ("margin-top", "'0'")), _style(spark, d, ("color", _COLOUR), ("top", "'1px'"))


def style_merge(spark, d):
    target, source = _merged_pair(spark, d)
    one = lambda p: G.merge_styles(target, source, p).select(F.lit(p).alias("policy"), "key", "property", "value")
    return one("target-wins").unionByName(one("source-wins")).unionByName(one("abort"))


def inherited_fold(spark, d):
    wrapper = _style(spark, d, ("color", "'blue'"), ("font-size", "'2em'"), ("margin-top", "'1px'"), ("cursor", "'help'"))
    child = _style(spark, d, ("color", "case p_size % 2 when 0 then 'red' end"), ("top", "'0'"))
    return G.fold_inherited(wrapper, child).select("key", "property", "value")


def style_residual(spark, d):
    target, source = _merged_pair(spark, d)
    return G.residual(source, target).select("key", "property", "value")


def style_difference(spark, d):
    target, _ = _merged_pair(spark, d)
    return G.differing(target, _style(spark, d, ("color", _COLOUR), ("margin-top", "'0'")))


_INLINE = (("color: RED; padding: 1px 2px", "color:RED padding-top:1px padding-right:2px padding-bottom:1px padding-left:2px"), ("color:red; bad", None), ("overflow:hidden !important", "overflow-x:hidden! overflow-y:hidden!"), ("top:1px;inset:0", None), ("background:url(a;b)", "background:url(a;b)"))


def inline_declarations(spark, d):
    text = F.get(F.array(*(F.lit(x[0]) for x in _INLINE)), (F.col("s_suppkey") % len(_INLINE)).cast("int"))
    read = F.udf(Y.inline_style, "array<struct<property:string,value:string,important:boolean>>", useArrow=True)
    parts = F.transform(read(text), lambda x: F.concat(x["property"], F.lit(":"), x["value"], F.when(x["important"], "!").otherwise("")))
    return _table(spark, d, "supplier").select("s_suppkey", F.array_join(parts, " ").alias("style"))


QUERIES = {f.__name__: f for f in (
    class_token_count, byte_totals, tag_histogram, inline_stylesheets, sheet_sets, canon_values, shorthand_expand, condition_keys,
    forward_resolve, unknown_tokens, cascade_last_wins, selector_usage, droppable_tokens, cover_candidates, single_child_wrappers, nth_child, depths,
    flatten_fixpoint, flatten_barriers, centring, compress_classes, fragment_optimize, file_stats, audit_totals, audit_worst5, run_totals, build_totals, pages_rewritten,
    tree_edits, readable_sizes, utility_tokens, file_routes, line_diffs,
    style_merge, inherited_fold, style_residual, style_difference, inline_declarations,
)}

_STATS = f"""SELECT o_orderkey AS doc_id, o_orderkey % 4 > 0 AS changed, 7 + o_orderkey % 4 - 1 AS nodes_before, o_orderkey % 4 AS nodes_removed, CAST(0 AS BIGINT) AS classes_before,
  CAST(0 AS BIGINT) AS classes_saved, CAST(octet_length(encode({_NESTED})) AS BIGINT) AS bytes_before, 11 * (o_orderkey % 4) AS bytes_saved FROM orders"""
_RULES = "(VALUES ('a','||','color','red',1), ('b','||','margin-top','0',2), ('b','||','margin-right','0',2), ('b','||','margin-bottom','0',2), ('b','||','margin-left','0',2), ('c','||','color','red',3), ('c','||','margin-top','0',3), ('c','||','margin-right','0',3), ('c','||','margin-bottom','0',3), ('c','||','margin-left','0',3), ('d','||','padding-top','1px',4), ('d','||','padding-right','2px',4), ('d','||','padding-bottom','1px',4), ('d','||','padding-left','2px',4), ('e','||','color','#ffffff',5), ('h','|:hover|','color','blue',6)) r(token, cond, property, value, ord)"
_TOK = f"(SELECT p_partkey AS key, unnest(string_split({_CLASSES}, ' ')) AS token FROM part) t"
_CASES = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_CANON))

SQL = {
    "class_token_count": "SELECT page_id, CAST(len(list_filter(flatten(list_transform(regexp_extract_all(html, '\\b(?:className|class)\\s*=\\s*\"([^\"]*)\"', 1), lambda x: string_split_regex(x, '\\s+'))), lambda y: y <> '')) AS BIGINT) AS n_classes FROM pages",
    "byte_totals": "SELECT CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes, count(*) AS files FROM pages",
    "tag_histogram": "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag",
    "inline_stylesheets": "SELECT page_id, CAST(unnest(range(len(regexp_extract_all(html, '(?s)<style>(.*?)</style>', 1)))) AS BIGINT) AS pos, unnest(regexp_extract_all(html, '(?s)<style>(.*?)</style>', 1)) AS css FROM pages",
    "sheet_sets": "SELECT sha256(css) AS set_id, css, count(*) AS pages FROM (SELECT array_to_string(regexp_extract_all(html, '(?s)<style>(.*?)</style>', 1), chr(10)) AS css FROM pages WHERE html LIKE '%<style>%') GROUP BY css",
    "canon_values": f"SELECT p_partkey, CASE p_partkey % {len(_VALUES)} {_CASES} END AS value FROM part",
    "shorthand_expand": "SELECT p_partkey, 'padding-' || side AS property, CASE p_size % 4 WHEN 0 THEN '1px' WHEN 1 THEN CASE WHEN k % 2 = 0 THEN '1px' ELSE '2px' END WHEN 2 THEN ['1px','2px','3px','2px'][k + 1] ELSE ['1px','2px','3px','4px'][k + 1] END AS value FROM part, (VALUES ('top',0),('right',1),('bottom',2),('left',3)) s(side, k)",
    "condition_keys": "SELECT event_id, '|' || array_to_string(list_sort([':hover', event_type]), ',') || '|' AS cond FROM events",
    "forward_resolve": f"SELECT key, cond, property, arg_max(value, ord) AS value, false AS important FROM {_TOK} JOIN {_RULES} USING (token) GROUP BY key, cond, property",
    "unknown_tokens": f"SELECT key, token FROM {_TOK} WHERE token NOT IN (SELECT token FROM {_RULES})",
    "cascade_last_wins": f"SELECT token, cond, property, arg_max(value, ord) AS value FROM {_RULES} GROUP BY token, cond, property",
    "selector_usage": "SELECT * FROM (VALUES ('a',true,false,true),('b',true,false,true),('c',true,false,true),('d',true,false,true),('e',true,false,true),('f',false,true,false),('g',true,false,true),('h',true,false,false)) u(token, subject, ancestor, droppable)",
    "droppable_tokens": f"SELECT key, token FROM {_TOK} WHERE token IN ('a','b','c','d','e')",
    "cover_candidates": f"""WITH r AS (SELECT * FROM {_RULES}), c AS (SELECT key, cond, property, arg_max(value, ord) AS value FROM {_TOK} JOIN r USING (token) GROUP BY key, cond, property)
      SELECT key, token FROM (SELECT key, r.token, count(*) AS n FROM c JOIN r USING (cond, property, value) GROUP BY key, r.token) JOIN (SELECT token, count(*) AS size FROM r GROUP BY token) USING (token) WHERE n = size""",
    "single_child_wrappers": "SELECT o_orderkey AS doc_id, o_orderkey % 4 AS wrappers FROM orders WHERE o_orderkey % 4 > 0",
    "nth_child": "SELECT p_partkey AS doc_id, CAST(p_size % 5 AS BIGINT) AS last, CAST(p_size % 5 - 1 AS BIGINT) AS with_prev, CAST(p_size % 5 - 1 AS BIGINT) AS with_next FROM part WHERE p_size % 5 > 0",
    "depths": "SELECT o_orderkey AS doc_id, o_orderkey % 4 + 3 AS depth FROM orders",
    "flatten_fixpoint": f"SELECT o_orderkey AS doc_id, {_INNER} AS text_after, o_orderkey % 4 AS nodes_removed FROM orders",
    "flatten_barriers": f"SELECT o_orderkey AS doc_id, {_BARRIER_OUT} AS text_after FROM orders",
    "centring": f"SELECT p_partkey AS doc_id, {_CENTRE_OUT} AS text_after FROM part",
    "compress_classes": f"SELECT p_partkey AS doc_id, concat('<p class=\"', {_COVERED}, '\">x</p>') AS text_after FROM part",
    "fragment_optimize": "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN concat('<b>', o_orderpriority, '</b>') WHEN 1 THEN concat('<div>x<b>', o_orderpriority, '</b></div>') ELSE concat('<div><!-- c --><b>', o_orderpriority, '</b></div>') END AS text_after FROM orders",
    "file_stats": _STATS,
    "audit_totals": f"""WITH s AS ({_STATS}), t AS (SELECT count(*) AS files, count(*) FILTER (nodes_removed > 0) AS files_improvable, CAST(sum(nodes_before) AS BIGINT) AS nodes_total, CAST(sum(bytes_before) AS BIGINT) AS bytes_total,
      CAST(sum(nodes_removed) AS BIGINT) AS nodes_removable, CAST(0 AS BIGINT) AS classes_compressible, CAST(sum(bytes_saved) AS BIGINT) AS bytes_savable FROM s)
      SELECT *, CAST(round(100 * (1 - bytes_savable / bytes_total) * (1 - nodes_removable / nodes_total)) AS BIGINT) AS score FROM t""",
    "audit_worst5": f"SELECT CAST(doc_id AS VARCHAR) AS id, bytes_saved AS bytes_savable, nodes_removed, classes_saved FROM ({_STATS}) WHERE nodes_removed > 0 ORDER BY bytes_savable DESC, id LIMIT 5",
    "run_totals": f"SELECT count(*) AS files, count(*) FILTER (changed) AS changed, CAST(sum(nodes_removed) AS BIGINT) AS nodes_removed, CAST(sum(classes_saved) AS BIGINT) AS classes_saved, CAST(sum(bytes_saved) AS BIGINT) AS bytes_saved FROM ({_STATS})",
    "build_totals": f"SELECT count(*) AS files, count(*) FILTER (changed) AS changed, CAST(sum(nodes_removed) AS BIGINT) AS nodes_removed, CAST(sum(classes_saved) AS BIGINT) AS classes_saved, CAST(sum(bytes_saved) AS BIGINT) AS bytes_saved FROM ({_STATS}) WHERE changed",
    "tree_edits": "SELECT o_orderkey AS doc_id, 'html head body ' || CASE o_custkey % 8 " + " ".join(f"WHEN {k} THEN '{e[5]}'".replace("{}", "' || o_orderpriority || '") for k, e in enumerate(_EDITS)) + " END AS outline, CAST(1 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS refused FROM orders",
    "readable_sizes": "SELECT o_orderkey, CASE " + " ".join(f"WHEN n < {1024 ** (k + 1)} THEN printf('%.1f {u}', round(n / {1024 ** k}, 1))" if k else "WHEN n < 1024 THEN n || ' B'" for k, u in enumerate(("B", "KB", "MB", "GB"))) + " ELSE printf('%.1f TB', round(n / 1099511627776, 1)) END AS bytes, format('{:,}', n) AS count FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 37 AS BIGINT) AS n FROM orders)",
    "utility_tokens": "SELECT p_partkey, " + ", ".join("CASE p_size % 4 " + " ".join(f"WHEN {k} THEN '{v[c]}'" for k, v in enumerate(_VARIANTS) if v[c]) + f" END AS {name}" for c, name in ((1, "chain"), (2, "root"))) + ", CASE WHEN p_name <> '' AND NOT regexp_matches(p_name, '[\\[\\]{}''\"`;_]') THEN regexp_replace(p_name, '\\s+', '_', 'g') END AS arbitrary FROM part",
    "file_routes": "SELECT event_id, ['tsx','html','html','jsx',NULL][event_id % 5 + 1] AS kind, ['/o/a.TSX?x=1','/o/s/b.html','/o/c.htm','/o/dist/d.jsx','/o/e.css'][event_id % 5 + 1] AS mirrored, [NULL,NULL,'/r/c.htm','/r/dist/d.jsx',NULL][event_id % 5 + 1] AS in_place FROM events",
    "line_diffs": "SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN '  (unchanged) f' WHEN 1 THEN concat_ws(chr(10), '--- a/f', '+++ b/f', '@@ -2 +2 @@', '-' || o_orderpriority, '+Y') ELSE concat_ws(chr(10), '--- a/f', '+++ b/f', '@@ -4 +4 @@', '+w') END AS diff FROM orders",
    "style_merge": f"""WITH p AS (SELECT p_partkey AS key, {_COLOUR} AS c, p_size % 2 = 0 AS same FROM part)
      SELECT policy, key, property, CASE property WHEN 'color' THEN CASE policy WHEN 'source-wins' THEN c ELSE 'red' END WHEN 'top' THEN '1px' ELSE '0' END AS value
      FROM p, (VALUES ('target-wins'), ('source-wins'), ('abort')) a(policy), (VALUES ('color'), ('margin-top'), ('top')) b(property) WHERE same OR policy <> 'abort' OR property <> 'top'""",
    "inherited_fold": "SELECT p_partkey AS key, property, CASE property WHEN 'color' THEN CASE p_size % 2 WHEN 0 THEN 'red' ELSE 'blue' END WHEN 'cursor' THEN 'help' ELSE '0' END AS value FROM part, (VALUES ('color'), ('cursor'), ('top')) b(property)",
    "style_residual": "SELECT p_partkey AS key, property, CASE property WHEN 'top' THEN '1px' ELSE 'blue' END AS value FROM part, (VALUES ('color'), ('top')) b(property) WHERE property = 'top' OR p_size % 2 = 1",
    "style_difference": "SELECT p_partkey AS key FROM part WHERE p_size % 2 = 1",
    "inline_declarations": "SELECT s_suppkey, [" + ", ".join("NULL" if x[1] is None else f"'{x[1]}'" for x in _INLINE) + f"][s_suppkey % {len(_INLINE)} + 1] AS style FROM supplier",
}
