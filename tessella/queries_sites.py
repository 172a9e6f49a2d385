"""More of the engine's queries: stylesheets of sites, outputs, conversions, patterns, selectors, streams.

As in ``queries``, markup and stylesheets are made from relational columns by the same formula on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import queries as Q
from tessella.functions import scalars as S
from tessella.operators import edits as E
from tessella.operators import patterns as P
from tessella.operators import resolve as R
from tessella.operators.optimize import Options
from tessella.plans import audit as A
from tessella.sources import files as L
from tessella.sources import markup as M
from tessella.sources import stylesheet as C
from tessella.sources.folders import work_folder
from tessella.streaming import audit as T

# ---- stylesheets of sites -------------------------------------------------------------------

_LINKS = (
    '<link rel="stylesheet" href="../css/a.css?v=1"><link rel=stylesheet href="b.css">',
    '<link rel="preload" href="../css/a.css"><link rel="stylesheet" href="https://x.org/y.css">',
    '<link rel="stylesheet" href="/site/css/b.css"><link rel="stylesheet" href="./../css/a.css#x">',
    '<style>.i{margin:0}</style><style type="text/scss">$x</style><link rel="stylesheet" href="//cdn/x.css"><link rel="stylesheet" href="data:text/css,.z{}">',
)
_FILES = (("/site/css/a.css", ".a{color:red}"), ("/site/css/b.css", ".b{top:0}"), ("/site/p/other.css", ".o{left:0}"))


def _site(spark, d):
    html = F.get(F.array(*map(F.lit, _LINKS)), (F.col("s_suppkey") % len(_LINKS)).cast("int"))
    pages = Q._table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("/site/p/"), F.col("s_suppkey").cast("string"), F.lit(".html")).alias("path"), html.alias("html"))
    return pages, spark.createDataFrame(list(_FILES), "path string, css string")


def linked_stylesheets(spark, d):
    pages, files = _site(spark, d)
    return C.linked_files(pages, "s_suppkey", "path", "html", files).select("s_suppkey", F.col("pos").cast("long").alias("pos"), "path")


def linked_sheet_sets(spark, d):
    pages, files = _site(spark, d)
    keyed, sets = C.sheet_sets(C.inline_sheets(pages, "s_suppkey", "html"), "s_suppkey", C.linked_files(pages, "s_suppkey", "path", "html", files), files)
    return keyed.join(sets, "set_id").groupBy("css").agg(F.count(F.lit(1)).alias("pages"))


def outputs_written(spark, d):
    """Changed documents of the nested formula written to a mirrored folder and read from there."""
    text = F.expr("concat(repeat('<div>', cast(s_suppkey % 3 as int)), '<p>', s_name, '</p>', repeat('</div>', cast(s_suppkey % 3 as int)))")
    docs = Q._table(spark, d, "supplier").select(F.concat(F.lit("/src/d"), (F.col("s_suppkey") % 5).cast("string"), F.lit("/p"), F.col("s_suppkey").cast("string"), F.lit(".html")).alias("path"), text.alias("text"))
    out = work_folder(spark, "outputs")
    L.write_outputs(A.optimize_documents(docs, "path", "text"), "/src", out).write.format("noop").mode("overwrite").save()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(out)
    return found.select(F.regexp_extract("path", r"([^/]*/[^/]*)$", 1).alias("place"), F.col("content").cast("string").alias("text"))


# ---- inline styles --------------------------------------------------------------------------

_UTIL = ".card{background:#fff}.p-4{padding:16px}.hov:hover{padding:2px}article{margin-top:1px}.x .deep{top:0}"
_STYLED = (  # markup and what becomes of it, {} the part's name
    ('<div class="card" style="padding:16px">{}</div>', '<div class="card p-4">{}</div>'),
    ('<div class="card" style="padding:16px !important">{}</div>', None),
    ('<div id="hero" class="card" style="padding:16px">{}</div>', None),
    ('<p class="card" style="--brand: red; padding: 16px">{}</p>', '<p class="card p-4" style="--brand: red">{}</p>'),
    ('<p style="padding: 16px">{}</p>', '<p class="p-4">{}</p>'),
    ('<p class="hov" style="padding: 16px">{}</p>', None),
    ('<p class="nope" style="padding: 16px">{}</p>', None),
    ('<p class="card" style="padding: 16px; padding-top: 16px">{}</p>', None),
    ('<p class="card" style="padding: 3px">{}</p>', None),
    ("<p class=card style='padding:16px'>{}</p>", '<p class="card p-4">{}</p>'),
)


def _case(rows, column: str, n: int, name: str) -> str:
    quote = lambda t: "'" + t.replace("'", "''").replace("{}", f"', {name}, '") + "'"
    return f"CASE {column} % {n} " + " ".join(f"WHEN {k} THEN concat({quote(t)})" for k, t in enumerate(rows)) + " END"


_STYLED_IN = _case([a for a, _ in _STYLED], "p_size", len(_STYLED), "p_name")
_STYLED_OUT = _case([b or a for a, b in _STYLED], "p_size", len(_STYLED), "p_name")


def _python_quotes(sql: str) -> str:
    return sql.replace("''", "\\'")


def inline_to_class(spark, d):
    return Q._outputs(Q._parts(spark, d, _python_quotes(_STYLED_IN)), _UTIL).select("doc_id", "text_after")


def competing_declarations(spark, d):
    """Which declarations of style attributes a rule that a class list alone doesn't decide may set too."""
    parsed = C.parsed_sheets(spark.createDataFrame([("s", _UTIL + ".y>.z{left:0}*{right:0}")], "set_id string, css string"))
    tag = F.expr("case p_size % 3 when 0 then 'article' when 1 then 'p' else 'div' end")
    classes = F.expr("case p_size % 4 when 0 then array('z') when 1 then array('deep', 'card') else array('card') end")
    props = F.explode(F.array(*map(F.lit, ("margin-top", "top", "left", "right", "padding-top"))))
    inline = Q._table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lit("s").alias("set_id"), tag.alias("tag"), classes.alias("classes"), props.alias("property"))
    return R.competing(inline, C.risks(parsed))


def op_counts(spark, d):
    return A.op_totals(Q._outputs(Q._orders(spark, d, Q._NESTED)))


# ---- trees ----------------------------------------------------------------------------------


def document_fingerprints(spark, d):
    docs = Q._parts(spark, d, "concat('<ul>', repeat('<li>x</li>', cast(p_size % 5 as int)), '</ul>')")
    return R.fingerprints(M.nodes(docs, "doc_id", "text"))


def edit_groups(spark, d):
    """Groups of edits of which one is refused, so that none of it is done, and a lone edit that is."""
    edit = lambda op, target, grp, markup=None: F.struct(F.lit(op), F.lit(target), F.lit(None), F.lit(None), F.lit(markup), F.lit(grp), F.lit(1)).cast(E.EDIT)
    bad = F.array(edit("remove", 4, "g"), edit("unwrap", 99, "g"), edit("classes", 6, None, "k l"))
    good = F.array(edit("remove", 4, "g"), edit("classes", 6, "g", "k"), edit("classes", 6, None, ""))
    docs = Q._table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("concat('<p>a</p><p class=\"c d\">', o_orderpriority, '</p>')").alias("text"), F.when(F.col("o_custkey") % 2 == 0, bad).otherwise(good).alias("edits"))
    shown = F.transform(F.filter("nodes", lambda n: n["tag"] == "p"), lambda n: n["classes"])
    got = E.edit_documents(docs, "doc_id", "text", "edits")
    return got.select("doc_id", F.array_join(shown, "|").alias("classes"), F.col("applied").cast("long").alias("applied"), F.element_at(F.concat(F.transform("refused", lambda x: x["reason"]), F.array(F.lit("none"))), 1).alias("refused"))


# ---- selectors ------------------------------------------------------------------------------

_NATION_CSS = "concat('@media (min-width:', n_nationkey, 'px){@media print{.n', n_nationkey, ':hover{top:', n_regionkey, 'px}}}.a', n_nationkey, '>.b', n_nationkey, ':first-child{left:0}.c', n_nationkey, '+.d{right:0}.n', n_nationkey, '::before{top:1px;bottom:0px!important}')"


def _nation_sheet(spark, d):
    css = Q._table(spark, d, "nation").select(F.lit("s").alias("set_id"), F.expr(Q._spark(_NATION_CSS)).alias("css"), "n_nationkey")
    return css.groupBy("set_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "css"))), lambda x: x["css"]), "").alias("css"))


def media_rules(spark, d):
    return R.winners(C.rules(C.parsed_sheets(_nation_sheet(spark, d)))).select("token", "cond", "property", "value", "important")


def selector_roles(spark, d):
    return C.usage(C.parsed_sheets(_nation_sheet(spark, d))).select("token", "subject", "ancestor", "sibling", "structural", "droppable")


def complex_selectors(spark, d):
    return C.complex_selectors(C.parsed_sheets(_nation_sheet(spark, d))).select("selector")


def coupled_elements(spark, d):
    """Customers whose element some combinator or structural selector reaches."""
    parsed = C.parsed_sheets(_nation_sheet(spark, d))
    token = F.expr("concat(case c_custkey % 4 when 0 then 'a' when 1 then 'b' when 2 then 'c' else 'n' end, c_nationkey)")
    tokens = Q._table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("s").alias("set_id"), token.alias("token"))
    return R.coupled(tokens, C.usage(parsed), C.complex_selectors(parsed))


def emitted_css(spark, d):
    """CSS that defines each class, properties in order."""
    rules = R.winners(C.rules(C.parsed_sheets(_nation_sheet(spark, d))))
    decl = F.concat_ws(":", "property", F.concat("value", F.when(F.col("important"), "!important").otherwise("")))
    return rules.groupBy("token", "cond").agg(F.array_join(F.array_sort(F.collect_list(decl)), ";").alias("block"))


# ---- scalars --------------------------------------------------------------------------------


def style_names(spark, d):
    """React names and numbers as CSS, tuple keys and lengths of class lists."""
    name = F.expr("case p_size % 4 when 0 then 'marginTop' when 1 then 'WebkitLineClamp' when 2 then '--x' else 'zIndex' end")
    css = S.kebab(name)
    n = F.col("p_size") % 3
    return Q._table(spark, d, "part").select(
        "p_partkey", css.alias("name"), S.react_value(css, n.cast("double")).alias("value"),
        F.translate(S.tuple_key(F.lit("||"), css, n.cast("string"), n == 1), S.UNIT, "~").alias("tuple"), S.joined_length(F.split("p_type", " ")).cast("long").alias("length"),
    )


# ---- patterns -------------------------------------------------------------------------------

_PATTERN_CSS = ".g{display:grid}.m{display:grid;align-items:center;justify-content:center}.p{place-self:center}.c{display:contents}.q{color:red}.w{top:0}.i{display:inline}.r{position:relative}.f{flex-grow:1}.s{align-self:center}"
_SHAPES = (
    ('<section class="g"><div class="m"><p class="w">{}</p></div></section>', '<section class="g"><p class="w p">{}</p></section>', 0),
    ('<div class="c"><p class="w">{}</p></div>', '<p class="w">{}</p>', 0),
    ('<span class="q"><b class="w">{}</b></span>', '<b class="w q">{}</b>', 0),
    ("<span><b>{}</b></span>", "<b>{}</b>", 0),
    ('<div class="i"><p class="w">{}</p></div>', None, 1),
    ('<div class="r"><p class="w">{}</p></div>', None, 1),
    ('<div class="f"><p class="w">{}</p></div>', None, 1),
    ('<div class="c" onclick="f()"><p>{}</p></div>', None, 0),
)
_SHAPE_IN = _case([a for a, _, _ in _SHAPES], "p_size", len(_SHAPES), "p_name")
_SHAPE_OUT = _case([b or a for a, b, _ in _SHAPES], "p_size", len(_SHAPES), "p_name")


def flatten_patterns(spark, d):
    got = Q._outputs(Q._parts(spark, d, _python_quotes(_SHAPE_IN)), _PATTERN_CSS)
    return got.select("doc_id", "text_after", F.col("n_refused").alias("refused"))


def declared_patterns(spark, d):
    """Declared patterns over the node table: which matches first, and the edit it asks for."""
    declared = [
        P.Pattern("contents", 2, P.flatten_into(), tag="div", style={"display": "contents"}, only_child=True, paints_nothing=True),
        P.Pattern("plain-span", 1, P.flatten_into(), tag="span", only_child=True, where=lambda: P.all_of(F.size("classes") == 0, P.none_of(P.opaque()))),
        P.Pattern("coloured", 2, P.drop_classes("q"), style={"color": "red"}),
        P.Pattern("too-bold", 3, P.drop_classes("w"), tag="b"),
    ]
    nodes = M.nodes(Q._parts(spark, d, _python_quotes(_SHAPE_IN)), "doc_id", "text").withColumn("set_id", F.lit("s"))
    parsed = C.parsed_sheets(spark.createDataFrame([("s", _PATTERN_CSS)], "set_id string, css string"))
    return P.matches(P.styled(nodes, parsed), declared).select("doc_id", "pattern", F.col("edit.op").alias("op"))


_WIDE = ".big{" + ";".join(f"--v{k}:1" for k in range(22)) + "}" + "".join(f".v{k}{{--v{k}:1}}" for k in range(22))


def greedy_cover(spark, d):
    """Styles of more declarations than an exact cover takes on."""
    docs = Q._parts(spark, d, "concat('<p class=\"', case p_size % 2 when 0 then '" + " ".join(f"v{k}" for k in range(22)) + "' else 'v0 v1' end, '\">x</p>')")
    return Q._outputs(docs, _WIDE).select("doc_id", "text_after")


def stream_run_totals(spark, d):
    """The run totals over a stream that brings the orders' documents, once it has brought all."""
    orders = f"{d}/orders.parquet"
    arriving = spark.readStream.schema(spark.read.parquet(orders).schema).parquet(f"{orders.removesuffix('.parquet')}*.parquet")
    docs = arriving.select(F.col("o_orderkey").alias("doc_id"), F.expr(Q._spark(Q._NESTED)).alias("text"))
    out = work_folder(spark, "stream")
    T.write_stats(docs, "doc_id", "text", f"{out}/stats", f"{out}/checkpoint").awaitTermination()
    return A.run_totals(spark.read.parquet(f"{out}/stats"))


# ---- utility classes and component templates ------------------------------------------------

_UTILITY = Options(provider="utility")
_UTILITY_LISTS = (
    ("h-[40px] w-[40px] bg-white", "bg-white size-[40px]"), ("pt-[7px] pb-[7px] pl-[7px] pr-[7px]", "p-[7px]"), ("hover:px-4 hover:py-4 bg-white", "bg-white hover:p-4"), ("md:h-10 md:w-10", "md:size-10"),
    ("hover:px-4 md:py-4", None), ("foo:px-4 px-4 py-4", "foo:px-4 p-4"), ("px-2 px-4 py-4", "p-4"), ("overflow-x-auto overflow-y-auto", "overflow-auto"), ("!mt-2 !mb-2 !ml-2 !mr-2", "!m-2"), ("flex gap-x-2 gap-y-2", "flex gap-2"),
)


def _listed(spark, d):
    lists = F.get(F.array(*(F.lit(a) for a, _ in _UTILITY_LISTS)), (F.col("p_size") % len(_UTILITY_LISTS)).cast("int"))
    return Q._table(spark, d, "part").select(F.col("p_partkey").alias("key"), lists.alias("classes"))


def utility_compress(spark, d):
    docs = _listed(spark, d).select(F.col("key").alias("doc_id"), F.concat(F.lit('<div class="'), "classes", F.lit('">x</div>')).alias("text"))
    return A.optimize_documents(docs, "doc_id", "text", options=_UTILITY).select("doc_id", "text_after")


def utility_resolve(spark, d):
    """Resolved utility lists of parts: steps of the scale by size, the later token winning."""
    classes = F.expr("concat('p-', p_size % 4, ' px-', p_size % 5, ' md:mt-[', p_size, 'px] zz')")
    tokens = Q._table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.posexplode(S.tokens(classes)).alias("pos", "token"))
    return R.utility_resolved(tokens, R.utility_declarations(tokens))


_TEMPLATES = (  # kind, a template and what becomes of it, {} the part's name
    ("jsx", "const A = () => (\n  <div>\n    <p className=\"px-4 py-4\">{}</p>\n  </div>\n);", "const A = () => (\n  <p className=\"p-4\">{}</p>\n);"),
    ("jsx", "const A = xs.map(x => <div key={x}><p>{}</p></div>);", None),
    ("jsx", "const A = a < b && <><b>{}</b></>;", "const A = a < b && <b>{}</b>;"),
    ("jsx", '<div className={clsx("px-4 py-4", c && "px-1 py-1")}>{}</div>', '<div className={clsx("p-4", c && "px-1 py-1")}>{}</div>'),
    ("jsx", '<i className="bg-white" style={{"--brand": 1, padding: 16}}>{}</i>', '<i className="bg-white p-[16px]" style={{"--brand": 1}}>{}</i>'),
    ("jsx", '<i {...rest} className="bg-white" style={{padding: 16}}>{}</i>', None),
    ("jsx", '<i className={`px-4 ${a} py-4`} style={{padding: p}}>{}</i>', None),
    ("vue", '<script>const a = "<div>"</script><template><div><p class="px-4 py-4">{}</p></div></template>', '<script>const a = "<div>"</script><template><p class="p-4">{}</p></template>'),
    ("vue", '<template><div><p class="px-4 py-4">{}</p></div></template><style>.a{top:0}</style>', None),
    ("vue", '<template><div v-if="a"><span><b :class="c">{}</b></span></div></template>', '<template><div v-if="a"><b :class="c">{}</b></div></template>'),
    ("astro", '---\nconst a = "<div>";\n---\n<span><b class="px-4 py-4">{}</b></span><br>', '---\nconst a = "<div>";\n---\n<b class="p-4">{}</b><br>'),
    ("astro", '<ul>{xs.map(x => <li class="px-4 py-4">{}</li>)}</ul>', '<ul>{xs.map(x => <li class="p-4">{}</li>)}</ul>'),
    ("jsx", "return <div {} <", None),
)


def templates_optimized(spark, d):
    kind = F.get(F.array(*(F.lit(k) for k, _, _ in _TEMPLATES)), (F.col("p_size") % len(_TEMPLATES)).cast("int"))
    docs = Q._table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), kind.alias("kind"), F.replace(F.get(F.array(*(F.lit(a) for _, a, _ in _TEMPLATES)), (F.col("p_size") % len(_TEMPLATES)).cast("int")), F.lit("{}"), F.col("p_name")).alias("text"))
    got = A.optimize_documents(docs, "doc_id", "text", options=_UTILITY, kind=F.col("kind"))
    return got.select("doc_id", "text_after", F.col("error").isNotNull().alias("failed"))


def _literal(text: str) -> str:
    return "concat(" + ", chr(10), ".join("'" + x.replace("'", "''") + "'" for x in text.split("\n")) + ")"


_NESTED_CSS = "concat('.n', n_nationkey, '{top:', n_regionkey, 'px;&:hover{left:0}@media print{right:0;& .k{bottom:0}}.x', n_nationkey, '{z-index:1} margin-left:2px}')"


def nested_rules(spark, d):
    """Rules nested in rules, as they would stand outside."""
    css = Q._table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("set_id"), F.expr(Q._spark(_NESTED_CSS)).alias("css"))
    parsed = C.parsed_sheets(css)
    own = R.winners(C.rules(parsed)).select("set_id", F.col("token").alias("name"), "cond", "property", "value")
    return own.unionByName(C.complex_selectors(parsed).select("set_id", F.col("selector").alias("name"), F.lit("").alias("cond"), F.lit("").alias("property"), F.lit("").alias("value")))


def closest_ancestors(spark, d):
    """Of the innermost elements of the nested documents the nearest div around them, and how many elements are."""
    around = M.ancestors(Q._orders(spark, d, Q._NESTED), "doc_id", "text")
    last = around.groupBy("doc_id").agg(F.max("node_id").alias("node_id"))
    near = M.closest(around, "div").join(last, ["doc_id", "node_id"]).select("doc_id", F.col("ancestor_id").cast("long").alias("div"))
    return around.join(last, ["doc_id", "node_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("around")).join(near, "doc_id", "left")


QUERIES = {f.__name__: f for f in (
    linked_stylesheets, linked_sheet_sets, outputs_written, inline_to_class, competing_declarations, op_counts, document_fingerprints, edit_groups,
    media_rules, selector_roles, complex_selectors, coupled_elements, emitted_css, style_names, flatten_patterns, declared_patterns, greedy_cover, stream_run_totals,
    utility_compress, utility_resolve, templates_optimized, nested_rules, closest_ancestors,
)}

_N = "(SELECT CAST(n_nationkey AS VARCHAR) AS k, CAST(n_regionkey AS VARCHAR) AS r FROM nation)"
_MEDIA = "'(min-width:' || k || 'px) and print|:hover|'"

SQL = {
    "linked_stylesheets": "SELECT s_suppkey, pos, path FROM supplier JOIN (VALUES (0, CAST(0 AS BIGINT), '/site/css/a.css'), (2, 0, '/site/css/b.css'), (2, 1, '/site/css/a.css')) l(m, pos, path) ON s_suppkey % 4 = m",
    "linked_sheet_sets": "SELECT css, count(*) AS pages FROM supplier JOIN (VALUES (0, '.a{color:red}'), (2, '.a{color:red}' || chr(10) || '.b{top:0}'), (3, '.i{margin:0}')) l(m, css) ON s_suppkey % 4 = m GROUP BY css",
    "outputs_written": "SELECT 'd' || (s_suppkey % 5) || '/p' || s_suppkey || '.html' AS place, '<p>' || s_name || '</p>' AS text FROM supplier WHERE s_suppkey % 3 > 0",
    "inline_to_class": f"SELECT p_partkey AS doc_id, {_STYLED_OUT} AS text_after FROM part",
    "competing_declarations": """SELECT p_partkey AS key, property FROM part, (VALUES ('margin-top'), ('top'), ('left'), ('right')) x(property)
      WHERE property = 'right' OR (property = 'margin-top' AND p_size % 3 = 0) OR (property = 'top' AND p_size % 4 = 1) OR (property = 'left' AND p_size % 4 = 0)""",
    "op_counts": "SELECT phase, CASE phase WHEN 'flatten' THEN count(*) FILTER (o_orderkey % 4 > 0) ELSE 0 END AS files, CAST(CASE phase WHEN 'flatten' THEN sum(o_orderkey % 4) ELSE 0 END AS BIGINT) AS ops FROM orders, (VALUES ('flatten'), ('compress'), ('convert')) p(phase) GROUP BY phase",
    "document_fingerprints": "SELECT p_partkey AS doc_id, sha256('0:fragment,1:element,2:element,3:element,4:element' || array_to_string(list_transform(range(p_size % 5), lambda i: ',' || (5 + 2 * i) || ':element,' || (6 + 2 * i) || ':text'), '')) AS fingerprint FROM part",
    "edit_groups": "SELECT o_orderkey AS doc_id, CASE o_custkey % 2 WHEN 0 THEN '|k l' ELSE '' END AS classes, CAST(CASE o_custkey % 2 WHEN 0 THEN 1 ELSE 3 END AS BIGINT) AS applied, CASE o_custkey % 2 WHEN 0 THEN 'target not found' ELSE 'none' END AS refused FROM orders",
    "media_rules": f"SELECT 'n' || k AS token, {_MEDIA} AS cond, 'top' AS property, CASE r WHEN '0' THEN '0' ELSE r || 'px' END AS value, false AS important FROM {_N} UNION ALL SELECT 'n' || k, '||::before', 'top', '1px', false FROM {_N} UNION ALL SELECT 'n' || k, '||::before', 'bottom', '0', true FROM {_N}",
    "selector_roles": f"""SELECT t || k AS token, t IN ('n', 'b') AS subject, t = 'a' AS ancestor, t = 'c' AS sibling, t = 'b' AS structural, false AS droppable FROM {_N}, (VALUES ('n'), ('a'), ('b'), ('c')) v(t)
      UNION ALL SELECT 'd', true, false, false, false, true""",
    "complex_selectors": f"SELECT '.a' || k || '>.b' || k || ':first-child' AS selector FROM {_N} UNION ALL SELECT '.c' || k || '+.d' FROM {_N}",
    "coupled_elements": "SELECT c_custkey AS key FROM customer WHERE c_custkey % 4 < 3",
    "emitted_css": f"SELECT 'n' || k AS token, {_MEDIA} AS cond, 'top:' || CASE r WHEN '0' THEN '0' ELSE r || 'px' END AS block FROM {_N} UNION ALL SELECT 'n' || k, '||::before', 'bottom:0!important;top:1px' FROM {_N}",
    "style_names": """SELECT p_partkey, name, CASE WHEN n = 0 OR name = 'z-index' THEN CAST(n AS VARCHAR) ELSE n || 'px' END AS value, '||~' || name || '~' || n || '~' || CASE n WHEN 1 THEN '!' ELSE '' END AS tuple, length(p_type) AS length
      FROM (SELECT *, p_size % 3 AS n, ['margin-top', '-webkit-line-clamp', '--x', 'z-index'][p_size % 4 + 1] AS name FROM part)""",
    "flatten_patterns": f"SELECT p_partkey AS doc_id, {_SHAPE_OUT} AS text_after, CAST([{', '.join(str(r) for _, _, r in _SHAPES)}][p_size % {len(_SHAPES)} + 1] AS BIGINT) AS refused FROM part",
    "declared_patterns": f"SELECT p_partkey AS doc_id, ['contents', 'coloured', 'plain-span'][p_size % {len(_SHAPES)}] AS pattern, ['unwrap', 'classes', 'unwrap'][p_size % {len(_SHAPES)}] AS op FROM part WHERE p_size % {len(_SHAPES)} BETWEEN 1 AND 3",
    "greedy_cover": "SELECT p_partkey AS doc_id, '<p class=\"' || CASE p_size % 2 WHEN 0 THEN 'big' ELSE 'v0 v1' END || '\">x</p>' AS text_after FROM part",
    "stream_run_totals": Q.SQL["run_totals"],
    "utility_compress": "SELECT p_partkey AS doc_id, '<div class=\"' || [" + ", ".join(f"'{b or a}'" for a, b in _UTILITY_LISTS) + f"][p_size % {len(_UTILITY_LISTS)} + 1] || '\">x</div>' AS text_after FROM part",
    "utility_resolve": """WITH p AS (SELECT p_partkey AS key, p_size % 4 AS a, p_size % 5 AS b, p_size AS s FROM part)
      SELECT key, '||' AS cond, 'padding-' || side AS property, CASE WHEN n = 0 THEN '0' ELSE rtrim(rtrim(printf('%.2f', n / 4), '0'), '.') || 'rem' END AS value, false AS important
      FROM (SELECT key, side, CASE WHEN side IN ('left', 'right') THEN b ELSE a END AS n FROM p, (VALUES ('top'), ('right'), ('bottom'), ('left')) v(side))
      UNION ALL SELECT key, '(min-width: 768px)||', 'margin-top', s || 'px', false FROM p""",
    "templates_optimized": f"SELECT p_partkey AS doc_id, replace([{', '.join(_literal(b or a) for _, a, b in _TEMPLATES)}][p_size % {len(_TEMPLATES)} + 1], '{{}}', p_name) AS text_after, p_size % {len(_TEMPLATES)} = {len(_TEMPLATES) - 1} AS failed FROM part",
    "nested_rules": f"""SELECT k AS set_id, 'n' || k AS name, cond, property, CASE property WHEN 'top' THEN CASE r WHEN '0' THEN '0' ELSE r || 'px' END WHEN 'margin-left' THEN '2px' ELSE '0' END AS value
      FROM {_N}, (VALUES ('||', 'top'), ('||', 'margin-left'), ('|:hover|', 'left'), ('print||', 'right')) v(cond, property)
      UNION ALL SELECT k, '.n' || k || ' .k', '', '', '' FROM {_N} UNION ALL SELECT k, '.n' || k || ' .x' || k, '', '', '' FROM {_N}""",
    "closest_ancestors": "SELECT o_orderkey AS doc_id, o_orderkey % 4 + 2 AS around, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 + 3 END AS div FROM orders",
}
