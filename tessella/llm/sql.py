"""DuckDB SQL for the operators that SQL can express, written from their contracts alone."""

from __future__ import annotations

import json

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_SEED, _M = 42, 1 << 64
_MOD = f"{_M}::UHUGEINT"


def _n(x: int) -> str:
    return f"{x % _M}::UHUGEINT"


def _mul(a: str, b: int) -> str:
    return f"((({a}) * {_n(b)}) % {_MOD})"


def _add(*terms: str) -> str:
    return f"(({' + '.join(terms)}) % {_MOD})"


def _rot(x: str, r: int) -> str:
    return f"((({x}) * {_n(1 << r)}) % {_MOD} + ({x}) // {_n(1 << (64 - r))})"


def _lane(at: str, size: int) -> str:
    """The little-endian number in ``size`` bytes of the hexadecimal digits ``d`` from byte ``at``."""
    return "CAST(CAST('0x' || " + " || ".join(f"substr(d, 2 * ({at}) + {2 * k + 1}, 2)" for k in range(size - 1, -1, -1)) + " AS UBIGINT) AS UHUGEINT)"


def _round(acc: str, lane: str) -> str:
    return _mul(_rot(_add(acc, _mul(lane, _P2)), 31), _P1)


def _stripes(first: str, k: int) -> str:
    return f"list_reduce(list_prepend({first}, list_transform(range(n // 32), lambda i: {_lane(f'32 * i + {8 * k}', 8)})), lambda acc, x: {_round('acc', 'x')})"


_V = [f"CASE WHEN n >= 32 THEN {_stripes(_n(first), k)} END AS v{k}" for k, first in enumerate((_SEED + _P1 + _P2, _SEED + _P2, _SEED, _SEED - _P1))]
_MERGED = "h0"
for _k in range(4):
    _MERGED = _add(_mul(f"xor({_MERGED}, {_round(_n(0), f'v{_k}')})", _P1), _n(_P4))
_EIGHTS = f"list_reduce(list_prepend({_add('h1', 'CAST(n AS UHUGEINT)')}, list_transform(range((n % 32) // 8), lambda i: {_lane('n - n % 32 + 8 * i', 8)})), lambda acc, x: {_add(_mul(_rot(f'xor(acc, {_round(_n(0), "x")})', 27), _P1), _n(_P4))})"
_FOUR = f"CASE WHEN n % 8 >= 4 THEN {_add(_mul(_rot(f'xor(h2, {_mul(_lane("n - n % 8", 4), _P1)})', 23), _P2), _n(_P3))} ELSE h2 END"
_ONES = f"list_reduce(list_prepend(h3, list_transform(range(n % 4), lambda i: {_lane('n - n % 4 + i', 1)})), lambda acc, x: {_mul(_rot(f'xor(acc, {_mul("x", _P5)})', 11), _P1)})"

#: Lower-case A-Z alone, words between ASCII white space.
_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SIMHASH = f"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
shingles AS (SELECT r, unnest(CASE WHEN len(w) <= 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words WHERE len(w) > 0),
every AS (SELECT s, count(*) AS c, r FROM shingles GROUP BY r, s),
x0 AS (SELECT s, hex(encode(s)) AS d, CAST(octet_length(encode(s)) AS BIGINT) AS n FROM (SELECT DISTINCT s FROM every)),
x1 AS (SELECT *, {', '.join(_V)} FROM x0),
x2 AS (SELECT *, {_add(*(_rot(f'v{k}', r) for k, r in enumerate((1, 7, 12, 18))))} AS h0 FROM x1),
x3 AS (SELECT s, d, n, CASE WHEN n >= 32 THEN {_MERGED} ELSE {_n(_SEED + _P5)} END AS h1 FROM x2),
x4 AS (SELECT s, d, n, {_EIGHTS} AS h2 FROM x3),
x5 AS (SELECT s, d, n, {_FOUR} AS h3 FROM x4),
x6 AS (SELECT s, {_ONES} AS h4 FROM x5),
x7 AS (SELECT s, {_mul(f'xor(h4, h4 // {_n(1 << 33)})', _P2)} AS h5 FROM x6),
x8 AS (SELECT s, {_mul(f'xor(h5, h5 // {_n(1 << 29)})', _P3)} AS h6 FROM x7),
hashes AS (SELECT s, CAST(xor(h6, h6 // {_n(1 << 32)}) AS UBIGINT) AS h FROM x8),
bits AS (SELECT r, CAST({' + '.join(f'CASE WHEN 2 * sum(c * CAST(h // {1 << b}::UBIGINT % 2 AS BIGINT)) > sum(c) THEN {_n(1 << b)} ELSE 0::UHUGEINT END' for b in range(64))} AS UBIGINT) AS fp FROM every JOIN hashes USING (s) GROUP BY r),
rows AS (SELECT r, doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM words LEFT JOIN bits USING (r)),
fps AS (SELECT fp, min(doc_id) AS least FROM rows GROUP BY fp),
links AS (SELECT a.fp AS a, b.fp AS b FROM fps a JOIN fps b ON bit_count(CAST(xor(a.fp, b.fp) AS BIT)) <= 4),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
groups AS (SELECT reach.a AS fp, min(least) AS component_id FROM reach JOIN fps ON reach.b = fps.fp GROUP BY reach.a)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM rows JOIN groups USING (fp)"""

NEAREST = """
WITH v AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(c.e, q.e) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(q.e, q.e)))) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e) GROUP BY q.vec_id, c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5"""


def _spans(kind: int, pattern: str, keep: str) -> str:
    """(r, s, k, e, m) of a pattern's matches ``m`` in ``texts``, from the lengths of matches and of gaps between them."""
    return f"""SELECT r, pos AS s, {kind} AS k, pos + length(m) AS e, m FROM (SELECT r, m, g, list_sum(list_transform(gaps[1:g], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:g - 1], lambda x: length(x))), 0) AS pos
  FROM (SELECT r, found, gaps, unnest(found) AS m, unnest(range(1, len(found) + 1)) AS g FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS gaps FROM texts WHERE regexp_matches(t, '{pattern}')))) WHERE {keep}"""


_STATE = ("i", "glue", "wait", "total", "peak", "start", "lft", "fin", "tail", "done")


def _struct(**fields: str) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


def secrets_sql() -> str:
    """The base spans by their patterns; of longer runs those that the ratios of character pairs call random, or
    the stretches of them that do: a pass over the pairs in which a stretch ends where its sum falls."""
    from tessella.llm import secrets as S

    quote = lambda p: p.replace("'", "''")
    value = r"[A-Za-z0-9+/_.=-]+"
    assign = quote(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""") + value
    group = quote(r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(""") + value + ")$"
    ratios = json.dumps(S.fit(S.samples()))
    glue = ", ".join(f"'{c}'" for c in S.GLUE)
    over = f"(a.total + p.x <= 0 OR a.total + p.x < a.peak - {S.DROP})"
    here = "(a.i + 1)"
    tail = f"(CASE WHEN a.tail < 0 AND p.g AND {here} >= a.fin THEN {here} ELSE a.tail END)"
    more = f"(NOT {over} AND a.total + p.x > a.peak)"
    close = f"({over} AND a.fin - a.start >= {S.CORE})"
    met = "(p.g AND a.wait >= 0)"
    first = f"(CASE WHEN {met} THEN a.wait WHEN {close} AND {tail} >= 0 THEN a.lft END)"
    last = f"(CASE WHEN {met} THEN {here} ELSE {tail} END)"
    out = f"({first} IS NOT NULL AND {last} - {first} >= {S.STRETCH} AND {last} > a.done)"
    step = _struct(
        i=here, glue=f"CASE WHEN p.g THEN {here} + 1 ELSE a.glue END", wait=f"CASE WHEN {close} AND a.wait < 0 AND {tail} < 0 THEN a.lft WHEN p.g THEN -1 ELSE a.wait END",
        total=f"CASE WHEN {over} THEN 0.0::DOUBLE ELSE a.total + p.x END", peak=f"CASE WHEN {over} THEN 0.0::DOUBLE WHEN {more} THEN a.total + p.x ELSE a.peak END", start=f"CASE WHEN {over} THEN {here} ELSE a.start END",
        lft=f"CASE WHEN {over} THEN a.glue ELSE a.lft END", fin=f"CASE WHEN {over} THEN {here} WHEN {more} THEN {here} + 1 ELSE a.fin END",
        tail=f"CASE WHEN {over} THEN CASE WHEN p.g THEN {here} ELSE -1 END WHEN {more} THEN -1 ELSE {tail} END", done=f"CASE WHEN {out} THEN {last} ELSE a.done END",
        found=f"CASE WHEN {out} THEN list_append(a.found, {_struct(a=first, b=last)}) ELSE a.found END", x="0.0::DOUBLE", g="false",
    )
    none = _struct(a="0::BIGINT", b="0::BIGINT")
    zero = lambda **more: _struct(**({n: "0::BIGINT" for n in _STATE} | {"total": "0.0::DOUBLE", "peak": "0.0::DOUBLE", "found": f"list_filter([{none}], lambda z: false)", "x": "0.0::DOUBLE", "g": "false"} | more))
    opening = f"(m[1] IN ({glue}))"
    pair = zero(x=f"w[unicode(m[j]) * 128 + unicode(m[j + 1]) + 1] - {S.MARGIN}", g=f"m[j + 1] IN ({glue})")
    start = zero(glue=f"CAST({opening} AS BIGINT)", wait="-1::BIGINT", tail=f"CASE WHEN {opening} THEN 0::BIGINT ELSE -1::BIGINT END")
    final = f"CASE WHEN z.wait >= 0 THEN {_struct(a='z.wait', b='length(m)')} WHEN z.fin - z.start >= {S.CORE} THEN {_struct(a='z.lft', b='CASE WHEN z.tail >= 0 THEN z.tail ELSE length(m) END')} END"
    return f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED (SELECT r, s, k, e FROM ({_spans(0, assign, f"length(regexp_extract(m, '{group}', 1)) >= {S.ASSIGN_LEAST}")}) UNION ALL SELECT r, s, k, e FROM ({_spans(1, 'AKIA[A-Z0-9]+', 'length(m) >= 16')}) UNION ALL SELECT r, s, k, e FROM ({_spans(2, '[0-9a-f]+', 'length(m) >= 32')})),
ratios AS MATERIALIZED (SELECT CAST({ratios} AS DOUBLE[]) AS w),
runs AS MATERIALIZED ({_spans(3, S.CANDIDATE, 'true')}),
judged AS MATERIALIZED (SELECT r, s, e, m, list_sum(list_transform(range(1, length(m)), lambda j: w[unicode(m[j]) * 128 + unicode(m[j + 1]) + 1])) > {S.MARGIN} * (length(m) - 1) AS random FROM runs, ratios),
passed AS MATERIALIZED (SELECT r, s, m, list_reduce(list_prepend({start}, list_transform(range(1, length(m)), lambda j: {pair})), lambda a, p: {step}) AS z FROM judged, ratios WHERE NOT random),
stretches AS (SELECT r, s, unnest(list_append(z.found, CASE WHEN c.b - c.a >= {S.STRETCH} AND c.b > z.done THEN c END)) AS x FROM (SELECT *, {final} AS c FROM passed)),
more AS (SELECT r, s, 3 AS k, e FROM judged WHERE random UNION ALL SELECT r, s + x.a, 3, s + x.b FROM stretches WHERE x IS NOT NULL),
fresh AS (SELECT * FROM more WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = more.r AND base.s <= more.s AND more.e <= base.e)),
names AS (SELECT r, s, k, e, {json.dumps(list(S.KINDS)).replace('"', "'")}[k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS name FROM (SELECT * FROM base UNION ALL SELECT * FROM fresh)),
joined AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS h, coalesce(string_agg(name, ',' ORDER BY s, k, e) FILTER (k < 3), '') AS base, string_agg(name, ',' ORDER BY s, k, e) AS spans FROM names GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN joined USING (r)"""
