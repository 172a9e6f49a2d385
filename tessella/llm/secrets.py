"""Secret scans with column expressions only: patterns, and a character Markov log-likelihood ratio."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, table

# The patterns of the kinds, as Java regular expressions.  Where a match that is too
# short would hide no other, its least length stands in the pattern.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Candidates of the Markov models: runs long enough to tell.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Nats by which a string must be likelier as random, for each of its character pairs.
MARGIN = 0.5
#: A stretch of a candidate ends where its sum of ratios over MARGIN has fallen by so many nats.
DROP = 8.0
#: Least characters of a stretch, as found and once widened to the next GLUE (then as of a candidate).
CORE, STRETCH = 14, 20
#: What joins the parts of paths and names.
GLUE = "/=_-"
KINDS = ("assign", "access", "hex", "random")


# ---- models, fitted on labelled samples -----------------------------------------------------

# Parts of which ordinary identifiers and words are made.
PARTS = """get set is has make load save read write open close start stop init update delete create find list count
index value name type size data file path user group order item node tree edge graph table column row key map
array string number buffer stream reader writer parser lexer token state event handler manager service client
server request response session cookie header body page view model controller factory builder helper util config
option default error message result status code time date start end first last next previous min max total sum
the and of to in for with that this from which would there their about other into more some could these than
ing tion ment able ness ance ence ious ture ship ough ight ates ered ling ting ring ding ning
eine der die und das nicht keit heit ung lich schaft ver ent les des une que dans pour est pas avec eau aux eux
cion mente ado ada los las una para como este esta""".split()  # fmt: skip


def samples(n: int = 3000) -> list[tuple[str, int]]:
    """Labelled strings: 1 for random ones (hexadecimal, base 36 and base 64), 0 for identifiers and words."""
    out = []
    for i in range(n):
        d = hashlib.sha256(f"tessella {i}".encode()).digest()
        number = int.from_bytes(d, "big")
        digits = ("0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz", ALPHABET[:64], ALPHABET[:62], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")[i % 5]
        chars = []
        for _ in range(40):
            number, r = divmod(number, len(digits))
            chars.append(digits[r])
        out.append(("".join(chars), 1))
        words = [PARTS[b % len(PARTS)] for b in d[:6]]
        joined = ("_".join(words), words[0] + "".join(w.title() for w in words[1:]), "".join(words), "-".join(words), "_".join(words).upper(), "/".join(words), "".join(words).title() + str(d[7] % 100))[i % 7]
        out.append((joined, 0))
    return out


def fit(labelled: list[tuple[str, int]], floor: float = 0.2) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) at place ord(a) * 128 + ord(b)."""
    n = [[[floor] * 128 for _ in range(128)] for _ in range(2)]
    for s, label in labelled:
        for a, b in itertools.pairwise(s):
            n[label][ord(a)][ord(b)] += 1
    out = [0.0] * (128 * 128)
    for a in ALPHABET:
        sums = [sum(m[ord(a)][ord(x)] for x in ALPHABET) for m in n]
        for b in ALPHABET:
            out[ord(a) * 128 + ord(b)] = round(math.log(n[1][ord(a)][ord(b)] / sums[1]) - math.log(n[0][ord(a)][ord(b)] / sums[0]), 6)
    return out


def ratio(s: str, table_: list[float]) -> float:
    """Mean log-likelihood ratio of a string's character pairs (for tests and tuning)."""
    return sum(table_[ord(a) * 128 + ord(b)] for a, b in itertools.pairwise(s)) / max(len(s) - 1, 1)


def stretches(s: str, table_: list[float]) -> list[tuple[int, int]]:
    """Start and end of the parts of a string that are likelier as random, widened to the next GLUE (for tests and tuning)."""
    out, total, start, peak, at = [], 0.0, 0, 0.0, 0

    def close():
        if at - start >= CORE:
            a = start - len(re.search(f"[^{GLUE}]*$", s[:start])[0])
            b = at + len(re.match(f"[^{GLUE}]*", s[at:])[0])
            if b - a >= STRETCH and not (out and b <= out[-1][1]):  # not one that lies in the last
                out.append((a, b))

    for i, (a, b) in enumerate(itertools.pairwise(s)):
        x = table_[ord(a) * 128 + ord(b)] - MARGIN
        if total + x <= 0 or total + x < peak - DROP:
            close()
            total, start, peak, at = 0.0, i + 1, 0.0, i + 1
            continue
        total += x
        if total > peak:
            peak, at = total, i + 2
    close()
    return out


# ---- the scan -------------------------------------------------------------------------------

_OPEN, _MID, _SHUT, _ELSE = "\x01", "\x02", "\x03", "\x04"
_SPAN, _PIECE = "struct<s:int,k:int,e:int>", "struct<s:int,k:int,e:int,piece:string>"
#: Items that a fold takes between two copies of what it has gathered; characters in a block of a text.
_CHUNK, _BLOCK = 64, 4096


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _state(**fields) -> Column:
    return F.struct(*((F.lit(v) if not isinstance(v, Column) else v).alias(k) for k, v in fields.items()))


def _let(value: Column, of) -> Column:
    """``of(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _fold(items: Column, kind: str, first: dict, step, last=None) -> Column:
    """What ``step`` gives over ``items``, one after another, and ``last(state)`` in the end.

    ``step(state, item)`` is a struct of the new state and, as ``out``, an array of what it gives.
    What is gathered is copied once a chunk, not once an item, so that many items don't cost their square.
    """
    names = list(first)

    def inner(acc, x):
        return _let(step(acc, x), lambda r: _state(**{n: r[n] for n in names}, got=F.when(F.size(r["out"]) > 0, F.concat(acc["got"], r["out"])).otherwise(acc["got"])))

    def of(xs):
        def outer(acc, c):
            done = F.aggregate(F.slice(xs, c * _CHUNK + 1, F.lit(_CHUNK)), _state(**{n: acc[n] for n in names}, got=_none(kind)), inner)
            return _let(done, lambda d: _state(**{n: d[n] for n in names}, all=F.array_append(acc["all"], d["got"])))

        chunks = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _CHUNK).cast("int"))).otherwise(_none("int"))
        zero = _state(**first, all=_none(f"array<{kind}>"))
        return F.aggregate(chunks, zero, outer, lambda acc: F.flatten(acc["all"]) if last is None else F.concat(F.flatten(acc["all"]), last(acc)))

    return _let(items, of)


def _spans(text: Column, pattern: str, kind: int, mid: bool = False, ok=None, within=None) -> Column:
    """array<struct<s, k, e>> of the pattern's leftmost non-overlapping matches in code points.

    The matches are set between marks, the text is split at the opening one, and running lengths
    of the parts give the places.  Marks that the text itself holds become another character first.
    Of a match that is not ``ok`` its parts ``within`` are taken.
    """
    put = f"{_OPEN}$1{_MID}$2{_SHUT}" if mid else f"{_OPEN}$0{_SHUT}"
    parts = F.split(F.regexp_replace(F.translate(text, _OPEN + _MID + _SHUT, _ELSE * 3), pattern, put), _OPEN)
    marks = 2 if mid else 1

    def of(parts: Column) -> Column:
        def step(acc, part):
            inner = F.substring_index(part, _SHUT, 1)
            span = F.array(_state(s=acc["at"], k=kind, e=acc["at"] + F.length(inner) - (1 if mid else 0)))
            rest = _none(_SPAN) if within is None else F.transform(within(inner), lambda w: _state(s=acc["at"] + w["a"], k=kind, e=acc["at"] + w["b"]))
            return _state(at=acc["at"] + F.length(part) - marks, out=span if ok is None else F.when(ok(inner), span).otherwise(rest))

        return _fold(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), _SPAN, {"at": F.length(F.element_at(parts, 1))}, step)

    return _let(parts, of)


def _long_enough(inner: Column) -> Column:
    return F.length(inner) - F.instr(inner, _MID) >= ASSIGN_LEAST


def _codes(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), F.ascii)


def _ratios(codes: Column, table_: Column) -> Column:
    """Of each pair of neighbours its log-likelihood ratio."""
    n = F.size(codes) - 1
    return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.element_at(table_, a * 128 + b + 1))


def _random(table_: Column):
    def ok(s: Column) -> Column:
        return _let(_codes(s), lambda c: F.aggregate(_ratios(c, table_), F.lit(0.0), lambda acc, x: acc + x) > MARGIN * (F.size(c) - 1))

    return ok


def _stretches(table_: Column):
    """The same as stretches(), of a column, in one pass.

    ``left`` is where the open stretch would start once widened, ``tail`` the first glue at or after its
    end ``at`` (-1: not met yet), ``glue`` the place after the last glue, ``done`` the end of the last one
    given.  A stretch that closes before its tail is met waits in ``wait`` (its start); those that close
    while one waits lie in it once widened.
    """
    glue_codes = [ord(c) for c in GLUE]

    none = _none("struct<a:int,b:int>")

    def of_codes(codes: Column) -> Column:
        n = F.size(codes)
        pairs = F.zip_with(_ratios(codes, table_), F.slice(codes, F.lit(2), n - 1), lambda x, c: _state(x=x - MARGIN, g=c.isin(glue_codes)))

        def step(acc, p):
            here = acc["i"] + 1  # place of the pair's second character
            tail = F.when((acc["tail"] < 0) & p["g"] & (here >= acc["at"]), here).otherwise(acc["tail"])
            total = acc["total"] + p["x"]
            return _let(_state(here=here, tail=tail, total=total, over=(total <= 0) | (total < acc["peak"] - DROP)), lambda v: moved(acc, p, v))

        def moved(acc, p, v):
            more = ~v["over"] & (v["total"] > acc["peak"])
            close = v["over"] & (acc["at"] - acc["start"] >= CORE)
            met = p["g"] & (acc["wait"] >= 0)
            a = F.when(met, acc["wait"]).when(close & (v["tail"] >= 0), acc["left"])
            b = F.when(met, v["here"]).otherwise(v["tail"])
            out = _let(_state(a=a, b=b), lambda w: F.when(w["a"].isNotNull() & (w["b"] - w["a"] >= STRETCH) & (w["b"] > acc["done"]), F.array(w)).otherwise(none))
            return _let(out, lambda out: _state(
                i=v["here"],
                glue=F.when(p["g"], v["here"] + 1).otherwise(acc["glue"]),
                wait=F.when(close & (acc["wait"] < 0) & (v["tail"] < 0), acc["left"]).when(p["g"], F.lit(-1)).otherwise(acc["wait"]),
                total=F.when(v["over"], F.lit(0.0)).otherwise(v["total"]),
                peak=F.when(v["over"], F.lit(0.0)).when(more, v["total"]).otherwise(acc["peak"]),
                start=F.when(v["over"], v["here"]).otherwise(acc["start"]),
                left=F.when(v["over"], acc["glue"]).otherwise(acc["left"]),
                at=F.when(v["over"], v["here"]).when(more, v["here"] + 1).otherwise(acc["at"]),
                tail=F.when(v["over"], F.when(p["g"], v["here"]).otherwise(F.lit(-1))).when(more, F.lit(-1)).otherwise(v["tail"]),
                done=F.when(F.size(out) > 0, F.element_at(out, 1)["b"]).otherwise(acc["done"]),
                out=out,
            ))

        def last(acc):
            end = F.when(acc["tail"] >= 0, acc["tail"]).otherwise(n)
            own = F.when(acc["at"] - acc["start"] >= CORE, _state(a=acc["left"], b=end))
            waiting = F.when(acc["wait"] >= 0, _state(a=acc["wait"], b=n))
            return F.filter(F.array(F.coalesce(waiting, own)), lambda w: w.isNotNull() & (w["b"] - w["a"] >= STRETCH) & (w["b"] > acc["done"]))

        opening = F.element_at(codes, 1).isin(glue_codes)
        first = {"i": 0, "glue": opening.cast("int"), "wait": -1, "total": 0.0, "peak": 0.0, "start": 0, "left": 0, "at": 0, "tail": F.when(opening, 0).otherwise(-1), "done": 0}
        return _fold(pairs, "struct<a:int,b:int>", first, step, last)

    return lambda s: _let(_codes(s), of_codes)


def _fresh(base: Column, more: Column) -> Column:
    """All spans in order; of ``more`` those that lie in no span of ``base``."""

    def step(acc, x):
        own = x["k"] < len(KINDS) - 1
        return _state(upto=F.when(own, F.greatest(acc["upto"], x["e"])).otherwise(acc["upto"]), out=F.when(own | (x["e"] > acc["upto"]), F.array(x)).otherwise(_none(_SPAN)))

    return _let(F.array_sort(F.concat(base, more)), lambda spans: _fold(spans, _SPAN, {"upto": -1}, step))


def scan(rows: DataFrame, labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """``rows`` (text and any others but base and spans) with ``base`` and ``spans``: array<struct<s, k, e>> of
    the base kinds and of all kinds, by start, then kind as in KINDS.

    A null or empty text has none.  Spans of different kinds may overlap; a run that lies in a
    span of a base kind is not reported as random again.  Of a run that is not random as a whole,
    its random stretches are reported.  The models are fitted on ``labelled`` strings (1: random).
    """
    ratios = F.from_json(F.lit(json.dumps(fit(labelled or samples()))), "array<double>")
    t = F.coalesce(F.col("text"), F.lit(""))

    def of(pattern, kind, **more):
        return F.when(t.rlike(pattern), _spans(t, pattern, kind, **more)).otherwise(_none(_SPAN))

    base = rows.withColumn("base", F.array_sort(F.concat(of(ASSIGN, 0, mid=True, ok=_long_enough), of(ACCESS, 1), of(HEX, 2))))
    return base.withColumn("spans", _fresh(F.col("base"), of(CANDIDATE, 3, ok=_random(ratios), within=_stretches(ratios))))


def _joined(spans) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_spans(docs: DataFrame, labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """doc_id, counts by base kind, digest of the base spans and all spans, for each row.

    Null and empty texts have no spans, repeated rows one result each, an empty table none; other
    columns, whatever their names, are not looked at.
    """
    got = scan(documents(docs), labelled)
    of = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")
    n = [of(k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return got.select("doc_id", *n, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def _without(text: Column, spans: Column) -> Column:
    """The text with [SECRET] for each span, for overlapping ones once.

    Blocks of the text and spans are taken in one order, so that each gap is cut from one block.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), 0)
    blocks = F.transform(F.concat(pieces, F.array(F.lit(""))), lambda x, i: _state(s=i * _BLOCK, k=-1, e=i * _BLOCK + F.length(x), piece=x))
    marks = F.transform(spans, lambda x: _state(s=x["s"], k=x["k"], e=x["e"], piece=F.lit("")))

    def step(acc, x):
        block = x["k"] < 0
        open_ = F.greatest(acc["at"], acc["from"])
        upto = F.when(block, acc["from"] + F.length(acc["cur"])).otherwise(x["s"])
        gap = F.when(upto > open_, F.array(F.substring(acc["cur"], open_ - acc["from"] + 1, upto - open_))).otherwise(_none("string"))
        mark = F.when(~block & (x["s"] >= acc["at"]), F.array(F.lit("[SECRET]"))).otherwise(_none("string"))
        new = {"cur": F.when(block, x["piece"]).otherwise(acc["cur"]), "from": F.when(block, x["s"]).otherwise(acc["from"]), "at": F.when(block, acc["at"]).otherwise(F.greatest(acc["at"], x["e"]))}
        return _state(**new, out=F.concat(gap, mark))

    # the block that ends the list has no text and comes after all others and every span
    items = F.array_sort(F.concat(blocks, marks), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).when(a["k"] != b["k"], a["k"] - b["k"]).otherwise(a["e"] - b["e"]))
    return _let(items, lambda xs: F.array_join(_fold(xs, "string", {"cur": "", "from": 0, "at": 0}, step), ""))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: every span is replaced by [SECRET]; overlapping ones by one; null texts stay null.

    Columns keep their names, values and order, but for text and, where it is a column, n_chars.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    got = scan(docs.select(whole, F.col("text").cast("string").alias("text")))
    got = got.select("row", (F.size("spans") > 0).alias("found"), F.when(F.size("spans") > 0, _without(F.col("text"), F.col("spans"))).otherwise(F.col("text")).alias("text"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("found"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return got.select(row.alias("row")).select("row.*")
