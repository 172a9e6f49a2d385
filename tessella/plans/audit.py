"""Plans over whole corpora: optimise every document, count, total, score."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import byte_count, class_token_count
from tessella.operators.optimize import Options, optimize_fragment, optimized
from tessella.sources.partitions import dealt
from tessella.sources.stylesheet import Sheet, parse
from tessella.sources.utilities import Utilities

WORST = 5
_SHEETS: dict[str, Sheet] = {}
_UTILITIES = Utilities()


def _sheet(css: str) -> Sheet:
    """Parsed once in each worker for each distinct text, a few hundred held."""
    if css not in _SHEETS:
        if len(_SHEETS) > 500:
            _SHEETS.clear()
        _SHEETS[css] = parse(css)
    return _SHEETS[css]


_OPS = ("flatten", "compress", "convert", "sweeps", "refused")
_RESULT = "struct<text:string,nodes:long,removed:long,error:string," + ",".join(f"{k}:long" for k in _OPS) + ">"


def _runner(options: Options):
    def one(text: str, css: str, kind: str) -> tuple:
        new, nodes, removed, ops = optimized(text, _UTILITIES if options.provider == "utility" else _sheet(css), options, kind)
        return new, nodes, removed, None, *(ops[k] for k in _OPS)

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, css, kind in batches:
            rows = []
            for t, c, k in zip(text, css, kind):
                try:
                    rows.append((None, 0, 0, None, *[0] * len(_OPS)) if t is None else one(t, c or "", k))
                except Exception as e:  # one broken document must not fail the run
                    rows.append((t, 0, 0, f"{type(e).__name__}: {e}"[:200], *[0] * len(_OPS)))
            yield pd.DataFrame(rows, columns=["text", "nodes", "removed", "error", *_OPS])

    return run


def _fragment(text: str) -> str:
    try:
        return optimize_fragment(text)
    except Exception:  # as above: left as it is
        return text


def _fragments(text: pd.Series) -> pd.Series:
    return text.map(_fragment, na_action="ignore")


def fragment(text: Column) -> Column:
    """The fragment without its inert wrappers."""
    return F.pandas_udf(_fragments, "string")(text)


def optimize_fragments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_after) of fragments; a map without a shuffle."""
    return dealt(docs.select(key, text)).select(key, fragment(F.col(text)).alias("text_after"))


def optimize_documents(docs: DataFrame, key: str, text: str, css: str | Column | None = None, options: Options = Options(), kind: str | Column = "html") -> DataFrame:
    """(key, text_before, text_after, nodes_before, nodes_removed, error, and op counts); a map without a shuffle (but that of an input
    too small to keep all cores busy).

    ``kind``: html, jsx, tsx, vue or astro; of a text that cannot be read as that the error is noted, and it stays.
    """
    sheet = F.lit("") if css is None else F.col(css) if isinstance(css, str) else css
    run = F.pandas_udf(_runner(options), _RESULT)
    rows = dealt(docs.select(key, F.col(text).alias("text_before"), sheet.alias("css"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind")))
    got = rows.select(key, "text_before", run("text_before", "css", "kind").alias("r"))
    return got.select(key, "text_before", F.col("r.text").alias("text_after"), F.col("r.nodes").alias("nodes_before"), F.col("r.removed").alias("nodes_removed"), F.col("r.error").alias("error"), *(F.col(f"r.{k}").alias(f"n_{k}") for k in _OPS))


def op_totals(outputs: DataFrame) -> DataFrame:
    """Over all documents, what each phase did and in how many."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("phase"), F.col(f"n_{k}").alias("n")) for k in _OPS[:3])))
    return outputs.select(rows.alias("x")).groupBy("x.phase").agg(F.count_if(F.col("x.n") > 0).alias("files"), _sum(F.col("x.n")).alias("ops"))


def file_stats(outputs: DataFrame, key: str) -> DataFrame:
    """Counts of each document: nodes and classes saved not below zero, bytes as they are."""
    before, after = F.col("text_before"), F.col("text_after")
    return outputs.select(
        key, (before != after).alias("changed"), "nodes_before", F.greatest(F.col("nodes_removed"), F.lit(0)).alias("nodes_removed"),
        class_token_count(before).alias("classes_before"), F.greatest(class_token_count(before) - class_token_count(after), F.lit(0)).cast("long").alias("classes_saved"),
        byte_count(before).alias("bytes_before"), (byte_count(before) - byte_count(after)).alias("bytes_saved"),
    )


def _improvable() -> Column:
    return (F.col("bytes_saved") > 0) | (F.col("nodes_removed") > 0) | (F.col("classes_saved") > 0)


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def audit_totals(stats: DataFrame) -> DataFrame:
    ok = _improvable()
    one = stats.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(ok).alias("files_improvable"), _sum(F.col("nodes_before")).alias("nodes_total"), _sum(F.col("bytes_before")).alias("bytes_total"),
        _sum(F.when(ok, F.col("nodes_removed"))).alias("nodes_removable"), _sum(F.when(ok, F.col("classes_saved"))).alias("classes_compressible"), _sum(F.when(ok, F.greatest(F.col("bytes_saved"), F.lit(0)))).alias("bytes_savable"),
    )
    return one.withColumn("score", score(F.col("bytes_savable"), F.col("bytes_total"), F.col("nodes_removable"), F.col("nodes_total")))


def score(bytes_savable: Column, bytes_total: Column, nodes_removable: Column, nodes_total: Column) -> Column:
    share = lambda a, b: F.least(F.lit(1.0), a / F.greatest(b, F.lit(1)))
    raw = F.round(100 * (1 - share(bytes_savable, bytes_total)) * (1 - share(nodes_removable, nodes_total)))
    return F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("long")


def worst(stats: DataFrame, key: str, n: int = WORST) -> DataFrame:
    """The documents with the most savable bytes, ties by identifier: a top-k without a full sort."""
    savable = F.greatest(F.col("bytes_saved"), F.lit(0))
    return stats.where(_improvable()).select(F.col(key).cast("string").alias("id"), savable.alias("bytes_savable"), "nodes_removed", "classes_saved").orderBy(F.desc("bytes_savable"), F.collate("id", "UNICODE")).limit(n)


def run_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("files"), F.count_if("changed").alias("changed"), _sum(F.col("nodes_removed")).alias("nodes_removed"), _sum(F.col("classes_saved")).alias("classes_saved"), _sum(F.col("bytes_saved")).alias("bytes_saved"))


def build_totals(stats: DataFrame) -> DataFrame:
    return run_totals(stats.where("changed"))
