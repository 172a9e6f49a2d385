"""Markup files in folders, and the places of their outputs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is read, and folders that are never looked into or may be written over.
MARKUP = ("jsx", "tsx", "html", "htm")
SKIPPED = ("node_modules", ".git")
DISPOSABLE = ("dist", "build", "out", ".next")
OUTPUT = "tessella-out"
SHEET_DEPTH, SHEETS = 10, 200


def kind(path: Column) -> Column:
    """tsx, jsx or html by the extension, whatever its case, before any query; else null."""
    ext = F.lower(F.regexp_extract(F.substring_index(path, "?", 1), r"\.([^./\\]*)$", 1))
    return F.when(ext.isin("tsx", "jsx"), ext).when(ext.isin("html", "htm"), "html")


def _below(path: Column, root: str) -> Column:
    """The folders and name of a path under a root."""
    top = re.escape(root.rstrip("/") + "/")
    return F.split(F.element_at(F.split(path, top, 2), -1), "/")


def _skipped(below: Column) -> Column:
    return F.arrays_overlap(below, F.array(*map(F.lit, (*SKIPPED, OUTPUT))))


def _outermost(paths: list[str]) -> list[str]:
    """The paths that lie under no other one."""
    tops = [p.rstrip("/") or "/" for p in dict.fromkeys(paths)]
    return [p for k, p in enumerate(tops) if p not in tops[:k] and not any(p != q and p.startswith(q.rstrip("/") + "/") for q in tops)]


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, kind, text) of the markup files under folders or patterns, each once; folders to skip left out.

    Overlapping folders are read once, so texts aren't shuffled; only several patterns may need that.
    Bytes that aren't UTF-8 become replacement characters.
    """
    roots, path = _outermost(paths), F.col("path")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    fixed = [r for r in roots if not re.search(r"[*?\[\]{}]", r)]
    below = F.split(path, "/")
    for r in fixed:
        below = F.when(path.contains(r.rstrip("/") + "/"), _below(path, r)).otherwise(below)
    own = found.where(kind(path).isNotNull() & ~_skipped(below))
    if len(roots) > 1 and len(fixed) < len(roots):
        own = own.dropDuplicates(["path"])
    return own.select("path", kind(path).alias("kind"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def stylesheets(spark: SparkSession, root: str) -> DataFrame:
    """The first SHEETS stylesheet paths under a folder in order, SHEET_DEPTH folders deep at most."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.css").load(root).select("path")
    below = _below(F.col("path"), root)
    return found.where((F.size(below) - 1 <= SHEET_DEPTH) & ~_skipped(below)).orderBy("path").limit(SHEETS)


def read_stylesheets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, css) of stylesheets; one that cannot be read is an error."""
    found = spark.read.format("binaryFile").load(paths)
    return found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("css"))


def problems(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """(path, what is wrong) of the given paths that are missing or are files of an unknown kind."""
    conf, jvm, out = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm, []
    for p in dict.fromkeys(paths):
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        if not fs.globStatus(at):
            out.append((p, "missing"))
        elif fs.exists(at) and fs.getFileStatus(at).isFile() and p.split("?")[0].rsplit(".", 1)[-1].lower() not in MARKUP:
            out.append((p, "unsupported"))
    return out


def write_outputs(outputs: DataFrame, root: str, out: str) -> DataFrame:
    """Writes the changed documents (path, text_before, text_after) to their places below ``out`` and returns
    (path, written), written null where the place is refused.

    Each task writes its own files, whole or not at all, through the file system that the place names.
    """
    dest = destination(F.col("path"), root, out)
    changed = outputs.where("text_before <> text_after").select("path", dest.alias("written"), "text_after")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for place, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if place is not None:
                    system, at = fs.FileSystem.from_uri(place)
                    part = f"{at.rpartition('/')[0]}/.{uuid.uuid4().hex}.part"
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    with system.open_output_stream(part) as f:
                        f.write((text or "").encode())
                    system.move(part, at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["path", "written"])

    return changed.mapInArrow(run, "path string, written string")


def destination(path: Column, root: str, out: str) -> Column:
    """Where an output goes: its place below ``root`` mirrored in ``out``, its base name if outside ``root``;
    null where that is the source itself and not in a disposable folder."""
    top = root.rstrip("/") + "/"
    below = F.when(path.startswith(top), F.substring(path, F.lit(len(top) + 1), F.length(path))).otherwise(F.substring_index(path, "/", -1))
    dest = F.concat(F.lit(out.rstrip("/") + "/"), below)
    disposable = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, DISPOSABLE)))
    return F.when((dest != path) | disposable, dest)


def line_diff(before: Column, after: Column, label: Column) -> Column:
    """The lines between the common first and last ones, old then new; a note where nothing changed."""
    a, b = F.split(before, "\n", -1), F.split(after, "\n", -1)
    same = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False).cast("int") - 1
    prefix = same(a, b)
    suffix = F.least(same(F.reverse(a), F.reverse(b)), F.size(a) - prefix, F.size(b) - prefix)
    middle = lambda x, mark: F.transform(F.slice(x, prefix + 1, F.size(x) - prefix - suffix), lambda t: F.concat(F.lit(mark), t))
    at = (prefix + 1).cast("string")
    head = F.array(F.concat(F.lit("--- a/"), label), F.concat(F.lit("+++ b/"), label))
    place = F.when(prefix > 0, F.array(F.concat(F.lit("@@ -"), at, F.lit(" +"), at, F.lit(" @@")))).otherwise(F.array().cast("array<string>"))
    return F.when(before == after, F.concat(F.lit("  (unchanged) "), label)).otherwise(F.array_join(F.concat(head, place, middle(a, "-"), middle(b, "+")), "\n"))
