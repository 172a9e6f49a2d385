"""Command line: optimise markup files into a mirrored folder, show what would change, or audit them.

Ends with 0 if all went well, 1 if files failed or there was nothing to read, 2 if it was called wrongly.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

CONFIG = "tessella.json"
#: What a configuration file may set; the command line goes before it.
SETTINGS = {"provider": str, "css": list, "safety": int, "patterns": list, "out": str, "dry_run": bool, "audit": bool, "report": bool, "details": bool}


class Misuse(ValueError):
    pass


def find_config(start: Path) -> Path | None:
    """The nearest configuration file, in this folder or one above it, up to a project's top."""
    for folder in (start.resolve(), *start.resolve().parents):
        if (folder / CONFIG).is_file():
            return folder / CONFIG
        if (folder / "package.json").is_file() or (folder / ".git").exists():
            return None
    return None


def load_config(path: Path) -> dict:
    try:
        found = json.loads(path.read_text())
    except (OSError, ValueError) as e:
        raise Misuse(f"cannot read {path}: {e}") from e
    if not isinstance(found, dict):
        raise Misuse(f"{path} must hold an object")
    for name, value in found.items():
        if name not in SETTINGS or not isinstance(value, SETTINGS[name]):
            raise Misuse(f"{path}: no such setting, or of another type: {name}")
    return found


def read_arguments(argv: list[str], folder: Path) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tessella", exit_on_error=False)
    p.add_argument("paths", nargs="*")
    p.add_argument("--provider", choices=("css", "utility"))
    p.add_argument("--css", nargs="*")
    p.add_argument("--safety", type=int)
    p.add_argument("--patterns", nargs="*")
    p.add_argument("--out")
    for flag in ("--dry-run", "--audit", "--report", "--details"):
        p.add_argument(flag, action="store_true", default=None)
    try:
        args, rest = p.parse_known_args(argv)
    except argparse.ArgumentError as e:
        raise Misuse(str(e)) from e
    if rest or not args.paths:
        raise Misuse(f"unknown arguments {rest}" if rest else "no paths given")
    config = find_config(folder)
    known = load_config(config) if config else {}
    defaults = {"provider": "css", "css": [], "safety": 2, "patterns": None, "out": str(folder / "tessella-out")}
    for name in SETTINGS:
        if getattr(args, name) is None:
            setattr(args, name, known.get(name, defaults.get(name, False)))
    here = lambda path: path if "://" in path else str((folder / path).absolute())
    args.paths, args.css, args.out = [here(x) for x in args.paths], [here(x) for x in args.css], here(args.out)
    return args


def execute(spark, args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from tessella.operators.optimize import Options
    from tessella.plans import audit as A
    from tessella.plans import report
    from tessella.sources import files as L
    from tessella.sources import stylesheet as C

    try:
        options = Options(args.safety, None if args.patterns is None else tuple(args.patterns), provider=args.provider)
    except ValueError as e:
        raise Misuse(str(e)) from e
    wrong = L.problems(spark, args.paths)
    for path, why in wrong:
        print(f"{path}: {why}", file=sys.stderr)
    paths = [p for p in args.paths if p not in {w for w, _ in wrong}]
    if not paths:
        return 1
    local = F.regexp_replace("path", "^file:/*", "/")
    docs = L.scan(spark, paths).withColumn("path", local)
    given = "\n".join(r.css for r in L.read_stylesheets(spark, args.css).orderBy("path").collect()) if args.css else ""
    css = F.concat_ws("\n", F.lit(given), F.when(F.col("kind") == "html", C.own_css(F.col("text"))))
    done = A.optimize_documents(docs, "path", "text", css, options, F.when(F.col("kind") == "html", "html").otherwise("jsx")).cache()
    stats = A.file_stats(done, "path")
    failed = done.where("error is not null").select("path", "error").orderBy("path").toLocalIterator()
    n_failed = 0
    for r in failed:
        n_failed += 1
        print(f"{r.path}: {r.error}", file=sys.stderr)
    totals = A.run_totals(stats).first().asDict()
    if not totals["files"]:
        print("no markup files found", file=sys.stderr)
        return 1
    if args.audit:
        print(report.audit_text(A.audit_totals(stats).first().asDict(), [r.asDict() for r in A.worst(stats, "path").collect()]))
        return int(n_failed > 0)
    if args.dry_run:
        changed = done.where("text_before <> text_after").select("path", L.line_diff(F.col("text_before"), F.col("text_after"), F.col("path")).alias("diff"))
        for r in changed.orderBy("path").toLocalIterator():
            print(r.diff)
    else:
        root = str(Path(paths[0]).resolve()) if len(paths) == 1 and Path(paths[0]).is_dir() else str(Path.cwd())
        wrote = L.write_outputs(done, root, args.out).join(stats, "path").orderBy("written").toLocalIterator()
        for r in wrote:
            print(f"{r.path}: not written over itself" if r.written is None else f"wrote {r.written}" + (f" ({r.nodes_removed} nodes, {r.bytes_saved} bytes)" if args.details else ""))
    if args.report or not totals["changed"]:
        print(report.run_text(totals))
    return int(n_failed > 0)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    try:
        args = read_arguments(sys.argv[1:] if argv is None else argv, Path.cwd())
        return execute(SparkSession.builder.getOrCreate(), args)
    except Misuse as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
