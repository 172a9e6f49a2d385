"""Totals as text for people."""

from __future__ import annotations

WIDTH = 26


def _bytes(n: int) -> str:
    size, unit = float(n), 0
    while size >= 1024 and unit < 4:
        size, unit = size / 1024, unit + 1
    return f"{n} B" if not unit else f"{size:.1f} {('KB', 'MB', 'GB', 'TB')[unit - 1]}"


def table(title: str, rows: list[tuple[str, str]], notes: list[str] = ()) -> str:
    lines = [title, "-" * len(title), *(f"{name:<{WIDTH}}{value}" for name, value in rows)]
    return "\n".join([*lines, *notes])


def audit_text(totals: dict, worst: list[dict]) -> str:
    """The score, what could be saved, and the documents with the most."""
    t = totals
    rows = [
        ("score", f"{t['score']} of 100"), ("files", f"{t['files']:,}"), ("files to improve", f"{t['files_improvable']:,}"), ("nodes to remove", f"{t['nodes_removable']:,} of {t['nodes_total']:,}"),
        ("class tokens to save", f"{t['classes_compressible']:,}"), ("bytes to save", f"{_bytes(t['bytes_savable'])} of {_bytes(t['bytes_total'])}"),
    ]
    return table("Audit", rows, [f"  {k}. {w['id']}: {_bytes(w['bytes_savable'])}, {w['nodes_removed']:,} nodes, {w['classes_saved']:,} class tokens" for k, w in enumerate(worst, 1)])


def run_text(totals: dict) -> str:
    t = totals
    return table("Run", [("files", f"{t['files']:,}"), ("files changed", f"{t['changed']:,}"), ("nodes removed", f"{t['nodes_removed']:,}"), ("class tokens saved", f"{t['classes_saved']:,}"), ("bytes saved", _bytes(t["bytes_saved"]))])
