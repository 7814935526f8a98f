"""Reports of small result tables: one row per system, rendered on the driver, and a distributed CSV or JSON sink."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

#: From which value on a measure is a warning or a problem.
LEVELS = {"l1": (0.3, 0.6), "l2": (0.3, 0.6), "l3": (0.3, 0.6), "acds": (0.3, 0.6), "urr": (0.05, 0.2), "ccx": (5, 10), "csd": (20, 50)}


def rows_of(df: DataFrame) -> list[dict]:
    """All rows, fetched a partition at a time. A report is for results that a reader or a file can take; larger ones belong in ``write``."""
    return [r.asDict() for r in df.toLocalIterator()]


def shown(value) -> str:
    return "unmeasured" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value)


def status(name: str, value) -> str:
    if value is None or name not in LEVELS or not isinstance(value, (int, float)):
        return ""
    low, high = LEVELS[name]
    return "ok" if value < low else "warn" if value < high else "bad"


def to_json(rows: list[dict]) -> str:
    return json.dumps(rows, indent=2, default=str)


def to_markdown(rows: list[dict], title: str = "Report") -> str:
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    head = list(rows[0])
    lines = [f"| {' | '.join(shown(r[c]).replace('|', chr(92) + '|') for c in head)} |" for r in rows]
    return "\n".join([f"# {title}", "", f"| {' | '.join(head)} |", "|" + "---|" * len(head), *lines, ""])


def to_html(rows: list[dict], title: str = "Report") -> str:
    head = list(rows[0]) if rows else []
    cells = lambda r: "".join(f'<td class="{status(c, r[c])}">{html.escape(shown(r[c]))}</td>' for c in head)
    body = "".join(f"<tr>{cells(r)}</tr>" for r in rows)
    style = "table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}.warn{background:#ffe9a8}.bad{background:#f5b5b0}.ok{background:#cfeccf}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in head)}</tr>{body}</table></body></html>"


def to_csv(rows: list[dict]) -> str:
    import csv
    import io

    out = io.StringIO()
    if rows:
        w = csv.DictWriter(out, fieldnames=list(rows[0]))
        w.writeheader()
        w.writerows(rows)
    return out.getvalue()


def write(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a result of any size as a folder of files."""
    (df.write.option("header", True) if kind == "csv" else df.write).mode("overwrite").format(kind).save(path)
