"""Reports of audits as files: tables, a page with histograms, and a manifest of the run."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvan.sources import files as small

PLACES = 4


def table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of a report in their order: those that df lacks are null, others go, and doubles have four places."""
    kinds = dict(df.dtypes)
    one = lambda c: F.lit(None).cast("string") if c not in kinds else F.bround(F.col(c), PLACES) if kinds[c] in ("double", "float") else F.col(c)
    return df.select(*(one(c).alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str] = ()) -> None:
    """One file with a header in the folder path. A report has a row for each group of an audit, so it fits one task."""
    rows = table(df, columns)
    (rows.orderBy(*order) if order else rows).coalesce(1).write.mode("overwrite").csv(path, header=True)


def most_incomplete(coverage: DataFrame, limit: int = 20) -> DataFrame:
    """The groups of a coverage audit with the lowest coverage, those with most empty units first."""
    return coverage.orderBy("coverage_pct", F.desc("empty"), *(c for c in ("corpus_id", "version_id", "height", "depth") if c in coverage.columns)).limit(limit)


def _rows(df: DataFrame, most: int) -> tuple[list[str], list]:
    return df.columns, df.limit(most).collect()


def page(title: str, tables: dict[str, DataFrame], histograms: dict[str, DataFrame], most: int = 1_000) -> str:
    """An HTML page with tables and bars. histograms: label, bin, n; of each frame the first `most` rows are shown."""
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        columns, rows = _rows(df, most)
        cell = lambda v: "" if v is None else html.escape(str(v))
        body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in columns)}</tr>{body}</table>")
    for name, df in histograms.items():
        _, rows = _rows(df.select("label", "bin", "n").orderBy("label", "bin"), most)
        top = max((r["n"] for r in rows), default=1)
        bars = "".join(f"<rect x={4 * k} y={100 - round(100 * r['n'] / top)} width=3 height={round(100 * r['n'] / top)}><title>{html.escape(str(r['label']))}, {r['bin']}: {r['n']}</title></rect>" for k, r in enumerate(rows))
        out.append(f"<h2>{html.escape(name)}</h2><svg width={4 * len(rows)} height=100>{bars}</svg>")
    return "\n".join(out)


def write(folder: str, run_id: str, created_at: str, tables: dict[str, DataFrame], histograms: dict[str, DataFrame], title: str = "Audit") -> dict:
    """Writes each table as CSV, the page, and a manifest that says how many rows each has; the manifest."""
    spark = next(iter(tables.values())).sparkSession
    at = f"{folder}/{run_id}"
    counts = {}
    for name, df in tables.items():
        write_csv(df, f"{at}/{name}", df.columns)
        counts[name] = df.count()
    small.write_bytes(spark, f"{at}/report.html", page(title, tables, histograms).encode())
    manifest = {"run_id": run_id, "created_at": created_at, "rows": counts}
    small.write_json(spark, f"{at}/manifest.json", manifest)
    return manifest
