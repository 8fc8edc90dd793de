"""Reports from small result tables: Markdown, HTML and inline SVG charts, on the driver."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

MAX_ROWS = 2_000


def rows_of(df: DataFrame) -> tuple[list[str], list[list]]:
    """Columns and rows of a result; more than ``MAX_ROWS`` is no report table."""
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError("too many rows for a report")
    return df.columns, [list(r) for r in rows]


def _cell(v: object) -> str:
    return "–" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)


def markdown(cols: Sequence[str], rows: Sequence[Sequence]) -> str:
    line = lambda xs: "| " + " | ".join(str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(cols), line(["---"] * len(cols)), *(line(map(_cell, r)) for r in rows)])


def table(cols: Sequence[str], rows: Sequence[Sequence]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in cols)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def _svg(w: int, h: int, parts: Sequence[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {w} {h}" width="{w}" height="{h}" font-size="11">{"".join(parts)}</svg>'


def bar_chart(labels: Sequence[str], values: Sequence[float | None], errors: Sequence[float | None] | None = None) -> str:
    """Bars up and down from zero with optional whiskers."""
    n, w, h = len(labels), 60 * max(1, len(labels)) + 20, 220
    top = max([abs(v or 0) + ((errors or [0] * n)[i] or 0) for i, v in enumerate(values)] or [1]) or 1
    y = lambda v: 100 - 85 * v / top
    parts = [f'<line x1="0" y1="{y(0)}" x2="{w}" y2="{y(0)}" stroke="#888"/>']
    for i, (name, v) in enumerate(zip(labels, values, strict=True)):
        x, v0 = 20 + 60 * i, v or 0.0
        parts.append(f'<rect x="{x}" y="{min(y(0), y(v0)):.1f}" width="40" height="{abs(y(0) - y(v0)):.1f}" fill="{"#2b6cb0" if v0 >= 0 else "#c05621"}"/>')
        if errors and errors[i]:
            parts.append(f'<line x1="{x + 20}" x2="{x + 20}" y1="{y(v0 - errors[i]):.1f}" y2="{y(v0 + errors[i]):.1f}" stroke="#222"/>')
        parts.append(f'<text x="{x}" y="212">{html.escape(str(name)[:9])}</text>')
    return _svg(w, h, parts)


def line_chart(values: Sequence[float]) -> str:
    if not values:
        return _svg(600, 200, [])
    lo, hi = min(0.0, *values), max(0.0, *values)
    span, step = (hi - lo) or 1, 580 / max(1, len(values) - 1)
    points = " ".join(f"{10 + i * step:.1f},{190 - 180 * (v - lo) / span:.1f}" for i, v in enumerate(values))
    return _svg(600, 200, [f'<polyline points="{points}" fill="none" stroke="#2b6cb0" stroke-width="1.5"/>'])


def heat_map(row_names: Sequence[str], col_names: Sequence[str], values: Mapping[tuple[str, str], float | None]) -> str:
    top = max([abs(v) for v in values.values() if v is not None] or [1]) or 1
    parts = [f'<text x="{150 + 70 * j}" y="14">{html.escape(str(c))}</text>' for j, c in enumerate(col_names)]
    for i, r in enumerate(row_names):
        parts.append(f'<text x="2" y="{38 + 24 * i}">{html.escape(str(r)[:22])}</text>')
        for j, c in enumerate(col_names):
            v = values.get((r, c))
            fill = "#eee" if v is None else f"rgba({'43,108,176' if v >= 0 else '192,86,33'},{abs(v) / top:.2f})"
            parts.append(f'<rect x="{145 + 70 * j}" y="{22 + 24 * i}" width="68" height="22" fill="{fill}"/><text x="{152 + 70 * j}" y="{38 + 24 * i}">{_cell(v)}</text>')
    return _svg(160 + 70 * len(col_names), 40 + 24 * len(row_names), parts)


def report(title: str, sections: Sequence[tuple[str, DataFrame]]) -> tuple[str, str]:
    """(HTML, Markdown) of headed tables; a section without rows says so."""
    page, text = [f"<h1>{html.escape(title)}</h1>"], [f"# {title}"]
    for name, df in sections:
        cols, rows = rows_of(df)
        page.append(f"<h2>{html.escape(name)}</h2>" + (table(cols, rows) if rows else "<p>no rows</p>"))
        text.append(f"## {name}\n\n" + (markdown(cols, rows) if rows else "no rows"))
    return "<!doctype html><meta charset='utf-8'>" + "".join(page), "\n\n".join(text)
