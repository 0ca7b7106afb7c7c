"""Reports: JSON, Markdown, HTML and text, with SVG charts."""

from __future__ import annotations

import json
import math
from html import escape
from pathlib import Path

from ..operators.prepare import chart_points
from .findings import Result, Severity


def to_json(r: Result) -> str:
    return json.dumps(r.to_dict(), indent=2, allow_nan=False, sort_keys=True)


def from_json(path: str) -> Result:
    return Result.from_dict(json.loads(Path(path).read_text()))


def number(x, digits: int = 2) -> str:
    return "-" if x is None or (isinstance(x, float) and not math.isfinite(x)) else f"{x:,.{digits}f}" if isinstance(x, float) else str(x)


def tables(r: Result) -> dict[str, tuple[list[str], list[list]]]:
    """Title -> (heads, rows) of what the sections hold; all formats print the same ones."""
    s, out = r.sections, {}
    scenarios = (s.get("execution") or {}).get("scenarios") or {}
    if scenarios:
        out["Scenarios"] = (["scenario", "returns", "total", "Sharpe ratio"], [[k, v["n"], v["total"], v["sharpe"]] for k, v in scenarios.items()])
    for title, key in (("Cost sensitivity", "cost_sensitivity"), ("Turnover", "turnover"), ("Break-even", "break_even")):
        block = (s.get("execution") or {}).get(key) or {}
        flat = {k: v for k, v in block.items() if not isinstance(v, list | dict)}
        if flat:
            out[title] = (["", "value"], [[k, v] for k, v in flat.items()])
    if found := (s.get("execution") or {}).get("attribution"):
        out["Cost attribution"] = (["component", "total", "a year"], [[x["component"], x["total"], x["annual"]] for x in found])
    stats = s.get("statistics") or {}
    flat = {k: v for k, v in (stats.get("headline") or {}).items()} | {k: stats[k] for k in ("psr", "needed", "adjusted") if k in stats} | {f"deflated {k}": v for k, v in (stats.get("dsr") or {}).items()} | {f"interval {k}": v for k, v in (stats.get("interval") or {}).items()}
    if flat:
        out["Statistics"] = (["", "value"], [[k, v] for k, v in flat.items()])
    valid = s.get("validation") or {}
    if folds := (valid.get("walk_forward") or {}).get("folds"):
        out["Walk-forward"] = (["fold", "trial", "train", "test"], [[f["fold"], f["trial"], f["train_sharpe"], f["test_sharpe"]] for f in folds])
    if pbo := valid.get("pbo"):
        out["Overfitting"] = (["", "value"], [[k, v] for k, v in pbo.items()])
    if paths := valid.get("paths"):
        out["Combinatorial paths"] = (["path", "Sharpe ratio"], list(map(list, enumerate(paths["sharpes"]))))
    if surface := (s.get("sensitivity") or {}).get("surface"):
        out["Parameter surface"] = (["", "value"], [[k, v] for k, v in surface.items() if not isinstance(v, list | dict)])
    for name, rows in (s.get("regimes") or {}).items():
        if rows:
            heads = [h for h in rows[0] if h != "first"]
            out[f"Regimes: {name}"] = (heads, [[x[h] for h in heads] for x in rows])
    return out


def to_markdown(r: Result, passes: bool = True) -> str:
    cell = lambda x: number(x, 4).replace("|", "/")
    lines = [f"# Audit: {r.status}", "", " | ".join(f"{k} {v}" for k, v in r.counts().items()), "", "## Why", *[f"- {x}" for x in r.narrative()]]
    if steps := r.next_steps():
        lines += ["", "## What to do", *[f"- {x}" for x in steps]]
    for cat in dict.fromkeys(f.category for f in r.findings):
        rows = [f for f in r.findings if f.category == cat and (passes or f.severity > Severity.PASS)]
        if rows:
            lines += ["", f"## {cat.capitalize()}", "", "| rule | severity | finding |", "|-|-|-|", *[f"| {f.rule} {f.title} | {f.severity.name} | {f.message.replace('|', '/')}{f' ({f.file}:{f.line})' if f.line else ''} |" for f in rows]]
    for f in r.issues():
        if f.evidence:
            lines += ["", f"### {f.rule} {f.title}", "", "```json", json.dumps(Result([f]).to_dict()["findings"][0]["evidence"], indent=1), "```"]
    for title, (heads, rows) in tables(r).items():
        lines += ["", f"## {title}", "", f"| {' | '.join(heads)} |", f"|{'-|' * len(heads)}", *[f"| {' | '.join(map(cell, row))} |" for row in rows]]
    if grid := (r.sections.get("sensitivity") or {}).get("map"):
        lines += ["", "## Surface", "", "```", grid, "```"]
    return "\n".join([*lines, "", "## Manifest", *[f"- {k}: {v}" for k, v in r.manifest.items() if not isinstance(v, list | dict)], ""])


def to_text(r: Result, verbose: bool = False, colour: bool = False) -> str:
    codes = {"FAIL": 31, "WARN": 33, "PASS": 32, "INFO": 36}
    paint = lambda s: f"\x1b[{codes[s]}m{s}\x1b[0m" if colour else s
    lines = [f"Verdict: {paint(r.status)}"]
    for cat in dict.fromkeys(f.category for f in r.findings):
        rows = [f for f in r.findings if f.category == cat and (verbose or f.severity != Severity.INFO)]
        if rows:
            lines += ["", cat.capitalize(), *[f"  {paint(f.severity.name)}{' ' * (5 - len(f.severity.name))} {f.rule:<10} {f.message}" for f in rows]]
    if verbose:
        for title, (heads, rows) in tables(r).items():
            lines += ["", title, *["  " + "  ".join(f"{number(x, 4):>14}" for x in row) for row in [heads, *rows]]]
    if steps := r.next_steps():
        lines += ["", "What to do", *[f"  {x}" for x in steps]]
    return "\n".join(lines)


# ---- charts


def _svg(width: int, height: float, title: str, body: str, data) -> str:
    return f'<svg viewBox="0 0 {width} {height:g}" role="img" data-values="{escape(json.dumps(data), True)}"><title>{escape(title)}</title>{body}</svg>'


def _ticks(lo: float, hi: float, n: int = 4) -> list[float]:
    return [lo + (hi - lo) * i / n for i in range(n + 1)] if hi > lo else [lo]


def line_chart(values: list[float | None], title: str, width: int = 640, height: int = 200) -> str:
    """SVG polyline of at most 400 evenly spaced points; a log axis where values span a factor over 30."""
    keep = [v for v in values if v is not None]
    if len(keep) < 2:
        return ""
    n = len(values)
    log = min(keep) > 0 and max(keep) / min(keep) > 30
    f = math.log if log else float
    lo, hi = f(min(keep)), f(max(keep))
    y = lambda v: height - 20 - (v - lo) / ((hi - lo) or 1) * (height - 40)
    at = [i for i in chart_points(n) if values[i] is not None]
    points = " ".join(f"{60 + i * (width - 70) / (n - 1):.1f},{y(f(values[i])):.1f}" for i in at)
    axis = "".join(f'<line x1="56" x2="{width - 8}" y1="{y(t):.1f}" y2="{y(t):.1f}" stroke="#ddd"/><text x="2" y="{y(t) + 4:.1f}">{math.exp(t) if log else t:.3g}</text>' for t in _ticks(lo, hi))
    return _svg(width, height, title, f'{axis}<polyline fill="none" stroke="currentColor" points="{points}"/>', [values[i] for i in at])


def bar_chart(items: dict[str, float], title: str, width: int = 640) -> str:
    top = max((abs(v) for v in items.values()), default=0) or 1
    rows = "".join(f'<text x="0" y="{20 + 22 * i}">{escape(k)}</text><rect x="160" y="{8 + 22 * i}" height="14" width="{abs(v) / top * (width - 260):.1f}"{" class=neg" if v < 0 else ""}/><text x="{width - 90}" y="{20 + 22 * i}">{v:.3g}</text>' for i, (k, v) in enumerate(items.items()))
    return _svg(width, 22 * len(items) + 10, title, rows, items)


def histogram(values: list[float], title: str, bins: int = 30, width: int = 640, height: int = 160) -> str:
    """Counts in equal bins from the least to the greatest value."""
    keep = [v for v in values if v is not None and math.isfinite(v)]
    if not keep:
        return ""
    lo, hi = min(keep), max(keep)
    counts = [0] * bins
    for v in keep:
        counts[min(bins - 1, int((v - lo) / ((hi - lo) or 1) * bins))] += 1
    step, top = (width - 20) / bins, max(counts)
    bars = "".join(f'<rect x="{10 + i * step:.1f}" width="{step * 0.9:.1f}" y="{height - 20 - c / top * (height - 40):.1f}" height="{c / top * (height - 40):.1f}"/>' for i, c in enumerate(counts))
    return _svg(width, height, title, f'{bars}<text x="10" y="{height - 4}">{lo:.3g}</text><text x="{width - 60}" y="{height - 4}">{hi:.3g}</text>', {"low": lo, "high": hi, "counts": counts})


def heat_chart(cells: list[dict], x: str, y: str, metric: str, title: str, size: int = 46) -> str:
    """A coloured square for each cell, from the least (pale) to the greatest value (dark); empty where there is none."""
    xs, ys = sorted({c[x] for c in cells}), sorted({c[y] for c in cells})
    values = [c[metric] for c in cells if c[metric] is not None]
    if not values:
        return ""
    lo, hi = min(values), max(values)
    body = "".join(f'<text x="{80 + i * size}" y="14">{v:g}</text>' for i, v in enumerate(xs)) + "".join(f'<text x="2" y="{42 + j * size}">{v:g}</text>' for j, v in enumerate(ys))
    for c in cells:
        if c[metric] is not None:
            shade = 235 - int((c[metric] - lo) / ((hi - lo) or 1) * 170)
            px, py = 74 + xs.index(c[x]) * size, 20 + ys.index(c[y]) * size
            body += f'<rect x="{px}" y="{py}" width="{size - 2}" height="{size - 2}" fill="rgb({shade},{shade},245)"/><text x="{px + 4}" y="{py + 26}">{c[metric]:.2f}</text>'
    return _svg(90 + size * len(xs), 26 + size * len(ys), title, body, cells)


def charts(r: Result) -> list[str]:
    s = r.sections
    out = [bar_chart({k: float(v) for k, v in r.counts().items()}, "Findings")]
    if curve := (s.get("charts") or {}).get("equity"):
        out.append(line_chart([v for _, v in curve], "Equity"))
    found = {k: v["sharpe"] for k, v in ((s.get("execution") or {}).get("scenarios") or {}).items() if v["sharpe"] is not None}
    if found:
        out.append(bar_chart(found, "Sharpe ratio by scenario"))
    valid = s.get("validation") or {}
    if paths := valid.get("paths"):
        out.append(histogram(paths["sharpes"], "Sharpe ratios of the combinatorial paths"))
    if heat := (s.get("sensitivity") or {}).get("heatmap"):
        out.append(heat_chart(heat["cells"], heat["x"], heat["y"], "sharpe", "Parameter surface"))
    return [c for c in out if c]


def to_html(r: Result) -> str:
    sections = ""
    for cat in dict.fromkeys(f.category for f in r.findings):
        rows = "".join(f"<tr class={f.severity.name}><td>{escape(f.rule)} {escape(f.title)}</td><td>{f.severity.name}</td><td>{escape(f.message)}{f'<br><i>{escape(f.fix)}</i>' if f.fix else ''}</td></tr>" for f in r.findings if f.category == cat)
        sections += f"<h2>{escape(cat.capitalize())}</h2><table>{rows}</table>"
    for title, (heads, rows) in tables(r).items():
        head = "".join(f"<th>{escape(h)}</th>" for h in heads)
        sections += f"<h2>{escape(title)}</h2><table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{escape(number(x, 4))}</td>" for x in row) + "</tr>" for row in rows) + "</table>"
    data = to_json(r).replace("<", "\\u003c")
    why = "".join(f"<li>{escape(x)}</li>" for x in r.narrative())
    style = "body{font:15px sans-serif;max-width:60em;margin:2em auto}td,th{padding:.2em .6em;text-align:left}.FAIL{color:#a00}.WARN{color:#a60}.neg{fill:#a00}svg{max-width:40em;display:block;margin:1em 0}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>Audit {r.status}</title><style>{style}</style></head><body><h1>{r.status}</h1><ul>{why}</ul>{"".join(charts(r))}{sections}<script type="application/json" id="result">{data}</script></body></html>'


WRITERS = {".json": to_json, ".md": to_markdown, ".html": to_html, ".txt": to_text}


def render(r: Result, fmt: str) -> str:
    return WRITERS[{"markdown": ".md", "text": ".txt"}.get(fmt, f".{fmt}")](r)


def write(r: Result, path: str, fmt: str | None = None) -> None:
    """The format named, else that of the suffix, else HTML."""
    text = render(r, fmt) if fmt else WRITERS.get(Path(path).suffix.lower(), to_html)(r)
    Path(path).write_text(text, encoding="utf-8")
