"""Reports as JSON, markdown, pull request comments and text, and contract stubs. Rows are a report's, so few."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from . import report

MARK = "<!-- plumbline-report -->"
ICONS = {"error": "❌", "warn": "⚠️", "info": "ℹ️"}


def collected(diagnostics: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in diagnostics.orderBy(*report.sort_keys()).collect()]


def summary_of(rows: list[dict]) -> dict[str, int]:
    count = lambda s: sum(r["severity"] == s for r in rows)
    return {"total": len(rows), "errors": count("error"), "warnings": count("warn"), "infos": count("info")}


def to_json(rows: list[dict], content_hash: str, models_checked: int = 0, contracts_validated: int = 0) -> str:
    summary = summary_of(rows) | {"models_checked": models_checked, "contracts_validated": contracts_validated}
    return json.dumps({"version": {"major": 1, "minor": 0}, "content_hash": content_hash, "summary": summary, "diagnostics": rows}, indent=2, ensure_ascii=False)


def to_markdown(rows: list[dict], title: str = "Schema report") -> str:
    s = summary_of(rows)
    out = [f"# {title}", "", f"{s['errors']} errors, {s['warnings']} warnings, {s['infos']} infos", ""]
    for severity in report.SEVERITIES:
        some = [r for r in rows if r["severity"] == severity]
        if some:
            out += [f"## {ICONS[severity]} {severity} ({len(some)})", "", *[f"- `{r['code']}` {r['message']}" + (f" ({r['file']})" if r.get("file") else "") for r in some], ""]
    return "\n".join(out if rows else [*out, "No findings.", ""])


def to_comment(rows: list[dict], impact_limit: int = 10) -> str:
    """Markdown with a hidden mark, so a later run can find and replace it."""
    s = summary_of(rows)
    out = [MARK, f"### {'❌ Failing' if s['errors'] else '✅ Passing'}: {s['errors']} errors, {s['warnings']} warnings", ""]
    for severity in report.SEVERITIES:
        some = [r for r in rows if r["severity"] == severity]
        if some:
            out += [f"<details{' open' if severity == 'error' else ''}><summary>{ICONS[severity]} {len(some)} {severity}</summary>", ""]
            for r in some:
                out.append(f"- `{r['code']}` {r['message']}")
                if r.get("impact"):
                    more = len(r["impact"]) - impact_limit
                    out.append(f"  - downstream: {', '.join(r['impact'][:impact_limit])}" + (f" and {more} more" if more > 0 else ""))
            out += ["", "</details>", ""]
    return "\n".join(out)


def to_text(rows: list[dict]) -> str:
    s = summary_of(rows)
    return "\n".join([*[f"{r['severity'].upper():5} {r['code']} {r['message']}" for r in rows], f"{s['total']} findings: {s['errors']} errors, {s['warnings']} warnings, {s['infos']} infos"])


def contract_yaml(model: str, columns: list[tuple[str, str]]) -> str:
    """A stub of an enforced contract for a model."""
    out = ["version: 2", "", "models:", f"  - name: {model}", "    config:", "      contract:", "        enforced: true", "    columns:"]
    return "\n".join([*out, *[x for name, kind in columns for x in (f"      - name: {name}", f"        data_type: {kind}")]]) + "\n"


WORKFLOW = """name: schema check
on: [pull_request]
jobs:
  check:
    runs-on: ubuntu-latest
    steps:
      - uses: actions/checkout@v4
      - run: python -m plumbline check --manifest target/manifest.json --sql . --output report.json
"""
