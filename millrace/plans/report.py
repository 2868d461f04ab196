"""The import report: small frames as one HTML page, and checks as JSON."""

from __future__ import annotations

import html
import json
from dataclasses import asdict

from pyspark.sql import DataFrame

from ..operators import rules
from ..operators.reconcile import Check, status_of
from .mapping import Mapping

PREVIEW = {"rejected": 25, "corrections": 25, "lineage": 50}


def report_data(typed: DataFrame, issues: DataFrame, checks: list[Check], frames: dict[str, DataFrame] | None = None, published: bool = False, signoff: str = "", mappings: list[Mapping] | None = None, coverage: list[dict] | None = None, run: dict | None = None, reviewer: str = "", notes: str = "", replay: dict | None = None) -> dict:
    """What the page shows: counts, issues by type, checks, and the first rows of each frame, ordered by row number; the run, its mapping decisions, the use of source columns and the sign-off where they are given.

    run: facts of the run as the store keeps them. replay: the run that published the same file before.
    """
    status = "Published" if published else "Needs customer correction" if signoff == "needs_customer_correction" or status_of(checks) == "FAIL" else "Ready for publish"
    rows = {k: [r.asDict() for r in df.orderBy("source_row_number").limit(PREVIEW.get(k, 25)).collect()] for k, df in (frames or {}).items()}
    counts = rules.counts(typed, issues).first().asDict()
    return {"status": status, "reconciliation": status_of(checks), "counts": counts, "errors": [r.asDict() for r in rules.by_type(issues, "error").collect()], "warnings": [r.asDict() for r in rules.by_type(issues, "warning").collect()], "checks": [asdict(c) for c in checks], "frames": rows, "run": _run_facts(run or {}, replay), "mappings": [_decision(m) for m in mappings or []],
            "coverage": coverage or [], "coverage_counts": {k: sum(c["status"] == k for c in coverage or []) for k in ("approved_mapped", "suggested_mapped", "unused")}, "signoff": {"decision": signoff, "reviewer": reviewer, "notes": notes}}


def _run_facts(run: dict, replay: dict | None) -> dict:
    kept = ("id", "run_kind", "parent_import_run_id", "attempt", "contract", "version", "template_name", "template_version")
    return {k: run.get(k) for k in kept} | {"source_file_hash_short": (run.get("source_file_hash") or "")[:12], "is_replay": replay is not None, "previous_import_run_id": (replay or {}).get("id")}


def _decision(m: Mapping) -> dict:
    steps = ", ".join(s.operation for s in m.steps)
    return {"target_table": m.table, "target_field": m.field, "source_columns": m.source, "steps": steps, "failure_policy": m.policy, "confidence": m.confidence, "status": m.status, "type_alignment": m.alignment, "review_flags": ", ".join(m.flags), "needs_review": m.needs_review, "approved": m.approved}


def table_html(rows: list[dict], columns: list[str] | None = None) -> str:
    if not rows:
        return "<p>None.</p>"
    columns = columns or list(rows[0])
    cell = lambda v: html.escape("" if v is None else str(v))
    head = "".join(f"<th>{cell(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(r.get(c))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def render_html(data: dict, title: str = "Import report") -> str:
    parts = [f"<h1>{html.escape(title)}</h1><p>{html.escape(data['status'])} · {html.escape(data['reconciliation'])}</p>", "<h2>Rows</h2>" + table_html([data["counts"]])]
    parts += [f"<h2>{h}</h2>" + table_html(data[k]) for h, k in (("Errors", "errors"), ("Warnings", "warnings"), ("Checks", "checks"))]
    for title_, key in (("Mapping decisions", "mappings"), ("Source columns", "coverage")):
        parts += [f"<h2>{title_}</h2>" + table_html(data[key])] if data.get(key) else []
    for title_, key in (("Run", "run"), ("Sign-off", "signoff")):
        parts += [f"<h2>{title_}</h2>" + table_html([data[key]])] if any((data.get(key) or {}).values()) else []
    parts += [f"<h2>{html.escape(k)}</h2>" + table_html(rows) for k, rows in data["frames"].items()]
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>{''.join(parts)}</body></html>"


def checks_json(checks: list[Check]) -> bytes:
    return json.dumps({"status": status_of(checks), "checks": [asdict(c) for c in checks]}, indent=2).encode()
