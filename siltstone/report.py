"""Evaluation reports as Markdown, and the circumstances of a run."""

from __future__ import annotations

import platform
import subprocess
from collections.abc import Iterator
from importlib import metadata
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

import siltstone

#: Packages whose versions a report names.
PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy", "sentence-transformers", "torch")
#: Column heads of the table of modes: name, key, whether it has an interval.
COLUMNS = (("Hit@k", "hit_at_k", True), ("nDCG@k", "ndcg_at_k", True), ("Recall@k", "recall_at_k", True), ("MRR", "mrr", True))


def _git(*arguments: str) -> str | None:
    try:
        return subprocess.run(("git", *arguments), cwd=Path(__file__).parent, capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def commit() -> str:
    """The short commit of the code, marked if files differ from it; `unknown` outside a repository."""
    name, changed = _git("rev-parse", "--short", "HEAD"), _git("status", "--porcelain")
    return "unknown" if name is None else f"{name}{'-dirty' if changed else ''}"


def _installed(package: str) -> str:
    try:
        return metadata.version(package)
    except metadata.PackageNotFoundError:
        return "not installed"


def run_environment(spark: SparkSession) -> dict[str, Any]:
    """What is needed to tell whether two runs can be compared."""
    return {
        "version": siltstone.__version__, "git_commit": commit(), "python": platform.python_version(), "platform": platform.platform(),
        "spark": spark.version, "master": spark.sparkContext.master, "packages": {p: _installed(p) for p in PACKAGES},
    }


def _cell(mode: dict[str, Any], key: str, interval: bool) -> str:
    bounds = (mode.get("confidence_intervals") or {}).get(key) if interval else None
    value = f"{mode.get(key, 0.0):.3f}"
    return f"{value} [{bounds['low']:.3f}, {bounds['high']:.3f}]" if bounds else value


def _facts(report: dict[str, Any]) -> Iterator[tuple[str, Any]]:
    """Name and value of what is known of the run, in order."""
    run, dataset = report.get("run") or {}, report.get("dataset") or {}
    about = run.get("environment") or {}
    yield from ((k.replace("git_", ""), about[k]) for k in ("git_commit", "version", "python", "spark", "master", "platform") if k in about)
    yield from ((k.replace("_", " "), v) for k, v in (run.get("retrieval") or {}).items())
    yield from ((k.replace("_", " "), run[k]) for k in ("index_seconds", "total_seconds", "started_at") if k in run)
    yield from (about.get("packages") or {}).items()
    if dataset:
        extent = "subset" if dataset.get("subset") else "full"
        yield "dataset", f"{dataset.get('dataset_id', '?')} ({extent}), fingerprint {dataset.get('fingerprint', '?')}"


def report_markdown(report: dict[str, Any]) -> str:
    """The report as a page: what was run, a table of modes, their comparison, the run."""
    lines = [f"# Evaluation: {report.get('suite', 'unknown')}", ""]
    lines += [f"- {name}: {report[key]}" for name, key in (("provider", "provider"), ("top_k", "top_k"), ("documents", "doc_count"), ("queries", "query_count"), ("rerank", "rerank")) if key in report]
    lines += ["", "Scores are per document: the chunks found are collapsed to their documents before the list is cut", "to top_k. Brackets are 95 % bootstrap intervals over the queries.", ""]
    lines += ["| mode | " + " | ".join(c[0] for c in COLUMNS) + " | p50 ms | p95 ms |", "| --- |" + " ---: |" * (len(COLUMNS) + 2)]
    for name, mode in sorted((report.get("modes") or {}).items()):
        times = mode.get("latency_ms") or {}
        cells = [name, *[_cell(mode, key, interval) for _, key, interval in COLUMNS], *[f"{times.get(t, 0.0):.1f}" for t in ("p50_ms", "p95_ms")]]
        lines.append("| " + " | ".join(cells) + " |")
    if report.get("comparison"):
        lines += ["", "## Comparison", "", *[f"- {k.replace('_', ' ')}: {v:+.3f}" for k, v in report["comparison"].items()]]
    facts = list(_facts(report))
    if facts:
        lines += ["", "## Run", "", *[f"- {name}: {value}" for name, value in facts]]
    return "\n".join(lines) + "\n"
