"""The whole investigation of one table."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from .. import __version__
from ..functions import vocab as V
from ..operators import completeness, consistency, distribution, leakage, uniqueness, validity
from .context import Context
from .frame import canonical
from .model import Dossier
from .scoring import trust_score

STAGES = ("profile", "completeness", "uniqueness", "validity", "distribution", "consistency", "leakage", "score")


class Cancelled(RuntimeError):
    """Raised between stages when the caller's ``progress`` returns False."""


def investigate(df: DataFrame, target: str | None = None, row_id: str | None = None, metadata: dict | None = None, progress: Callable[[str], bool | None] | None = None) -> Dossier:
    """Profile, six analyzers, order, score and advice for a table.

    ``target`` names a column to predict, for the leakage detectors; ``row_id`` a
    column of unique integers that evidence refers to. Findings are ordered by
    severity, then analyzer, column and detector; the score depends on that order.
    """
    began = time.perf_counter()
    sc = df.sparkSession.sparkContext

    def stage(name: str) -> None:
        sc.setLocalProperty("spark.job.description", f"investigate: {name}")
        if progress is not None and progress(name) is False:
            raise Cancelled(name)

    if target is not None and target not in df.columns:
        raise ValueError(f"no column {target!r}; there are {', '.join(df.columns[:20])}{' and more' if len(df.columns) > 20 else ''}")
    stage("profile")
    frame = canonical(df, row_id)
    if not frame.columns:
        raise ValueError("the table has no columns")
    ctx, summary = Context.of(frame)
    try:
        found = []
        for name, part in (("completeness", completeness), ("uniqueness", uniqueness), ("validity", validity), ("distribution", distribution), ("consistency", consistency)):
            stage(name)
            found += part.find(ctx)
        stage("leakage")
        found += leakage.find(ctx, target)
        stage("score")
    finally:
        ctx.freq.unpersist()
        sc.setLocalProperty("spark.job.description", None)
    unique = list({f.id: f for f in reversed(found)}.values())[::-1]
    findings = sorted(unique, key=lambda f: V.SEVERITIES.index(f.severity))
    for f in findings:
        for c in f.affected_columns:
            if c in ctx.by_name:
                ctx.by_name[c].anomalies_detected += 1
    advice = sorted((r for f in findings for r in f.recommendations), key=lambda r: V.SEVERITIES.index(r.priority))
    about = {
        "file_name": "table", "file_size_bytes": 0, "file_type": "table", "sheet_name": None, "available_sheets": None, "table_index": None, "page_count": None,
        **(metadata or {}),
        "row_count": ctx.rows, "column_count": len(frame.columns), "analyzed_at": datetime.now(timezone.utc).isoformat(), "execution_time_ms": round((time.perf_counter() - began) * 1000, 2), "engine_version": __version__,
    }
    return Dossier(about, summary, trust_score(findings), findings, ctx.profiles, advice)


def investigate_file(spark, path: str, target: str | None = None, **options) -> Dossier:
    """Load a file (see ``lakeassay.sources.load``) and investigate it."""
    from ..sources.files import load

    loaded = load(spark, path, **options)
    if not loaded.df.columns or not loaded.df.limit(1).count():
        raise ValueError("the file has 0 records or 0 columns")
    return investigate(loaded.df, target, row_id=loaded.row_id, metadata=loaded.metadata)
