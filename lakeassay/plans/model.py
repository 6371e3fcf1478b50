"""Results as plain records, and their tables."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import vocab as V


@dataclass
class ColumnProfile:
    name: str
    inferred_dtype: str
    semantic_type: str
    non_null_count: int
    null_count: int
    null_ratio: float
    unique_count: int
    unique_ratio: float
    sample_values: list = field(default_factory=list)
    anomalies_detected: int = 0
    min_value: Any = None
    max_value: Any = None
    mean: float | None = None
    median: float | None = None
    std_dev: float | None = None
    memory_bytes: int | None = None
    is_candidate_identifier: bool = False
    is_constant_or_near_constant: bool = False
    finite_count: int = 0

    @property
    def is_text(self) -> bool:
        return self.inferred_dtype == "str"

    @property
    def is_numeric(self) -> bool:
        return self.inferred_dtype in ("int64", "float64", "bool")


@dataclass
class Evidence:
    metric_name: str
    observed_value: Any
    threshold_or_expected: Any = None
    sample_row_indices: list[int] = field(default_factory=list)
    sample_values: list = field(default_factory=list)
    details: str | None = None


@dataclass
class Recommendation:
    finding_id: str
    action: str
    reason: str
    priority: str


@dataclass
class Finding:
    id: str
    category: str
    severity: str
    title: str
    description: str
    affected_columns: list[str]
    affected_row_count: int
    affected_row_ratio: float
    evidence: list[Evidence] = field(default_factory=list)
    recommendations: list[Recommendation] = field(default_factory=list)


@dataclass
class Penalty:
    finding_id: str
    category: str
    deduction: float
    reason: str


@dataclass
class TrustScore:
    overall_score: float
    verdict: str
    grade: str
    total_deductions: float
    penalties: list[Penalty]
    rationale: str


@dataclass
class Summary:
    total_cells: int
    missing_cells: int
    missing_cell_ratio: float
    duplicate_rows: int
    duplicate_row_ratio: float
    memory_usage_bytes: int


def clean(x: Any) -> Any:
    """Values that strict JSON can hold: non-finite numbers become null, sets sort by text, odd objects become text."""
    if isinstance(x, dict):
        return {str(k): clean(v) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        return [clean(v) for v in sorted(x, key=str)]
    if isinstance(x, (list, tuple)):
        return [clean(v) for v in x]
    if isinstance(x, bool) or x is None or isinstance(x, (int, str)):
        return x
    if isinstance(x, float) or hasattr(x, "__float__") and not hasattr(x, "isoformat"):
        return float(x) if math.isfinite(x) else None
    return str(x)


def clean_cell(x: Any) -> Any:
    """As ``clean``, and a text that a spreadsheet would take for a formula gets ' in front."""
    if isinstance(x, str) and len(x) > 1 and x[0] in "=+-@\t\r":
        try:
            float(x)
        except ValueError:
            return "'" + x
    return clean(x)


@dataclass
class Dossier:
    metadata: dict
    summary: Summary
    trust_score: TrustScore
    findings: list[Finding]
    columns: list[ColumnProfile]
    recommendations: list[Recommendation]

    def to_dict(self) -> dict:
        out = clean(asdict(self))
        for c in out["columns"]:
            del c["finite_count"]
        return out

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(self.to_dict(), allow_nan=False, indent=indent, ensure_ascii=False)

    def to_markdown(self) -> str:
        from .report import markdown

        return markdown(self)

    def findings_df(self, spark: SparkSession) -> DataFrame:
        rows = [(k, f.id, f.category, f.severity, V.SEVERITIES.index(f.severity), f.title, f.description, f.affected_columns, f.affected_row_count, float(f.affected_row_ratio), f.evidence[0].metric_name if f.evidence else None, json.dumps(clean(f.evidence[0].observed_value)) if f.evidence else None, f.evidence[0].sample_row_indices if f.evidence else []) for k, f in enumerate(self.findings)]
        return spark.createDataFrame(rows, "seq int, id string, category string, severity string, severity_rank int, title string, description string, affected_columns array<string>, affected_row_count long, affected_row_ratio double, metric_name string, observed_value string, sample_row_indices array<long>")

    def columns_df(self, spark: SparkSession) -> DataFrame:
        text = lambda v: None if v is None else str(v)
        rows = [(k, c.name, c.inferred_dtype, c.semantic_type, c.non_null_count, c.null_count, float(c.null_ratio), c.unique_count, float(c.unique_ratio), [str(v) for v in c.sample_values], c.anomalies_detected, text(c.min_value), text(c.max_value), c.mean, c.median, c.std_dev, c.memory_bytes, c.is_candidate_identifier, c.is_constant_or_near_constant) for k, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, "ordinal int, name string, inferred_dtype string, semantic_type string, non_null_count long, null_count long, null_ratio double, unique_count long, unique_ratio double, sample_values array<string>, anomalies_detected int, min_value string, max_value string, mean double, median double, std_dev double, memory_bytes long, is_candidate_identifier boolean, is_constant_or_near_constant boolean")

    def penalties_df(self, spark: SparkSession) -> DataFrame:
        rows = [(k, p.finding_id, p.category, float(p.deduction), p.reason) for k, p in enumerate(self.trust_score.penalties)]
        return spark.createDataFrame(rows, "seq int, finding_id string, category string, deduction double, reason string")
