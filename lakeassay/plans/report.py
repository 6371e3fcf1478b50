"""The dossier as Markdown, and its one-screen summary."""

from __future__ import annotations

from ..functions import vocab as V


def size(n: int) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024 or unit == "GiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return ""


def _cell(x) -> str:
    return "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(_cell, r)) + " |" for r in rows)]


def _figure(x: float | None) -> str:
    return "-" if x is None else f"{x:.2f}"


def markdown(d, target: str | None = None) -> str:
    s, m, t = d.summary, d.metadata, d.trust_score
    counts = {v: sum(f.severity == v for f in d.findings) for v in V.SEVERITIES}
    out = ["# Data integrity dossier", "", "## 1. Verdict", "", f"**{t.overall_score:.1f} of 100, grade {t.grade}, {t.verdict}.** {t.rationale}", ""]
    out += ["## 2. Table", ""] + _table(["Property", "Value"], [["File", m["file_name"]], ["Type", m["file_type"]], ["Size", size(m["file_size_bytes"])], ["Rows", f"{m['row_count']:,}"], ["Columns", m["column_count"]], ["Target", target or "none"], ["Analysed", m["analyzed_at"]]]) + [""]
    out += ["## 3. Shape", ""] + _table(["Cells", "Empty cells", "Share", "Repeated rows", "Share "], [[f"{s.total_cells:,}", f"{s.missing_cells:,}", f"{s.missing_cell_ratio:.2%}", f"{s.duplicate_rows:,}", f"{s.duplicate_row_ratio:.2%}"]]) + [""]
    out += ["## 4. Findings by severity", ""] + _table(["Severity", "Findings"], [[k, n] for k, n in counts.items()]) + [""]
    out += ["## 5. Deductions", ""] + (_table(["Finding", "Category", "Points", "Reason"], [[p.finding_id, p.category, f"-{p.deduction:.2f}", p.reason] for p in t.penalties]) if t.penalties else ["None."]) + [""]
    out += ["## 6. Findings", ""]
    for f in d.findings:
        out += [f"### {f.title}", "", f"`{f.id}`, {f.severity}, {f.category}; columns {', '.join(f.affected_columns)}; {f.affected_row_count:,} rows ({f.affected_row_ratio:.2%}).", "", f.description, ""]
        for e in f.evidence:
            out += [f"- {e.metric_name}: {_cell(e.observed_value)} (expected {_cell(e.threshold_or_expected)})"]
            out += [f"- rows: {', '.join(map(str, e.sample_row_indices))}"] if e.sample_row_indices else []
        out += [""]
    out += [] if d.findings else ["None.", ""]
    out += ["## 7. Columns", ""] + _table(["Column", "Type", "Role", "Nulls", "Distinct", "Mean", "Median", "Deviation", "Range", "Findings"], [[c.name, c.inferred_dtype, c.semantic_type, f"{c.null_ratio:.1%}", f"{c.unique_count} ({c.unique_ratio:.1%})", _figure(c.mean), _figure(c.median), _figure(c.std_dev), "-" if c.min_value is None or c.max_value is None else f"{c.min_value} to {c.max_value}", c.anomalies_detected] for c in d.columns]) + [""]
    out += ["## 8. What to do", ""] + ([f"{k}. [{r.priority}] {r.action} {r.reason}" for k, r in enumerate(d.recommendations, 1)] or ["Nothing."]) + [""]
    out += ["## 9. How this was made", "", f"Engine {m['engine_version']}; fixed rules over exact counts; the same table gives the same result."]
    return "\n".join(out) + "\n"


def summary(d) -> str:
    counts = ", ".join(f"{n} {v}" for v in V.SEVERITIES if (n := sum(f.severity == v for f in d.findings)))
    m, t = d.metadata, d.trust_score
    return f"{m['file_name']}: {m['row_count']:,} rows, {m['column_count']} columns\nscore {t.overall_score:.1f}, grade {t.grade}, {t.verdict}\nfindings: {len(d.findings)}{f' ({counts})' if counts else ''}\n"
