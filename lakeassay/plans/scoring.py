"""From findings to a score: a fold in the findings' order, on the driver."""

from __future__ import annotations

from ..functions import vocab as V
from .model import Finding, Penalty, TrustScore

RATIONALE = {
    "A+": "Hardly anything speaks against using this table.",
    "A": "The table is in good order; what was found is minor.",
    "B": "The table is usable; a few problems should be mended.",
    "C": "The table has problems that should be mended before it feeds reports or models.",
    "D": "The table has many or grave problems; results from it would be doubtful.",
    "F": "The table is not fit for use until its problems are mended.",
}


def severity_share(severity: str, ratio: float) -> float:
    """The raw deduction of a finding; criticals do not scale with the rows affected."""
    base = V.BASE_PENALTY.get(severity, 0.0)
    return round(base if severity == "critical" or ratio <= 0 else base * (0.60 + 0.40 * min(1.0, ratio * 2.0)), 2)


def grade(score: float) -> tuple[str, str]:
    return next((g, v) for least, g, v in V.GRADES if score >= least)


def trust_score(findings: list[Finding]) -> TrustScore:
    """Every affected column is charged; none beyond the cap, which bounds what a finding can take."""
    charged: dict[str, float] = {}
    penalties, total = [], 0.0
    for f in findings:
        raw = severity_share(f.severity, f.affected_row_ratio)
        if raw <= 0:
            continue
        taken = min([raw, *(max(0.0, V.COLUMN_CAP - charged.get(c, 0.0)) for c in f.affected_columns)])
        for c in f.affected_columns:
            charged[c] = charged.get(c, 0.0) + taken
        if taken > 0.1:
            total += taken
            penalties.append(Penalty(f.id, f.category, round(taken, 2), f"{f.title} [{f.severity}]"))
    score = round(max(0.0, min(100.0, 100.0 - total)), 1)
    letter, verdict = grade(score)
    return TrustScore(score, verdict, letter, round(total, 2), penalties, RATIONALE[letter])
