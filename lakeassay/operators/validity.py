"""Numbers that turn into text, dates in several forms, and categories in several spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import names as N
from ..functions import vocab as V
from ..plans.context import Context, Evidence, col, finding
from ..plans.frame import one_of

NAME = "validity"


def find(ctx: Context) -> list:
    spelled = _spellings(ctx)
    out = []
    for p in ctx.texts():
        if p.non_null_count < 3:
            continue
        out += [*_drift(ctx, p), *_date_forms(ctx, p), *spelled.get(p.name, [])]
    return out


def _drift(ctx: Context, p) -> list:
    numbers = ctx.text_stats[p.name]["number"]
    if not 0.60 <= numbers / p.non_null_count < 1.0:
        return []
    n = p.non_null_count - numbers
    odd = lambda c: c.isNotNull() & X.to_number(c).isNull()
    at, _ = ctx.examples(odd(col(p.name)))
    values = ctx.first_distinct(p.name, odd(F.col("value")))
    return [finding(f"FND-VAL-TYPEDRIFT-{p.name}", NAME, "high", f"{p.name} is numeric but for {n} cells", f"Cells such as {', '.join(values)} make a column of numbers a column of text.", [p.name], n, n / ctx.rows, Evidence("non_numeric_contaminants", n, 0, at, values), f"Repair or clear these cells and store {p.name} as a number.")]


def _date_forms(ctx: Context, p) -> list:
    if not (N.has_any(p.name, V.DATE_NAMES) or p.semantic_type == "datetime"):
        return []
    forms = {f: ctx.text_stats[p.name][f] for f, _ in V.DATE_PATTERNS if ctx.text_stats[p.name][f]}
    matched = sum(forms.values())
    mixed = len(forms) > 1 or (len(forms) == 1 and matched < p.non_null_count)
    if not mixed or not (matched >= 2 or matched / p.non_null_count >= 0.20):
        return []
    main = max(forms, key=forms.get)  # the first pattern of those that are equally frequent
    n = p.non_null_count - forms[main]
    if n <= 0 or n / p.non_null_count < 0.02:
        return []
    odd = lambda c: c.isNotNull() & ~F.coalesce(X.date_class(c) == main, F.lit(False))
    at, _ = ctx.examples(odd(col(p.name)))
    values = list(dict.fromkeys(v.strip() for v in ctx.first_distinct(p.name, odd(F.col("value")), 10)))[:5]
    return [finding(f"FND-VAL-DATE-FORMAT-{p.name}", NAME, "medium", f"{p.name} writes dates in more than one form", f"{forms[main]} dates are {main}, {n} cells are not, such as {', '.join(values)}; day and month may be swapped in reading.", [p.name], n, n / ctx.rows, Evidence("format_breakdown", forms, f"100% {main}", at, values), f"Write every date of {p.name} as YYYY-MM-DD.")]


def _spellings(ctx: Context) -> dict[str, list]:
    names = [p.name for p in ctx.texts() if 1 < p.unique_count <= 50 and p.non_null_count >= 3]
    keys = {ctx.frame.columns.index(c): c for c in names}
    if not keys:
        return {}
    # Columns of 50 distinct values at most.
    values: dict[str, list] = {}
    for r in ctx.freq.where(one_of("k", keys)).orderBy("k", "first_row").collect():
        values.setdefault(keys[r.k], []).append((r.value, r.n))
    out = {}
    for c, found in values.items():
        groups: dict[str, set[str]] = {}
        for v, _ in found:
            groups.setdefault(v.strip().lower(), set()).add(v.strip())
        clash = [sorted(g) for g in groups.values() if len(g) > 1]
        if not clash:
            continue
        flat = [v for g in clash for v in g]
        n = sum(k for v, k in found if v in flat)
        at = []
        for g in clash:  # group by group, as the groups are listed
            at += ctx.examples(col(c).isin(*g))[0]
            if len(at) >= 10:
                break
        out[c] = [finding(f"FND-VAL-CAT-CASING-{c}", NAME, "medium", f"{c} spells categories in more than one way", f"{'; '.join(' / '.join(g) for g in clash)}: grouping by {c} splits what belongs together.", [c], n, n / ctx.rows, Evidence("conflicting_category_variants", clash, "one spelling each", at[:10], flat[:8]), f"Choose one spelling for each category of {c}.")]
    return out
