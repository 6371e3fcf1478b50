"""Ends before starts, negative amounts of things, and minima above maxima."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import names as N
from ..functions import vocab as V
from ..plans.context import Context, Evidence, col, finding
from ..plans.frame import number
from ..plans.profile import as_text, first_rows, in_batches, unpivoted

NAME = "consistency"


def day(c: Column) -> Column:
    return F.date_trunc("DAY", c)


def inverted(start: Column, end: Column, start_has_time: bool, end_has_time: bool) -> Column:
    """Whether the end comes first; an end that is a mere day is compared with the start's day."""
    return end < (day(start) if start_has_time and not end_has_time else start)


def find(ctx: Context) -> list:
    if not ctx.rows:
        return []
    return [*_inversions(ctx), *_negatives(ctx), *_bounds(ctx)]


def date_like(ctx: Context) -> list[str]:
    kinds = ctx.frame.kinds
    some = [p.name for p in ctx.profiles if kinds[p.name] in ("str", "datetime64[ns]") and p.semantic_type not in ("identifier", "boolean") and (p.semantic_type == "datetime" or N.has_any(p.name, V.TEMPORAL_NAMES))]
    texts = [c for c in some if kinds[c] == "str"]
    parsed = set()
    if texts:
        head = first_rows(unpivoted(ctx.frame, texts), 10)
        parsed = {texts[r.k] for r in head.where(X.parse_datetime(F.col("value")).isNotNull()).select("k").distinct().collect()}
    return [c for c in some if c in parsed or (kinds[c] != "str" and ctx.by_name[c].non_null_count)]


def date_pairs(names: list[str]) -> list[tuple[str, str, str]]:
    """Each (start, end, rule) once, in the rules' order."""
    out: dict[tuple[str, str], str] = {}
    for starts, ends, rule in V.TEMPORAL_PAIRS:
        for a in (c for c in names if N.has_any(c, starts)):
            for b in (c for c in names if N.has_any(c, ends)):
                if a != b:
                    out.setdefault((a, b), rule)
    return [(a, b, rule) for (a, b), rule in out.items()]


def _inversions(ctx: Context) -> list:
    pairs = date_pairs(date_like(ctx))
    if not pairs:
        return []
    used = list(dict.fromkeys(c for a, b, _ in pairs for c in (a, b)))
    at = {c: F.col(f"_t{k}") for k, c in enumerate(used)}
    # Parsed once, whatever the number of pairs.
    times = ctx.df.select(*[X.as_instant(col(c), ctx.frame.kinds[c]).alias(f"_t{k}") for k, c in enumerate(used)])
    both = {(a, b): at[a].isNotNull() & at[b].isNotNull() for a, b, _ in pairs}
    clock = in_batches(times, {(a, b, c): F.bool_or(both[a, b] & (day(at[c]) != at[c])) for a, b, _ in pairs for c in (a, b)})
    test = {(a, b): inverted(at[a], at[b], bool(clock[a, b, a]), bool(clock[a, b, b])) for a, b, _ in pairs}
    counts = in_batches(times, {k: F.count(F.when(v, 1)) for k, v in test.items()})
    out = []
    for a, b, rule in pairs:
        n = counts[a, b]
        if not n:
            continue
        real = {c: X.as_instant(col(c), ctx.frame.kinds[c]) for c in (a, b)}
        rows, values = ctx.examples(inverted(real[a], real[b], bool(clock[a, b, a]), bool(clock[a, b, b])), as_text(ctx.frame, a), as_text(ctx.frame, b))
        out.append(finding(f"FND-CNS-TEMP-{a}-{b}", NAME, "critical", f"{b} lies before {a} in {n} rows", f"By the names, {rule}; {n} rows say otherwise, and durations from them are negative.", [a, b], n, n / ctx.rows, Evidence("chronological_inversion_count", n, 0, rows, [{a: v[0], b: v[1]} for v in values[:5]]), f"Correct {a} or {b} in these rows."))
    return out


def as_number(ctx: Context, name: str) -> Column:
    kind = ctx.frame.kinds[name]
    return X.to_number(col(name)) if kind == "str" else number(ctx.frame, name).cast("double") if kind != "datetime64[ns]" else F.lit(None).cast("double")


def _negatives(ctx: Context) -> list:
    names = [c for c in ctx.frame.columns if N.has_any(c, V.NON_NEGATIVE) and ctx.frame.kinds[c] in ("str", "int64", "float64")]
    counts = in_batches(ctx.df, {c: F.count(F.when(as_number(ctx, c) < 0, 1)) for c in names})
    out = []
    for c in names:
        if n := counts[c]:
            at, values = ctx.examples(as_number(ctx, c) < 0, as_number(ctx, c))
            values = [v for v in values if v != float("-inf")][:5]
            out.append(finding(f"FND-CNS-NEG-{c}", NAME, "high", f"{c} is negative in {n} rows", "By its name it counts or measures something that cannot be less than nothing.", [c], n, n / ctx.rows, Evidence("negative_count_violation", n, 0, at, values), f"Find out what negative values of {c} stand for."))
    return out


def bound_pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for a in names if "min" in N.tokens(a) for b in names if a != b and "max" in N.tokens(b) and a.lower().replace("min", "") == b.lower().replace("max", "")]


def _bounds(ctx: Context) -> list:
    pairs = bound_pairs(ctx.frame.columns)
    counts = in_batches(ctx.df, {(a, b): F.count(F.when(as_number(ctx, a) > as_number(ctx, b), 1)) for a, b in pairs})
    out = []
    for a, b in pairs:
        if n := counts[a, b]:
            at, _ = ctx.examples(as_number(ctx, a) > as_number(ctx, b))
            out.append(finding(f"FND-CNS-BOUND-{a}-{b}", NAME, "high", f"{a} exceeds {b} in {n} rows", "A lower bound above its upper bound leaves no range.", [a, b], n, n / ctx.rows, Evidence("min_gt_max_violations", n, 0, at), f"Swap or correct {a} and {b} in these rows."))
    return out
