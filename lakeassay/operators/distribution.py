"""Extreme values, skew, and first digits that no natural amounts have."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import names as N
from ..plans.context import Context, Evidence, col, finding
from ..plans.frame import number
from ..plans.profile import in_batches, numeric_stats
from ..plans.quantiles import quantiles

NAME = "distribution"
BENFORD = {d: math.log10(1 + 1 / d) for d in range(1, 10)}


def bounds(q25: float, median: float, q75: float, mad: float) -> tuple[float, float]:
    """Three interquartile ranges beyond the quartiles; without a range, five median deviations (or 1) off the median."""
    iqr = q75 - q25
    if iqr > 0:
        return q25 - 3.0 * iqr, q75 + 3.0 * iqr
    off = 5.0 * mad if mad > 0 else 1.0
    return median - off, median + off


def benford_deviation(counts: dict[int, int]) -> float:
    total = sum(counts.values())
    return sum(abs(counts.get(d, 0) / total - BENFORD[d]) for d in BENFORD) / 9


def median_deviations(ctx: Context, medians: dict[str, float]) -> dict[str, float]:
    """The median distance of each column's values from its median."""
    if not medians:
        return {}
    at = {ctx.frame.columns.index(c): c for c in medians}
    some = ctx.freq.sparkSession.createDataFrame([(k, float(medians[c])) for k, c in at.items()], "k int, median double")  # a row a column
    off = ctx.freq.where(X.finite(F.col("x"))).join(F.broadcast(some), "k").select(F.col("k").alias("key"), F.abs(F.col("x") - F.col("median")).alias("x"), "n")
    return {at[k]: q[0] for k, q in quantiles(off, (0.5,), max(ctx.by_name[c].unique_count for c in medians)).items()}


def find(ctx: Context) -> list:
    if ctx.rows < 5:
        return []
    names = [c for c in ctx.frame.numeric() if ctx.by_name[c].non_null_count >= 8 and ctx.by_name[c].finite_count >= 8 and ctx.by_name[c].unique_count > 2]
    if not names:
        return []
    x = lambda c: F.when(X.finite(col(c)), number(ctx.frame, c).cast("double"))
    quart = {c: ctx.quartiles[c] for c in names}
    flat = [c for c in names if quart[c][2] <= quart[c][0]]
    mads = median_deviations(ctx, {c: quart[c][1] for c in flat})
    limit = {c: bounds(*quart[c], mads.get(c, 0.0)) for c in names}
    shape = {"out": lambda v, lo, hi: F.count(F.when((v > hi) | (v < lo), 1)), "skew": lambda v, *_: F.skewness(v.cast("double")), "kurt": lambda v, *_: F.kurtosis(v.cast("double"))}
    got = numeric_stats(ctx.frame, shape, names, {"lo": [limit[c][0] for c in names], "hi": [limit[c][1] for c in names]})
    money = [c for c in names if _benford_applies(ctx.by_name[c])]
    digits = in_batches(ctx.df, {(c, d): F.count(F.when(X.leading_digit(x(c)) == d, 1)) for c in money for d in BENFORD})
    out = []
    for c in names:
        p, n, (lo, hi), (q25, median, q75) = ctx.by_name[c], got["out", c], limit[c], quart[c]
        if n and (n / p.finite_count <= 0.10 or n <= 2):
            at, values = ctx.examples((x(c) > hi) | (x(c) < lo), x(c))
            values = [round(v, 4) for v in values[:5]]
            iqr = q75 - q25
            far = (float(p.max_value) - q75) / iqr if iqr > 0 else 0.0
            out.append(finding(f"FND-DST-OUTLIER-{c}", NAME, "high" if far > 10.0 else "medium", f"{n} extreme values in {c}", f"Values such as {values} lie outside [{lo:.2f}, {hi:.2f}] around a median of {median:.2f} and pull every mean.", [c], n, n / ctx.rows, Evidence("tukey_3x_iqr_violation", values, f"[{lo:.2f}, {hi:.2f}]", at, values, f"Quartiles {q25:.2f} and {q75:.2f}."), f"Check where the extreme values of {c} come from."))
        skew = got["skew", c]
        if n == 0 and skew is not None and abs(skew) > 4.0:
            out.append(finding(f"FND-DST-SKEW-{c}", NAME, "low", f"{c} is strongly skewed", f"Skewness {skew:.2f} and excess kurtosis {got['kurt', c] or 0:.2f}: the mean says little about a usual row.", [c], 0, 0.0, Evidence("fisher_pearson_skewness", round(skew, 3), "[-4, 4]"), f"Use ranks or logarithms of {c}."))
        if c in money:
            counts = {d: digits[c, d] for d in BENFORD}
            if sum(counts.values()) >= 40 and (mad := benford_deviation(counts)) > 0.025:
                out.append(finding(f"FND-DST-BENFORD-{c}", NAME, "medium", f"First digits of {c} are unusual; investigation is recommended", f"Amounts that span scales begin with low digits more often than these do (mean deviation {mad:.4f}). Limits, rounding or selection can cause this.", [c], 0, 0.0, Evidence("benford_mad_divergence", round(mad, 4), "<= 0.025", [], [], json_digits(counts)), f"Ask how the amounts in {c} come about."))
    return out


def _benford_applies(p) -> bool:
    lo, hi = p.min_value, p.max_value
    return p.finite_count >= 40 and not isinstance(lo, (bool, type(None))) and lo > 0 and not p.is_candidate_identifier and N.is_financial(p.name) and hi / (lo + 1e-9) >= 50


def json_digits(counts: dict[int, int]) -> str:
    return ", ".join(f"{d}: {n}" for d, n in counts.items())
