"""Missing cells, values that stand for missing ones, and columns that miss together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import names as N
from ..functions import vocab as V
from ..plans.context import Context, Evidence, col, finding
from ..plans.profile import in_batches, walk_pairs
from ..plans.quantiles import quantiles

NAME = "completeness"


def is_missing(ctx: Context, name: str) -> Column:
    c = col(name)
    return (c.isNull() | X.is_blank(c)) if ctx.frame.kinds[name] == "str" else c.isNull()


def missing_severity(name: str, is_key: bool, ratio: float) -> str:
    if is_key:
        return "critical" if ratio > 0.05 else "high"
    if N.is_lifecycle(name):
        return "info" if ratio >= 0.50 else "low"
    return "high" if ratio >= 0.50 else "medium" if ratio >= 0.20 else "low"


def suspicious(sentinel: int, share_not_negative: float, q25: float, q75: float) -> bool:
    """A negative code among values that are hardly ever negative, else one far outside the quartiles of the rest."""
    iqr = q75 - q25
    if sentinel < 0 and share_not_negative > 0.95:
        return True
    return iqr > 0 and not q25 - 3 * iqr <= sentinel <= q75 + 3 * iqr


def others(freq: DataFrame, codes: list[tuple[int, int]]) -> DataFrame:
    """(key, x, n): the finite values of a column other than a code; ``key`` numbers the (column, code) pairs."""
    some = freq.sparkSession.createDataFrame([(i, k, float(s)) for i, (k, s) in enumerate(codes)], "key int, k int, code double")  # six a column at most
    return freq.where(X.finite(F.col("x"))).join(F.broadcast(some), "k").where("x <> code").select("key", "x", "n")


def find(ctx: Context) -> list:
    if not ctx.rows:
        return []
    missing = {p.name: p.null_count + (ctx.text_stats[p.name]["blank"] if p.name in ctx.text_stats else 0) for p in ctx.profiles}
    numeric: dict[str, list] = {}
    for f in _numeric_sentinels(ctx):
        numeric.setdefault(f.affected_columns[0], []).append(f)
    out = []
    for p in ctx.profiles:
        n, ratio = missing[p.name], missing[p.name] / ctx.rows
        if n and ratio >= 0.05:
            severity = missing_severity(p.name, p.is_candidate_identifier, ratio)
            at, values = ctx.examples(is_missing(ctx, p.name), col(p.name).isNull())
            marks = list(dict.fromkeys("<NULL>" if v else "<WHITESPACE>" for v in values))
            out.append(finding(f"FND-CMP-MISS-{p.name}", NAME, severity, f"{n} cells of {p.name} are empty", f"{ratio:.1%} of the rows have no value in {p.name}; statistics over it describe the rest only.", [p.name], n, ratio, Evidence("missing_ratio", round(ratio, 4), "< 0.05", at, marks), f"Find out why {p.name} is empty before filling or dropping it."))
        hits = ctx.text_stats[p.name]["sentinel"] if p.name in ctx.text_stats else 0
        if hits:
            at, _ = ctx.examples(X.is_text_sentinel(col(p.name)))
            words = ctx.first_distinct(p.name, X.is_text_sentinel(F.col("value")))
            severity = "high" if hits / ctx.rows >= 0.10 else "medium"
            out.append(finding(f"FND-CMP-SENT-TXT-{p.name}", NAME, severity, f"{p.name} writes missing values as text", f"{hits} rows hold a word for nothing, such as {', '.join(words)}; it passes for a category.", [p.name], hits, hits / ctx.rows, Evidence("disguised_text_token_count", hits, 0, at, words), f"Replace these words in {p.name} with null."))
        out += numeric.get(p.name, [])
    return out + _co_missing(ctx, missing)


def _numeric_sentinels(ctx: Context) -> list:
    names = [c for c in ctx.frame.numeric() if ctx.frame.kinds[c] != "bool" and ctx.by_name[c].finite_count >= 10]
    # Distinct values tell which codes occur; a code is written with a point if the column is a float.
    codes = {str(s): s for s in V.NUMERIC_SENTINELS} | {f"{s}.0": s for s in V.NUMERIC_SENTINELS}
    seen = {(ctx.frame.columns[r.k], codes[r.value]): r.n for r in ctx.freq.where(F.col("value").isin(*codes)).select("k", "value", "n").collect()}
    hits = {(c, s): seen.get((c, s), 0) for c in names for s in V.NUMERIC_SENTINELS}
    found = [k for k, n in hits.items() if n and ctx.by_name[k[0]].finite_count - n >= 5]
    if not found:
        return []
    rest = others(ctx.freq, [(ctx.frame.columns.index(c), s) for c, s in found])
    q = quantiles(rest, (0.25, 0.75), max(ctx.by_name[c].unique_count for c, _ in found))
    got = {r.key: r for r in rest.groupBy("key").agg((F.sum(F.when(F.col("x") >= 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    out = []
    for k, (c, s) in enumerate(found):
        if not suspicious(s, got[k].share, *q[k]):
            continue
        n, ratio = hits[c, s], hits[c, s] / ctx.rows
        at, _ = ctx.examples(col(c) == s)
        span = f"[{got[k].lo}, {got[k].hi}]"
        out.append(finding(f"FND-CMP-SENT-NUM-{c}-{s}", NAME, "high" if ratio > 0.05 else "medium", f"{s} in {c} looks like a code for missing", f"{s} occurs {n} times while all else in {c} lies in {span}; as a number it distorts every mean.", [c], n, ratio, Evidence("numeric_sentinel_outlier", s, span, at, [s]), f"Turn {s} in {c} into null."))
    return out


def _co_missing(ctx: Context, missing: dict[str, int]) -> list:
    least = max(3, int(0.05 * ctx.rows))
    names = [c for c, n in missing.items() if n >= least]
    masks = {c: is_missing(ctx, c) for c in names}
    # The smaller count bounds the overlap, so unlike counts cannot reach the similarity.
    pairs = [(a, b) for a, b in walk_pairs(names) if min(missing[a], missing[b]) >= 0.90 * max(missing[a], missing[b])]
    both = in_batches(ctx.df, {p: F.count(F.when(masks[p[0]] & masks[p[1]], 1)) for p in pairs})
    out = []
    for a, b in pairs:
        n, union = both[a, b], missing[a] + missing[b] - both[a, b]
        if n >= 5 and n / union >= 0.90:
            at, _ = ctx.examples(masks[a] & masks[b])
            out.append(finding(f"FND-CMP-COMISS-{a}-{b}", NAME, "medium", f"{a} and {b} are empty in the same rows", f"{n} rows miss both, {n / union:.0%} of the rows that miss either; one cause lies behind both.", [a, b], n, n / ctx.rows, Evidence("missingness_jaccard_similarity", round(n / union, 4), "< 0.90", at), f"Treat {a} and {b} together when filling gaps."))
    return out
