"""Columns that give a prediction target away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.context import Context, Evidence, col, finding
from ..plans.frame import number
from ..plans.profile import in_batches

NAME = "data_leakage"


def correlation(df: DataFrame, a: Column, b: Column) -> float | None:
    """Pearson's r of two number columns, or null if either is constant (``corr`` would divide by zero)."""
    pairs = df.select(a.cast("double").alias("a"), b.cast("double").alias("b")).where(X.finite(F.col("a")) & X.finite(F.col("b")))
    return pairs.agg(pearson("a", "b")).first()[0]


def pearson(a: str | Column, b: str | Column) -> Column:
    """Of two columns that are null in the same rows."""
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def average_ranks(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(value, rank): the mean place of each distinct value among all rows; and what to unpersist once it was read.

    Distinct values are counted, dealt out by range, ranked within each part, and
    moved by the rows of the parts before; no sort ever meets in one task.
    """
    counts = df.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()).persist()
    start, at = {}, 0
    for r in sorted(ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        start[r.part], at = at, at + r.n
    offset = F.get(F.lit([start.get(k, 0) for k in range(max(start, default=0) + 1)]), F.col("part"))
    w = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.select("value", (offset + F.sum("n").over(w) - (F.col("n") - 1) / 2).alias("rank")), ranged


def spearman(df: DataFrame, a: Column, b: Column) -> float | None:
    pairs = df.select(a.cast("double").alias("a"), b.cast("double").alias("b")).where(X.finite(F.col("a")) & X.finite(F.col("b")))
    ranks = {c: average_ranks(pairs, c) for c in ("a", "b")}
    ra, rb = (r.select(F.col("value").alias(c), F.col("rank").alias(f"r{c}")) for c, (r, _) in ranks.items())
    try:
        return correlation(pairs.join(ra, "a").join(rb, "b"), F.col("ra"), F.col("rb"))
    finally:
        for _, held in ranks.values():
            held.unpersist()


def cramers_v(df: DataFrame, a: Column, b: Column) -> tuple[float | None, int, int, int]:
    """V, rows and columns of the contingency table, and pairs; from cell counts, without laying out the table."""
    cells = df.select(a.cast("string").alias("a"), b.cast("string").alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    # Summed again from the cells, so a hot value is combined before it meets in one place.
    na, nb = (cells.groupBy(c).agg(F.sum("n").alias(f"n{c}")) for c in ("a", "b"))
    got = cells.join(na, "a").join(nb, "b").agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"), F.sum("n").alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c")).first()
    if not got.n or got.r < 2 or got.c < 2:
        return None, got.r, got.c, int(got.n or 0)
    return max(0.0, (got.s - 1) / (min(got.r, got.c) - 1)) ** 0.5, got.r, got.c, int(got.n)


def same_text(ctx: Context, a: str, b: str) -> Column:
    ka, kb = ctx.by_name[a].inferred_dtype, ctx.by_name[b].inferred_dtype
    if {ka, kb} <= {"int64", "float64"}:
        return (col(a) == col(b)) if ka == kb else F.lit(False)  # 1 and 1.0 are written differently
    return X.folded(col(a).cast("string")) == X.folded(col(b).cast("string"))


def find(ctx: Context, target: str | None = None) -> list:
    if not target or target not in ctx.by_name or ctx.rows < 5:
        return []
    others = [c for c in ctx.frame.columns if c != target]
    aggs: dict = {}
    for c in others:
        pair = col(c).isNotNull() & col(target).isNotNull()
        aggs["pairs", c] = F.count(F.when(pair, 1))
        aggs["same", c] = F.count(F.when(pair & same_text(ctx, c, target), 1))
        if ctx.by_name[c].is_numeric and ctx.by_name[target].is_numeric:
            if not ctx.by_name[c].is_candidate_identifier:
                x, y = (number(ctx.frame, k).cast("double") for k in (c, target))
                both = X.finite(x) & X.finite(y)
                aggs["r", c] = pearson(F.when(both, x), F.when(both, y))
            aggs["finite", c] = F.count(F.when(X.finite(col(c).cast("double")) & X.finite(col(target).cast("double")), 1)) if "bool" not in (ctx.frame.kinds[c], ctx.frame.kinds[target]) else aggs["pairs", c]
    got = in_batches(ctx.df, aggs)
    out = []
    for c in others:
        n = got["pairs", c]
        rate = got["same", c] / n if n else 0.0
        p, t = ctx.by_name[c], ctx.by_name[target]
        if n >= 10 and rate >= 0.95:
            at, _ = ctx.examples(col(c).isNotNull() & col(target).isNotNull())
            out.append(finding(f"FND-LKG-PROXY-{c}", NAME, "critical", f"{c} equals the target in {rate:.1%} of the rows", f"A model that sees {c} has the answer at hand and will fail without it.", [c, target], int(rate * n), rate, Evidence("target_identity_ratio", round(rate, 4), "< 0.95", at), f"Take {c} out of the features."))
            continue
        if p.is_numeric and t.is_numeric:
            if got["finite", c] >= 10 and not p.is_candidate_identifier:
                x, y = number(ctx.frame, c), number(ctx.frame, target)
                r, s = got["r", c], spearman(ctx.df, x, y)
                top = max([abs(v) for v in (r, s) if v is not None], default=None)
                if top is not None and top >= 0.95:
                    severity = "critical" if top >= 0.98 else "high"
                    out.append(finding(f"FND-LKG-CORR-{c}", NAME, severity, f"{c} moves with the target (r = {top:.3f})", f"Pearson {_f(r)}, Spearman {_f(s)}: {c} may be measured after the target, or from it.", [c, target], got["finite", c], got["finite", c] / ctx.rows, Evidence("maximum_correlation_coefficient", round(top, 4), "< 0.95"), f"Make sure that {c} is known before {target}."))
        elif not p.is_numeric and not t.is_numeric and not p.is_candidate_identifier and n >= 15:
            v, r, k, n = cramers_v(ctx.df, col(c), col(target))
            if v is not None and round(v, 12) >= 0.95:
                at, _ = ctx.examples(col(c).isNotNull() & col(target).isNotNull())
                out.append(finding(f"FND-LKG-CRAMER-{c}", NAME, "high", f"{c} all but decides the target (V = {v:.3f})", f"The {r} values of {c} sort the {k} values of {target} almost without error.", [c, target], n, n / ctx.rows, Evidence("cramers_v_association", round(v, 4), "< 0.95", at), f"Check whether {c} is recorded after the outcome."))
    return out


def _f(x: float | None) -> str:
    return "undefined" if x is None else f"{x:.3f}"

