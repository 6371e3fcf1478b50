"""Repeated rows, colliding or empty keys, and keys of two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import vocab as V
from ..plans.context import ROW_ID, Context, Evidence, col, finding
from ..plans.profile import as_text, duplicate_rows

NAME = "uniqueness"


def is_foreign_key(name: str, ratio: float, rows: int, collisions: int, best_ratio: float, intact: bool) -> bool:
    """Whether repeats are to be expected: a role of another entity, or too many for a key."""
    if N.has_any(name, V.FOREIGN_ROLES) and best_ratio > ratio:
        return True
    if ratio < 0.80 and (rows >= 5 or collisions > 1 or best_ratio > ratio):
        return True
    return intact and ratio < 0.95


def find(ctx: Context) -> list:
    if ctx.rows <= 1:
        return []
    return [*_repeated_rows(ctx), *_keys(ctx), *_pair_key(ctx)]


def _repeated_rows(ctx: Context) -> list:
    if any(p.unique_count == ctx.rows and p.null_count == 0 for p in ctx.profiles):
        return []
    n, groups = duplicate_rows(ctx.frame)
    if not n:
        return []
    # The first ten rows of repeated groups belong to the ten groups that begin first.
    first = groups.orderBy("first_row").limit(10)
    same = None
    for k, c in enumerate(ctx.frame.columns):
        test = col(c).eqNullSafe(F.col(f"g{k}"))
        same = test if same is None else same & test
    keys = first.select(*[col(c).alias(f"g{k}") for k, c in enumerate(ctx.frame.columns)])
    rows = ctx.df.join(F.broadcast(keys), same, "left_semi").orderBy(ROW_ID).limit(10)  # ten rows are broadcast
    got = rows.select(ROW_ID, *[F.substring(as_text(ctx.frame, c), 1, 40).alias(f"v{k}") for k, c in enumerate(ctx.frame.columns[:25])]).collect()
    ratio = n / ctx.rows
    severity = "critical" if ratio >= 0.10 else "high" if ratio >= 0.02 else "medium"
    shown = [dict(zip(ctx.frame.columns[:25], r[1:], strict=True)) for r in got[:3]]
    return [finding("FND-UNQ-EXACT-DUPS", NAME, severity, f"{n} rows repeat an earlier row", f"{ratio:.1%} of the rows equal an earlier one in every column; counts and sums include them twice.", ctx.frame.columns[:50], n, ratio, Evidence("exact_duplicate_rows", n, 0, [r[0] for r in got], shown), "Remove the repeats, or find what tells them apart.")]


def _rows_of(ctx: Context, name: str) -> DataFrame:
    """Row ids whose value in ``name`` occurs more than once."""
    again = ctx.values_of(name).where("n > 1").select(F.col("value").alias("v"))
    return ctx.df.select(ROW_ID, as_text(ctx.frame, name).alias("v")).join(again, "v", "left_semi").select(ROW_ID)


def _keys(ctx: Context) -> list:
    named = {p.name: (p.unique_count / p.non_null_count if p.non_null_count else 0.0) for p in ctx.profiles if N.is_identifier(p.name)}
    intact = any(p.name in named and p.unique_count == ctx.rows and p.null_count == 0 for p in ctx.profiles)
    best = max(named.values(), default=0.0)
    out, earlier = [], []
    for p in ctx.profiles:
        if p.name not in named and not (p.is_candidate_identifier and p.unique_count == ctx.rows):
            continue
        ratio = p.unique_count / p.non_null_count if p.non_null_count else 0.0
        n = p.non_null_count - p.unique_count
        if is_foreign_key(p.name, ratio, ctx.rows, n, best, intact):
            continue
        if n > 0:
            mine = _rows_of(ctx, p.name)
            if any(not mine.join(_rows_of(ctx, e), ROW_ID, "left_anti").limit(1).count() for e in earlier):
                continue  # an earlier key's collisions are on the same rows
            earlier.append(p.name)
            at = [r[0] for r in mine.orderBy(ROW_ID).limit(10).collect()]
            values = ctx.first_distinct(p.name, F.col("n") > 1)
            out.append(finding(f"FND-UNQ-PK-COLLISION-{p.name}", NAME, "critical", f"Key {p.name} is not unique", f"{n} rows reuse a key, such as {', '.join(values)}; joins on {p.name} will multiply rows.", [p.name], n, n / ctx.rows, Evidence("identifier_collision_count", n, 0, at, values), f"Decide which row each repeated {p.name} belongs to."))
        if p.null_count and p.name in named:
            at, _ = ctx.examples(col(p.name).isNull())
            share = p.null_count / ctx.rows
            out.append(finding(f"FND-UNQ-PK-NULL-{p.name}", NAME, "critical" if share > 0.05 else "high", f"Key {p.name} is empty in {p.null_count} rows", "Rows without a key cannot be joined or traced.", [p.name], p.null_count, share, Evidence("identifier_null_count", p.null_count, 0, at, ["<NULL>"]), f"Give these rows a {p.name}.", "high"))
    return out


def _pair_key(ctx: Context) -> list:
    full = [p for p in ctx.profiles if p.null_count == 0]
    if any(p.unique_count == ctx.rows for p in full) or len(ctx.profiles) < 2 or ctx.rows < 10:
        return []
    some = [p for p in full if 5 < p.unique_count < ctx.rows]
    for i, a in enumerate(some[:5]):
        for b in some[i + 1 : 6]:
            if a.unique_count * b.unique_count >= ctx.rows and ctx.df.select(col(a.name), col(b.name)).distinct().count() == ctx.rows:
                return [finding(f"FND-UNQ-COMPOSITE-{a.name}-{b.name}", NAME, "info", f"{a.name} with {b.name} identifies a row", f"No single column is a key; the two together differ in all {ctx.rows} rows.", [a.name, b.name], 0, 0.0, Evidence("composite_cardinality", ctx.rows, ctx.rows), f"Use {a.name} and {b.name} as the key.")]
    return []


