"""Profile of every column: one global aggregate, one value-frequency shuffle and two bounded selections."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import names as N
from ..functions import vocab as V
from .frame import ROW_ID, Frame, col, number, one_of, quoted
from .model import ColumnProfile, Summary, clean_cell
from .quantiles import quantiles

BATCH = 90  # aggregates in one query; more would not compile into one method
WIDE = 64
FIRST_VALUES, FIRST_ROWS = 200, 20
QUARTILES = (0.25, 0.5, 0.75)


def in_batches(df: DataFrame, aggregates: dict[str, Column], size: int = BATCH) -> dict:
    """All aggregates of ``df``, a query for each ``size`` of them."""
    out: dict = {}
    items = list(aggregates.items())
    for lo in range(0, len(items), size):
        part = items[lo : lo + size]
        row = df.agg(*[c.alias(f"_{i}") for i, (_, c) in enumerate(part)]).first()
        out.update({k: row[i] for i, (k, _) in enumerate(part)})
    return out


def numeric_stats(frame: Frame, stats: dict, names: list[str] | None = None, lists: dict[str, list] | None = None) -> dict:
    """Aggregates of the finite values of each number column, as {(statistic, column): value}.

    A table of up to ``WIDE`` number columns is aggregated column by column in one
    scan; a wider one as rows (column, value), so that the plan does not grow with
    the columns. ``lists`` has a value for each column, which a statistic reaches as
    its further arguments.
    """
    names = frame.numeric() if names is None else names
    lists = lists or {}
    if len(names) <= WIDE:
        aggs = {("rows", ""): F.count(F.lit(1))}
        for j, c in enumerate(names):
            x = number(frame, c)
            for s, f in stats.items():
                aggs[s, c] = f(F.when(X.finite(x), x), *[F.lit(v[j]) for v in lists.values()])
        return in_batches(frame.df, aggs)
    out: dict = {}
    for whole in (True, False):  # long integers stay exact
        part = [(j, c) for j, c in enumerate(names) if (frame.kinds[c] != "float64") == whole]
        if not part:
            continue
        kind = "long" if whole else "double"
        pairs = F.expr("array(" + ", ".join(f"named_struct('j', {j}, 'x', CAST({quoted(c)} AS {kind}))" for j, c in part) + ")")
        rows = frame.df.select(F.explode(pairs).alias("p")).select("p.*")
        x = F.when(X.finite(F.col("x")), F.col("x"))
        more = [F.expr("get(array(" + ", ".join(f"double('{float(y)!r}')" for y in v) + "), j)") for v in lists.values()]
        for r in rows.groupBy("j").agg(*[f(x, *more).alias(s) for s, f in stats.items()]).collect():
            out.update({(s, names[r.j]): r[s] for s in stats})
    return {(s, c): out.get((s, c)) for c in names for s in stats}


def as_text(frame: Frame, name: str) -> Column:
    return col(name).cast("string")


def unpivoted(frame: Frame, names: list[str]) -> DataFrame:
    """(_row_id, k, value): a row for each value that is not null, k being the column's place in ``names``."""
    pairs = F.expr("array(" + ", ".join(f"named_struct('k', {k}, 'value', CAST({quoted(c)} AS STRING))" for k, c in enumerate(names)) + ")")
    return frame.df.select(ROW_ID, F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).select(ROW_ID, "p.k", "p.value")


def frequencies(frame: Frame, names: list[str] | None = None) -> DataFrame:
    """(k, value, x, n, first_row): how often each distinct value occurs, and where first; ``x`` is it as a number.

    The only shuffle by value: it gives distinct counts, first values, sentinels,
    formats and collisions, and its map side has combined the frequent values.
    Numbers, booleans and times are grouped as what they are and written as text
    once a distinct value, not once a row.
    """
    names = frame.columns if names is None else names
    kinds = [frame.kinds[c] for c in names]

    def key(k: int, name: str) -> str:
        slot = {"int64": ("i", "{}"), "bool": ("i", "CAST({} AS BIGINT)"), "datetime64[ns]": ("i", "unix_micros({})"), "float64": ("d", "{}")}.get(kinds[k], ("s", "CAST({} AS STRING)"))
        own = {"i": "CAST(NULL AS BIGINT)", "d": "CAST(NULL AS DOUBLE)", "s": "CAST(NULL AS STRING)"} | {slot[0]: slot[1].format(quoted(name))}
        return f"named_struct('k', {k}, 'i', {own['i']}, 'd', {own['d']}, 's', {own['s']})"

    some = F.expr("filter(array(" + ", ".join(key(k, c) for k, c in enumerate(names)) + "), p -> p.i IS NOT NULL OR p.d IS NOT NULL OR p.s IS NOT NULL)")
    rows = frame.df.select(ROW_ID, F.explode(some).alias("p")).select(ROW_ID, "p.*")
    counted = rows.groupBy("k", "i", "d", "s").agg(F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("first_row"))
    of = lambda kind: one_of("k", [k for k, x in enumerate(kinds) if x == kind])
    value = F.when(of("bool"), F.when(F.col("i") == 1, "true").otherwise("false")).when(of("datetime64[ns]"), F.timestamp_micros("i").cast("string"))
    x = F.when(of("float64"), F.col("d")).when(of("int64") | of("bool"), F.col("i").cast("double"))
    return counted.select("k", value.otherwise(F.coalesce(F.col("s"), F.col("i").cast("string"), F.col("d").cast("string"))).alias("value"), x.alias("x"), "n", "first_row")


def first_values(freq: DataFrame, k: int) -> DataFrame:
    """The ``k`` values of each column that occur first; each task keeps ``k`` a column before the shuffle."""
    w = Window.partitionBy("k").orderBy("first_row")
    return freq.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def first_rows(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("k").orderBy(ROW_ID)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def semantic_type(name: str, kind: str, rows: int, non_null: int, unique: int, values: list[str], head: list[str], date_hits: int) -> str:
    """The first role that fits: values are the first distinct ones, head the first ones."""
    if non_null == 0:
        return "unknown"
    if unique <= 2 and all(v.lower() in V.BOOLEAN_WORDS for v in values[:2]):
        return "boolean"
    if kind == "datetime64[ns]":
        return "datetime"
    text, is_float = kind in ("str", "other"), kind == "float64"
    if text and date_hits >= min(3, len(head)) and date_hits / max(1, len(head)) > 0.6:
        return "datetime"
    length = sum(map(len, values)) / len(values) if text and values else 0.0
    spaces = sum(v.count(" ") for v in values) / len(values) if text and values else 0.0
    prose = text and (length > 60 or spaces >= 2.0)
    ratio = unique / non_null
    if not is_float and (rows - non_null) / rows <= 0.05:
        if N.is_identifier(name) and (ratio > 0.90 or unique == rows) and length <= 60:
            return "identifier"
        if rows >= 5 and unique == non_null and non_null >= 0.95 * rows and not prose:
            return "identifier"
    if kind in ("int64", "float64", "bool"):
        if is_float:
            return "numeric_continuous"
        if unique <= 10 and ratio < 0.05:
            return "categorical"
        return "numeric_continuous" if unique > 20 else "numeric_discrete"
    if length > 60 or (prose and ratio > 0.50):
        return "free_text"
    return "categorical" if ratio < 0.20 or unique <= 50 else "free_text"


def duplicate_rows(frame: Frame) -> tuple[int, DataFrame]:
    """Rows that repeat an earlier one, and the groups with repeats (n, first_row, key)."""
    cols = [col(c) for c in frame.columns]
    groups = frame.df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("first_row")).where("n > 1")
    return int(groups.agg(F.sum(F.col("n") - 1)).first()[0] or 0), groups


def profile(frame: Frame, freq: DataFrame | None = None) -> tuple[Summary, list[ColumnProfile], DataFrame, dict]:
    """Summary, profiles, the frequency table, and quartiles by column.

    An integer column with nulls counts as float, as it does for whoever loads it
    into a frame without nullable integers.
    """
    freq = frequencies(frame) if freq is None else freq
    got = numeric_stats(frame, {"finite": F.count, "min": F.min, "max": F.max, "mean": lambda c: F.avg(c.cast("double")), "std": lambda c: F.stddev_samp(c.cast("double"))})
    rows = got["rows", ""] if ("rows", "") in got else frame.df.count()
    totals = {r.k: r for r in freq.groupBy("k").agg(F.count(F.lit(1)).alias("u"), F.sum("n").alias("n"), F.sum(F.col("n") * F.octet_length("value")).alias("bytes")).collect()}
    numbers = {k: c for k, c in enumerate(frame.columns) if c in set(frame.numeric()) and got["finite", c]}
    quart = quantiles(freq.where(one_of("k", numbers) & X.finite(F.col("x"))).select(F.col("k").alias("key"), "x", "n"), QUARTILES, max(totals[k].u for k in numbers)) if numbers else {}
    quart = {c: quart.get(k) for k, c in numbers.items()}
    values: dict[int, list[str]] = {}
    for r in sorted(first_values(freq, FIRST_VALUES).collect(), key=lambda r: (r.k, r.place)):
        values.setdefault(r.k, []).append(r.value)
    head: dict[int, list[tuple[str, bool]]] = {}
    texts = [c for c in frame.columns if frame.kinds[c] in ("str", "other")]
    if texts:
        shaped = F.coalesce(F.col("value").rlike(V.DATE_SHAPE), F.lit(False))
        for r in sorted(first_rows(unpivoted(frame, texts), FIRST_ROWS).withColumn("hit", shaped).collect(), key=lambda r: (r.k, r.place)):
            head.setdefault(frame.columns.index(texts[r.k]), []).append((r.value, r.hit))
    out = []
    for k, c in enumerate(frame.columns):
        non_null, u = (int(totals[k].n), int(totals[k].u)) if k in totals else (0, 0)
        kind = frame.kinds[c]
        if kind == "int64" and non_null < rows:
            kind = "float64"
        if kind == "bool" and non_null < rows:
            kind = "str"
        first = head.get(k, [])
        sem = semantic_type(c, kind, rows, non_null, u, values.get(k, []), [v for v, _ in first], sum(h for _, h in first))
        ratio, nulls = u / non_null if non_null else 0.0, rows - non_null
        null_ratio = nulls / rows if rows else 0.0
        p = ColumnProfile(c, kind if kind != "other" else "object", sem, non_null, nulls, round(null_ratio, 4), u, round(ratio, 4))
        p.sample_values = [clean_cell(_typed(v, frame.kinds[c], kind)) for v in values.get(k, [])[:5]]
        width = {"bool": 1, "str": None, "other": None}.get(frame.kinds[c], 8)
        p.memory_bytes = int(totals[k].bytes if width is None else width * non_null) if k in totals else 0
        p.is_candidate_identifier = bool((u == rows and rows > 1 and nulls == 0 and kind != "float64" and sem != "free_text") or (sem == "identifier" and ratio > 0.95 and null_ratio <= 0.05))
        p.is_constant_or_near_constant = non_null > 0 and u <= 1
        if c in frame.numeric() and got["finite", c]:
            p.finite_count = int(got["finite", c])
            p.min_value, p.max_value = clean_cell(got["min", c]), clean_cell(got["max", c])
            if kind == "float64":
                p.min_value, p.max_value = float(p.min_value), float(p.max_value)
            p.mean, p.median = round(got["mean", c], 4), round(quart[c][1], 4)
            p.std_dev = None if got["std", c] is None else round(got["std", c], 4)
        out.append(p)
    # One column with all values different means that no row repeats.
    dups = 0 if rows == 0 or any(p.unique_count == rows and p.null_count == 0 for p in out) else duplicate_rows(frame)[0]
    cells, missing = rows * len(out), sum(p.null_count for p in out)
    summary = Summary(cells, missing, round(missing / cells, 6) if cells else 0.0, dups, round(dups / rows, 6) if rows else 0.0, sum(p.memory_bytes or 0 for p in out))
    return summary, out, freq, {c: quart.get(c) for c in frame.numeric()} | {"rows": rows}


def _typed(v: str, source: str, kind: str):
    """A text of the frequency table as the value it stands for."""
    if kind == "float64":
        return float(v)
    if source == "int64":
        return int(v)
    return v == "true" if source == "bool" else v


def walk_pairs(names: list) -> Iterator[tuple]:
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            yield a, b
