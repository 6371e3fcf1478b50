"""Mixing sources to target weights by entropy balancing.

Every document i gets the rate r_i = exp(x_i . lambda) that stays closest to 1 in
relative entropy while the expected words sum(size_i * r_i * x_i) meet the
targets. Newton's method minimises the convex dual
sum(size_i * exp(x_i . lambda)) - lambda . T; the sums behind each gradient and
Hessian are Spark aggregates, and iterations go on until every constraint is met
to ``TOLERANCE`` or an error says which was not. x_i marks the document's source
and, if the caller names a second column, its group there. Documents alike in both
share a sufficient statistic (a cell's words), so the corpus is aggregated once.

With sources alone the Hessian is diagonal, and each Newton step is a projection of
the table of sources, which never leaves the cluster. With groups, whose number the
caller bounds by naming them, the sources' multipliers are eliminated: the dual in
the groups' multipliers has a dense Hessian of that size, summed over sources in
tasks.

Rates are then rounded into whole copies by error diffusion in buckets of about 4,096
documents of one cell, so a source's words end within about one small document a
bucket of their target.

Edge cases: null or empty texts have size 0 and are taken 0 times; a null source
is a source of its own, last in order; repeated rows are separate documents; null ids
are dealt out by their texts; an empty table gives an empty table; a corpus without
words has targets 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store, text

NEWTON_STEPS = 12  # between two looks at the gap
MAX_ROUNDS = 40
TOLERANCE = 1e-9
DOCS_IN_BUCKET = 4096
MAX_RATE = 3.0
MAX_GROUPS = 256


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", also: str | None = None) -> DataFrame:
    """doc_id, source, part (the second column, if any), mark (a hash of the text) and size: words of the whole text."""

    def count(batches):
        for b in batches:
            n = [np.diff(w.first) for w in text.words(b.column(4))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.concatenate(n) if n else [], pa.int64())], ["doc_id", "source", "part", "mark", "size"])

    kind = dict(docs.select(F.col(id_col).alias("d")).dtypes)["d"]
    part = F.col(also).cast("string") if also else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), part.alias("part"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")).mapInArrow(count, f"doc_id {kind}, source string, part string, mark long, size long")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``place``, from 0 in code point order (null last): dealt out by range, then moved by the rows of the ranges before."""
    order = F.col("source").asc_nulls_last()
    ranged = store.write(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_at", 33).cast("int")
    counts = dict(ranged.groupBy(part).count().collect())  # one row a range
    start = np.cumsum([0] + [counts.get(k, 0) for k in range(max(counts, default=0) + 1)]).tolist()
    return ranged.select("*", (F.get(F.lit(start), part) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place")).drop("_at")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = MAX_RATE) -> DataFrame:
    """Adds ``target``: sources in code point order (null last) weigh ``weights`` in turn and share ``share`` of all
    words; a target stops at ``most`` times its source's words, and the excess is shared again by weight.

    A target is its weight times one level, or its stop. Each look at the sources
    takes those as stopped that the level so far stops and raises the level for the
    others; it never falls, and it stands still once no more sources stop.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = store.write(numbered(sources.select("source", "source_size", "n_docs")).withColumn("weight", w), "weights")
    stop = F.lit(most) * F.col("source_size")
    budget, open_ = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level = share * (budget or 0), None
    new = budget / open_ if open_ else 0.0
    while level is None or new > level:
        level = new
        stopped = stop <= F.lit(level) * F.col("weight")
        full, open_ = ranked.agg(F.sum(F.when(stopped, stop).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))).first()
        new = (budget - full) / open_ if open_ else level
    return ranked.select("source", "source_size", "n_docs", F.least(stop, F.lit(level) * F.col("weight")).cast("double").alias("target"))


def balance(sources: DataFrame, mass: str = "source_size", steps: int = NEWTON_STEPS, rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``rate``: exp(lambda) after Newton steps on the dual from lambda = 0, until ``mass`` * rate meets ``target``.

    Gradient: mass * exp(lambda) - T; Hessian: mass * exp(lambda). A step up is cut to
    1 so that it cannot overshoot; one down is never below -1.
    """
    some = (F.col(mass) > 0) & (F.col("target") > 0)
    out = sources.withColumn("lambda", F.lit(0.0))
    for _ in range(rounds):
        for _ in range(steps):
            g = F.col(mass) * F.exp("lambda")
            out = out.withColumn("lambda", F.when(some, F.col("lambda") + F.least(F.lit(1.0), F.try_divide(F.col("target") - g, g))).otherwise(F.lit(0.0)))
        out = store.write(out, "steps")
        gap = out.where(some).agg(F.max(F.abs(F.col(mass) * F.exp("lambda") / F.col("target") - 1))).first()[0] or 0.0
        if gap <= tolerance:
            return out.withColumn("rate", F.when(F.col("target") > 0, F.exp("lambda")).otherwise(F.lit(0.0))).drop("lambda")
    raise RuntimeError(f"Newton steps left a source {gap:.3g} off its target after {rounds * steps} steps")


def group_multipliers(cells: DataFrame, names: list[str], shares: list[float], steps: int = 60, tolerance: float = TOLERANCE) -> np.ndarray:
    """The multiplier of each group: Newton steps, halved while the dual does not fall, on
    f(mu) = sum over sources of T * log(sum over groups of words * exp(mu)) - mu . U.

    ``cells``: (source, part, words, target), target being the source's. One row a
    task, of len(names)**2 numbers and some, is gathered in each step.
    """
    k = len(names)
    at = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("part")).cast("int") - 1, F.lit(-1))
    lists = store.write(cells.where("words > 0 and target > 0").groupBy("source", "target").agg(F.collect_list(F.struct(at.alias("at"), F.col("words").cast("double").alias("words"))).alias("of")).select("target", "of.at", "of.words"), "cells")

    def look(mu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        def sums(batches):
            f, g, h, total = 0.0, np.zeros(k), np.zeros((k, k)), 0.0
            for b in batches:
                for t, at, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    mass = np.zeros(k)
                    np.add.at(mass, at, np.array(words) * np.exp(mu[at]))
                    p = mass / mass.sum()
                    f, g, total = f + t * np.log(mass.sum()), g + t * p, total + t
                    h += t * (np.diag(p) - np.outer(p, p))
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[f, total], g, h.ravel()])], pa.list_(pa.float64()))], ["sums"])

        x = np.sum([r.sums for r in lists.mapInArrow(sums, "sums array<double>").collect()], axis=0)
        want = np.array(shares) * x[1]
        return x[0] - mu @ want, x[2 : 2 + k] - want, x[2 + k :].reshape(k, k), x[1]

    mu = np.zeros(k)
    f, g, h, total = look(mu)
    for _ in range(steps):
        if np.abs(g).max() <= tolerance * max(total, 1e-9):
            return mu
        step, size = -np.linalg.pinv(h, rcond=1e-12, hermitian=True) @ g, 1.0
        while size > 1e-6:
            new = look(mu + size * step)
            if new[0] <= f + 1e-4 * size * (g @ step) or np.abs(new[1]).max() <= tolerance * total:
                break
            size /= 2
        mu, (f, g, h, total) = mu + size * step, new
    worst = int(np.abs(g).argmax())
    raise RuntimeError(f"group {names[worst]!r} stays {abs(g[worst]) / max(total, 1e-9):.3g} of all words off its share; the sources' targets cannot meet it")


def round_bucket(size: np.ndarray, rate: float, most: float) -> np.ndarray:
    """Copies of each document, sizes descending: the whole part of the rate or one more, whichever keeps the words
    taken so far nearer to the words due so far."""
    low = min(int(rate), int(most))
    copies = np.full(len(size), low, np.int64)
    if low < most:
        part, error = rate - low, 0.0
        for i, s in enumerate(size.tolist()):
            due = error + s * part
            if due > s - due:
                copies[i] += 1
                due -= s
            error = due
    return copies


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = MAX_RATE, also: str | None = None, also_share: dict[str, float] | None = None) -> DataFrame:
    """doc_id, mark (a hash of the text), source, size, source_size, target, rate, copies, taken, for every document.

    ``also`` names a second column and ``also_share`` the share of all words taken
    that some of its values are to have; other values share the rest. An error says if
    that needs a rate above ``most``. Rounding runs in buckets of about 4,096 documents
    of one source and group (a source of a third of all rows has as many buckets as it
    needs), each towards its own share of the target, in the order (size descending,
    doc_id), so reruns agree.
    """
    store.small_batches(docs.sparkSession)
    sized = store.write(word_counts(docs, id_col, text_col, source_col, also), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # One row a source, written so that neither the sums nor the steps run twice.
    aimed = store.write(targets(sources, weights, share, most), "targets")
    if also is None:
        rates = balance(aimed).withColumn("part", F.lit(None).cast("string"))
    else:
        sized, rates = _with_groups(sized, aimed, dict(also_share or {}), most)
    joined = sized.alias("d").join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & F.col("d.part").eqNullSafe(F.col("r.part"))).select("d.doc_id", "d.mark", "d.source", "d.size", "r.source_size", "r.target", "r.rate", "d.part", F.pmod(F.xxhash64("d.doc_id", "d.mark"), F.greatest(F.lit(1), F.ceil(F.col("r.n_docs") / DOCS_IN_BUCKET))).alias("bucket"))

    def rounded(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending")])
        size = table["size"].to_numpy()
        copies = round_bucket(size, table["rate"][0].as_py(), most)
        return table.drop_columns(["bucket", "part"]).append_column("copies", pa.array(copies)).append_column("taken", pa.array(copies * size))

    kind = dict(sized.dtypes)["doc_id"]
    return joined.groupBy("source", "part", "bucket").applyInArrow(rounded, f"doc_id {kind}, mark long, source string, size long, source_size long, target double, rate double, copies long, taken long")


def _with_groups(sized: DataFrame, aimed: DataFrame, shares: dict[str, float], most: float) -> tuple[DataFrame, DataFrame]:
    """Documents with ``part`` as one of the named groups or "", and a rate for each source and part."""
    rest = 1.0 - sum(shares.values())
    if not shares or len(shares) >= MAX_GROUPS or "" in shares or min(shares.values()) < 0 or rest < -1e-9:
        raise ValueError(f"also_share names 1 to {MAX_GROUPS - 1} groups, with shares of 1 in sum at most")
    names = [*shares, ""]
    sized = sized.withColumn("part", F.when(F.col("part").isin(*shares), F.col("part")).otherwise(F.lit("")))
    cells = store.write(sized.groupBy("source", "part").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")), "cells")
    of = aimed.withColumnRenamed("source", "_s")
    cells = cells.join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "n_docs").withColumnRenamed("docs", "n_docs")
    mu = group_multipliers(cells, names, [*shares.values(), max(0.0, rest)])
    factor: Column = F.element_at(F.array(*[F.lit(float(x)) for x in np.exp(mu)]), F.array_position(F.array(*map(F.lit, names)), F.col("part")).cast("int"))
    mass = F.sum(F.col("words") * factor).over(Window.partitionBy("source"))  # a row a group: 256 at most
    each = store.write(cells.withColumn("factor", factor).withColumn("mass", mass), "mass")
    one = balance(each.groupBy("source", "target").agg(F.max("mass").alias("mass")), "mass").withColumnRenamed("source", "_s").withColumnRenamed("rate", "_r")
    rates = store.write(each.join(one.select("_s", "_r"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", F.col("_r") * F.col("factor")).drop("_s", "_r", "factor", "mass"), "rates")
    top = rates.where("words > 0").agg(F.max("rate")).first()[0] or 0.0
    if top > most * (1 + 1e-9):
        raise RuntimeError(f"these shares need {top:.3g} copies of some documents; {most:g} are allowed")
    return sized, rates
