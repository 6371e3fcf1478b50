"""Exact quantiles of many columns at once, from how often each value occurs."""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GATHERED = 200_000  # distinct values of a key that one task may hold


def quantiles(counts: DataFrame, at: tuple[float, ...], distinct: int) -> dict:
    """{key: [a value for each of ``at``]}, interpolated linearly between the two ranks around (n - 1) * q.

    ``counts``: (key, x double, n long), a row for each value or some of its rows; ``distinct`` is the most
    values that a key has. Keys with more than ``GATHERED`` go by range: distinct values are dealt out in order,
    sums of the ranges tell which of them hold the wanted ranks, and only those are looked at again. Both ways
    give the same numbers.
    """
    if distinct <= GATHERED:
        return {r.key: list(r.q) for r in counts.groupBy("key").agg(F.percentile("x", F.array(*map(F.lit, at)), F.col("n")).alias("q")).collect() if r.q is not None}
    whole = counts.groupBy("key", "x").agg(F.sum("n").alias("n"))
    ranged = whole.repartitionByRange("key", "x").withColumn("part", F.spark_partition_id()).persist()
    try:
        # A row a range, and one more for each key that ends within a range.
        parts: dict = {}
        for r in ranged.groupBy("part", "key").agg(F.sum("n").alias("n")).collect():
            parts.setdefault(r.key, []).append((r.part, r.n))
        wanted, places = {}, set()
        for key, found in parts.items():
            found.sort()
            before = [0]
            for _, n in found:
                before.append(before[-1] + n)
            wanted[key] = []
            for q in at:
                pos = (before[-1] - 1) * q
                pair = []
                for rank in (math.floor(pos), math.ceil(pos)):
                    k = bisect_right(before, rank) - 1
                    pair.append((key, found[k][0], rank - before[k]))
                places.update(pair)
                wanted[key].append((pos - math.floor(pos), *pair))
        kind = dict(counts.dtypes)["key"]
        looked = counts.sparkSession.createDataFrame(sorted(places, key=str), f"key {kind}, part int, place long")  # two a key and quantile
        upto = F.sum("n").over(Window.partitionBy("part", "key").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        some = ranged.join(F.broadcast(looked.select("key", "part").distinct()), ["key", "part"], "left_semi").withColumn("upto", upto)
        hits = some.join(F.broadcast(looked), ["key", "part"]).where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
        value = {(r.key, r.part, r.place): r.x for r in hits.select("key", "part", "place", "x").collect()}
    finally:
        ranged.unpersist()
    return {key: [value[a] if not share else value[a] + (value[b] - value[a]) * share for share, a, b in of] for key, of in wanted.items()}
