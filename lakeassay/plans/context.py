"""What detectors share: the table, its profiles and the evidence queries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .frame import ROW_ID, Frame, col, one_of
from .model import ColumnProfile, Evidence, Finding, Recommendation
from .profile import profile


@dataclass
class Context:
    frame: Frame
    rows: int
    profiles: list[ColumnProfile]
    freq: DataFrame
    quartiles: dict

    @classmethod
    def of(cls, frame: Frame) -> tuple[Context, object]:
        from .profile import frequencies

        freq = frequencies(frame).persist()
        summary, profiles, freq, stats = profile(frame, freq)
        rows = stats.pop("rows")
        return cls(frame, rows, profiles, freq, stats), summary

    @property
    def df(self) -> DataFrame:
        return self.frame.df

    @cached_property
    def by_name(self) -> dict[str, ColumnProfile]:
        return {p.name: p for p in self.profiles}

    def texts(self) -> list[ColumnProfile]:
        return [p for p in self.profiles if self.frame.kinds[p.name] == "str"]

    @cached_property
    def text_stats(self) -> dict[str, dict]:
        """Per text column, from distinct values weighted by their rows: blanks, sentinels, numbers and date classes."""
        keys = {self.frame.columns.index(p.name): p.name for p in self.texts()}
        if not keys:
            return {}
        v, n = F.col("value"), F.col("n")
        some = self.freq.where(one_of("k", keys)).select("k", "n", "first_row", "value", X.is_blank(v).alias("blank"), X.is_text_sentinel(v).alias("sentinel"), X.to_number(v).isNotNull().alias("number"), X.date_class(v).alias("form"))
        from ..functions.vocab import DATE_PATTERNS

        count = lambda c: F.sum(F.when(c, n).otherwise(0))
        rows = some.groupBy("k").agg(count(F.col("blank")).alias("blank"), count(F.col("sentinel")).alias("sentinel"), count(F.col("number")).alias("number"), *[count(F.col("form") == f).alias(f) for f, _ in DATE_PATTERNS]).collect()
        out = {keys[r.k]: r.asDict() for r in rows}
        none = {"blank": 0, "sentinel": 0, "number": 0} | {f: 0 for f, _ in DATE_PATTERNS}
        return {name: out.get(name, none) for name in keys.values()}

    def values_of(self, name: str) -> DataFrame:
        """(value, n, first_row) of a column."""
        return self.freq.where(F.col("k") == self.frame.columns.index(name)).select("value", "n", "first_row")

    def examples(self, hit: Column, *values: Column, k: int = 10) -> tuple[list[int], list]:
        """The first ``k`` row ids where ``hit``, and the values there; each task keeps ``k`` rows."""
        got = self.df.where(hit).select(ROW_ID, *[v.alias(f"v{i}") for i, v in enumerate(values)]).orderBy(ROW_ID).limit(k).collect()
        return [r[0] for r in got], [r[1] if len(values) == 1 else tuple(r[1:]) for r in got] if values else []

    def first_distinct(self, name: str, hit: Column, k: int = 5) -> list[str]:
        """The first ``k`` distinct values of a column where ``hit`` (of ``value``)."""
        return [r.value for r in self.values_of(name).where(hit).orderBy("first_row").limit(k).collect()]


def finding(fid: str, category: str, severity: str, title: str, why: str, columns: list[str], count: int, ratio: float, evidence: Evidence, action: str, priority: str | None = None) -> Finding:
    return Finding(fid, category, severity, title, why, columns, int(count), round(ratio, 4), [evidence], [Recommendation(fid, action, why, priority or severity)])


__all__ = ["ROW_ID", "Context", "Evidence", "col", "finding"]
