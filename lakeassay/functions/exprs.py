"""Column expressions that detectors and queries share. All are JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_EDGES = r"(?U)^\s+|\s+$"


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite. Spark orders NaN above all numbers, so comparisons need this guard."""
    d = c.cast("double")
    return c.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, _EDGES, "")


def folded(c: Column) -> Column:
    return F.lower(strip(c))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def is_text_sentinel(c: Column) -> Column:
    return folded(c).isin(*V.TEXT_SENTINELS)


def to_number(c: Column) -> Column:
    """A decimal literal's value, or null; words such as nan or inf and suffixed literals are no numbers."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def date_class(c: Column) -> Column:
    """The first date pattern that a stripped text has, by name; year-first ones must exist in the calendar."""
    s = strip(c)
    day = F.replace(F.substring(s, 1, 10), F.lit("/"), F.lit("-")).try_cast("date")
    real = day.isNotNull() & F.year(day).between(1678, 2261)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(V.DATE_PATTERNS):
        out = F.when(s.rlike(pattern) & (real if name in ("ISO_8601", "SLASH_YMD") else F.lit(True)), F.lit(name)).otherwise(out)
    return out


def parse_datetime(c: Column) -> Column:
    """A UTC timestamp of a text in one of the accepted forms, or null.

    ISO dates and date-times with T or a space, fractions and zones; year first with
    / or .; otherwise month first unless the first number is over 12.
    """
    s = strip(c)
    iso = F.when(s.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?\s*(Z|UTC|[+-][0-9]{2}:?[0-9]{2})?)?$"), F.regexp_replace(s, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2").try_cast("timestamp"))
    part = lambda i: F.regexp_extract(s, r"^([0-9]{1,4})[/.\-]([0-9]{1,2})[/.\-]([0-9]{1,4})(.*)$", i)
    shaped = s.rlike(r"^([0-9]{4}[/.][0-9]{1,2}[/.][0-9]{1,2}|[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-]([0-9]{4}|[0-9]{2}))([T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$")
    # Bound by a one-element array, so each part is cut out once and the generated code stays short.
    other = F.get(F.transform(F.array(F.struct(part(1).alias("a"), part(2).alias("b"), part(3).alias("z"), part(4).alias("rest"))), _numbered_date), F.lit(0))
    out = F.coalesce(iso, F.when(shaped, other.try_cast("timestamp")))
    return F.when(F.year(out).between(1678, 2261), out)


def _numbered_date(p: Column) -> Column:
    """ISO text of three numbers and what follows."""
    pad = lambda x: F.lpad(x, 2, "0")
    a, b, z = p["a"], p["b"], p["z"]
    year = F.when(F.length(z) == 2, F.concat(F.when(z.try_cast("int") < 69, F.lit("20")).otherwise(F.lit("19")), z)).otherwise(z)
    day_first = a.try_cast("int") > 12
    date = F.when(F.length(a) == 4, F.concat_ws("-", a, pad(b), pad(z))).otherwise(F.concat_ws("-", year, pad(F.when(day_first, b).otherwise(a)), pad(F.when(day_first, a).otherwise(b))))
    return F.concat(date, p["rest"])


def as_instant(c: Column, kind: str) -> Column:
    return c.cast("timestamp") if kind == "datetime64[ns]" else parse_datetime(c.cast("string"))


def leading_digit(c: Column) -> Column:
    """The first significant digit in ten-digit scientific notation (log10 would misplace values such as 0.3)."""
    return F.substring(F.format_string("%.10e", F.abs(c.cast("double"))), 1, 1).cast("int")


def escaped_formula(c: Column) -> Column:
    """With ' in front of what a spreadsheet would take for a formula and is no number."""
    return F.when(c.rlike(r"^[=+\-@\t\r]") & (F.length(c) > 1) & c.try_cast("double").isNull(), F.concat(F.lit("'"), c)).otherwise(c)
