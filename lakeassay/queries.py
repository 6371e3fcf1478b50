"""Every operator as a query over the test tables, beside SQL that gives the same rows.

The tables hold hardly anything wrong, so some queries first make a flawed view of
one, written alike in both dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import detector_queries
from .functions import exprs as X
from .functions import names as N
from .functions import vocab as V
from .operators import completeness, consistency, distribution, leakage, uniqueness
from .plans.context import Context
from .plans.explore import filter_columns, filter_findings
from .plans.frame import ROW_ID, canonical, col
from .plans.investigate import investigate
from .plans.profile import first_values, frequencies
from .plans.quantiles import quantiles as exact_quantiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(detector_queries.QUERIES)
SQL: dict[str, str] = dict(detector_queries.SQL)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def unstacked(df: DataFrame, rows: dict[str, dict[str, Column]]) -> DataFrame:
    """One global aggregate of ``df``, laid out as a row for each key."""
    wide = df.agg(*[F.struct(F.lit(k).alias("column_name"), *[v.alias(n) for n, v in cells.items()]).alias(f"r{i}") for i, (k, cells) in enumerate(rows.items())])
    return wide.select(F.explode(F.array(*wide.columns)).alias("r")).select("r.*")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# Profile

LABELLED = "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")


def _per_column(columns, line: str, source: str) -> str:
    return " UNION ALL ".join(line.replace("{c}", c) for c in columns).join(["WITH t AS (" + source + ") ", ""])


@query(_per_column(("doc_id", "lang", "quality", "toxic"), "SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM t", LABELLED))
def profile_counts(spark, sf):
    df = labelled(spark, sf)
    frame = canonical(df)
    distinct = frequencies(frame).groupBy("k").agg(F.count(F.lit(1)).alias("distinct_values"))
    n = F.count(F.lit(1))
    counts = unstacked(df, {c: {"k": F.lit(i), "n_rows": n, "non_null": F.count(c), "nulls": n - F.count(c)} for i, c in enumerate(frame.columns)})
    return counts.join(distinct, "k", "left").select("column_name", "n_rows", "non_null", "nulls", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"))


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(_per_column(NUMBERS, "SELECT '{c}' AS column_name, min({c}) AS min_value, max({c}) AS max_value, round(avg({c}), 5) AS mean, round(quantile_cont({c}, 0.25), 6) AS q25, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75, round(stddev_samp({c}), 5) AS std_dev FROM t", "SELECT * FROM lineitem"))
def numeric_profile(spark, sf):
    ctx, _ = Context.of(canonical(table(spark, sf, "lineitem").select(*NUMBERS)))
    q = ctx.quartiles
    exact = unstacked(ctx.df, {c: {"min_value": F.min(c), "max_value": F.max(c), "mean": F.round(F.avg(c), 5), "std_dev": F.round(F.stddev_samp(c), 5)} for c in NUMBERS})
    ctx.freq.unpersist()
    some = spark.createDataFrame([(c, *(round(v, 6) for v in q[c])) for c in NUMBERS], "column_name string, q25 double, median double, q75 double")
    return exact.join(F.broadcast(some), "column_name").select("column_name", "min_value", "max_value", "mean", "q25", "median", "q75", "std_dev")  # four rows


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, count(*) AS n FROM events GROUP BY event_type")
def quantiles(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("key"), F.col("value").alias("x")).agg(F.count(F.lit(1)).alias("n")).persist()
    most = counts.groupBy("key").agg(F.count(F.lit(1)).alias("u"), F.sum("n").alias("n")).collect()  # a row a kind of event
    got = exact_quantiles(counts, (0.25, 0.5, 0.75), max(r.u for r in most))
    counts.unpersist()
    return spark.createDataFrame([(r.key, *(round(v, 6) for v in got[r.key]), r.n) for r in most], "event_type string, q25 double, q50 double, q75 double, n long")


@query(f"WITH t AS ({LABELLED}) SELECT count(*) * 4 AS total_cells, sum((quality IS NULL)::BIGINT + (toxic IS NULL)::BIGINT)::BIGINT AS missing_cells, round(sum((quality IS NULL)::BIGINT + (toxic IS NULL)::BIGINT) / (count(*) * 4), 6) AS missing_cell_ratio FROM t")
def missing_summary(spark, sf):
    df = labelled(spark, sf)
    n, missing = F.count(F.lit(1)) * len(df.columns), sum((F.count(F.lit(1)) - F.count(c) for c in df.columns), F.lit(0))
    return df.agg(n.alias("total_cells"), missing.cast("long").alias("missing_cells"), r6(missing / n).alias("missing_cell_ratio"))


_MOMENTS = "WITH m AS (SELECT avg(value) AS mu FROM events), d AS (SELECT avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3, avg((value - mu) ** 4) AS m4 FROM events, m) "


@query(_MOMENTS + "SELECT round(m3 / m2 ** 1.5, 6) AS skewness, round(m4 / m2 ** 2 - 3, 6) AS kurtosis FROM d")
def shape_stats(spark, sf):
    return table(spark, sf, "events").agg(r6(F.skewness("value")).alias("skewness"), r6(F.kurtosis("value")).alias("kurtosis"))


@query("SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def value_frequency(spark, sf):
    frame = canonical(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))
    return frequencies(frame).select(F.get(F.array(*map(F.lit, frame.columns)), "k").alias("column_name"), "value", "n")


@query("WITH f AS (SELECT 'p_brand' AS column_name, p_brand AS value, min(p_partkey) AS first_row FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, min(p_partkey) FROM part GROUP BY 2), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY first_row) AS place FROM f) SELECT column_name, value, first_row, place::BIGINT AS place FROM r WHERE place <= 5")
def first_samples(spark, sf):
    frame = canonical(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), row_id="p_partkey")
    return first_values(frequencies(frame), 5).select(F.get(F.array(*map(F.lit, frame.columns)), "k").alias("column_name"), "value", "first_row", F.col("place").cast("long").alias("place"))


@query(
    "SELECT * FROM (VALUES ('event_id', 'identifier', 'int64'), ('ts', 'datetime', 'datetime64[ns]'), ('user_id', 'numeric_continuous', 'int64'), ('event_type', 'categorical', 'str'), ('value', 'numeric_continuous', 'float64')) AS t(column_name, semantic_type, inferred_dtype)"
)
def semantic_types(spark, sf):
    ctx, _ = Context.of(canonical(table(spark, sf, "events").drop("props")))
    return spark.createDataFrame([(p.name, p.semantic_type, p.inferred_dtype) for p in ctx.profiles], "column_name string, semantic_type string, inferred_dtype string")


_KINDS = {"c_custkey": "int64", "c_name": "str", "c_nationkey": "int64", "c_acctbal": "float64", "c_mktsegment": "str"}
_NUMERIC = "min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value, round(avg({c}), 4) AS mean, round(median({c}), 4)::DOUBLE AS median, round(stddev_samp({c}), 4) AS std_dev"
_NO_NUMBERS = "NULL AS min_value, NULL AS max_value, NULL AS mean, NULL AS median, NULL AS std_dev"


@query(
    "WITH p AS (" + " UNION ALL ".join(f"SELECT {i} AS ordinal, '{c}' AS name, '{k}' AS inferred_dtype, count(*) AS total, count({c}) AS non_null_count, count(DISTINCT {c}) AS unique_count, {_NO_NUMBERS if k == 'str' else _NUMERIC.format(c=c)} FROM customer" for i, (c, k) in enumerate(_KINDS.items())) + ") "
    "SELECT ordinal, name, inferred_dtype, CASE WHEN inferred_dtype <> 'float64' AND unique_count = non_null_count AND non_null_count >= 0.95 * total THEN 'identifier' WHEN inferred_dtype = 'float64' THEN 'numeric_continuous' WHEN inferred_dtype = 'int64' THEN CASE WHEN unique_count <= 10 AND unique_count / non_null_count < 0.05 THEN 'categorical' WHEN unique_count > 20 THEN 'numeric_continuous' ELSE 'numeric_discrete' END WHEN unique_count / non_null_count < 0.2 OR unique_count <= 50 THEN 'categorical' ELSE 'free_text' END AS semantic_type, "
    "non_null_count, total - non_null_count AS null_count, unique_count, round(unique_count / non_null_count, 4) AS unique_ratio, min_value, max_value, mean, median, std_dev, inferred_dtype <> 'float64' AND unique_count = total AS is_candidate_identifier, unique_count <= 1 AS is_constant_or_near_constant FROM p"
)
def column_profiles(spark, sf):
    columns = ("ordinal", "name", "inferred_dtype", "semantic_type", "non_null_count", "null_count", "unique_count", "unique_ratio", "min_value", "max_value", "mean", "median", "std_dev", "is_candidate_identifier", "is_constant_or_near_constant")
    return investigate(table(spark, sf, "customer")).columns_df(spark).select(*columns)


# Completeness


@query(f"WITH t AS ({LABELLED}) SELECT sum((quality IS NULL)::BIGINT)::BIGINT AS affected_rows, sum((quality IS NULL)::BIGINT) / count(*) AS ratio, CASE WHEN sum((quality IS NULL)::BIGINT) / count(*) >= 0.5 THEN 'high' WHEN sum((quality IS NULL)::BIGINT) / count(*) >= 0.2 THEN 'medium' ELSE 'low' END AS severity FROM t")
def missing_ratio(spark, sf):
    n = F.count(F.lit(1)) - F.count("quality")
    ratio = n / F.count(F.lit(1))
    return labelled(spark, sf).agg(n.alias("affected_rows"), ratio.alias("ratio"), F.when(ratio >= 0.50, "high").when(ratio >= 0.20, "medium").otherwise("low").alias("severity"))


@query(f"WITH t AS ({LABELLED}) SELECT sum((quality IS NULL AND toxic IS NULL)::BIGINT)::BIGINT AS overlap, sum((quality IS NULL AND toxic IS NULL)::BIGINT) / sum((quality IS NULL OR toxic IS NULL)::BIGINT) AS jaccard FROM t")
def co_missingness(spark, sf):
    a, b = F.col("quality").isNull(), F.col("toxic").isNull()
    both, either = F.count(F.when(a & b, 1)), F.count(F.when(a | b, 1))
    return labelled(spark, sf).agg(both.alias("overlap"), (both / either).alias("jaccard"))


SENTINEL_SQL = "SELECT event_id, CASE event_id % 9 WHEN 0 THEN ' N/A' WHEN 1 THEN '?' WHEN 2 THEN 'Unknown ' WHEN 3 THEN '-' WHEN 4 THEN 'not a sentinel' ELSE event_type END AS feedback FROM events"
_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _case(n: int, base: Column, *values: str | None, otherwise: Column) -> Column:
    out = otherwise
    for k, v in reversed(list(enumerate(values))):
        out = F.when(base % n == k, F.lit(v)).otherwise(out)
    return out


@query(f"WITH t AS ({SENTINEL_SQL}) SELECT feedback, count(*) AS n, min(event_id) AS first_row FROM t WHERE lower({_STRIP.format(c='feedback')}) IN ({', '.join(repr(s) for s in V.TEXT_SENTINELS)}) GROUP BY feedback")
def text_sentinels(spark, sf):
    e = table(spark, sf, "events").select("event_id", _case(9, F.col("event_id"), " N/A", "?", "Unknown ", "-", "not a sentinel", otherwise=F.col("event_type")).alias("feedback"))
    frame = canonical(e, row_id="event_id")
    return frequencies(frame).where(X.is_text_sentinel(F.col("value"))).select(F.col("value").alias("feedback"), "n", "first_row")


CODED_SQL = "SELECT event_id, CASE WHEN event_id % 20 = 0 THEN -999.0 WHEN event_id % 50 = 1 THEN 9999.0 ELSE value END AS reading FROM events"


@query(
    f"WITH t AS ({CODED_SQL}), s AS (SELECT unnest([9999, 99999, 999999, -1, -999, -9999]) AS sentinel), g AS (SELECT sentinel, (SELECT count(*) FROM t WHERE reading = sentinel) AS hits, (SELECT quantile_cont(reading, 0.25) FROM t WHERE reading <> sentinel) AS q25, (SELECT quantile_cont(reading, 0.75) FROM t WHERE reading <> sentinel) AS q75, (SELECT avg((reading >= 0)::INT) FROM t WHERE reading <> sentinel) AS share FROM s) "
    "SELECT sentinel::BIGINT AS sentinel, hits, round(q25, 6) AS q25, round(q75, 6) AS q75, round(share, 6) AS share_not_negative, (sentinel < 0 AND share > 0.95) OR (q75 > q25 AND (sentinel < q25 - 3 * (q75 - q25) OR sentinel > q75 + 3 * (q75 - q25))) AS suspicious FROM g WHERE hits > 0"
)
def numeric_sentinels(spark, sf):
    e = F.col("event_id")
    t = table(spark, sf, "events").select(F.when(e % 20 == 0, -999.0).when(e % 50 == 1, 9999.0).otherwise(F.col("value")).alias("reading"))
    freq = frequencies(canonical(t)).persist()
    hits = {int(r.x): r.n for r in freq.where(F.col("x").isin(*map(float, V.NUMERIC_SENTINELS))).select("x", "n").collect()}
    codes = list(hits)
    rest = completeness.others(freq, [(0, s) for s in codes])
    q = exact_quantiles(rest, (0.25, 0.75), freq.count())
    share = dict(rest.groupBy("key").agg(F.sum(F.when(F.col("x") >= 0, F.col("n")).otherwise(0)) / F.sum("n")).collect())
    freq.unpersist()
    return spark.createDataFrame([(s, hits[s], round(q[k][0], 6), round(q[k][1], 6), round(share[k], 6), completeness.suspicious(s, share[k], *q[k])) for k, s in enumerate(codes)], "sentinel long, hits long, q25 double, q75 double, share_not_negative double, suspicious boolean")


@query("WITH t AS (SELECT event_id, CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN chr(9) || ' ' || chr(10) WHEN 3 THEN NULL ELSE props END AS note FROM events) SELECT count(*) FILTER (note IS NULL) AS nulls, count(*) FILTER (regexp_replace(note, '^\\s+|\\s+$', '', 'g') = '') AS blanks, count(*) AS n_rows FROM t".replace("\\\\", "\\"))
def whitespace_missing(spark, sf):
    note = _case(11, F.col("event_id"), "", "  ", "\t \n", None, otherwise=F.col("props"))
    t = table(spark, sf, "events").select(note.alias("note"))
    return t.agg(F.count(F.when(F.col("note").isNull(), 1)).alias("nulls"), F.count(F.when(X.is_blank(F.col("note")), 1)).alias("blanks"), F.count(F.lit(1)).alias("n_rows"))


# Uniqueness

ORDER_KEYS = ("o_custkey", "o_orderstatus", "o_orderpriority")


@query("SELECT sum(n - 1)::BIGINT AS excess_rows, count(*) AS repeated_groups, sum(n)::BIGINT AS member_rows FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority) WHERE n > 1")
def exact_duplicates(spark, sf):
    from .plans.profile import duplicate_rows

    _, groups = duplicate_rows(canonical(table(spark, sf, "orders").select(*ORDER_KEYS)))
    return groups.agg(F.sum(F.col("n") - 1).alias("excess_rows"), F.count(F.lit(1)).alias("repeated_groups"), F.sum("n").alias("member_rows"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k > 1")
def excess_members(spark, sf):
    w = Window.partitionBy(*ORDER_KEYS).orderBy("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).alias("k")).where("k > 1").select("o_orderkey")


@query("SELECT count(*) AS non_null, count(DISTINCT text) AS distinct_values, count(*) - count(DISTINCT text) AS collisions, round(count(DISTINCT text) / count(*), 6) AS unique_ratio FROM documents")
def pk_collision(spark, sf):
    frame = canonical(table(spark, sf, "documents").select(F.col("text").alias("record_code")))
    f = frequencies(frame)
    return f.agg(F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("distinct_values"), F.sum(F.col("n") - 1).alias("collisions"), r6(F.count(F.lit(1)) / F.sum("n")).alias("unique_ratio"))


@query("SELECT round(count(DISTINCT l_orderkey) / count(*), 6) AS unique_ratio, count(DISTINCT l_orderkey) / count(*) < 0.8 AS is_foreign_key FROM lineitem")
def fk_disambiguation(spark, sf):
    frame = canonical(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id")))
    n, u = frequencies(frame).agg(F.sum("n"), F.count(F.lit(1))).first()
    return spark.createDataFrame([(round(u / n, 6), uniqueness.is_foreign_key("order_id", u / n, n, n - u, u / n, False))], "unique_ratio double, is_foreign_key boolean")


@query(f"WITH t AS (SELECT CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE d.doc_id END AS record_id FROM ({LABELLED}) d) SELECT count(*) - count(record_id) AS nulls, (count(*) - count(record_id)) / count(*) AS ratio, CASE WHEN (count(*) - count(record_id)) / count(*) > 0.05 THEN 'critical' ELSE 'high' END AS severity FROM t")
def pk_null(spark, sf):
    n = F.count(F.lit(1)) - F.count("record_id")
    ratio = n / F.count(F.lit(1))
    return labelled(spark, sf).select(F.when(F.col("doc_id") % 13 != 0, F.col("doc_id")).alias("record_id")).agg(n.alias("nulls"), ratio.alias("ratio"), F.when(ratio > 0.05, "critical").otherwise("high").alias("severity"))


@query("SELECT 'conv_id,turn' AS pair, (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations)) AS distinct_pairs, (SELECT count(*) FROM conversations) AS n_rows UNION ALL SELECT 'l_partkey,l_extendedprice', (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_extendedprice FROM lineitem)), (SELECT count(*) FROM lineitem)")
def composite_key(spark, sf):
    out = None
    for name, a, b in (("conversations", "conv_id", "turn"), ("lineitem", "l_partkey", "l_extendedprice")):
        t = table(spark, sf, name).groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).agg(F.lit(f"{a},{b}").alias("pair"), F.count(F.lit(1)).alias("distinct_pairs"), F.sum("n").alias("n_rows"))
        out = t if out is None else out.union(t)
    return out


@query("WITH a AS (SELECT o_orderkey FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority) AS n FROM orders) WHERE n > 1), b AS (SELECT o_orderkey FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1) SELECT (SELECT count(*) FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)) = 0 AS explained")
def collisions_explained(spark, sf):
    o = table(spark, sf, "orders")
    rows = lambda keys: o.join(o.groupBy(*keys).count().where("count > 1"), list(keys), "left_semi").select("o_orderkey")
    return rows(ORDER_KEYS).join(rows(("o_custkey",)), "o_orderkey", "left_anti").agg((F.count(F.lit(1)) == 0).alias("explained"))


# Validity

DRIFT_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'pending' WHEN o_orderkey % 10 = 1 THEN '12x' WHEN o_orderkey % 10 = 2 THEN ' 7.5e1 ' WHEN o_orderkey % 10 = 3 THEN 'nan' ELSE o_custkey::VARCHAR END AS amount FROM orders"


@query(f"WITH t AS ({DRIFT_SQL}) SELECT count(*) FILTER (regexp_matches(trim(amount), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')) AS numeric_cells, count(*) FILTER (NOT regexp_matches(trim(amount), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')) AS other_cells FROM t")
def type_drift(spark, sf):
    o = F.col("o_orderkey")
    amount = F.when(o % 10 == 0, "pending").when(o % 10 == 1, "12x").when(o % 10 == 2, " 7.5e1 ").when(o % 10 == 3, "nan").otherwise(F.col("o_custkey").cast("string"))
    f = frequencies(canonical(table(spark, sf, "orders").select(amount.alias("amount"))))
    ok = X.to_number(F.col("value")).isNotNull()
    return f.agg(F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("numeric_cells"), F.sum(F.when(ok, 0).otherwise(F.col("n"))).alias("other_cells"))


DATED_SQL = "SELECT event_id, lpad((event_id % 28 + 1)::VARCHAR, 2, '0') AS d, lpad((event_id % 12 + 1)::VARCHAR, 2, '0') AS m FROM events"
FORMS_SQL = f"SELECT CASE event_id % 8 WHEN 0 THEN d || '/' || m || '/2024' WHEN 1 THEN '2024/' || m || '/' || d WHEN 2 THEN d || '.' || m || '.2024' WHEN 3 THEN '2024-02-30' WHEN 4 THEN 'soon' ELSE '2024-' || m || '-' || d || CASE WHEN event_id % 8 = 5 THEN 'T10:20:30' ELSE '' END END AS due_date FROM ({DATED_SQL})"


def dated(spark, sf) -> DataFrame:
    e = F.col("event_id")
    d, m = F.lpad((e % 28 + 1).cast("string"), 2, "0"), F.lpad((e % 12 + 1).cast("string"), 2, "0")
    due = F.when(e % 8 == 0, F.concat(d, F.lit("/"), m, F.lit("/2024"))).when(e % 8 == 1, F.concat(F.lit("2024/"), m, F.lit("/"), d)).when(e % 8 == 2, F.concat(d, F.lit("."), m, F.lit(".2024"))).when(e % 8 == 3, F.lit("2024-02-30")).when(e % 8 == 4, F.lit("soon"))
    return table(spark, sf, "events").select("event_id", due.otherwise(F.concat(F.lit("2024-"), m, F.lit("-"), d, F.when(e % 8 == 5, F.lit("T10:20:30")).otherwise(F.lit("")))).alias("due_date"))


@query(f"WITH t AS ({FORMS_SQL}), c AS (SELECT CASE WHEN due_date ~ '^[0-9]{{4}}-.*' AND try_cast(due_date[1:10] AS DATE) IS NOT NULL THEN 'ISO_8601' WHEN due_date ~ '^[0-9]{{4}}/.*' THEN 'SLASH_YMD' WHEN due_date ~ '^[0-9]{{2}}/.*' THEN 'SLASH_DMY' WHEN due_date ~ '^[0-9]{{2}}\\..*' THEN 'DOT_DMY' ELSE 'none' END AS form FROM t) SELECT form, count(*) AS n FROM c GROUP BY form".replace("~ '^[0-9]{4}-.*'", "LIKE '2024-%'").replace("~ '^[0-9]{4}/.*'", "LIKE '2024/%'").replace("~ '^[0-9]{2}/.*'", "LIKE '__/%'").replace("~ '^[0-9]{2}\\..*'", "LIKE '__.%'"))
def date_formats(spark, sf):
    f = frequencies(canonical(dated(spark, sf), row_id="event_id"))
    return f.groupBy(F.coalesce(X.date_class(F.col("value")), F.lit("none")).alias("form")).agg(F.sum("n").alias("n"))


@query(f"SELECT * FROM (SELECT o_orderpriority AS canonical, 0 AS n FROM orders LIMIT 0) UNION ALL SELECT lower(trim(v)) AS canonical, count(DISTINCT trim(v)) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN upper(o_orderstatus || 'x') WHEN 1 THEN lower(o_orderstatus || 'x') WHEN 2 THEN ' ' || o_orderstatus || 'x' ELSE o_orderpriority END AS v FROM orders) GROUP BY 1 HAVING count(DISTINCT trim(v)) > 1".replace("SELECT * FROM (SELECT o_orderpriority AS canonical, 0 AS n FROM orders LIMIT 0) UNION ALL ", ""))
def casing_drift(spark, sf):
    o, s = F.col("o_orderkey"), F.concat("o_orderstatus", F.lit("x"))
    v = F.when(o % 4 == 0, F.upper(s)).when(o % 4 == 1, F.lower(s)).when(o % 4 == 2, F.concat(F.lit(" "), s)).otherwise(F.col("o_orderpriority"))
    f = frequencies(canonical(table(spark, sf, "orders").select(v.alias("state"))))
    return f.select(X.strip(F.col("value")).alias("v")).distinct().groupBy(F.lower("v").alias("canonical")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"WITH t AS ({FORMS_SQL.replace('SELECT CASE', 'SELECT event_id, CASE')}) SELECT event_id, CASE WHEN due_date LIKE '__/%' THEN CASE WHEN due_date[1:2]::INT > 12 THEN (due_date[7:10] || '-' || due_date[4:5] || '-' || due_date[1:2])::DATE WHEN due_date[4:5]::INT > 12 THEN NULL ELSE (due_date[7:10] || '-' || due_date[1:2] || '-' || due_date[4:5])::DATE END WHEN due_date LIKE '__.%' THEN CASE WHEN due_date[1:2]::INT > 12 THEN (due_date[7:10] || '-' || due_date[4:5] || '-' || due_date[1:2])::DATE ELSE (due_date[7:10] || '-' || due_date[1:2] || '-' || due_date[4:5])::DATE END ELSE try_cast(replace(due_date[1:10], '/', '-') AS DATE) END AS day FROM t")
def datetime_parsing(spark, sf):
    return dated(spark, sf).select("event_id", X.parse_datetime(F.col("due_date")).cast("date").alias("day"))


# Distribution


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, value FROM events, q WHERE value > b + 3 * (b - a) OR value < a - 3 * (b - a)")
def outliers(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    lo, hi = _limits(canonical(e.select("value")))
    return e.where((F.col("value") > hi) | (F.col("value") < lo))


def _limits(frame) -> tuple[float, float]:
    ctx, _ = Context.of(frame)
    c = frame.columns[0]
    q = ctx.quartiles[c]
    mad = distribution.median_deviations(ctx, {c: q[1]})[c]
    ctx.freq.unpersist()
    return distribution.bounds(*q, mad)


@query("WITH t AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN value ELSE 5.0 END AS v FROM events), m AS (SELECT median(v) AS md FROM t), d AS (SELECT median(abs(v - md)) AS mad FROM t, m) SELECT count(*) AS extreme_rows, min(v) AS lowest, max(v) AS highest FROM t, m, d WHERE v > md + CASE WHEN mad > 0 THEN 5 * mad ELSE 1 END OR v < md - CASE WHEN mad > 0 THEN 5 * mad ELSE 1 END")
def outliers_mad(spark, sf):
    t = table(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 0, F.col("value")).otherwise(5.0).alias("v"))
    lo, hi = _limits(canonical(t))
    return t.where((F.col("v") > hi) | (F.col("v") < lo)).agg(F.count(F.lit(1)).alias("extreme_rows"), F.min("v").alias("lowest"), F.max("v").alias("highest"))


_DIGIT = "format('{:.10e}', abs({c}))[1]::INT"


@query("WITH a AS (SELECT 'l_extendedprice' AS column_name, l_extendedprice AS x FROM lineitem UNION ALL SELECT 'o_totalprice', o_totalprice FROM orders), h AS (SELECT column_name, format('{:.10e}', abs(x))[1]::INT AS digit, count(*) AS n FROM a GROUP BY 1, 2), t AS (SELECT column_name, sum(n) AS total FROM h GROUP BY 1), g AS (SELECT t.column_name, d, total, coalesce(n, 0) AS n FROM t CROSS JOIN (SELECT unnest(range(1, 10)) AS d) LEFT JOIN h ON h.column_name = t.column_name AND h.digit = d) SELECT column_name, round(sum(abs(n / total - log10(1 + 1 / d))) / 9, 6) AS deviation, round(sum(abs(n / total - log10(1 + 1 / d))) / 9, 6) > 0.025 AS fires FROM g GROUP BY 1")
def benford(spark, sf):
    out = None
    for name, c in (("lineitem", "l_extendedprice"), ("orders", "o_totalprice")):
        x = table(spark, sf, name).select(F.lit(c).alias("column_name"), X.leading_digit(F.col(c)).alias("digit"))
        out = x if out is None else out.union(x)
    n = F.count(F.lit(1))
    mad = sum((F.abs(F.count(F.when(F.col("digit") == d, 1)) / n - e) for d, e in distribution.BENFORD.items()), F.lit(0.0)) / 9
    return out.groupBy("column_name").agg(r6(mad).alias("deviation"), (r6(mad) > 0.025).alias("fires"))


@query("SELECT format('{:.10e}', abs(o_totalprice))[1]::BIGINT AS digit, count(*) AS n FROM orders GROUP BY 1")
def leading_digits(spark, sf):
    return table(spark, sf, "orders").groupBy(X.leading_digit(F.col("o_totalprice")).cast("long").alias("digit")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN exp(c_custkey % 7) ELSE 0.0 END AS v FROM customer), m AS (SELECT avg(v) AS mu FROM t), d AS (SELECT avg((v - mu) ** 2) AS m2, avg((v - mu) ** 3) AS m3 FROM t, m) SELECT round(m3 / m2 ** 1.5, 4) AS skewness, abs(m3 / m2 ** 1.5) > 4 AS fires FROM d")
def skewness(spark, sf):
    k = F.col("c_custkey")
    t = table(spark, sf, "customer").select(F.when(k % 50 == 0, F.exp(k % 7)).otherwise(0.0).alias("v"))
    return t.agg(F.round(F.skewness("v"), 4).alias("skewness"), (F.abs(F.skewness("v")) > 4).alias("fires"))


# Consistency


@query("SELECT count(*) AS pairs, count(*) FILTER (l_shipdate < o_orderdate) AS inversions FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def temporal_inversion(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("ship_date")).join(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("order_date")), F.col("l_orderkey") == F.col("o_orderkey"))
    (start, end, _), = consistency.date_pairs(["ship_date", "order_date"])
    clock = t.agg(*[F.bool_or(consistency.day(F.col(c)) != F.col(c)) for c in (start, end)]).first()
    return t.agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(consistency.inverted(F.col(start), F.col(end), *map(bool, clock)), 1)).alias("inversions"))


@query("SELECT count(*) FILTER (date_trunc('day', ts) < ts) AS as_instants, count(*) FILTER (date_trunc('day', ts) < date_trunc('day', ts)) AS as_days FROM events")
def temporal_day_grain(spark, sf):
    t = table(spark, sf, "events").select(F.col("ts").alias("order_time"), F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("ship_date"))
    n = lambda a, b: F.count(F.when(consistency.inverted(F.col("order_time"), F.col("ship_date"), a, b), 1))
    return t.agg(n(False, False).alias("as_instants"), n(True, False).alias("as_days"))


@query("SELECT count(*) AS negatives, min(c_acctbal) AS lowest FROM customer WHERE c_acctbal < 0")
def negative_domain(spark, sf):
    assert N.has_any("balance_units", V.NON_NEGATIVE)
    t = table(spark, sf, "customer").select(F.col("c_acctbal").alias("balance_units"))
    return t.where(X.finite(F.col("balance_units")) & (F.col("balance_units") < 0)).agg(F.count(F.lit(1)).alias("negatives"), F.min("balance_units").alias("lowest"))


@query("SELECT count(*) AS violations FROM part WHERE p_size * 40 > p_retailprice")
def min_max_bounds(spark, sf):
    (a, b), = consistency.bound_pairs(["price_min", "price_max"])
    return table(spark, sf, "part").select((F.col("p_size") * 40).alias("price_min"), F.col("p_retailprice").alias("price_max")).agg(F.count(F.when(F.col(a) > F.col(b), 1)).alias("violations"))


# Leakage


@query("SELECT count(*) AS pairs, count(*) FILTER (lower(trim(c)) = lower(trim(t))) / count(*) AS match_rate FROM (SELECT CASE WHEN o_orderkey % 33 = 0 THEN 'other' WHEN o_orderkey % 2 = 0 THEN ' ' || lower(o_orderpriority) ELSE o_orderpriority END AS c, o_orderpriority AS t FROM orders)")
def target_proxy(spark, sf):
    o, p = F.col("o_orderkey"), F.col("o_orderpriority")
    t = table(spark, sf, "orders").select(F.when(o % 33 == 0, "other").when(o % 2 == 0, F.concat(F.lit(" "), F.lower(p))).otherwise(p).alias("c"), p.alias("t"))
    return t.where("c is not null and t is not null").agg(F.count(F.lit(1)).alias("pairs"), F.avg((X.folded(F.col("c")) == X.folded(F.col("t"))).cast("double")).alias("match_rate"))


@query("SELECT round(corr(l_extendedprice, l_extendedprice * (1 - l_discount)), 6) AS pearson FROM lineitem")
def pearson(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"))
    return t.agg(r6(leakage.pearson("a", "b")).alias("pearson"))


@query("WITH t AS (SELECT l_extendedprice AS a, l_extendedprice * (1 - l_discount) AS b FROM lineitem), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM t) SELECT round(corr(ra, rb), 6) AS spearman FROM r")
def spearman(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"))
    r = leakage.spearman(t, F.col("a"), F.col("b"))
    return spark.createDataFrame([(None if r is None else round(r, 6),)], "spearman double")


@query("WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM c) SELECT round(sqrt(greatest(0, sum(n * n / (na * nb)) - 1) / (least((SELECT count(DISTINCT a) FROM c), (SELECT count(DISTINCT b) FROM c)) - 1)), 6) AS cramers_v FROM m")
def cramers_v(spark, sf):
    v, *_ = leakage.cramers_v(table(spark, sf, "lineitem"), F.col("l_returnflag"), F.col("l_linestatus"))
    return spark.createDataFrame([(round(v, 6),)], "cramers_v double")


# Whole investigations and what is read from them


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, max(value) AS m FROM events) SELECT 'FND-DST-OUTLIER-value' AS id, CASE WHEN (m - b) / (b - a) > 10 THEN 'high' ELSE 'medium' END AS severity, count(*) AS affected_row_count FROM events, q WHERE value > b + 3 * (b - a) OR value < a - 3 * (b - a) GROUP BY ALL")
def investigate_events(spark, sf):
    return investigate(table(spark, sf, "events")).findings_df(spark).select("id", "severity", "affected_row_count")


@query(
    f"WITH t AS ({LABELLED}), m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) - count({c}) AS n, count(*) AS total FROM t" for c in ("doc_id", "lang", "quality", "toxic")) + "), b AS (SELECT count(*) FILTER (quality IS NULL AND toxic IS NULL) AS n, count(*) FILTER (quality IS NULL OR toxic IS NULL) AS u, count(*) AS total FROM t) "
    "SELECT 'FND-CMP-MISS-' || c AS id, 'completeness' AS category, CASE WHEN n / total >= 0.5 THEN 'high' WHEN n / total >= 0.2 THEN 'medium' ELSE 'low' END AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM m WHERE n / total >= 0.05 UNION ALL SELECT 'FND-CMP-COMISS-quality-toxic', 'completeness', 'medium', n, round(n / total, 4) FROM b WHERE n >= 5 AND n / u >= 0.9"
)
def investigate_labelled(spark, sf):
    """A joined table with a target: all findings."""
    df = labelled(spark, sf).withColumn("record_code", F.col("doc_id") % 97)
    return investigate(df, target="toxic").findings_df(spark).select("id", "category", "severity", "affected_row_count", "affected_row_ratio")


@query("WITH h AS (SELECT format('{:.10e}', abs(o_totalprice))[1]::INT AS digit, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT sum(abs(coalesce(n, 0) / (SELECT count(*) FROM orders) - log10(1 + 1 / d))) / 9 AS off FROM (SELECT unnest(range(1, 10)) AS d) LEFT JOIN h ON digit = d), x AS (SELECT max(o_totalprice) / (min(o_totalprice) + 1e-9) AS span, min(o_totalprice) AS low FROM orders) SELECT 'FND-DST-BENFORD-total_price' AS finding_id, 'distribution' AS category, 6.0::DOUBLE AS deduction FROM g, x WHERE off > 0.025 AND span >= 50 AND low > 0")
def investigate_orders(spark, sf):
    """The deductions of a whole investigation of sound orders."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("order_date"), F.col("o_totalprice").alias("total_price"), "o_orderstatus", "o_orderpriority")
    return investigate(o).penalties_df(spark).select("finding_id", "category", "deduction")


LITERAL = (
    ("FND-A", "uniqueness", "critical", ("id",), 0.10), ("FND-B", "validity", "high", ("pay", "id"), 0.02), ("FND-C", "validity", "medium", ("pay",), 0.30),
    ("FND-D", "distribution", "low", ("pay",), 0.0), ("FND-E", "completeness", "info", ("exit",), 0.92), ("FND-F", "consistency", "critical", ("id",), 0.01),
)
_VALUES = "(VALUES " + ", ".join(f"('{i}', '{c}', '{s}', [{', '.join(repr(x) for x in cols)}], {r})" for i, c, s, cols, r in LITERAL) + ") AS f(id, category, severity, affected_columns, ratio)"


def literal_findings(spark) -> DataFrame:
    return spark.createDataFrame([(i, c, s, list(cols), float(r)) for i, c, s, cols, r in LITERAL], "id string, category string, severity string, affected_columns array<string>, ratio double")


@query("SELECT finding_id, deduction::DOUBLE AS deduction FROM (VALUES ('FND-A', 20.0), ('FND-F', 15.0), ('FND-C', 5.04), ('FND-D', 2.0)) AS t(finding_id, deduction)")
def score_ledger(spark, sf):
    """FND-A and FND-F bring column id to its cap of 35, so FND-B, which also charges id, takes nothing."""
    from .plans.model import Finding
    from .plans.scoring import trust_score

    order = sorted(LITERAL, key=lambda f: V.SEVERITIES.index(f[2]))
    t = trust_score([Finding(i, c, s, i, "", list(cols), 1, r) for i, c, s, cols, r in order])
    return spark.createDataFrame([(p.finding_id, p.deduction) for p in t.penalties], "finding_id string, deduction double")


@query("SELECT s AS score, CASE WHEN s >= 97 THEN 'A+' WHEN s >= 90 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 50 THEN 'C' WHEN s >= 30 THEN 'D' ELSE 'F' END AS grade, CASE WHEN s >= 75 THEN 'reliable' WHEN s >= 30 THEN 'caution' ELSE 'compromised' END AS verdict FROM (SELECT unnest([100.0, 97.0, 96.9, 90.0, 89.9, 75.0, 74.9, 50.0, 49.9, 30.0, 29.9, 0.0])::DOUBLE AS s)")
def grade_verdict(spark, sf):
    from .plans.scoring import grade

    return spark.createDataFrame([(x, *grade(x)) for x in (100.0, 97.0, 96.9, 90.0, 89.9, 75.0, 74.9, 50.0, 49.9, 30.0, 29.9, 0.0)], "score double, grade string, verdict string")


@query(f"SELECT severity, count(*) AS n FROM {_VALUES} GROUP BY severity")
def severity_counts(spark, sf):
    return literal_findings(spark).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT column_name, count(*) AS n FROM (SELECT unnest(affected_columns) AS column_name FROM {_VALUES}) GROUP BY 1")
def anomalies_per_column(spark, sf):
    return literal_findings(spark).select(F.explode("affected_columns").alias("column_name")).groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, severity, category FROM {_VALUES} WHERE category = 'validity' AND (id ILIKE '%PAY%' OR list_bool_or([c ILIKE '%PAY%' FOR c IN affected_columns]))".replace("list_bool_or([c ILIKE '%PAY%' FOR c IN affected_columns])", "len([c FOR c IN affected_columns IF c ILIKE '%PAY%']) > 0"))
def findings_filter(spark, sf):
    return filter_findings(literal_findings(spark), category="validity", search="PAY").select("id", "severity", "category")


@query("SELECT * FROM (VALUES ('event_type', 'categorical'), ('props', 'categorical')) AS t(name, semantic_type)")
def column_filter(spark, sf):
    return filter_columns(investigate(table(spark, sf, "events")).columns_df(spark), semantic_type="categorical", search="P").select("name", "semantic_type")


@query(f"WITH c AS (SELECT id, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, id) AS place FROM {_VALUES}) SELECT id, place FROM c")
def severity_order(spark, sf):
    rank = F.array_position(F.array(*map(F.lit, V.SEVERITIES)), F.col("severity"))
    return literal_findings(spark).withColumn("place", F.row_number().over(Window.orderBy(rank, "id")).cast("long")).select("id", "place")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '''=' || p_name WHEN p_partkey % 5 = 1 THEN '-12.5' WHEN p_partkey % 5 = 2 THEN '''@x' ELSE p_name END AS cell FROM part")
def formula_escape(spark, sf):
    k = F.col("p_partkey")
    cell = F.when(k % 5 == 0, F.concat(F.lit("="), F.col("p_name"))).when(k % 5 == 1, F.lit("-12.5")).when(k % 5 == 2, F.lit("@x")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.escaped_formula(cell).alias("cell"))


@query("SELECT doc_id, length(text) AS n_points, length(text) - length(replace(text, ' ', '')) AS n_spaces, n_chars FROM documents")
def text_lengths(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(t).cast("long").alias("n_points"), (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))).cast("long").alias("n_spaces"), "n_chars")


__all__ = ["QUERIES", "ROW_ID", "SQL", "col", "filter_findings"]
