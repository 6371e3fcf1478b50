"""Each detector's findings in a flawed view, and files as tables, beside SQL that works the same out by itself.

A view is one text that Spark and DuckDB both read, with tables in braces. What runs
on it here is a whole investigation; the SQL has the detector's gate, severity and
count written anew.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vocab as V
from .plans.frame import ROW_ID, canonical
from .plans.investigate import investigate
from .plans.scratch import delete, new_path
from .sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "labels")


def view(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return spark.sql(text.format(**{t: f"parquet.`{sf}/{t}.parquet`" for t in TABLES}))


def plain(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


def detector(name: str, prefix: str, text: str, sql: str, target: str | None = None) -> None:
    """A query for the findings of ``text`` whose ids begin with ``prefix``; ``sql`` goes on from the view ``t``."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = investigate(view(spark, sf, text), target=target).findings_df(spark)
        return found.where(F.startswith("id", F.lit(prefix))).select("id", "severity", "affected_row_count", "affected_row_ratio")

    run.__name__ = name
    QUERIES[name], SQL[name] = run, f"WITH t AS ({plain(text)}) {sql}" if not sql.startswith(",") else f"WITH t AS ({plain(text)}){sql}"


def counted(c: str, hit: str) -> str:
    return f"SELECT '{c}' AS c, count(*) FILTER ({hit}) AS n, count(*) AS total FROM t"


_BLANK = r"regexp_replace({c}, '^\s+|\s+$', '', 'g') = ''"
detector(
    "finds_missing",
    "FND-CMP-MISS-",
    "SELECT event_id % 50 AS lane, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 9 = 1 THEN '  ' ELSE event_type END AS channel, CASE WHEN event_id % 3 <> 0 THEN NULL ELSE value END AS reading, CASE WHEN event_id % 10 < 9 THEN NULL ELSE 'gone' END AS exit_note, CASE WHEN event_id % 10 < 2 THEN NULL ELSE 'some' END AS cancel_note, CASE WHEN event_id % 30 = 0 THEN NULL ELSE event_type END AS hardly FROM {events}",
    ", m AS (" + " UNION ALL ".join([counted("channel", "channel IS NULL OR " + _BLANK.format(c="channel")), counted("reading", "reading IS NULL"), counted("exit_note", "exit_note IS NULL"), counted("cancel_note", "cancel_note IS NULL"), counted("hardly", "hardly IS NULL")]) + ") SELECT 'FND-CMP-MISS-' || c AS id, CASE WHEN c IN ('exit_note', 'cancel_note') THEN CASE WHEN n / total >= 0.5 THEN 'info' ELSE 'low' END WHEN n / total >= 0.5 THEN 'high' WHEN n / total >= 0.2 THEN 'medium' ELSE 'low' END AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM m WHERE n / total >= 0.05",
)
detector(
    "finds_text_sentinels",
    "FND-CMP-SENT-TXT-",
    "SELECT event_id % 50 AS lane, CASE WHEN event_id % 9 = 0 THEN ' N/A' WHEN event_id % 9 = 1 THEN '?' WHEN event_id % 9 = 2 THEN 'no sentinel' ELSE event_type END AS feedback, CASE WHEN event_id % 25 = 3 THEN 'Unknown' ELSE event_type END AS remark FROM {events}",
    ", m AS (" + " UNION ALL ".join(counted(c, f"lower(trim({c})) IN ({', '.join(repr(s) for s in V.TEXT_SENTINELS)})") for c in ("feedback", "remark")) + ") SELECT 'FND-CMP-SENT-TXT-' || c AS id, CASE WHEN n / total >= 0.1 THEN 'high' ELSE 'medium' END AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM m WHERE n > 0",
)
detector(
    "finds_numeric_sentinels",
    "FND-CMP-SENT-NUM-",
    "SELECT event_type AS kind, CASE WHEN event_id % 15 = 0 THEN -999.0 WHEN event_id % 50 = 1 THEN 9999.0 ELSE value END AS reading FROM {events}",
    ", s AS (SELECT unnest([9999, 99999, 999999, -1, -999, -9999]) AS s), g AS (SELECT s, (SELECT count(*) FROM t) AS total, (SELECT count(*) FROM t WHERE reading = s) AS n, (SELECT quantile_cont(reading, 0.25) FROM t WHERE reading <> s) AS a, (SELECT quantile_cont(reading, 0.75) FROM t WHERE reading <> s) AS b, (SELECT avg((reading >= 0)::INT) FROM t WHERE reading <> s) AS p FROM s) SELECT 'FND-CMP-SENT-NUM-reading-' || s AS id, CASE WHEN n / total > 0.05 THEN 'high' ELSE 'medium' END AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM g WHERE n > 0 AND ((s < 0 AND p > 0.95) OR (b > a AND (s < a - 3 * (b - a) OR s > b + 3 * (b - a))))",
)
detector(
    "finds_co_missing",
    "FND-CMP-COMISS-",
    "SELECT event_type AS kind, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS first_note, CASE WHEN event_id % 7 = 0 AND event_id % 98 <> 0 THEN NULL ELSE user_id END AS second_ref, CASE WHEN event_id % 7 = 1 THEN NULL ELSE event_type END AS third_note FROM {events}",
    ", m AS (SELECT count(*) AS total, count(*) FILTER (first_note IS NULL AND second_ref IS NULL) AS n, count(*) FILTER (first_note IS NULL OR second_ref IS NULL) AS u FROM t) SELECT 'FND-CMP-COMISS-first_note-second_ref' AS id, 'medium' AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM m WHERE n >= 5 AND n / u >= 0.9",
)
detector(
    "finds_repeated_rows",
    "FND-UNQ-EXACT-DUPS",
    "SELECT o_custkey, o_orderstatus, o_orderpriority FROM {orders}",
    ", g AS (SELECT count(*) AS n FROM t GROUP BY ALL), m AS (SELECT sum(n) AS total, sum(n - 1)::BIGINT AS n FROM g) SELECT 'FND-UNQ-EXACT-DUPS' AS id, CASE WHEN n / total >= 0.1 THEN 'critical' WHEN n / total >= 0.02 THEN 'high' ELSE 'medium' END AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM m WHERE n > 0".replace("GROUP BY ALL", "GROUP BY o_custkey, o_orderstatus, o_orderpriority"),
)
detector(
    "finds_key_collisions",
    "FND-UNQ-PK-COLLISION-",
    "SELECT CASE WHEN o_orderkey % 20 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS record_id, o_custkey AS buyer, o_totalprice AS total FROM {orders}",
    ", m AS (SELECT count(record_id) - count(DISTINCT record_id) AS n, count(DISTINCT record_id) / count(*) AS share, count(*) AS total FROM t) SELECT 'FND-UNQ-PK-COLLISION-record_id' AS id, 'critical' AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM m WHERE n > 0 AND share >= 0.8",
)
detector(
    "finds_empty_keys",
    "FND-UNQ-PK-NULL-",
    "SELECT CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey END AS record_id, o_custkey AS buyer FROM {orders}",
    ", m AS (SELECT count(*) - count(record_id) AS n, count(*) AS total FROM t) SELECT 'FND-UNQ-PK-NULL-record_id' AS id, CASE WHEN n / total > 0.05 THEN 'critical' ELSE 'high' END AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM m WHERE n > 0",
)
detector(
    "finds_pair_keys",
    "FND-UNQ-COMPOSITE-",
    "SELECT o_orderkey % 100 AS bay, CAST(floor(o_orderkey / 100) AS BIGINT) AS shelf, o_orderpriority AS urgency FROM {orders}",
    ", m AS (SELECT count(*) AS total, (SELECT count(*) FROM (SELECT DISTINCT bay, shelf FROM t)) AS pairs, greatest(count(DISTINCT bay), count(DISTINCT shelf), count(DISTINCT urgency)) AS most FROM t) SELECT 'FND-UNQ-COMPOSITE-bay-shelf' AS id, 'info' AS severity, 0::BIGINT AS affected_row_count, 0.0::DOUBLE AS affected_row_ratio FROM m WHERE pairs = total AND most < total",
)
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
detector(
    "finds_type_drift",
    "FND-VAL-TYPEDRIFT-",
    "SELECT o_orderpriority AS urgency, CASE WHEN o_orderkey % 10 = 0 THEN 'pending' WHEN o_orderkey % 10 = 1 THEN '12x' WHEN o_orderkey % 10 = 2 THEN ' 7.5e1 ' WHEN o_orderkey % 10 = 3 THEN NULL ELSE CAST(o_custkey AS STRING) END AS amount FROM {orders}",
    f", m AS (SELECT count(*) FILTER (NOT regexp_matches(trim(amount), '{_NUMBER}')) AS n, count(amount) AS filled, count(*) AS total FROM t) SELECT 'FND-VAL-TYPEDRIFT-amount' AS id, 'high' AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM m WHERE n > 0 AND (filled - n) / filled >= 0.6",
)
_DAY, _MONTH = (f"lpad(CAST(event_id % {k} + 1 AS STRING), 2, '0')" for k in (28, 12))
detector(
    "finds_date_forms",
    "FND-VAL-DATE-FORMAT-",
    f"SELECT event_type AS kind, CASE WHEN event_id % 8 = 0 THEN {_DAY} || '/' || {_MONTH} || '/2024' WHEN event_id % 8 = 1 THEN '2024/' || {_MONTH} || '/' || {_DAY} WHEN event_id % 8 = 2 THEN {_DAY} || '.' || {_MONTH} || '.2024' WHEN event_id % 8 = 3 THEN NULL WHEN event_id % 8 = 4 THEN 'soon' ELSE '2024-' || {_MONTH} || '-' || {_DAY} END AS due_date FROM {{events}}",
    ", f AS (SELECT CASE WHEN due_date LIKE '2024-%' THEN 1 WHEN due_date LIKE '2024/%' THEN 2 WHEN due_date LIKE '__/%' THEN 3 WHEN due_date LIKE '__.%' THEN 4 END AS form, count(*) AS n FROM t GROUP BY 1), m AS (SELECT (SELECT count(due_date) FROM t) - max(n) AS n, count(*) AS forms, (SELECT count(*) FROM t) AS total FROM f WHERE form IS NOT NULL) SELECT 'FND-VAL-DATE-FORMAT-due_date' AS id, 'medium' AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM m WHERE forms > 1 AND n / total >= 0.02",
)
detector(
    "finds_spellings",
    "FND-VAL-CAT-CASING-",
    "SELECT o_custkey AS buyer, CASE WHEN o_orderkey % 4 = 0 THEN upper(o_orderstatus || 'x') WHEN o_orderkey % 4 = 1 THEN lower(o_orderstatus || 'x') WHEN o_orderkey % 4 = 2 THEN ' ' || o_orderstatus || 'x' ELSE o_orderpriority END AS state FROM {orders}",
    ", v AS (SELECT lower(trim(state)) AS g, trim(state) AS w FROM t GROUP BY 1, 2), c AS (SELECT w FROM v WHERE g IN (SELECT g FROM v GROUP BY g HAVING count(*) > 1)), m AS (SELECT count(*) FILTER (state IN (SELECT w FROM c)) AS n, count(*) AS total FROM t) SELECT 'FND-VAL-CAT-CASING-state' AS id, 'medium' AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM m WHERE n > 0",
)
_FAR = ", q AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b, median({c}) AS md, max({c}) AS top FROM t), d AS (SELECT median(abs({c} - md)) AS mad FROM t, q), w AS (SELECT *, CASE WHEN b > a THEN a - 3 * (b - a) WHEN mad > 0 THEN md - 5 * mad ELSE md - 1 END AS lo, CASE WHEN b > a THEN b + 3 * (b - a) WHEN mad > 0 THEN md + 5 * mad ELSE md + 1 END AS hi FROM q, d), o AS (SELECT count(*) FILTER ({c} < lo OR {c} > hi) AS n, count(*) AS total, any_value(CASE WHEN b > a THEN (top - b) / (b - a) ELSE 0 END) AS far FROM t, w)"
_OUT = " SELECT 'FND-DST-OUTLIER-{c}' AS id, CASE WHEN far > 10 THEN 'high' ELSE 'medium' END AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM o WHERE n > 0 AND (n / total <= 0.1 OR n <= 2)"
detector("finds_outliers", "FND-DST-OUTLIER-", "SELECT event_type AS kind, CASE WHEN event_id % 200 = 7 THEN value * 1000 + 5000 ELSE value END AS weight FROM {events}", _FAR.format(c="weight") + _OUT.format(c="weight"))
detector("finds_outliers_of_flat_columns", "FND-DST-OUTLIER-", "SELECT event_type AS kind, CASE WHEN event_id % 40 = 0 THEN value + 20 ELSE 5.0 END AS weight FROM {events}", _FAR.format(c="weight") + _OUT.format(c="weight"))
detector(
    "finds_skew",
    "FND-DST-SKEW-",
    "SELECT event_type AS kind, CASE WHEN event_id % 50 = 0 THEN 1.0 WHEN event_id % 50 = 1 THEN 0.5 ELSE 0.0 END AS share FROM {events}",
    _FAR.format(c="share") + ", u AS (SELECT avg(share) AS mu FROM t), s AS (SELECT avg((share - mu) ** 3) / avg((share - mu) ** 2) ** 1.5 AS skew FROM t, u) SELECT 'FND-DST-SKEW-share' AS id, 'low' AS severity, 0::BIGINT AS affected_row_count, 0.0::DOUBLE AS affected_row_ratio FROM o, s WHERE n = 0 AND abs(skew) > 4",
)
detector(
    "finds_odd_first_digits",
    "FND-DST-BENFORD-",
    "SELECT event_type AS kind, CAST(9 * power(10, event_id % 4) + (event_id % 7) * 0.1 AS DOUBLE) AS payment_amount, CAST(power(10, (event_id % 4000) * 0.001) AS DOUBLE) AS cost FROM {events}",
    "".join(f", {c[0]} AS (SELECT sum(abs(coalesce(n, 0) / (SELECT count(*) FROM t) - log10(1 + 1 / d))) / 9 AS off FROM (SELECT unnest(range(1, 10)) AS d) LEFT JOIN (SELECT format('{{:.10e}}', {c})[1]::INT AS digit, count(*) AS n FROM t GROUP BY 1) ON digit = d)" for c in ("payment_amount", "cost")) + " " + " UNION ALL ".join(f"SELECT 'FND-DST-BENFORD-{c}' AS id, 'medium' AS severity, 0::BIGINT AS affected_row_count, 0.0::DOUBLE AS affected_row_ratio FROM {c[0]} WHERE off > 0.025" for c in ("payment_amount", "cost")),
)
_DATES = ", h AS (SELECT bool_or(date_trunc('day', order_date) <> order_date) AS a, bool_or(date_trunc('day', ship_date) <> ship_date) AS b FROM t), m AS (SELECT count(*) FILTER (ship_date < CASE WHEN a AND NOT b THEN date_trunc('day', order_date) ELSE order_date END) AS n, count(*) AS total FROM t, h) SELECT 'FND-CNS-TEMP-order_date-ship_date' AS id, 'critical' AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM m WHERE n > 0"
detector("finds_inverted_dates", "FND-CNS-TEMP-", "SELECT l_quantity AS pieces, o_orderdate AS order_date, CASE WHEN l_orderkey % 40 = 0 THEN o_orderdate - INTERVAL 3 DAY ELSE l_shipdate END AS ship_date FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey", _DATES)
detector("finds_inverted_days", "FND-CNS-TEMP-", "SELECT event_type AS kind, ts AS order_date, date_trunc('day', CASE WHEN event_id % 40 = 0 THEN ts - INTERVAL 3 DAY ELSE ts END) AS ship_date FROM {events}", _DATES)
detector(
    "finds_negatives",
    "FND-CNS-NEG-",
    "SELECT c_mktsegment AS segment, c_acctbal AS balance_units, CASE WHEN c_custkey % 11 = 0 THEN '-3' ELSE '4' END AS visits, c_acctbal AS voltage FROM {customer}",
    ", m AS (" + " UNION ALL ".join([counted("balance_units", "balance_units < 0"), counted("visits", "visits::INT < 0")]) + ") SELECT 'FND-CNS-NEG-' || c AS id, 'high' AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM m WHERE n > 0",
)
detector(
    "finds_crossed_bounds",
    "FND-CNS-BOUND-",
    "SELECT p_brand AS brand, CAST(p_size * 40 AS DOUBLE) AS price_min, p_retailprice AS price_max FROM {part}",
    ", m AS (" + counted("x", "price_min > price_max") + ") SELECT 'FND-CNS-BOUND-price_min-price_max' AS id, 'high' AS severity, n AS affected_row_count, round(n / total, 4) AS affected_row_ratio FROM m WHERE n > 0",
)
detector(
    "finds_proxies",
    "FND-LKG-PROXY-",
    "SELECT o_totalprice AS total, CASE WHEN o_orderkey % 33 = 0 THEN 'other' WHEN o_orderkey % 2 = 0 THEN ' ' || lower(o_orderpriority) ELSE o_orderpriority END AS copied, CASE WHEN o_orderkey % 10 = 0 THEN 'other' ELSE o_orderpriority END AS nearly, o_orderpriority AS urgency FROM {orders}",
    ", m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) AS total, count(*) FILTER (lower(trim({c})) = lower(trim(urgency))) / count(*) AS rate FROM t" for c in ("copied", "nearly")) + ") SELECT 'FND-LKG-PROXY-' || c AS id, 'critical' AS severity, floor(rate * total)::BIGINT AS affected_row_count, round(rate, 4) AS affected_row_ratio FROM m WHERE rate >= 0.95",
    "urgency",
)
detector(
    "finds_correlates",
    "FND-LKG-CORR-",
    "SELECT l_returnflag AS flag, l_extendedprice AS gross, l_extendedprice * (1 - l_discount) AS net, power(l_extendedprice, 5) AS steep, l_quantity AS pieces FROM {lineitem}",
    ", x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS a, gross AS b FROM t" for c in ("net", "steep", "pieces")) + "), r AS (SELECT c, a, b, rank() OVER (PARTITION BY c ORDER BY a) + (count(*) OVER (PARTITION BY c, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY c ORDER BY b) + (count(*) OVER (PARTITION BY c, b) - 1) / 2 AS rb FROM x), m AS (SELECT c, count(*) AS n, greatest(abs(corr(a, b)), abs(corr(ra, rb))) AS top FROM r GROUP BY c) SELECT 'FND-LKG-CORR-' || c AS id, CASE WHEN top >= 0.98 THEN 'critical' ELSE 'high' END AS severity, n AS affected_row_count, 1.0::DOUBLE AS affected_row_ratio FROM m WHERE top >= 0.95",
    "gross",
)
detector(
    "finds_associates",
    "FND-LKG-CRAMER-",
    "SELECT o_totalprice AS total, 'band ' || substr(o_orderpriority, 1, 1) AS band, o_orderstatus AS status, o_orderpriority AS urgency FROM {orders}",
    ", m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, sqrt(greatest(0, sum(n * n / (na * nb)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)) AS v, sum(n)::BIGINT AS n FROM (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM (SELECT {c} AS a, urgency AS b, count(*) AS n FROM t GROUP BY 1, 2))" for c in ("band", "status")) + ") SELECT 'FND-LKG-CRAMER-' || c AS id, 'high' AS severity, n AS affected_row_count, 1.0::DOUBLE AS affected_row_ratio FROM m WHERE round(v, 12) >= 0.95",
    "urgency",
)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# Row coordinates


@query("SELECT c_custkey AS row_id, 'FND-CNS-NEG-balance_units' AS id FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 10")
def evidence_rows(spark, sf):
    """The first rows behind a finding, by a column of the caller's, from a table that was shuffled before."""
    df = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("nr"), F.col("c_acctbal").alias("balance_units"), F.col("c_mktsegment").alias("segment")).repartition(5, "segment")
    return investigate(df, row_id="nr").findings_df(spark).where("id = 'FND-CNS-NEG-balance_units'").select(F.explode("sample_row_indices").alias("row_id"), "id")


@query("SELECT count(*) AS n_rows, 0::BIGINT AS first_row, count(*) - 1 AS last_row, count(*) AS distinct_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def row_positions(spark, sf):
    """Positions in a joined table are the numbers from 0, each once."""
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("lineitem", "orders")}
    frame = canonical(t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")))
    return frame.df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(ROW_ID).alias("first_row"), F.max(ROW_ID).alias("last_row"), F.count_distinct(ROW_ID).alias("distinct_rows"))


# Files


def put(spark: SparkSession, path: str, content: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def from_file(spark: SparkSession, name: str, content: bytes, **options) -> DataFrame:
    folder = new_path(spark, "file")
    put(spark, f"{folder}/{name}", content)
    df = files.load(spark, f"{folder}/{name}", **options).df
    rows = df.drop(files.LINE).collect()  # a small file
    delete(spark, folder)
    return spark.createDataFrame(rows, df.drop(files.LINE).schema)


def nations(spark: SparkSession, sf: str) -> list[tuple]:
    """Some 25 rows: a key, a name with every delimiter, an amount and a day that some rows lack."""
    rows = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").collect()
    return [(r.n_nationkey, f"{r.n_name}, a|b;c", None if r.n_nationkey % 5 == 0 else r.n_regionkey + 0.5, "" if r.n_nationkey % 7 == 0 else f"2024-01-{r.n_nationkey + 1:02d}") for r in rows]


NATIONS = "SELECT n_nationkey::BIGINT AS nation_key, n_name || ', a|b;c' AS name, CASE WHEN n_nationkey % 5 <> 0 THEN n_regionkey + 0.5::DOUBLE END AS amount, CASE WHEN n_nationkey % 7 <> 0 THEN '2024-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') END AS day FROM nation"
HEADER = ("nation_key", "name", "amount", "day")


def delimited(rows: list[tuple], sep: str, none: str = "NA") -> bytes:
    import csv

    out = io.StringIO()
    w = csv.writer(out, delimiter=sep)
    w.writerow(HEADER)
    w.writerows([[none if v is None else v for v in r] for r in rows])
    return out.getvalue().encode()


@query(NATIONS)
def source_csv(spark, sf):
    return from_file(spark, "nations.csv", b"\xef\xbb\xbf" + delimited(nations(spark, sf), ","))


@query(NATIONS)
def source_tsv(spark, sf):
    return from_file(spark, "nations.tsv", delimited(nations(spark, sf), "\t", "null"), multi_line=False)


@query(NATIONS.replace("', a|b;c'", "''"))
def source_txt(spark, sf):
    return from_file(spark, "nations.txt", delimited([(k, n.split(",")[0], a, d) for k, n, a, d in nations(spark, sf)], "|", ""))


@query(NATIONS.replace("', a|b;c'", "''").replace("CASE WHEN n_nationkey % 7 <> 0 THEN '2024-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') END AS day", "'d' || n_regionkey::VARCHAR AS day"))
def source_aligned_txt(spark, sf):
    rows = [HEADER, *((str(k), n.split(",")[0], "NA" if a is None else str(a), None) for k, n, a, _ in nations(spark, sf))]
    regions = [r[0] for r in spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").select("n_regionkey").collect()]
    rows = [rows[0], *((*r[:3], f"d{g}") for r, g in zip(rows[1:], regions, strict=True))]
    return from_file(spark, "nations.txt", "\n".join("".join(f"{c:<24}  " for c in r).rstrip() for r in rows).encode())


def workbook(sheets: dict[str, list[tuple]]) -> bytes:
    """A small .xlsx file: numbers as numbers, texts in place."""
    cell = lambda v: "" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    letters = "ABCDEFGHIJ"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook xmlns:r='r'><sheets>" + "".join(f"<sheet name='{n}' r:id='r{k}'/>" for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f"<Relationship Id='r{k}' Target='worksheets/s{k}.xml'/>" for k in range(len(sheets))) + "</Relationships>")
        for k, rows in enumerate(sheets.values()):
            body = "".join(f"<row r='{i}'>" + "".join(cell(v).replace("<c", f"<c r='{letters[j]}{i}'", 1) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


@query(NATIONS)
def source_xlsx(spark, sf):
    rows = [tuple(None if v == "" else v for v in r) for r in nations(spark, sf)]
    return from_file(spark, "nations.xlsx", workbook({"none": [], "nations": [HEADER, *rows]}))


@query(NATIONS.replace("CASE WHEN n_nationkey % 7 <> 0 THEN '2024-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') END AS day", "lpad(n_nationkey::VARCHAR, 3, '0') AS day").replace("n_nationkey::BIGINT", "n_nationkey::VARCHAR"))
def source_document_tables(spark, sf):
    """Tables of a document over three pages: a header repeated, a row alone, prose in between, blank rows."""
    rows = [[str(k), n, None if a is None else f" {a} ", f"{k:03d}"] for k, n, a, _ in nations(spark, sf)]
    prose = ["A long remark that goes on well beyond what any cell of this table would ever hold, as prose does.", "So does this one, and it goes on over as many words as the other one does before it comes to an end."]
    tables = [(0, [["Title", "Note"]]), (0, [list(HEADER), *rows[:10], [None, "", " ", None]]), (1, [list(HEADER), *rows[10:20]]), (1, [[prose[0], prose[0], prose[1], None]]), (1, [[*prose, *prose], [*prose, *prose]]), (2, rows[20:24]), (2, [rows[24]]), (2, [["one", "cell"]])]
    return files.pdf_frame(spark, tables).drop(files.LINE)


@query("SELECT c_custkey AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def source_folder(spark, sf):
    """A folder of CSV files that Spark wrote, read back in splittable form."""
    folder = new_path(spark, "customers.csv")
    spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").repartition(3).write.option("header", True).csv(folder)
    return files.load(spark, folder, multi_line=False).df.drop(files.LINE)


@query("SELECT 'nations.csv' AS name, 'csv' AS kind, ',' AS delimiter UNION ALL SELECT 'nations.tsv', 'tsv', chr(9) UNION ALL SELECT 'nations.txt', 'txt', '|' UNION ALL SELECT 'list.txt', 'refused', 'refused' UNION ALL SELECT 'fake.csv', 'refused', 'refused' UNION ALL SELECT 'nul.csv', 'refused', 'refused'")
def source_detection(spark, sf):
    """What a file's first bytes say; texts without a table, binary files and wrong endings are refused."""
    rows = nations(spark, sf)
    cases = {"nations.csv": delimited(rows, ","), "nations.tsv": delimited(rows, "\t"), "nations.txt": delimited([(k, n.split(",")[0], a, d) for k, n, a, d in rows], "|"), "list.txt": b"just some words of prose here\nand then some more of it\n", "fake.csv": workbook({"a": [("x",)]}), "nul.csv": b"a,b\n\0,2\n"}
    out = []
    for name, content in cases.items():
        try:
            kind = files.detect(name, content[: files.HEAD])
            out.append((name, kind, (files.text_delimiter if kind == "txt" else files.sniff)(content.decode())))
        except ValueError:
            out.append((name, "refused", "refused"))
    return spark.createDataFrame(out, "name string, kind string, delimiter string")
