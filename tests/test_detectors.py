"""Each detector on a small table with a known answer."""

import math
import random

import pytest

from lakeassay import investigate
from lakeassay.functions import names as N
from lakeassay.functions import vocab as V


def run(spark, columns, target=None, row_id=None):
    """A table from {name: values}; a list that mixes int and float is float."""
    names = list(columns)
    types = []
    for values in columns.values():
        some = [v for v in values if v is not None]
        types.append("boolean" if some and isinstance(some[0], bool) else "string" if any(isinstance(v, str) for v in some) else "double" if not some or any(isinstance(v, float) for v in some) else "long")
    cast = [float if t == "double" else (lambda v: v) for t in types]
    rows = [tuple(None if v is None else c(v) for c, v in zip(cast, r)) for r in zip(*columns.values())]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, types)))
    return investigate(df, target, row_id)


def found(d):
    return {f.id: f for f in d.findings}


def test_missing_and_blank_cells(spark):
    d = run(spark, {"regular": [1.0, None, None, *map(float, range(7))], "words": ["a", "  ", "", *"bcdefgh"]})
    f = found(d)
    assert f["FND-CMP-MISS-regular"].affected_row_count == 2 and f["FND-CMP-MISS-regular"].severity == "medium"
    assert f["FND-CMP-MISS-words"].affected_row_count == 2 and f["FND-CMP-MISS-words"].evidence[0].sample_row_indices == [1, 2]


def test_lifecycle_names_soften_missing(spark):
    n = 11
    d = run(spark, {"termination_date": [None] * 10 + ["2024-01-01"], "payment_terms": [None] * 10 + ["30 days"], "row": list(range(10, 10 * (n + 1), 10))}, row_id="row")
    f = found(d)
    assert f["FND-CMP-MISS-termination_date"].severity == "info" and f["FND-CMP-MISS-payment_terms"].severity == "high"
    assert f["FND-CMP-MISS-payment_terms"].evidence[0].sample_row_indices == list(range(10, 110, 10))


def test_sentinels(spark):
    d = run(spark, {"feedback": ["good", "bad", "N/A", " unknown ", "?", "fine", "ok", "good", "bad", "ok"], "salary": [50, 60, 55, 58, 62, -999, 57, 59, 61, 60], "ratio": [1.0, 2.0, math.inf, -1.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]})
    f = found(d)
    assert f["FND-CMP-SENT-TXT-feedback"].affected_row_count == 3 and f["FND-CMP-SENT-TXT-feedback"].severity == "high"
    assert f["FND-CMP-SENT-NUM-salary--999"].affected_row_count == 1
    assert "FND-CMP-SENT-NUM-ratio--1" not in f  # nine finite values only


def test_columns_that_miss_together(spark):
    v = [None if 10 <= i <= 25 else f"v{i % 7}" for i in range(40)]
    f = found(run(spark, {"col_a": v, "col_b": [x and x + "b" for x in v], "col_c": [f"c{i % 9}" for i in range(40)]}))
    assert f["FND-CMP-COMISS-col_a-col_b"].affected_row_count == 16 and len([k for k in f if "COMISS" in k]) == 1


def test_repeated_rows(spark):
    f = found(run(spark, {"num": [1, 2, 3, 1, 4, 1, None], "name": ["a", "b", "c", "a", "d", "a", None]}))
    x = f["FND-UNQ-EXACT-DUPS"]
    assert x.affected_row_count == 2 and x.evidence[0].sample_row_indices == [0, 3, 5] and x.severity == "critical"
    both_null = found(run(spark, {"a": [None, None, "x"], "b": [1.0, 1.0, 2.0]}))
    assert both_null["FND-UNQ-EXACT-DUPS"].affected_row_count == 1


def test_key_collisions_and_nulls(spark):
    f = found(run(spark, {"employee_id": ["E1", "E2", "E2", "E3", "E4", "E5"], "name": list("abcdef"), "pay": [1, 2, 3, 4, 5, 6]}))
    x = f["FND-UNQ-PK-COLLISION-employee_id"]
    assert x.severity == "critical" and x.affected_row_count == 1 and x.evidence[0].sample_row_indices == [1, 2]
    nulls = found(run(spark, {"user_id": ["u1", None, "u3", "u4", "u5", "u6"], "v": [1, 1, 2, 2, 3, 3]}))
    assert nulls["FND-UNQ-PK-NULL-user_id"].severity == "critical" and nulls["FND-UNQ-PK-NULL-user_id"].recommendations[0].priority == "high"


def test_secondary_key_explained_by_the_first(spark):
    ids = [f"r{i}" for i in range(19)] + ["r0"]
    f = found(run(spark, {"record_id": ids, "user_code": [x.replace("r", "u") for x in ids], "v": list(range(20))}))
    assert "FND-UNQ-PK-COLLISION-record_id" in f and "FND-UNQ-PK-COLLISION-user_code" not in f


def test_foreign_keys_may_repeat(spark):
    n = 20
    f = found(run(spark, {"order_id": [f"o{i}" for i in range(n)], "customer_id": [f"c{i % 5}" for i in range(n)], "product_code": [f"p{i % 3}" for i in range(n)], "manager_id": [None if i % 4 else f"m{i % 8}" for i in range(n)]}))
    assert not [k for k in f if "PK" in k]


@pytest.mark.parametrize(("name", "yes"), [("user_id", True), ("customerCode", True), ("OrderNo", True), ("primaryKey", True), ("country_code", False), ("paid", False), ("validity", False), ("sort_key", False), ("number_of_orders", False), ("l_orderkey", False), ("HTTPUserID", True)])
def test_identifier_names(name, yes):
    assert N.is_identifier(name) == yes


def test_key_of_two_columns(spark):
    f = found(run(spark, {"a": [i // 10 for i in range(100)], "b": [i % 10 for i in range(100)], "c": ["x"] * 100}))
    assert "FND-UNQ-COMPOSITE-a-b" in f and f["FND-UNQ-COMPOSITE-a-b"].severity == "info"


def test_type_drift(spark):
    f = found(run(spark, {"weight": ["70", "71.5", "heavy", "68", "72", "1e2", " 65 ", "66", "nan", "64", "63"], "note": ["a", "1", "2", "b", "c", "d", "e", "f", "g", "h", "i"]}))
    assert f["FND-VAL-TYPEDRIFT-weight"].affected_row_count == 2 and f["FND-VAL-TYPEDRIFT-weight"].evidence[0].sample_values == ["heavy", "nan"]
    assert "FND-VAL-TYPEDRIFT-note" not in f


def test_date_forms(spark):
    d = ["2024-01-05", "2024-02-06", "2024-03-07", "05/01/2024", "2024-02-30", "2024-05-01 10:00:00", "someday", "2024-06-01", "2024-07-01", "2024-08-01"]
    x = found(run(spark, {"hire_date": d}))["FND-VAL-DATE-FORMAT-hire_date"]
    assert x.affected_row_count == 3 and x.evidence[0].observed_value == {"ISO_8601": 7, "SLASH_DMY": 1}
    assert not N.has_any("overtime_notes", V.DATE_NAMES)
    assert not found(run(spark, {"overtime_notes": [f"x {x}" if k % 3 else x for k, x in enumerate(d)]}))


def test_spellings(spark):
    x = found(run(spark, {"city": ["Paris", "paris", "PARIS", "Rome", "Rome", " Oslo", "Oslo", "Bern"]}))["FND-VAL-CAT-CASING-city"]
    assert x.affected_row_count == 3 and x.evidence[0].observed_value == [["PARIS", "Paris", "paris"]]


def test_outliers_and_skew(spark):
    f = found(run(spark, {"pay": [50, 52, 51, 53, 49, 48, 50, 51, 52, 50, 49, 51, 50, 5000]}))
    assert f["FND-DST-OUTLIER-pay"].affected_row_count == 1 and f["FND-DST-OUTLIER-pay"].severity == "high"
    flat = found(run(spark, {"level": [5] * 30 + [5, 6, 4, 90]}))
    assert flat["FND-DST-OUTLIER-level"].affected_row_count == 1


def test_first_digits(spark):
    rng = random.Random(1)
    nines = [float(f"9{rng.randint(0, 9)}") * 10 ** rng.randint(0, 3) for _ in range(60)]
    f = found(run(spark, {"transaction_amount": nines, "rating": [float(i % 5 + 1) for i in range(60)]}))
    assert "investigation is recommended" in f["FND-DST-BENFORD-transaction_amount"].title and "fraud" not in f["FND-DST-BENFORD-transaction_amount"].description
    assert "FND-DST-BENFORD-rating" not in f


def test_inversions(spark):
    f = found(run(spark, {"hire_date": ["2020-01-01", "2021-05-05", "2022-03-03"], "exit_date": ["2021-01-01", "2020-05-05", None]}))
    assert f["FND-CNS-TEMP-hire_date-exit_date"].affected_row_count == 1 and f["FND-CNS-TEMP-hire_date-exit_date"].evidence[0].sample_row_indices == [1]
    zones = found(run(spark, {"order_date": ["2024-01-01T10:00:00Z"] * 4 + ["2024-01-05T00:00:00+02:00"], "delivery_date": ["2024-01-02", "2024-01-01", "2023-12-31", "01/15/2024", "2024-01-04"]}))
    assert zones["FND-CNS-TEMP-order_date-delivery_date"].affected_row_count == 1  # by days, as deliveries have no time


def test_negative_amounts_by_name(spark):
    v = [1, 2, -3, 4, 5, 6]
    f = found(run(spark, {c: v for c in ("item_count", "customer_age", "user_age", "voltage", "shortage", "percentage")} | {"units": ["1", "-2", "x", "3", "4", "5"]}))
    assert {k for k in f if "NEG" in k} == {"FND-CNS-NEG-item_count", "FND-CNS-NEG-customer_age", "FND-CNS-NEG-user_age", "FND-CNS-NEG-units"} - ({"FND-CNS-NEG-item_count"} - set(f))


def test_bounds(spark):
    f = found(run(spark, {"price_min": [1, 9, 3], "price_max": ["5", "6", "x"]}))
    assert f["FND-CNS-BOUND-price_min-price_max"].affected_row_count == 1


def test_leakage(spark):
    y = [float(i) + (i % 3) * 0.01 for i in range(30)]
    f = found(run(spark, {"target_price": y, "signal": [2 * v + 1 for v in y], "curve": [v**5 for v in y], "noise": [float((i * 7919) % 31) for i in range(30)], "flat": [1.0] * 30}, "target_price"))
    assert f["FND-LKG-CORR-signal"].severity == "critical" and f["FND-LKG-CORR-curve"].severity == "critical" and not {"FND-LKG-CORR-noise", "FND-LKG-CORR-flat"} & set(f)
    t = ["yes", "no"] * 10
    g = found(run(spark, {"outcome": t, "proxy": [" YES" if x == "yes" else "No" for x in t], "code": ["a" if x == "yes" else "b" for x in t], "other": list("aabb") * 5}, "outcome"))
    assert g["FND-LKG-PROXY-proxy"].affected_row_ratio == 1.0 and g["FND-LKG-CRAMER-code"].severity == "high" and "FND-LKG-CRAMER-proxy" not in g and "FND-LKG-CRAMER-other" not in g


def test_roles(spark):
    n = 40
    d = run(spark, {"emp_id": [f"E{i}" for i in range(n)], "age": [20 + i % 12 for i in range(n)], "department": [f"D{i % 3}" for i in range(n)], "is_active": [i % 2 == 0 for i in range(n)], "notes": [f"a long remark about case {i} and its course" for i in range(n)], "score": [i / 7 for i in range(n)], "none": [None] * n, "day": [f"2024-01-{i % 28 + 1:02}" for i in range(n)]})
    roles = {c.name: c.semantic_type for c in d.columns}
    assert roles == {"emp_id": "identifier", "age": "numeric_discrete", "department": "categorical", "is_active": "boolean", "notes": "free_text", "score": "numeric_continuous", "none": "unknown", "day": "datetime"}
    c = {c.name: c for c in d.columns}
    assert c["emp_id"].is_candidate_identifier and c["age"].sample_values == [20, 21, 22, 23, 24] and not c["score"].is_constant_or_near_constant


def test_non_finite_numbers(spark):
    d = run(spark, {"all_nan": [math.nan] * 4, "mixed": [1.0, math.inf, math.nan, -math.inf], "same": [2.0] * 4, "one": [math.inf, 5.0, math.nan, math.nan]})
    c = {c.name: c for c in d.columns}
    assert c["all_nan"].null_count == 4 and c["mixed"].null_count == 1 and c["mixed"].unique_count == 3 and (c["mixed"].min_value, c["mixed"].max_value) == (1.0, 1.0)
    assert c["one"].std_dev is None and c["one"].mean == 5.0 and c["same"].is_constant_or_near_constant
    assert "Infinity" not in d.to_json() and "NaN" not in d.to_json()


def test_names_become_unique():
    assert N.unique_names(["id", "score", "score", ""]) == ["id", "score", "score_1", "col_4"]
    assert N.unique_names(["a", "a", "a_1"]) == ["a", "a_2", "a_1"]
    assert len(set(N.unique_names(["x"] * 5 + ["x_2"]))) == 6


def test_vocabulary_is_what_detectors_expect():
    assert len(V.TEXT_SENTINELS) == 15 and len(V.NUMERIC_SENTINELS) == 6 and len(V.NA_CELLS) == 19 and len(V.TEMPORAL_PAIRS) == 9


def test_tables_without_rows_or_with_a_wrong_target(spark):
    d = investigate(spark.createDataFrame([], "a long, b string"))
    assert d.metadata["row_count"] == 0 and d.trust_score.overall_score == 100.0 and not d.findings
    with pytest.raises(ValueError, match="no column"):
        investigate(spark.range(3), target="missing")


def test_nested_columns_are_profiled_only(spark):
    d = investigate(spark.createDataFrame([([1, 2], {"k": 1}, b"x"), ([1, 2], {"k": 2}, b"y"), (None, None, None)], "a array<int>, m map<string,int>, b binary"))
    assert [(c.non_null_count, c.unique_count) for c in d.columns] == [(2, 1), (2, 2), (2, 2)]
