"""Tables that were shuffled, columns of many values, document tables, folders and the command line."""

import random

import pytest
from pyspark.sql import functions as F

import lakeassay
from lakeassay import cli
from lakeassay.plans import quantiles as Q
from lakeassay.plans.explore import filter_columns, filter_findings
from lakeassay.plans.frame import ROW_ID, canonical, stays
from lakeassay.sources import files


def positions(frame):
    return sorted(r[0] for r in frame.df.select(ROW_ID).collect())


def test_positions_of_shuffled_tables(spark):
    a = spark.range(0, 3000, 1, 3).withColumn("v", F.col("id") % 7)
    b = spark.range(0, 3000, 1, 4).withColumn("w", F.col("id") % 5)
    tables = {
        "scan": (a, True), "filtered": (a.where("v > 2").select("id"), True), "union": (a.select("id").union(b.select("id")), True),
        "joined": (a.join(b, "id"), False), "outer": (a.join(b.where("w = 1"), "id", "left"), False), "sorted": (a.orderBy("v", "id"), False),
        "dealt": (a.repartition(5, "v"), False), "grouped": (a.groupBy("v").count(), False), "cut": (a.limit(100), False), "random": (a.withColumn("r", F.rand()), False), "none": (a.where("id < 0"), True),
    }
    for name, (df, steady) in tables.items():
        assert stays(df) == steady, name
        got = positions(canonical(df))
        assert got == list(range(len(got))) and len(got) == df.count(), name


def test_positions_follow_an_order(spark):
    df = spark.range(0, 500, 1, 4).select((499 - F.col("id")).alias("k"), F.when(F.col("id") % 50 == 0, -5).otherwise(3).alias("visits")).orderBy("k")
    rows = {r.k: r[ROW_ID] for r in canonical(df).df.collect()}
    assert rows == {k: k for k in range(500)}
    (f,) = (f for f in lakeassay.investigate(df).findings if f.id == "FND-CNS-NEG-visits")
    assert f.evidence[0].sample_row_indices == [49 + 50 * k for k in range(10)]


def test_quantiles_by_range_equal_those_in_one_place(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, float(rng.choice([rng.randint(-50, 50), rng.random() * 1e6])), rng.randint(1, 9)) for k in (0, 1, 2) for _ in range(400)] + [(5, 1.5, 1), (6, 2.0, 3), (6, 4.0, 1)]
    df = spark.createDataFrame(rows, "key int, x double, n long").repartition(5)
    at = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    one = Q.quantiles(df, at, 10)
    monkeypatch.setattr(Q, "GATHERED", 1)
    many = Q.quantiles(df, at, 10)
    assert one.keys() == many.keys() == {0, 1, 2, 5, 6} and all(many[k] == pytest.approx(one[k]) for k in one)
    assert Q.quantiles(df.where("key > 9"), at, 10) == {}
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plain = lambda d: {k: v for k, v in d.to_dict().items() if k != "metadata"}
    by_range = plain(lakeassay.investigate(df))
    monkeypatch.undo()
    assert plain(lakeassay.investigate(df)) == by_range


HEAD = ["item", "price", "stock"]
DATA = [["a", "1.5", "2"], ["b", "2.5", "3"]]


def test_document_tables_take_data_only():
    long = "A sentence that goes on for far longer than any cell of a table of prices and stocks ever would do."
    join = lambda *more: files.primary_table([(0, [HEAD, *DATA]), *more])[1]
    assert join((1, [HEAD, ["c", "3", "4"]])) == [*DATA, ["c", "3", "4"]]
    assert join((1, [["c", "3", "4"], ["d", "4", "5"]])) == [*DATA, ["c", "3", "4"], ["d", "4", "5"]]
    assert join((1, [[long, long, long], [long, long, long]])) == DATA  # prose of two rows
    assert join((1, [["x\ny\nz\nw\nv", "x\ny\nz\nw\nv", "1"]])) == DATA  # one row of many lines
    assert join((1, [["c", None, ""], ["", None, "d"]])) == DATA  # too few cells
    assert join((1, [["c", "3", "4"]])) == [*DATA, ["c", "3", "4"]]
    assert join((0, [["c", "3", "4"]])) == DATA  # one row on the same page
    assert join((1, [HEAD])) == DATA
    assert join((1, [["c", "3"]])) == DATA and join((1, [["c", "3", "4", "5"]])) == DATA
    assert join((1, [["c", "3", "4"], [None, " ", ""], ["d", "4", "5"]])) == [*DATA, ["c", "3", "4"], ["d", "4", "5"]]
    assert files.primary_table([(0, [["title", "note"]]), (0, [[" item ", "price"], ["a ", "1"]])]) == (["item", "price"], [["a", "1"]])
    for tables in ([], [(0, [HEAD])], [(0, [["x"], ["y"]])], [(0, [HEAD, [None, "", " "]])]):
        with pytest.raises(ValueError):
            files.primary_table(tables)


def test_folders_and_limits(spark, tmp_path):
    folder = tmp_path / "part.csv"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.csv").write_text('nr,name\n' + "".join(f'{k * 10 + i},"n, {i}"\n' for i in range(5)))
    (folder / "_SUCCESS").write_text("")
    for options in ({}, {"multi_line": False}):
        got = files.load(spark, str(folder), **options)
        assert sorted((r.nr, r.name) for r in got.df.collect()) == [(k * 10 + i, f"n, {i}") for k in range(3) for i in range(5)]
        assert sorted(r[0] for r in got.df.select(files.LINE).collect()) == list(range(15))
    assert lakeassay.investigate_file(spark, str(folder)).metadata["row_count"] == 15
    (folder / "9.csv").write_text("nr,other\n1,2\n")
    with pytest.raises(ValueError, match="other columns"):
        files.load(spark, str(folder))
    path = str(tmp_path / "t.parquet")
    spark.range(20).withColumn("v", F.lit(1)).write.parquet(path)
    assert files.load(spark, path, max_rows=20, max_columns=2, max_bytes=1 << 20).df.count() == 20
    for limit in ({"max_rows": 19}, {"max_columns": 1}, {"max_bytes": 10}):
        with pytest.raises(ValueError):
            files.load(spark, path, **limit)
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="empty"):
        files.load(spark, str(tmp_path / "empty"))


def test_command_line_writes_and_refuses(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f"{i},x\n" for i in range(5)))
    out = tmp_path / "new" / "folder" / "report.json"
    assert cli.main([str(tmp_path / "t.csv"), "-o", str(out)]) == 0 and out.exists() and "5 rows" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "t.csv"), "-o", str(tmp_path / "t.csv")]) == 1
    assert cli.main([str(tmp_path / "t.csv"), "-o", str(tmp_path)]) == 1 and "could not be written" in capsys.readouterr().err


def test_looking_through_results(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(20)], "order_id long, note string")
    d = lakeassay.investigate(df)
    assert [r.id for r in filter_findings(d.findings_df(spark), category="completeness", search="NOTE").collect()] == ["FND-CMP-MISS-note"]
    assert filter_findings(d.findings_df(spark), severity="low", search="note").count() == 0
    assert [r.name for r in filter_columns(d.columns_df(spark), search="INT").collect()] == ["order_id"]
    assert filter_columns(d.columns_df(spark), name="note", semantic_type="identifier").count() == 0
    assert "| order_id | int64 | identifier | 0.0% | 20 (100.0%) | 9.50 | 9.50 | 5.92 | 0 to 19 | 0 |" in d.to_markdown()
