"""A table ready for analysis: unique names, NaN as null, one kind a column and a row coordinate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import unique_names
from .scratch import written

ROW_ID = "_row_id"
CASTS = {"int64": "BIGINT", "datetime64[ns]": "TIMESTAMP", "str": "STRING"}


@dataclass
class Frame:
    df: DataFrame
    kinds: dict[str, str]

    @property
    def columns(self) -> list[str]:
        return list(self.kinds)

    def text(self) -> list[str]:
        return [c for c, k in self.kinds.items() if k == "str"]

    def numeric(self) -> list[str]:
        return [c for c, k in self.kinds.items() if k in ("int64", "float64", "bool")]


def col(name: str) -> Column:
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def one_of(c: str, values) -> Column:
    """Whether an integer column is one of some. One text, as a call for each of hundreds of columns would take seconds."""
    some = ", ".join(str(int(v)) for v in values)
    return F.expr(f"{c} IN ({some})" if some else "false")


def number(frame: Frame, name: str) -> Column:
    """The column as a number: booleans count as 0 and 1, long integers stay exact."""
    c = col(name)
    return c.cast("int") if frame.kinds[name] == "bool" else c


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int64"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float64"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime64[ns]"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "str"
    return "other"


#: Nodes of a plan that leave every row in its partition and place, whatever columns are asked for.
STEADY = {"Project", "Filter", "SubqueryAlias", "View", "Union", "Generate", "LogicalRelation", "LogicalRDD", "LocalRelation", "Range", "InMemoryRelation", "ExternalRDD", "SerializeFromObject", "DeserializeToObject", "MapPartitions", "MapInPandas", "MapInArrow", "ArrowEvalPython", "BatchEvalPython", "DataSourceV2ScanRelation", "StreamingDataSourceV2ScanRelation", "OneRowRelation"}


def stays(df: DataFrame) -> bool:
    """Whether two runs of parts of ``df`` see the same rows in the same partitions and order."""
    plan = df._jdf.queryExecution().optimizedPlan()
    todo = [plan] if plan.deterministic() else []
    if not todo:
        return False
    while todo:
        p = todo.pop()
        if p.nodeName() not in STEADY:
            return False
        if p.nodeName() == "LogicalRelation" and p.relation().getClass().getSimpleName() == "HadoopFsRelation" and p.relation().bucketSpec().isDefined():
            return False  # read by bucket or not, as each query sees fit
        children = p.children()
        todo += [children.apply(k) for k in range(children.size())]
    return True


def canonical(df: DataFrame, row_id: str | None = None) -> Frame:
    """``df`` with text, number, boolean and timestamp columns only, and ``_row_id``.

    Row ids are ``row_id`` if that column is named, else positions from 0 in the
    order of the table's partitions: one count of each partition and no shuffle. A
    table that is more than a scan (a join, a sort, ...) is run once and written, as
    it may be dealt out otherwise each time it runs.
    Nested columns are analysed as JSON text for nulls and distinct values only.
    """
    kept = [i for i, c in enumerate(df.columns) if c != row_id]
    names = unique_names([df.columns[i] for i in kept])
    df = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    out, kinds, types = [], {}, [f.dataType for f in df.schema.fields]
    for i, name in zip(kept, names, strict=True):
        t, c = types[i], f"_c{i}"
        kind = kind_of(t)
        if kind == "float64":  # NaN as null, -0.0 as 0.0
            c = f"CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) + 0.0D END"
        elif kind in CASTS:
            c = f"CAST({c} AS {CASTS[kind]})"
        elif kind != "bool":
            c = f"hex({c})" if isinstance(t, T.BinaryType) else f"CASE WHEN {c} IS NOT NULL THEN to_json(named_struct('v', {c})) END"
        out.append(f"{c} AS {quoted(name)}")
        kinds[name] = kind
    if row_id is not None:
        rid = F.col(f"_c{[x for x in range(len(df.columns)) if x not in kept][0]}").cast("long")
    else:
        here = F.monotonically_increasing_id()
        if not stays(df):
            df = written(df.withColumn("_at", here), "rows")
            here = F.col("_at")
        part = F.shiftright(here, 33).cast("int")
        counts = {r[0]: r[1] for r in df.select(part.alias("p")).groupBy("p").count().collect()}
        rid = here
        if len(counts) > 1:
            start, at = [], 0
            for p in range(max(counts) + 1):
                start.append(at)
                at += counts.get(p, 0)
            rid = F.get(F.lit(start), part) + here.bitwiseAND(F.lit((1 << 33) - 1))
        elif max(counts, default=0):
            rid = here.bitwiseAND(F.lit((1 << 33) - 1))
    df = df.withColumn(ROW_ID, rid)
    return Frame(df.selectExpr(ROW_ID, *out), kinds)
