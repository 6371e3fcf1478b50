"""Files as tables: delimited text, spreadsheets, PDF tables and what Spark reads itself.

Delimited text is read as strings by Spark's reader and typed by aggregates over
all of it, with the NA words of ``vocab.NA_CELLS``. Spreadsheets are read by the
standard library's zip and XML modules; they and PDF tables are of driver size by
nature. Limits of bytes and dimensions exist only if asked for.

A folder of delimited files of one kind is one table: the first file, by name, gives
the delimiter and the columns, and a file whose first line differs is refused. Text
without a quoted line break is read with ``multi_line=False``, which lets Spark split
a file among tasks; the default keeps a quoted line break within its cell.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..functions import names as N
from ..functions import vocab as V

DELIMITERS = ",\t;|"
HEAD = 8192
MAX_UNZIPPED = 250 << 20
LINE = "_line_"


@dataclass
class Loaded:
    df: DataFrame
    metadata: dict = field(default_factory=dict)
    row_id: str | None = None


def safe_name(name: str) -> str:
    """The last part of a path of either style, without control characters."""
    base = re.split(r"[/\\]", name)[-1]
    return re.sub(r"[\x00-\x1f\x7f]", "", base).strip() or "unnamed"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return fs, p


def data_files(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """The files that Spark's readers take from a path, by name, and their bytes: of a folder those directly in it,
    without hidden ones and those that begin with ``_``."""
    fs, p = _file_system(spark, path)
    status = fs.getFileStatus(p)
    if not status.isDirectory():
        return [path], status.getLen()
    some = [s for s in fs.listStatus(p) if s.isFile() and not s.getPath().getName().startswith((".", "_"))]
    return sorted(s.getPath().toString() for s in some), sum(s.getLen() for s in some)


def head(spark: SparkSession, path: str, n: int = HEAD) -> tuple[bytes, int]:
    """The first bytes and the size of a file on any file system that Spark reads."""
    fs, p = _file_system(spark, path)
    size = fs.getFileStatus(p).getLen()
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, size))), size
    finally:
        stream.close()


def detect(name: str, first: bytes) -> str:
    """csv, tsv, txt, xlsx, xls or pdf, by magic bytes before the name's ending; they must agree."""
    ending = PurePosixPath(name.lower()).suffix.lstrip(".")
    magic = "pdf" if first.startswith(b"%PDF") else "xlsx" if first.startswith(b"PK\x03\x04") else "xls" if first.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1") else None
    if magic:
        if ending in ("csv", "tsv", "txt") or (ending in ("pdf", "xlsx", "xls") and ending != magic):
            raise ValueError(f"{name} is a {magic} file by its first bytes")
        return magic
    if ending in ("pdf", "xlsx", "xls"):
        raise ValueError(f"{name} is no {ending} file by its first bytes")
    if b"\0" in first[:HEAD] and not first.startswith((b"\xff\xfe", b"\xfe\xff")):
        raise ValueError(f"{name} is binary")
    if ending not in ("csv", "tsv", "txt"):
        raise ValueError(f"files ending in .{ending} are not supported")
    return ending


def sniff(sample: str) -> str:
    """The delimiter of a text's beginning; a tab in the first line, else a comma, if none stands out."""
    try:
        return csv.Sniffer().sniff(sample[:4096], DELIMITERS).delimiter
    except csv.Error:
        lines = [x for x in sample.splitlines()[:50] if x.strip()]
        steady = [d for d in DELIMITERS if lines and (n := lines[0].count(d)) and sum(x.count(d) == n for x in lines) >= 0.8 * len(lines)]
        return steady[0] if steady else "\t" if lines and "\t" in lines[0] else ","


def text_delimiter(sample: str) -> str:
    """The delimiter of a .txt table; prose and text without a regular delimiter are refused."""
    lines = [x for x in sample.splitlines() if x.strip()][:10]
    if not lines:
        raise ValueError("the file is empty")
    seen = {d: sum(d in x for x in lines) for d in DELIMITERS}
    usable = [d for d, n in seen.items() if n >= max(1, len(lines) // 2)]
    if not usable:
        if all(re.search(r"\S(\t+|\s{2,})\S", x) for x in lines):
            return "\\s"
        raise ValueError("no delimiter is used regularly; this is no table")
    try:
        return csv.Sniffer().sniff(sample[:4096], "".join(usable)).delimiter
    except csv.Error:
        return max(usable, key=seen.get)


def read_delimited(spark: SparkSession, path: str, delimiter: str, encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """All cells as text, NA words as null, names unique. Rows are numbered in the file's order by a hidden column."""
    raw = spark.read.option("sep", delimiter).option("header", False).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("encoding", encoding).option("mode", "PERMISSIVE").option("inferSchema", False).option("ignoreLeadingWhiteSpace", False).option("nullValue", "").csv(path)
    raw = raw.withColumn(LINE, F.monotonically_increasing_id())
    first = raw.orderBy(LINE).limit(1).collect()
    if not first:
        raise ValueError("the file is empty")
    cols = raw.columns[:-1]
    names = N.unique_names([str(first[0][c] or "").lstrip("\ufeff") for c in cols])
    body = raw.where(F.col(LINE) > first[0][LINE])
    wide = F.lit(False)
    for c in cols:
        wide = wide | F.col(c).isNotNull()
    body = body.where(wide)
    return body.select(F.col(LINE).alias(LINE), *[F.when(~F.col(c).isin(*V.NA_CELLS), F.col(c)).alias(n) for c, n in zip(cols, names, strict=True)])


def read_folder(spark: SparkSession, files: list[str], delimiter: str, encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """As ``read_delimited`` for files that each begin with the same line of names; a file's first row goes."""
    first = next(csv.reader(io.StringIO(head(spark, files[0])[0].decode("utf-16" if encoding == "UTF-16" else "utf-8-sig", "replace")), delimiter=delimiter))
    schema = ", ".join(f"_c{k} string" for k in range(len(first)))
    read = spark.read.option("sep", delimiter).option("header", True).option("enforceSchema", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("encoding", encoding).option("nullValue", "")
    for f in files[1:]:
        other = next(csv.reader(io.StringIO(head(spark, f)[0].decode("utf-16" if encoding == "UTF-16" else "utf-8-sig", "replace")), delimiter=delimiter), [])
        if other != first:
            raise ValueError(f"{safe_name(f)} begins with other columns than {safe_name(files[0])}")
    raw = read.schema(schema).csv(files)
    cells = [F.col(f"_c{k}") for k in range(len(first))]
    return raw.where(F.coalesce(*cells).isNotNull()).select(F.monotonically_increasing_id().alias(LINE), *[F.when(~c.isin(*V.NA_CELLS), c).alias(n) for c, n in zip(cells, N.unique_names(first), strict=True)])


def read_spaced(spark: SparkSession, path: str) -> DataFrame:
    """A table aligned by two or more spaces or by tabs."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias(LINE), F.split(F.trim("value"), r"\s{2,}|\t+").alias("cells"))
    first = lines.orderBy(LINE).limit(1).collect()[0]
    names = N.unique_names(list(first.cells))
    return lines.where(F.col(LINE) > first[LINE]).select(LINE, *[F.when(~F.get("cells", F.lit(k)).isin(*V.NA_CELLS), F.get("cells", F.lit(k))).alias(n) for k, n in enumerate(names)])


def typed(df: DataFrame, keep: tuple[str, ...] = (LINE,)) -> DataFrame:
    """Columns whose every value is a boolean word, an integer or a number get that type; one without values is double.

    One aggregate over the whole text decides; an integer column with nulls is double.
    """
    names = [c for c in df.columns if c not in keep]
    aggs = []
    for k, c in enumerate(names):
        v = F.col(f"`{c}`")
        n = F.count(v)
        is_int = v.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$")
        is_num = v.rlike(X.NUMBER.replace("^", r"^\s*").replace("$", r"\s*$")) | F.lower(F.trim(v)).isin("inf", "-inf", "+inf", "infinity", "-infinity")
        aggs += [n.alias(f"n{k}"), F.count(F.when(v.isin("True", "False", "TRUE", "FALSE", "true", "false"), 1)).alias(f"b{k}"), F.count(F.when(is_int, 1)).alias(f"i{k}"), F.count(F.when(is_num, 1)).alias(f"f{k}")]
    got: dict = {"rows": df.count()}
    for lo in range(0, len(aggs), 80):
        got |= df.agg(*aggs[lo : lo + 80]).first().asDict()
    out = [F.col(c) for c in df.columns if c in keep]
    for k, c in enumerate(names):
        v, n = F.col(f"`{c}`"), got[f"n{k}"]
        if n == 0:
            v = v.try_cast("double")
        elif got[f"b{k}"] == n == got["rows"]:
            v = F.lower(v) == "true"
        elif got[f"i{k}"] == n == got["rows"]:
            v = F.trim(v).try_cast("long")
        elif got[f"f{k}"] == n:
            v = F.regexp_replace(F.lower(F.trim(v)), "^([+-]?)inf$", "$1infinity").try_cast("double")
        out.append(v.alias(c))
    return df.select(*out)


def sheet_cell(value, kind: str = ""):
    """A spreadsheet cell for a table: date-times as ``YYYY-MM-DD HH:MM:SS``, dates as ``YYYY-MM-DD``."""
    if hasattr(value, "hour"):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    return value.strftime("%Y-%m-%d") if hasattr(value, "strftime") else value


def xlsx_rows(content: bytes) -> tuple[list[list], str, list[str]]:
    """Cells of the first sheet that has any, its name, and all names. Numbers are int or float, dates text."""
    import datetime as dt
    import xml.etree.ElementTree as ET

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > MAX_UNZIPPED:
            raise ValueError("the workbook is larger than 250 MiB when unpacked")
        tree = lambda name: ET.fromstring(z.read(name)) if name in z.namelist() else None
        local = lambda e: e.tag.rpartition("}")[2]
        shared = [] if (s := tree("xl/sharedStrings.xml")) is None else ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in s if local(si) == "si"]
        dates: set[int] = set()
        if (styles := tree("xl/styles.xml")) is not None:
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter() if local(f) == "numFmt"}
            for group in (e for e in styles if local(e) == "cellXfs"):
                for k, xf in enumerate(group):
                    f = int(xf.get("numFmtId", 0))
                    if 14 <= f <= 22 or 45 <= f <= 47 or re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(f, "").lower())):
                        dates.add(k)
        book, rels = tree("xl/workbook.xml"), tree("xl/_rels/workbook.xml.rels")
        if book is None:
            raise ValueError("this zip file is no workbook")
        target = {r.get("Id"): r.get("Target") for r in rels} if rels is not None else {}
        sheets = []
        for e in book.iter():
            if local(e) == "sheet":
                rid = next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == "id"), None)
                t = target.get(rid, "").lstrip("/")
                sheets.append((e.get("name"), t if t.startswith("xl/") else f"xl/{t}"))

        def read(sheet) -> list[list]:
            rows: list[list] = []
            for r in (e for e in sheet.iter() if local(e) == "row"):
                at = int(r.get("r", len(rows) + 1)) - 1
                while len(rows) <= at:
                    rows.append([])
                for c in (e for e in r if local(e) == "c"):
                    letters = re.match(r"[A-Z]+", c.get("r", "")) or None
                    k = len(rows[at])
                    if letters:
                        k = 0
                        for ch in letters[0]:
                            k = k * 26 + ord(ch) - 64
                        k -= 1
                    while len(rows[at]) <= k:
                        rows[at].append(None)
                    raw = next((v.text for v in c if local(v) == "v"), None)
                    t = c.get("t", "n")
                    if t == "s" and raw is not None:
                        v = shared[int(raw)]
                    elif t == "inlineStr":
                        v = "".join(x.text or "" for x in c.iter() if local(x) == "t")
                    elif t == "b" and raw is not None:
                        v = raw == "1"
                    elif t in ("str", "e", "d") or raw is None:
                        v = raw
                    else:
                        v = float(raw)
                        if int(c.get("s", 0)) in dates:
                            v = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(v * 86400))
                            v = sheet_cell(v)
                        elif v.is_integer() and abs(v) < 2**53:
                            v = int(v)
                    rows[at][k] = None if v == "" else v
            return rows

        for name, part in sheets:
            sheet = tree(part)
            rows = [] if sheet is None else [r for r in read(sheet) if any(v is not None for v in r)]
            if len(rows) >= 1:
                return rows, name, [n for n, _ in sheets]
    raise ValueError("no sheet of the workbook has cells")


def xls_rows(content: bytes) -> tuple[list[list], str, list[str]]:
    """As ``xlsx_rows`` for the older binary format, by the optional package xlrd."""
    try:
        import xlrd
    except ImportError:
        raise RuntimeError("reading .xls files needs the optional package xlrd") from None
    book = xlrd.open_workbook(file_contents=content)

    def value(c):
        if c.ctype == xlrd.XL_CELL_DATE:
            return sheet_cell(xlrd.xldate_as_datetime(c.value, book.datemode))
        if c.ctype == xlrd.XL_CELL_BOOLEAN:
            return bool(c.value)
        if c.ctype == xlrd.XL_CELL_NUMBER:
            return int(c.value) if float(c.value).is_integer() and abs(c.value) < 2**53 else c.value
        return c.value if c.ctype == xlrd.XL_CELL_TEXT and c.value != "" else None

    for name in book.sheet_names():
        sheet = book.sheet_by_name(name)
        cells = ([value(c) for c in sheet.row(k)] for k in range(sheet.nrows))
        rows = [r for r in cells if any(v is not None for v in r)]
        if rows:
            return rows, name, book.sheet_names()
    raise ValueError("no sheet of the workbook has cells")


def rows_to_df(spark: SparkSession, header: list, rows: list[list]) -> DataFrame:
    """A small table of Python values: whole columns of one type keep it, mixed ones become text. Empty columns go."""
    width = max([len(header), *map(len, rows)])
    header = [*header, *[None] * (width - len(header))]
    rows = [[*r, *[None] * (width - len(r))] for r in rows]
    used = [k for k in range(width) if header[k] is not None or any(r[k] is not None for r in rows)]
    names = N.unique_names(["" if header[k] is None else str(header[k]) for k in used])
    cols, fields = [], []
    for name, k in zip(names, used, strict=True):
        values = [r[k] for r in rows]
        kinds = {type(v) for v in values if v is not None}
        if kinds and kinds <= {bool} and None not in values:
            t = T.BooleanType()
        elif kinds == {int} and None not in values:
            t = T.LongType()
        elif not kinds or kinds <= {int, float}:
            t, values = T.DoubleType(), [None if v is None else float(v) for v in values]
        else:
            t, values = T.StringType(), [None if v is None else str(v) for v in values]
        cols.append(values)
        fields.append(T.StructField(name, t))
    schema = T.StructType([T.StructField(LINE, T.LongType()), *fields])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(zip(*cols, strict=True))], schema)


def holds_data(table: list[list], least_cells: int = 4) -> bool:
    """Whether a table's cells are many, short and of few lines, as data are and prose is not. One row may hold two
    cells only; long cells pass in tables of five rows and more."""
    cells = [s for r in table for c in r if c is not None and (s := str(c).strip())]
    if len(cells) < (2 if len(table) == 1 else least_cells):
        return False
    lines, length = sum(c.count("\n") for c in cells) / len(cells), sum(map(len, cells)) / len(cells)
    return lines <= 2 and (length <= 80 or len(table) >= 5)


def primary_table(tables: list[tuple[int, list[list]]]) -> tuple[list, list[list]]:
    """Header and rows from a document's (page, table) lists: the first table of two rows that holds data, and what
    later ones of as many columns add to it.

    A later table has to hold data itself, and one of a single row has to stand on a later page. Repeated headers
    and rows without a cell are left out; rows have the header's length.
    """
    usable = [(p, t) for p, t in tables if t and len(t[0]) >= 2]
    main = next((k for k, (_, t) in enumerate(usable) if len(t) >= 2 and holds_data(t)), None)
    if main is None:
        raise ValueError("no table of data was found")
    page, first = usable[main]
    tidy = lambda r: [c.strip() if isinstance(c, str) else c for c in r]
    width, names = len(first[0]), ["" if c is None else str(c).strip() for c in first[0]]
    rows = list(first[1:])
    for p, t in usable[main + 1 :]:
        again = ["" if c is None else str(c).strip() for c in t[0]] == names
        if len(t[0]) == width and holds_data(t) and (len(t) > 1 or p > page):
            rows += t[1:] if again else t
    rows = [[*tidy(r)[:width], *[None] * (width - len(r))] for r in rows if any(c is not None and str(c).strip() for c in r)]
    if not rows:
        raise ValueError("no table of data was found")
    return tidy(first[0]), rows


def promoted(name: str, values: list) -> list:
    """Cells of a document's column as numbers if all are number literals, none has a leading zero and the name is no key's."""
    some = [v for v in values if v not in (None, "")]
    if not some or N.is_identifier(name) or any(re.match(r"[+-]?0[0-9]", str(v).strip()) for v in some) or not all(re.match(X.NUMBER, str(v).strip()) for v in some):
        return values
    whole = all(re.match(r"^[+-]?[0-9]+$", str(v).strip()) for v in some) and len(some) == len(values)
    return [None if v in (None, "") else int(v) if whole else float(v) for v in values]


def pdf_tables(content: bytes) -> tuple[list[tuple[int, list[list]]], int]:
    try:
        import pdfplumber
    except ImportError:
        raise RuntimeError("reading PDF files needs the optional package pdfplumber") from None
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [(k, t) for k, page in enumerate(pdf.pages) for t in page.extract_tables()], len(pdf.pages)


def pdf_frame(spark: SparkSession, tables: list[tuple[int, list[list]]]) -> DataFrame:
    header, rows = primary_table(tables)
    names = N.unique_names(["" if h is None else str(h) for h in header])
    width = len(names)
    cols = [promoted(n, [(r[k] if k < len(r) else None) for r in rows]) for k, n in enumerate(names)]
    return rows_to_df(spark, names, [list(r) for r in zip(*cols, strict=True)]) if rows and width else rows_to_df(spark, names, [])


def load(spark: SparkSession, path: str, fmt: str | None = None, max_bytes: int | None = None, max_rows: int | None = None, max_columns: int | None = None, multi_line: bool = True) -> Loaded:
    """A file, or a folder of files of one kind, as a table with its metadata.

    Formats that Spark reads (parquet, orc, json) pass to its readers. Limits hold for
    every format.
    """
    name = safe_name(path.rstrip("/"))
    native = ("parquet", "orc", "json")
    if fmt is None and PurePosixPath(name.lower()).suffix[1:] in native:
        fmt = PurePosixPath(name.lower()).suffix[1:]
    if fmt in native:
        meta = {"file_name": name, "file_type": fmt}
        if max_bytes is not None:
            meta["file_size_bytes"] = _within(name, data_files(spark, path)[1], max_bytes)
        return _bounded(Loaded(spark.read.format(fmt).load(path), meta), name, max_rows, max_columns)
    files, total = data_files(spark, path)
    if not total:
        raise ValueError(f"{name} is empty")
    _within(name, total, max_bytes)
    folder = files != [path]
    if folder:
        kinds = {PurePosixPath(f.lower()).suffix[1:] for f in files}
        if len(kinds) > 1:
            raise ValueError(f"{name} holds files of several kinds: {', '.join(sorted(kinds))}")
        if fmt is None and kinds <= set(native):
            return load(spark, path, next(iter(kinds)), max_bytes, max_rows, max_columns)
    first, _ = head(spark, files[0])
    fmt = fmt or detect(safe_name(files[0]), first)
    meta = {"file_name": name, "file_size_bytes": total, "file_type": fmt}
    if folder and fmt not in ("csv", "tsv", "txt"):
        raise ValueError(f"{name} is a folder; files of type {fmt} are read one by one")
    if fmt in ("csv", "tsv", "txt"):
        encoding = "UTF-16" if first.startswith((b"\xff\xfe", b"\xfe\xff")) else "UTF-8"
        sample = first.decode("utf-16" if encoding == "UTF-16" else "utf-8-sig", "replace")
        delimiter = text_delimiter(sample) if fmt == "txt" else sniff(sample)
        if folder and delimiter == "\\s":
            raise ValueError(f"{name} is a folder; tables aligned by white space are read one by one")
        if folder:
            df = read_folder(spark, files, delimiter, encoding, multi_line)
        else:
            df = read_spaced(spark, path) if delimiter == "\\s" else read_delimited(spark, path, delimiter, encoding, multi_line)
        df = typed(_numbered(df))
    elif fmt == "xlsx":
        rows, sheet, names = xlsx_rows(head(spark, path, total)[0])
        df = rows_to_df(spark, rows[0], rows[1:])
        meta |= {"sheet_name": sheet, "available_sheets": names}
    elif fmt == "pdf":
        tables, pages = pdf_tables(head(spark, path, total)[0])
        df = pdf_frame(spark, tables)
        meta |= {"table_index": 1, "page_count": pages}
    elif fmt == "xls":
        rows, sheet, names = xls_rows(head(spark, path, total)[0])
        df = rows_to_df(spark, rows[0], rows[1:])
        meta |= {"sheet_name": sheet, "available_sheets": names}
    else:
        raise ValueError(f"unknown format {fmt}")
    return _bounded(Loaded(df, meta, LINE), name, max_rows, max_columns)


def _within(name: str, total: int, max_bytes: int | None) -> int:
    if max_bytes is not None and total > max_bytes:
        raise ValueError(f"{name} has {total} bytes; the limit is {max_bytes}")
    return total


def _bounded(loaded: Loaded, name: str, max_rows: int | None, max_columns: int | None) -> Loaded:
    columns = [c for c in loaded.df.columns if c != loaded.row_id]
    if max_columns is not None and len(columns) > max_columns:
        raise ValueError(f"{name} has {len(columns)} columns; the limit is {max_columns}")
    if max_rows is not None and loaded.df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"{name} has more than {max_rows} rows")
    return loaded


def _numbered(df: DataFrame) -> DataFrame:
    """Line numbers from 0 without gaps: an offset for each partition, no shuffle."""
    part = F.shiftright(F.col(LINE), 33)
    got = {r.p: (r.lo, r.n) for r in df.groupBy(part.alias("p")).agg(F.min(LINE).alias("lo"), F.count(F.lit(1)).alias("n")).collect()}
    if not got:
        return df
    start, at = [], 0
    for p in range(max(got) + 1):
        lo, n = got.get(p, (0, 0))
        start.append(at - lo)
        at += n
    return df.withColumn(LINE, F.col(LINE) + F.get(F.lit(start), part.cast("int")))


def read_table(spark: SparkSession, name: str) -> Loaded:
    return Loaded(spark.table(name), {"file_name": name, "file_type": "table"})


def preview(df: DataFrame, n: int = 5) -> tuple[list[str], list]:
    """Names and the first rows."""
    return df.columns, [tuple(r) for r in df.limit(n).collect()]
