"""``.xlsx`` workbooks as a Spark data source: a folder of workbooks is one table.

Each workbook is one input partition, read row by row on an executor (the format itself ends a
sheet at 1,048,576 rows). Cells arrive as text; dates as ISO text. Listing and schema run on the
driver; the folder must be reachable as a file path on every executor.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that show dates or times.
DATE_FORMAT_IDS = frozenset({*range(14, 23), *range(45, 48)})
EPOCH = datetime(1899, 12, 30)


def workbook_paths(path: str) -> list[str]:
    local = re.sub(r"^file:(//)?", "", path)
    if os.path.isdir(local):
        return sorted(glob.glob(os.path.join(local, "*.xlsx")))
    return sorted(glob.glob(local))


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in root.iter(f"{MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell style numbers that show a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dated = set(DATE_FORMAT_IDS)
    for fmt in root.iter(f"{MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        if re.search("[ymdhs]", code, re.IGNORECASE):
            dated.add(int(fmt.get("numFmtId")))
    cells = root.find(f"{MAIN}cellXfs")
    return {i for i, xf in enumerate(cells if cells is not None else []) if int(xf.get("numFmtId", 0)) in dated}


def _sheet_part(book: zipfile.ZipFile, sheet_name: str | None) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets")
    wanted = [s for s in sheets if sheet_name is None or s.get("name") == sheet_name]
    if not wanted:
        raise ValueError(f"Worksheet named {sheet_name!r} not found")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == wanted[0].get(f"{REL}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _column_number(reference: str) -> int:
    number = 0
    for ch in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(ch) - 64
    return number - 1


def _cell_text(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    raw = cell.findtext(f"{MAIN}v")
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind in ("str", "e", "d"):
        return raw
    if int(cell.get("s", 0)) in dates:
        moment = EPOCH + timedelta(seconds=round(float(raw) * 86400))
        return moment.strftime("%Y-%m-%d" if moment.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
    return raw[:-2] if raw.endswith(".0") else raw


def sheet_rows(path: str, sheet_name: str | None, skip_rows: int) -> Iterator[list[str | None]]:
    """Rows of one sheet after the first ``skip_rows``, streamed; blank rows are left out."""
    with zipfile.ZipFile(path) as book:
        shared, dates = _shared_strings(book), _date_styles(book)
        with book.open(_sheet_part(book, sheet_name)) as part:
            position = 0
            for _, element in ElementTree.iterparse(part):
                if element.tag != f"{MAIN}row":
                    continue
                position = int(element.get("r", position + 1))
                values: list[str | None] = []
                for cell in element.iter(f"{MAIN}c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else len(values)
                    values.extend([None] * (at - len(values)))
                    values.append(_cell_text(cell, shared, dates))
                element.clear()
                if position > skip_rows and any(v not in (None, "") for v in values):
                    yield values


class WorkbookPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names = schema.names
        self.sheet = options.get("sheet") or None
        self.skip = int(options.get("skip_rows", 0))
        self.path = options["path"]

    def partitions(self):
        return [WorkbookPartition(p) for p in workbook_paths(self.path)]

    def read(self, partition):
        rows = sheet_rows(partition.path, self.sheet, self.skip)
        header = next(rows, None)
        if header is None:
            return
        place = {name: i for i, name in enumerate(header) if name is not None}
        missing = [n for n in self.names if n not in place]
        if missing:
            raise ValueError(f"{partition.path} has no column {missing[0]!r}")
        order = [place[n] for n in self.names]
        for row in rows:
            yield tuple(row[i] if i < len(row) else None for i in order)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self):
        paths = workbook_paths(self.options["path"])
        if not paths:
            raise FileNotFoundError(f"File not found: {self.options['path']}")
        rows = sheet_rows(paths[0], self.options.get("sheet") or None, int(self.options.get("skip_rows", 0)))
        header = next(rows, [])
        return T.StructType([T.StructField(n, T.StringType()) for n in header if n is not None])

    def reader(self, schema):
        return WorkbookReader(schema, dict(self.options))


def scan_workbooks(spark: SparkSession, path: str, sheet_name: str | None = None, skip_rows: int = 0) -> DataFrame:
    """One sheet (the first by default) of every workbook at ``path``."""
    if path.lower().endswith(".xls"):
        raise ValueError("Unsupported file format: legacy xls workbooks are not read")
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook").option("path", path).option("skip_rows", skip_rows)
    return (reader.option("sheet", sheet_name) if sheet_name else reader).load()
