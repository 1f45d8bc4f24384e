"""Spreadsheet files as a many-file ingest job: one task reads one workbook at a time and streams its first sheet."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .clean import apply_schema, infer_types, normalize_missing
from .tables import _unique

CHUNK = 5_000
Row = list[str | None]


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _attr(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_rows(content: bytes) -> Iterator[Row]:
    """The rows of the first sheet; cells are text, numbers as written."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, si in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if _tag(si) == "si":
                    shared.append("".join(t.text or "" for t in si.iter() if _tag(t) == "t"))
                    si.clear()
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        for _, element in ElementTree.iterparse(z.open(sheets[0])):
            if _tag(element) != "row":
                continue
            row: Row = []
            for cell in element:
                at = _column(cell.get("r")) if cell.get("r") else len(row)
                row += [None] * (at - len(row))
                text = next((v.text for v in cell if _tag(v) == "v"), None)
                if cell.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                elif cell.get("t") == "b" and text is not None:
                    text = "true" if text == "1" else "false"
                elif cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter() if _tag(t) == "t")
                row.append(text)
            yield row
            element.clear()


def ods_rows(content: bytes) -> Iterator[Row]:
    """The rows of the first table; repeated empty cells and rows at the end are dropped."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for event, element in ElementTree.iterparse(z.open("content.xml")):
            if _tag(element) == "table":
                return
            if _tag(element) != "table-row":
                continue
            row: Row = []
            empty = 0  # empty cells count only if another cell follows
            for cell in element:
                if _tag(cell) not in ("table-cell", "covered-table-cell"):
                    continue
                text = next((_attr(cell, a) for a in ("date-value", "boolean-value", "value") if _attr(cell, a) is not None), None)
                if text is None:
                    lines = ["".join(p.itertext()) for p in cell if _tag(p) == "p"]
                    text = "\n".join(lines) if lines else None
                times = int(_attr(cell, "number-columns-repeated") or 1)
                if text is None:
                    empty += times
                else:
                    row += [None] * empty + [text] * times
                    empty = 0
            for _ in range(int(_attr(element, "number-rows-repeated") or 1) if row else 0):
                yield list(row)
            element.clear()


def parse_workbooks(files: DataFrame, reader: Callable[[bytes], Iterator[Row]]) -> DataFrame:
    """(path, row, cells): one row per sheet row below the header, cells as a map from header name to text.

    Repeated header names are numbered (a, a.1); cells beyond the header are named by their position, like those below a blank one."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = reader(content)
                first = next(rows, [])
                header = _unique(first)
                buffer: list[tuple] = []
                for number, row in enumerate(rows):
                    while len(row) > len(first) and row[-1] is None:
                        row.pop()
                    if len(row) > len(header):
                        header = _unique([*first, *[None] * (len(row) - len(first))])
                    buffer.append((path, number, dict(zip(header, row + [None] * (len(header) - len(row))))))
                    if len(buffer) == CHUNK:
                        yield pd.DataFrame(buffer, columns=["path", "row", "cells"])
                        buffer = []
                yield pd.DataFrame(buffer, columns=["path", "row", "cells"])

    return files.select("path", "content").mapInPandas(parse, "path string, row bigint, cells map<string,string>")


def workbook_table(parsed: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Columns from parsed workbooks: the declared schema, or all header names with inferred types."""
    if schema:
        names = [f.name for f in schema.fields]
    else:
        names = [r[0] for r in parsed.select(F.explode(F.map_keys("cells"))).distinct().orderBy("col").collect()]
    if not names:
        raise ValueError("no sheet has a header row")
    raw = normalize_missing(parsed.select(*[F.col("cells")[n].alias(n) for n in names]))
    return apply_schema(raw, schema) if schema else infer_types(raw)


def _load(spark: SparkSession, path: str, reader: Callable, schema: T.StructType | None) -> DataFrame:
    return workbook_table(parse_workbooks(spark.read.format("binaryFile").load(path), reader), schema)


def load_workbooks(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All .xlsx or .xlsm files of a path or glob as one table."""
    return _load(spark, path, xlsx_rows, schema)


def load_ods(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All .ods or .odf files of a path or glob as one table."""
    return _load(spark, path, ods_rows, schema)
