"""Cells of .xlsx workbooks as rows, and plate maps from them."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.sources import tables

#: A workbook over so many bytes, packed or unpacked, is an error: a plate map has a few kilobytes, and one task reads it whole.
MOST_BYTES = 64 << 20
# Namespaces of the container's parts.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "path string, sheet string, row int, col int, value string"


def _text(node) -> str:
    """The text of a string item, runs joined, without phonetic hints."""
    return "".join(t.text or "" for part in node.iter() if part.tag in (f"{MAIN}si", f"{MAIN}is", f"{MAIN}r") for t in part.findall(f"{MAIN}t"))


def _place(reference: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", reference).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits), column


def _number(text: str) -> str:
    """A stored number as a sheet shows it: without an exponent or a fraction of zero."""
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def cells_of(data: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of each cell that holds a value, in the order of sheets, rows and columns as stored."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
            raise ValueError(f"a workbook of over {MOST_BYTES} bytes")

        def part(name):
            return ElementTree.fromstring(z.read(name))

        names = set(z.namelist())
        targets = {r.get("Id"): posixpath.normpath(posixpath.join("xl", r.get("Target"))).lstrip("/") for r in part("xl/_rels/workbook.xml.rels")}
        targets = {k: v.removeprefix("xl/xl/") if v not in names else v for k, v in targets.items()}
        shared = [_text(si) for si in part("xl/sharedStrings.xml").findall(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        out = []
        for sheet in part("xl/workbook.xml").iter(f"{MAIN}sheet"):
            row = 0
            for line in part(targets[sheet.get(LINK)]).iter(f"{MAIN}row"):
                row, column = int(line.get("r", row + 1)), 0
                for c in line.findall(f"{MAIN}c"):
                    column = _place(c.get("r"))[1] if c.get("r") else column + 1
                    kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        text = _text(c.find(f"{MAIN}is"))
                    elif v is None or v.text is None:
                        continue
                    else:
                        text = shared[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[v.text] if kind == "b" else v.text if kind in ("str", "e", "d") else _number(v.text)
                    if text != "":
                        out.append((sheet.get("name"), row, column, text))
    return out


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, value) of the workbooks under a path or pattern, a row for each cell with a value; rows and columns from 1."""
    files = spark.read.format("binaryFile").load(path)

    def run(parts):
        for part in parts:
            rows = [(path, *cell) for path, content in zip(part["path"], part["content"]) for cell in cells_of(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "value"]).astype({"row": "int32", "col": "int32"})

    return files.select("path", "content").mapInPandas(run, CELLS)


def plate_map(cells: DataFrame) -> DataFrame:
    """(path, sheet, well, plate_row, plate_col, treatment, ploidy, dose, condition_id) of every well that a sheet has a head and a letter for.

    Heads are the numbers 1 to 12 in the first row, letters A to H in the first column. A cell without a
    value is a well with null treatment; what a treatment doesn't say is null.
    """
    heads = cells.where("row = 1").select("path", "sheet", "col", F.col("value").try_cast("double").cast("int").alias("plate_col")).where("plate_col BETWEEN 1 AND 12")
    sides = cells.where("col = 1").select("path", "sheet", "row", F.col("value").alias("plate_row")).where(F.col("plate_row").rlike("^[A-H]$"))
    wells = heads.join(sides, ["path", "sheet"])  # 12 x 8 a sheet
    filled = wells.join(cells.select("path", "sheet", "row", "col", F.nullif(F.trim("value"), F.lit("")).alias("treatment")), ["path", "sheet", "row", "col"], "left")
    ploidy, dose = tables.parse_treatment("treatment")
    out = filled.select("path", "sheet", F.concat("plate_row", F.col("plate_col").cast("string")).alias("well"), "plate_row", "plate_col", "treatment", ploidy.alias("ploidy"), dose.alias("dose"))
    return out.withColumn("condition_id", tables.condition_id())
