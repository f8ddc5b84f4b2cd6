"""Spreadsheet scans: OOXML workbooks, read through Spark's binary reader, so any store will do.

A workbook becomes rows (path, sheet, source_row, cells): cells maps the normalised
header to the value as text, absent cells are absent keys. The header is the first of
the first twelve rows that has all required names.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, sheet string, source_row long, cells map<string,string>, error_cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_KIND = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("source_row", pa.int64()), ("cells", pa.map_(pa.string(), pa.string())), ("error_cells", pa.list_(pa.string()))])


class WorkbookError(ValueError):
    """A workbook that can't be read as asked."""


def key(name: object) -> str:
    """Letters and digits of a header, without accents, in lower case."""
    plain = unicodedata.normalize("NFKD", "" if name is None else str(name)).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9]", "", plain.lower())


def field(*names: str, cells: str = "cells") -> Column:
    """The first of some header names that a row has."""
    return F.coalesce(*[F.try_element_at(F.col(cells), F.lit(key(n))) for n in names])


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(data: bytes, strict: bool = False) -> Iterator[tuple[str, list[tuple[int, list, list]]]]:
    """(name, [(row number, values, error cells)]) of each sheet. ``strict`` fails on formulas and error cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_REL)].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row"):
                values, errors = [], []
                for cell in row.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r"))
                    values += [None] * (at + 1 - len(values))
                    values[at] = _value(cell, shared, errors, strict)
                rows.append((int(row.get("r")), values, errors))
            yield sheet.get("name"), rows


def _value(cell, shared: list[str], errors: list[str], strict: bool):
    kind, raw = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if cell.find(f"{_MAIN}f") is not None and (strict or raw is None):
        raise WorkbookError(f"formula in {cell.get('r')}" + ("" if strict else " without a value"))
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    if raw is None or raw.text is None:
        return None
    if kind == "s":
        return shared[int(raw.text)]
    if kind == "b":
        return raw.text == "1"
    if kind == "e":
        if strict:
            raise WorkbookError(f"error in {cell.get('r')}: {raw.text}")
        errors.append(f"{cell.get('r')}={raw.text}")
        return raw.text
    if kind in ("str", "d"):
        return raw.text
    return float(raw.text) if re.search("[.eE]", raw.text) else int(raw.text)


def _text(value) -> str | None:
    if value is None or value == "":
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def records(rows: list, required: list[str], search_rows: int = 12, need_header: bool = True) -> Iterator[tuple[int, dict, list]]:
    """Non-blank rows below the header."""
    wanted = {key(r) for r in required}
    head = None
    for i, (_, values, _) in enumerate(rows[:search_rows]):
        if wanted <= {key(v) for v in values if v is not None}:
            head = i
            break
    if head is None:
        if need_header:
            raise WorkbookError(f"no header row with {sorted(wanted)}")
        return
    names = [key(v) for v in rows[head][1]]
    for number, values, errors in rows[head + 1 :]:
        cells = {n: t for n, v in zip(names, values) if n and (t := _text(v)) is not None}
        if cells:
            yield number, cells, errors


def read_workbook(spark: SparkSession, path: str, required: list[str], sheet: str | None = None, strict: bool = False) -> DataFrame:
    """Rows of one sheet, or of all sheets that have the header. Each file is one task's work; both formats are told by their first bytes."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomgene.sources.biff import biff_sheets

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = data.as_py()
                found = False
                for title, rows in biff_sheets(raw) if raw[:4] == b"\xd0\xcf\x11\xe0" else sheets(raw, strict):
                    if sheet is not None and title != sheet:
                        continue
                    found = True
                    out = [{"path": name, "sheet": title, "source_row": n, "cells": list(cells.items()), "error_cells": errors} for n, cells, errors in records(rows, required, need_header=sheet is not None)]
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=_KIND)
                if not found:
                    raise WorkbookError(f"no sheet {sheet!r} in {name}")

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, ROWS)


def genotype_matrix(rows: DataFrame, meta: list[str], samples: list[str]) -> DataFrame:
    """Wide genotype rows to (source_row, meta..., symbols): one array of upper-case calls in the order of the samples."""
    doubles = {s for s in samples if samples.count(s) > 1}
    if doubles or not samples:
        raise WorkbookError(f"empty or repeated samples: {sorted(doubles)}")
    call = [F.upper(F.substring(F.coalesce(field(s), F.lit("")), 1, 17)) for s in samples]
    checked = F.transform(F.array(*call), lambda c: F.when(F.length(c) > 16, F.raise_error(F.lit("call of more than 16 letters")).cast("string")).otherwise(c))
    return rows.select("source_row", *[field(m).alias(m) for m in meta], checked.alias("symbols"))
