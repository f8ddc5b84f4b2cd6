"""Verification of results: every cell of every sheet against a reference, and files against their manifest."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgene.operators.checks import CheckFailed
from loomgene.sources.sinks import verify_manifest

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_WHOLE = r"^[+-]?[0-9]+$"


def cells(rows: DataFrame, renamed: dict[str, str], ignored: list[str]) -> DataFrame:
    """(sheet, row, column, value) of workbook rows: rows are numbered within their sheet, headers take their present names."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (renamed or {"": ""}).items() for x in kv]), F.col("key")), F.col("key"))
    numbered = rows.withColumn("row", F.row_number().over(W.partitionBy("sheet").orderBy("source_row")))
    each = numbered.select("sheet", "row", F.explode("cells")).select("sheet", "row", name.alias("column"), F.col("value"))
    return each.filter(~F.col("column").isin(ignored)) if ignored else each


def compare_cells(actual: DataFrame, expected: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Cells side by side with same: whole numbers and texts are equal, other numbers within the absolute tolerance, absent equals absent only."""
    both = actual.select("sheet", "row", "column", F.col("value").alias("actual")).join(expected.select("sheet", "row", "column", F.col("value").alias("expected")), ["sheet", "row", "column"], "full")
    a, b = F.col("actual"), F.col("expected")
    numbers = a.rlike(_NUMBER) & b.rlike(_NUMBER)
    delta = F.when(numbers, F.abs(a.try_cast("double") - b.try_cast("double")))
    whole = a.rlike(_WHOLE) & b.rlike(_WHOLE)
    same = F.when(whole, a.try_cast("decimal(38,0)") == b.try_cast("decimal(38,0)")).when(numbers, delta <= tolerance).otherwise(a == b)
    return both.withColumns({"delta": delta, "same": F.coalesce(same, F.lit(False))})


def compare_workbooks(actual: DataFrame, expected: DataFrame, renamed: dict[str, str] | None = None, ignored: list[str] | None = None, tolerance: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """(one row per sheet with rows, cells, mismatches, largest difference and status; the cells that differ). Other sheets or columns are an error."""
    a, b = (cells(x, renamed or {}, ignored or []) for x in (actual, expected))
    for level in (["sheet"], ["sheet", "column"]):
        left, right = a.select(*level).distinct(), b.select(*level).distinct()
        torn = left.exceptAll(right).unionByName(right.exceptAll(left)).limit(5).collect()
        if torn:
            raise CheckFailed(f"only on one side: {[tuple(r) for r in torn]}")
    compared = compare_cells(a, b, tolerance)
    wrong = F.count_if(~F.col("same"))
    sheets = compared.groupBy("sheet").agg(F.max("row").alias("rows"), F.count("*").alias("cells"), wrong.alias("mismatched_cells"), F.coalesce(F.max("delta"), F.lit(0.0)).alias("maximum_numeric_difference"), F.when(wrong == 0, "PASS").otherwise("FAIL").alias("status"))
    return sheets, compared.filter("NOT same").select("sheet", "row", "column", "actual", "expected")


def safe_manifest(folder: str) -> list[str]:
    """Names in the folder's manifest, if none leads out of the folder and all files are as recorded; otherwise an error."""
    with open(os.path.join(folder, "MANIFEST.json")) as file:
        names = list(json.load(file))
    bad = [n for n in names if os.path.isabs(n) or ".." in n.split("/") or ":" in n or "\\" in n or os.path.islink(os.path.join(folder, n))]
    if not names or bad:
        raise CheckFailed(f"an empty manifest, or names that lead elsewhere: {bad}")
    if changed := verify_manifest(folder):
        raise CheckFailed(f"missing, added or changed: {changed}")
    return sorted(names)


def verify_results(pairs: dict[str, tuple[DataFrame, DataFrame]], **how) -> tuple[dict, DataFrame]:
    """A summary with status PASS or FAIL over several workbooks (name: actual and expected rows), and the rows per sheet."""
    sheets = None
    for name, (actual, expected) in pairs.items():
        part = compare_workbooks(actual, expected, **how)[0].withColumn("file", F.lit(name))
        sheets = part if sheets is None else sheets.unionByName(part)
    if sheets is None:
        raise CheckFailed("nothing to verify")
    total = sheets.agg(F.count("*").alias("worksheets"), F.sum("rows").alias("rows"), F.sum("cells").alias("cells"), F.sum("mismatched_cells").alias("mismatched_cells")).first().asDict()
    return {"status": "FAIL" if total["mismatched_cells"] else "PASS", **total}, sheets
