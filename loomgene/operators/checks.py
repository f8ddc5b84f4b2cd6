"""Check ledgers, asserted scans, file location, closed configurations and content-addressed tables."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A limit, a count or an inventory that isn't as it must be."""


@dataclass
class Ledger:
    """(check, observed, expected, status) rows of a run; values are kept as text."""

    rows: list[tuple[str, str, str, str]] = field(default_factory=list)

    def add(self, name: str, observed, expected, tolerance: float = 0.0) -> bool:
        near = isinstance(observed, (int, float)) and isinstance(expected, (int, float)) and not isinstance(observed, bool) and abs(observed - expected) <= tolerance
        ok = bool(near or observed == expected)
        self.rows.append((name, str(observed), str(expected), "PASS" if ok else "FAIL"))
        return ok

    @property
    def status(self) -> str:
        return "CHECK_FAILED" if any(r[3] == "FAIL" for r in self.rows) else "COMPLETED"

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "check string, observed string, expected string, status string")


def assert_rows(df: DataFrame, expected: int, name: str) -> DataFrame:
    """A table that has exactly so many rows, or an error."""
    found = df.count()
    if found != expected:
        raise CheckFailed(f"{name}: {found} rows, expected {expected}")
    return df


def assert_at_most(df: DataFrame, limit: int, name: str) -> DataFrame:
    """A cap that fails: nothing is cut off. Only one row more than the cap is looked for."""
    if df.limit(limit + 1).count() > limit:
        raise CheckFailed(f"{name}: more than {limit} rows")
    return df


def assert_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    if df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        raise CheckFailed(f"{name}: {keys} are not unique")
    return df


def locate(root: str, relative: str, aliases: list[str] = (), optional: bool = False) -> Path | None:
    """The expected path, else the one file below the root with an alias for a name, whatever its case; different copies are an error."""
    expected = Path(root, relative)
    if expected.is_file():
        return expected
    names = {n.casefold() for n in (Path(relative).name, *aliases)}
    found = sorted(p for p in Path(root).rglob("*") if p.is_file() and p.name.casefold() in names)
    if len({hashlib.sha256(p.read_bytes()).digest() for p in found}) > 1:
        raise CheckFailed(f"different copies of {relative}: {[str(p) for p in found]}")
    if not found and not optional:
        raise CheckFailed(f"{relative} isn't there")
    return found[0] if found else None


def closed(kind, values: dict):
    """A configuration dataclass from a mapping whose keys are exactly its fields."""
    names = {f.name for f in fields(kind)}
    if set(values) != names:
        raise CheckFailed(f"missing: {sorted(names - set(values))}; unknown: {sorted(set(values) - names)}")
    return kind(**values)


def validated_aliases(aliases: list[dict], primary: set[str]) -> dict[str, str]:
    """source -> target: no repeated, own, chained or primary source, and each with its reason."""
    out: dict[str, str] = {}
    for a in aliases:
        if not a.get("reason") or a["source"] in out or a["source"] == a["target"] or a["source"] in primary:
            raise CheckFailed(f"alias of {a['source']!r}")
        out[a["source"]] = a["target"]
    if set(out) & set(out.values()):
        raise CheckFailed("aliases form a chain")
    return out


def cached(spark: SparkSession, folder: str, identity: dict, make) -> DataFrame:
    """A Parquet table under the digest of what it is made from; a finished one is read, another is made."""
    name = hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
