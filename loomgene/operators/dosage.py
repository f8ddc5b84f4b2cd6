"""Genotype symbols, dosages, quality and pairwise-complete correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dosage of each symbol; anything else is missing.
DOSAGE = {"A": 0, "M": 1, "C": 2}
MIN_SAMPLES = 40


def dosage(symbols: Column) -> Column:
    code = F.create_map(*[F.lit(x) for k, v in DOSAGE.items() for x in (k, v)])
    return F.transform(symbols, lambda s: F.try_element_at(code, s).cast("tinyint"))


def total(values: Column, f=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(f(x).cast("long"), F.lit(0)))


def marker_quality(rows: DataFrame, column: str = "dosage", least_rate: float = 0.9, least_maf: float = 0.05) -> DataFrame:
    """n_called, call_rate, maf, integer variance, keep."""
    d = F.col(column)
    called = F.filter(d, lambda x: x.isNotNull())
    n, s, s2 = F.size(called).cast("long"), total(called), total(called, lambda x: x * x)
    p = F.try_divide(s, 2 * n)
    out = rows.withColumns({"n_called": n, "call_rate": F.try_divide(n, F.size(d)), "maf": F.least(p, 1 - p), "variance": n * s2 - s * s})
    keep = (F.col("call_rate") >= least_rate) & (F.coalesce(F.col("maf"), F.lit(0.0)) >= least_maf) & (F.col("variance") > 0)
    return out.withColumn("keep", keep)


def pair_sums(x: Column, y: Column) -> Column:
    """n, sums, sums of squares and products over samples that both have, as exact integers."""
    pairs = F.filter(F.zip_with(x, y, lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")])
    step = lambda s, p: F.struct((s["n"] + 1).alias("n"), (s["sx"] + p["a"]).alias("sx"), (s["sy"] + p["b"]).alias("sy"), (s["sxy"] + p["a"] * p["b"]).alias("sxy"), (s["sxx"] + p["a"] * p["a"]).alias("sxx"), (s["syy"] + p["b"] * p["b"]).alias("syy"))
    return F.aggregate(pairs, zero, step)


def correlate(pairs: DataFrame, x: str, y: str, least: int = MIN_SAMPLES) -> DataFrame:
    """``pairs`` with n, status (1 too few samples, 0 valid, 2 no variance) and r2, null where not valid."""
    rows = pairs.withColumn("__s", pair_sums(F.col(x), F.col(y)))
    s = lambda c: F.col(f"__s.{c}")
    vx, vy, cov = s("n") * s("sxx") - s("sx") * s("sx"), s("n") * s("syy") - s("sy") * s("sy"), s("n") * s("sxy") - s("sx") * s("sy")
    status = F.when(s("n") < least, 1).when((vx > 0) & (vy > 0), 0).otherwise(2)
    r2 = F.when(status == 0, F.least(F.lit(1.0), cov.cast("double") * cov.cast("double") / (vx.cast("double") * vy.cast("double"))))
    return rows.withColumns({"n": s("n"), "status": status, "r2": r2}).drop("__s", x, y)
