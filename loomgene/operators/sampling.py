"""Deterministic sampling by keyed hashes, quotas, strata and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(seed: int, label: Column | str, rep: str, ident: str) -> Column:
    """The order of a draw: sha256 of seed, label, replicate and id."""
    name = F.lit(label) if isinstance(label, str) else label
    return F.sha2(F.concat_ws("|", F.lit(seed), name, F.col(rep), F.col(ident)), 256)


def hash_below(share: Column) -> Column:
    """The limit below which a ``share`` of all hashes of ``hash_order`` lies; from 1 on, above every one of them."""
    return F.when(share >= 1, "g").otherwise(F.lpad(F.lower(F.hex(F.floor(F.greatest(share, F.lit(0.0)) * 2.0**52).cast("long"))), 13, "0"))


def replicate(rows: DataFrame, reps: int, name: str = "rep") -> DataFrame:
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def draw(pool: DataFrame, quotas: DataFrame, strata: list[str], rep: str, order: Column, ident: str, quota: str = "quota") -> DataFrame:
    """Without replacement, the first ``quota`` of each stratum and replicate in hash order; all of it where it has no more."""
    by = W.partitionBy(rep, *strata).orderBy(order, ident)
    return pool.join(quotas, strata).withColumn("__n", F.row_number().over(by)).filter(F.col("__n") <= F.col(quota)).drop("__n", quota)


def dense_quotas(points: DataFrame, by: list[str], across: str, key: str) -> DataFrame:
    """Per group and key, the least number of distinct positions over all ``across``; one that lacks the key counts as 0."""
    counts = points.groupBy(*by, across, key).agg(F.count_distinct("pos").alias("n"))
    resources = points.select(*by, across).distinct()
    keys = points.select(*by, key).distinct()
    return resources.join(keys, by).join(counts, [*by, across, key], "left").groupBy(*by, key).agg(F.min(F.coalesce("n", F.lit(0))).alias("quota"))


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and central 95 % over replicates."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return rows.groupBy(*by).agg(F.count("*").alias("n_reps"), F.round(F.avg(value), 9).alias("mean"), q.alias("__q")).select(*by, "n_reps", "mean", F.round(F.col("__q")[0], 9).alias("q025"), F.round(F.col("__q")[1], 9).alias("q975"))


def cut_points(rows: DataFrame, by: str, value: str, bins: int) -> DataFrame:
    """Distinct quantiles j / bins of each group."""
    at = F.array(*[F.lit(j / bins) for j in range(1, bins)])
    return rows.groupBy(by).agg(F.array_distinct(F.percentile(value, at)).alias("cuts"))


def bin_of(value: Column, cuts: Column) -> Column:
    """Number of cut points that are not above the value."""
    return F.size(F.filter(cuts, lambda c: c <= value))


def requirements(targets: DataFrame, pool: DataFrame, strata: list[str]) -> DataFrame:
    """Needed and available members of each stratum; a whole model is blocked by one deficit."""
    need = targets.groupBy(*strata).agg(F.count("*").alias("required"))
    have = pool.groupBy(*strata).agg(F.count("*").alias("available"))
    return need.join(have, strata, "left").withColumn("available", F.coalesce("available", F.lit(0)))


def filled(need: DataFrame) -> DataFrame:
    """Requirements with the column quota; the query fails if a stratum has fewer members than it needs."""
    short = F.raise_error(F.concat(F.lit("a stratum needs "), F.col("required"), F.lit(" members and has "), F.col("available"))).cast("long")
    return need.withColumn("quota", F.when(F.col("required") > F.col("available"), short).otherwise(F.col("required"))).filter("quota > 0")


def percentiles(draws: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """Strict, midrank and inclusive percentile of the observed value among the draws."""
    less, same, n = F.count_if(F.col("value") < F.col("observed")), F.count_if(F.col("value") == F.col("observed")), F.count("*")
    return draws.join(observed, by).groupBy(*by, "observed").agg((100 * less / n).alias("strict"), (100 * (less + 0.5 * same) / n).alias("midrank"), (100 * (less + same) / n).alias("inclusive"))
