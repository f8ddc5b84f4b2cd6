"""Identity joins, cascades, event de-duplication, consolidation and table comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgene.functions.scalars import same_value


def keyed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key -> number of rows and the least value; empty keys don't take part."""
    return rows.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("first"))


def unique_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Equi-join of keys that stand once on either side."""
    once = lambda df: df.withColumn("__n", F.count("*").over(W.partitionBy(key))).filter("__n = 1").drop("__n")
    return once(a).join(once(b), key)


def classify(rows: DataFrame, lookup: DataFrame, key: str, none: str, many: str, one: str) -> DataFrame:
    """Left join to a keyed lookup: none, one or many, and the value where it is one."""
    joined = rows.join(lookup, key, "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return joined.withColumn("status", F.when(n == 0, none).when(n > 1, many).otherwise(one)).withColumn("value", F.when(n == 1, F.col("first"))).drop("n", "first")


def cascade(rows: DataFrame, master: DataFrame, value: str, levels: list[tuple[str, list[tuple[Column, str]]]]) -> DataFrame:
    """Match by the first level that has any hit: each level is a name and null-safe equalities (expression of rows, column of master)."""
    status, basis, hit = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None)
    out = rows
    for k, (name, pairs) in enumerate(levels):
        found = master.groupBy(*[F.col(c).alias(f"__k{i}") for i, (_, c) in enumerate(pairs)]).agg(F.count("*").alias(f"__n{k}"), F.min(value).alias(f"__v{k}"))
        left = out.withColumns({f"__e{i}": e for i, (e, _) in enumerate(pairs)})
        on = [left[f"__e{i}"].eqNullSafe(found[f"__k{i}"]) for i in range(len(pairs))]
        out = left.join(found, on, "left").drop(*[f"__{x}{i}" for x in "ek" for i in range(len(pairs))])
    for k in reversed(range(len(levels))):
        n = F.col(f"__n{k}")
        status = F.when(n == 1, "matched_unique_master_event").when(n > 1, "ambiguous_master_event").otherwise(F.coalesce(status, F.lit("not_matched")))
        basis = F.when(n > 0, levels[k][0]).otherwise(basis)
        hit = F.when(n == 1, F.col(f"__v{k}")).when(n > 1, F.lit(None)).otherwise(hit)
    return out.withColumns({"match_status": status, "match_basis": basis, "master_value": hit}).drop(*[f"__{x}{k}" for x in "nv" for k in range(len(levels))])


def dedup_events(rows: DataFrame, key: list[str], payload: str, order: str) -> DataFrame:
    """First row per event in source order, how often it occurs, and whether its payloads conflict."""
    return rows.groupBy(*key).agg(
        F.min(order).alias("first_row"), F.min_by(payload, order).alias("first_payload"), F.count("*").alias("occurrences"),
        F.count_distinct(payload).alias("n_payloads"), F.array_join(F.array_sort(F.collect_list(order)), ";").alias("rows"),
    )


def consolidate(rows: DataFrame, key: str, coordinates: list[str], valid: Column, flags: list[str]) -> DataFrame:
    """One row per key if all its rows are valid and agree on the coordinates; others are quarantined."""
    place = F.struct(*coordinates)
    out = rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(place).alias("lo"), F.max(place).alias("hi"), F.bool_and(valid).alias("valid"), *[F.bool_or(f).alias(f) for f in flags])
    agree = F.col("lo").eqNullSafe(F.col("hi"))
    return out.select(key, "n_rows", *[F.when(agree, F.col(f"lo.{c}")).alias(c) for c in coordinates], *flags, F.when(agree & F.col("valid"), "UNIQUE").otherwise("QUARANTINED").alias("status"))


def compare_by_key(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Fields that differ, by key: full outer join, typed tolerant equality, missing rows included."""
    values = [c for c in left.columns if c not in keys]
    a, b = left.select(*keys, F.struct(*values).alias("__a")), right.select(*keys, F.struct(*values).alias("__b"))
    both = a.join(b, keys, "full")
    kinds = dict(left.dtypes)
    cells = F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"__a.{v}").cast("string").alias("left_value"), F.col(f"__b.{v}").cast("string").alias("right_value"), same_value(F.col(f"__a.{v}"), F.col(f"__b.{v}"), kinds[v], tolerance).alias("same")) for v in values])
    rows = both.select(*keys, F.col("__a").isNull().alias("no_left"), F.col("__b").isNull().alias("no_right"), F.explode(cells).alias("x"))
    state = F.when(F.col("no_left"), "only_right").when(F.col("no_right"), "only_left").otherwise("different")
    return rows.filter(F.col("no_left") | F.col("no_right") | ~F.col("x.same")).select(*keys, "x.field", "x.left_value", "x.right_value", state.alias("state"))


def numbered(rows: DataFrame, order: list[str], name: str = "row", pieces: int = 256) -> DataFrame:
    """Gapless numbers from 1 in the given order, without one task for all rows: cut points from at most ``pieces`` distinct
    keys (least hashes, so the same ones in every run) deal rows to ordered pieces, each numbered from the count before it."""
    at = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    picked = rows.select(at.alias("k")).distinct().orderBy(F.xxhash64("k")).limit(pieces)
    cuts = picked.agg(F.array_sort(F.collect_list("k")).alias("__cuts"))
    dealt = rows.crossJoin(F.broadcast(cuts)).withColumn("__piece", F.size(F.filter("__cuts", lambda c: c <= at))).drop("__cuts")
    before = dealt.groupBy("__piece").count().select("__piece", (F.sum("count").over(W.orderBy("__piece")) - F.col("count")).alias("__before"))
    ranked = dealt.withColumn("__rank", F.row_number().over(W.partitionBy("__piece").orderBy(*order)))
    return ranked.join(F.broadcast(before), "__piece").withColumn(name, (F.col("__rank") + F.col("__before")).cast("long")).drop("__piece", "__rank", "__before")


def compare_by_position(left: DataFrame, right: DataFrame, order: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Cell comparison row by row, in the given order; the longer table's rest counts as different."""
    return compare_by_key(numbered(left, order), numbered(right, order), ["row"], tolerance)


def same_inventory(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side that the other lacks."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
