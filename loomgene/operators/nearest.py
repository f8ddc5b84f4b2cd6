"""Nearest point of a closed interval, in both directions, as window plans.

Work is dealt by key and position bucket, so one large key doesn't land in one task:
inside a bucket two ordered windows carry the last point seen; what lies beyond the
bucket comes from a small table of bucket edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET = 1 << 14


def nearest(queries: DataFrame, points: DataFrame, keys: list[str], start: str = "start", end: str = "end", pos: str = "pos", bucket: int = BUCKET) -> DataFrame:
    """``queries`` with distance: 0 inside [start, end], null where the key has no point. Points need not be distinct."""
    slot = lambda c: F.floor(F.col(c) / bucket)
    names = [c for c in queries.columns]
    q = queries.select(*keys, slot(start).alias("__b"), F.col(start).alias("__at"), F.lit(-1).alias("__kind"), F.struct(*names).alias("__q"), F.lit(None).cast("long").alias("__p"))
    p = points.select(*keys, slot(pos).alias("__b"), F.col(pos).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(q.schema["__q"].dataType).alias("__q"), F.col(pos).cast("long").alias("__p"))
    both = q.unionByName(p)
    # At one position a query stands before the points: they lie to its right, at distance 0.
    inside = [*keys, "__b"]
    up = W.partitionBy(*inside).orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*inside).orderBy(F.desc("__at"), F.desc("__kind")).rowsBetween(W.unboundedPreceding, -1)
    seen = both.withColumn("__l", F.last("__p", True).over(up)).withColumn("__r", F.last("__p", True).over(down)).filter(F.col("__kind") == -1)
    edges = both.groupBy(*inside).agg(F.min("__p").alias("__lo"), F.max("__p").alias("__hi"))
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(*inside, F.last("__hi", True).over(before).alias("__left"), F.last("__lo", True).over(after).alias("__right"))
    joined = seen.join(edges, inside)
    left, right = F.coalesce("__l", "__left"), F.coalesce("__r", "__right")
    gap = F.least(F.col("__at") - left, F.greatest(right - F.col(f"__q.{end}"), F.when(right.isNotNull(), F.lit(0))))
    return joined.select("__q.*", gap.cast("long").alias("distance"))


def nearest_each(queries: DataFrame, points: DataFrame, keys: list[str], label: Column, n_labels: int, start: str = "start", end: str = "end", pos: str = "pos", bucket: int = BUCKET) -> DataFrame:
    """``queries`` with distances: as ``nearest``, an entry for the points of each label 0 to n_labels - 1.

    Queries and positions go through the windows once, whatever the number of labels (62 at most): a position carries its labels as bits.
    """
    if not 0 < n_labels <= 62:
        raise ValueError("1 to 62 labels")
    slot = lambda c: F.floor(F.col(c) / bucket)
    at = points.groupBy(*keys, pos).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), label)).alias("__m"))
    q = queries.select(*keys, slot(start).alias("__b"), F.col(start).alias("__at"), F.lit(-1).alias("__kind"), F.struct(*queries.columns).alias("__q"), F.lit(None).cast("long").alias("__m"))
    p = at.select(*keys, slot(pos).alias("__b"), F.col(pos).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(q.schema["__q"].dataType).alias("__q"), "__m")
    inside, labels = [*keys, "__b"], range(n_labels)
    # Rows without a place meet nothing below; left out here, both uses of ``both`` read the same exchange of positions.
    both = q.unionByName(p).dropna(subset=inside)
    own = lambda i: F.when(F.col("__m").bitwiseAND(F.lit(1 << i)) != 0, F.col("__at"))
    up = W.partitionBy(*inside).orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*inside).orderBy(F.desc("__at"), F.desc("__kind")).rowsBetween(W.unboundedPreceding, -1)
    seen = both.select("*", *[F.last(own(i), True).over(up).alias(f"__l{i}") for i in labels])
    seen = seen.select("*", *[F.last(own(i), True).over(down).alias(f"__r{i}") for i in labels]).filter(F.col("__kind") == -1)
    edges = both.groupBy(*inside).agg(*[f(own(i)).alias(f"__{n}{i}") for i in labels for f, n in ((F.min, "lo"), (F.max, "hi"))])
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(*inside, *[F.last(f"__hi{i}", True).over(before).alias(f"__left{i}") for i in labels], *[F.last(f"__lo{i}", True).over(after).alias(f"__right{i}") for i in labels])
    gaps = []
    for i in labels:
        left, right = F.coalesce(f"__l{i}", f"__left{i}"), F.coalesce(f"__r{i}", f"__right{i}")
        gaps.append(F.least(F.col("__at") - left, F.greatest(right - F.col(f"__q.{end}"), F.when(right.isNotNull(), F.lit(0)))).cast("long"))
    return seen.join(edges, inside).select("__q.*", F.array(*gaps).alias("distances"))


def window_counts(distances: DataFrame, by: list[str], windows: list[int]) -> DataFrame:
    """Per group and flank: queries, those within the flank, and their share. A missing distance counts as a miss."""
    sums = distances.groupBy(*by).agg(F.count("*").alias("n_queries"), *[F.count_if(F.col("distance") <= w).alias(f"__{w}") for w in windows])
    rows = sums.select(*by, "n_queries", F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("flank_bp"), F.col(f"__{w}").alias("n_recovered")) for w in windows])).alias("x"))
    return rows.select(*by, "x.flank_bp", "n_queries", "x.n_recovered", F.try_divide("x.n_recovered", "n_queries").alias("fraction_recovered"))


def range_neighbours(rows: DataFrame, key: str, pos: str, radius: int, name: str, bucket: int = BUCKET) -> DataFrame:
    """Other rows within ``radius`` on either side, as ``name``."""
    return range_neighbours_each(rows, key, pos, {name: radius}, bucket)


def range_neighbours_each(rows: DataFrame, key: str, pos: str, radii: dict[str, int], bucket: int = BUCKET) -> DataFrame:
    """Other rows within each radius on either side of a whole-numbered position, a column per name.

    One exchange and sort for all radii: windows per key and position bucket, to which rows near its edges are lent. A count is
    what lies up to the right edge less what lies before the left one; both frames only grow, so dense positions cost no more than others.
    """
    most = max(radii.values())
    width = max(bucket, 2 * most)
    own = F.floor(F.col(pos) / width)
    spots = F.array_distinct(F.array(own, F.floor((F.col(pos) - most) / width), F.floor((F.col(pos) + most) / width)))
    lent = rows.withColumn("__own", own).withColumn("__b", F.explode(spots))
    up_to = lambda d: F.count("*").over(W.partitionBy(key, "__b").orderBy(pos).rangeBetween(W.unboundedPreceding, d))
    return lent.withColumns({name: up_to(r) - up_to(-r - 1) - 1 for name, r in radii.items()}).filter(F.col("__b") == F.col("__own")).drop("__own", "__b")


def band_pairs(left: DataFrame, right: DataFrame, key: str, width: int, left_pos: str, right_pos: str) -> DataFrame:
    """Equi-join on key and position bucket for |left - right| <= width; the right side stands in its bucket and both beside it, so a pair meets once."""
    a = left.withColumn("__b", F.floor(F.col(left_pos) / width))
    spots = F.array(*[F.floor(F.col(right_pos) / width) + d for d in (-1, 0, 1)])
    b = right.withColumn("__b", F.explode(spots))
    return a.join(b, [key, "__b"]).filter(F.abs(F.col(left_pos) - F.col(right_pos)) <= width).drop("__b")


def overlap_pairs(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], width: int = 1 << 10) -> DataFrame:
    """All pairs of closed intervals that share a position, of any length: an equi-join on key and position bucket.

    An interval stands in every bucket that it spans, of its own size: buckets double until it spans two at most, and meets the
    other side's intervals of every size that occurs there. A pair is kept in the bucket of the larger size in which the overlap begins.
    """

    def level(s, e):
        return F.greatest(F.ceil(F.log2(F.greatest((F.col(e) - F.col(s) + 1) / width, F.lit(1.0)))), F.lit(0)).cast("int")

    def spots(s, e, at):
        size = F.call_function("shiftleft", F.lit(width).cast("long"), at)
        return F.sequence(F.floor(F.col(s) / size), F.floor(F.col(e) / size))

    def levels(rows, s, e):
        return rows.filter(F.col(s) <= F.col(e)).withColumn("__level", level(s, e))

    x, y = levels(left, *a), levels(right, *b)
    # Levels are at most 53 in number, so this table is small however large the sides are.
    held = x.select("__level").distinct().withColumnRenamed("__level", "__x").join(y.select("__level").distinct().withColumnRenamed("__level", "__y"), F.lit(True))
    side = lambda rows, own, s, e: rows.join(F.broadcast(held), F.col("__level") == F.col(own)).withColumn("__at", F.greatest("__x", "__y")).withColumn("__b", F.explode(spots(s, e, F.col("__at")))).drop("__level")
    pairs = side(x, "__x", *a).join(side(y, "__y", *b), [key, "__x", "__y", "__at", "__b"])
    first = F.greatest(F.col(a[0]), F.col(b[0]))
    begins = F.floor(first / F.call_function("shiftleft", F.lit(width).cast("long"), F.col("__at"))) == F.col("__b")
    return pairs.filter((first <= F.least(F.col(a[1]), F.col(b[1]))) & begins).drop("__x", "__y", "__at", "__b")
