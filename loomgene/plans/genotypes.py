"""Dosage, pairs, profiles, neighbours, concordance and adjusted correlation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgene.operators import adjusted
from loomgene.operators.dosage import MIN_SAMPLES, correlate, dosage, marker_quality
from loomgene.operators.checks import CheckFailed
from loomgene.operators.nearest import band_pairs as band_join
from loomgene.operators.nearest import range_neighbours
from loomgene.plans.views import calls, calls_sql

BAND = 50_000
BINS = [0, 5_000, 20_000, 50_000]
FAR = 300_000
SAMPLE = 200
#: An inventory of more pairs fails.
MOST_PAIRS = 2_000_000_000


def _panel(spark, sf, second=False):
    rows = calls(spark, sf, second)
    return rows.withColumn("dosage", dosage(F.col("symbols"))).withColumn("corrected", F.col("position") + (F.col("marker") % 7) * 3000)


def _long(spark, sf, second=False):
    return calls(spark, sf, second).select("marker", "chromosome", F.posexplode("symbols").alias("sample", "symbol"))


def dosage_decode(spark, sf):
    d = F.col("dosage")
    count = lambda k: F.size(F.filter(d, lambda x: x == k)).cast("long")
    text = F.array_join(F.transform(d, lambda x: F.coalesce(x.cast("string"), F.lit("."))), "")
    return _panel(spark, sf).select("marker", count(0).alias("n_0"), count(1).alias("n_1"), count(2).alias("n_2"), F.size(F.filter(d, lambda x: x.isNull())).cast("long").alias("n_missing"), text.alias("dosages"))


def symbol_totals(spark, sf):
    n = _long(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    return n.select("symbol", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 9).alias("fraction"))


def symbol_patterns(spark, sf):
    pattern = F.array_join(F.array_sort(F.array_distinct("symbols")), "")
    return calls(spark, sf).groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n_markers"), F.min("marker").alias("first_marker"))


def marker_qc(spark, sf):
    rows = marker_quality(_panel(spark, sf))
    return rows.select("marker", "n_called", F.round("call_rate", 9).alias("call_rate"), F.round("maf", 9).alias("maf"), "variance", "keep")


def sample_qc(spark, sf):
    """Per sample over kept markers: call rate and share of heterozygous calls."""
    kept = marker_quality(_panel(spark, sf)).filter("keep").select(F.posexplode("dosage").alias("sample", "d"))
    n = F.count("d")
    return kept.groupBy("sample").agg(F.count("*").alias("n_markers"), F.round(F.try_divide(n, F.count("*")), 9).alias("call_rate"), F.round(F.try_divide(F.count_if(F.col("d") == 1), n), 9).alias("het_fraction"))


def _band(spark, sf, position="position", width=BAND, extra=()):
    rows = _panel(spark, sf)
    side = lambda s: rows.select(F.col("chromosome"), F.col("marker").alias(s), F.col(position).alias(f"p{s}"), *[F.col(c).alias(f"{c}_{s}") for c in extra])
    return band_join(side("i"), side("j"), "chromosome", width, "pi", "pj").filter("i < j").withColumn("distance", F.abs(F.col("pj") - F.col("pi")))


def band_pairs(spark, sf):
    return _band(spark, sf).select("chromosome", "i", "j", "distance")


def within_cap(rows, most):
    """Fails if either position makes more than ``most`` pairs within the band."""
    for position in ("position", "corrected"):
        pairs = (range_neighbours(rows, "chromosome", position, BAND, "near").agg(F.sum("near").alias("n")).first()["n"] or 0) // 2
        if pairs > most:
            raise CheckFailed(f"{pairs} pairs by {position}, more than {most}")


def pair_inventory_union(spark, sf):
    """Pairs near by the original or by the corrected position, with a flag for each.

    More than MOST_PAIRS fail, none are cut: pairs are counted per marker by RANGE frames before any is listed.
    """
    within_cap(_panel(spark, sf).select("chromosome", "marker", "position", "corrected"), MOST_PAIRS)
    flag = lambda df, a, b: df.select("i", "j", F.lit(a).alias("o"), F.lit(b).alias("c"))
    both = flag(_band(spark, sf), True, False).unionByName(flag(_band(spark, sf, "corrected"), False, True))
    return both.groupBy("i", "j").agg(F.bool_or("o").alias("original_local"), F.bool_or("c").alias("corrected_local"))


def window_membership_changes(spark, sf):
    out = None
    for w in (10_000, 50_000):
        o = _band(spark, sf, "position", w).select("chromosome", "i", "j", F.lit(1).alias("o"))
        c = _band(spark, sf, "corrected", w).select("chromosome", "i", "j", F.lit(1).alias("c"))
        both = o.join(c, ["chromosome", "i", "j"], "full")
        part = both.groupBy("chromosome").agg(F.count_if(F.col("o").isNotNull() & F.col("c").isNotNull()).alias("n_both"), F.count_if(F.col("c").isNull()).alias("n_original_only"), F.count_if(F.col("o").isNull()).alias("n_corrected_only")).withColumn("window_bp", F.lit(w).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def context_pair_sample(spark, sf):
    """Pairs between chromosomes, and far ones within, by rank: pairs are counted per marker, never listed; chosen ranks are unranked by running sums."""
    rows = calls(spark, sf).select("marker", "chromosome", "position")
    by = W.partitionBy("chromosome").orderBy("position", "marker")
    near = W.partitionBy("chromosome").orderBy("position").rangeBetween(0, FAR - 1)
    ranked = rows.withColumns({"rn": F.row_number().over(by), "size": F.count("*").over(W.partitionBy("chromosome")), "near": F.count("*").over(near)})
    ranked = ranked.withColumn("far", F.col("size") - F.col("rn") - F.col("near") + 1)
    sizes = rows.groupBy("chromosome").agg(F.count("*").alias("size"))
    # One row per chromosome: how many markers stand on later ones, and the place of the first of them.
    order = W.orderBy("chromosome")
    sizes = sizes.withColumns({"upto": F.sum("size").over(order), "all": F.sum("size").over(W.partitionBy(F.lit(1)))})
    placed = ranked.drop("size").join(F.broadcast(sizes), "chromosome").withColumn("at", F.col("upto") - F.col("size") + F.col("rn"))
    each = F.array(
        F.struct(F.lit("distant").alias("pair_class"), F.col("far").alias("n"), (F.col("upto") - F.col("far")).alias("skip")),
        F.struct(F.lit("interchromosomal").alias("pair_class"), (F.col("all") - F.col("upto")).alias("n"), F.col("upto").alias("skip")),
    )
    counted = placed.select("marker", "chromosome", "at", F.explode(each).alias("x")).select("marker", "chromosome", "at", "x.*").filter("n > 0")
    # Running sums: within a chromosome by window, across chromosomes by one row for each.
    inner = W.partitionBy("pair_class", "chromosome").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    base = counted.groupBy("pair_class", "chromosome").agg(F.sum("n").alias("total"))
    base = base.withColumns({"base": F.coalesce(F.sum("total").over(W.partitionBy("pair_class").orderBy("chromosome").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "whole": F.sum("total").over(W.partitionBy("pair_class"))})
    lo = counted.join(F.broadcast(base), ["pair_class", "chromosome"]).withColumn("lo", F.col("base") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    k = F.col("k")
    picks = base.select("pair_class", "whole").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SAMPLE - 1))))
    low, high = F.expr(f"whole * k div {SAMPLE}"), F.expr(f"whole * (k + 1) div {SAMPLE}")
    picks = picks.withColumns({"low": low, "high": high}).filter("high > low").withColumn("rank", F.col("low") + F.pmod(F.pmod(k.cast("long") * 1103515245 + 12345, F.lit(2147483648)), F.col("high") - F.col("low")))
    hit = lo.join(F.broadcast(picks.select("pair_class", "rank")), "pair_class").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.col("n")))
    partner = placed.select(F.col("marker").alias("other"), F.col("at").alias("other_at"))
    return hit.withColumn("other_at", F.col("skip") + F.col("rank") - F.col("lo") + 1).join(partner, "other_at").select("pair_class", "rank", F.col("marker").alias("a"), F.col("other").alias("b"))


def _correlated(rows, drop=0):
    cut = lambda c: F.slice(c, drop + 1, F.greatest(F.size(c) - drop, F.lit(0))) if drop else F.col(c)
    return correlate(rows.withColumns({"x": cut("dosage_i"), "y": cut("dosage_j")}), "x", "y").drop("dosage_i", "dosage_j", "pi", "pj")


def _pairs(spark, sf, drop=0):
    return _correlated(_band(spark, sf, extra=("dosage",)), drop)


def pairwise_r2(spark, sf):
    return _pairs(spark, sf).select("i", "j", "n", "status", F.round("r2", 9).alias("r2"))


def _profile(binned, names, *by):
    """Per chromosome and overall (ALL), and per distance bin, empty ones too, for each of ``by``."""
    sets = binned.groupingSets([[*by, "chromosome", "bin_bp"], [*by, "bin_bp"]], *by, "chromosome", "bin_bp")
    q = lambda p: F.round(F.percentile("r2", p), 9)
    stats = sets.agg(
        F.count("*").alias("n_pairs"), F.count("r2").alias("n_valid"), F.round(F.avg("r2"), 9).alias("mean_r2"), q(0.5).alias("median_r2"), q(0.9).alias("q90_r2"), q(0.95).alias("q95_r2"),
        F.min(F.when(F.col("r2").isNotNull(), F.col("n"))).alias("least_n"), F.max(F.when(F.col("r2").isNotNull(), F.col("n"))).alias("most_n"), F.count_if(F.col("r2") >= 0.2).alias("n_high"),
    ).withColumn("chromosome", F.coalesce("chromosome", F.lit("ALL")))
    dense = names.withColumn("bin_bp", F.explode(F.array(*[F.lit(b).cast("long") for b in BINS])))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pairs", "n_valid")]
    return dense.join(stats, [*by, "chromosome", "bin_bp"], "left").select(*by, "chromosome", "bin_bp", *zero, "mean_r2", "median_r2", "q90_r2", "q95_r2", "least_n", "most_n", F.coalesce("n_high", F.lit(0)).alias("n_high"))


def _binned(pairs):
    """Zero is a bin of its own; above it a bin reaches from above its lower to its upper edge."""
    edge = F.when(F.col("distance") == 0, 0)
    for hi in BINS[1:]:
        edge = edge.when(F.col("distance") <= hi, hi)
    return pairs.withColumn("bin_bp", edge.cast("long"))


def _names(spark, sf):
    return calls(spark, sf).select("chromosome").distinct().unionByName(spark.createDataFrame([("ALL",)], "chromosome string"))


def r2_distance_profile(spark, sf):
    return _profile(_binned(_pairs(spark, sf)), _names(spark, sf))


def r2_profile_by_basis(spark, sf):
    """The profile for all samples and without the first two, each by original and by corrected distance."""
    rows = None
    for basis, position in (("original", "position"), ("corrected", "corrected")):
        near = _band(spark, sf, position, extra=("dosage",))
        for group, drop in (("all_samples", 0), ("without_first_two", 2)):
            part = _correlated(near, drop).select(F.lit(group).alias("sample_group"), F.lit(basis).alias("basis"), "chromosome", "distance", "n", "r2")
            rows = part if rows is None else rows.unionByName(part)
    kinds = spark.createDataFrame([(g, b) for g in ("all_samples", "without_first_two") for b in ("original", "corrected")], "sample_group string, basis string")
    return _profile(_binned(rows), _names(spark, sf).crossJoin(F.broadcast(kinds)), "sample_group", "basis")


def sample_sensitivity(spark, sf):
    """All samples against those without the first two: paired differences and crossings of 0.2."""
    full = _pairs(spark, sf).select("chromosome", "i", "j", F.col("r2").alias("a"))
    less = _pairs(spark, sf, 2).select("i", "j", F.col("r2").alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    both = full.join(less, ["i", "j"])
    return both.groupBy("chromosome").agg(
        F.count("*").alias("n_pairs"), F.count(d).alias("n_both"), F.round(F.percentile(d, 0.5), 9).alias("median_abs"), F.round(F.percentile(d, 0.95), 9).alias("q95_abs"), F.round(F.max(d), 9).alias("max_abs"),
        F.count_if((F.col("a") >= 0.1) & (F.col("b") < 0.1)).alias("n_lost"), F.count_if((F.col("a") < 0.1) & (F.col("b") >= 0.1)).alias("n_gained"),
    )


def _both_ways(pairs):
    return pairs.select(F.col("i").alias("marker"), F.col("j").alias("partner"), "r2").unionByName(pairs.select(F.col("j").alias("marker"), F.col("i").alias("partner"), "r2"))


def best_neighbor(spark, sf):
    """Best valid partner of each marker, ties to the lowest; markers without one keep a row."""
    ways = _both_ways(_pairs(spark, sf))
    best = ways.groupBy("marker").agg(F.count("*").alias("n_partners"), F.count("r2").alias("n_valid"), F.max_by(F.struct("partner", "r2"), F.when(F.col("r2").isNotNull(), F.struct("r2", -F.col("partner")))).alias("x"))
    rows = calls(spark, sf).select("marker").join(best, "marker", "left")
    status = F.when(F.col("n_valid") > 0, "EVALUABLE").when(F.col("n_partners") > 0, "NO_VALID_PAIR").otherwise("NO_OTHER_MARKER_IN_WINDOW")
    ok = F.col("n_valid") > 0
    return rows.select("marker", F.coalesce("n_partners", F.lit(0)).alias("n_partners"), F.when(ok, F.col("x.partner")).alias("partner"), F.when(ok, F.round("x.r2", 9)).alias("r2"), status.alias("status"))


def neighbor_summary(spark, sf):
    rows = best_neighbor(spark, sf).withColumn("threshold", F.explode(F.array(F.lit(0.05), F.lit(0.1), F.lit(0.2))))
    hit = F.count_if(F.col("r2") >= F.col("threshold"))
    return rows.groupBy("threshold").agg(F.count("*").alias("n_markers"), F.count("r2").alias("n_evaluable"), hit.alias("n_hit"), F.round(F.try_divide(hit, F.count("*")), 9).alias("fraction_all"), F.round(F.try_divide(hit, F.count("r2")), 9).alias("fraction_evaluable"))


def _two_panels(spark, sf):
    key = ["marker", "sample"]
    a, b = _long(spark, sf), _long(spark, sf, True).select(*key, F.col("symbol").alias("symbol2"))
    return a.join(b, key)


def panel_concordance(spark, sf):
    rows = _two_panels(spark, sf)
    called = (F.col("symbol") != "N") & (F.col("symbol2") != "N")
    same = F.count_if(called & (F.col("symbol") == F.col("symbol2")))
    swap = F.count_if(called & (F.translate("symbol", "AC", "CA") == F.col("symbol2")))
    return rows.groupBy("marker").agg(F.count("*").alias("n_shared"), F.count_if(called).alias("n_paired"), F.count_if((F.col("symbol") == "N") & (F.col("symbol2") == "N")).alias("n_both_missing"), F.round(F.try_divide(same, F.count_if(called)), 9).alias("concordance"), F.round(F.try_divide(swap, F.count_if(called)), 9).alias("swap_concordance"))


def discordance_transitions(spark, sf):
    return _two_panels(spark, sf).filter("symbol <> symbol2").groupBy("sample", "symbol", "symbol2").agg(F.count("*").alias("n"))


def common_panel(spark, sf):
    """Markers of both exports that pass quality in both, with the dosages that differ."""
    a = marker_quality(_panel(spark, sf)).filter("keep").select("marker", "chromosome", "position", "dosage")
    b = marker_quality(_panel(spark, sf, True)).filter("keep").select("marker", F.col("chromosome").alias("c2"), F.col("position").alias("p2"), F.col("dosage").alias("d2"))
    differ = F.size(F.filter(F.zip_with("dosage", "d2", lambda x, y: ~x.eqNullSafe(y)), lambda z: z)).cast("long")
    rank = (F.row_number().over(W.partitionBy("chromosome").orderBy("position", "marker")) - 1).cast("long")
    return a.join(b, "marker").select("marker", "chromosome", ((F.col("chromosome") == F.col("c2")) & (F.col("position") == F.col("p2"))).alias("agrees"), differ.alias("n_differ"), rank.alias("rank"))


def _complete(spark, sf):
    return marker_quality(_panel(spark, sf)).filter("variance > 0 AND forall(dosage, x -> x IS NOT NULL)").select("marker", "chromosome", "position", "dosage")


def relationship_kernel(spark, sf):
    """Diagonal of each held-out kernel, and the first eigenvalues."""
    models = adjusted.held_out_models([r.asDict() for r in adjusted.gram_sums(_complete(spark, sf)).orderBy("chromosome").collect()])
    rows = [(c, i, float(m["kernel"][i, i]), float(m["values"][i]), int(m["n"])) for c, m in sorted(models.items()) for i in range(len(m["kernel"]))]
    return spark.createDataFrame(rows, "held_out string, sample int, self_kinship double, eigenvalue double, n_markers long")


def adjusted_r2(spark, sf):
    rows = _complete(spark, sf)
    models = adjusted.held_out_models([r.asDict() for r in adjusted.gram_sums(rows).orderBy("chromosome").collect()])
    units = adjusted.unit_vectors(rows, models)
    near = _band(spark, sf).select("i", "j", "chromosome", "distance")
    u = units.select(F.col("marker").alias("i"), "model", F.col("unit").alias("u"))
    v = units.select(F.col("marker").alias("j"), "model", F.col("unit").alias("v"))
    dot = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return near.join(u, "i").join(v, ["j", "model"]).select("chromosome", "i", "j", "model", F.least(F.lit(1.0), dot * dot).alias("r2"))


def adjustment_transitions(spark, sf):
    """RAW against each adjusted model: pairs kept, lost and gained at 0.1."""
    rows = adjusted_r2(spark, sf)
    raw = rows.filter("model = 'RAW'").select("i", "j", F.col("r2").alias("raw"))
    both = rows.filter("model <> 'RAW'").join(raw, ["i", "j"])
    hi, was = F.col("r2") >= 0.1, F.col("raw") >= 0.1
    return both.groupBy("model").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("r2").isNotNull() & F.col("raw").isNotNull()).alias("n_valid"), F.count_if(hi & was).alias("n_retained"), F.count_if(~hi & was).alias("n_lost"), F.count_if(hi & ~was).alias("n_gained"))


def thinned_background(spark, sf):
    rows = calls(spark, sf).select("marker", "chromosome", "position", (F.col("marker") / 3).cast("long").alias("family"))
    held = rows.select(F.col("chromosome").alias("held_out")).distinct()
    return adjusted.thin(rows.crossJoin(F.broadcast(held)).filter("held_out <> chromosome"))


def tolerant_neighbor(spark, sf):
    return adjusted.tolerant_best(_both_ways(_pairs(spark, sf))).withColumn("r2", F.round("r2", 9))


def nearest_best_partner(spark, sf):
    """Best partner by r2 to one digit, so that ties occur: the first by corrected position."""
    ways = _both_ways(_pairs(spark, sf)).withColumn("r2", F.round("r2", 1))
    at = _panel(spark, sf).select(F.col("marker").alias("partner"), F.col("corrected").alias("position"))
    return adjusted.best_partner(ways.join(at, "partner"))


QUERIES = {f.__name__: f for f in (dosage_decode, symbol_totals, symbol_patterns, marker_qc, sample_qc, band_pairs, pair_inventory_union, window_membership_changes, context_pair_sample, pairwise_r2, r2_distance_profile, r2_profile_by_basis, sample_sensitivity, best_neighbor, neighbor_summary, panel_concordance, discordance_transitions, common_panel, relationship_kernel, adjusted_r2, adjustment_transitions, thinned_background, tolerant_neighbor, nearest_best_partner)}

_CALLS = calls_sql()
_D = "CASE symbol WHEN 'A' THEN 0 WHEN 'M' THEN 1 WHEN 'C' THEN 2 END"
_QC = f"""d AS (SELECT *, {_D} AS d FROM calls), qc0 AS (SELECT marker, count(*) AS m, count(d) AS n, coalesce(sum(d), 0) AS s, coalesce(sum(d * d), 0) AS s2 FROM d GROUP BY 1),
qc AS (SELECT marker, n AS n_called, n / m AS call_rate, CASE WHEN n > 0 THEN least(s / (2 * n), 1 - s / (2 * n)) END AS maf, CAST(n * s2 - s * s AS BIGINT) AS variance FROM qc0),
kept AS (SELECT *, call_rate >= 0.9 AND coalesce(maf, 0) >= 0.05 AND variance > 0 AS keep FROM qc)"""
_M = "mk AS (SELECT DISTINCT marker, chromosome, position, position + (marker % 7) * 3000 AS corrected FROM calls)"
_BAND = f"{_M}, band AS (SELECT a.chromosome, a.marker AS i, b.marker AS j, abs(a.position - b.position) AS distance FROM mk a JOIN mk b ON a.chromosome = b.chromosome AND a.marker < b.marker AND abs(a.position - b.position) <= {BAND})"


def _r2(name: str, where: str = "") -> str:
    return f"""{name}s AS (SELECT p.chromosome, p.i, p.j, p.distance, count(x.d + y.d) AS n, sum(x.d) FILTER (y.d IS NOT NULL) AS sx, sum(y.d) FILTER (x.d IS NOT NULL) AS sy, sum(x.d * y.d) AS sxy, sum(x.d * x.d) FILTER (y.d IS NOT NULL) AS sxx, sum(y.d * y.d) FILTER (x.d IS NOT NULL) AS syy
 FROM band p JOIN d x ON x.marker = p.i JOIN d y ON y.marker = p.j AND x.sample = y.sample {where} GROUP BY ALL),
{name} AS (SELECT *, CASE WHEN n < {MIN_SAMPLES} THEN 1 WHEN n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN 0 ELSE 2 END AS status, CASE WHEN n >= {MIN_SAMPLES} AND n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0
 THEN least(1.0, CAST(n * sxy - sx * sy AS DOUBLE) * CAST(n * sxy - sx * sy AS DOUBLE) / (CAST(n * sxx - sx * sx AS DOUBLE) * CAST(n * syy - sy * sy AS DOUBLE))) END AS r2 FROM {name}s)"""


_PAIRS = f"WITH {_CALLS}, d AS (SELECT *, {_D} AS d FROM calls), {_BAND}, {_r2('pr')}"
_BEST = f"""{_PAIRS}, ways AS (SELECT i AS marker, j AS partner, r2 FROM pr UNION ALL SELECT j, i, r2 FROM pr), b AS (SELECT marker, count(*) AS n_partners, count(r2) AS n_valid FROM ways GROUP BY 1),
t AS (SELECT marker, partner, r2 FROM (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY r2 DESC, partner) AS n FROM ways WHERE r2 IS NOT NULL) WHERE n = 1),
best AS (SELECT m.marker, coalesce(n_partners, 0) AS n_partners, partner, round(r2, 9) AS r2, CASE WHEN n_valid > 0 THEN 'EVALUABLE' WHEN n_partners > 0 THEN 'NO_VALID_PAIR' ELSE 'NO_OTHER_MARKER_IN_WINDOW' END AS status FROM (SELECT DISTINCT marker FROM calls) m LEFT JOIN b USING (marker) LEFT JOIN t USING (marker))"""
_BIN = "CAST(CASE WHEN distance = 0 THEN 0 WHEN distance <= 5000 THEN 5000 WHEN distance <= 20000 THEN 20000 ELSE 50000 END AS BIGINT)"
_STATS = "count(*) AS n_pairs, count(r2) AS n_valid, round(avg(r2), 9) AS mean_r2, round(quantile_cont(r2, 0.5), 9) AS median_r2, round(quantile_cont(r2, 0.9), 9) AS q90_r2, round(quantile_cont(r2, 0.95), 9) AS q95_r2, min(n) FILTER (r2 IS NOT NULL) AS least_n, max(n) FILTER (r2 IS NOT NULL) AS most_n, count(*) FILTER (r2 >= 0.2) AS n_high"
_FILLED = "coalesce(n_pairs, 0) AS n_pairs, coalesce(n_valid, 0) AS n_valid, mean_r2, median_r2, q90_r2, q95_r2, least_n, most_n, coalesce(n_high, 0) AS n_high"
_TWO = f"WITH {_CALLS}, {calls_sql('calls2', True)}, two AS (SELECT a.marker, a.sample, a.symbol, b.symbol AS symbol2 FROM calls a JOIN calls2 b USING (marker, sample))"
_CHANGES = " UNION ALL ".join(f"""SELECT chromosome, count(*) FILTER (o AND c) AS n_both, count(*) FILTER (o AND NOT c) AS n_original_only, count(*) FILTER (c AND NOT o) AS n_corrected_only, CAST({w} AS BIGINT) AS window_bp
 FROM (SELECT a.chromosome, abs(a.position - b.position) <= {w} AS o, abs(a.corrected - b.corrected) <= {w} AS c FROM mk a JOIN mk b ON a.chromosome = b.chromosome AND a.marker < b.marker) WHERE o OR c GROUP BY 1""" for w in (10_000, 50_000))

ORACLE_SQL = {
    "nearest_best_partner": f"""{_PAIRS}, w AS (SELECT i AS marker, j AS partner, round(r2, 1) AS r2 FROM pr UNION ALL SELECT j, i, round(r2, 1) FROM pr), b AS (SELECT *, max(r2) OVER (PARTITION BY marker) AS most FROM w WHERE r2 IS NOT NULL),
t AS (SELECT b.marker, b.partner, mk.corrected AS position, b.r2, count(*) OVER (PARTITION BY b.marker) AS n_tied, row_number() OVER (PARTITION BY b.marker ORDER BY mk.corrected, b.partner) AS rn FROM b JOIN mk ON mk.marker = b.partner WHERE most - r2 <= 1e-12)
SELECT marker, partner, position, r2, n_tied FROM t WHERE rn = 1""",
    "dosage_decode": f"""WITH {_CALLS} SELECT marker, count(*) FILTER (symbol = 'A') AS n_0, count(*) FILTER (symbol = 'M') AS n_1, count(*) FILTER (symbol = 'C') AS n_2, count(*) FILTER (symbol = 'N') AS n_missing, string_agg(coalesce(CAST({_D} AS VARCHAR), '.'), '' ORDER BY sample) AS dosages FROM calls GROUP BY 1""",
    "symbol_totals": f"WITH {_CALLS} SELECT symbol, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS fraction FROM calls GROUP BY 1",
    "symbol_patterns": f"WITH {_CALLS}, p AS (SELECT marker, string_agg(symbol, '' ORDER BY symbol) AS pattern FROM (SELECT DISTINCT marker, symbol FROM calls) GROUP BY 1) SELECT pattern, count(*) AS n_markers, min(marker) AS first_marker FROM p GROUP BY 1",
    "marker_qc": f"WITH {_CALLS}, {_QC} SELECT marker, n_called, round(call_rate, 9) AS call_rate, round(maf, 9) AS maf, variance, keep FROM kept",
    "sample_qc": f"WITH {_CALLS}, {_QC} SELECT CAST(sample AS INTEGER) AS sample, count(*) AS n_markers, round(count(d) / count(*), 9) AS call_rate, round(count(*) FILTER (d = 1) / nullif(count(d), 0), 9) AS het_fraction FROM d JOIN kept USING (marker) WHERE keep GROUP BY 1",
    "band_pairs": f"WITH {_CALLS}, {_BAND} SELECT chromosome, i, j, distance FROM band",
    "pair_inventory_union": f"""WITH {_CALLS}, {_M}, p AS (SELECT a.marker AS i, b.marker AS j, abs(a.position - b.position) <= {BAND} AS o, abs(a.corrected - b.corrected) <= {BAND} AS c FROM mk a JOIN mk b ON a.chromosome = b.chromosome AND a.marker < b.marker)
SELECT i, j, o AS original_local, c AS corrected_local FROM p WHERE o OR c""",
    "window_membership_changes": f"WITH {_CALLS}, {_M} {_CHANGES}",
    "context_pair_sample": f"""WITH {_CALLS}, {_M}, p AS (SELECT CASE WHEN a.chromosome = b.chromosome THEN 'distant' ELSE 'interchromosomal' END AS pair_class, a.marker AS a, b.marker AS b,
 row_number() OVER (PARTITION BY a.chromosome = b.chromosome ORDER BY a.chromosome, a.position, a.marker, b.chromosome, b.position, b.marker) - 1 AS rank FROM mk a JOIN mk b ON (a.chromosome = b.chromosome AND b.position >= a.position + {FAR}) OR a.chromosome < b.chromosome),
w AS (SELECT pair_class, count(*) AS whole FROM p GROUP BY 1), k AS (SELECT pair_class, whole * k // {SAMPLE} AS low, whole * (k + 1) // {SAMPLE} AS high, k FROM w, range({SAMPLE}) t(k)),
r AS (SELECT pair_class, low + ((k * 1103515245 + 12345) % 2147483648) % (high - low) AS rank FROM k WHERE high > low) SELECT pair_class, rank, a, b FROM p JOIN r USING (pair_class, rank)""",
    "pairwise_r2": f"{_PAIRS} SELECT i, j, n, status, round(r2, 9) AS r2 FROM pr",
    "r2_distance_profile": f"""{_PAIRS}, b AS (SELECT chromosome, r2, n, {_BIN} AS bin_bp FROM pr),
s AS (SELECT coalesce(chromosome, 'ALL') AS chromosome, bin_bp, {_STATS} FROM b GROUP BY GROUPING SETS ((chromosome, bin_bp), (bin_bp))),
g AS (SELECT chromosome, CAST(bin AS BIGINT) AS bin_bp FROM (SELECT DISTINCT chromosome FROM calls UNION ALL SELECT 'ALL'), (VALUES (0), (5000), (20000), (50000)) v(bin))
SELECT g.chromosome, g.bin_bp, {_FILLED} FROM g LEFT JOIN s ON g.chromosome = s.chromosome AND g.bin_bp = s.bin_bp""",
    "r2_profile_by_basis": f"""WITH {_CALLS}, d AS (SELECT *, {_D} AS d FROM calls), {_M},
nb AS (SELECT a.chromosome, a.marker AS i, b.marker AS j, basis, abs(CASE basis WHEN 'original' THEN a.position - b.position ELSE a.corrected - b.corrected END) AS distance FROM mk a JOIN mk b ON a.chromosome = b.chromosome AND a.marker < b.marker, (VALUES ('original'), ('corrected')) k(basis)),
near AS (SELECT * FROM nb WHERE distance <= {BAND}),
x AS (SELECT near.*, sample_group, p.d AS x, q.d AS y FROM near JOIN d p ON p.marker = i JOIN d q ON q.marker = j AND q.sample = p.sample, (VALUES ('all_samples', 0), ('without_first_two', 2)) g(sample_group, skip) WHERE p.sample >= skip),
e AS (SELECT sample_group, basis, chromosome, i, j, distance, count(x + y) AS n, sum(x) FILTER (y IS NOT NULL) AS sx, sum(y) FILTER (x IS NOT NULL) AS sy, sum(x * y) AS sxy, sum(x * x) FILTER (y IS NOT NULL) AS sxx, sum(y * y) FILTER (x IS NOT NULL) AS syy FROM x GROUP BY ALL),
b AS (SELECT *, CASE WHEN n >= {MIN_SAMPLES} AND n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN least(1.0, CAST(n * sxy - sx * sy AS DOUBLE) * CAST(n * sxy - sx * sy AS DOUBLE) / (CAST(n * sxx - sx * sx AS DOUBLE) * CAST(n * syy - sy * sy AS DOUBLE))) END AS r2, {_BIN} AS bin_bp FROM e),
s AS (SELECT sample_group, basis, coalesce(chromosome, 'ALL') AS chromosome, bin_bp, {_STATS} FROM b GROUP BY GROUPING SETS ((sample_group, basis, chromosome, bin_bp), (sample_group, basis, bin_bp))),
g AS (SELECT sample_group, basis, chromosome, CAST(bin AS BIGINT) AS bin_bp FROM (SELECT DISTINCT chromosome FROM calls UNION ALL SELECT 'ALL'), (VALUES (0), (5000), (20000), (50000)) v(bin), (VALUES ('all_samples'), ('without_first_two')) h(sample_group), (VALUES ('original'), ('corrected')) k(basis))
SELECT g.sample_group, g.basis, g.chromosome, g.bin_bp, {_FILLED} FROM g LEFT JOIN s USING (sample_group, basis, chromosome, bin_bp)""",
    "sample_sensitivity": f"""{_PAIRS}, {_r2('lw', 'AND x.sample >= 2')}, b AS (SELECT pr.chromosome, pr.r2 AS a, lw.r2 AS b, abs(pr.r2 - lw.r2) AS d FROM pr JOIN lw USING (i, j))
SELECT chromosome, count(*) AS n_pairs, count(d) AS n_both, round(quantile_cont(d, 0.5), 9) AS median_abs, round(quantile_cont(d, 0.95), 9) AS q95_abs, round(max(d), 9) AS max_abs, count(*) FILTER (a >= 0.1 AND b < 0.1) AS n_lost, count(*) FILTER (a < 0.1 AND b >= 0.1) AS n_gained FROM b GROUP BY 1""",
    "best_neighbor": f"{_BEST} SELECT * FROM best",
    "neighbor_summary": f"""{_BEST} SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS n_markers, count(r2) AS n_evaluable, count(*) FILTER (r2 >= threshold) AS n_hit, round(count(*) FILTER (r2 >= threshold) / count(*), 9) AS fraction_all, round(count(*) FILTER (r2 >= threshold) / nullif(count(r2), 0), 9) AS fraction_evaluable
FROM best, (VALUES (0.05), (0.1), (0.2)) v(threshold) GROUP BY 1""",
    "panel_concordance": f"""{_TWO} SELECT marker, count(*) AS n_shared, count(*) FILTER (symbol <> 'N' AND symbol2 <> 'N') AS n_paired, count(*) FILTER (symbol = 'N' AND symbol2 = 'N') AS n_both_missing, round(count(*) FILTER (symbol <> 'N' AND symbol = symbol2) / nullif(count(*) FILTER (symbol <> 'N' AND symbol2 <> 'N'), 0), 9) AS concordance,
 round(count(*) FILTER (symbol <> 'N' AND symbol2 <> 'N' AND translate(symbol, 'AC', 'CA') = symbol2) / nullif(count(*) FILTER (symbol <> 'N' AND symbol2 <> 'N'), 0), 9) AS swap_concordance FROM two GROUP BY 1""",
    "discordance_transitions": f"{_TWO} SELECT CAST(sample AS INTEGER) AS sample, symbol, symbol2, count(*) AS n FROM two WHERE symbol <> symbol2 GROUP BY ALL",
    "common_panel": f"""WITH {_CALLS}, {calls_sql('calls2', True)}, {_QC}, {_QC.replace('d AS (', 'e AS (', 1).replace('FROM calls)', 'FROM calls2)').replace('qc0', 'rc0').replace('FROM d ', 'FROM e ').replace('qc AS', 'rc AS').replace('kept AS', 'kept2 AS').replace('FROM qc)', 'FROM rc)')},
f AS (SELECT d.marker, any_value(d.chromosome) AS chromosome, any_value(d.position) AS position, count(*) FILTER (d.d IS DISTINCT FROM e.d) AS n_differ FROM d JOIN e USING (marker, sample) WHERE d.marker IN (SELECT marker FROM kept WHERE keep) AND d.marker IN (SELECT marker FROM kept2 WHERE keep) GROUP BY 1)
SELECT marker, chromosome, true AS agrees, n_differ, row_number() OVER (PARTITION BY chromosome ORDER BY position, marker) - 1 AS rank FROM f""",
    "tolerant_neighbor": f"{_BEST} SELECT marker, partner, r2 FROM best WHERE status = 'EVALUABLE'",
}
