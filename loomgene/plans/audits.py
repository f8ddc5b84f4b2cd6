"""Inventories, cross-tabulations and audits of the other results, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgene.functions import scalars as S
from loomgene.operators import identity as I
from loomgene.plans import coverage, genotypes, records
from loomgene.plans.views import ASSOC, INTERVALS, LOCI, assoc, calls, calls_sql, intervals, loci


def distinct_intervals(spark, sf):
    """Each place and set once, with an id from its content and the number of its rows."""
    rows = intervals(spark, sf).groupBy("chromosome", (F.floor(F.col("start") / 100) * 100).alias("start"), "query_set").agg(F.count("*").alias("n_rows"))
    return rows.withColumn("interval_id", S.stable_id(F.col("chromosome"), F.col("start"), F.col("query_set")))


def sheet_audit(spark, sf):
    key = F.struct("chromosome", "peak", "trait")
    return assoc(spark, sf).groupBy("sheet").agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_events"), F.count_distinct("trait").alias("n_traits"), F.count_distinct("chromosome", "peak").alias("n_peaks"), F.count_if(F.col("payload").isNull()).alias("n_no_payload"))


def resource_summary(spark, sf):
    return loci(spark, sf).groupBy("resource").agg(
        F.count("*").alias("n_records"), F.count_distinct("record_key").alias("n_keys"), F.count_distinct("chromosome").alias("n_chromosomes"),
        F.count_distinct("chromosome", "orig").alias("n_positions"), F.count_if("accepted").alias("n_accepted"), F.count_if(F.col("orig") != F.col("ref")).alias("n_moved"),
    )


def symbol_diagnostics(spark, sf):
    """Markers of a chromosome by the symbols they show: how many rows, calls of each, and markers with a rare symbol."""
    n = lambda s: F.size(F.filter("symbols", lambda x: x == s)).cast("long")
    rows = calls(spark, sf).select("chromosome", *[n(s).alias(f"n_{s.lower()}") for s in "ACMN"])
    return rows.groupBy("chromosome").agg(F.count("*").alias("n_markers"), *[F.sum(f"n_{s}").alias(f"n_{s}") for s in "acmn"], F.count_if(F.col("n_n") == 0).alias("n_complete"), F.max("n_n").alias("most_missing"))


def status_fractions(spark, sf):
    """States of the intervals with their share of all."""
    rows = records.interval_states(spark, sf).groupBy("state").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(rows.agg(F.sum("n").alias("total")))).select("state", "n", F.round(F.col("n") / F.col("total"), 9).alias("fraction"))


def convention_crosstab(spark, sf):
    """Which positional convention turns the original position into the reference one, by resource and acceptance."""
    hypotheses = S.positional_models(F.col("ref"), F.lit(7), F.lit(20))
    first = F.element_at(F.filter(hypotheses, lambda m: m["start"] == F.col("orig")), 1)["model"]
    named = loci(spark, sf).withColumn("fits", F.exists(hypotheses, lambda m: m["start"] == F.col("orig")))
    model = F.when(F.col("fits"), first).otherwise("other_offset")
    relation = S.coordinate_relation(F.col("chromosome"), F.col("orig"), F.col("chromosome"), F.col("ref"))
    return named.groupBy("resource", "accepted", relation.alias("relation"), model.alias("convention")).agg(F.count("*").alias("n"))


def background_range(spark, sf):
    """Extremes of the percentiles over all models of the grid."""
    rows = coverage.background_percentile(spark, sf)
    return rows.groupBy("arm").agg(F.count("*").alias("n_models"), F.min("midrank").alias("least_midrank"), F.max("midrank").alias("most_midrank"), F.count_if(F.col("midrank") >= 95).alias("n_high"))


def filter_groups(spark, sf):
    """Peaks by the set of traits that hold them."""
    sets = assoc(spark, sf).groupBy("chromosome", "peak").agg(F.array_join(F.array_sort(F.collect_set("trait")), "; ").alias("traits"), F.count_distinct("trait").alias("n_traits"))
    return sets.groupBy("traits", "n_traits").agg(F.count("*").alias("n_peaks"))


def recovery_by_policy(spark, sf):
    """Recovered share of candidates by resource, arm and flank; over all candidates, and over those whose chromosome has a point."""
    d = coverage.distances(spark, sf).filter("candidate")
    n = d.withColumn("flank", F.explode(F.array(*[F.lit(w) for w in (0, 20, 100)])))
    out = n.groupBy("resource", "arm", "flank").agg(F.count("*").alias("n_all"), F.count("distance").alias("n_reachable"), F.count_if(F.col("distance") <= F.col("flank")).alias("n_recovered"))
    return out.withColumns({"fraction_all": F.round(F.col("n_recovered") / F.col("n_all"), 9), "fraction_reachable": F.round(F.try_divide("n_recovered", "n_reachable"), 9)})


def inventory_differences(spark, sf):
    """Positions that only one of two resources has, counted by side and chromosome."""
    rows = loci(spark, sf)
    side = lambda r: rows.filter(F.col("resource") == r).select("chromosome", F.col("orig").alias("pos"))
    return I.same_inventory(side("A"), side("R"), ["chromosome", "pos"]).groupBy("side", "chromosome").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def duplicate_positions(spark, sf):
    """Records whose place another record shares: all of them are out."""
    places = loci(spark, sf).groupBy("resource", "chromosome", "orig").agg(F.count("*").alias("k"))
    return places.groupBy("resource", "chromosome").agg(F.count("*").alias("n_places"), F.sum("k").alias("n_records"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("n_excluded"))


def lost_point_reasons(spark, sf):
    """Original points that the reference arm lacks, by the first reason that applies."""
    rows = loci(spark, sf)
    kept = rows.filter("accepted").groupBy("resource", "chromosome", F.col("ref").alias("orig")).agg(F.count("*").alias("n_ref"))
    points = rows.groupBy("resource", "chromosome", "orig").agg(F.count_if("accepted").alias("n_accepted"), F.count("*").alias("n"))
    reason = F.when(F.col("n_accepted") == 0, "no_accepted_record").when(F.col("n_accepted") < F.col("n"), "some_records_accepted_elsewhere").otherwise("all_records_moved")
    lost = points.join(kept, ["resource", "chromosome", "orig"], "left_anti")
    return lost.groupBy("resource", reason.alias("reason")).agg(F.count("*").alias("n_points"), F.sum("n").alias("n_records"))


def pair_flags(spark, sf):
    """Near pairs by tag family and by span: markers of one family, or of one aligned span, aren't independent."""
    rows = genotypes.band_pairs(spark, sf)
    family, span = (F.floor(F.col("i") / 3) == F.floor(F.col("j") / 3)), (F.floor(F.col("i") / 5) == F.floor(F.col("j") / 5))
    return rows.groupBy(family.alias("same_family"), span.alias("same_span")).agg(F.count("*").alias("n_pairs"), F.min("distance").alias("least"), F.max("distance").alias("most"))


def positional_compare(spark, sf):
    """Cells that differ between two tables, row by row in the order of their keys."""
    old, new = records._policies(spark, sf)
    cells = I.compare_by_position(old, new, ["record_key"])
    return cells.groupBy("field", "state").agg(F.count("*").alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


_MODELS = [("tag_start_1based", 0), ("tag_start_0based", 1), ("snp_1based_forward", -7), ("snp_0based_forward", -6), ("snp_1based_reverse", -12), ("snp_0based_reverse", -11), ("tag_end_1based", -19)]
_MODEL = " ".join(f"WHEN orig = ref + ({d}) THEN '{name}'" for name, d in _MODELS)

QUERIES = {f.__name__: f for f in (distinct_intervals, sheet_audit, resource_summary, symbol_diagnostics, status_fractions, convention_crosstab, background_range, filter_groups, recovery_by_policy, inventory_differences, duplicate_positions, lost_point_reasons, pair_flags, positional_compare)}

ORACLE_SQL = {
    "distinct_intervals": f"""WITH {INTERVALS}, d AS (SELECT chromosome, CAST(floor("start" / 100) * 100 AS BIGINT) AS start, query_set, count(*) AS n_rows FROM intervals GROUP BY ALL)
SELECT *, substr(sha256(chromosome || chr(31) || start || chr(31) || query_set), 1, 16) AS interval_id FROM d""",
    "sheet_audit": f"WITH {ASSOC} SELECT sheet, count(*) AS n_rows, count(DISTINCT (chromosome, peak, trait)) AS n_events, count(DISTINCT trait) AS n_traits, count(DISTINCT (chromosome, peak)) AS n_peaks, count(*) FILTER (payload IS NULL) AS n_no_payload FROM assoc GROUP BY 1",
    "resource_summary": f"WITH {LOCI} SELECT resource, count(*) AS n_records, count(DISTINCT record_key) AS n_keys, count(DISTINCT chromosome) AS n_chromosomes, count(DISTINCT (chromosome, orig)) AS n_positions, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (orig <> ref) AS n_moved FROM loci GROUP BY 1",
    "symbol_diagnostics": f"""WITH {calls_sql()}, m AS (SELECT marker, chromosome, count(*) FILTER (symbol = 'A') AS a, count(*) FILTER (symbol = 'C') AS c, count(*) FILTER (symbol = 'M') AS m, count(*) FILTER (symbol = 'N') AS n FROM calls GROUP BY 1, 2)
SELECT chromosome, count(*) AS n_markers, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(c) AS BIGINT) AS n_c, CAST(sum(m) AS BIGINT) AS n_m, CAST(sum(n) AS BIGINT) AS n_n, count(*) FILTER (n = 0) AS n_complete, max(n) AS most_missing FROM m GROUP BY 1""",
    "status_fractions": f"WITH s AS ({records.ORACLE_SQL['interval_states']}), h AS (SELECT state, count(*) AS n FROM s GROUP BY 1) SELECT state, n, round(n / (SELECT sum(n) FROM h), 9) AS fraction FROM h",
    "convention_crosstab": f"WITH {LOCI} SELECT resource, accepted, CASE WHEN orig = ref THEN 'exact_coordinate' ELSE 'same_chromosome_offset' END AS relation, CASE {_MODEL} ELSE 'other_offset' END AS convention, count(*) AS n FROM loci GROUP BY ALL",
    "background_range": f"WITH p AS ({coverage.ORACLE_SQL['background_percentile']}) SELECT arm, count(*) AS n_models, min(midrank) AS least_midrank, max(midrank) AS most_midrank, count(*) FILTER (midrank >= 95) AS n_high FROM p GROUP BY 1",
    "filter_groups": f"WITH {ASSOC}, s AS (SELECT chromosome, peak, string_agg(DISTINCT trait, '; ' ORDER BY trait) AS traits, count(DISTINCT trait) AS n_traits FROM assoc GROUP BY 1, 2) SELECT traits, n_traits, count(*) AS n_peaks FROM s GROUP BY 1, 2",
    "recovery_by_policy": f"""{coverage.COVERAGE}, r AS (SELECT resource, arm, CAST(w AS INTEGER) AS flank, count(*) AS n_all, count(distance) AS n_reachable, count(*) FILTER (distance <= w) AS n_recovered FROM dist, (VALUES (0), (20), (100)) f(w) WHERE candidate GROUP BY ALL)
SELECT *, round(n_recovered / n_all, 9) AS fraction_all, round(n_recovered / nullif(n_reachable, 0), 9) AS fraction_reachable FROM r""",
    "inventory_differences": f"""WITH {LOCI}, a AS (SELECT DISTINCT chromosome, orig AS pos FROM loci WHERE resource = 'A'), b AS (SELECT DISTINCT chromosome, orig AS pos FROM loci WHERE resource = 'R'),
d AS (SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT side, chromosome, count(*) AS n, min(pos) AS first, max(pos) AS last FROM d GROUP BY 1, 2""",
    "duplicate_positions": f"WITH {LOCI}, p AS (SELECT resource, chromosome, orig, count(*) AS k FROM loci GROUP BY ALL) SELECT resource, chromosome, count(*) AS n_places, CAST(sum(k) AS BIGINT) AS n_records, CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS n_excluded FROM p GROUP BY 1, 2",
    "lost_point_reasons": f"""WITH {LOCI}, k AS (SELECT DISTINCT resource, chromosome, ref FROM loci WHERE accepted), p AS (SELECT resource, chromosome, orig, count(*) FILTER (accepted) AS a, count(*) AS n FROM loci GROUP BY ALL)
SELECT p.resource, CASE WHEN a = 0 THEN 'no_accepted_record' WHEN a < n THEN 'some_records_accepted_elsewhere' ELSE 'all_records_moved' END AS reason, count(*) AS n_points, CAST(sum(n) AS BIGINT) AS n_records FROM p ANTI JOIN k ON p.resource = k.resource AND p.chromosome = k.chromosome AND p.orig = k.ref GROUP BY ALL""",
    "pair_flags": f"WITH p AS ({genotypes.ORACLE_SQL['band_pairs']}) SELECT i // 3 = j // 3 AS same_family, i // 5 = j // 5 AS same_span, count(*) AS n_pairs, min(distance) AS least, max(distance) AS most FROM p GROUP BY 1, 2",
    "positional_compare": f"""{records._POL}, a AS (SELECT *, row_number() OVER (ORDER BY record_key) AS row FROM o), b AS (SELECT *, row_number() OVER (ORDER BY record_key) AS row FROM n),
j AS (SELECT coalesce(a.row, b.row) AS row, a.row IS NULL AS nl, b.row IS NULL AS nr, a.record_key IS NOT DISTINCT FROM b.record_key AS s1, a.chromosome IS NOT DISTINCT FROM b.chromosome AS s2, a.position IS NOT DISTINCT FROM b.position AS s3, a.kept IS NOT DISTINCT FROM b.kept AS s4 FROM a FULL JOIN b ON a.row = b.row),
f AS (SELECT row, nl, nr, 'record_key' AS field, s1 AS same FROM j UNION ALL SELECT row, nl, nr, 'chromosome', s2 FROM j UNION ALL SELECT row, nl, nr, 'position', s3 FROM j UNION ALL SELECT row, nl, nr, 'kept', s4 FROM j)
SELECT field, CASE WHEN nl THEN 'only_right' WHEN nr THEN 'only_left' ELSE 'different' END AS state, count(*) AS n, min(row) AS first_row, max(row) AS last_row FROM f WHERE nl OR nr OR NOT same GROUP BY 1, 2""",
}
