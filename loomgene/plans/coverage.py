"""Coverage, cohorts, resampling and backgrounds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgene.operators.nearest import band_pairs, nearest, nearest_each, overlap_pairs, range_neighbours, window_counts
from loomgene.operators.sampling import bin_of, cut_points, dense_quotas, draw, filled, hash_order, percentiles, replicate, requirements, spread
from loomgene.plans.views import ARM_ROWS, COVERAGE, INTERVALS, LOCI, POINTS, SEED, WINDOWS, arms, intervals, loci

REPS = 3
FLANKS = [0, 10, 100]
KEYS = ["resource", "arm", "chromosome"]


def _points(spark, sf):
    return arms(loci(spark, sf)).select(*KEYS, "pos").distinct()


def _sets(points, arms_):
    """(resource, arm) of every point set, and the label of a point's set: nine at most, whatever the data's size."""
    sets = [(r["resource"], a) for r in points.select("resource").distinct().orderBy("resource").collect() for a in arms_]
    at = F.try_element_at(F.create_map(*[F.lit(x) for i, s in enumerate(sets) for x in ("|".join(s), i)]), F.concat_ws("|", "resource", "arm"))
    return sets, at


def _exploded(rows, sets, *columns):
    """A row for each point set: ``columns``, resource, arm, distance."""
    each = F.array(*[F.struct(F.lit(r).alias("resource"), F.lit(a).alias("arm"), F.col("distances")[i].alias("distance")) for i, (r, a) in enumerate(sets)])
    return rows.select(*columns, F.inline(each))


def wide_distances(spark, sf, arms_=("A", "B", "C"), where="true"):
    """Intervals with a distance for each of the point sets, and the sets; what ``where`` leaves out never reaches the windows."""
    points = _points(spark, sf).filter(F.col("arm").isin(*arms_))
    sets, label = _sets(points, arms_)
    return nearest_each(intervals(spark, sf).filter(where), points, ["chromosome"], label, len(sets)), sets


def distances(spark, sf, arms_=("A", "B", "C"), where="true"):
    rows, sets = wide_distances(spark, sf, arms_, where)
    return _exploded(rows, sets, *[c for c in rows.columns if c != "distances"])


def nearest_interval_distance(spark, sf):
    return distances(spark, sf).select("resource", "arm", "query_set", "query_id", "distance")


def coverage_by_window(spark, sf):
    cover = window_counts(distances(spark, sf), ["resource", "arm", "query_set"], WINDOWS)
    size = arms(loci(spark, sf)).groupBy("resource", "arm").agg(F.count("*").alias("n_marker_records"), F.count_distinct("chromosome", "pos").alias("n_unique_positions"))
    return cover.join(size, ["resource", "arm"]).withColumn("fraction_recovered", F.round("fraction_recovered", 9))


def paired_arm_transitions(spark, sf):
    """Per resource, set and flank: recovered by each arm, gains and losses of C against B; B must lie within A."""
    wide, sets = wide_distances(spark, sf)
    place = {s: i for i, s in enumerate(sets)}
    each = F.array(*[F.struct(F.lit(r).alias("resource"), *[F.col("distances")[place[r, a]].alias(a) for a in "ABC"]) for r in sorted({r for r, _ in sets})])
    d = wide.select("query_set", F.inline(each))
    hit = {(a, w): F.coalesce(F.col(a) <= w, F.lit(False)) for a in "ABC" for w in WINDOWS}
    # One row per resource and set comes out of the map side; flanks are unfolded only then.
    sums = {"n": lambda w: F.count("*"), "a": lambda w: F.count_if(hit["A", w]), "b": lambda w: F.count_if(hit["B", w]), "c": lambda w: F.count_if(hit["C", w])}
    sums |= {"gain": lambda w: F.count_if(~hit["B", w] & hit["C", w]), "loss": lambda w: F.count_if(hit["B", w] & ~hit["C", w]), "bad": lambda w: F.count_if(hit["B", w] & ~hit["A", w])}
    wide = d.groupBy("resource", "query_set").agg(*[f(w).alias(f"{k}{w}") for k, f in sums.items() for w in WINDOWS])
    rows = wide.select("resource", "query_set", F.inline(F.array(*[F.struct(F.lit(w).cast("long").alias("flank_bp"), *[F.col(f"{k}{w}").alias(k) for k in sums]) for w in WINDOWS])))
    checked = F.when((F.col("bad") > 0) | (F.col("gain") - F.col("loss") != F.col("c") - F.col("b")), F.raise_error(F.lit("arms do not nest"))).otherwise(F.col("c") - F.col("b"))
    named = [F.col(k).alias(f"n_{'queries' if k == 'n' else k}") for k in ("n", "a", "b", "c", "gain", "loss")]
    return rows.select("resource", "query_set", "flank_bp", *named, (F.col("b") - F.col("a")).alias("selection_delta"), checked.cast("long").alias("coordinate_delta"), (F.col("c") - F.col("a")).alias("total_delta"))


def cohort_ledger(spark, sf):
    """in_A, in_B, in_C and the first reason that applies; a valid position lies on its chromosome."""
    valid = F.col("orig").between(1, 90_000)
    rows = loci(spark, sf)
    in_b = F.col("accepted") & valid
    reason = F.when(in_b, "PAIRED_B_C").when(valid, "CONTEXT_ONLY_ORIGINAL").when(F.col("accepted"), "UNPAIRED_ORIGINAL_COORDINATE_INVALID").otherwise("ORIGINAL_COORDINATE_INVALID")
    return rows.select("record_key", "resource", "chromosome", valid.alias("in_a"), in_b.alias("in_b"), in_b.alias("in_c"), reason.alias("cohort_reason"))


def cohort_counts(spark, sf):
    """Records and positions for every resource, arm and chromosome, zero rows included."""
    rows = arms(loci(spark, sf))
    dims = rows.select("resource").distinct().crossJoin(rows.select("arm").distinct()).crossJoin(rows.select("chromosome").distinct())
    counts = rows.groupBy(*KEYS).agg(F.count("*").alias("n_records"), F.count_distinct("pos").alias("n_positions"))
    return F.broadcast(dims).join(counts, KEYS, "left").select(*KEYS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_records", "n_positions")])


def chromosome_quotas(spark, sf):
    return dense_quotas(_points(spark, sf).filter("arm <> 'B'"), ["arm"], "resource", "chromosome")


def count_matched_resample(spark, sf):
    """Each interval once per replicate; the point sets of a replicate are labels of its positions."""
    points = _points(spark, sf).filter("arm <> 'B'").withColumn("label", F.concat_ws(":", "resource", "arm", "chromosome"))
    drawn = _drawn(points, chromosome_quotas(spark, sf))
    sets, label = _sets(points, ("A", "C"))
    queries = replicate(intervals(spark, sf).select("query_id", "chromosome", "start", "end", "query_set"), REPS)
    wide = nearest_each(queries, drawn, ["chromosome", "rep"], label, len(sets))
    counts = window_counts(_exploded(wide, sets, "query_set", "rep"), ["resource", "arm", "query_set", "rep"], FLANKS)
    return spread(counts.withColumn("value", F.col("n_recovered").cast("double")), ["resource", "arm", "query_set", "flank_bp"], "value")


def _drawn(points, quotas):
    """Per replicate, as many positions of each set and chromosome as its quota. Quotas are one row per arm and chromosome, left to the optimizer to send or shuffle."""
    by = ["resource", "arm", "chromosome"]
    pool = replicate(points.join(quotas, ["arm", "chromosome"]), REPS)
    order = hash_order(SEED, F.col("label"), "rep", "pos")
    n = F.row_number().over(W.partitionBy("rep", *by).orderBy(order, "pos"))
    return pool.withColumn("n", n).filter("n <= quota").select(*by, "rep", "pos")


def gene_density_range(spark, sf):
    rows = intervals(spark, sf).withColumn("mid", F.floor((F.col("start") + F.col("end")) / 2).cast("long"))
    return range_neighbours(rows, "chromosome", "mid", 250, "n_near").select("query_id", "mid", "n_near")


def strata_bins(spark, sf):
    """Quantile cuts of non-candidates' lengths per biotype, ties collapsed, and every gene's bin."""
    rows = intervals(spark, sf).withColumn("length", (F.col("end") - F.col("start") + 1).cast("double"))
    cuts = cut_points(rows.filter("NOT candidate"), "biotype", "length", 4)
    binned = rows.join(F.broadcast(cuts), "biotype").withColumn("length_bin", bin_of(F.col("length"), F.col("cuts")))
    return binned.select("query_id", "biotype", F.col("length_bin").cast("int").alias("length_bin"))


STRATA = ["chromosome", "biotype", "length_bin"]


def _genes(spark, sf):
    return intervals(spark, sf).withColumn("length_bin", F.floor((F.col("end") - F.col("start")) / 100).cast("int"))


def _draws(spark, sf, reps=REPS):
    genes = _genes(spark, sf)
    quotas = filled(requirements(genes.filter("candidate"), genes.filter("NOT candidate"), STRATA)).select(*STRATA, "quota")
    pool = replicate(genes.filter("NOT candidate").select(*STRATA, "query_id"), reps)
    return draw(pool, quotas, STRATA, "rep", hash_order(SEED, "background", "rep", "query_id"), "query_id")


def background_draws(spark, sf):
    """Per replicate: size, mean length and digest of the sorted ids drawn; a draw is as large as the candidates, not as the pool."""
    ids = F.array_join(F.array_sort(F.collect_list(F.col("query_id"))), "\n")
    size = intervals(spark, sf).select("query_id", (F.col("end") - F.col("start") + 1).alias("length"))
    drawn = _draws(spark, sf).join(size, "query_id")
    return drawn.groupBy("rep", "biotype").agg(F.count("*").alias("n"), F.round(F.avg("length"), 9).alias("mean_length"), F.sha2(ids, 256).alias("ids_sha256"))


def _drawn_counts(spark, sf):
    """Recovered genes of each draw: distances are computed once and shared by all draws."""
    wide, sets = wide_distances(spark, sf, ("A", "C"), "NOT candidate")
    hits = wide.select("query_id", "distances").join(_draws(spark, sf).select("rep", "query_id"), "query_id")
    return window_counts(_exploded(hits, sets, "rep"), ["resource", "arm", "rep"], FLANKS)


def background_summary(spark, sf):
    return spread(_drawn_counts(spark, sf).withColumn("value", F.col("n_recovered").cast("double")), ["resource", "arm", "flank_bp"], "value")


def background_percentile(spark, sf):
    by = ["resource", "arm", "flank_bp"]
    seen = window_counts(distances(spark, sf, ("A", "C"), "candidate"), ["resource", "arm"], FLANKS).select(*by, F.col("n_recovered").alias("observed"))
    out = percentiles(_drawn_counts(spark, sf).withColumnRenamed("n_recovered", "value"), seen, by)
    return out.select(*by, "observed", *[F.round(c, 9).alias(c) for c in ("strict", "midrank", "inclusive")])


def background_blocked_models(spark, sf):
    """Grid of length units; the finest has strata that can't be filled and is blocked as a whole."""
    genes = intervals(spark, sf)
    grid = genes.withColumn("unit", F.explode(F.array(F.lit(500), F.lit(100), F.lit(1)))).withColumn("length_bin", F.floor((F.col("end") - F.col("start")) / F.col("unit")).cast("int"))
    need = requirements(grid.filter("candidate"), grid.filter("NOT candidate"), ["unit", *STRATA])
    short = F.col("required") > F.col("available")
    status = F.when(F.count_if(short) > 0, "BLOCKED_INSUFFICIENT_STRATA").otherwise("COMPLETED_DESCRIPTIVE_BACKGROUND")
    return need.groupBy("unit").agg(F.count("*").alias("n_strata"), F.count_if(short).alias("n_deficit"), F.sum("required").alias("n_required"), status.alias("status"))


def interval_overlap_links(spark, sf):
    """Each candidate with the other set's intervals on its chromosome: overlaps, containments, nearest gap."""
    rows = intervals(spark, sf)
    a = rows.filter("candidate").select("chromosome", "query_id", "start", "end")
    b = rows.filter("NOT candidate AND biotype = 'F'").select("chromosome", F.col("start").alias("s2"), F.col("end").alias("e2"))
    near = nearest(nearest_ready(a), b.select("chromosome", F.explode(F.array("s2", "e2")).alias("pos")), ["chromosome"]).select("query_id", F.col("distance").alias("edge"))
    hits = overlap_pairs(a, b, "chromosome", ("start", "end"), ("s2", "e2")).groupBy("query_id").agg(F.count("*").alias("n_overlap"), F.count_if((F.col("s2") <= F.col("start")) & (F.col("e2") >= F.col("end"))).alias("n_contain"))
    joined = a.join(near, "query_id", "left").join(hits, "query_id", "left")
    return joined.select("query_id", F.coalesce("n_overlap", F.lit(0)).alias("n_overlap"), F.coalesce("n_contain", F.lit(0)).alias("n_contain"), F.when(F.col("n_overlap") > 0, 0).otherwise(F.col("edge")).cast("long").alias("nearest_gap"))


def nearest_ready(rows):
    return rows.select("chromosome", "query_id", "start", "end")


def _peaks(spark, sf):
    return intervals(spark, sf).select("query_id", "chromosome", F.col("start").alias("peak"))


def exact_point_context(spark, sf):
    """Peaks against markers at the same position, by resource; then elsewhere on the chromosome; then nothing."""
    points = arms(loci(spark, sf)).filter("arm = 'A'")
    at = points.groupBy("chromosome", F.col("pos").alias("peak")).agg(F.count("*").alias("n_exact"), F.count_distinct("resource").alias("n_resources"))
    any_ = points.select("chromosome").distinct().withColumn("present", F.lit(True))
    rows = _peaks(spark, sf).join(at, ["chromosome", "peak"], "left").join(F.broadcast(any_), "chromosome", "left")
    label = F.when(F.col("n_exact") > 0, "COLOCATED_REFERENCE_SNP").when(F.col("present"), "ONLY_DIFFERENT_REFERENCE_POSITION").otherwise("NO_SEQUENCE_BACKED_COORDINATE_CONTEXT")
    return rows.select("query_id", F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_resources", F.lit(0)).alias("n_resources"), label.alias("context"))


def window_marker_counts(spark, sf):
    """Distinct marker positions within 50 of a peak, by a bucketed band join."""
    points = arms(loci(spark, sf)).filter("arm = 'A' AND resource = 'N'").select("chromosome", "pos").distinct()
    hits = band_pairs(_peaks(spark, sf), points, "chromosome", 50, "peak", "pos").groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("pos") != F.col("peak")).alias("n_other"))
    return _peaks(spark, sf).join(hits, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_positions"), F.coalesce("n_other", F.lit(0)).alias("n_other"))


_W = ", ".join(f"({w})" for w in WINDOWS)
_F = ", ".join(f"({w})" for w in FLANKS)
_QUOTAS = "quotas AS (SELECT r.arm, k.chromosome, min(coalesce(n, 0)) AS quota FROM (SELECT DISTINCT arm, resource FROM points WHERE arm <> 'B') r JOIN (SELECT DISTINCT arm, chromosome FROM points WHERE arm <> 'B') k ON r.arm = k.arm LEFT JOIN (SELECT arm, resource, chromosome, count(*) AS n FROM points GROUP BY ALL) c ON c.arm = r.arm AND c.resource = r.resource AND c.chromosome = k.chromosome GROUP BY ALL)"
_GENES = """genes AS (SELECT *, CAST(floor(("end" - "start") / 100.0) AS INTEGER) AS length_bin FROM intervals),
need AS (SELECT chromosome, biotype, length_bin, count(*) AS quota FROM genes WHERE candidate GROUP BY ALL),
draws AS (SELECT rep, g.biotype, query_id FROM (SELECT g.*, rep, quota, row_number() OVER (PARTITION BY rep, g.chromosome, g.biotype, g.length_bin ORDER BY sha256(concat_ws('|', 1729, 'background', rep, query_id)), query_id) AS n
 FROM genes g JOIN need USING (chromosome, biotype, length_bin), range(3) t(rep) WHERE NOT candidate) g WHERE n <= quota)"""
_DRAWN = f"drawn AS (SELECT resource, arm, rep, w AS flank_bp, count(*) FILTER (distance <= w) AS value FROM draws JOIN dist USING (query_id), (VALUES {_F}) f(w) WHERE arm <> 'B' GROUP BY ALL)"
_SPREAD = "count(*) AS n_reps, round(avg(CAST(value AS DOUBLE)), 9) AS mean, round(quantile_cont(CAST(value AS DOUBLE), 0.025), 9) AS q025, round(quantile_cont(CAST(value AS DOUBLE), 0.975), 9) AS q975"

QUERIES = {f.__name__: f for f in (nearest_interval_distance, coverage_by_window, paired_arm_transitions, cohort_ledger, cohort_counts, chromosome_quotas, count_matched_resample, gene_density_range, strata_bins, background_draws, background_summary, background_percentile, background_blocked_models, interval_overlap_links, exact_point_context, window_marker_counts)}

ORACLE_SQL = {
    "nearest_interval_distance": f"{COVERAGE} SELECT resource, arm, query_set, query_id, distance FROM dist",
    "coverage_by_window": f"""{COVERAGE}, s AS (SELECT resource, arm, count(*) AS n_marker_records, count(DISTINCT (chromosome, pos)) AS n_unique_positions FROM arm_rows GROUP BY ALL)
SELECT d.resource, d.arm, query_set, CAST(w AS BIGINT) AS flank_bp, count(*) AS n_queries, count(*) FILTER (distance <= w) AS n_recovered, round(count(*) FILTER (distance <= w) / count(*), 9) AS fraction_recovered,
 any_value(n_marker_records) AS n_marker_records, any_value(n_unique_positions) AS n_unique_positions FROM dist d JOIN s ON d.resource = s.resource AND d.arm = s.arm, (VALUES {_W}) f(w) GROUP BY ALL""",
    "paired_arm_transitions": f"""{COVERAGE}, p AS (SELECT resource, query_set, query_id, min(distance) FILTER (arm = 'A') AS a, min(distance) FILTER (arm = 'B') AS b, min(distance) FILTER (arm = 'C') AS c FROM dist GROUP BY ALL),
h AS (SELECT resource, query_set, CAST(w AS BIGINT) AS flank_bp, coalesce(a <= w, false) AS a, coalesce(b <= w, false) AS b, coalesce(c <= w, false) AS c FROM p, (VALUES {_W}) f(w))
SELECT resource, query_set, flank_bp, count(*) AS n_queries, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (c) AS n_c, count(*) FILTER (NOT b AND c) AS n_gain, count(*) FILTER (b AND NOT c) AS n_loss,
 count(*) FILTER (b) - count(*) FILTER (a) AS selection_delta, count(*) FILTER (c) - count(*) FILTER (b) AS coordinate_delta, count(*) FILTER (c) - count(*) FILTER (a) AS total_delta FROM h GROUP BY ALL""",
    "cohort_ledger": f"""WITH {LOCI} SELECT record_key, resource, chromosome, orig BETWEEN 1 AND 90000 AS in_a, accepted AND orig BETWEEN 1 AND 90000 AS in_b, accepted AND orig BETWEEN 1 AND 90000 AS in_c,
 CASE WHEN accepted AND orig BETWEEN 1 AND 90000 THEN 'PAIRED_B_C' WHEN orig BETWEEN 1 AND 90000 THEN 'CONTEXT_ONLY_ORIGINAL' WHEN accepted THEN 'UNPAIRED_ORIGINAL_COORDINATE_INVALID' ELSE 'ORIGINAL_COORDINATE_INVALID' END AS cohort_reason FROM loci""",
    "cohort_counts": f"""WITH {LOCI}, {ARM_ROWS}, d AS (SELECT * FROM (SELECT DISTINCT resource FROM arm_rows), (SELECT DISTINCT arm FROM arm_rows), (SELECT DISTINCT chromosome FROM arm_rows))
SELECT resource, arm, chromosome, count(record_key) AS n_records, count(DISTINCT pos) AS n_positions FROM d LEFT JOIN arm_rows USING (resource, arm, chromosome) GROUP BY ALL""",
    "chromosome_quotas": f"WITH {LOCI}, {ARM_ROWS}, {POINTS}, {_QUOTAS} SELECT arm, chromosome, quota FROM quotas",
    "count_matched_resample": f"""WITH {LOCI}, {ARM_ROWS}, {INTERVALS}, {POINTS}, {_QUOTAS},
picked AS (SELECT * FROM (SELECT p.*, rep, quota, row_number() OVER (PARTITION BY rep, p.resource, p.arm, p.chromosome ORDER BY sha256(concat_ws('|', 1729, concat_ws(':', p.resource, p.arm, p.chromosome), rep, pos)), pos) AS n FROM points p JOIN quotas q ON p.arm = q.arm AND p.chromosome = q.chromosome, range(3) t(rep)) WHERE n <= quota),
dims AS (SELECT DISTINCT resource, arm, rep FROM picked), q AS (SELECT * FROM intervals, dims),
lft AS (SELECT q.*, p.pos AS lp FROM q ASOF LEFT JOIN picked p ON q.resource = p.resource AND q.arm = p.arm AND q.rep = p.rep AND q.chromosome = p.chromosome AND q."start" > p.pos),
dist AS (SELECT l.* EXCLUDE (lp), least(l."start" - l.lp, CASE WHEN p.pos IS NOT NULL THEN greatest(p.pos - l."end", 0) END) AS distance FROM lft l ASOF LEFT JOIN picked p ON l.resource = p.resource AND l.arm = p.arm AND l.rep = p.rep AND l.chromosome = p.chromosome AND l."start" <= p.pos),
n AS (SELECT resource, arm, query_set, rep, CAST(w AS BIGINT) AS flank_bp, count(*) FILTER (distance <= w) AS value FROM dist, (VALUES {_F}) f(w) GROUP BY ALL)
SELECT resource, arm, query_set, flank_bp, {_SPREAD} FROM n GROUP BY ALL""",
    "gene_density_range": f"""WITH {INTERVALS}, m AS (SELECT query_id, chromosome, ("start" + "end") // 2 AS mid FROM intervals)
SELECT query_id, mid, count(*) OVER (PARTITION BY chromosome ORDER BY mid RANGE BETWEEN 250 PRECEDING AND 250 FOLLOWING) - 1 AS n_near FROM m""",
    "strata_bins": f"""WITH {INTERVALS}, l AS (SELECT *, CAST("end" - "start" + 1 AS DOUBLE) AS len FROM intervals), c AS (SELECT biotype, list_distinct(quantile_cont(len, [0.25, 0.5, 0.75])) AS cuts FROM l WHERE NOT candidate GROUP BY 1)
SELECT query_id, l.biotype, CAST(len(list_filter(cuts, lambda x: x <= len)) AS INTEGER) AS length_bin FROM l JOIN c ON l.biotype = c.biotype""",
    "background_draws": f'''WITH {INTERVALS}, {_GENES} SELECT CAST(rep AS INTEGER) AS rep, d.biotype, count(*) AS n, round(avg(i."end" - i."start" + 1), 9) AS mean_length, sha256(string_agg(CAST(d.query_id AS VARCHAR), chr(10) ORDER BY d.query_id)) AS ids_sha256 FROM draws d JOIN intervals i ON i.query_id = d.query_id GROUP BY 1, 2''',
    "background_summary": f"{COVERAGE}, {_GENES}, {_DRAWN} SELECT resource, arm, CAST(flank_bp AS BIGINT) AS flank_bp, {_SPREAD} FROM drawn GROUP BY ALL",
    "background_percentile": f"""{COVERAGE}, {_GENES}, {_DRAWN}, o AS (SELECT resource, arm, w AS flank_bp, count(*) FILTER (distance <= w) AS observed FROM dist, (VALUES {_F}) f(w) WHERE arm <> 'B' AND candidate GROUP BY ALL)
SELECT resource, arm, CAST(flank_bp AS BIGINT) AS flank_bp, observed, round(100 * count(*) FILTER (value < observed) / count(*), 9) AS strict, round(100 * (count(*) FILTER (value < observed) + 0.5 * count(*) FILTER (value = observed)) / count(*), 9) AS midrank,
 round(100 * count(*) FILTER (value <= observed) / count(*), 9) AS inclusive FROM drawn JOIN o USING (resource, arm, flank_bp) GROUP BY ALL""",
    "background_blocked_models": f"""WITH {INTERVALS}, g AS (SELECT *, CAST(floor(("end" - "start") / unit) AS INTEGER) AS length_bin FROM intervals, (VALUES (500), (100), (1)) u(unit)),
n AS (SELECT unit, chromosome, biotype, length_bin, count(*) FILTER (candidate) AS required, count(*) FILTER (NOT candidate) AS available FROM g GROUP BY ALL HAVING count(*) FILTER (candidate) > 0)
SELECT unit, count(*) AS n_strata, count(*) FILTER (required > available) AS n_deficit, CAST(sum(required) AS BIGINT) AS n_required, CASE WHEN count(*) FILTER (required > available) > 0 THEN 'BLOCKED_INSUFFICIENT_STRATA' ELSE 'COMPLETED_DESCRIPTIVE_BACKGROUND' END AS status FROM n GROUP BY 1""",
    "interval_overlap_links": f"""WITH {INTERVALS}, p AS (SELECT a.query_id, b.query_id AS other, greatest(b."start" - a."end", a."start" - b."end", 0) AS gap, b."start" <= a."start" AND b."end" >= a."end" AS inside
 FROM intervals a LEFT JOIN intervals b ON a.chromosome = b.chromosome AND NOT b.candidate AND b.biotype = 'F' WHERE a.candidate)
SELECT query_id, count(*) FILTER (gap = 0 AND other IS NOT NULL) AS n_overlap, count(*) FILTER (inside) AS n_contain, CAST(min(gap) FILTER (other IS NOT NULL) AS BIGINT) AS nearest_gap FROM p GROUP BY 1""",
    "exact_point_context": f"""WITH {LOCI}, {ARM_ROWS}, {INTERVALS}, a AS (SELECT * FROM arm_rows WHERE arm = 'A'), e AS (SELECT chromosome, pos, count(*) AS n, count(DISTINCT resource) AS r FROM a GROUP BY 1, 2)
SELECT query_id, coalesce(n, 0) AS n_exact, coalesce(r, 0) AS n_resources, CASE WHEN n > 0 THEN 'COLOCATED_REFERENCE_SNP' WHEN i.chromosome IN (SELECT chromosome FROM a) THEN 'ONLY_DIFFERENT_REFERENCE_POSITION' ELSE 'NO_SEQUENCE_BACKED_COORDINATE_CONTEXT' END AS context
FROM intervals i LEFT JOIN e ON i.chromosome = e.chromosome AND i."start" = e.pos""",
    "window_marker_counts": f"""WITH {LOCI}, {ARM_ROWS}, {INTERVALS}, a AS (SELECT DISTINCT chromosome, pos FROM arm_rows WHERE arm = 'A' AND resource = 'N')
SELECT query_id, count(pos) AS n_positions, count(pos) FILTER (pos <> "start") AS n_other FROM intervals i LEFT JOIN a ON i.chromosome = a.chromosome AND a.pos BETWEEN i."start" - 50 AND i."start" + 50 GROUP BY 1""",
}
