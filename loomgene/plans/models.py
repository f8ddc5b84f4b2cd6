"""The grid of background models: target sets by length bins, alone and with bins of gene density within a radius."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgene.operators.nearest import nearest_each, range_neighbours_each
from loomgene.operators.sampling import bin_of, hash_below, hash_order, percentiles
from loomgene.plans.views import ARM_ROWS, INTERVALS, LOCI, POINTS, SEED, intervals, loci

LENGTH_BINS = (2, 3, 5)
DENSITY_BINS = (2, 3, 5)
RADII = (100, 500, 2000)
TARGETS = {"all_candidates": "candidate", "every_second_candidate": "candidate AND query_id % 2 = 0"}
REPS = 3
FLANK = 100
#: Standard deviations that a stratum's hash limit lies beyond its quota; a draw that falls short is made again from the whole pool.
SPARE = 6
SPECS = [(f"L{n}", "length", n, None, None) for n in LENGTH_BINS] + [(f"L{n}_D{d}_R{r}", "length_and_density", n, d, r) for n in LENGTH_BINS for d in DENSITY_BINS for r in RADII]
MODEL = ["target_set", "model_id", "model"]
STRATUM = [*MODEL, "chromosome", "biotype", "length_bin", "density_bin"]


def _cuts(n):
    return F.array(*[F.lit(j / n) for j in range(1, n)])


def _features(spark, sf):
    """Genes with length, number of other midpoints within each radius, and the bin of each under every cut of their biotype's non-candidates."""
    rows = intervals(spark, sf).withColumns({"length": (F.col("end") - F.col("start") + 1).cast("double"), "mid": F.floor((F.col("start") + F.col("end")) / 2).cast("long")})
    rows = range_neighbours_each(rows.select("query_id", "chromosome", "biotype", "candidate", "length", "mid"), "chromosome", "mid", {f"near{r}": r for r in RADII})
    wanted = {f"l{n}": ("length", n) for n in LENGTH_BINS} | {f"d{d}_{r}": (f"near{r}", d) for d in DENSITY_BINS for r in RADII}
    # One row per biotype; a quantile that repeats is one cut.
    cuts = rows.filter("NOT candidate").groupBy("biotype").agg(*[F.array_distinct(F.percentile(F.col(c).cast("double"), _cuts(n))).alias(f"c_{k}") for k, (c, n) in wanted.items()])
    bins = F.array(*[bin_of(F.col(c).cast("double"), F.col(f"c_{k}")) for k, (c, _) in wanted.items()])
    return rows.join(F.broadcast(cuts), "biotype").select("query_id", "chromosome", "biotype", "candidate", bins.alias("bins")), list(wanted)


def _assigned(rows, names, *columns):
    """``rows`` under each target set and model, 60 at most whatever the data's size: ``columns``, the number of target set and model, their names and the bins."""
    grid = [(s, t, i, m, names.index(f"l{n}"), names.index(f"d{d}_{r}") if d else None) for s, (t, (i, m, n, d, r)) in enumerate((t, spec) for t in TARGETS for spec in SPECS)]
    specs = rows.sparkSession.createDataFrame(grid, "spec int, target_set string, model_id string, model string, l int, d int")
    return rows.crossJoin(F.broadcast(specs)).select(*columns, "spec", *MODEL, F.col("bins")[F.col("l")].alias("length_bin"), F.col("bins")[F.col("d")].alias("density_bin"))


def strata(rows, names):
    """Required and available members; genes alike in chromosome, biotype and all bins are counted before they meet the models."""
    counts = [F.count_if(F.expr(where)).alias(t) for t, where in TARGETS.items()]
    alike = rows.groupBy("chromosome", "biotype", "bins").agg(F.count_if(~F.col("candidate")).alias("n_pool"), *counts)
    required = F.coalesce(*[F.when(F.col("target_set") == t, F.col(t)) for t in TARGETS])
    each = _assigned(alike, names, "chromosome", "biotype", "n_pool", *TARGETS)
    return each.groupBy("spec", *STRATUM).agg(F.sum(required).alias("required"), F.sum("n_pool").alias("available")).filter("required > 0")


def _status(need):
    short = F.count_if(F.col("required") > F.col("available"))
    state = F.when(short > 0, "BLOCKED_INSUFFICIENT_STRATA").otherwise("COMPLETED_DESCRIPTIVE_BACKGROUND")
    return need.groupBy("target_set", "model_id", "model").agg(F.count("*").alias("n_strata"), short.alias("n_deficit"), F.sum("required").alias("n_required"), state.alias("status"))


def model_grid_status(spark, sf):
    """Both target sets under all 30 models: a model with one stratum too small is blocked as a whole."""
    return _status(strata(*_features(spark, sf)))


def _hits(spark, sf, resources):
    """Per gene id, the number of its rows with a point of each resource within the flank at the corrected arm: h0, h1 and so on."""
    label = F.coalesce(*[F.when(F.col("resource") == r, i) for i, r in enumerate(resources)])
    # Arm C of ``arms``, without a row for each of the others.
    points = loci(spark, sf).filter("accepted").select("resource", "chromosome", F.col("ref").alias("pos"))
    genes = intervals(spark, sf).filter("query_id IS NOT NULL").select("query_id", "candidate", "chromosome", "start", "end")
    wide = nearest_each(genes, points, ["chromosome"], label, len(resources))
    return wide.groupBy("query_id", "candidate").agg(*[F.count_if(F.col("distances")[i] <= FLANK).alias(f"h{i}") for i in range(len(resources))])


def _tallies(spark, sf, resources, spare, only=None):
    """A row per target set, model that isn't blocked and replicate: genes required and drawn, hits of the drawn (h0 ...) and of the targets (o0 ...).

    A gene goes on to a draw only if its hash lies below the stratum's limit, so that about the quota is sorted, not the pool. The limit is
    where ``spare`` standard deviations more than the quota are expected, or none for a null ``spare``. A draw from too few has ``drawn`` below ``required``.
    """
    rows, names = _features(spark, sf)
    need = strata(rows, names)
    need = need.filter(F.col("spec").isin(only)) if only is not None else need
    done = _status(need).filter("n_deficit = 0").select(*MODEL, "n_required")
    share = (F.col("required") + spare * F.sqrt("required") + spare * abs(spare) / 2) / F.col("available") if spare is not None else F.lit(1.0)
    # As many strata as chromosomes, biotypes and bins make, however many genes there are.
    number = F.row_number().over(W.orderBy(*STRATUM))
    quotas = need.filter("required <= available").join(F.broadcast(done.select(*MODEL)), MODEL).select("spec", *STRATUM, F.col("required").alias("quota"), hash_below(share).alias("limit"), F.concat_ws(":", "target_set", "model_id").alias("label"), number.alias("stratum"))
    hits, n = _hits(spark, sf, resources), range(len(resources))
    # A gene without a place has no row in ``hits``.
    found = [F.coalesce(f"h{i}", F.lit(0)).alias(f"h{i}") for i in n]
    pool = rows.filter("NOT candidate").join(hits.drop("candidate"), "query_id", "left").select(*rows.columns, F.col("query_id").cast("string").alias("id"), *found)
    keys = ["spec", "chromosome", "biotype", "length_bin", "density_bin"]
    each = _assigned(pool, names, "query_id", "id", "chromosome", "biotype", *[f"h{i}" for i in n]).alias("p")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) if c in ("chromosome", "density_bin") else F.col(f"p.{c}") == F.col(f"q.{c}") for c in keys]
    each = each.join(F.broadcast(quotas.select(*keys, "label", "limit", "stratum").alias("q")), same).select("query_id", "id", *[f"h{i}" for i in n], "label", "limit", "stratum")
    each = each.withColumn("rep", F.explode(F.array(*[F.lit(str(r)) for r in range(REPS)])))
    near = each.filter(hash_order(SEED, F.col("label"), "rep", "id") < F.col("limit")).select("stratum", "rep", "query_id", *[f"h{i}" for i in n])
    # The hash is cheaper to compute again than to send.
    near = near.repartition("stratum", "rep").join(F.broadcast(quotas.select("stratum", "label", "quota", *MODEL)), "stratum")
    order = W.partitionBy("stratum", "rep").orderBy(hash_order(SEED, F.col("label"), "rep", "query_id"), "query_id")
    drawn = near.withColumn("n", F.row_number().over(order)).filter("n <= quota").groupBy(*MODEL, "rep").agg(F.count("*").alias("drawn"), *[F.sum(f"h{i}").alias(f"h{i}") for i in n])
    sums = [F.sum(F.when(F.expr(where), F.col(f"h{i}"))).alias(f"{t}{i}") for t, where in TARGETS.items() for i in n]
    seen = hits.agg(*sums).select(F.inline(F.array(*[F.struct(F.lit(t).alias("target_set"), *[F.col(f"{t}{i}").alias(f"o{i}") for i in n]) for t in TARGETS])))
    reps = F.explode(F.array(*[F.lit(str(r)) for r in range(REPS)])).alias("rep")
    return done.select("*", reps).join(drawn, [*MODEL, "rep"], "left").join(F.broadcast(seen), "target_set")


def model_grid_range(spark, sf):
    """Over the models that aren't blocked: range of the midrank percentile, and of observed less drawn, at the corrected arm and one flank.

    The draws are made when this is called, and collected as sums: a row for each target set, model and replicate, 180 at most.
    """
    resources = sorted(r[0] for r in loci(spark, sf).select("resource").distinct().filter("resource IS NOT NULL").collect())
    number = {(t, i): s for s, (t, i) in enumerate((t, spec[0]) for t in TARGETS for spec in SPECS)}
    found = _tallies(spark, sf, resources, SPARE).collect()
    few = sorted({number[r["target_set"], r["model_id"]] for r in found if (r["drawn"] or 0) < r["n_required"]})
    if few:
        found = [r for r in found if number[r["target_set"], r["model_id"]] not in few] + _tallies(spark, sf, resources, None, few).collect()
    by = ["target_set", "model_id", "model", "resource"]
    each = [(r["target_set"], r["model_id"], r["model"], name, r["rep"], r[f"h{i}"], r[f"o{i}"]) for r in found if r["drawn"] for i, name in enumerate(resources)]
    rows = spark.createDataFrame(each, "target_set string, model_id string, model string, resource string, rep string, value long, observed long")
    draws, seen = rows.drop("observed"), rows.select(*by, "observed").distinct()
    rows = percentiles(draws, seen, by).join(draws.groupBy(*by).agg(F.avg("value").alias("mean")), by)
    gap = F.round(F.col("observed") - F.col("mean"), 9)
    return rows.groupBy("target_set", "resource", "model").agg(F.count("*").alias("n_models"), F.round(F.min("midrank"), 9).alias("least_midrank"), F.round(F.max("midrank"), 9).alias("most_midrank"), F.min(gap).alias("least_excess"), F.max(gap).alias("most_excess"))


QUERIES = {f.__name__: f for f in (model_grid_status, model_grid_range)}


def _list(n):
    return "[" + ", ".join(repr(j / n) for j in range(1, n)) + "]"


_NEAR = ", ".join(f"count(*) OVER (PARTITION BY chromosome ORDER BY mid RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) - 1 AS near{r}" for r in RADII)
_CUTS = ", ".join([f"list_distinct(quantile_cont(length, {_list(n)})) AS c_l{n}" for n in LENGTH_BINS] + [f"list_distinct(quantile_cont(CAST(near{r} AS DOUBLE), {_list(d)})) AS c_d{d}_{r}" for d in DENSITY_BINS for r in RADII])
_ROWS = ", ".join(f"('{i}', '{m}')" for i, m, *_ in SPECS)
_BIN = lambda value, cuts: f"len(list_filter({cuts}, lambda c: c <= {value}))"
_LENGTH = "CASE " + " ".join(f"WHEN model_id = '{i}' THEN {_BIN('length', f'c_l{n}')}" for i, _, n, *_ in SPECS) + " END"
_DENSITY = "CASE " + " ".join(f"WHEN model_id = '{i}' THEN {_BIN(f'near{r}', f'c_d{d}_{r}')}" for i, _, _, d, r in SPECS if d) + " END"
_TARGETS = ", ".join(f"('{t}')" for t in TARGETS)
_TARGET = "CASE target_set " + " ".join(f"WHEN '{t}' THEN {where}" for t, where in TARGETS.items()) + " END"
_GRID = f"""{INTERVALS}, m AS (SELECT *, CAST("end" - "start" + 1 AS DOUBLE) AS length, ("start" + "end") // 2 AS mid FROM intervals), f AS (SELECT *, {_NEAR} FROM m),
cuts AS (SELECT biotype, {_CUTS} FROM f WHERE NOT candidate GROUP BY 1),
a AS (SELECT query_id, chromosome, biotype, candidate, target_set, {_TARGET} AS target, model_id, model, {_LENGTH} AS length_bin, {_DENSITY} AS density_bin FROM f JOIN cuts USING (biotype), (VALUES {_ROWS}) s(model_id, model), (VALUES {_TARGETS}) t(target_set)),
need AS (SELECT {', '.join(STRATUM)}, count(*) FILTER (target) AS required, count(*) FILTER (NOT candidate) AS available FROM a GROUP BY ALL HAVING count(*) FILTER (target) > 0),
st AS (SELECT target_set, model_id, model, count(*) AS n_strata, count(*) FILTER (required > available) AS n_deficit, CAST(sum(required) AS BIGINT) AS n_required, CASE WHEN count(*) FILTER (required > available) > 0 THEN 'BLOCKED_INSUFFICIENT_STRATA' ELSE 'COMPLETED_DESCRIPTIVE_BACKGROUND' END AS status FROM need GROUP BY 1, 2, 3)"""
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM n.{c}" for c in STRATUM)

ORACLE_SQL = {
    "model_grid_status": f"WITH {_GRID} SELECT * FROM st",
    "model_grid_range": f"""WITH {_GRID}, {LOCI}, {ARM_ROWS}, {POINTS}, pc AS (SELECT * FROM points WHERE arm = 'C'), dims AS (SELECT DISTINCT resource FROM points), q AS (SELECT intervals.*, dims.resource FROM intervals, dims),
lft AS (SELECT q.*, p.pos AS lp FROM q ASOF LEFT JOIN pc p ON q.resource = p.resource AND q.chromosome = p.chromosome AND q."start" > p.pos),
dist AS (SELECT l.query_id, l.candidate, l.resource, least(l."start" - l.lp, CASE WHEN p.pos IS NOT NULL THEN greatest(p.pos - l."end", 0) END) AS distance FROM lft l ASOF LEFT JOIN pc p ON l.resource = p.resource AND l.chromosome = p.chromosome AND l."start" <= p.pos),
h AS (SELECT query_id, candidate, resource, CASE WHEN distance <= {FLANK} THEN 1 ELSE 0 END AS hit FROM dist),
pool AS (SELECT a.*, n.required, rep, row_number() OVER (PARTITION BY rep, {', '.join(f'a.{c}' for c in STRATUM)} ORDER BY sha256(concat_ws('|', {SEED}, a.target_set || ':' || a.model_id, rep, a.query_id)), a.query_id) AS rn FROM a JOIN need n ON {_SAME} JOIN st ON st.target_set = a.target_set AND st.model_id = a.model_id, range({REPS}) r(rep) WHERE NOT a.candidate AND n_deficit = 0),
draws AS (SELECT target_set, model_id, model, resource, rep, sum(hit) AS value FROM pool JOIN h USING (query_id) WHERE rn <= required GROUP BY ALL),
seen AS (SELECT target_set, resource, sum(hit) AS observed FROM (SELECT *, {_TARGET} AS target FROM h, (VALUES {_TARGETS}) t(target_set)) WHERE target GROUP BY ALL),
p AS (SELECT target_set, model_id, model, resource, observed, 100 * (count(*) FILTER (value < observed) + 0.5 * count(*) FILTER (value = observed)) / count(*) AS midrank, round(observed - avg(value), 9) AS gap FROM draws JOIN seen USING (target_set, resource) GROUP BY 1, 2, 3, 4, 5)
SELECT target_set, resource, model, count(*) AS n_models, round(min(midrank), 9) AS least_midrank, round(max(midrank), 9) AS most_midrank, min(gap) AS least_excess, max(gap) AS most_excess FROM p GROUP BY 1, 2, 3""",
}
