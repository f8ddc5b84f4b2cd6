"""A whole study: workbooks, annotation and alignments in, cohorts, coverage and backgrounds out, as Parquet with checks and a manifest of counts."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgene.functions import scalars as S
from loomgene.operators import tags as T
from loomgene.operators.checks import CheckFailed, Ledger, assert_unique, closed
from loomgene.operators.identity import classify, dedup_events, keyed
from loomgene.operators.nearest import nearest, window_counts
from loomgene.operators.sampling import draw, hash_order, replicate, requirements, spread
from loomgene.sources.genomics import read_fasta, read_gff, read_sam
from loomgene.sources.workbook import field, read_workbook


#: Letters of the reference in a chunk; alignments meet the chunk in which they begin.
REFERENCE_CHUNK = 1 << 16


@dataclass
class Config:
    windows: list
    seed: int
    replicates: int
    lengths: dict
    aliases: dict
    focal_index: int
    length_unit: int

    def __post_init__(self):
        if self.windows != sorted(set(self.windows)) or min(self.windows) < 0 or self.replicates < 1 or self.length_unit < 1:
            raise CheckFailed("windows must rise from 0, and replicates and length unit be positive")


def markers(rows: DataFrame, cfg: Config) -> DataFrame:
    """Canonical markers; those without a place on a known chromosome, or with several, are not eligible."""
    chrom = S.chromosome(field("chrom", "chromosome"), cfg.aliases)
    out = rows.select("source_row", S.text(field("marker id", "rs#")).alias("marker_id"), chrom.alias("chromosome"), S.integer(field("pos", "position")).alias("position"), S.text(field("tag key")).alias("key"))
    out = out.withColumn("canonical_id", S.canonical_marker(F.col("marker_id")))
    places = out.groupBy("marker_id").agg(F.min(F.struct("chromosome", "position")).alias("lo"), F.max(F.struct("chromosome", "position")).alias("hi")).select("marker_id", (~F.col("lo").eqNullSafe(F.col("hi"))).alias("conflict"))
    length = F.try_element_at(F.create_map(*[F.lit(x) for kv in cfg.lengths.items() for x in kv]), F.col("chromosome"))
    ok = F.coalesce(F.col("position").between(1, length), F.lit(False)) & ~F.col("conflict") & ~F.col("marker_id").startswith("#")
    return out.join(places, "marker_id").withColumn("eligible", ok)


def placements(sam: DataFrame, cfg: Config, tags: DataFrame | None = None, contigs: DataFrame | None = None) -> DataFrame:
    """Alignment lines named tag|allele to one retained place per tag.

    With the tags' sequences and the reference every line is held against both, and a contradiction fails; without them edits are
    as the lines report them, less the variant's own on the second allele.
    """
    rows = sam.filter("contiguous").withColumns({"tag_id": F.element_at(F.split("qname", "\\|"), 1), "allele": F.upper(F.substring(F.element_at(F.split("qname", "\\|"), -1), 1, 1))})
    if tags is not None and contigs is not None:
        hits = T.checked_placements(T.sam_placements(rows, tags, contigs, size=REFERENCE_CHUNK))
    else:
        rows = rows.filter("cigar <> '*'").withColumn("w", T.cigar_walk(F.col("cigar"), F.col("pos"), F.lit(cfg.focal_index)))
        at, edits = F.col("w.focal_position"), F.coalesce("nm", F.lit(0))
        reason = T.placement_reason(F.col("cigar"), at.isNotNull(), F.lit(True), F.col("w"), F.when(F.col("allele") == "A", F.greatest(edits - 1, F.lit(0))).otherwise(edits))
        strand = F.when(F.col("flag").bitwiseAND(16) > 0, "-").otherwise("+")
        hits = rows.select("tag_id", "allele", F.concat_ws(":", "rname", strand, F.coalesce(at, F.col("pos"))).alias("locus"), "score", reason.alias("reason"), "xs", F.col("pos").alias("start"), F.col("w.end").alias("end"), "cigar")
    primary = F.element_at(F.split("locus", ":"), 1).isin(*cfg.lengths)
    out = T.combine_alleles(T.allele_decisions(hits, expected=rows.select("tag_id", "allele")), F.coalesce(primary, F.lit(False)))
    parts = F.split("locus", ":")
    return out.select(F.col("tag_id").alias("key"), "status", "accepted", parts[0].alias("ref_chromosome"), F.try_element_at(parts, F.lit(3)).cast("long").alias("ref_position"))


def run(spark: SparkSession, sources: dict[str, str], values: dict, out: str) -> dict[str, DataFrame]:
    """``sources``: markers and associations (workbooks), genes (GFF3), alignments (SAM), and where given tags (workbook) and reference (FASTA). Tables that several steps read are written first."""
    cfg, ledger = closed(Config, values), Ledger()

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("errorifexists").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    tables: dict[str, DataFrame] = {}
    marked = tables["markers"] = keep("markers", markers(read_workbook(spark, sources["markers"], ["marker id", "pos"]), cfg))
    defs = contigs = None
    if "tags" in sources and "reference" in sources:
        sheet = read_workbook(spark, sources["tags"], ["tag key", "ref", "alt"])
        defs = sheet.select(S.text(field("tag key")).alias("tag_id"), S.dna(S.text(field("ref"))).alias("ref"), S.dna(S.text(field("alt"))).alias("alt"), S.integer(field("snp0")).cast("int").alias("snp0"))
        contigs = read_fasta(spark, sources["reference"], overlap=512, chunk=REFERENCE_CHUNK, tails=True)
    placed = placements(read_sam(spark, sources["alignments"]), cfg, defs, contigs).filter("accepted")
    linked = classify(marked, keyed(placed, "key", "ref_chromosome").join(placed, "key").select("key", "n", F.struct("ref_chromosome", "ref_position").alias("first")), "key", "NO_SEQUENCE_IDENTITY_BRIDGE", "MISSING_OR_AMBIGUOUS_REFERENCE_KEY", "RETAINED_PROJECTED_ALIGNMENT")
    ledger_rows = linked.select("source_row", "canonical_id", "chromosome", "position", "status", F.col("value.ref_chromosome").alias("ref_chromosome"), F.col("value.ref_position").alias("ref_position"), "eligible")
    accepted = F.col("status") == "RETAINED_PROJECTED_ALIGNMENT"
    cohort = tables["ledger"] = keep("ledger", ledger_rows.withColumns({"in_a": F.col("eligible"), "in_b": F.col("eligible") & accepted, "in_c": F.col("eligible") & accepted}))
    assert_unique(cohort, ["source_row"], "ledger")
    arms = None
    for arm, flag, c, p in (("A", "in_a", "chromosome", "position"), ("B", "in_b", "chromosome", "position"), ("C", "in_c", "ref_chromosome", "ref_position")):
        part = cohort.filter(flag).select(F.lit(arm).alias("arm"), F.col(c).alias("chromosome"), F.col(p).alias("pos"))
        arms = part if arms is None else arms.unionByName(part)
    points = tables["points"] = keep("points", arms.distinct())

    raw = read_workbook(spark, sources["associations"], ["traits", "chromosome"])
    events = raw.select(F.concat_ws("!", "sheet", F.format_string("%07d", "source_row")).alias("row"), S.chromosome(field("chromosome"), cfg.aliases).alias("chromosome"), S.integer(field("position")).alias("peak"), S.lexical_trait(field("traits")).alias("trait"), S.number(field("p value")).alias("p"))
    tables["events"] = keep("events", dedup_events(events, ["chromosome", "peak", "trait"], "p", "row"))
    lengths = spark.createDataFrame(list(cfg.lengths.items()), "seqid string, length long")
    genes, rejected = read_gff(spark, sources["genes"], lengths)
    tables["genes"], tables["rejected_genes"] = keep("genes", genes), keep("rejected_genes", rejected)

    peaks = tables["events"].filter("peak IS NOT NULL").select(F.lit("peaks").alias("query_set"), F.concat_ws(":", "chromosome", "peak").alias("query_id"), "chromosome", F.col("peak").alias("start"), F.col("peak").alias("end")).distinct()
    spans = tables["genes"].select(F.lit("genes").alias("query_set"), F.col("gene_id").alias("query_id"), F.col("seqid").alias("chromosome"), F.col("start_bp").alias("start"), F.col("end_bp").alias("end"))
    queries = peaks.unionByName(spans).crossJoin(F.broadcast(spark.createDataFrame([("A",), ("B",), ("C",)], "arm string")))
    distances = tables["distances"] = keep("distances", nearest(queries, points, ["arm", "chromosome"]))
    tables["coverage"] = keep("coverage", window_counts(distances, ["arm", "query_set"], cfg.windows))

    near = F.broadcast(peaks.select(F.col("chromosome").alias("seqid"), F.col("start").alias("peak")))
    hit = tables["genes"].join(near, "seqid").filter(F.col("peak").between(F.col("start_bp"), F.col("end_bp"))).select("gene_id").distinct().withColumn("target", F.lit(True))
    strata = ["seqid", "biotype", "bin"]
    pool = tables["genes"].join(hit, "gene_id", "left").withColumns({"target": F.coalesce("target", F.lit(False)), "bin": F.floor((F.col("end_bp") - F.col("start_bp")) / cfg.length_unit)})
    need = tables["strata"] = keep("strata", requirements(pool.filter("target"), pool.filter("NOT target"), strata))
    blocked = need.filter("required > available").limit(1).count() > 0
    if not blocked:
        chosen = draw(replicate(pool.filter("NOT target"), cfg.replicates), need.withColumnRenamed("required", "quota"), strata, "rep", hash_order(cfg.seed, "background", "rep", "gene_id"), "gene_id")
        d = distances.filter("query_set = 'genes'").select(F.col("query_id").alias("gene_id"), "arm", "distance")
        counts = window_counts(chosen.select("rep", "gene_id").join(d, "gene_id"), ["arm", "rep"], cfg.windows)
        tables["background"] = keep("background", spread(counts.withColumn("value", F.col("n_recovered").cast("double")), ["arm", "flank_bp"], "value"))

    wide = tables["coverage"].groupBy("query_set", "flank_bp").pivot("arm", ["A", "B", "C"]).agg(F.first("n_recovered"))
    ledger.add("B within A", wide.filter("B > A").count(), 0)
    ledger.add("one row per marker", cohort.count(), marked.count())
    ledger.add("flanks nest", tables["coverage"].filter("n_recovered > n_queries").count(), 0)
    tables["checks"] = keep("checks", ledger.table(spark))
    summary = {"status": ledger.status, "background": "BLOCKED_INSUFFICIENT_STRATA" if blocked else "COMPLETED_DESCRIPTIVE_BACKGROUND", "rows": {n: t.count() for n, t in tables.items()}}
    spark.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.text(f"{out}/summary")
    if ledger.status != "COMPLETED":
        raise CheckFailed(json.dumps(summary))
    return tables
