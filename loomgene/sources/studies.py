"""Scans of study workbooks, as DataFrames over ``read_workbook``'s rows: marker evidence, candidates, raw associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgene.functions import scalars as S
from loomgene.sources.workbook import field

# Spellings of a positive and of a negative flag.
POSITIVE = ["x", "1", "1.0", "yes", "true"]
NEGATIVE = ["", "0", "no", "false"]


def _text(*names: str) -> Column:
    return S.text(field(*names))


def diversity_markers(rows: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Marker rows with canonical keys, position, flanks and variant, as reported and as read; rows without a name are left out."""
    out = rows.select(
        "path", "sheet", "source_row", _text("SNP marker name").alias("marker_id"), _text("reference sequence name").alias("reference_sequence_name"), S.chromosome(field("chromosome"), aliases).alias("chromosome"),
        S.integer(field("snp position")).alias("position_bp"), _text("chromosome").alias("chromosome_raw"), _text("snp position").alias("position_raw"), _text("version").alias("assembly_reported"),
        _text("5flank_sequence").alias("five_flank"), _text("3flank_sequence").alias("three_flank"), _text("variation").alias("variation"), _text("strand").alias("strand_reported"), _text("remark marker").alias("remark"),
    ).filter("marker_id <> ''")
    return out.withColumns({"marker_key": S.canonical_marker(F.col("marker_id")), "reference_key": S.canonical_marker(F.col("reference_sequence_name"))})


def reference_sequences(rows: DataFrame) -> DataFrame:
    """(reference_key, copies, first): named reference sequences by canonical key; a key with several keeps its count and the first row."""
    named = rows.select("source_row", _text("reference sequence name").alias("reference_name"), _text("Sequence").alias("sequence"), _text("accession number").alias("accession"), _text("sequence database name").alias("database"))
    keyed = named.filter("reference_name <> ''").withColumn("reference_key", S.canonical_marker(F.col("reference_name")))
    return keyed.groupBy("reference_key").agg(F.count("*").alias("copies"), F.min(F.struct("source_row", "reference_name", "sequence", "accession", "database")).alias("first"))


def marker_evidence(markers: DataFrame, references: DataFrame) -> DataFrame:
    """Markers with how their reference tag compares to the tags built from their flanks."""
    change = F.upper(F.regexp_replace("variation", r"\s", ""))
    five, three = (F.upper(F.regexp_replace(c, r"\s", "")) for c in ("five_flank", "three_flank"))
    ref, alt = S.reconstruct(F.when(five.rlike("^[ACGT]*$"), five), change, F.when(three.rlike("^[ACGT]*$"), three))
    joined = markers.join(references, "reference_key", "left").withColumn("reference_sequence", F.col("first.sequence"))
    status = S.compare_tag(F.when(F.col("copies").isNotNull(), F.col("reference_sequence_name")), F.col("copies"), ref, alt, S.dna(F.col("reference_sequence")))
    return joined.withColumn("ref_lookup_status", status).drop("first")


def candidate_genes(rows: DataFrame, lengths: list[str], pathways: dict[str, str], aliases: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Candidate genes: raw rows, consolidated genes, their pathways, conflicting rows, and qualifiers that are no plain flag.

    ``pathways``: label to header. A gene is unique if all its rows are valid and have one place; flags are true if any row has one.
    """
    flags = {label: F.lower(_text(column)) for label, column in pathways.items()}
    start, end, c = S.integer(field("start")), S.integer(field("end")), S.chromosome(field("Chromosome"), aliases)
    raw = rows.select("path", "sheet", "source_row", _text("gene_id").alias("gene_id"), c.alias("chromosome"), start.alias("start_bp"), end.alias("end_bp"), _text("gene_function").alias("gene_function"), *[f.alias(f"{k}_source_flag") for k, f in flags.items()])
    raw = raw.filter("gene_id <> ''").withColumns({k: F.col(f"{k}_source_flag").isin(POSITIVE) for k in flags})
    raw = raw.withColumn("valid_interval", F.coalesce(F.col("chromosome").isin(lengths) & (F.col("start_bp") > 0) & (F.col("start_bp") <= F.col("end_bp")), F.lit(False)))
    place = F.struct("chromosome", "start_bp", "end_bp")
    genes = raw.groupBy("gene_id").agg(
        F.count("*").alias("record_count"), F.min(place).alias("lo"), F.max(place).alias("hi"), F.bool_and("valid_interval").alias("valid"), F.array_join(F.array_sort(F.collect_list("source_row")), ";").alias("original_rows"),
        F.array_join(F.array_sort(F.array_remove(F.collect_set("gene_function"), "")), "; ").alias("gene_function"), *[F.bool_or(k).alias(k) for k in flags],
    )
    fine = genes.withColumn("unique", F.col("valid") & F.col("lo").eqNullSafe(F.col("hi")))
    held = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in flags]))
    unique = fine.filter("unique").select("gene_id", "lo.*", "record_count", "original_rows", "gene_function", *flags, F.array_join(held, "; ").alias("pathways"), (F.size(held) > 0).alias("has_pathway_annotation"))
    members = unique.select("gene_id", F.explode(F.split(F.col("pathways"), "; ")).alias("pathway")).filter("pathway <> ''")
    notes = F.array(*[F.struct(F.lit(k).alias("pathway"), F.col(f"{k}_source_flag").alias("source_flag")) for k in flags])
    qualifiers = raw.select("gene_id", "source_row", F.inline(notes)).filter(~F.col("source_flag").isin(POSITIVE + NEGATIVE))
    return {"raw_records": raw, "unique_genes": unique, "memberships": members, "coordinate_conflicts": raw.join(fine.filter("NOT unique").select("gene_id"), "gene_id", "left_semi"), "qualifier_annotations": qualifiers}


def raw_associations(rows: DataFrame, chromosomes: list[str], filters: list[str], aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected) association rows, each with its cells as they stand, 'NA' included.

    A filter's name in the method column, where the filter column has none, is a provisional label only.
    """
    c, peak, trait = S.chromosome(field("Chromosome"), aliases), S.integer(field("Position of the association peak (bp)")), _text("Traits")
    judged = rows.select("sheet", "source_row", c.alias("chromosome"), peak.alias("peak_bp"), trait.alias("trait"), _text("GWAS method").alias("method_reported"), _text("Sorting of marker").alias("marker_filter_reported"), F.to_json("cells").alias("raw_record_json"))
    ok = F.coalesce(F.col("chromosome").isin(chromosomes) & (F.col("peak_bp") > 0) & (F.col("trait") != ""), F.lit(False))
    provisional = ~F.col("marker_filter_reported").isin(filters) & F.col("method_reported").isin(filters)
    parsed = judged.filter(ok).withColumns({
        "provisional_filter_candidate": F.when(provisional, F.col("method_reported")).otherwise(""),
        "provisional_basis": F.when(provisional, "FILTER_LIKE_LABEL_IN_METHOD_FIELD_UNRESOLVED").otherwise(""),
    })
    return parsed, judged.filter(~ok).select("sheet", "source_row", F.lit("INVALID_PRIMARY_CHROMOSOME_PEAK_OR_TRAIT").alias("reason"), "raw_record_json")


def point_order(chromosome: str = "chromosome", position: str = "position") -> list[Column]:
    """Sort columns: chromosomes by their number, then positions."""
    return [F.col(chromosome).try_cast("int").asc_nulls_last(), F.col(chromosome), F.col(position)]
