"""Identity, events, tags, placement and comparison on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgene.functions import scalars as S
from loomgene.operators import identity as I
from loomgene.operators import tags as T
from loomgene.plans.views import ASSOC, INTERVALS, LOCI, assoc, intervals, loci, table


def event_dedup_conflicts(spark, sf):
    out = I.dedup_events(assoc(spark, sf).filter("sheet = 'master'"), ["chromosome", "peak", "trait"], "payload", "source_row")
    return out.withColumn("conflict", F.col("n_payloads") > 1)


def unique_peaks(spark, sf):
    return assoc(spark, sf).groupBy("chromosome", "peak").agg(F.count("*").alias("n_events"), F.count_distinct("trait").alias("n_traits"), F.array_join(F.array_sort(F.collect_set("trait")), "; ").alias("traits"))


def event_crosswalk(spark, sf):
    """Rows of other sheets against the master: exact key, then trait without its ending, then chromosome and hour's day."""
    rows = assoc(spark, sf)
    cut = F.regexp_replace("trait", "_[a-z]+$", "")
    master = rows.filter("sheet = 'master'").withColumns({"stem": cut, "day": F.floor(F.col("peak") / 24)})
    others = rows.filter("sheet <> 'master'")
    levels = [
        ("exact_event_key", [(F.col("chromosome"), "chromosome"), (F.col("peak"), "peak"), (F.col("trait"), "trait")]),
        ("terminal_suffix_whitespace_candidate", [(F.col("chromosome"), "chromosome"), (F.col("peak"), "peak"), (cut, "stem")]),
        ("configured_trait_alias_candidate", [(F.col("chromosome"), "chromosome"), (F.floor(F.col("peak") / 24), "day"), (F.col("trait"), "trait")]),
    ]
    out = I.cascade(others, master, "source_row", levels)
    return out.select("source_row", "sheet", "match_status", "match_basis", F.col("master_value").cast("long").alias("master_row"))


def extra_events_anti(spark, sf):
    rows, key = assoc(spark, sf), ["chromosome", "peak", "trait"]
    extra = rows.filter("sheet <> 'master'").join(rows.filter("sheet = 'master'").select(*key).distinct(), key, "left_anti")
    first = extra.groupBy(*key).agg(F.min("source_row").alias("source_row"), F.count("*").alias("occurrences"))
    return first


def interval_states(spark, sf):
    rows = intervals(spark, sf)
    k = F.col("query_id")
    start = F.when(k % 7 == 0, None).when(k % 11 == 0, -F.col("start")).otherwise(F.col("start"))
    end = F.when(k % 5 == 0, None).when(k % 13 == 0, F.col("start") - 1).otherwise(F.col("end"))
    peak = F.when(k % 17 == 0, 0).otherwise(F.col("start") + k % 300)
    return rows.select("query_id", S.interval_state(peak, start, end).alias("state"))


def gene_consolidation(spark, sf):
    """Suppliers of a part as its conflicting records: one place and all valid, or quarantined."""
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene_id"), (F.col("l_suppkey") % 3).alias("chromosome"), (F.col("l_linenumber") % 2).cast("long").alias("start"), (F.col("l_returnflag") == "R").alias("flag"), (F.col("l_quantity") > 1).alias("ok"))
    return I.consolidate(rows, "gene_id", ["chromosome", "start"], F.col("ok"), ["flag"])


def identity_unique_join(spark, sf):
    """Part names once on either of two resources (odd and even keys), and their coordinate relation."""
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", F.element_at(F.split("p_name", " "), 1), "p_brand", "p_size").alias("key"), (F.col("p_size") % 3).alias("chromosome"), F.floor("p_retailprice").alias("position"))
    side = lambda k, s: parts.filter(F.col("p_partkey") % 2 == k).select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("p_partkey", "chromosome", "position")])
    out = I.unique_join(side(0, "a"), side(1, "b"), "key")
    return out.select("key", "p_partkey_a", "p_partkey_b", S.coordinate_relation(F.col("chromosome_a"), F.col("position_a"), F.col("chromosome_b"), F.col("position_b")).alias("relation"))


def key_collisions(spark, sf):
    parts = table(spark, sf, "part")
    return parts.groupBy("p_brand", "p_size").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("p_partkey")), ";").alias("members")).filter("n > 1")


def set_overlap(spark, sf):
    """Parts ordered under each pair of return flags: sizes, intersection, Jaccard, subset."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("r"), F.col("l_partkey").alias("k")).distinct()
    size = rows.groupBy("r").agg(F.count("*").alias("n"))
    both = rows.alias("x").join(rows.alias("y"), "k").filter("x.r < y.r").groupBy(F.col("x.r").alias("a"), F.col("y.r").alias("b")).agg(F.count("*").alias("n_both"))
    out = both.join(F.broadcast(size.select(F.col("r").alias("a"), F.col("n").alias("n_a"))), "a").join(F.broadcast(size.select(F.col("r").alias("b"), F.col("n").alias("n_b"))), "b")
    return out.select("a", "b", "n_a", "n_b", "n_both", F.round(F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")), 9).alias("jaccard"), ((F.col("n_both") == F.col("n_a")) | (F.col("n_both") == F.col("n_b"))).alias("subset"))


def key_link_classification(spark, sf):
    """Orders to line items of quantity 50 as identity bridge: none, one, many."""
    links = table(spark, sf, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").cast("string").alias("key"), "l_partkey")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"))
    return I.classify(rows, I.keyed(links, "key", "l_partkey"), "key", "NO_SEQUENCE_IDENTITY_BRIDGE", "AMBIGUOUS_REFERENCE_TAG_KEY", "DIRECT_UNIQUE_EXACT_TAG")


def fallback_match(spark, sf):
    """Line items' parts by exact id among small parts, else by name among all, labelled by what matched."""
    parts = table(spark, sf, "part")
    by_id = parts.filter("p_size <= 10").select("p_partkey", F.lit(1).alias("hit"))
    by_name = parts.groupBy("p_type").agg(F.count("*").alias("n_name"), F.min("p_partkey").alias("first"))
    rows = parts.select("p_partkey", "p_type").join(by_id, "p_partkey", "left").join(by_name.filter("n_name <= 20"), "p_type", "left")
    basis = F.when(F.col("hit").isNotNull(), "EXACT_ID").when(F.col("n_name") == 1, "EXACT_NAME").when(F.col("n_name") > 1, "AMBIGUOUS_ANNOTATION_ID").otherwise("SOURCE_GENE_ID_NOT_FOUND_IN_THIS_ANNOTATION")
    return rows.select("p_partkey", basis.alias("basis"), F.coalesce(F.when(F.col("hit").isNotNull(), F.col("p_partkey")), F.when(F.col("n_name") == 1, F.col("first"))).alias("target"))


def canonical_ids(spark, sf):
    """Part numbers in the spellings that markers, chromosomes and whole numbers come in."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    dotted = lambda letter: F.concat_ws(".", k, F.lit(letter), F.lit("0"), n)
    raw = F.when(k % 4 == 0, dotted("F")).when(k % 4 == 1, dotted("r")).when(k % 4 == 2, F.concat(k, F.lit("|f|0--"), n)).otherwise(dotted("Z"))
    chrom = F.when(k % 5 == 0, F.concat(F.lit("chr0"), n)).when(k % 5 == 1, F.concat(n, F.lit(".0"))).when(k % 5 == 2, F.concat(F.lit("chr-"), n)).when(k % 5 == 3, F.concat(F.lit("Tc_chr"), n, F.lit("_v2"))).otherwise(F.concat(F.lit("chr"), n, F.lit("x")))
    whole = F.when(k % 3 == 0, F.concat(n, F.lit(".0"))).when(k % 3 == 1, F.concat(n, F.lit(",000"))).otherwise(F.concat(n, F.lit(".0000001")))
    rows = table(spark, sf, "part").select("p_partkey", S.canonical_marker(raw).alias("canonical_id"), S.chromosome(chrom).alias("chromosome"), S.integer(whole).alias("whole"))
    return rows.select("p_partkey", "canonical_id", S.dart_suffix(F.col("canonical_id")).alias("suffix"), S.tag_family(F.col("canonical_id")).alias("family"), "chromosome", "whole")


def stable_ids(spark, sf):
    d = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return table(spark, sf, "pages").select("page_id", S.stable_id(F.col("page_id"), F.lit(None).cast("string"), F.col("url")).alias("stable_id"), S.stable_id(F.col("url"), width=20).alias("long_id"), d.alias("host"))


def _tags(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("tag_id"), F.col("text").alias("tag"))


def _contigs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("contig_id"), F.col("text").alias("bases"))


def _bases(spark, sf):
    """Part names as sequences of 40 to 90 bases."""
    base = F.translate(F.regexp_replace(F.upper(F.concat("p_name", "p_type", "p_name", "p_type", "p_brand", "p_name")), "[^A-Z]", ""), "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")
    return table(spark, sf, "part").select("p_partkey", "p_size", base.alias("s"))


def seed_choice(spark, sf):
    rows = _bases(spark, sf).select("p_partkey", T.select_seed(F.col("s"), F.col("p_size") % 30).alias("x"))
    return rows.select("p_partkey", "x.seed", F.col("x.offset").cast("long").alias("seed_offset"))


def tag_eligibility(spark, sf):
    """Flanks and variants of part sequences, each ninth of them wrong in another way."""
    k, s = F.col("p_partkey") % 9, F.col("s")
    rows = _bases(spark, sf).filter("length(s) >= 41").select(
        "p_partkey", F.when(k == 0, "ACGN").otherwise(F.lower(F.substring(s, 1, 20))).alias("five_flank"), F.when(k == 5, "AC").when(k == 6, F.expr("substring(s, 22, 19)")).otherwise(F.expr("substring(s, 22)")).alias("three_flank"),
        F.when(k == 7, "A>A").otherwise(F.concat(F.substring(s, 21, 1), F.lit(" > "), F.translate(F.substring(s, 21, 1), "ACGT", "CGTA"))).alias("variation"),
        F.when(k == 1, "").when(k == 2, F.concat(s, F.lit("A"))).when(k == 5, F.concat(F.substring(s, 1, 21), F.lit("AC"))).when(k == 6, F.substring(s, 1, 40)).otherwise(s).alias("reference_sequence"),
        F.when(k == 3, "sequence_mismatch").otherwise("exact_ref_tag").alias("ref_lookup_status"), F.when(k == 4, " ").otherwise("key").alias("reference_key"),
    )
    out = T.eligible_tags(rows, 30)
    return out.select("p_partkey", "eligibility", F.when(F.col("eligibility") == "ELIGIBLE", F.length("ref_tag")).cast("long").alias("tag_length"), F.when(F.col("eligibility") == "ELIGIBLE", F.sha2("alt_tag", 256)).alias("alt_sha256"))


def tag_exact_hits(spark, sf):
    """Benchmark items as tags, documents as contigs; forward strand."""
    return T.exact_hits(_tags(spark, sf), _contigs(spark, sf)).filter("strand = '+'").select("tag_id", "contig_id", "start")


def mapping_summary(spark, sf):
    tags = _tags(spark, sf)
    return T.mapping_summary(tags, T.exact_hits(tags, _contigs(spark, sf)).filter("strand = '+'"), F.length("tag") >= T.SEED)


def reverse_complement(spark, sf):
    """Letters of part names as bases: complement, both allele tags, and how a third sequence compares."""
    base = F.translate(F.regexp_replace(F.upper("p_name"), "[^A-Z]", ""), "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")
    rows = table(spark, sf, "part").select("p_partkey", S.dna(base).alias("seq"))
    ref, alt = S.reconstruct(F.col("seq"), F.lit("A>G"), F.lit("ACC"))
    given = F.when(F.col("p_partkey") % 4 == 0, ref).when(F.col("p_partkey") % 4 == 1, alt).when(F.col("p_partkey") % 4 == 2, S.reverse_complement(ref)).otherwise(F.col("seq"))
    return rows.select("p_partkey", "seq", S.reverse_complement(F.col("seq")).alias("flipped"), S.compare_tag(F.lit("x"), F.lit(1), ref, alt, given).alias("comparison"))


def _hits(spark, sf):
    """Events as alignments of users' tags: reasons, places and cigars that differ within a locus, competitors reported or not."""
    e = F.col("event_id")
    score = (-e % 31).cast("long")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("tag_id"), (e % 2).alias("allele"), F.concat_ws(":", e % 3, "event_type").alias("locus"), score.alias("score"),
        F.when(e % 5 == 0, "TOO_MANY_NONFOCAL_EDITS").otherwise("ELIGIBLE_PLACEMENT").alias("reason"), F.when(e % 11 == 0, score - 2).alias("xs"), (e % 50).cast("long").alias("start"), (e % 50 + 20).cast("long").alias("end"),
        F.when(e % 2 == 0, "20M").otherwise("19M1D1M").alias("cigar"), F.when(e % 7 == 0, "C").otherwise("A").alias("base"), F.lit("G").alias("other_base"), F.lit(5).cast("long").alias("snp"),
    )


def sam_validation(spark, sf):
    """Part names as contigs, and tags cut from them with known edits: what each alignment rests on, and what contradicts it."""
    base = F.translate(F.regexp_replace(F.upper(F.concat("p_name", "p_type", "p_name")), "[^A-Z]", ""), "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC")
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("tag_id"), base.alias("s"), (F.col("p_partkey") % 6).alias("kind")).filter("length(s) >= 20")
    n, kind = F.length("s"), F.col("kind")
    flip, third = (lambda c, to=to: F.translate(c, "ACGT", to) for to in ("TGCA", "CAAC"))
    put = lambda c, at, x: F.concat(F.substring(c, 1, at), x, F.expr(f"substring(s, {at + 2})"))
    ref = F.when(kind == 1, put(F.col("s"), 2, flip(F.substring("s", 3, 1)))).when(kind == 2, F.concat(F.substring("s", 1, 12), F.expr("substring(s, 14)"))).when(kind == 3, F.concat(F.substring("s", 1, 15), F.lit("A"), F.expr("substring(s, 16)"))).when(kind == 4, put(F.col("s"), 8, flip(F.substring("s", 9, 1)))).otherwise(F.col("s"))
    rows = rows.withColumn("ref", ref)
    alt = F.concat(F.substring("ref", 1, 8), F.when(kind == 4, third(F.substring("s", 9, 1))).otherwise(flip(F.substring("s", 9, 1))), F.expr("substring(ref, 10)"))
    cigar = F.when(kind == 2, F.concat(F.lit("12M1D"), n - 13, F.lit("M"))).when(kind == 3, F.concat(F.lit("15M1I"), n - 15, F.lit("M"))).otherwise(F.concat(n, F.lit("M")))
    score = F.when(kind.isin(1, 4), -6).when(kind.isin(2, 3), -8).otherwise(0).cast("long")
    edits = F.when(kind == 0, 0).when(kind == 5, 2).otherwise(1).cast("long")
    none = F.lit(None).cast("long")
    sam = rows.select("tag_id", F.lit("R").alias("allele"), F.lit(0).alias("flag"), "tag_id", F.lit(3).cast("long").alias("pos"), cigar.alias("cigar"), F.lit("*").alias("seq"), score.alias("score"), edits.alias("nm"), none.alias("xs")).toDF("tag_id", "allele", "flag", "rname", "pos", "cigar", "seq", "score", "nm", "xs")
    contigs = rows.select(F.col("tag_id").alias("contig_id"), F.concat(F.lit("AC"), "s", F.lit("GT")).alias("bases"))
    out = T.sam_placements(sam, rows.select("tag_id", "ref", alt.alias("alt"), F.lit(8).alias("snp0")), contigs)
    return out.select("tag_id", "locus", "snp", "base", "nonfocal_edits", "gap_bases", "focal_gap_distance", "reason", "error")


def placement_decision(spark, sf):
    return T.allele_decisions(_hits(spark, sf), cap=40, gap=1)


def allele_combination(spark, sf):
    return T.combine_alleles(T.allele_decisions(_hits(spark, sf), cap=40, gap=1), F.col("locus").startswith("0"))


def contiguous_groups(spark, sf):
    return T.noncontiguous(table(spark, sf, "conversations"), "conv_id", "turn", "role")


def tag_length_summary(spark, sf):
    n = F.length("text").cast("double")
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), *[F.percentile(n, p).alias(f"q{int(100 * p)}") for p in (0.25, 0.5, 0.75)], F.min(n).alias("least"), F.max(n).alias("most"))


def tag_length_distribution(spark, sf):
    """Documents per language and length in hundreds of letters, with their share of the language."""
    rows = table(spark, sf, "documents").groupBy("lang", F.floor(F.length("text") / 100).cast("long").alias("hundreds")).agg(F.count("*").alias("n"))
    total = rows.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("total"))
    return rows.join(total, F.col("lang").eqNullSafe(F.col("of"))).select("lang", "hundreds", "n", F.round(F.col("n") / F.col("total"), 9).alias("fraction"))


def filter_recovery(spark, sf):
    """Traits as filters: peaks under each, by all events and by its own denominator, and peaks of one filter only."""
    rows = assoc(spark, sf).select("trait", "chromosome", "peak").distinct()
    held = rows.groupBy("chromosome", "peak").agg(F.count("*").alias("k"))
    total = held.agg(F.count("*").alias("n_all"))
    per = rows.join(held, ["chromosome", "peak"]).groupBy("trait").agg(F.count("*").alias("n_peaks"), F.count_if(F.col("k") == 1).alias("n_only"))
    return per.join(F.broadcast(total)).select("trait", "n_peaks", "n_only", F.round(F.col("n_peaks") / F.col("n_all"), 9).alias("fraction_all"), F.round(F.col("n_only") / F.col("n_peaks"), 9).alias("fraction_own"))


def _policies(spark, sf):
    rows = loci(spark, sf).filter("resource = 'R'")
    old = rows.filter("accepted OR orig % 3 = 0").select("record_key", "chromosome", F.col("orig").alias("position"), F.col("accepted").alias("kept"))
    new = rows.filter("orig % 7 <> 0").select("record_key", "chromosome", F.when(F.col("orig") % 2 == 0, F.col("orig")).otherwise(F.col("ref")).alias("position"), (F.col("orig") % 5 != 0).alias("kept"))
    return old, new


def table_compare(spark, sf):
    old, new = _policies(spark, sf)
    return I.compare_by_key(old, new, ["record_key"]).groupBy("field", "state").agg(F.count("*").alias("n"), F.min("record_key").alias("first_key"))


def policy_transitions(spark, sf):
    old, new = _policies(spark, sf)
    both = old.join(new.select("record_key", F.col("position").alias("p2"), F.col("kept").alias("k2")), "record_key")
    k, k2 = F.col("kept"), F.col("k2")
    label = F.when(k & k2 & (F.col("position") == F.col("p2")), "RETAINED_SAME_FOCAL_LOCATION").when(k & k2, "RETAINED_DIFFERENT_FOCAL_LOCATION").when(k2, "NEWLY_RETAINED").when(k, "EXACT_ONLY_RETAINED_NOW_EXCLUDED").otherwise("NOT_RETAINED_IN_EITHER_POLICY")
    return both.groupBy("chromosome", label.alias("transition")).agg(F.count("*").alias("n"))


def scalar_comparisons(spark, sf):
    """Supplier and customer balances of equal keys: equal, off by a known factor, different."""
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("a"))
    b = F.when(F.col("key") % 3 == 0, F.col("a") * 100).when(F.col("key") % 3 == 1, F.col("a")).otherwise(F.col("a") + 1)
    return a.select("key", S.scalar_comparison(F.col("a"), b).alias("relation"))


QUERIES = {f.__name__: f for f in (event_dedup_conflicts, unique_peaks, event_crosswalk, extra_events_anti, interval_states, gene_consolidation, identity_unique_join, key_collisions, set_overlap, key_link_classification, fallback_match, canonical_ids, stable_ids, seed_choice, tag_eligibility, tag_exact_hits, mapping_summary, reverse_complement, sam_validation, placement_decision, allele_combination, contiguous_groups, tag_length_summary, tag_length_distribution, filter_recovery, table_compare, policy_transitions, scalar_comparisons)}

_HITS = """hits AS (SELECT user_id AS tag_id, event_id % 2 AS allele, concat_ws(':', event_id % 3, event_type) AS locus, CAST(-event_id % 31 AS BIGINT) AS score, CASE WHEN event_id % 5 = 0 THEN 'TOO_MANY_NONFOCAL_EDITS' ELSE 'ELIGIBLE_PLACEMENT' END AS reason,
 CASE WHEN event_id % 11 = 0 THEN CAST(-event_id % 31 AS BIGINT) - 2 END AS xs, event_id % 50 AS s, event_id % 50 + 20 AS e, CASE WHEN event_id % 2 = 0 THEN '20M' ELSE '19M1D1M' END AS cigar, CASE WHEN event_id % 7 = 0 THEN 'C' ELSE 'A' END AS base FROM events),
h AS (SELECT *, max(score) OVER (PARTITION BY tag_id, allele, locus) AS top FROM hits),
l AS (SELECT tag_id, allele, locus, top AS score, arg_min(reason, (-score, s, e, cigar, reason)) AS reason, max(xs) FILTER (score = top) AS xs, count(DISTINCT base) FILTER (score = top) > 1 AS torn, count(*) AS n FROM h GROUP BY tag_id, allele, locus, top),
k AS (SELECT *, row_number() OVER (PARTITION BY tag_id, allele ORDER BY score DESC, locus) AS rank, max(score) OVER (PARTITION BY tag_id, allele) AS best FROM l),
d0 AS (SELECT tag_id, allele, CAST(sum(n) AS BIGINT) AS n_hits, max(score) AS best_score, greatest(max(score) FILTER (rank = 2), max(xs) FILTER (score = best)) AS next_score, max(locus) FILTER (rank = 1) AS locus, max(reason) FILTER (rank = 1) AS reason, bool_or(torn) FILTER (rank = 1) AS torn FROM k GROUP BY ALL),
dec AS (SELECT tag_id, allele, n_hits, best_score, next_score, locus, CASE WHEN n_hits >= 40 THEN 'REPORTING_CAP_REACHED' WHEN best_score - next_score < 1 THEN 'INSUFFICIENT_SCORE_SEPARATION' WHEN best_score + 30 < 1 THEN 'SEARCH_THRESHOLD_MARGIN_INSUFFICIENT' WHEN reason <> 'ELIGIBLE_PLACEMENT' THEN reason WHEN torn THEN 'TIED_CIGAR_FOCAL_CONFLICT' ELSE 'RETAINED_BOUNDED_SEARCH' END AS status FROM d0)"""
_POL = f"""WITH {LOCI}, r AS (SELECT * FROM loci WHERE resource = 'R'), o AS (SELECT record_key, chromosome, orig AS position, accepted AS kept FROM r WHERE accepted OR orig % 3 = 0),
n AS (SELECT record_key, chromosome, CASE WHEN orig % 2 = 0 THEN orig ELSE ref END AS position, orig % 5 <> 0 AS kept FROM r WHERE orig % 7 <> 0)"""
_ID = "parts AS (SELECT p_partkey, concat_ws(' ', string_split(p_name, ' ')[1], p_brand, p_size) AS key, p_size % 3 AS chromosome, floor(p_retailprice) AS position FROM part)"
_SEQ = "s AS (SELECT p_partkey, translate(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') AS seq FROM part), t AS (SELECT *, seq || 'AACC' AS ref, seq || 'GACC' AS alt FROM s)"
_HIT = "h AS (SELECT item_id AS tag_id, d.doc_id AS contig_id, d.text AS t, b.text AS g FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND length(b.text) >= 24), hits AS (SELECT tag_id, contig_id, CAST(p AS BIGINT) AS start FROM (SELECT *, unnest(range(0, CAST(length(t) AS BIGINT))) AS p FROM h) WHERE substr(t, CAST(p + 1 AS BIGINT), length(g)) = g)"

ORACLE_SQL = {
    "event_dedup_conflicts": f"WITH {ASSOC} SELECT chromosome, peak, trait, min(source_row) AS first_row, arg_min(payload, source_row) AS first_payload, count(*) AS occurrences, count(DISTINCT payload) AS n_payloads, string_agg(CAST(source_row AS VARCHAR), ';' ORDER BY source_row) AS rows, count(DISTINCT payload) > 1 AS conflict FROM assoc WHERE sheet = 'master' GROUP BY 1, 2, 3",
    "unique_peaks": f"WITH {ASSOC} SELECT chromosome, peak, count(*) AS n_events, count(DISTINCT trait) AS n_traits, string_agg(DISTINCT trait, '; ' ORDER BY trait) AS traits FROM assoc GROUP BY 1, 2",
    "event_crosswalk": f"""WITH {ASSOC}, m AS (SELECT *, regexp_replace(trait, '_[a-z]+$', '') AS stem, CAST(floor(peak / 24.0) AS BIGINT) AS day FROM assoc WHERE sheet = 'master'), o AS (SELECT *, regexp_replace(trait, '_[a-z]+$', '') AS stem, CAST(floor(peak / 24.0) AS BIGINT) AS day FROM assoc WHERE sheet <> 'master'),
a AS (SELECT chromosome, peak, trait, count(*) AS n, min(source_row) AS v FROM m GROUP BY 1, 2, 3), b AS (SELECT chromosome, peak, stem, count(*) AS n, min(source_row) AS v FROM m GROUP BY 1, 2, 3), c AS (SELECT chromosome, day, trait, count(*) AS n, min(source_row) AS v FROM m GROUP BY 1, 2, 3),
j AS (SELECT o.source_row, o.sheet, a.n AS n1, a.v AS v1, b.n AS n2, b.v AS v2, c.n AS n3, c.v AS v3 FROM o LEFT JOIN a ON o.chromosome = a.chromosome AND o.peak = a.peak AND o.trait = a.trait LEFT JOIN b ON o.chromosome = b.chromosome AND o.peak = b.peak AND o.stem = b.stem LEFT JOIN c ON o.chromosome = c.chromosome AND o.day = c.day AND o.trait = c.trait)
SELECT source_row, sheet, CASE coalesce(n1, n2, n3, 0) WHEN 0 THEN 'not_matched' WHEN 1 THEN 'matched_unique_master_event' ELSE 'ambiguous_master_event' END AS match_status, CASE WHEN n1 > 0 THEN 'exact_event_key' WHEN n2 > 0 THEN 'terminal_suffix_whitespace_candidate' WHEN n3 > 0 THEN 'configured_trait_alias_candidate' END AS match_basis,
 CASE WHEN n1 > 0 THEN CASE WHEN n1 = 1 THEN v1 END WHEN n2 > 0 THEN CASE WHEN n2 = 1 THEN v2 END WHEN n3 = 1 THEN v3 END AS master_row FROM j""",
    "extra_events_anti": f"WITH {ASSOC} SELECT chromosome, peak, trait, min(source_row) AS source_row, count(*) AS occurrences FROM assoc a WHERE sheet <> 'master' AND NOT EXISTS (SELECT 1 FROM assoc m WHERE m.sheet = 'master' AND m.chromosome = a.chromosome AND m.peak = a.peak AND m.trait = a.trait) GROUP BY 1, 2, 3",
    "interval_states": f"""WITH {INTERVALS}, k AS (SELECT query_id, CASE WHEN query_id % 7 = 0 THEN NULL WHEN query_id % 11 = 0 THEN -"start" ELSE "start" END AS s, CASE WHEN query_id % 5 = 0 THEN NULL WHEN query_id % 13 = 0 THEN "start" - 1 ELSE "end" END AS e, CASE WHEN query_id % 17 = 0 THEN 0 ELSE "start" + query_id % 300 END AS p FROM intervals)
SELECT query_id, CASE WHEN coalesce(p, 0) <= 0 THEN 'invalid_peak' WHEN s IS NULL AND e IS NULL THEN 'no_boundaries' WHEN s IS NULL OR e IS NULL THEN 'partial_boundaries' WHEN s <= 0 OR e <= 0 THEN 'nonpositive_boundary' WHEN s > e THEN 'reversed_boundaries' WHEN p < s OR p > e THEN 'peak_outside_interval' ELSE 'valid_as_labeled' END AS state FROM k""",
    "gene_consolidation": """WITH r AS (SELECT l_partkey AS gene_id, l_suppkey % 3 AS chromosome, CAST(l_linenumber % 2 AS BIGINT) AS start, l_returnflag = 'R' AS flag, l_quantity > 1 AS ok FROM lineitem), g AS (SELECT gene_id, count(*) AS n_rows, count(DISTINCT (chromosome, start)) AS k, min(chromosome) AS chromosome, min(start) AS start, bool_or(flag) AS flag, bool_and(ok) AS ok FROM r GROUP BY 1)
SELECT gene_id, n_rows, CASE WHEN k = 1 THEN chromosome END AS chromosome, CASE WHEN k = 1 THEN start END AS start, flag, CASE WHEN k = 1 AND ok THEN 'UNIQUE' ELSE 'QUARANTINED' END AS status FROM g""",
    "identity_unique_join": f"""WITH {_ID}, a AS (SELECT key, min(p_partkey) AS p, min(chromosome) AS c, min(position) AS x FROM parts WHERE p_partkey % 2 = 0 GROUP BY 1 HAVING count(*) = 1), b AS (SELECT key, min(p_partkey) AS p, min(chromosome) AS c, min(position) AS x FROM parts WHERE p_partkey % 2 = 1 GROUP BY 1 HAVING count(*) = 1)
SELECT key, a.p AS p_partkey_a, b.p AS p_partkey_b, CASE WHEN a.c <> b.c THEN 'different_chromosomes' WHEN a.x = b.x THEN 'exact_coordinate' ELSE 'same_chromosome_offset' END AS relation FROM a JOIN b USING (key)""",
    "key_collisions": "SELECT p_brand, p_size, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ';' ORDER BY p_partkey) AS members FROM part GROUP BY 1, 2 HAVING count(*) > 1",
    "set_overlap": "WITH r AS (SELECT DISTINCT l_returnflag AS r, l_partkey AS k FROM lineitem), n AS (SELECT r, count(*) AS n FROM r GROUP BY 1), b AS (SELECT x.r AS a, y.r AS b, count(*) AS n_both FROM r x JOIN r y ON x.k = y.k AND x.r < y.r GROUP BY 1, 2) SELECT a, b, p.n AS n_a, q.n AS n_b, n_both, round(n_both / (p.n + q.n - n_both), 9) AS jaccard, n_both = p.n OR n_both = q.n AS subset FROM b JOIN n p ON p.r = a JOIN n q ON q.r = b",
    "key_link_classification": "WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n, min(l_partkey) AS f FROM lineitem WHERE l_quantity >= 45 GROUP BY 1) SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN coalesce(n, 0) = 0 THEN 'NO_SEQUENCE_IDENTITY_BRIDGE' WHEN n > 1 THEN 'AMBIGUOUS_REFERENCE_TAG_KEY' ELSE 'DIRECT_UNIQUE_EXACT_TAG' END AS status, CASE WHEN n = 1 THEN f END AS value FROM orders LEFT JOIN l ON CAST(o_orderkey AS VARCHAR) = key",
    "fallback_match": """WITH n AS (SELECT p_type, count(*) AS n_name, min(p_partkey) AS f FROM part GROUP BY 1 HAVING count(*) <= 20)
SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'EXACT_ID' WHEN n_name = 1 THEN 'EXACT_NAME' WHEN n_name > 1 THEN 'AMBIGUOUS_ANNOTATION_ID' ELSE 'SOURCE_GENE_ID_NOT_FOUND_IN_THIS_ANNOTATION' END AS basis, CASE WHEN p_size <= 10 THEN p_partkey WHEN n_name = 1 THEN f END AS target FROM part LEFT JOIN n USING (p_type)""",
    "canonical_ids": """WITH n AS (SELECT p_partkey, p_partkey || '|' || CASE p_partkey % 4 WHEN 1 THEN 'R' ELSE 'F' END || '|0' AS family, CAST(p_size AS VARCHAR) AS n, p_size FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN p_partkey || '.Z.0.' || n ELSE family || '--' || n END AS canonical_id, CASE WHEN p_partkey % 4 < 3 THEN CAST(p_size AS BIGINT) END AS suffix, CASE WHEN p_partkey % 4 = 3 THEN p_partkey || '.Z.0.' || n ELSE family END AS family,
 CASE WHEN p_partkey % 5 = 4 THEN 'chr' || n || 'x' ELSE n END AS chromosome, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS BIGINT) WHEN 1 THEN CAST(p_size AS BIGINT) * 1000 END AS whole FROM n""",
    "sam_validation": """WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS tag_id, p_partkey % 6 AS kind, translate(regexp_replace(upper(p_name || p_type || p_name), '[^A-Z]', '', 'g'), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') AS s FROM part)
SELECT tag_id, tag_id || ':+:11' AS locus, CAST(11 AS BIGINT) AS snp, substr(s, 9, 1) AS base, CAST(CASE WHEN kind IN (1, 2, 3) THEN 1 ELSE 0 END AS BIGINT) AS nonfocal_edits, CAST(CASE WHEN kind IN (2, 3) THEN 1 ELSE 0 END AS BIGINT) AS gap_bases, CAST(CASE kind WHEN 2 THEN 3 WHEN 3 THEN 7 END AS BIGINT) AS focal_gap_distance,
 CASE kind WHEN 2 THEN 'GAP_NEAR_FOCAL_SNP' WHEN 4 THEN 'REFERENCE_ALLELE_UNSUPPORTED' WHEN 5 THEN NULL ELSE 'ELIGIBLE_PLACEMENT' END AS reason, CASE WHEN kind = 5 THEN 'EDIT_COUNT_DISAGREES' END AS error FROM s WHERE length(s) >= 20""",
    "stable_ids": "SELECT page_id, substr(sha256(page_id || chr(31) || chr(31) || url), 1, 16) AS stable_id, substr(sha256(url), 1, 20) AS long_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages",
    "seed_choice": """WITH s AS (SELECT p_partkey, p_size % 30 AS snp, translate(regexp_replace(upper(p_name || p_type || p_name || p_type || p_brand || p_name), '[^A-Z]', '', 'g'), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') AS s FROM part),
g AS (SELECT p_partkey, s, o, substr(s, o + 1, 24) AS w FROM (SELECT *, unnest(range(0, length(s) - 23)) AS o FROM s) WHERE o > snp OR snp >= o + 24),
c AS (SELECT *, [24 - length(replace(w, 'A', '')), 24 - length(replace(w, 'C', '')), 24 - length(replace(w, 'G', '')), 24 - length(replace(w, 'T', ''))] AS n FROM g),
e AS (SELECT p_partkey, w, o, s, round(-list_sum(list_transform(n, lambda x: CASE WHEN x > 0 THEN x / 24 * log2(x / 24) ELSE 0 END)), 9) AS entropy, len(list_distinct(list_transform(range(1, 24), lambda i: substr(w, i, 2)))) AS twos FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY entropy DESC, twos DESC, abs(2 * o + 24 - length(s)), o) AS rn FROM e)
SELECT p.p_partkey, w AS seed, CAST(o AS BIGINT) AS seed_offset FROM part p LEFT JOIN r ON p.p_partkey = r.p_partkey AND rn = 1""",
    "tag_eligibility": """WITH s AS (SELECT p_partkey, p_partkey % 9 AS k, translate(regexp_replace(upper(p_name || p_type || p_name || p_type || p_brand || p_name), '[^A-Z]', '', 'g'), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') AS s FROM part),
e AS (SELECT *, CASE k WHEN 0 THEN 'UNSUPPORTED_SEQUENCE_OR_VARIATION' WHEN 7 THEN 'UNSUPPORTED_SEQUENCE_OR_VARIATION' WHEN 1 THEN 'UNSUPPORTED_REFERENCE_TAG' WHEN 2 THEN 'FLANK_REFERENCE_TAG_MISMATCH' WHEN 3 THEN 'PRIOR_REFERENCE_KEY_NOT_CONFIRMED' WHEN 4 THEN 'MISSING_REFERENCE_KEY'
 WHEN 5 THEN 'TAG_TOO_SHORT' WHEN 6 THEN CASE WHEN length(s) < 30 THEN 'TAG_TOO_SHORT' ELSE 'NO_SNP_FREE_SEED' END ELSE CASE WHEN length(s) < 30 THEN 'TAG_TOO_SHORT' WHEN greatest(20, length(s) - 21) < 24 THEN 'NO_SNP_FREE_SEED' ELSE 'ELIGIBLE' END END AS eligibility FROM s)
SELECT p_partkey, eligibility, CASE WHEN eligibility = 'ELIGIBLE' THEN length(s) END AS tag_length, CASE WHEN eligibility = 'ELIGIBLE' THEN sha256(substr(s, 1, 20) || translate(substr(s, 21, 1), 'ACGT', 'CGTA') || substr(s, 22)) END AS alt_sha256 FROM e WHERE length(s) >= 41""",
    "tag_exact_hits": f"WITH {_HIT} SELECT tag_id, contig_id, start FROM hits",
    "mapping_summary": f"""WITH {_HIT}, n AS (SELECT tag_id, count(*) AS n, min(contig_id) AS c, min(start) AS s FROM hits GROUP BY 1)
SELECT item_id AS tag_id, coalesce(n, 0) AS n_places, CASE WHEN length(text) < 24 THEN 'TAG_TOO_SHORT' WHEN n IS NULL THEN 'NO_EXACT_FULL_TAG_MATCH' WHEN n > 1 THEN 'MULTIPLE_EXACT_FULL_TAG_PLACEMENTS' ELSE 'UNIQUE_EXACT_PLACEMENT' END AS status, CASE WHEN n = 1 THEN c END AS contig_id, CASE WHEN n = 1 THEN s END AS start FROM benchmark LEFT JOIN n ON item_id = tag_id""",
    "reverse_complement": f"""WITH {_SEQ} SELECT p_partkey, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS flipped, CASE p_partkey % 4 WHEN 0 THEN 'exact_ref_tag' WHEN 1 THEN 'exact_alt_tag' WHEN 2 THEN CASE WHEN reverse(translate(ref, 'ACGT', 'TGCA')) = ref THEN 'exact_ref_tag' WHEN reverse(translate(ref, 'ACGT', 'TGCA')) = alt THEN 'exact_alt_tag' ELSE 'reverse_complement_ref_tag' END ELSE 'sequence_mismatch' END AS comparison FROM t""",
    "placement_decision": f"WITH {_HITS} SELECT * FROM dec",
    "allele_combination": f"""WITH {_HITS}, c AS (SELECT tag_id, count(*) FILTER (status = 'RETAINED_BOUNDED_SEARCH') AS n, min(locus) AS lo, max(locus) AS locus FROM dec GROUP BY 1), s AS (SELECT tag_id, locus, CASE WHEN n < 2 THEN 'BOTH_ALLELES_REQUIRED' WHEN lo <> locus THEN 'ALLELE_PLACEMENTS_DISAGREE' WHEN locus LIKE '0%' THEN 'RETAINED_PRIMARY_CHROMOSOME' ELSE 'RETAINED_UNPLACED_CONTIG' END AS status FROM c)
SELECT *, status = 'RETAINED_PRIMARY_CHROMOSOME' AS accepted FROM s""",
    "contiguous_groups": """WITH l AS (SELECT conv_id, role, lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, role, count(*) AS n_rows, count(*) FILTER (new) AS n_runs, count(*) FILTER (new) = 1 AS contiguous FROM l GROUP BY 1, 2""",
    "tag_length_summary": "SELECT lang, count(*) AS n, quantile_cont(CAST(length(text) AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(length(text) AS DOUBLE), 0.5) AS q50, quantile_cont(CAST(length(text) AS DOUBLE), 0.75) AS q75, CAST(min(length(text)) AS DOUBLE) AS least, CAST(max(length(text)) AS DOUBLE) AS most FROM documents GROUP BY 1",
    "tag_length_distribution": "WITH d AS (SELECT lang, CAST(length(text) // 100 AS BIGINT) AS hundreds, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, hundreds, n, round(n / sum(n) OVER (PARTITION BY lang), 9) AS fraction FROM d",
    "filter_recovery": f"WITH {ASSOC}, r AS (SELECT DISTINCT trait, chromosome, peak FROM assoc), h AS (SELECT chromosome, peak, count(*) AS k FROM r GROUP BY 1, 2) SELECT trait, count(*) AS n_peaks, count(*) FILTER (k = 1) AS n_only, round(count(*) / (SELECT count(*) FROM h), 9) AS fraction_all, round(count(*) FILTER (k = 1) / count(*), 9) AS fraction_own FROM r JOIN h USING (chromosome, peak) GROUP BY 1",
    "table_compare": f"""{_POL}, b AS (SELECT coalesce(o.record_key, n.record_key) AS record_key, o.record_key IS NULL AS nl, n.record_key IS NULL AS nr, o.chromosome AS c1, n.chromosome AS c2, o.position AS p1, n.position AS p2, o.kept AS k1, n.kept AS k2 FROM o FULL JOIN n ON o.record_key = n.record_key),
f AS (SELECT record_key, nl, nr, 'chromosome' AS field, c1 IS NOT DISTINCT FROM c2 AS same FROM b UNION ALL SELECT record_key, nl, nr, 'position', p1 IS NOT DISTINCT FROM p2 FROM b UNION ALL SELECT record_key, nl, nr, 'kept', k1 IS NOT DISTINCT FROM k2 FROM b)
SELECT field, CASE WHEN nl THEN 'only_right' WHEN nr THEN 'only_left' ELSE 'different' END AS state, count(*) AS n, min(record_key) AS first_key FROM f WHERE nl OR nr OR NOT same GROUP BY 1, 2""",
    "policy_transitions": f"{_POL} SELECT o.chromosome, CASE WHEN o.kept AND n.kept AND o.position = n.position THEN 'RETAINED_SAME_FOCAL_LOCATION' WHEN o.kept AND n.kept THEN 'RETAINED_DIFFERENT_FOCAL_LOCATION' WHEN n.kept THEN 'NEWLY_RETAINED' WHEN o.kept THEN 'EXACT_ONLY_RETAINED_NOW_EXCLUDED' ELSE 'NOT_RETAINED_IN_EITHER_POLICY' END AS transition, count(*) AS n FROM o JOIN n ON o.record_key = n.record_key GROUP BY 1, 2",
    "scalar_comparisons": "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_acctbal = 0 THEN 'equal' ELSE 'scale_factor_100' END WHEN s_suppkey % 3 = 1 THEN 'equal' ELSE 'different' END AS relation FROM supplier",
}
