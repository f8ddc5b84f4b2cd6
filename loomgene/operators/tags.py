"""Exact tag placement, placement decisions, contiguous groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SEED = 24
CAP, GAP, FLOOR = 10, 6, -30


def select_seed(tag: Column, snp: Column, k: int = SEED) -> Column:
    """The k-mer without the variant's place that has the highest letter entropy, then most distinct letter pairs, then is nearest to the middle, then leftmost: (seed, offset); null if none fits."""
    last = F.length(tag) - k
    size = float(k)

    def gram(o):
        seed = F.substr(tag, o + 1, F.lit(k))
        share = lambda x: (F.lit(k) - F.length(F.replace(seed, F.lit(x), F.lit("")))) / size
        entropy = sum((F.when(share(x) > 0, share(x) * F.log2(share(x))).otherwise(0.0) for x in "ACGT"), F.lit(0.0))
        twos = F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.substr(seed, i, F.lit(2)))))
        # Rounded, as equal counts in another order of letters differ in the last bits.
        return F.struct(F.round(-entropy, 9).alias("entropy"), twos.alias("twos"), (-F.abs(2 * o + k - F.length(tag))).alias("middle"), (-o).alias("place"), seed.alias("seed"))

    free = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda o: (o > snp) | (snp >= o + k))
    best = F.array_max(F.transform(free, gram))
    return F.when((last >= 0) & (F.size(free) > 0), F.struct(best["seed"].alias("seed"), (-best["place"]).alias("offset")))


def eligible_tags(rows: DataFrame, least: int, k: int = SEED) -> DataFrame:
    """``rows`` with ref_tag, alt_tag, snp0 and eligibility: the first of eight reasons that applies, else ELIGIBLE.

    ``rows``: five_flank, three_flank, variation, reference_sequence, ref_lookup_status, reference_key. Flanks may be empty.
    """
    clean = lambda c: F.upper(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s", ""))
    letters = lambda c, empty: clean(c).rlike("^[ACGT]*$" if empty else "^[ACGT]+$")
    change = F.upper(F.trim(F.coalesce(F.col("variation"), F.lit(""))))
    of = lambda i: F.regexp_extract(change, r"^([ACGT])\s*>\s*([ACGT])$", i)
    fine = letters("five_flank", True) & letters("three_flank", True) & (of(1) != "") & (of(1) != of(2))
    out = rows.withColumns({f"{n}_tag": F.when(fine, F.concat(clean("five_flank"), of(i), clean("three_flank"))) for n, i in (("ref", 1), ("alt", 2))})
    out = out.withColumn("snp0", F.when(fine, F.length(clean("five_flank"))))
    tag = F.col("ref_tag")
    reason = (
        F.when(tag.isNull(), "UNSUPPORTED_SEQUENCE_OR_VARIATION").when(~letters("reference_sequence", False), "UNSUPPORTED_REFERENCE_TAG").when(tag != clean("reference_sequence"), "FLANK_REFERENCE_TAG_MISMATCH")
        .when(~F.col("ref_lookup_status").eqNullSafe("exact_ref_tag"), "PRIOR_REFERENCE_KEY_NOT_CONFIRMED").when(F.trim(F.coalesce(F.col("reference_key"), F.lit(""))) == "", "MISSING_REFERENCE_KEY")
        .when(F.length(tag) < least, "TAG_TOO_SHORT").when(F.greatest(F.col("snp0"), F.length(tag) - F.col("snp0") - 1) < k, "NO_SNP_FREE_SEED").otherwise("ELIGIBLE")
    )
    return out.withColumn("eligibility", reason)


def exact_hits(tags: DataFrame, contigs: DataFrame, k: int = SEED, block_bytes: int = 4 << 20) -> DataFrame:
    """(tag_id, contig_id, start, strand): all places of whole tags of at least k letters, on both strands.

    Tags go to the scan of the contigs as one automaton for each block of bounded size, so contigs aren't
    shuffled and each letter is read once. Contigs may be chunks (column chunk_start) that overlap by the
    longest tag less one letter; a place found twice counts once.
    """
    spark = tags.sparkSession
    flip = F.reverse(F.translate("tag", "ACGTacgt", "TGCAtgca"))
    usable = tags.filter(F.length("tag") >= k).select("tag_id", "tag", flip.alias("flipped"))
    size = usable.agg(F.sum(F.octet_length("tag"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    chunked = "chunk_start" in contigs.columns
    rows = contigs.select("contig_id", (F.col("chunk_start") if chunked else F.lit(0)).cast("long").alias("chunk_start"), "bases").filter("bases IS NOT NULL")
    schema = T.StructType([tags.schema["tag_id"], contigs.schema["contig_id"], T.StructField("start", T.LongType()), T.StructField("strand", T.StringType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    names = schema.names
    found = None
    for b in range(blocks):
        words: dict[str, list] = {}
        for r in usable.filter(F.pmod(F.xxhash64("tag_id"), F.lit(blocks)) == b).toLocalIterator():
            words.setdefault(r["tag"], []).append((r["tag_id"], "+"))
            words.setdefault(r["flipped"], []).append((r["tag_id"], "-"))
        sent = spark.sparkContext.broadcast(words)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            matcher = ahocorasick.Automaton()
            for word, owners in sent.value.items():
                matcher.add_word(word, (len(word), owners))
            if not len(matcher):
                return
            matcher.make_automaton()
            for batch in batches:
                out = []
                for contig, base, text in zip(*(batch.column(i) for i in range(3))):
                    contig, base = contig.as_py(), base.as_py()
                    for end, (length, owners) in matcher.iter(text.as_py()):
                        out += [(tag, contig, base + end - length + 1, strand) for tag, strand in owners]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        part = rows.mapInArrow(scan, schema)
        found = part if found is None else found.unionByName(part)
    return found.distinct() if chunked else found


def mapping_summary(tags: DataFrame, hits: DataFrame, eligible: Column) -> DataFrame:
    """One row per tag: eligibility, then none, one or many places."""
    n = hits.groupBy("tag_id").agg(F.count("*").alias("n_places"), F.min(F.struct("contig_id", "start", "strand")).alias("first"))
    rows = tags.join(n, "tag_id", "left").withColumn("n_places", F.coalesce("n_places", F.lit(0)))
    status = F.when(~eligible, "TAG_TOO_SHORT").when(F.col("n_places") == 0, "NO_EXACT_FULL_TAG_MATCH").when(F.col("n_places") > 1, "MULTIPLE_EXACT_FULL_TAG_PLACEMENTS").otherwise("UNIQUE_EXACT_PLACEMENT")
    one = F.col("n_places") == 1
    return rows.select("tag_id", "n_places", status.alias("status"), F.when(one, F.col("first.contig_id")).alias("contig_id"), F.when(one, F.col("first.start")).alias("start"))


def allele_decisions(hits: DataFrame, cap: int = CAP, gap: int = GAP, floor: int = FLOOR, expected: DataFrame | None = None) -> DataFrame:
    """Per tag and allele: the best locus, the next one's score, and the first reason that applies; competition comes before edit limits.

    ``hits``: tag_id, allele, locus, score, reason, xs (null where not reported), and where known start, end, cigar, base,
    other_base and snp. Of the best locus' best alignments the first by start, end and cigar gives the reason; the largest xs
    of all alignments of the best score competes too. ``expected`` (tag_id, allele) adds those without an alignment.
    """
    keys = ["tag_id", "allele"]
    for name, kind in (("start", "long"), ("end", "long"), ("cigar", "string"), ("base", "string"), ("other_base", "string"), ("snp", "long")):
        if name not in hits.columns:
            hits = hits.withColumn(name, F.lit(None).cast(kind))
    focal = F.struct("base", "other_base", "snp")
    loci = hits.groupBy(*keys, "locus").agg(
        F.count("*").alias("n"), F.max(F.struct("score", "xs")).alias("top"), F.min_by("reason", F.struct(-F.col("score"), "start", "end", "cigar", "reason")).alias("reason"),
        F.max(F.struct(F.col("score"), focal.alias("f"))).alias("hi"), F.min(F.struct((-F.col("score")).alias("score"), focal.alias("f"))).alias("lo"),
    )
    # Loci of one tag are few: at most as many as alignments are reported for it.
    best = F.struct(-F.col("top.score"), F.col("locus"))
    out = loci.groupBy(*keys).agg(
        F.sum("n").alias("n_hits"), F.count("*").alias("n_loci"), F.max(F.col("top")).alias("top"), F.min_by(F.struct("locus", "reason", (F.col("hi.f") != F.col("lo.f")).alias("torn")), best).alias("b"),
        F.slice(F.array_sort(F.collect_list(-F.col("top.score"))), 2, 1).alias("others"),
    )
    top = F.col("top.score")
    out = out.withColumn("next_score", F.greatest(-F.try_element_at("others", F.lit(1)), F.col("top.xs")))
    status = (
        F.when(F.col("n_hits") >= cap, "REPORTING_CAP_REACHED").when(top - F.col("next_score") < gap, "INSUFFICIENT_SCORE_SEPARATION")
        .when(top - floor < gap, "SEARCH_THRESHOLD_MARGIN_INSUFFICIENT").when(F.col("b.reason") != "ELIGIBLE_PLACEMENT", F.col("b.reason"))
        .when(F.col("b.torn"), "TIED_CIGAR_FOCAL_CONFLICT").otherwise("RETAINED_BOUNDED_SEARCH")
    )
    out = out.select(*keys, "n_hits", top.alias("best_score"), "next_score", F.col("b.locus").alias("locus"), status.alias("status"))
    if expected is None:
        return out
    some = expected.select(*keys).distinct().join(out, keys, "left")
    return some.withColumns({"n_hits": F.coalesce("n_hits", F.lit(0)), "status": F.coalesce("status", F.lit("UNMAPPED"))})


def combine_alleles(decisions: DataFrame, primary: Column) -> DataFrame:
    """Both alleles must be retained, at one locus; only primary chromosomes are accepted."""
    side = decisions.groupBy("tag_id").agg(F.count_if(F.col("status") == "RETAINED_BOUNDED_SEARCH").alias("n"), F.min("locus").alias("lo"), F.max("locus").alias("locus"))
    status = F.when(F.col("n") < 2, "BOTH_ALLELES_REQUIRED").when(F.col("lo") != F.col("locus"), "ALLELE_PLACEMENTS_DISAGREE").when(primary, "RETAINED_PRIMARY_CHROMOSOME").otherwise("RETAINED_UNPLACED_CONTIG")
    return side.select("tag_id", "locus", status.alias("status"), (status == "RETAINED_PRIMARY_CHROMOSOME").alias("accepted"))


def top_alignments(hits: DataFrame, n: int = 2) -> DataFrame:
    order = W.partitionBy("tag_id", "allele").orderBy(F.desc("score"), "locus")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def noncontiguous(rows: DataFrame, stream: str, order: str, group: str) -> DataFrame:
    """Runs of each group within a stream; a group with more than one run isn't contiguous."""
    w = W.partitionBy(stream).orderBy(order)
    first = ~F.lag(group).over(w).eqNullSafe(F.col(group)) | (F.row_number().over(w) == 1)
    return rows.withColumn("__new", first).groupBy(stream, group).agg(F.count("*").alias("n_rows"), F.count_if("__new").alias("n_runs")).withColumn("contiguous", F.col("n_runs") == 1)


def cigar_walk(cigar: Column, pos: Column, focal: Column) -> Column:
    """struct(end, focal_position, gap_bases, focal_gap_distance) of an alignment; ``focal`` is a 0-based place in the read.

    focal_position is null where the focal base isn't aligned; the gap distance is that of the nearest
    gap, in read bases from the focal one, 0 beside a deletion, or null without gaps.
    """
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("long").alias("n"), F.substring(x, -1, 1).alias("op")))
    null = F.lit(None).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("read"), pos.cast("long").alias("ref"), null.alias("focal"), F.lit(0).cast("long").alias("gaps"), null.alias("near"))

    def step(s, o):
        n, op = o["n"], o["op"]
        both, read, ref = op.isin("M", "=", "X"), op.isin("I", "S"), op.isin("D", "N")
        inside = both & (focal >= s["read"]) & (focal < s["read"] + n)
        gap = op.isin("I", "D")
        # A deletion lies between two read bases and is as near to either.
        away = F.when(op == "I", F.greatest(s["read"] - focal, focal - (s["read"] + n - 1), F.lit(0))).otherwise(F.least(F.abs(focal - s["read"]), F.abs(focal - s["read"] + 1)))
        return F.struct(
            (s["read"] + F.when(both | read, n).otherwise(0)).alias("read"), (s["ref"] + F.when(both | ref, n).otherwise(0)).alias("ref"),
            F.when(inside, s["ref"] + focal - s["read"]).otherwise(s["focal"]).alias("focal"), (s["gaps"] + F.when(gap, n).otherwise(0)).alias("gaps"),
            F.when(gap, F.least(s["near"], away)).otherwise(s["near"]).alias("near"),
        )

    walked = F.aggregate(ops, start, step)
    return F.struct((walked["ref"] - 1).alias("end"), walked["focal"].alias("focal_position"), walked["gaps"].alias("gap_bases"), walked["near"].alias("focal_gap_distance"))


def placement_reason(cigar: Column, aligned: Column, supported: Column, walk: Column, edits: Column) -> Column:
    return (
        F.when(cigar.rlike("[SH]"), "NOT_FULL_END_TO_END").when(~aligned, "FOCAL_SNP_NOT_ON_REFERENCE_BASE").when(~supported, "REFERENCE_ALLELE_UNSUPPORTED")
        .when(walk["focal_gap_distance"] <= 3, "GAP_NEAR_FOCAL_SNP").when(walk["gap_bases"] > 2, "TOO_MANY_GAP_BASES").when(edits > 3, "TOO_MANY_NONFOCAL_EDITS").otherwise("ELIGIBLE_PLACEMENT")
    )


#: Penalties and limits of the aligner's run; the defaults are those of the study.
PENALTIES = {"mismatch": 6, "gap_open": 5, "gap_extend": 3}


def chunked(contigs: DataFrame, size: int = 1 << 16, overlap: int = 512) -> DataFrame:
    """(contig_id, chunk, bases): contigs cut so that each stretch of up to ``overlap`` letters lies whole in the chunk in which it begins.

    Contigs that come with chunk_start are cut already, at multiples of ``size``.
    """
    if "chunk_start" in contigs.columns:
        return contigs.select("contig_id", F.expr(f"chunk_start div {size}").alias("chunk"), "bases")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(length(bases) - 1, 0) div {size}")))
    return contigs.select("contig_id", "bases", at.alias("chunk")).select("contig_id", "chunk", F.substring("bases", F.col("chunk").cast("int") * size + 1, F.lit(size + overlap)).alias("bases"))


def sam_placements(sam: DataFrame, tags: DataFrame, contigs: DataFrame, penalties: dict = PENALTIES, size: int = 1 << 16, overlap: int = 512) -> DataFrame:
    """Alignments held against their tag and the reference: error (null if none), and what the placement rests on.

    ``sam``: tag_id, allele ('R' or 'A'), flag, rname, pos, cigar, seq, score, nm, xs. ``tags``: tag_id, ref, alt, snp0 (0-based place
    of the variant in both). ``contigs``: contig_id, bases. Unmapped lines (flag 4) are left out. An alignment meets its stretch of the
    reference by an equi-join on contig and chunk. Alignments are at most ``overlap`` reference letters long; longer ones are an error.
    """
    ops = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("long").alias("n"), F.substring(x, -1, 1).alias("op")))
    total = lambda kinds: F.aggregate("ops", F.lit(0).cast("long"), lambda t, o: t + F.when(o["op"].isin(*kinds), o["n"]).otherwise(0))
    minus = F.col("flag").bitwiseAND(16) > 0
    flip = lambda c: F.reverse(F.translate(c, "ACGT", "TGCA"))
    rows = sam.filter(F.col("flag").bitwiseAND(4) == 0).join(tags, "tag_id", "left").withColumns({"ops": ops, "strand": F.when(minus, "-").otherwise("+")})
    own = F.when(F.col("allele") == "R", F.col("ref")).when(F.col("allele") == "A", F.col("alt"))
    rows = rows.withColumns({"query": F.when(minus, flip(own)).otherwise(own), "focal": F.when(minus, F.length(own) - 1 - F.col("snp0")).otherwise(F.col("snp0")).cast("long")})
    rows = rows.withColumns({"q_length": total("MIS=X"), "r_length": total("MDN=X"), "chunk": F.expr(f"(pos - 1) div {size}")})
    joined = rows.join(chunked(contigs, size, overlap).select(F.col("contig_id").alias("rname"), "chunk", F.col("bases").alias("chunk_bases")), ["rname", "chunk"], "left")
    joined = joined.withColumn("target", F.substring("chunk_bases", ((F.col("pos") - 1) % size + 1).cast("int"), F.col("r_length").cast("int"))).drop("chunk_bases")

    null = F.lit(None).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("wrong"), F.lit(0).cast("long").alias("gaps"), F.lit(0).cast("long").alias("cost"), null.alias("snp"), null.alias("near"), F.lit(False).alias("odd"))
    letter = lambda c, i: F.substring(c, i.cast("int") + 1, F.lit(1))

    def step(s, o):
        n, op = o["n"], o["op"]
        both, gap = op.isin("M", "=", "X"), op.isin("I", "D")
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: (letter(F.col("query"), s["q"] + i) != letter(F.col("target"), s["r"] + i)).cast("long"))
        wrong = F.when(both & (n > 0), F.aggregate(place, F.lit(0).cast("long"), lambda t, x: t + x)).otherwise(0)
        inside = both & (F.col("focal") >= s["q"]) & (F.col("focal") < s["q"] + n)
        away = F.when(op == "I", F.greatest(s["q"] - F.col("focal"), F.col("focal") - (s["q"] + n - 1), F.lit(0))).otherwise(F.least(F.abs(F.col("focal") - s["q"]), F.abs(F.col("focal") - s["q"] + 1)))
        return F.struct(
            (s["q"] + F.when(both | op.isin("I", "S"), n).otherwise(0)).alias("q"), (s["r"] + F.when(both | op.isin("D", "N"), n).otherwise(0)).alias("r"), (s["wrong"] + wrong).alias("wrong"),
            (s["gaps"] + F.when(gap, n).otherwise(0)).alias("gaps"), (s["cost"] + F.when(gap, F.lit(penalties["gap_open"]) + n * F.lit(penalties["gap_extend"])).otherwise(0)).alias("cost"),
            F.when(inside, s["r"] + F.col("focal") - s["q"]).otherwise(s["snp"]).alias("snp"), F.when(gap, F.least(s["near"], away)).otherwise(s["near"]).alias("near"), (s["odd"] | ~(both | gap)).alias("odd"),
        )

    whole = F.array_join(F.transform("ops", lambda o: F.concat(o["n"].cast("string"), o["op"])), "")
    broken = (F.size("ops") == 0) | (whole != F.col("cigar")) | F.exists("ops", lambda o: o["n"] <= 0)
    early = (
        F.when(F.col("flag").bitwiseAND(1 | 2048) > 0, "PAIRED_OR_SUPPLEMENTARY").when(F.col("query").isNull(), "UNKNOWN_TAG").when((F.col("seq") != "*") & (F.col("seq") != F.col("query")), "SEQUENCE_DIFFERS_FROM_TAG")
        .when(F.col("score").isNull() | F.col("nm").isNull(), "MISSING_SCORE_OR_EDITS").when(broken, "INVALID_CIGAR").when(F.col("q_length") != F.length("query"), "CIGAR_LENGTH_DIFFERS")
        .when((F.col("pos") < 1) | (F.col("r_length") > overlap) | F.coalesce(F.length("target") != F.col("r_length"), F.lit(True)), "OUTSIDE_REFERENCE")
    )
    walked = joined.withColumn("early", early).withColumn("w", F.when(F.col("early").isNull(), F.aggregate("ops", start, step)))
    base = F.when(F.col("w.snp").isNotNull(), letter(F.col("target"), F.col("w.snp")))
    one = lambda c: F.when(minus, F.translate(letter(c, F.col("snp0")), "ACGT", "TGCA")).otherwise(letter(c, F.col("snp0")))
    unclear = F.col("target").rlike("[^ACGT]")
    walked = walked.withColumns({"base": base, "first": one(F.col("ref")), "second": one(F.col("alt")), "edits": F.col("w.wrong") + F.col("w.gaps")})
    late = (
        F.when(F.col("w.odd") | unclear, F.lit(None).cast("string")).when(F.col("nm") != F.col("edits"), "EDIT_COUNT_DISAGREES")
        .when(F.col("score") != -(F.col("w.wrong") * penalties["mismatch"] + F.col("w.cost")), "SCORE_DISAGREES")
    )
    off = F.when(F.col("w.snp").isNotNull() & (letter(F.col("query"), F.col("focal")) != F.col("base")), 1).otherwise(0)
    supported = ~unclear & F.col("base").isin(F.col("first"), F.col("second"))
    walk = F.struct(F.col("w.near").alias("focal_gap_distance"), F.col("w.gaps").alias("gap_bases"))
    walked = walked.withColumns({"error": F.coalesce("early", late), "nonfocal_edits": F.col("edits") - off, "walk": walk, "odd": F.when(F.col("w.odd"), "S").otherwise("M")})
    reason = F.when(F.col("error").isNull(), placement_reason(F.col("odd"), F.col("w.snp").isNotNull(), F.coalesce(supported, F.lit(False)), F.col("walk"), F.col("nonfocal_edits")))
    other = F.when(F.col("first") != F.col("base"), F.col("first")).when(F.col("second") != F.col("base"), F.col("second")).otherwise("")
    snp = F.col("pos") + F.col("w.snp")
    locus = F.when(snp.isNotNull(), F.concat_ws(":", "rname", "strand", snp)).otherwise(F.concat_ws(":", "rname", "strand", "pos", F.col("pos") + F.col("r_length") - 1, "cigar"))
    return walked.select(
        "tag_id", "allele", "rname", "strand", F.col("pos").alias("start"), (F.col("pos") + F.col("r_length") - 1).alias("end"), "cigar", "score", "nm", "xs", locus.alias("locus"), snp.alias("snp"), "base", other.alias("other_base"),
        "nonfocal_edits", F.col("w.gaps").alias("gap_bases"), F.col("w.near").alias("focal_gap_distance"), reason.alias("reason"), "error",
    )


def checked_placements(placements: DataFrame) -> DataFrame:
    """Placements, or a failure at the first alignment that contradicts its tag, its reference or itself."""
    bad = F.raise_error(F.concat_ws(" ", F.lit("alignment of"), "tag_id", "allele", F.lit("at"), "locus", F.lit(":"), "error"))
    return placements.withColumn("reason", F.when(F.col("error").isNotNull(), bad.cast("string")).otherwise(F.col("reason"))).drop("error")
