import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgene.functions import scalars as S
from loomgene.operators import adjusted, tags
from loomgene.operators.dosage import correlate
from loomgene.operators.nearest import band_pairs, nearest, nearest_each, overlap_pairs


def test_nearest_equals_brute_force_across_buckets(spark):
    rng = random.Random(4)
    points = [(str(k), rng.randrange(1, 4000)) for k in range(2) for _ in range(150)]
    spans = [(i, str(rng.randrange(3)), s, s + rng.randrange(0, 60)) for i in range(300) for s in [rng.randrange(1, 4000)]]
    q = spark.createDataFrame(spans, "id int, chromosome string, start long, end long")
    p = spark.createDataFrame(points, "chromosome string, pos long")
    for bucket in (7, 500, 1 << 14):
        got = {r["id"]: r["distance"] for r in nearest(q, p, ["chromosome"], bucket=bucket).collect()}
        for i, c, s, e in spans:
            want = min((max(s - x, x - e, 0) for k, x in points if k == c), default=None)
            assert got[i] == want


def test_interval_body_is_closed(spark):
    q = spark.createDataFrame([(1, "1", 10, 20)], "id int, chromosome string, start long, end long")
    for at, want in ((10, 0), (15, 0), (20, 0), (25, 5), (7, 3)):
        p = spark.createDataFrame([("1", at)], "chromosome string, pos long")
        assert nearest(q, p, ["chromosome"]).first()["distance"] == want


def test_band_pairs_once(spark):
    rng = random.Random(5)
    rows = [(i, str(rng.randrange(2)), rng.randrange(300)) for i in range(120)]
    a = spark.createDataFrame(rows, "i int, c string, p int")
    got = sorted((r["i"], r["j"]) for r in band_pairs(a, a.select(F.col("i").alias("j"), "c", F.col("p").alias("q")), "c", 10, "p", "q").filter("i < j").collect())
    assert got == sorted((a, b) for a, c, p in rows for b, d, q in rows if a < b and c == d and abs(p - q) <= 10)


def test_correlation_cases(spark):
    cases = [([0, 1, 2, 1], [0, 1, 2, 1], 1.0), ([0, 1, 2, 1], [2, 1, 0, 1], 1.0), ([0, 0, 2, 2], [0, 2, 0, 2], 0.0), ([0, 0, 0, 0], [0, 1, 2, 1], None)]
    df = spark.createDataFrame([(x, y) for x, y, _ in cases], "x array<tinyint>, y array<tinyint>")
    got = correlate(df, "x", "y", least=3).collect()
    assert [r["r2"] for r in got] == [c[2] for c in cases] and got[3]["status"] == 2
    few = spark.createDataFrame([([0, 1, 2, None, 2], [0, None, 2, 1, 1])], "x array<tinyint>, y array<tinyint>")
    assert correlate(few, "x", "y", least=3).first()["n"] == 3 and correlate(few, "x", "y", least=4).first()["status"] == 1


def test_raw_model_is_plain_correlation(spark):
    rng = np.random.default_rng(2)
    rows = [(i, str(i % 2), rng.integers(0, 3, 20).tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "marker long, chromosome string, dosage array<tinyint>")
    models = adjusted.held_out_models([r.asDict() for r in adjusted.gram_sums(df).collect()])
    units = {r["marker"]: np.array(r["unit"]) for r in adjusted.unit_vectors(df, models).filter("model = 'RAW'").collect()}
    want = np.corrcoef(rows[0][2], rows[2][2])[0, 1] ** 2
    assert abs((units[0] @ units[2]) ** 2 - want) < 1e-12
    for name in adjusted.MODELS:
        assert np.abs(adjusted.projection(models["0"], name) @ np.ones(20)).max() < 1e-6


def test_greedy_thinning(spark):
    rows = [("x", i, "1", p, f) for i, (p, f) in enumerate([(1, 0), (50, 1), (100_050, 0), (100_060, 2), (200_001, 2), (200_002, 3)])]
    df = spark.createDataFrame(rows, "held_out string, marker long, chromosome string, position long, family long")
    assert sorted(r["marker"] for r in adjusted.thin(df).collect()) == [0, 3, 5]


def test_tolerant_neighbour(spark):
    df = spark.createDataFrame([(1, 2, 0.8), (1, 3, 0.8 + 2e-14), (4, 5, 0.1), (4, 6, 0.3)], "marker long, partner long, r2 double")
    assert sorted((r["marker"], r["partner"]) for r in adjusted.tolerant_best(df).collect()) == [(1, 2), (4, 6)]


def test_exact_hits_both_strands_and_chunks(spark):
    rng = random.Random(9)
    genome = "".join(rng.choice("ACGT") for _ in range(900))
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    items = [(0, genome[10:50]), (1, flip(genome[300:340])), (2, genome[480:520]), (3, "ACGT" * 10), (4, genome[5:15])]
    t = spark.createDataFrame(items, "tag_id long, tag string")
    whole = spark.createDataFrame([(7, genome)], "contig_id long, bases string")
    chunks = spark.createDataFrame([(7, a, genome[a : a + 100 + 39]) for a in range(0, 900, 100)], "contig_id long, chunk_start long, bases string")
    want = sorted((i, m, "+") for i, g in items if len(g) >= 24 for m in range(900) if genome.startswith(g, m)) + sorted((i, m, "-") for i, g in items if len(g) >= 24 for m in range(900) if genome.startswith(flip(g), m))
    for c in (whole, chunks):
        assert sorted((r["tag_id"], r["start"], r["strand"]) for r in tags.exact_hits(t, c).collect()) == sorted(want)


def test_cigar_walk(spark):
    # 49-base tag, focal base 20, placed after ten others.
    cases = [("49M", 31, 0, None), ("5M1I43M", 30, 1, 15), ("5M1D44M", 32, 1, 15), ("19M1D30M", 32, 1, 1), ("20M1D29M", 32, 1, 0), ("21M1D28M", 31, 1, 0), ("30S19M", None, 0, None)]
    df = spark.createDataFrame([(c,) for c, *_ in cases], "cigar string").withColumn("w", tags.cigar_walk(F.col("cigar"), F.lit(11), F.lit(20)))
    for r, (_, focal, gaps, near) in zip(df.collect(), cases):
        assert (r["w"]["focal_position"], r["w"]["gap_bases"], r["w"]["focal_gap_distance"]) == (focal, gaps, near)


def test_scalars(spark):
    row = spark.createDataFrame([(" 1,234 ", "1.5", "123.F.0.5", "aroma _R", "chr03", "ID=a%20b;x=1+1;ID=c", "acgt n")], "a string, b string, c string, d string, e string, f string, g string").select(
        S.integer(F.col("a")).alias("a"), S.integer(F.col("b")).alias("b"), S.canonical_marker(F.col("c")).alias("c"), S.lexical_trait(F.col("d")).alias("d"), S.chromosome(F.col("e")).alias("e"),
        S.gff_attributes(F.col("f")).alias("f"), S.dna(F.col("g")).alias("g"), S.reverse_complement(F.lit("AACG")).alias("h"), S.scalar_comparison(F.lit(15.0), F.lit(0.15)).alias("i"),
        S.boundary_rotation([F.lit(2), F.lit(90), F.lit(110)], [F.lit(90), F.lit(110), F.lit(2)]).alias("j"), S.positional_models(F.lit(100), F.lit(2), F.lit(5)).alias("k"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"], row["g"], row["h"], row["i"], row["j"]) == (1234, None, "123|F|0--5", "aroma_R", "3", None, "CGTT", "scale_factor_100", "120")
    assert row["f"] == {"ID": "c", "x": "1+1"} and row["k"][2]["start"] == 98


def test_numbered_rows_are_gapless_in_order(spark):
    from loomgene.operators.identity import numbered

    rows = [(k * 37 % 101, None if k % 9 == 0 else f"x{k % 5}", k) for k in range(400)] + [(7, "hot", k) for k in range(400, 700)]
    df = spark.createDataFrame(rows, "a int, b string, k int").repartition(7)
    found = {r["k"]: r["row"] for r in numbered(df, ["a", "b", "k"], pieces=20).collect()}
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    assert [found[r[2]] for r in want] == list(range(1, 701))
    assert numbered(df.limit(0), ["a"]).collect() == []


def test_identifier_spellings(spark):
    cases = {
        "chromosome": [("1.0", "1"), ("chr-3", "3"), ("Tc_chr1_v2", "1"), ("Chromosome 07", "7"), ("NC_030850.1", "NC_030850.1"), ("chr3x", "chr3x"), ("x", "x"), ("", ""), ("007", "7"), ("0", "0"), ("1.5", "1.5"), ("machr1", "machr1")],
        "marker": [("12.f.0.22", "12|F|0--22"), ("12|r|0--5", "12|R|0--5"), ("9.Z.0.1", "9.Z.0.1"), ("9.F.0.1", "9|F|0--1"), ("9|F|0.1", "9|F|0.1"), ("9.F.0--1", "9.F.0--1"), (" 3.R.1.2 ", "3|R|1--2")],
        "integer": [("3.0000001", None), ("3.0", 3), ("1,234", 1234), ("1e3", 1000), ("1d", None), ("x", None), ("-7", -7), ("", None), ("1e30", None)],
    }
    call = {"chromosome": S.chromosome, "marker": S.canonical_marker, "integer": S.integer}
    for name, pairs in cases.items():
        rows = spark.createDataFrame([(a,) for a, _ in pairs], "a string").select(call[name](F.col("a")).alias("b")).collect()
        assert [r["b"] for r in rows] == [b for _, b in pairs], name


def test_allele_decisions_by_first_alignment_and_all_competitors(spark):
    ok, many = "ELIGIBLE_PLACEMENT", "TOO_MANY_NONFOCAL_EDITS"
    rows = [
        ("a", "R", "1:+:5", 0, many, None, 20, 30, "10M", "A", "G", 5), ("a", "R", "1:+:5", 0, ok, None, 10, 30, "10M", "A", "G", 5),  # the first by start counts
        ("b", "R", "1:+:5", 0, ok, None, 10, 30, "10M", "A", "G", 5), ("b", "R", "2:+:5", 0, ok, -3, 10, 30, "10M", "A", "G", 5),  # two best loci
        ("c", "R", "1:+:5", 0, ok, -3, 12, 30, "10M", "A", "G", 5), ("c", "R", "1:+:5", 0, ok, None, 11, 30, "10M", "A", "G", 5),  # xs of another best alignment
        ("d", "R", "1:+:5", 0, ok, None, 10, 30, "10M", "A", "G", 5), ("d", "R", "1:+:5", 0, ok, None, 10, 31, "10M", "A", "C", 5), ("d", "R", "3:+:5", -9, ok, None, 1, 2, "10M", "A", "C", 5),
        ("e", "R", "1:+:5", -28, ok, None, 10, 30, "10M", "A", "G", 5),
    ]
    hits = spark.createDataFrame(rows, "tag_id string, allele string, locus string, score long, reason string, xs long, start long, end long, cigar string, base string, other_base string, snp long")
    expected = spark.createDataFrame([(t, "R") for t in "abcdef"], "tag_id string, allele string")
    got = {r["tag_id"]: (r["status"], r["n_hits"], r["next_score"]) for r in tags.allele_decisions(hits, expected=expected).collect()}
    assert got == {
        "a": ("RETAINED_BOUNDED_SEARCH", 2, None), "b": ("INSUFFICIENT_SCORE_SEPARATION", 2, 0), "c": ("INSUFFICIENT_SCORE_SEPARATION", 2, -3),
        "d": ("TIED_CIGAR_FOCAL_CONFLICT", 3, -9), "e": ("SEARCH_THRESHOLD_MARGIN_INSUFFICIENT", 1, None), "f": ("UNMAPPED", 0, None),
    }


def test_sam_placements_hold_against_tag_and_reference(spark):
    contig = "ACGTACGGTTCAAGCTTGCAATCGGATCCTAGCATGCCATTG"
    tag = contig[10:30]  # variant at place 8: the reference has contig[18]
    alt = tag[:8] + "A" + tag[9:]
    flip = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    wrong = tag[:2] + ("A" if tag[2] != "A" else "C") + tag[3:]
    tags_ = [("t", tag, alt, 8), ("w", wrong, wrong[:8] + "A" + wrong[9:], 8), ("d", tag[:12] + tag[13:], alt[:12] + alt[13:], 8), ("z", tag[:8] + "T" + tag[9:], tag[:8] + "A" + tag[9:], 8), ("f", flip(tag), flip(alt), 11), ("n", "ACGTN" * 4, "ACGTN" * 4, 2)]
    rows = [
        ("t", "R", 0, "c", 11, "20M", "*", 0, 0, None, None, "ELIGIBLE_PLACEMENT", 0, 19), ("t", "A", 0, "c", 11, "20M", alt, -6, 1, None, None, "ELIGIBLE_PLACEMENT", 0, 19),
        ("w", "R", 0, "c", 11, "20M", "*", -6, 1, -9, None, "ELIGIBLE_PLACEMENT", 1, 19), ("d", "R", 0, "c", 11, "12M1D7M", "*", -8, 1, None, None, "GAP_NEAR_FOCAL_SNP", 1, 19),
        ("z", "R", 0, "c", 11, "20M", "*", -6, 1, None, None, "REFERENCE_ALLELE_UNSUPPORTED", 0, 19), ("f", "R", 16, "c", 11, "20M", tag, 0, 0, None, None, "ELIGIBLE_PLACEMENT", 0, 19),
        ("t", "R", 0, "c", 11, "20M", "*", 0, 1, None, "EDIT_COUNT_DISAGREES", None, 0, 19), ("t", "R", 0, "c", 11, "20M", "*", -6, 0, None, "SCORE_DISAGREES", None, 0, 19),
        ("t", "R", 1, "c", 11, "20M", "*", 0, 0, None, "PAIRED_OR_SUPPLEMENTARY", None, None, None), ("t", "R", 0, "c", 11, "19M", "*", 0, 0, None, "CIGAR_LENGTH_DIFFERS", None, None, None),
        ("t", "R", 0, "c", 11, "20M1", "*", 0, 0, None, "INVALID_CIGAR", None, None, None), ("t", "R", 0, "c", 30, "20M", "*", 0, 0, None, "OUTSIDE_REFERENCE", None, None, None),
        ("t", "R", 0, "c", 11, "20M", alt, 0, 0, None, "SEQUENCE_DIFFERS_FROM_TAG", None, None, None), ("q", "R", 0, "c", 11, "20M", "*", 0, 0, None, "UNKNOWN_TAG", None, None, None),
        ("t", "R", 0, "c", 11, "20M", "*", None, 0, None, "MISSING_SCORE_OR_EDITS", None, None, None), ("t", "R", 0, "c", 16, "5S15M", "*", 0, 0, None, None, "NOT_FULL_END_TO_END", None, 19),
    ]
    names = "tag_id string, allele string, flag int, rname string, pos long, cigar string, seq string, score long, nm long, xs long, n int"
    sam = spark.createDataFrame([(*r[:10], k) for k, r in enumerate(rows)] + [("t", "A", 4, "*", 0, "*", "*", None, None, None, 99)], names)
    defs = spark.createDataFrame(tags_, "tag_id string, ref string, alt string, snp0 int")
    contigs = spark.createDataFrame([("c", contig)], "contig_id string, bases string")
    out = tags.sam_placements(sam, defs, contigs, size=16, overlap=32).collect()
    assert len(out) == len(rows)
    for _, _, _, _, pos, cigar, seq, score, nm, _, error, reason, edits, snp in rows:
        assert any((r["start"], r["cigar"], r["score"], r["nm"], r["error"], r["reason"]) == (pos, cigar, score, nm, error, reason) and (edits is None or r["nonfocal_edits"] == edits) and (snp is None or r["snp"] == snp) for r in out), (cigar, error, reason)
    with pytest.raises(Exception, match="alignment of"):
        tags.checked_placements(tags.sam_placements(sam, defs, contigs, size=16, overlap=32)).collect()


def test_nearest_each_equals_nearest_per_label(spark):
    rng = random.Random(9)
    spans = [(i, rng.choice("12"), s := rng.randrange(500), s + rng.randrange(40)) for i in range(150)]
    points = [(rng.choice("12"), rng.randrange(500), rng.randrange(3)) for _ in range(25)] + [("2", 7, 3)]
    q = spark.createDataFrame(spans, "id int, chromosome string, start long, end long")
    p = spark.createDataFrame(points, "chromosome string, pos long, label int")
    got = {r["id"]: r["distances"] for r in nearest_each(q, p, ["chromosome"], F.col("label"), 4, bucket=32).collect()}
    for i, c, s, e in spans:
        want = [min((max(x - e, s - x, 0) for d, x, k in points if d == c and k == label), default=None) for label in range(4)]
        assert got[i] == want


def test_overlaps_of_any_length_equal_brute_force(spark):
    rng = random.Random(10)
    span = lambda: (s := rng.randrange(20_000), s + rng.choice([0, 3, 40, 900, 5_000, 15_000]))
    a = [(i, rng.choice("12"), *span()) for i in range(120)] + [(999, "1", 10, 5)]
    b = [(i, rng.choice("12"), *span()) for i in range(120)]
    got = overlap_pairs(spark.createDataFrame(a, "i int, c string, s long, e long"), spark.createDataFrame(b, "j int, c string, s2 long, e2 long"), "c", ("s", "e"), ("s2", "e2"), width=64)
    found = sorted((r["i"], r["j"]) for r in got.collect())
    assert found == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= x[3] and max(x[2], y[2]) <= min(x[3], y[3]))
