import json

import pytest

from loomgene.operators import checks
from loomgene.plans import study
from loomgene.sources import sinks


def test_study_end_to_end(spark, tmp_path):
    markers = [(f"m{i}", "I" if i < 12 else "2", 100 * i + 50, f"k{i}") for i in range(24)] + [("m1", "1", 9, "k1"), ("far", "1", 10**9, "kx")]
    sinks.write_workbook(str(tmp_path / "m.xlsx"), {"m": spark.createDataFrame(markers, "`marker_id` string, chrom string, pos long, `tag key` string")})
    events = [("1", 350, "aroma _R", 0.1), ("1", 350, "aroma_R", 0.2), ("2", 1512, "other", 0.3), ("2", None, "gone", 0.3)]
    sinks.write_workbook(str(tmp_path / "a.xlsx"), {"master": spark.createDataFrame(events, "chromosome string, position long, traits string, `p value` double")})
    (tmp_path / "g.gff").write_text("".join(f"{c}\ts\tgene\t{100 * i + 1}\t{100 * i + 40 + 20 * (i % 2)}\t.\t+\t.\tID=g{c}{i};biotype=pc\n" for c in "12" for i in range(1, 24)) + "1\ts\tgene\t5\t2\t.\t+\t.\tID=bad\n")
    line = "{}\t0\t{}\t{}\t42\t49M\t*\t0\t0\tA\t*\tAS:i:0\tNM:i:0\n"
    (tmp_path / "x.sam").write_text("@HD\n" + "".join(line.format(f"k{i}|{a}", 1 if i < 12 else 2, 100 * i + 40) for i in range(24) if i % 3 for a in ("ref", "alt")))
    config = {"windows": [0, 10, 100], "seed": 1729, "replicates": 3, "lengths": {"1": 3000, "2": 3000}, "aliases": {"I": "1"}, "focal_index": 20, "length_unit": 1000}
    sources = {"markers": str(tmp_path / "m.xlsx"), "associations": str(tmp_path / "a.xlsx"), "genes": str(tmp_path / "g.gff"), "alignments": str(tmp_path / "x.sam")}
    t = study.run(spark, sources, config, str(tmp_path / "out"))
    assert t["ledger"].count() == 26 and t["ledger"].filter("in_a").count() == 23 and t["ledger"].filter("in_c").count() == 15
    assert t["ledger"].filter("canonical_id = 'm4'").first()["ref_position"] == 460
    assert t["events"].filter("trait = 'aroma_R'").first()["occurrences"] == 2 and t["rejected_genes"].count() == 1
    c = {(r["arm"], r["query_set"], r["flank_bp"]): r["n_recovered"] for r in t["coverage"].collect()}
    assert c["A", "peaks", 0] == 1 and c["A", "peaks", 100] == 2 and all(c["B", s, w] <= c["A", s, w] for _, s, w in c)
    assert t["background"].count() == 9 and t["checks"].filter("status = 'PASS'").count() == 3
    assert json.loads(spark.read.text(str(tmp_path / "out" / "summary")).first()["value"])["status"] == "COMPLETED"
    with pytest.raises(checks.CheckFailed):
        study.run(spark, sources, {**config, "more": 1}, str(tmp_path / "two"))


def test_checks(spark, tmp_path):
    ledger = checks.Ledger()
    assert ledger.add("a", 1.0, 1.0 + 1e-13, 1e-12) and not ledger.add("b", 1, 2) and ledger.status == "CHECK_FAILED" and ledger.table(spark).count() == 2
    with pytest.raises(checks.CheckFailed):
        checks.assert_at_most(spark.range(11), 10, "x")
    assert checks.assert_at_most(spark.range(10), 10, "x").count() == 10 and checks.assert_rows(spark.range(3), 3, "x").count() == 3
    with pytest.raises(checks.CheckFailed):
        checks.validated_aliases([{"source": "a", "target": "b", "reason": "r"}, {"source": "b", "target": "c", "reason": "r"}], set())
    assert checks.validated_aliases([{"source": "a", "target": "b", "reason": "r"}], {"z"}) == {"a": "b"}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "Data.XLSX").write_text("1")
    assert checks.locate(str(tmp_path), "data.xlsx").name == "Data.XLSX" and checks.locate(str(tmp_path), "none", optional=True) is None
    calls = []
    make = lambda: calls.append(1) or spark.range(4)
    for _ in range(2):
        assert checks.cached(spark, str(tmp_path / "cache"), {"a": 1}, make).count() == 4
    assert len(calls) == 1


def test_placements_against_tags_and_reference(spark, tmp_path):
    """A variant that the second allele's tag carries is no edit; an allele that the reference lacks isn't supported."""
    import random

    from loomgene.sources.genomics import read_fasta, read_sam

    rng = random.Random(1)
    contig = "".join(rng.choice("ACGT") for _ in range(150_000))
    (tmp_path / "r.fa").write_text(">1 first\n" + "\n".join(contig[i : i + 80] for i in range(0, len(contig), 80)) + "\n>2\nACGT\n")
    other = lambda c, k=1: "ACGT"[("ACGT".index(c) + k) % 4]
    defs, lines = [], []
    for k, at in enumerate((10, 65_500, 65_530, 131_060, 140_000)):
        ref = contig[at : at + 40]
        if k == 4:  # neither allele is the reference's
            ref = ref[:20] + other(ref[20], 2) + ref[21:]
        alt = ref[:20] + other(contig[at + 20]) + ref[21:]
        for _ in range(3):  # edits elsewhere, on both tags
            p = rng.choice([x for x in range(40) if abs(x - 20) > 4])
            if k == 3 and ref[p] == contig[at + p]:
                ref, alt = (t[:p] + other(t[p]) + t[p + 1 :] for t in (ref, alt))
        defs.append((f"k{k}", ref, alt, 20))
        for name, t in (("ref", ref), ("alt", alt)):
            nm = sum(a != b for a, b in zip(t, contig[at : at + 40]))
            lines.append(f"k{k}|{name}\t0\t1\t{at + 1}\t42\t40M\t*\t0\t0\t{t}\t*\tAS:i:{-6 * nm}\tNM:i:{nm}\n")
    lines.append("k9|ref\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n")
    (tmp_path / "x.sam").write_text("@HD\n" + "".join(lines))
    cfg = study.Config([0], 1, 1, {"1": 150_000}, {}, 20, 100)
    tags = spark.createDataFrame(defs, "tag_id string, ref string, alt string, snp0 int")
    contigs = read_fasta(spark, str(tmp_path / "r.fa"), overlap=512, chunk=study.REFERENCE_CHUNK, tails=True)
    got = {r["key"]: (r["status"], r["ref_position"]) for r in study.placements(read_sam(spark, str(tmp_path / "x.sam")), cfg, tags, contigs).collect()}
    for k, at in ((0, 10), (1, 65_500), (2, 65_530)):
        assert got[f"k{k}"] == ("RETAINED_PRIMARY_CHROMOSOME", at + 21)
    assert got["k4"][0] == got["k9"][0] == "BOTH_ALLELES_REQUIRED"
    assert got["k3"][0] in ("RETAINED_PRIMARY_CHROMOSOME", "BOTH_ALLELES_REQUIRED")
    (tmp_path / "y.sam").write_text(lines[0].replace("NM:i:0", "NM:i:1"))
    with pytest.raises(Exception, match="EDIT_COUNT_DISAGREES"):
        study.placements(read_sam(spark, str(tmp_path / "y.sam")), cfg, tags, contigs).collect()
