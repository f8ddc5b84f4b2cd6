"""Study scans, verification of results, and the adjusted models against their formulas."""

import numpy as np
import pytest

from loomgene.operators import adjusted, checks, verification
from loomgene.sources import sinks, studies
from loomgene.sources.workbook import read_workbook


def book(spark, path, sheets):
    sinks.write_workbook(str(path), {name: spark.createDataFrame(rows, schema) for name, (rows, schema) in sheets.items()})
    return str(path)


def test_diversity_scan(spark, tmp_path):
    markers = [("12.f.0.22", "r.1", "chr-3", "1,234", "ACG", "TT", "A > G"), ("m2", "r.2", "NC_1.2", "x", "ACN", "T", "A>G"), ("", "r.1", "1", "5", "A", "C", "A>C"), ("m4", "none", "1.0", "7.0", "GG", "", "C>T")]
    names = [("r.1", "acgatt", "x"), ("r.2", "ACGT", "y"), ("r.2", "ACGA", "z"), ("", "A", "")]
    path = book(spark, tmp_path / "d.xlsx", {
        "markers": (markers, "`SNP marker name` string, `reference sequence name` string, chromosome string, `snp position` string, `5flank_sequence` string, `3flank_sequence` string, variation string"),
        "refs": (names, "`reference sequence name` string, Sequence string, `accession number` string"),
    })
    found = studies.diversity_markers(read_workbook(spark, path, ["SNP marker name"], sheet="markers"))
    references = studies.reference_sequences(read_workbook(spark, path, ["reference sequence name"], sheet="refs"))
    assert {(r["reference_key"], r["copies"]) for r in references.collect()} == {("r.1", 1), ("r.2", 2)}
    got = {r["marker_id"]: r for r in studies.marker_evidence(found, references).collect()}
    assert set(got) == {"12.f.0.22", "m2", "m4"} and got["12.f.0.22"]["marker_key"] == "12|F|0--22"
    assert (got["12.f.0.22"]["chromosome"], got["12.f.0.22"]["position_bp"], got["m2"]["position_bp"], got["m4"]["position_bp"]) == ("3", 1234, None, 7)
    assert [got[m]["ref_lookup_status"] for m in ("12.f.0.22", "m2", "m4")] == ["exact_ref_tag", "duplicate_reference_name", "missing_reference_name"]


def test_candidate_scan(spark, tmp_path):
    rows = [("g1", "1", 5, 9, "b", "x", ""), ("g1", "chr1", 5, 9, "a", "", "maybe"), ("g2", "1", 5, 9, "c", "no", "1"), ("g2", "1", 6, 9, "c", "", ""), ("g3", "Z", 5, 9, "", "", ""), ("", "1", 1, 2, "", "", ""), ("g4", "2", 8, 8, "", "0", "TRUE")]
    path = book(spark, tmp_path / "c.xlsx", {"c": (rows, "gene_id string, Chromosome string, start long, end long, gene_function string, p1 string, p2 string")})
    out = studies.candidate_genes(read_workbook(spark, path, ["gene_id", "start", "end"]), ["1", "2"], {"sugar": "p1", "acid": "p2"})
    unique = {r["gene_id"]: r for r in out["unique_genes"].collect()}
    assert set(unique) == {"g1", "g4"} and unique["g1"]["gene_function"] == "a; b" and unique["g1"]["record_count"] == 2
    assert unique["g1"]["sugar"] and not unique["g1"]["acid"] and unique["g4"]["pathways"] == "acid" and unique["g4"]["start_bp"] == 8
    assert {tuple(r) for r in out["memberships"].collect()} == {("g1", "sugar"), ("g4", "acid")}
    assert {r["gene_id"] for r in out["coordinate_conflicts"].collect()} == {"g2", "g3"} and out["raw_records"].count() == 6
    assert [(r["gene_id"], r["pathway"], r["source_flag"]) for r in out["qualifier_annotations"].collect()] == [("g1", "acid", "maybe")]


def test_raw_association_scan(spark, tmp_path):
    rows = [("1", "100", "F1", "mlm", "NA"), ("1", "100", "mlm", "F1", "t"), ("11", "5", "m", "F1", "t"), ("2", "-5", "m", "F1", "t"), ("2", "7", "m", "F2", "")]
    path = book(spark, tmp_path / "a.xlsx", {"s": (rows, "Chromosome string, `Position of the association peak (bp)` string, `GWAS method` string, `Sorting of marker` string, Traits string")})
    parsed, rejected = studies.raw_associations(read_workbook(spark, path, ["Chromosome", "Traits"]), [str(i) for i in range(1, 11)], ["F1", "F2"])
    got = parsed.orderBy("source_row").collect()
    assert [(r["trait"], r["provisional_filter_candidate"]) for r in got] == [("NA", "F1"), ("t", "")] and rejected.count() == 3 and '"NA"' in got[0]["raw_record_json"]
    points = spark.createDataFrame([("10", 1), ("2", 9), ("2", 3), ("x", 0)], "chromosome string, position long")
    assert [tuple(r) for r in points.orderBy(*studies.point_order()).collect()] == [("2", 3), ("2", 9), ("10", 1), ("x", 0)]


def test_results_are_verified_cell_by_cell(spark, tmp_path):
    schema = "id long, value double, label string"
    base = [(i, i / 7, f"x{i}") for i in range(50)]
    def rows(name, data, cols=schema):  # noqa: E306
        return read_workbook(spark, book(spark, tmp_path / f"{name}.xlsx", {"s": (data, cols)}), ["id"])

    want = rows("want", base)
    assert verification.verify_results({"w": (rows("same", [(i, v + 1e-14, t) for i, v, t in base]), want)})[0]["status"] == "PASS"
    wrong = [(i, v + (1e-3 if i == 7 else 0), "y" if i == 9 else t) for i, v, t in base[:49]]
    summary, sheets = verification.verify_results({"w": (rows("wrong", wrong), want)})
    assert summary["status"] == "FAIL" and summary["mismatched_cells"] == 5 and sheets.first()["maximum_numeric_difference"] == pytest.approx(1e-3)
    renamed = rows("renamed", base, "id long, amount double, label string")
    with pytest.raises(checks.CheckFailed):
        verification.compare_workbooks(renamed, want)
    assert verification.verify_results({"w": (renamed, want)}, renamed={"amount": "value"})[0]["status"] == "PASS"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text("1")
    sinks.manifest(str(tmp_path / "m"))
    assert verification.safe_manifest(str(tmp_path / "m")) == ["a.txt"]
    (tmp_path / "m" / "a.txt").write_text("2")
    with pytest.raises(checks.CheckFailed):
        verification.safe_manifest(str(tmp_path / "m"))


def test_adjusted_models_equal_generalised_least_squares(spark):
    """Squared correlation of residuals under P = V^-1 - V^-1 X (X' V^-1 X)^-1 X' V^-1, for all six models."""
    rng = np.random.default_rng(7)
    n, rows = 24, []
    for c in "123":
        for k in range(30):
            x = rng.integers(0, 3, n)
            rows.append((100 * int(c) + k, c, k, [int(v) for v in x]))
    df = spark.createDataFrame(rows, "marker long, chromosome string, position long, dosage array<int>")
    models = adjusted.held_out_models([r.asDict() for r in adjusted.gram_sums(df).collect()])
    units = {(r["marker"], r["model"]): np.array(r["unit"]) for r in adjusted.unit_vectors(df, models).collect() if r["unit"] is not None}
    for c in "13":
        x = np.array([r[3] for r in rows if r[1] != c], float)
        p = x.mean(axis=1, keepdims=True) / 2
        kernel = (x - 2 * p).T @ (x - 2 * p) / (2 * p * (1 - p)).sum()
        kernel *= n / np.trace(kernel)
        z = (x - 2 * p) / np.sqrt(2 * p * (1 - p))
        axes = np.linalg.svd(z, full_matrices=False)[2]
        for model in adjusted.MODELS:
            nuisance = np.c_[np.ones(n), axes[: int(model[-1])].T] if "PC" in model else np.ones((n, 1))
            v = np.eye(n) if not model.startswith("V") else kernel + adjusted.RIDGES["V_RIDGE" if model == "V_RIDGE" else "V"] * np.eye(n) + np.ones((n, n)) / n
            inv = np.linalg.inv(v)
            proj = inv - inv @ nuisance @ np.linalg.inv(nuisance.T @ inv @ nuisance) @ nuisance.T @ inv
            own = [(r[0], np.array(r[3], float)) for r in rows if r[1] == c][:6]
            for i, a in own:
                for j, b in own:
                    want = (a @ proj @ b) ** 2 / ((a @ proj @ a) * (b @ proj @ b))
                    assert (units[i, model] @ units[j, model]) ** 2 == pytest.approx(want, abs=1e-6), (c, model)


def test_projections_fail_on_bad_matrices():
    good = {"kernel": np.eye(6), "axes": np.linalg.qr(np.random.default_rng(1).normal(size=(6, 5)))[0]}
    assert adjusted.projection(good, "PC2").shape == (6, 6)
    twin = dict(good, axes=np.repeat(good["axes"][:, :1], 5, axis=1))
    for model, name in ((twin, "PC2"), (dict(good, kernel=-np.eye(6)), "V"), (dict(good, kernel=np.full((6, 6), np.nan)), "V"), (good, "PC5")):
        with pytest.raises(ValueError):
            adjusted.projection(model, name)
