import gzip
import struct

import pytest
from pyspark.sql import functions as F

from loomgene.sources import sinks
from loomgene.sources.biff import biff_sheets
from loomgene.sources.genomics import contigs, read_fasta, read_gff, read_sam
from loomgene.sources.workbook import field, genotype_matrix, key, read_workbook


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a<b", 1, 2.5, True), (None, 2, None, False)], "`Márker_ID` string, n long, x double, ok boolean")
    path = str(tmp_path / "book.xlsx")
    sinks.write_workbook(path, {"data": df, "other": df.select("n")}, ["made here"])
    rows = read_workbook(spark, path, ["marker id", "N"], "data").orderBy("source_row").collect()
    assert [r["source_row"] for r in rows] == [2, 3] and rows[0]["cells"] == {"markerid": "a<b", "n": "1", "x": "2.5", "ok": "true"} and "x" not in rows[1]["cells"]
    assert read_workbook(spark, path, ["n"]).count() == 4 and key("Position of the péak (bp)") == "positionofthepeakbp"
    assert read_workbook(spark, path, ["n"], "data").select(field("nope", "Marker-ID").alias("m")).filter("m IS NOT NULL").count() == 1
    with pytest.raises(FileExistsError):
        sinks.write_workbook(path, {"data": df})
    with pytest.raises(Exception, match="no header row"):
        read_workbook(spark, path, ["missing"], "data").count()
    wide = genotype_matrix(read_workbook(spark, path, ["n"], "data"), ["n"], ["x", "ok"])
    assert wide.orderBy("n").first()["symbols"] == ["2.5", "TRUE"]


def tiny_biff():
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    words = ["id", "value", "näme"]
    sst = struct.pack("<II", 3, 3) + b"".join(struct.pack("<HB", len(w), 1) + w.encode("utf-16-le") for w in words)
    sheet = record(0x809, b"\0" * 16) + b"".join(record(0xFD, struct.pack("<HHHI", 0, c, 0, c)) for c in range(2)) + record(0xFD, struct.pack("<HHHI", 1, 0, 0, 2)) + record(0x203, struct.pack("<HHHd", 1, 1, 0, 1.25)) + record(0x27E, struct.pack("<HHHI", 2, 1, 0, (7 << 2) | 2)) + record(0x205, struct.pack("<HHHBB", 2, 0, 0, 42, 1)) + record(0x0A, b"")
    bound = lambda at: record(0x85, struct.pack("<IHBB", at, 0, 1, 0) + b"S")
    head = record(0x809, b"\0" * 16)
    at = len(head) + len(bound(0)) + len(record(0xFC, sst)) + 4
    stream = head + bound(at) + record(0xFC, sst) + record(0x0A, b"") + sheet
    stream += b"\0" * (4608 - len(stream))
    entry = lambda name, kind, first, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind)).ljust(116, b"\0") + struct.pack("<IQ", first, size)
    n = len(stream) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, n + 2), 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return header.ljust(512, b"\0") + struct.pack("<128I", *fat) + (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream))).ljust(512, b"\0") + stream


def test_legacy_workbook(spark, tmp_path):
    [(name, rows)] = biff_sheets(tiny_biff())
    assert name == "S" and rows == [(1, ["id", "value"], []), (2, ["näme", 1.25], []), (3, ["#N/A", 7], ["0=#N/A"])]
    (tmp_path / "old.xls").write_bytes(tiny_biff())
    assert read_workbook(spark, str(tmp_path / "old.xls"), ["ID"], "S").orderBy("source_row").first()["cells"] == {"id": "näme", "value": "1.25"}


def test_sequence_scans(spark, tmp_path):
    (tmp_path / "g.fa.gz").write_bytes(gzip.compress(b">c1 first\nACGTAC\nGTNN\n>c2\nTTT\n"))
    got = {(r["contig_id"], r["chunk_start"]): r["bases"] for r in read_fasta(spark, str(tmp_path / "g.fa.gz"), overlap=2, chunk=4).collect()}
    assert got == {("c1", 0): "ACGTAC", ("c1", 4): "ACGTNN", ("c2", 0): "TTT"}
    for bad in (b">a\nAC\n>a\nAC\n", b">a\n\n", b">a\nAC!\n"):
        with pytest.raises(ValueError):
            list(contigs(bad))
    (tmp_path / "a.gff").write_text("##gff\nc1\ts\tgene\t1\t5\t.\t+\t.\tID=g1;Name=x%2By;biotype=pc\nc1\ts\tmRNA\t1\t5\t.\t+\t.\tID=m\nc1\ts\tgene\t4\t50\t.\t+\t.\tID=g2\nbroken\nc9\ts\tgene\t1\t2\t.\t+\t.\tID=g3\n##FASTA\n>c1\nAC\n")
    genes, bad = read_gff(spark, str(tmp_path / "a.gff"), spark.createDataFrame([("c1", 10)], "seqid string, length long"))
    assert [(r["gene_id"], r["name"], r["biotype"]) for r in genes.collect()] == [("g1", "x+y", "pc")]
    assert sorted(r["reason"] for r in bad.collect()) == ["FIELD_COUNT", "OUT_OF_BOUNDS", "UNKNOWN_SEQUENCE"]
    line = "{}\t0\tc1\t{}\t9\t5M\t*\t0\t0\tACGTA\t*\tAS:i:-3\tNM:i:1"
    (tmp_path / "x.sam").write_text("@HD\n" + "\n".join(line.format(q, i) for i, q in enumerate(["a", "a", "b", "a"], 1)) + "\tXS:i:-6\n")
    rows = read_sam(spark, str(tmp_path / "x.sam")).orderBy("pos").collect()
    assert [r["contiguous"] for r in rows] == [False, False, True, False] and rows[0]["score"] == -3 and [r["xs"] for r in rows] == [None, None, None, -6]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], "AC", "AT")], "tag_id string, l array<int>, ref_tag string, alt_tag string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()["l"] == "[1,2]"
    sinks.write_fasta(df, str(tmp_path / "fa"))
    assert spark.read.text(str(tmp_path / "fa")).count() == 4
    parts = sinks.split_pairs(spark.range(10).withColumn("r", F.lit("x")), ["id"], "r", 4)
    assert [r["count"] for r in parts.groupBy("part").count().orderBy("part").collect()] == [4, 4, 2]
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "a").write_text("1")
    assert list(sinks.manifest(str(folder))) == ["a"] and sinks.verify_manifest(str(folder)) == []
    (folder / "a").write_text("2")
    assert sinks.verify_manifest(str(folder)) == ["a"]


def test_workbooks_are_whole_or_absent(spark, tmp_path):
    path = tmp_path / "x.xlsx"
    with pytest.raises(ValueError, match="control character"):
        sinks.write_workbook(str(path), {"a": spark.createDataFrame([("fine",), ("bad\x01",)], "t string").coalesce(1)})
    assert not list(tmp_path.iterdir())
    sinks.write_workbook(str(path), {"a": spark.createDataFrame([("line\nand\ttab",)], "t string")})
    with pytest.raises(FileExistsError):
        sinks.write_workbook(str(path), {})
    assert [p.name for p in tmp_path.iterdir()] == ["x.xlsx"]
