"""Sequence, annotation and alignment scans."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgene.functions.scalars import gff_attributes


def contigs(data: bytes, limit: int = 1 << 31) -> Iterator[tuple[str, str]]:
    """(name, bases in upper case); repeated, empty, invalid and oversize contigs are errors."""
    text = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    seen: set[str] = set()
    for entry in text.decode("utf-8-sig").split(">")[1:]:
        head, _, body = entry.partition("\n")
        name = head.split()[0] if head.split() else ""
        bases = "".join(body.split()).upper()
        if not name or name in seen:
            raise ValueError(f"unnamed or repeated contig {name!r}")
        if not bases or len(bases) > limit or bases.strip("ACGTURYSWKMBDHVN-"):
            raise ValueError(f"empty, oversize or invalid contig {name!r}")
        seen.add(name)
        yield name, bases


def read_fasta(spark: SparkSession, path: str, overlap: int = 255, chunk: int = 1 << 20, tails: bool = False) -> DataFrame:
    """(contig_id, chunk_start, bases): chunks that share ``overlap`` letters with the next, for tags of at most that plus one.

    With ``tails`` also a last chunk that lies in the overlap of the one before, so that each letter has the chunk of its own place.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for name, bases in contigs(data.as_py()):
                    for a in range(0, len(bases) if tails else max(1, len(bases) - overlap), chunk):
                        yield pa.RecordBatch.from_pydict({"contig_id": [name], "chunk_start": pa.array([a], pa.int64()), "bases": [bases[a : a + chunk + overlap]]})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "contig_id string, chunk_start long, bases string")


def read_gff(spark: SparkSession, path: str, lengths: DataFrame, feature: str = "gene") -> tuple[DataFrame, DataFrame]:
    """(genes, rejected lines). ``lengths``: seqid, length. Everything behind ##FASTA is ignored; each file must be one partition's text."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.element_at(F.split("value", "(?m)^##FASTA"), 1), "\r?\n").alias("lines"))
    rows = lines.select("file", F.posexplode("lines").alias("n", "line")).filter("line <> '' AND NOT startswith(line, '#')").withColumn("f", F.split("line", "\t"))
    wanted = rows.filter((F.size("f") != 9) | (F.try_element_at("f", F.lit(3)) == feature))
    at = lambda i: F.try_element_at("f", F.lit(i))
    parsed = wanted.select("file", (F.col("n") + 1).alias("line_number"), "line", F.size("f").alias("n_fields"), at(1).alias("seqid"), at(4).try_cast("long").alias("start_bp"), at(5).try_cast("long").alias("end_bp"), at(7).alias("strand"), gff_attributes(at(9)).alias("attributes"))
    parsed = parsed.join(lengths, "seqid", "left")
    reason = (
        F.when(F.col("n_fields") != 9, "FIELD_COUNT").when(F.col("length").isNull(), "UNKNOWN_SEQUENCE").when(F.col("start_bp").isNull() | F.col("end_bp").isNull(), "BAD_COORDINATE")
        .when((F.col("start_bp") < 1) | (F.col("start_bp") > F.col("end_bp")) | (F.col("end_bp") > F.col("length")), "OUT_OF_BOUNDS").when(~F.col("strand").isin("+", "-", ".", "?"), "BAD_STRAND")
        .when(F.try_element_at("attributes", F.lit("ID")).isNull(), "NO_ID")
    )
    judged = parsed.withColumn("reason", reason)
    genes = judged.filter("reason IS NULL").select(F.col("attributes")["ID"].alias("gene_id"), "seqid", "start_bp", "end_bp", "strand", F.coalesce(F.try_element_at("attributes", F.lit("biotype")), F.lit("")).alias("biotype"), F.try_element_at("attributes", F.lit("Name")).alias("name"))
    return genes, judged.filter("reason IS NOT NULL").select("file", "line_number", "line", "reason")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines with their optional AS, NM and XS tags; ``contiguous`` is false where a read's lines are torn apart."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"), F.input_file_name().alias("file")).filter("NOT startswith(value, '@')").withColumn("f", F.split("value", "\t"))
    tag = lambda t: F.nullif(F.regexp_extract("value", rf"\t{t}:i:(-?\d+)", 1), F.lit("")).cast("long")
    at = lambda i: F.col("f")[i]
    out = rows.select("file", "n", at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("rname"), at(3).cast("long").alias("pos"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"), at(9).alias("seq"), tag("AS").alias("score"), tag("NM").alias("nm"), tag("XS").alias("xs"))
    new = ~F.lag("qname").over(W.partitionBy("file").orderBy("n")).eqNullSafe(F.col("qname"))
    runs = out.withColumn("__new", new)
    return runs.withColumn("contiguous", F.count_if("__new").over(W.partitionBy("file", "qname")) == 1).drop("__new", "n", "file")
