"""The corpus pipeline: language, lines, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with all
columns of ``documents``; the last one returns token digests instead. ``run`` writes
every stage's result as Parquet to the shared folder and reads it back for the next.

Defined cases, in every stage: an empty table gives an empty result; all columns are kept
as they are, whatever their names, but for text and n_chars where lines are cut; a very
long text is taken whole. What a stage does with nulls, repeated rows and ties is said there.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgene.llm import bpe_table, edit_leaks, line_templates, parity_join, parse_language
from loomgene.llm._store import materialize

#: A document goes if at least this share of its letters is in blocks that parse clearly better as another language than its label:
#: texts in two languages, or with a long foreign passage, stay.
FOREIGN = 0.9
#: Rows without an id of their own are named from here on by their text, above the ids of documents.
OWN_NAMES = 1 << 62
#: Rows go to Python workers in batches of so many bytes. By Spark's default a whole partition may be one batch, held by the executor and by its worker.
BATCH_BYTES = 8 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Text of a block that is tokenised; half an operator's own, as the executors of a pipeline are filled by the stages before.
TOKEN_BLOCK_BYTES = 2 << 20


def _in_batches(stage: Callable) -> Callable:
    """The stage with BATCH_BYTES set, unless the session sets a size of its own. It stays set, as results are lazy; they don't depend on it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_KEY, None) is None:
            spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The columns ``names``, and all others in one called __rest, where no operator's columns can clash with them."""
    rest = [c for c in docs.columns if c not in names]
    return docs.select(*names, (F.struct(*rest) if rest else F.lit(None)).alias("__rest"))


def _unpacked(docs: DataFrame, columns: list[str], **named) -> list:
    """Columns in their order again, out of __rest unless they stand beside it or are given."""
    return [named.get(c, F.col(f"`{c}`") if c in docs.columns else F.col("__rest").getField(c)).alias(c) for c in columns]


@_in_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (also null and empty texts) go, and those whose label is a learned language that their text clearly isn't.

    Rows without a label, or with one that isn't learned, stay; so do ties of languages. Repeated rows are each judged.
    """
    samples = parse_language.learn(docs)
    rows = _packed(docs, "doc_id", "lang", "text")
    found = parse_language.identify(rows, samples, "lang")
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("foreign") < FOREIGN)).select("doc_id", "lang", "text", "__rest")
    return kept.select(*_unpacked(kept, docs.columns))


@_in_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines are cut, and n_chars follows; a document of which nothing is left goes.

    A null or empty text has no lines and stays. Rows that share a doc_id are one document, rows without one as well: their lines count once.
    """
    rows = _packed(docs, "doc_id", "text")
    cut = line_templates.drop_recurring(rows, min_tokens=1)
    left = cut.filter((F.col("n_dropped") == 0) | (F.trim(F.translate("kept", "\n\r\t", "   ")) != ""))
    named = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        was = F.col("__rest").getField("n_chars")
        named["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept")).otherwise(was).cast(docs.schema["n_chars"].dataType)
    left = left.select("doc_id", "text", "__rest", "kept", "n_dropped")
    return left.select(*_unpacked(left.select("doc_id", "text", "__rest"), docs.columns, **named))


@_in_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Rows without an id, and rows that share one but differ in their text, are documents of their own and are named by their text;
    of repeated rows (equal id and text) one stays, the first by its columns. Texts without words are linked with nothing and all stay.
    """
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    # One small row per id: which ids stand for several texts.
    texts = docs.select(F.col("doc_id").alias("__key"), digest.alias("__h")).groupBy("__key").agg(F.min("__h").alias("lo"), F.max("__h").alias("hi"))
    several = materialize(texts.filter(F.col("__key").isNotNull() & (F.col("lo") != F.col("hi"))).select("__key", F.lit(True).alias("__several")), "several")
    own = F.lit(OWN_NAMES) + F.xxhash64("doc_id", digest).bitwiseAND(F.lit(OWN_NAMES - 1))
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    if several.isEmpty():
        name = F.coalesce(F.col("doc_id").cast("long"), own)
    else:
        rows = rows.join(several.withColumnRenamed("__key", "doc_id"), "doc_id", "left")
        name = F.when(F.col("doc_id").isNull() | F.col("__several"), own).otherwise(F.col("doc_id").cast("long"))
    rows = rows.withColumn("__name", name)
    found = materialize(parity_join.near_duplicates(rows.select(F.col("__name").alias("doc_id"), "text")), "found")
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__name")).distinct()
    left = rows.select("__name", "__row").join(gone, "__name", "left_anti")
    again = found.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("__name")).agg(F.count("*").alias("n")).filter("n > 1").select("__name")
    again = materialize(again, "again")
    if not again.isEmpty():
        # Repeated rows, one of each: the least by its columns. The aggregation is partial before the shuffle.
        first = left.join(again, "__name", "left_semi").groupBy("__name").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
        left = left.join(again, "__name", "left_anti").unionByName(first)
    return left.select("__row.*")


@_in_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, or one within a few edits, go, each judged by its own text; rows without id or text need no care."""
    rows = _packed(docs, "text")
    left = edit_leaks.mark_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__leaks").filter("__leaks = 0").drop("__leaks")
    return left.select(*_unpacked(left, docs.columns))


@_in_batches
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each row left; a null text is encoded as an empty one."""
    return bpe_table.digests(bpe_table.encode_texts(docs.select("doc_id", "text"), bpe_table.default_tokenizer(), block_bytes=TOKEN_BLOCK_BYTES))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: Cross-parsing, template trees and merges have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
