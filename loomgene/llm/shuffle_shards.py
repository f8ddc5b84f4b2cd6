"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters whole records uniformly into memory-sized buckets by a seeded hash.
Pass 2 permutes every bucket by Fisher-Yates (Spark's ``shuffle`` of an array is the
inside-out form of it) and writes it; buckets lie end to end, and the place in that
order decides shard and slot.

Law ``rows``: the i-th record goes to shard i mod n, slot i div n, so counts are at
most one apart and slots are gapless.

A record's bucket follows from its columns. Groups of equal rows with more than ``HOT_ROWS``
members are folded to one row and a count, and dealt out again, each copy with its number in
the hash, so that no group meets in one bucket. Where buckets begin is a running sum over one
number per bucket. Results depend on the records, ``seed`` and the bucket's size, not on how
the input is split: the number of tasks follows from that of buckets, and a task's buckets
are taken in one order. For many TB raise ``bucket_bytes`` to what a task may hold twice over.

Defined cases: a null text has no bytes; a null doc_id is hashed as such; repeated rows are
kept, each with its own slot; a very long text is one record, in a bucket with others; an empty
table gives an empty result; other columns are kept in what is written, and where one is called
shard or slot, the new one gets underscores. Columns that can't be compared (maps) don't take part in the hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from loomgene.llm._store import materialize, shared_dir

ROW_OVERHEAD = 16
LAW = "rows"
BUCKET_BYTES = 8 << 20
HOT_ROWS = 1024
#: Small hot tables are sent to all tasks, larger ones are joined by a shuffle; a row has 16 bytes.
SEND_ROWS = 100_000
BUCKETS_PER_TASK = 8
COPIES_PER_ROW = 1 << 12


def record_size() -> Column:
    """UTF-8 bytes of the text plus overhead."""
    return (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + F.lit(ROW_OVERHEAD)).cast("long")


def text_crc32() -> Column:
    return F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")


def free_name(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _copies(rows: DataFrame) -> DataFrame:
    """Rows with their __copies, as often as that, each with its number __copy; in two steps, so that no row becomes very many at once."""
    step = F.lit(COPIES_PER_ROW).cast("long")
    lanes = rows.withColumn("__lane", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__copies - 1) div {COPIES_PER_ROW}"))))
    lanes = lanes.repartition(F.xxhash64("__h", "__lane"))
    each = F.sequence(F.col("__lane") * step, F.least(F.col("__copies"), (F.col("__lane") + 1) * step) - 1)
    return lanes.withColumn("__copy", F.explode(each)).drop("__lane", "__copies")


def placed_records(docs: DataFrame, seed: int, bucket_rows: int | None, bucket_bytes: int) -> DataFrame:
    """(__bucket, __at, __place, __record): each record whole, at its place in the order of the permuted buckets; lazy but for the counts."""
    spark = docs.sparkSession
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.xxhash64(F.lit(seed), *hashed).alias("__h"), record_size().alias("__size"), record.alias("__record"))
    # Some 24 bytes for each distinct record: the texts are not read again for what follows from the counts.
    stats = materialize(rows.groupBy("__h").agg(F.count("*").alias("__copies"), F.sum("__size").alias("__bytes")), "records")
    total = stats.agg(F.coalesce(F.sum("__copies"), F.lit(0)).alias("rows"), F.coalesce(F.sum("__bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("__copies") > HOT_ROWS).alias("hot")).first()
    n = max(1, -(-total["rows"] // bucket_rows) if bucket_rows else 1, -(-total["bytes"] // bucket_bytes))
    bucket = F.pmod(F.xxhash64("__h", "__copy"), F.lit(n)).cast("int").alias("__bucket")
    plain = F.lit(0).cast("long").alias("__copy")
    # Pass 1: scatter.
    if total["hot"]:
        hot = stats.filter(F.col("__copies") > HOT_ROWS).select("__h")
        hot = F.broadcast(hot) if total["hot"] <= SEND_ROWS else hot
        folded = rows.join(hot, "__h", "left_semi").groupBy("__h").agg(F.count("*").alias("__copies"), F.first("__record").alias("__record"))
        dealt = rows.join(hot, "__h", "left_anti").select("__h", plain, "__record").unionByName(_copies(folded).select("__h", "__copy", "__record"))
        counted = _copies(stats.filter(F.col("__copies") > HOT_ROWS).select("__h", "__copies")).select(bucket, F.lit(1).cast("long").alias("n"))
        counted = counted.unionByName(stats.filter(F.col("__copies") <= HOT_ROWS).select("__h", plain, F.col("__copies").alias("n")).select(bucket, "n"))
    else:
        dealt = rows.select("__h", plain, "__record")
        counted = stats.select("__h", plain, F.col("__copies").alias("n")).select(bucket, "n")
    scattered = dealt.select("__h", "__copy", bucket, "__record")
    bases = bucket_bases(counted.groupBy("__bucket").agg(F.sum("n").alias("rows")), n)
    # Pass 2: each bucket is sorted, so that its input order is always the same, and then permuted by Fisher-Yates. The generator
    # runs on from bucket to bucket of a task, so their order and the number of tasks are fixed as well.
    parts = max(min(n, BUCKETS_PER_TASK), n // BUCKETS_PER_TASK)
    dealt_out = scattered.repartition(parts, "__bucket")
    entry = F.collect_list(F.struct("__h", "__copy", "__record"))
    if any(isinstance(f.dataType, MapType) for f in docs.schema.fields):
        # Records that can't be compared are sorted before they are collected.
        decks = dealt_out.sortWithinPartitions("__bucket", "__h", "__copy").groupBy("__bucket").agg(entry.alias("deck"))
    else:
        decks = dealt_out.groupBy("__bucket").agg(F.sort_array(entry).alias("deck"))
    permuted = decks.sortWithinPartitions("__bucket").select("__bucket", F.shuffle("deck", seed).alias("deck"))
    at = F.col("base") + F.col("__place")
    return permuted.join(bases, "__bucket").select("__bucket", "base", F.posexplode("deck").alias("__place", "r")).select("__bucket", at.alias("__at"), "__place", F.col("r.__record").alias("__record"))


def bucket_bases(sizes: DataFrame, n: int) -> DataFrame:
    """(__bucket, base): a running sum over one small row per bucket, coarse totals first so that no task sees all buckets."""
    width = max(1, int(n**0.5))
    sizes = sizes.withColumn("lane", F.expr(f"__bucket div {width}"))
    coarse = sizes.groupBy("lane").agg(F.sum("rows").alias("lane_rows"))
    lanes = coarse.select("lane", F.coalesce(F.sum("lane_rows").over(W.orderBy("lane").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("lane_base"))
    inner = W.partitionBy("lane").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("within", F.coalesce(F.sum("rows").over(inner), F.lit(0))).join(lanes, "lane").select("__bucket", (F.col("lane_base") + F.col("within")).alias("base"))


def _shard(shards: int) -> Column:
    return F.pmod("__at", F.lit(shards)).cast("int")


def _slot(shards: int) -> Column:
    return F.expr(f"__at div {shards}").cast("long")


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 20_177, bucket_rows: int | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, bucket, place in the bucket, shard, slot. Nothing but the records' hashes is written."""
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = docs.select("doc_id", "text").select("doc_id", record_size().alias("size"), text_crc32().alias("crc"), F.lit("").alias("text"))
    placed = placed_records(rows, seed, bucket_rows, bucket_bytes)
    return placed.select(
        F.col("__record.doc_id").cast("long").alias("doc_id"),
        F.col("__record.size").alias("size"),
        F.col("__record.crc").alias("text_crc32"),
        F.col("__bucket").alias("bucket"),
        F.col("__place").cast("long").alias("place"),
        _shard(shards).alias("shard"),
        _slot(shards).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 20_177, bucket_rows: int | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the records, whole, bucket by bucket, to one folder per shard with their slots; returns what was written.

    A file holds a task's buckets in the order of slots; a shard is many files, so no task holds a shard.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    shard = free_name("shard", docs.columns)
    slot = free_name("slot", [*docs.columns, shard])
    placed = placed_records(docs, seed, bucket_rows, bucket_bytes)
    out = placed.select("__record.*", _slot(shards).alias(slot), _shard(shards).alias(shard))
    out.write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def op7_shuffle_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_shards(docs, f"{shared_dir(spark)}/loomgene/shards-{uuid.uuid4().hex}")
    return shards.select(F.col("doc_id").cast("long").alias("doc_id"), record_size().alias("size"), text_crc32().alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
