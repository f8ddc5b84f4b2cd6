"""Shared storage for intermediate tables, and packed text blocks.

Lineage is cut only through Parquet tables in the folder that the cluster names
in ``spark.checkpoint.dir``; no operator writes to a machine-local folder.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
BLOCK_SCHEMA = "block long, payload binary"


_HELD: dict = {}


def held(key, make):
    """The one large object that a Python worker keeps from task to task; another key frees it first."""
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = make()
        release()
    return _HELD[key]


def release() -> None:
    """Give freed memory back to the system: workers stay, and there are several beside each executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Tidy:
    """A function over batches that leaves no freed memory behind in its worker."""

    def __init__(self, run):
        self.run = run

    def __call__(self, batches):
        yield from self.run(batches)
        release()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is set only where it is unset and all runs in one process (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loomgene-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a DataFrame to the shared folder and read it back, so that later steps do not recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgene/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``materialize`` wrote, once all that read it is written itself."""
    if (path := getattr(df, "_written_at", None)) is not None:
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def encode_block(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def decode_block(payload) -> pa.RecordBatch:
    data = payload.as_buffer() if isinstance(payload, pa.Scalar) else payload
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def _sizes(batch: pa.RecordBatch, column: str) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0).to_pylist()


def ranges(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one row where that alone is larger."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def to_blocks(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows packed into compressed blocks of about ``block_bytes`` of text, hash-partitioned by block.

    A block's number is its scan partition and its place there, so a lost task makes the same blocks again.
    Whole rows travel at about a third of their size, and once: every branch of one plan shares the exchange.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lo, hi in ranges(_sizes(batch, text), block_bytes):
                yield pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([encode_block(batch.slice(lo, hi - lo))], pa.binary())], names=["block", "payload"])
                k += 1

    return docs.mapInArrow(Tidy(pack), BLOCK_SCHEMA).repartition(shuffle_partitions(docs.sparkSession), "block")


def gather_returns(rows: DataFrame) -> DataFrame:
    """(block, bucket, payload) to one row per block; a block has at most one row per bucket."""
    return rows.groupBy("block").agg(F.collect_list(F.struct("bucket", F.col("payload").alias("back"))).alias("returns"))


ROUTED = "block long, bucket int, step int, payload binary"


def routed_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["block", "bucket", "step", "payload"])


def ask(blocks: DataFrame, make) -> DataFrame:
    """Routed rows of ``make(block, rows, returns)``, which yields (bucket, step, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, returns in _opened(batch):
                if rows := [(block, *row) for row in make(block, decode_block(payload), returns)]:
                    yield routed_rows(rows)
        release()

    return blocks.mapInArrow(run, ROUTED)


def answer(asked: DataFrame, reply) -> DataFrame:
    """All rows of a bucket together: ``reply(blocks, payloads)`` gives an answer, or None, to each; and the step it belongs to."""

    def run(table: pa.Table) -> pa.Table:
        back, step = reply(table.column("block").to_pylist(), table.column("payload").to_pylist())
        out = table.select(["block", "bucket"]).append_column("step", pa.array([step] * len(back), pa.int32())).append_column("payload", pa.array(back, pa.binary()))
        release()
        return out.filter(pa.compute.is_valid(out.column("payload")))

    return asked.groupBy("bucket").applyInArrow(run, ROUTED)


def answer_and_tell(asked: DataFrame, reply) -> DataFrame:
    """As ``answer``; ``reply`` also gives what the bucket has to tell all blocks, as (step, payload) pairs, filed under block -1."""

    def run(table: pa.Table) -> pa.Table:
        back, step, told = reply(table.column("block").to_pylist(), table.column("payload").to_pylist())
        bucket = table.column("bucket")[0].as_py()
        rows = [(b, bucket, step, p) for b, p in zip(table.column("block").to_pylist(), back) if p is not None]
        rows += [(-1, bucket, s, p) for s, p in told]
        release()
        return pa.Table.from_batches([routed_rows(rows)]) if rows else pa.table({f: pa.array([], t) for f, t in (("block", pa.int64()), ("bucket", pa.int32()), ("step", pa.int32()), ("payload", pa.binary()))})

    return asked.groupBy("bucket").applyInArrow(run, ROUTED)


def with_told(blocks: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Blocks with what the buckets told: one row of some bytes per bucket, sent to all by a join on a constant."""
    told = rows.filter("block = -1").agg(F.collect_list(F.struct("step", "payload")).alias(name)).withColumn("__one", F.lit(1))
    return blocks.withColumn("__one", F.lit(1)).join(F.broadcast(told), "__one", "left").drop("__one")


def with_returns(blocks: DataFrame, rows: DataFrame, name: str = "returns") -> DataFrame:
    """Blocks with all answers to them; a block gets at most one row per bucket and step."""
    gathered = rows.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("step", "bucket", F.col("payload").alias("back"))).alias(name))
    return blocks.join(gathered, "block", "left")


def _opened(batch: pa.RecordBatch):
    """(block, payload, step -> bucket -> answer); under -step the list of what buckets told there."""
    names = [x for x in batch.schema.names if x not in ("block", "payload")]
    for i, (block, payload) in enumerate(zip(batch.column("block").to_pylist(), batch.column("payload"))):
        steps: dict = {}
        for name in names:
            for r in batch.column(name)[i].as_py() or []:
                if "back" in r:
                    steps.setdefault(r["step"], {})[r["bucket"]] = r["back"]
                else:
                    steps.setdefault(-r["step"], []).append(r["payload"])
        yield block, payload, steps


def finish(blocks: DataFrame, make, schema) -> DataFrame:
    """Rows of ``make(block, rows, returns)``, a RecordBatch for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, returns in _opened(batch):
                yield make(block, decode_block(payload), returns)
        release()

    return blocks.mapInArrow(run, schema)
