"""Exact top-k search over vector-approximation files.

Every vector is kept twice: exact, and as one small cell number per dimension. A
query scans the cells, which bound its inner product with a vector from both sides,
and then reads exact vectors in the order of their upper bounds until the k-th best
exact score is not below the next bound. The result is exact.

Queries are taken in blocks of bounded size, a pass over the cells for each; its candidates
are appended to one table and its broadcast is dropped before the next, so neither the plan
nor what is sent grows with the data. A task keeps each query's k best lower bounds from batch
to batch, so what it names grows with the logarithm of its rows.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows without an id; rows that share an id are all candidates, and queries, of
their own; a row is never its own candidate; only vectors of equal length are compared; equal
scores go to the smaller id; fewer than k candidates give fewer rows; very long vectors are
taken whole; an empty table gives an empty result; other columns, whatever their names, are
ignored. Components whose cell number or scores that don't fit into 64 bits raise an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgene.llm._store import materialize, shared_dir

SCALE = 256
CELL_BITS = 6
BLOCK_QUERIES = 4096
#: Up to so many repeated ids, of 8 bytes, are sent to all tasks; more are joined by a shuffle.
SEND_IDS = 1_000_000
FIRST_OWN = -(1 << 62)


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """row (vec_id, or a number of its own where rows share it), vec_id and the vector of floor(scale * x), without rows that take no part."""
    x = F.col("__v")
    usable = F.col("__id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("__id"), F.col(column).cast("array<double>").alias("__v")).filter(usable)
    cell = lambda c: F.when(F.abs(c * scale) < F.lit(2.0**63), F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large for 64 bits")).cast("long"))
    rows = rows.select(F.col("__id").alias("vec_id"), F.transform("__v", cell).alias("vector"))
    again = materialize(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id", F.lit(True).alias("__again")), "again")
    if not (n := again.count()):
        return rows.select(F.col("vec_id").alias("row"), "vec_id", "vector")
    marked = rows.join(F.broadcast(again) if n <= SEND_IDS else again, "vec_id", "left")
    return marked.select(F.when(F.col("__again"), F.lit(FIRST_OWN) + F.monotonically_increasing_id()).otherwise(F.col("vec_id")).alias("row"), "vec_id", "vector")


def cell_bounds(exact: DataFrame, bits: int = CELL_BITS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each vector length, the origin and the cell width of each dimension: one row per dimension reaches the driver."""
    spread = exact.select(F.size("vector").alias("dim"), F.posexplode("vector").alias("d", "x")).groupBy("dim", "d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for row in spread.collect():
        lo, width = out.setdefault(row["dim"], (np.zeros(row["dim"], np.int64), np.ones(row["dim"], np.uint64)))
        lo[row["d"]] = row["lo"]
        width[row["d"]] = max(1, -(-(row["hi"] - row["lo"] + 1) // (1 << bits)))
    return out


def approximation_file(exact: DataFrame, bounds: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """row, vec_id, dim, cells (one byte per dimension), digest of the exact vector."""

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            flat, lengths = np.asarray(vectors.flatten(), np.int64), np.diff(np.asarray(vectors.offsets, np.int64))
            at = np.concatenate([[0], np.cumsum(lengths)])
            cells = []
            for i, n in enumerate(lengths):
                lo, width = bounds[int(n)]
                # Differences modulo 2**64, as both ends may be far out.
                cells.append(((flat[at[i] : at[i + 1]].view(np.uint64) - lo.view(np.uint64)) // width).astype(np.uint8).tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(lengths.astype(np.int32)), pa.array(cells, pa.binary()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "dim", "cells", "digest"])

    return exact.select("row", "vec_id", "vector", F.xxhash64("vector").alias("digest")).mapInArrow(quantise, "row long, vec_id long, dim int, cells binary, digest long")


def _whole(x: np.ndarray) -> np.ndarray:
    """Numbers as 64-bit integers; those beyond become the ends of the range."""
    top = float(2**63 - 1024)
    return np.where(x > top, np.int64(2**63 - 1), np.where(x < -top, np.int64(-(2**63)), np.clip(x, -top, top).astype(np.int64)))


def _scan(bounds, queries, k: int):
    """Cells to candidates: (query, row, vec_id, upper bound, lower bound). What can't be among the k best of those seen so far is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = queries.value
        #: Of each length, the k best lower bounds of each query in the batches so far.
        best = {dim: np.full((len(q_rows), k), -np.inf) for dim, (q_rows, _) in held.items()}
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims):
                if int(dim) not in held:
                    continue
                q_rows, q = held[int(dim)]
                rows = np.flatnonzero(dims == dim)
                own, ids, digest = (np.asarray(batch.column(c))[rows] for c in (0, 1, 4))
                # Of equal vectors only the k + 1 smallest ids can matter: one of them may be the query itself.
                order = np.lexsort((own, ids, digest))
                new = np.r_[True, digest[order][1:] != digest[order][:-1]]
                start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                order = order[np.arange(len(order)) - start <= k]
                order.sort()
                rows, own, ids = rows[order], own[order], ids[order]
                lo, width = bounds[int(dim)]
                cells = np.stack([np.frombuffer(x, np.uint8) for x in batch.column(3).take(pa.array(rows)).to_pylist()]).astype(np.float64)
                # Components are integers: a cell holds lo + c * width up to lo + c * width + width - 1.
                half = (width.astype(np.float64) - 1) / 2.0
                middle = (lo + half) + cells * width
                far = np.abs(lo.astype(np.float64)) + 256.0 * width
                # Half the width of the bounds, and what rounding may add to a sum of so many products.
                radius = np.abs(q) @ half + 1 + (np.abs(q) @ far) * (4 * (int(dim) + 4) * 2.0**-53)
                for a in range(0, len(q_rows), 512):
                    part = slice(a, a + 512)
                    centre = q[part] @ middle.T
                    upper, lower = centre + radius[part, None], centre - radius[part, None]
                    mine = q_rows[part, None] == own[None, :]
                    lower[mine] = -np.inf
                    most = np.concatenate([best[int(dim)][part], lower if lower.shape[1] <= k else np.partition(lower, lower.shape[1] - k, axis=1)[:, -k:]], axis=1)
                    best[int(dim)][part] = np.partition(most, most.shape[1] - k, axis=1)[:, -k:]
                    floor = best[int(dim)][part].min(axis=1)
                    qi, vi = np.nonzero((upper >= floor[:, None]) & ~mine)
                    columns = [q_rows[part][qi], own[vi], ids[vi], _whole(np.ceil(upper[qi, vi])), _whole(np.floor(lower[qi, vi]))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "row", "vec_id", "upper", "lower"])

    return run


def _inner(pairs: DataFrame, exact: DataFrame) -> DataFrame:
    q = exact.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("vector").alias("__q"))
    product = F.aggregate(F.zip_with("__q", "vector", F.try_multiply), F.lit(0).cast("long"), F.try_add)
    product = F.coalesce(product, F.raise_error(F.lit("a score is too large for 64 bits")).cast("long"))
    return pairs.join(exact, "row").join(q, "query").select("query", "query_id", "row", "vec_id", product.alias("score"))


def _candidates(exact: DataFrame, cells: DataFrame, queries: DataFrame, bounds, k: int, block_queries: int) -> DataFrame:
    """Candidates of all queries, block by block."""
    spark = exact.sparkSession
    blocks = max(1, -(-queries.count() // block_queries))
    path, schema = f"{shared_dir(spark)}/loomgene/candidates-{uuid.uuid4().hex}", "query long, row long, vec_id long, upper long, lower long"
    for b in range(blocks):
        held: dict[int, tuple[list, list]] = {}
        for row in queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toLocalIterator():
            rows, vectors = held.setdefault(len(row["vector"]), ([], []))
            rows.append(row["row"])
            vectors.append(row["vector"])
        sent = spark.sparkContext.broadcast({d: (np.array(i, np.int64), np.array(r, np.float64)) for d, (i, r) in held.items()})
        cells.mapInArrow(_scan(bounds, sent, k), schema).write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(schema).parquet(path)


def top_k(vectors: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", column: str = "embedding", bits: int = CELL_BITS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k largest inner products of every query with all other vectors: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the column vec_id.
    """
    if not 1 <= bits <= 8:
        raise ValueError("a cell number has 1 to 8 bits")
    exact = materialize(integer_vectors(vectors, id_column, column), "exact")
    bounds = cell_bounds(exact, bits)
    cells = materialize(approximation_file(exact, bounds), "cells")
    candidates = _candidates(exact, cells, exact.filter(is_query), bounds, k, block_queries)
    # The k-th largest lower bound over all cells is a floor below any query's k-th score.
    by_lower = W.partitionBy("query").orderBy(F.desc("lower"), "row")
    floor = candidates.withColumn("n", F.row_number().over(by_lower)).filter(F.col("n") <= k).groupBy("query").agg(F.when(F.count("*") == k, F.min("lower")).alias("floor"))
    kept = candidates.join(floor, "query").filter(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
    by_upper = W.partitionBy("query").orderBy(F.desc("upper"), "vec_id", "row")
    kept = kept.withColumn("n", F.row_number().over(by_upper)).select("query", "row", "upper", "n")
    # Exact vectors are read in the order of upper bounds: k of them first; the k-th score then tells which others can still count.
    first = materialize(_inner(kept.filter(F.col("n") <= k).select("query", "row"), exact), "first")
    kth = first.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    rest = kept.filter(F.col("n") > k).join(kth, "query").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    scored = first.unionByName(_inner(rest.select("query", "row"), exact))
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_va_search(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
