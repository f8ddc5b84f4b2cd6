"""Analogous views of the driver's tables, once as DataFrames and once as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOWS = [0, 1, 5, 10, 20, 50, 100, 500]
SEED = 1729
ARMS = ("A", "B", "C")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def loci(spark: SparkSession, sf: str) -> DataFrame:
    """Marker ledger: every line item is a record of resource, chromosome, original and reference position."""
    orig = F.floor("l_extendedprice").cast("long")
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("resource"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_key"),
        (F.col("l_suppkey") % 10).cast("string").alias("chromosome"),
        orig.alias("orig"),
        (orig + F.floor("l_quantity")).cast("long").alias("ref"),
        (F.col("l_linestatus") == "O").alias("accepted"),
    )


LOCI = """loci AS (SELECT l_returnflag AS resource, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record_key,
 CAST(l_suppkey % 10 AS VARCHAR) AS chromosome, CAST(floor(l_extendedprice) AS BIGINT) AS orig,
 CAST(floor(l_extendedprice) AS BIGINT) + CAST(floor(l_quantity) AS BIGINT) AS ref, l_linestatus = 'O' AS accepted FROM lineitem)"""


def arms(rows: DataFrame) -> DataFrame:
    """A: all at the original position; B: accepted there; C: accepted at the reference position."""
    ok = F.col("accepted")
    each = F.array(
        F.struct(F.lit("A").alias("arm"), F.col("orig").alias("pos")),
        F.when(ok, F.struct(F.lit("B").alias("arm"), F.col("orig").alias("pos"))),
        F.when(ok, F.struct(F.lit("C").alias("arm"), F.col("ref").alias("pos"))),
    )
    return rows.select("resource", "record_key", "chromosome", F.explode(F.array_compact(each)).alias("x")).select("resource", "record_key", "chromosome", "x.arm", "x.pos")


ARM_ROWS = """arm_rows AS (SELECT resource, record_key, chromosome, 'A' AS arm, orig AS pos FROM loci
 UNION ALL SELECT resource, record_key, chromosome, 'B', orig FROM loci WHERE accepted
 UNION ALL SELECT resource, record_key, chromosome, 'C', ref FROM loci WHERE accepted)"""


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    start = (F.floor(F.col("o_totalprice") / 5) + 1).cast("long")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("query_id"),
        (F.col("o_custkey") % 10).cast("string").alias("chromosome"),
        start.alias("start"),
        (start + F.col("o_orderkey") % 500).alias("end"),
        F.col("o_orderpriority").alias("query_set"),
        F.col("o_orderstatus").alias("biotype"),
        (F.col("o_orderkey") % 33 == 0).alias("candidate"),
    )


INTERVALS = """intervals AS (SELECT o_orderkey AS query_id, CAST(o_custkey % 10 AS VARCHAR) AS chromosome,
 CAST(floor(o_totalprice / 5) AS BIGINT) + 1 AS "start", CAST(floor(o_totalprice / 5) AS BIGINT) + 1 + o_orderkey % 500 AS "end",
 o_orderpriority AS query_set, o_orderstatus AS biotype, o_orderkey % 33 = 0 AS candidate FROM orders)"""

POINTS = "points AS (SELECT DISTINCT resource, arm, chromosome, pos FROM arm_rows)"

#: Distance of every interval to the nearest point of every resource and arm; null where its chromosome has none.
DISTANCES = """dims AS (SELECT DISTINCT resource, arm FROM points),
q AS (SELECT * FROM intervals, dims),
lft AS (SELECT q.*, p.pos AS lp FROM q ASOF LEFT JOIN points p ON q.resource = p.resource AND q.arm = p.arm AND q.chromosome = p.chromosome AND q."start" > p.pos),
dist AS (SELECT l.* EXCLUDE (lp), least(l."start" - l.lp, CASE WHEN p.pos IS NOT NULL THEN greatest(p.pos - l."end", 0) END) AS distance
 FROM lft l ASOF LEFT JOIN points p ON l.resource = p.resource AND l.arm = p.arm AND l.chromosome = p.chromosome AND l."start" <= p.pos)"""

COVERAGE = f"WITH {LOCI}, {ARM_ROWS}, {INTERVALS}, {POINTS}, {DISTANCES}"


def calls(spark: SparkSession, sf: str, second: bool = False) -> DataFrame:
    """Genotype matrix, one row per marker with its 64 symbols; the second export lacks every fifth marker and cuts elsewhere."""
    cut = 0.07 if second else 0.06
    symbol = lambda v: F.when(F.abs(F.abs(v) - 0.1) < 0.004, "N").when(v < -cut, "A").when(v > cut, "C").otherwise("M")
    rows = table(spark, sf, "embeddings")
    rows = rows.filter(F.col("vec_id") % 5 != 0) if second else rows
    return rows.select(
        F.col("vec_id").alias("marker"),
        F.col("label").cast("string").alias("chromosome"),
        (F.col("vec_id") * 1000 + 1).alias("position"),
        F.transform(F.col("embedding").cast("array<double>"), symbol).alias("symbols"),
    )


def calls_sql(name: str = "calls", second: bool = False) -> str:
    cut = 0.07 if second else 0.06
    where = "WHERE vec_id % 5 <> 0" if second else ""
    return f"""{name} AS (SELECT vec_id AS marker, CAST(label AS VARCHAR) AS chromosome, vec_id * 1000 + 1 AS position, s - 1 AS sample,
 CASE WHEN abs(abs(x) - 0.1::DOUBLE) < 0.004::DOUBLE THEN 'N' WHEN x < -{cut}::DOUBLE THEN 'A' WHEN x > {cut}::DOUBLE THEN 'C' ELSE 'M' END AS symbol
 FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS s FROM embeddings {where}))"""


def assoc(spark: SparkSession, sf: str) -> DataFrame:
    """Association records: trait, chromosome, hour as peak, method, value as payload; sheets by user."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    return table(spark, sf, "events").select(
        F.when(F.col("user_id") % 4 == 0, "subset").when(F.col("user_id") % 4 == 1, "other").otherwise("master").alias("sheet"),
        F.col("event_id").alias("source_row"),
        (F.col("user_id") % 10).cast("string").alias("chromosome"),
        hour.alias("peak"),
        F.col("event_type").alias("trait"),
        F.floor(F.col("value")).cast("long").alias("payload"),
    )


ASSOC = """assoc AS (SELECT CASE WHEN user_id % 4 = 0 THEN 'subset' WHEN user_id % 4 = 1 THEN 'other' ELSE 'master' END AS sheet, event_id AS source_row,
 CAST(user_id % 10 AS VARCHAR) AS chromosome, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS peak, event_type AS trait, CAST(floor(value) AS BIGINT) AS payload FROM events)"""
