"""The model grid on a table whose strata are larger than their quotas."""

import duckdb
import pytest

from loomgene.operators.nearest import range_neighbours_each
from loomgene.plans import models


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """12,000 genes of one chromosome and biotype, some at one place and one without, and 3,000 points."""
    d = str(tmp_path_factory.mktemp("grid"))
    con = duckdb.connect()
    con.execute("CREATE VIEW orders AS SELECT i AS o_orderkey, CASE WHEN i <> 7 THEN 10 * i END AS o_custkey, 'F' AS o_orderstatus, 5.0 * (CASE WHEN i % 10 = 0 THEN 900 ELSE (i * 7919) % 60000 END) AS o_totalprice, '1' AS o_orderpriority FROM range(1, 12001) t(i)")
    con.execute("CREATE VIEW lineitem AS SELECT i AS l_orderkey, 1 AS l_linenumber, i AS l_partkey, 10 * i AS l_suppkey, chr(CAST(65 + i % 2 AS INTEGER)) AS l_returnflag, CASE WHEN i % 3 = 0 THEN 'O' ELSE 'F' END AS l_linestatus, CAST((i * 104729) % 60000 AS DOUBLE) AS l_extendedprice, CAST(i % 50 AS DOUBLE) AS l_quantity FROM range(3000) t(i)")
    for name in ("orders", "lineitem"):
        con.execute(f"COPY {name} TO '{d}/{name}.parquet' (FORMAT parquet)")
    columns = sorted(models.model_grid_range(spark, d).columns)
    want = con.sql(models.ORACLE_SQL["model_grid_range"]).project(",".join(columns)).fetchall()
    return d, columns, sorted(tuple(map(repr, r)) for r in want)


def moved(spark):
    """Bytes that all stages so far wrote to exchanges."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_draws_send_quotas_not_the_pool(spark, large):
    d, columns, want = large
    before = moved(spark)
    got = models.model_grid_range(spark, d).select(*columns).collect()
    n = moved(spark) - before
    assert sorted(tuple(map(repr, r)) for r in got) == want and len(want) > 2
    # The pool under all models and replicates is over 1.9 million rows.
    assert 0 < n < 20_000_000


@pytest.mark.parametrize("spare", [-2, 0])
def test_draw_from_too_few_is_made_again(spark, large, spare, monkeypatch):
    d, columns, want = large
    again, tallies = [], models._tallies
    monkeypatch.setattr(models, "SPARE", spare)
    monkeypatch.setattr(models, "_tallies", lambda *a: (again.append(a[-1]), tallies(*a))[1])
    got = models.model_grid_range(spark, d).select(*columns).collect()
    assert sorted(tuple(map(repr, r)) for r in got) == want and len(again) == 2 and again[1]


def test_neighbours_of_several_radii_equal_brute_force(spark):
    at = [(str(i % 2), (i * i * 31) % 997 if i % 5 else 400) for i in range(200)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(at)], "i int, c string, p long")
    got = range_neighbours_each(rows, "c", "p", {"a": 0, "b": 7, "d": 90}, bucket=50).orderBy("i").select("a", "b", "d").collect()
    assert [tuple(r) for r in got] == [tuple(sum(k == c and abs(p - q) <= r for k, q in at) - 1 for r in (0, 7, 90)) for c, p in at]
