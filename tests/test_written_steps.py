"""Steps that are written leave no shuffle files, joined lines are stored once, and their datasets keep every line they had."""

import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import bindings as b
from ledgerloom.session import removed, written


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_written_table_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf, parts = shuffle_files(spark), spark.conf.get(key, None), spark.conf.get("spark.sql.shuffle.partitions")
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "step", source=spark.range(10))
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and (spark.conf.get(key, None), spark.conf.get("spark.sql.shuffle.partitions")) == (conf, parts)
    assert sorted(table.agg(F.sum("n"), F.count("*")).collect()[0]) == [7, 1000]
    laid_out = table.filter("k > 2").unionByName(spark.createDataFrame([(9, 9)], "k long, n long"))
    kept = written(laid_out, "next")
    removed(laid_out)
    assert kept.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(table.inputFiles()[0].rpartition("/")[0]).count()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    day = F.to_timestamp(F.concat(F.lit("2020-"), (F.col("id") % 12 + 1).cast("string"), F.lit("-03")))
    rows = {
        "nation": spark.range(3).selectExpr("id AS n_nationkey", "'N' || id AS n_name", "id AS n_regionkey"),
        "customer": spark.range(50).selectExpr("IF(id = 7, NULL, id) AS c_custkey", "id % 3 AS c_nationkey"),
        "supplier": spark.range(9).selectExpr("IF(id = 4, NULL, id) AS s_suppkey", "'Supplier#00' || id AS s_name", "id % 3 AS s_nationkey"),
        "part": spark.range(20).selectExpr("IF(id = 5, NULL, id) AS p_partkey", "IF(id % 2 = 0, 'STANDARD', 'PROMO') AS p_type", "'Brand#' || (id % 4 + 1) AS p_brand"),
        "orders": spark.range(400).select(F.expr("IF(id % 50 = 9, NULL, id) AS o_orderkey"), F.expr("id % 50 AS o_custkey"), F.lit(10.0).alias("o_totalprice"), day.alias("o_orderdate")),
        "lineitem": spark.range(2000).select(
            F.expr("IF(id % 10 = 3, NULL, id % 400) AS l_orderkey"), F.expr("id % 20 AS l_partkey"), F.expr("id % 9 AS l_suppkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"),
            F.when(F.col("id") % 11 != 0, day).alias("l_shipdate"), F.expr("IF(id % 2 = 0, 'A', 'R') AS l_returnflag"), F.expr("IF(id % 3 = 0, 'F', 'O') AS l_linestatus"),
            (F.col("id") % 5).cast("double").alias("l_quantity"), F.rand(1).alias("l_extendedprice"), F.lit(0.25).alias("l_discount"), F.lit(0.5).alias("l_tax")),
    }
    for name, table in rows.items():
        table.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def grouped(lines):
    return sorted(map(str, lines.groupBy("project", "month", "division", "main_code", "source", "raw_di").agg(
        F.count("*"), *[F.round(F.sum(c), 6) for c in ("work_qty", "bac", "ev", "ac")]).collect()))


@pytest.mark.parametrize("limit", [None, "-1"])
def test_stored_lines_are_the_cost_lines(spark, tables, limit):
    """In one join or, above the broadcast threshold, in two written ones."""
    want = grouped(b.ledger_codes(b.cost_lines(spark, tables, part=True)))
    if limit:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        stored = b.stored_lines(spark, tables)
        assert any("cost-lines" in f for f in stored.inputFiles()) and grouped(b.amounts(stored)) == want
        with_names = b.amounts(b.with_supplier(spark, tables, stored))
        assert with_names.count() == b.ledger_lines(spark, tables).count() < stored.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_waste_keeps_lines_without_a_supplier(spark, tables):
    from ledgerloom.plans import descriptor_queries as d

    lines = d.shared_cells(spark, tables)
    li, part, orders = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("lineitem", "part", "orders"))
    own = spark.read.parquet(f"{tables}/customer.parquet").join(spark.read.parquet(f"{tables}/nation.parquet"), F.expr("c_nationkey = n_nationkey"))
    every = li.join(part, F.expr("l_partkey = p_partkey")).join(orders, F.expr("l_orderkey = o_orderkey")).join(own, F.expr("o_custkey = c_custkey"))
    want = {(r[0], r[1]): r[2] for r in every.groupBy("n_name", F.expr("IF(p_type = 'STANDARD', 'steel', 'concrete')")).agg(F.sum("l_quantity")).collect()}
    assert {(r.project, r.material): r.actual for r in lines["waste"].collect()} == want
    assert lines["entry"].agg(F.sum("n")).first()[0] == lines["time"].agg(F.sum("n")).first()[0] == b.ledger_lines(spark, tables).count()
    assert any("cash-" in f for f in lines["cash"].inputFiles()) and any("quality-" in f for f in lines["quality"].inputFiles())


def test_transactions_are_dealt_once(spark, tables):
    ledger = b.ledger(spark, tables)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = b.ledger(spark, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1
    months = b.ledger_lines(spark, tables).select("project", "main_code", "resource", "source", "raw_di", "month").distinct().count()
    assert ledger.agg(F.sum(F.size("months"))).first()[0] == months
