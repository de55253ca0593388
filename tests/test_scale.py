"""Parts of a join follow the size of the tables."""

from ledgerloom import session
from pyspark.sql import functions as F


def test_lines_are_dealt_by_the_size_of_their_table(spark, tmp_path, monkeypatch):
    """Above the broadcast threshold the join of the lines has as many parts as their table has pieces of PART_BYTES."""
    from ledgerloom.plans import bindings

    n = 3000
    day = F.to_timestamp(F.lit("2020-03-01"))
    tables = {
        "nation": spark.range(3).selectExpr("id AS n_nationkey", "'N' || id AS n_name", "id AS n_regionkey"),
        "customer": spark.range(50).selectExpr("IF(id = 7, NULL, id) AS c_custkey", "id % 3 AS c_nationkey"),
        "orders": spark.range(500).select(F.expr("IF(id % 50 = 9, NULL, id) AS o_orderkey"), F.expr("id % 50 AS o_custkey"), F.lit(10.0).alias("o_totalprice"), day.alias("o_orderdate")),
        "lineitem": spark.range(n).select(
            F.expr("IF(id % 10 = 3, NULL, id % 500) AS l_orderkey"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"), day.alias("l_shipdate"), F.lit("A").alias("l_returnflag"),
            F.lit("F").alias("l_linestatus"), F.lit(1.0).alias("l_quantity"), F.rand(1).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax")),
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    want = sorted(bindings.cost_lines(spark, str(tmp_path)).groupBy("project").agg(F.count("*"), F.round(F.sum("ac"), 6)).collect())
    monkeypatch.setattr(session, "PART_BYTES", sum(f.stat().st_size for f in (tmp_path / "lineitem.parquet").glob("*.parquet")) // 40)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = bindings.cost_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() >= 40
        assert sorted(lines.groupBy("project").agg(F.count("*"), F.round(F.sum("ac"), 6)).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
