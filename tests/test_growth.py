"""A task's share must not grow with the tables: rows are dealt out by their size, and file rows are not sorted."""

from pyspark.sql import functions as F

from citedspark.operators import gates as G
from citedspark.plans import member as M
from citedspark.sources import flat_files as L
from workload.tables import Source


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_file_rows_by_place_in_the_task(spark, tmp_path):
    sizes = {"a.csv": 400, "b.csv": 1, "c.csv": 37}
    for name, n in sizes.items():
        (tmp_path / name).write_text("X\n" + "".join(f"{i}\n" for i in range(1, n + 1)), encoding="utf-8")
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        numbered = L.with_file_rows(L.read_text_columns(spark, str(tmp_path)))
        rows = numbered.select("source_filename", "source_file_row_number", "X", F.spark_partition_id().alias("task")).collect()
        assert len({r["task"] for r in rows}) > 3  # several blocks a file, and blocks of several files in a task
        assert {name: sum(r["source_filename"] == name for r in rows) for name in sizes} == sizes
        assert all(r["source_file_row_number"] == int(r["X"]) for r in rows)
        plan = plan_of(numbered)
        assert "row_number()" not in plan and "BroadcastHashJoin" in plan
    finally:
        for name in settings:
            spark.conf.unset(name)


def order_tables(spark, folder, files):
    lines = spark.range(60).select(
        (F.col("id") % 9).alias("l_orderkey"), (F.col("id") % 4).alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"),
        (F.col("id") % 3).cast("int").alias("l_linenumber"), F.lit("R").alias("l_returnflag"),
    )
    lines.unionByName(lines.limit(5).withColumn("l_orderkey", F.lit(None).cast("long"))).repartition(files).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(9).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 2).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"),
        F.lit("2001-01-01").cast("timestamp_ntz").alias("o_orderdate"),
    ).write.parquet(f"{folder}/orders.parquet")
    return Source(spark, folder)


def test_order_lines_are_dealt_out_by_size(spark, tmp_path):
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # a file is a split
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = (order_tables(spark, str(tmp_path / name), files) for name, files in (("few", 2), ("many", 5)))
        assert many.tasks() > few.tasks() and many.core().tasks == many.tasks()
        distinct = many.order_lines().select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey").distinct()
        assert distinct.rdd.getNumPartitions() == many.tasks()
        assert plan_of(distinct).count("Exchange") == 2  # lines and orders; none for the distinct rows
        assert sorted(map(str, many.document_section().collect())) == sorted(map(str, few.document_section().collect()))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


class Sized(dict):
    tasks = 7


def test_windows_joins_and_groups_take_the_number_of_the_views(spark, tmp_path):
    conditions = spark.range(40).select(
        (F.col("id") % 3).cast("string").alias("patient_id"), F.lit("e").alias("encounter_id"), F.lit("c").alias("code"),
        F.lit("d").alias("description"), F.lit("2001-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("stop_date"),
        F.col("id").alias("source_file_row_number"),
    )
    plain, sized = M.panel({"condition": conditions}, "conditions"), M.panel(Sized(condition=conditions), "conditions")
    assert sized.rdd.getNumPartitions() == 7 and plan_of(sized).count("Exchange") == 1
    assert sorted(map(str, sized.collect())) == sorted(map(str, plain.collect()))
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 1), (None, 1)], "k string, n int")
    for tasks in (None, 3):
        assert G.duplicate_groups(rows, ("k", "n"), "twins", tasks).first()["twins"] == 2
    path = str(tmp_path / "charts")
    M.write_by_member(plain, path, 4, tasks=9)
    back = M.read_member(spark, path, "1", 4)
    assert sorted(map(str, back.select(plain.columns).collect())) == sorted(map(str, plain.where("patient_id = '1'").collect()))
