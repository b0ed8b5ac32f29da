"""Flat files: the given tables written as delimited text and loaded again with lineage."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citedspark.plans.conform import conformed
from citedspark.session import scratch_path
from citedspark.sources import facts as FA
from citedspark.sources import files as S
from citedspark.sources import flat_files as L
from workload.registry import query
from workload.tables import Source, text

STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def written(spark: SparkSession, folder: str) -> str:
    """Order lines under the medication file's header; the description has quotes and commas."""
    lines = Source(spark, folder).order_lines().select(
        F.date_format("o_orderdate", STAMP).alias("START"),
        F.when(F.col("l_linestatus") == "F", F.date_format("l_shipdate", STAMP)).alias("STOP"),
        text("o_custkey").alias("PATIENT"),
        F.concat(F.lit("N"), F.col("l_suppkey")).alias("PAYER"),
        text("l_orderkey").alias("ENCOUNTER"),
        F.lpad(text("l_partkey"), 9, "0").alias("CODE"),
        F.concat(F.lit('Part "'), F.col("l_partkey"), F.lit('", '), F.col("l_returnflag")).alias("DESCRIPTION"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("BASE_COST"),
        F.lit("0.50").alias("PAYER_COVERAGE"),
        F.col("l_quantity").cast("bigint").alias("DISPENSES"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("TOTALCOST"),
        F.when(F.col("l_returnflag") == "R", "R1").alias("REASONCODE"),
        F.lit(None).cast("string").alias("REASONDESCRIPTION"),
    )
    path = scratch_path(spark, "medications")
    lines.write.options(header=True, quote='"', escape='"', nullValue="").csv(path)
    return path


def loaded(spark: SparkSession, folder: str) -> DataFrame:
    return L.load_table(
        spark, written(spark, folder), "medications", L.new_batch_id(), datetime.now(timezone.utc)
    )


@query(
    """SELECT o_orderdate AS start_ts, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS stop_ts,
              CAST(o_custkey AS VARCHAR) AS patient_id, 'N' || l_suppkey AS payer_id,
              CAST(l_orderkey AS VARCHAR) AS encounter_id, lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS code,
              'Part "' || l_partkey || '", ' || l_returnflag AS description,
              CAST(l_extendedprice AS DECIMAL(18,2)) AS base_cost, CAST(0.5 AS DECIMAL(18,2)) AS payer_coverage,
              CAST(l_quantity AS BIGINT) AS dispenses, CAST(l_extendedprice AS DECIMAL(18,2)) AS total_cost,
              CASE WHEN l_returnflag = 'R' THEN 'R1' END AS reason_code, CAST(NULL AS VARCHAR) AS reason_description
       FROM v_line"""
)
def csv_typed_load(spark: SparkSession, folder: str) -> DataFrame:
    """Write, load, conform: every value survives, leading zeros and quotes included."""
    view = conformed(loaded(spark, folder), "medications")
    return view.drop("source_filename", "source_file_row_number", "loaded_at", "load_batch_id")


@query("SELECT COUNT(*) AS row_count, CAST(0 AS BIGINT) AS wrong_files, 1 AS batches, 1 AS load_times FROM lineitem")
def csv_lineage_load(spark: SparkSession, folder: str) -> DataFrame:
    """Row numbers run from 1 without a gap in every file; one batch, one time."""
    per_file = loaded(spark, folder).groupBy("source_filename").agg(
        F.count("*").alias("n"),
        F.min("source_file_row_number").alias("low"),
        F.max("source_file_row_number").alias("high"),
        F.sum("source_file_row_number").alias("total"),
        F.min("load_batch_id").alias("batch"),
        F.min("loaded_at").alias("at"),
    )
    gapless = (
        (F.col("low") == 1) & (F.col("high") == F.col("n"))
        & (F.col("total") == (F.col("n") * (F.col("n") + 1) / 2).cast("bigint"))
    )
    return per_file.agg(
        F.sum("n").alias("row_count"),
        F.count_if(~gapless).alias("wrong_files"),
        F.count_distinct("batch").cast("int").alias("batches"),
        F.count_distinct("at").cast("int").alias("load_times"),
    )


@query("SELECT CAST(l_orderkey AS VARCHAR) AS encounter, lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS code FROM v_line")
def csv_by_name_load(spark: SparkSession, folder: str) -> DataFrame:
    """Two columns matched to the header by name, in another case and order."""
    df = L.load_table(
        spark, written(spark, folder), "medications", "b", datetime.now(timezone.utc), ("encounter", "Code")
    )
    return df.select("encounter", "code")


def fact_folder(source: Source) -> str:
    """Facts of the given tables as files: procedures without their code, care plans not at all; three member files."""
    folder, lines = scratch_path(source.spark, "facts"), source.order_lines()
    day, order = F.date_format("o_orderdate", STAMP), text("l_orderkey")
    part = F.lpad(text("l_partkey"), 9, "0")
    orders = source.table("orders")
    own, start = text("o_custkey").alias("PATIENT"), F.date_format("o_orderdate", STAMP).alias("START")
    files = {
        "medications": lines.where("l_returnflag = 'R'").select(day.alias("START"), own, order.alias("ENCOUNTER"), part.alias("CODE")),
        "conditions": lines.where("l_returnflag = 'A'").select(own, part.alias("CODE"), day.alias("START"), order.alias("ENCOUNTER")),
        "procedures": lines.where("l_returnflag = 'N'").select(day.alias("START"), own, order.alias("ENCOUNTER")),
        "allergies": orders.select(start, own, text("o_orderkey").alias("ENCOUNTER"), text("o_orderkey").alias("CODE")),
        "encounters": orders.select(text("o_orderkey").alias("Id"), start, own, F.col("o_orderstatus").alias("CODE")),
        "immunizations": source.table("events").select(
            F.date_format("ts", STAMP).alias("DATE"), F.concat(F.lit(" "), text("user_id"), F.lit(" ")).alias("PATIENT"),
            text("event_id").alias("ENCOUNTER"), F.col("event_type").alias("CODE"),
        ),
        "patients": source.table("customer").select(text("c_custkey").alias("Id")),
        "nobody": source.table("customer").select(F.lit(" ").alias("Id")),
        "unnamed": source.table("customer").select(text("c_custkey").alias("Key")),
    }
    for name, rows in files.items():
        rows.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(
            f"{folder}/{name}.csv"
        )
    return folder


@query(
    """SELECT 'medications' AS csv_table, COUNT(*) AS facts, COUNT(DISTINCT o_custkey) AS members, '' AS problem
       FROM v_line WHERE l_returnflag = 'R'
       UNION ALL SELECT 'conditions', COUNT(*), COUNT(DISTINCT o_custkey), '' FROM v_line WHERE l_returnflag = 'A'
       UNION ALL SELECT 'allergies', COUNT(*), COUNT(DISTINCT o_custkey), '' FROM orders
       UNION ALL SELECT 'encounters', COUNT(*), COUNT(DISTINCT o_custkey), '' FROM orders
       UNION ALL SELECT 'immunizations', COUNT(*), COUNT(DISTINCT user_id), '' FROM events
       UNION ALL SELECT 'procedures', 0, 0, 'procedures.csv missing columns CODE'
       UNION ALL SELECT 'careplans', 0, 0, 'missing reconciliation file careplans.csv for careplans'
       UNION ALL SELECT '', 0, COUNT(*), '' FROM customer
       UNION ALL SELECT '', 0, 0, 'nobody.csv has no patient ids' UNION ALL SELECT '', 0, 0, 'unnamed.csv has no Id column'
       UNION ALL SELECT '', 0, 0, 'cannot read absent.csv'"""
)
def tolerant_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Facts and members of files of which some are absent, lack a column or are empty, each a row."""
    place = fact_folder(Source(spark, folder))
    facts, failures = FA.available_facts(spark, place)
    found = facts.groupBy("csv_table").agg(F.count("*").alias("facts"), F.count_distinct("patient_id").alias("members"))
    members = [FA.available_members(spark, place, name) for name in ("patients", "nobody", "unnamed", "absent")]
    known = members[0][0].agg(F.count("*").alias("members")).select(F.lit("").alias("csv_table"), "members")
    rows = found.unionByName(known, allowMissingColumns=True)
    for _, failed in [(None, failures), *members]:
        rows = rows.unionByName(failed.drop("kind"), allowMissingColumns=True)
    none = F.lit(0).cast("long")
    return rows.select(
        "csv_table", F.coalesce("facts", none).alias("facts"), F.coalesce("members", none).alias("members"),
        F.coalesce("problem", F.lit("")).alias("problem"),
    )


@query(
    """SELECT 'first' AS load, COUNT(*) AS loaded, 0 AS refused, COUNT(*) AS table_rows, SUM(o_orderkey) AS table_sum
       FROM orders WHERE o_orderstatus = 'F'
       UNION ALL
       SELECT 'refused', 0, COUNT(*) FILTER (o_orderstatus = 'P'), COUNT(*) FILTER (o_orderstatus = 'F'),
              SUM(o_orderkey) FILTER (o_orderstatus = 'F') FROM orders
       UNION ALL SELECT 'second', COUNT(*), 0, COUNT(*), SUM(o_orderkey) FROM orders"""
)
def table_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """A catalog table replaced twice, and once not, because a check of the load failed in between."""
    database = f"refreshed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch_path(spark, 'database')}'")
    orders, name = Source(spark, folder).table("orders"), f"{database}.orders"
    pending, table, log = F.col("o_orderstatus") == "P", f"{database}.log", []

    def noted(load: str, loaded: int, refused: int) -> None:
        now = spark.table(name).agg(F.count("*"), F.sum("o_orderkey")).first()
        log.append((load, loaded, refused, now[0], now[1]))

    noted_first = L.refresh(orders.where("o_orderstatus = 'F'"), name, {"pending": pending})
    noted("first", noted_first["row_count"], noted_first["pending"])
    try:
        L.refresh(orders.select(*reversed(orders.columns)), name, {"pending": pending})
    except ValueError as stopped:
        noted("refused", 0, int(str(stopped).rsplit(" ", 1)[1]))
    noted("second", L.refresh(orders.select(*reversed(orders.columns)), name)["row_count"], 0)
    schema = "load string, loaded long, refused long, table_rows long, table_sum long"
    L.refresh(spark.createDataFrame(log, schema), table)
    return spark.table(table)


@query()
def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Size and digest of each given file."""
    return S.file_manifest(spark, folder, "*.parquet")
