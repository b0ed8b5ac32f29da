"""Structured facts that document cells are matched with, and the known member ids."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citedspark.fixed_values import FACT_TABLES
from citedspark.sources.flat_files import read_text_columns


def fact_pool(text_tables: dict[str, DataFrame]) -> DataFrame:
    """The given text tables as (csv_table, patient_id, code, start, encounter), all trimmed text."""

    def taken(name: str, df: DataFrame) -> DataFrame:
        start, encounter = FACT_TABLES[name]
        headed = {column.upper(): column for column in df.columns}
        missing = [c for c in ("PATIENT", "CODE", start, encounter) if c not in headed]
        if missing:
            raise ValueError(f"{name}: missing columns {', '.join(missing)}")

        def value(column: str):
            return F.coalesce(F.trim(F.col(f"`{headed[column]}`")), F.lit(""))

        return df.select(
            F.lit(name).alias("csv_table"),
            value("PATIENT").alias("patient_id"),
            value("CODE").alias("code"),
            value(start).alias("start"),
            value(encounter).alias("encounter"),
        )

    return reduce(DataFrame.unionByName, [taken(name, df) for name, df in text_tables.items()])


def read_facts(spark: SparkSession, folder: str, tables: tuple[str, ...] = tuple(FACT_TABLES)) -> DataFrame:
    return fact_pool({name: read_text_columns(spark, f"{folder}/{name}.csv") for name in tables})


def known_members(patients: DataFrame) -> DataFrame:
    """Distinct non-blank ids of the member file; the Id column must be there."""
    if "Id" not in patients.columns:
        raise ValueError("the member file has no Id column")
    return (
        patients.select(F.trim("Id").alias("patient_id")).filter(F.length("patient_id") > 0).distinct()
    )


# --- sources that may be incomplete ---------------------------------------------
FAILURE = "kind string, csv_table string, problem string"


def _listed(spark: SparkSession, folder: str) -> set[str]:
    """Names of the .csv files (or folders of parts) below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        paths = files.load(folder).select("path")
    except AnalysisException:  # no such folder
        return set()
    names = paths.select(F.regexp_extract("path", r"/([^/]+)\.csv(?:/|$)", 1).alias("name")).distinct()
    return {row["name"] for row in names.collect()}  # at most one for each declared file and a few others


def available_facts(
    spark: SparkSession, folder: str, narrative: DataFrame | None = None, tables: tuple[str, ...] = tuple(FACT_TABLES)
) -> tuple[DataFrame, DataFrame]:
    """(facts, failures): what the files of a folder give, and a row for each that gives nothing.

    Files and headers are compared with the declared ones before any row is read. An absent file is
    a failure only where `narrative` (cells with csv_table; None: any) has cells for it; a file
    without a needed column always is.
    """
    present, absent, lacking = _listed(spark, folder), [], []
    usable: dict[str, DataFrame] = {}
    for name in tables:
        if name not in present:
            absent.append(("count", name, f"missing reconciliation file {name}.csv for {name}"))
            continue
        text = read_text_columns(spark, f"{folder}/{name}.csv")
        headed = {column.upper() for column in text.columns}
        missing = [column for column in ("PATIENT", "CODE", *FACT_TABLES[name]) if column not in headed]
        if missing:
            lacking.append(("count", name, f"{name}.csv missing columns {', '.join(missing)}"))
        else:
            usable[name] = text
    failures = spark.createDataFrame(absent, FAILURE)
    if narrative is not None:
        failures = failures.join(narrative.where("csv_table <> ''").select("csv_table").distinct(), "csv_table", "left_semi")
        failures = failures.select("kind", "csv_table", "problem")
    nothing = spark.createDataFrame([], "csv_table string, patient_id string, code string, start string, encounter string")
    return fact_pool(usable) if usable else nothing, failures.unionByName(spark.createDataFrame(lacking, FAILURE))


def available_members(spark: SparkSession, folder: str, name: str = "patients") -> tuple[DataFrame, DataFrame]:
    """(members, failures): the ids of the member file, and a row where it is absent, has no Id column or no id."""
    none = spark.createDataFrame([], "patient_id string")

    def failed(problem: str) -> DataFrame:
        return spark.createDataFrame([("identity", "", problem)], FAILURE)

    if name not in _listed(spark, folder):
        return none, failed(f"cannot read {name}.csv")
    text = read_text_columns(spark, f"{folder}/{name}.csv")
    if "Id" not in text.columns:
        return none, failed(f"{name}.csv has no Id column")
    members = known_members(text)
    empty = members.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    return members, empty.select(
        F.lit("identity").alias("kind"), F.lit("").alias("csv_table"), F.lit(f"{name}.csv has no patient ids").alias("problem")
    )
