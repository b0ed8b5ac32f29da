"""Raw tables to conformed views. A view is a lazy projection, never a copy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citedspark.functions.columns import whole_number
from citedspark.schemas import LINEAGE, MEMBER_COLUMNS, TABLES, Table

Core = Mapping[str, DataFrame]


def conformed(raw: DataFrame, table: Table | str) -> DataFrame:
    """Rename to the conformed names, lineage last; the member view is minimised."""
    table = TABLES[table] if isinstance(table, str) else table
    source = [name for name in raw.columns if name not in LINEAGE]
    if table.view == "patient":
        kept = {name.upper(): name for name in source}
        columns = [F.col(kept[name]).alias(alias) for name, alias in MEMBER_COLUMNS.items()]
    else:
        columns = [F.col(f"`{name}`").alias(table.view_name(name)) for name in source]
    if table.view == "observation":
        columns.append(whole_number(F.col("value")).alias("value_numeric"))
    return raw.select(*columns, *[name for name in LINEAGE if name in raw.columns])


def read_core(spark: SparkSession, target: str, files: tuple[str, ...] = tuple(TABLES)) -> dict[str, DataFrame]:
    """All conformed views over the loaded tables of a folder."""
    return {
        TABLES[name].view: conformed(spark.table(f"{target}.{name}"), name) for name in files
    }


def register(core: Core) -> None:
    """Publish the views under their names, for SQL users."""
    for name, df in core.items():
        df.createOrReplaceTempView(name)
