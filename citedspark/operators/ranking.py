"""Top rows per key, and positions that stay cheap when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citedspark.session import written

_SLICE = "_slice"


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int, position: str = "position"
) -> DataFrame:
    """The first rows of every key.

    The filter on row_number lets Spark cut each key to `count` rows before the shuffle,
    so a hot key costs `count` rows per input partition.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= count)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str
) -> DataFrame:
    """Sum of `value` over the rows before each row, per key, without one task per key.

    Rows are range-partitioned by key and order, so a hot key is cut into many slices.
    The slices are written once (their bounds come from sampling); each slice sums its own
    rows, and the slice totals, a few per key, carry the sums across. Keys must not be NULL.
    """
    spark = df.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(
        df.withColumn("_value", value.cast("long"))
        .repartitionByRange(slices, *keys, *order)
        .withColumn(_SLICE, F.spark_partition_id()),
        "slices",
    )
    before = Window.unboundedPreceding, -1
    local = Window.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(*before)
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_SLICE).rowsBetween(*before)
    offsets = (
        placed.groupBy(*keys, _SLICE)
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(across), F.lit(0)))
        .drop("_sum")
    )
    return (
        placed.withColumn("_local", F.coalesce(F.sum("_value").over(local), F.lit(0)))
        .join(offsets, [*keys, _SLICE])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", "_value", _SLICE)
    )


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1, 2, 3 ... per key in the given order, whatever the size of a key; keys must not be NULL."""
    ranked = running_total(df, keys, order, F.lit(1), out)
    return ranked.select(*df.columns, (F.col(out) + 1).cast("int").alias(out))
