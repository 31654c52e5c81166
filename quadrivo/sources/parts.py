"""Tables dealt out in parts of a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: About as many rows as a task takes for each of its sorts; and the most where there would be over STRAIGHT parts, up to which Spark's tasks write the parts
#: straight to files, while for more of them they hold the rows of a whole split.
ROWS, MOST, STRAIGHT = 1 << 17, 1 << 21, 200


def parts(spark: SparkSession, rows: int) -> int | None:
    """In how many parts to deal out so many rows; None where they are few, and may lie as they do."""
    return None if rows <= ROWS else max(-(-rows // MOST), min(STRAIGHT, max(-(-rows // ROWS), spark.sparkContext.defaultParallelism)))


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt out by columns for so many rows. Shuffle partitions are a fixed number, or joined together by their compressed bytes, so that what a task
    sorts grows with the table and with how well it compresses; these parts hold ROWS to MOST rows at any size. What is dealt for as many rows by the columns of a join is met without another shuffle."""
    n = parts(df.sparkSession, rows)
    return df if n is None else df.repartition(n, *by)
