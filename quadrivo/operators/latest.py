"""The one definition of "latest": the last row of each key in an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import as_column


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows that come last by `order` (descending, nulls last) within their keys: one for each. Spark limits each task's rows to one a key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*(as_column(o).desc_nulls_last() for o in order))
    return df.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")


def latest_versions(versions: DataFrame) -> DataFrame:
    """The version of each resource with the highest number."""
    return latest_by(versions, ["resource_id"], ["version_number", "id"])


def latest_extractions(extractions: DataFrame, depth: str | None = None) -> DataFrame:
    """The attempt of each version with the highest id: at one depth, or at any."""
    rows = extractions if depth is None else extractions.filter(F.col("depth") == depth)
    return latest_by(rows, ["resource_version_id"], ["id"])


def next_version_numbers(resources: DataFrame, versions: DataFrame) -> DataFrame:
    """id, next_number of each resource: one more than its latest version's, or 1."""
    last = versions.groupBy("resource_id").agg(F.max("version_number").alias("_last"))
    return resources.join(last, resources.id == last.resource_id, "left").select("id", (F.coalesce("_last", F.lit(0)) + 1).cast("bigint").alias("next_number"))


def version_history(fetched: DataFrame) -> DataFrame:
    """The versions that fetches (resource_id, seq, content_hash) make in order: one whenever the hash is not the previous fetch's, numbered from 1."""
    by = Window.partitionBy("resource_id").orderBy("seq")
    changed = F.row_number().over(by).eqNullSafe(1) | ~F.col("content_hash").eqNullSafe(F.lag("content_hash").over(by))
    return (
        fetched.withColumn("_new", changed)
        .withColumn("version_number", F.sum(F.col("_new").cast("bigint")).over(by))
        .filter("_new")
        .select("resource_id", "version_number", "seq", "content_hash")
    )
