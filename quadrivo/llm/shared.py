"""Reading tables, and writing intermediate tables where every executor can reach them."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import drop_path, new_path, open_path, scratch, shared_dir, written  # noqa: F401
from ..sources.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


@lru_cache(maxsize=64)
def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromJson(json.loads(ddl)))


def batch_of(columns: list, schema: T.StructType) -> pa.RecordBatch:
    """An Arrow batch of columns (lists, numpy arrays or Arrow arrays) in the schema's order."""
    arrow = _arrow(schema.json())
    made = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
    return pa.RecordBatch.from_arrays(made, schema=arrow)


def arrow_map(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """df.mapInArrow with this package at the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def stored_rows(path: str, part: int, columns: list[str], key: str, value: int) -> pa.Table:
    """Rows with this key of a table that was written by part, read by a Python worker."""
    import pyarrow.dataset as ds

    store, place = open_path(f"{path}/part={part}")
    return ds.dataset(place, filesystem=store, format="parquet").to_table(columns=columns, filter=ds.field(key) == value)
