"""Total orders of whole tables: sorted once, and kept."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.parts import parts
from ..sources.scratch import drop_path, new_path, written
from ..sources.shipping import ship


def _spare(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def ranged(df: DataFrame, order: Sequence[Column], key: str) -> tuple[DataFrame, str, str, str]:
    """df sorted and written down, with three more columns (whose names follow): the key of the row before it in its range, the number of its range, and its place there, from 0.

    Each range is a task's part of the one sort, numbered as it is written; so nothing that reads the table afterwards depends on how the sort
    was planned or how its partitions were joined together.
    """
    names = [_spare(df, c) for c in ("_before", "_range", "_place")]
    schema = T.StructType([*df.schema, T.StructField(names[0], df.schema[key].dataType), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.LongType())])
    at = df.columns.index(key)
    ship(df.sparkSession)

    def run(batches):
        number, n, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            rows, keys = b.num_rows, b.column(at)
            if rows:
                before = pa.concat_arrays([pa.nulls(1, keys.type) if last is None else last, keys.slice(0, rows - 1)])
                yield pa.RecordBatch.from_arrays([*b.columns, before, pa.array(np.full(rows, number)), pa.array(np.arange(n, n + rows))], names=[f.name for f in schema])
                n, last = n + rows, keys.slice(rows - 1, 1)

    # The rows are written and so counted first: a task sorts a range of about as many rows at any size, and what makes the rows runs once, not for the sample of the ranges too.
    path = new_path(df.sparkSession, "unordered")
    held = written(df, "", path)
    n = parts(df.sparkSession, held.count())
    in_order = held.orderBy(*order) if n is None else held.repartitionByRange(n, *order).sortWithinPartitions(*order)
    made = written(in_order.mapInArrow(run, schema), "ranged")
    drop_path(df.sparkSession, path)
    return made, *names


def with_previous(df: DataFrame, order: Sequence[Column], key: str, name: str) -> DataFrame:
    """df with the key of the row before each in a total order (null for the first row). order has to decide every tie.

    One sort; the last key of each range, of which there is one a task, goes to the first row of the next range.
    """
    made, before, part, place = ranged(df, order, key)
    lasts = made.groupBy(F.col(part).alias("p")).agg(F.max_by(key, place).alias("last"))
    follows = lasts.select(F.lead("p").over(Window.orderBy("p")).alias("q"), "last").filter("q IS NOT NULL")
    first = F.col(place) == 0
    joined = made.join(F.broadcast(follows), first & (F.col(part) == F.col("q")), "left")
    return joined.select(*df.columns, F.when(first, F.col("last")).otherwise(F.col(before)).alias(name))
