"""Messages sent by the tasks that hold them, with a receipt for each."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .scratch import open_path
from .shipping import ship
from .sinks import Message, Sink, safe_error

IDENTITY = ["notification_type", "subject_key", "scheduled_for"]
RECEIPT = pa.schema([*((c, pa.string()) for c in IDENTITY), ("error", pa.string())])
RECEIPTS = "notification_type string, subject_key string, scheduled_for string, error string"


@dataclass
class Sent(WriterCommitMessage):
    """What a task that ended well has to say: where its receipts are."""

    file: str


class Outbox(DataSourceWriter):
    """Sends rows (identity, title, body) and writes a receipt for each, sent or not. A task that is lost sends its own rows again, no others; only the receipts of tasks that ended well are listed, when all have."""

    def __init__(self, sink: Sink, path: str):
        self.sink, self.path = sink, path

    def write(self, rows: Iterator[Row]) -> Sent:
        receipts: list[dict] = []
        for r in rows:
            receipts.append({c: r[c] for c in IDENTITY} | {"error": None})
            try:
                self.sink.send(Message(r["notification_type"], r["title"], r["body"]))
            except Exception as e:  # noqa: BLE001 - one message never stops the rest
                receipts[-1]["error"] = safe_error(e)
        store, place = open_path(self.path)
        store.create_dir(place, recursive=True)
        file = f"receipts-{uuid.uuid4().hex}.parquet"
        pq.write_table(pa.Table.from_pylist(receipts, RECEIPT), f"{place}/{file}", filesystem=store)
        return Sent(file)

    def _listed(self, messages: list) -> None:
        store, place = open_path(self.path)
        store.create_dir(place, recursive=True)
        with store.open_output_stream(f"{place}/LIST") as f:
            f.write(json.dumps([m.file for m in messages if m is not None]).encode())

    def commit(self, messages: list) -> None:
        self._listed(messages)

    def abort(self, messages: list) -> None:
        self._listed(messages)  # what was sent was sent


def send(messages: DataFrame, sink: Sink, path: str) -> DataFrame:
    """Sends messages (IDENTITY, title, body) on the executors; a receipt for each, read from path, with error null if it was sent.

    The sink travels within the writer's code, so no secret of it is an option that a plan would show.
    """

    class Format(DataSource):
        @classmethod
        def name(cls) -> str:
            return "outbox"

        def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
            return Outbox(sink, path)

    spark = messages.sparkSession
    ship(spark)
    spark.dataSource.register(Format)
    messages.select(*IDENTITY, "title", "body").write.format("outbox").mode("append").save()
    return receipts(messages, path)


def receipts(messages: DataFrame, path: str) -> DataFrame:
    """What was listed at path, if anything was."""
    spark = messages.sparkSession
    store, place = open_path(path)
    if store.get_file_info(f"{place}/LIST").type == pafs.FileType.NotFound:
        return spark.createDataFrame([], RECEIPTS)
    with store.open_input_stream(f"{place}/LIST") as f:
        files = json.loads(f.read())
    return spark.read.schema(RECEIPTS).parquet(*(f"{path}/{name}" for name in files)) if files else spark.createDataFrame([], RECEIPTS)
