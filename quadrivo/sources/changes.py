"""What changed on the platform since a time, as a streaming source, so that the time asked from is a streaming offset that a checkpoint keeps."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.history import asked_since
from .platform import FUNCTIONS, Client
from .shipping import ship

#: Courses that a task asks about.
TOGETHER = 16


class _Courses(InputPartition):
    def __init__(self, ids: list[int], since: int, until: int):
        super().__init__(json.dumps([ids, since, until]))
        self.ids, self.since, self.until = ids, since, until


class _Reader(DataSourceStreamReader):
    """An offset is the second up to which changes were asked for; 0 means that nothing was read yet. A batch asks from a little before its start, so a change that was stored late is told twice, not never."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def _client(self) -> Client:
        return Client(self.options["base"], self.options["token"], float(self.options.get("timeout", 30)))

    def initialOffset(self) -> dict:
        return {"since": int(self.options.get("since", 0))}

    def latestOffset(self) -> dict:
        return {"since": int(time.time())}

    def partitions(self, start: dict, end: dict) -> list[_Courses]:
        client = self._client()
        ids = sorted(int(c["id"]) for c in client.call(FUNCTIONS["courses"], userid=client.user_id()))  # the courses of one student
        return [_Courses(ids[i : i + TOGETHER], start["since"], end["since"]) for i in range(0, len(ids), TOGETHER)]

    def read(self, partition: _Courses) -> Iterator[tuple]:
        client, since = self._client(), asked_since(partition.since)
        for course in partition.ids:
            if not partition.since:
                yield course, None, partition.until, 0, 0
                continue
            said = client.call(FUNCTIONS["updates"], courseid=course, since=since)
            yield course, since, partition.until, len(said.get("instances") or ()), len(said.get("warnings") or ())

    def commit(self, end: dict) -> None:
        pass


class ChangeFeed(DataSource):
    """readStream.format("course_changes"): a row for each course and batch: since (null: everything is new), until, and how many instances and warnings the platform tells of; options base, token, since (default 0)."""

    @classmethod
    def name(cls) -> str:
        return "course_changes"

    def schema(self) -> str:
        return "course_id long, since long, until long, n_instances long, n_warnings long"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Reader(self.options)


def feed(spark: SparkSession, base: str, token: str, since: int = 0) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("course_changes").options(base=base, token=token, since=str(since)).load()
