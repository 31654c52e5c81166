"""The learning platform's interface as a Spark data source, and downloads of files."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shipping import ship

MAX_BYTES, RETRIES, RETRY_STATUS = 64 << 20, 2, (502, 503, 504)
#: Functions of the platform's interface.
FUNCTIONS = {
    "site_info": "core_webservice_get_site_info", "courses": "core_enrol_get_users_courses", "contents": "core_course_get_contents",
    "timeline": "core_course_get_enrolled_courses_by_timeline_classification", "updates": "core_course_get_updates_since",
    "assignments": "mod_assign_get_assignments", "submission": "mod_assign_get_submission_status", "grades": "gradereport_user_get_grade_items", "calendar": "core_calendar_get_action_events_by_courses",
}


def flatten(params: object, prefix: str = "") -> dict[str, str]:
    """Nested parameters as form fields: {"a": [{"b": True}]} is {"a[0][b]": "1"}."""
    if isinstance(params, (list, tuple)):
        params = dict(enumerate(params))
    if isinstance(params, dict):
        out: dict[str, str] = {}
        for key, value in params.items():
            out |= flatten(value, f"{prefix}[{key}]" if prefix else str(key))
        return out
    return {prefix: "" if params is None else str(int(params)) if isinstance(params, bool) else str(params)}


def form_fields(df: DataFrame, params: str, *keys: str) -> DataFrame:
    """keys, field, value: nested parameters (a column of JSON text) as form fields, a row for each, by the same rules as flatten; of any depth, level by level. An empty object or list has none, and neither has a null."""
    spark, out = df.sparkSession, None
    rows = df.select(*keys, F.lit("").alias("field"), F.parse_json(params).alias("_v")).filter("_v IS NOT NULL")
    while True:
        kind = F.schema_of_variant("_v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        value = F.when(kind == "VOID", "").when(kind == "BOOLEAN", F.try_variant_get("_v", "$", "boolean").cast("int").cast("string")).otherwise(F.try_variant_get("_v", "$", "string"))
        leaves = rows.filter(~nested).select(*keys, "field", value.alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        inner = rows.filter(nested)
        if inner.isEmpty():
            return out
        below = inner.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_w")))
        name = F.coalesce("_key", F.col("_pos").cast("string"))
        rows = below.select(*keys, F.when(F.col("field") == "", name).otherwise(F.concat("field", F.lit("["), name, F.lit("]"))).alias("field"), F.col("_w").alias("_v"))


class ApiError(RuntimeError):
    def __init__(self, code: str, said: str, auth: bool):
        super().__init__(f"{code}: {said}")
        self.code, self.auth = code, auth


class TooLarge(RuntimeError):
    def __init__(self, size: int | None, most: int):
        super().__init__(f"{size if size is not None else 'more than allowed'} bytes; the limit is {most}")
        self.size, self.most = size, most


@dataclass
class Client:
    """Calls to one host. A token goes nowhere else."""

    base: str
    token: str
    timeout: float = 30
    most_bytes: int = MAX_BYTES
    open: Callable = urllib.request.urlopen
    sleep: Callable[[float], None] = time.sleep
    _user: int | None = field(default=None, repr=False)

    def call(self, function: str, **params) -> object:
        form = urllib.parse.urlencode(flatten(params) | {"wstoken": self.token, "wsfunction": function, "moodlewsrestformat": "json"}).encode()
        for attempt in range(RETRIES + 1):
            try:
                with self.open(urllib.request.Request(f"{self.base}/webservice/rest/server.php", form), timeout=self.timeout) as reply:
                    said = json.loads(reply.read())
                break
            except urllib.error.HTTPError as e:
                if e.code not in RETRY_STATUS or attempt == RETRIES:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if attempt == RETRIES:
                    raise
            self.sleep(attempt + 1.0)
        return checked(said)

    def user_id(self) -> int:
        if self._user is None:
            self._user = int(self.call(FUNCTIONS["site_info"])["userid"])
        return self._user

    def trusts(self, url: str) -> bool:
        there, here = urllib.parse.urlsplit(url), urllib.parse.urlsplit(self.base)
        return (there.hostname or "").lower() == (here.hostname or "").lower() and (there.scheme == "https" or there.scheme == here.scheme == "http")

    def download(self, url: str) -> bytes:
        """A file's bytes: whole, not over the limit, and no error reply in disguise."""
        if not self.trusts(url):
            raise PermissionError("not the platform's address")
        parts = urllib.parse.urlsplit(url)
        query = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query, keep_blank_values=True) if k.lower() != "token"]
        with self.open(parts._replace(query=urllib.parse.urlencode([*query, ("token", self.token)])).geturl(), timeout=self.timeout) as reply:
            told = (reply.headers.get("Content-Length") or "").strip()
            size = int(told) if told.isdigit() else None
            if size is not None and size > self.most_bytes:
                raise TooLarge(size, self.most_bytes)
            body = reply.read(self.most_bytes + 1)
            kind = reply.headers.get("Content-Type") or ""
        if len(body) > self.most_bytes:
            raise TooLarge(None, self.most_bytes)
        if not body or size is not None and len(body) < size:
            raise ConnectionError(f"{len(body)} of {size} bytes came")
        if "json" in kind:
            try:
                said = json.loads(body)
            except ValueError:
                return body
            checked(said)
        return body


def checked(said: object) -> object:
    """A reply, unless it reports an error."""
    if isinstance(said, dict) and "exception" in said and "errorcode" in said:
        code = str(said["errorcode"])
        raise ApiError(code, str(said.get("message", "")), code in ("invalidtoken", "invalidlogin"))
    return said


@dataclass
class _Call(InputPartition):
    function: str
    params: str

    def __init__(self, function: str, params: str):
        super().__init__((function, params))
        self.function, self.params = function, params


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[_Call]:
        return [_Call(self.options["function"], p) for p in json.loads(self.options.get("calls", "[{}]"), parse_constant=str) for p in [json.dumps(p)]]

    def read(self, partition: _Call) -> Iterator[tuple]:
        client = Client(self.options["base"], self.options["token"], float(self.options.get("timeout", 30)))
        made = json.loads(partition.params)
        yield partition.params, json.dumps(client.call(partition.function, **made))


class PlatformSource(DataSource):
    """format("platform"): params, payload (both JSON text) for each call; options base, token, function, calls (a JSON array of parameter objects, a partition each)."""

    @classmethod
    def name(cls) -> str:
        return "platform"

    def schema(self) -> str:
        return "params string, payload string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


def systemic(e: BaseException | None) -> bool:
    """Whether an error, or one that caused it, will meet every further item too, as a refused token does."""
    while e is not None:
        if isinstance(e, ApiError) and e.auth:
            return True
        e = e.__cause__ or e.__context__
    return False


def calls(spark: SparkSession, base: str, token: str, function: str, params: list[dict] | DataFrame) -> DataFrame:
    """params, payload (both JSON text) of a call for each parameter object: those of a list, or of a table with a column params, whose rows stay on the executors."""
    ship(spark)
    if isinstance(params, DataFrame):
        return _called(params, base, token, FUNCTIONS.get(function, function))
    spark.dataSource.register(PlatformSource)
    return spark.read.format("platform").options(base=base, token=token, function=FUNCTIONS.get(function, function), calls=json.dumps(params)).load()


def _called(params: DataFrame, base: str, token: str, function: str) -> DataFrame:
    def run(batches):
        client = Client(base, token)
        for b in batches:
            for given in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"params": [given], "payload": [json.dumps(client.call(function, **json.loads(given)))]})

    return params.select("params").mapInArrow(run, "params string, payload string")


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Recorded payloads, a line of {"params": ..., "payload": ...} for each call, in the source's columns."""
    rows = spark.read.text(path)
    return rows.selectExpr("get_json_object(value, '$.params') AS params", "get_json_object(value, '$.payload') AS payload")


def downloads(urls: DataFrame, base: str, token: str, url: str = "fileurl") -> DataFrame:
    """url, outcome (done, too_large, failed), size_bytes, content, error for each address; a failure never stops the rest, unless it is systemic."""
    import pandas as pd

    def run(batches):
        client = Client(base, token)
        for b in batches:
            rows = []
            for u in b[url]:
                try:
                    body = client.download(u)
                    rows.append((u, "done", len(body), body, None))
                except TooLarge as e:
                    rows.append((u, "too_large", e.size, None, str(e)))
                except Exception as e:  # noqa: BLE001 - recorded row by row
                    if systemic(e):
                        raise
                    rows.append((u, "failed", None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "outcome", "size_bytes", "content", "error"]).astype({"size_bytes": "Int64"})

    ship(urls.sparkSession)
    return urls.select(url).mapInPandas(run, "url string, outcome string, size_bytes long, content binary, error string")
