"""Tables as logs of parts, backups, and the content-addressed store of originals."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from threading import RLock

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commit_log import BUCKET_BYTES, Log, Part, buckets_for, due
from .schema import COLUMNS, PURGED, after_purge, empty, identity, looked_up_by, schema

#: Bytes that stay free on the file system of originals.
RESERVE = 1 << 30
#: Backups that are kept.
BACKUPS = 14
#: Seconds for which a folder stays after nothing names it any more.
GRACE = 24 * 3600


def _bucket(by: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int").alias("_bucket")



_locks: dict[str, RLock] = {}


class Files:
    """Small text files of a folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf, self.gateway, self.folder = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway, folder
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        """The files' names in order; hidden ones are left out."""
        found = self.fs.listStatus(self._at("")) if self.fs.exists(self._at("")) else []
        return sorted(n for f in found for n in [f.getPath().getName()] if n[0] not in "._")

    def read(self, name: str) -> str | None:
        """A file's text; None where there is no such file."""
        if not self.fs.exists(self._at(name)):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _written(self, text: str):
        part = self._at(f".{uuid.uuid4().hex}")
        out = self.fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        return part

    def _renamed(self, part, name: str, over: bool) -> None:
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.gateway.new_array(options, 1)
        array[0] = options.OVERWRITE if over else options.NONE
        uri = part.toUri() if part.toUri().getScheme() else self.fs.getUri()
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.conf).rename(self.fs.makeQualified(part), self.fs.makeQualified(self._at(name)), array)

    def replace(self, name: str, text: str) -> None:
        """Puts a file in place of one of that name, whole at any moment."""
        self._renamed(self._written(text), name, True)

    def create(self, name: str, text: str) -> bool:
        """Makes a file unless there is one of that name; whether it did."""
        part = self._written(text)
        try:
            self._renamed(part, name, False)
        except Py4JJavaError:
            self.fs.delete(part, False)
            return False
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), False)


class Warehouse:
    """Tables as logs of Parquet parts below a folder that all executors reach.

    A commit writes parts (all rows anew, rows that are added, rows that take the place of others, ends of rows) and then replaces the small file that names the
    parts of all tables, so readers see all of a change or nothing of it, and nothing is overwritten while it is read. Small parts are merged by
    size, large ones lie in buckets by the columns that rows are looked up by. Folders that are named no more stay for a while, for who still reads them.
    """

    def __init__(self, spark: SparkSession, root: str, now: Callable[[], float] = time.time):
        self.spark, self.root, self.now = spark, root.rstrip("/"), now
        #: Held while the log is read and replaced. Another process doesn't change it: see the lease.
        self._lock = _locks.setdefault(self.root, RLock())
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- reading ---

    def log(self) -> Log:
        """The parts of all tables, as last committed."""
        return Log.parsed(self.files("").read("CURRENT") or "")

    def __getitem__(self, table: str) -> DataFrame:
        if table not in COLUMNS:
            raise KeyError(table)
        if table == "requests":
            return self.requests(self.request_files())
        return self._rows(table, self.log().parts.get(table, ()))

    def find(self, table: str, wanted: DataFrame) -> DataFrame:
        """A table's rows of the wanted keys (a DataFrame of the columns by which the table is looked up, or more), of whose large parts only the buckets of those keys are read."""
        by = looked_up_by(table)
        keys = wanted.select(*(F.col(c).cast(schema(table)[c].dataType).alias(c) for c in by)).distinct()
        rows = self._rows(table, self.log().parts.get(table, ()), keys)
        return rows.join(keys, by, "left_semi").select(*rows.columns)

    def _rows(self, table: str, parts: Sequence[Part], wanted: DataFrame | None = None) -> DataFrame:
        """The rows that parts make up."""
        return self._resolved(table, parts, wanted, ends=False).drop("_gone")

    def _read(self, table: str, part: Part, wanted: DataFrame | None) -> DataFrame:
        columns = T.StructType([*schema(table), *([T.StructField("_gone", T.BooleanType())] if part.over else []), *([T.StructField("_bucket", T.IntegerType())] if part.buckets else [])])
        rows = self.spark.read.schema(columns).parquet(f"{self.root}/{part.path}")
        if part.buckets and wanted is not None:
            some = [r[0] for r in wanted.select(_bucket(looked_up_by(table), part.buckets)).distinct().collect()]  # as many as there are buckets at most
            rows = rows.filter(F.col("_bucket").isin(some)) if len(some) < part.buckets else rows
        return rows.drop("_bucket") if part.over else rows.drop("_bucket").withColumn("_gone", F.lit(None).cast("boolean"))

    def _resolved(self, table: str, parts: Sequence[Part], wanted: DataFrame | None = None, ends: bool = True) -> DataFrame:
        """What is left of parts, with _gone for the ends of rows that may lie in earlier parts."""
        names, key = [f.name for f in schema(table)], identity(table)
        runs: list[tuple[int, DataFrame]] = []  # plain rows, of parts between the same over parts as one
        overs: list[tuple[int, DataFrame]] = []
        for n, part in enumerate(parts):
            rows = self._read(table, part, wanted)
            if part.over:
                overs.append((n, rows))
            elif runs and not any(runs[-1][0] < m for m, _ in overs):
                runs[-1] = (n, runs[-1][1].unionByName(rows))
            else:
                runs.append((n, rows))
        if not overs:
            return reduce(DataFrame.unionByName, (rows for _, rows in runs)) if runs else empty(self.spark, table).withColumn("_gone", F.lit(None).cast("boolean"))
        every = reduce(DataFrame.unionByName, (rows.withColumn("_part", F.lit(n)) for n, rows in overs))
        if len(overs) > 1:
            every = every.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_part")))).filter("_nth = 1").drop("_nth")
        later = every.select(*(F.col(c).alias(f"_{c}") for c in key), F.col("_part").alias("_later"))
        same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}") for c in key))
        left = [rows.join(later.filter(F.col("_later") > n), same, "left_anti") if n < overs[-1][0] else rows for n, rows in runs]
        newest = every.drop("_part") if ends else every.drop("_part").filter("_gone IS NULL")
        return reduce(DataFrame.unionByName, [*left, newest]).select(*names, "_gone")

    # --- writing ---

    def commit(self, tables: Mapping[str, DataFrame] | None = None, *, append: Mapping[str, DataFrame] | None = None, put: Mapping[str, DataFrame] | None = None, drop: Mapping[str, DataFrame] | None = None) -> None:
        """All changes together. tables: their rows from now on; append: rows of new keys; put: rows that take the place of those with the same key, or are new; drop: keys of rows that end (before what is put)."""
        if any("requests" in (changes or {}) for changes in (tables, append, put, drop)):
            raise ValueError("requests are added one by one, by any process")
        new: list[tuple[str, Part, bool]] = []  # table, part, whether it is all of the table
        for name, df in (tables or {}).items():
            new.append((name, self._write(name, df.select(*(f.name for f in schema(name)))), True))
        for changes, over in ((append, False), (drop, True), (put, True)):
            for name, df in (changes or {}).items():
                ends = changes is drop
                rows = df.select(*(F.col(c) if not ends or c in identity(name) else F.lit(None).cast(f.dataType).alias(c) for f in schema(name) for c in [f.name]))
                rows = rows.withColumn("_gone", F.lit(True) if ends else F.lit(None).cast("boolean")) if over else rows
                new.append((name, self._write(name, rows, over, few=True), False))
        with self._lock:
            log = self.log()
            parts, gone = dict(log.parts), dict(log.gone)
            for name, part, whole in new:
                gone |= {p.path: self._ms() for p in parts.get(name, ()) if whole}
                parts[name] = (*(() if whole else parts.get(name, ())), part)
            self._name("CURRENT", Log(parts, log.last_ids, gone))
        for name in {name for name, _, _ in new}:
            self.merge(name)

    def merge(self, table: str, whole: bool = False) -> bool:
        """Merges a table's newest parts where enough of a size have come together, or all of them; a first part that has outgrown its buckets is dealt anew. Whether it did. Readers see the same rows before and after."""
        parts = self.log().parts.get(table, ())
        start, end = 0 if whole and len(parts) > 1 else due(parts), len(parts)
        if start is None and parts and buckets_for(parts[0].size) > 2 * parts[0].buckets:
            start, end = 0, 1
        if start is None:
            return False
        merged = parts[start:end]
        over = start > 0 and any(p.over for p in merged)
        rows = self._resolved(table, merged, ends=over)
        made = self._write(table, rows if over else rows.drop("_gone"), over, size=sum(p.size for p in merged))
        with self._lock:
            log = self.log()
            now = log.parts.get(table, ())
            if now[start:end] != merged:  # the table was replaced meanwhile: what was made is named by nothing, so a vacuum removes it
                return False
            self._name("CURRENT", Log({**log.parts, table: (*now[:start], made, *now[end:])}, log.last_ids, {**log.gone, **{p.path: self._ms() for p in merged}}))
        return True

    def vacuum(self, grace_seconds: float = GRACE) -> list[str]:
        """Removes folders that have been named by nothing for longer than the grace time, those of broken commits among them; returns what went."""
        before = self._ms() - int(1000 * grace_seconds)
        with self._lock:
            log = self.log()
            old = {path for path, at in log.gone.items() if at <= before}
            named = {p.path for ps in log.parts.values() for p in ps} | set(log.gone)
            for table in COLUMNS:
                top = self._path(f"{self.root}/{table}")
                for f in self._fs.listStatus(top) if table != "requests" and self._fs.exists(top) else []:
                    path = f"{table}/{f.getPath().getName()}"
                    if path not in named and f.getModificationTime() <= before:
                        old.add(path)
            self._name("CURRENT", Log(log.parts, log.last_ids, {p: at for p, at in log.gone.items() if p not in old}))
        for path in old:
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
        return sorted(old)

    def reserve(self, table: str, n: int) -> int:
        """Sets n ids of a table aside, that follow the number returned; none is given twice, whatever becomes of these."""
        known = None
        if table not in self.log().last_ids:
            known = self[table].agg(F.max("id")).first()[0] or 0  # once for a table
        with self._lock:
            log = self.log()
            last = log.last_ids.get(table, known)
            if n or table not in log.last_ids:
                self._name("CURRENT", Log(log.parts, {**log.last_ids, table: last + n}, log.gone))
        return last

    def _ms(self) -> int:
        return int(1000 * self.now())

    def _write(self, table: str, rows: DataFrame, over: bool = False, few: bool = False, size: int = 0) -> Part:
        """A new part. Rows of a known size are dealt to buckets where that is large; a few are one file."""
        path, buckets = f"{table}/{uuid.uuid4().hex}", buckets_for(size)
        where = f"{self.root}/{path}"
        if buckets:
            rows.withColumn("_bucket", _bucket(looked_up_by(table), buckets)).repartition("_bucket").write.mode("errorifexists").partitionBy("_bucket").parquet(where)
        else:
            (rows.coalesce(1) if few or 0 < size < BUCKET_BYTES else rows).write.mode("errorifexists").parquet(where)
        return Part(path, over, buckets, self._fs.getContentSummary(self._path(where)).getLength())

    def size(self) -> int:
        """Bytes below the root, those of folders that are named no more included."""
        return self._fs.getContentSummary(self._path(self.root)).getLength()

    def _name(self, file: str, log: Log) -> None:
        self.files("").replace(file, log.text())

    def files(self, folder: str) -> Files:
        """Small text files in a folder beside the tables."""
        return Files(self.spark, f"{self.root}/{folder}".rstrip("/"))

    # Requests come from processes that don't hold the lock, so each is a file of its own, which no commit replaces.

    def ask(self, job: str, at: str) -> None:
        """Adds a request for a job, which the process that runs the jobs takes up."""
        row = self.spark.createDataFrame([(time.time_ns(), job, at)], schema("requests"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/requests")

    def request_files(self) -> list[str]:
        at = self._path(f"{self.root}/requests")
        found = self._fs.listStatus(at) if self._fs.exists(at) else []
        return sorted(str(f.getPath()) for f in found if f.getPath().getName().startswith("part-"))

    def requests(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(schema("requests")).parquet(*files) if files else empty(self.spark, "requests")

    def remove_requests(self, files: list[str]) -> int:
        for file in files:
            self._fs.delete(self._path(file), False)
        return len(files)

    @contextmanager
    def aside(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """A function that writes a DataFrame down and gives it back as read, so that calls and downloads are made once even if an executor is lost; its path() is a new place there; all is removed at the end."""
        where = f"{self.root}/.aside-{uuid.uuid4().hex}"

        def keep(df: DataFrame) -> DataFrame:
            path = keep.path()
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        keep.path = lambda: f"{where}/{uuid.uuid4().hex}"
        try:
            yield keep
        finally:
            self._fs.delete(self._path(where), True)

    def backup(self, stamp: str, most: int = BACKUPS) -> str:
        """A full copy of all tables under backups/<stamp>, its row counts checked; an existing one is refused. Then the oldest ones go, beyond `most`."""
        where = f"{self.root}/backups/{stamp}"
        for name in self.log().parts:
            df = self[name]
            df.write.mode("errorifexists").parquet(f"{where}/{name}")
            if self.spark.read.schema(df.schema).parquet(f"{where}/{name}").count() != df.count():
                raise RuntimeError(f"the backup of {name} is not whole")
        self.keep_newest_backups(most)
        return where

    def keep_newest_backups(self, most: int = BACKUPS) -> list[str]:
        """Removes all but the backups that were made last; returns what went."""
        top = self._path(f"{self.root}/backups")
        found = sorted((s.getModificationTime(), s.getPath().getName()) for s in self._fs.listStatus(top)) if self._fs.exists(top) else []
        gone = [name for _, name in found[: max(0, len(found) - most)]]
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/backups/{name}"), True)
        return gone

    def purge(self, stamp: str) -> DataFrame:
        """Empties the academic tables after a backup; returns table_name, n of what was removed. Without a whole backup nothing is removed."""
        self.backup(f"before-purge-{stamp}")
        was = {name: self[name] for name in PURGED}
        counts = [(name, df.count()) for name, df in was.items()]
        self.commit(after_purge(was))
        return self.spark.createDataFrame(counts, "table_name string, n long")


# --- originals --------------------------------------------------------------------------------------


def addressed(objects: DataFrame, content: str = "content") -> DataFrame:
    """Distinct objects of a column of bytes: content_hash, storage_ref, size_bytes, content. Bytes are compared by hash before the shuffle, and one copy of each is kept."""
    rows = objects.select(F.sha2(F.col(content), 256).alias("content_hash"), F.col(content).alias("content")).filter("content_hash IS NOT NULL")
    one = rows.dropDuplicates(["content_hash"])
    return one.select("content_hash", F.concat(F.left("content_hash", F.lit(2)), F.lit("/"), "content_hash").alias("storage_ref"), F.length("content").cast("bigint").alias("size_bytes"), "content")


#: Hashes that are looked up one by one, and those up to which a set of them is broadcast; bytes of a row group and of a page of originals.
POINTS, MANY = 64, 100_000
ROW_GROUP, PAGE = 8 << 20, 1 << 16


def _prefix() -> Column:
    """The folder of an object."""
    return F.left("content_hash", F.lit(2)).alias("prefix")


class NoSpace(OSError):
    pass


def free_bytes(spark: SparkSession, root: str) -> int:
    """What the file system below a store says is left."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getStatus().getRemaining()


def store(objects: DataFrame, root: str, content: str = "content", reserve: int = RESERVE, free: Callable[[SparkSession, str], int] = free_bytes) -> DataFrame:
    """Adds objects that the store lacks; returns content_hash, storage_ref, size_bytes of all given. Storing again changes nothing.

    Nothing is written, and NoSpace raised, where less than `reserve` bytes would be left free.
    """
    spark = objects.sparkSession
    given = addressed(objects, content)
    held = stored(spark, root)
    fresh = given if held is None else given.join(held.select("content_hash"), "content_hash", "left_anti")
    need, left = totals(fresh).first().bytes, free(spark, root)
    if need and left - need < reserve:
        raise NoSpace(f"{need} bytes to store, {left} free, {reserve} are to stay free")
    kept = fresh.select("content_hash", "content", _prefix()).repartition("prefix").sortWithinPartitions("prefix", "content_hash")
    # in order of the hashes, in small groups and pages, whose least and greatest hashes tell a reader what to leave out
    kept.write.mode("append").option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).partitionBy("prefix").parquet(root)
    return given.drop("content")


def stored(spark: SparkSession, root: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("content_hash string, content binary, prefix string").parquet(root)


def retrieve(spark: SparkSession, root: str, hashes: DataFrame) -> DataFrame:
    """content_hash, content of the wanted hashes (column content_hash). A hash is checked against its bytes.

    Only the folders of the hashes' prefixes are opened; for POINTS hashes or fewer, only the row groups and pages in which they may be are read.
    """
    held = stored(spark, root)
    wanted = hashes.select("content_hash").filter(F.length("content_hash") == 64).distinct()
    if held is None:
        return wanted.select("content_hash", F.lit(None).cast("binary").alias("content")).limit(0)
    few = [r.content_hash for r in wanted.limit(POINTS + 1).collect()]
    if not few:
        return held.select("content_hash", "content").limit(0)
    if len(few) <= POINTS:
        rows = held.filter(F.col("prefix").isin(sorted({h[:2] for h in few}))).filter(reduce(lambda a, b: a | b, (F.col("content_hash") == h for h in few)))
    else:
        wanted = wanted.select("content_hash", _prefix())
        wanted = F.broadcast(wanted) if wanted.limit(MANY + 1).count() <= MANY else wanted
        rows = held.join(wanted, ["prefix", "content_hash"], "left_semi")
    return rows.select("content_hash", "content").filter(F.sha2("content", 256) == F.col("content_hash"))


def storage_totals(spark: SparkSession, root: str) -> DataFrame:
    """One row: objects, bytes."""
    held = stored(spark, root)
    return totals(spark.createDataFrame([], "content binary") if held is None else held)


def totals(objects: DataFrame) -> DataFrame:
    return objects.agg(F.count("*").alias("objects"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("bigint").alias("bytes"))


def valid_ref(ref: str) -> bool:
    """Whether a reference can only name an object of the store: a prefix and a hash, nothing that leads elsewhere."""
    head, _, tail = ref.partition("/")
    return len(head) == 2 and len(tail) == 64 and tail.startswith(head) and set(tail) <= set("0123456789abcdef")
