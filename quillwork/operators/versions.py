"""Tables under concurrent writers: a log of versions, the next of which only one writer can create.

A version is an entry of the log, a small file named by its number. It names, for each table it changes, a
written set of rows by key; a row with ``gone`` takes the key away. Creating the entry of the next number if there is
none is the one atomic step, so of two writers on one version one succeeds. The other compares the keys it
touches with those of the entries that came in between: apart, it takes the next number as it is; else it has
lost, and its change is made anew on the newer version. Nothing is overwritten, so no writer can lose another's rows.

A reader takes, for each key, the row of the latest version up to its own. Every ``EVERY`` versions an entry names
the whole table too, so a read unions a bounded number of sets. What a writer wrote for a version it never got isn't
named by any entry and is never read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = 10
#: Seconds that a reader waits for an entry that was created but isn't whole yet.
PATIENCE = 10.0


class Conflict(Exception):
    """Another writer changed some of the same keys first."""


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with this text, unless there is one: whether it did. One of many callers does."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    try:
        if fs.getUri().getScheme() == "file":  # Hadoop's local files look first and create then, which isn't one step
            target = jvm.java.nio.file.Paths.get(at.toUri().getPath(), sc._gateway.new_array(jvm.java.lang.String, 0))
            options = sc._gateway.new_array(jvm.java.nio.file.OpenOption, 2)
            options[0], options[1] = jvm.java.nio.file.StandardOpenOption.CREATE_NEW, jvm.java.nio.file.StandardOpenOption.WRITE
            jvm.java.nio.file.Files.write(target, bytearray(text.encode()), options)
        else:
            out = fs.create(at, False)
            try:
                out.write(bytearray(text.encode()))
            finally:
                out.close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


class Versioned:
    """Tables in a folder that all writers and readers share. keys: each table's key column."""

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, str]):
        self.spark, self.folder, self.keys = spark, folder, keys

    def _entry(self, version: int) -> str:
        return f"{self.folder}/log/{version:020d}.json"

    def head(self) -> int:
        """The latest version; 0 before the first."""
        sc = self.spark.sparkContext
        log = sc._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        fs = log.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(log):
            return 0
        return max((int(s.getPath().getName()[:20]) for s in fs.listStatus(log) if s.getPath().getName()[:20].isdigit()), default=0)

    def entry(self, version: int) -> dict:
        """What a version changed: tables, each with the folder of its rows, and of its whole where it has one."""
        until = time.monotonic() + PATIENCE
        while True:
            lines = [r["value"] for r in self.spark.read.text(self._entry(version)).collect()]  # one line
            if lines and lines[0].endswith("}"):
                return json.loads(lines[0])
            if time.monotonic() > until:
                raise OSError(f"version {version} isn't whole")
            time.sleep(0.1)

    def _sets(self, name: str, version: int) -> tuple[str | None, list[tuple[int, str]]]:
        """The latest whole table and the changes after it, up to a version."""
        changes = []
        for v in range(version, 0, -1):
            found = self.entry(v)["tables"].get(name)
            if found:
                changes.append((v, found["rows"]))
                if found.get("whole"):
                    return found["whole"], changes[:-1]
        return None, changes

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version (the latest); None if no version up to it has it."""
        whole, changes = self._sets(name, self.head() if version is None else version)
        parts = [self.spark.read.parquet(path).withColumn("_version", F.lit(v)) for v, path in changes]
        if whole:
            parts.append(self.spark.read.parquet(whole).withColumns({"gone": F.lit(False), "_version": F.lit(0)}))
        if not parts:
            return None
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        key = self.keys[name]
        columns = [c for c in rows.columns if c not in (key, "gone", "_version")]
        latest = rows.groupBy(key).agg(F.max_by(F.struct("gone", *columns), "_version").alias("_row"))
        return latest.filter("not _row.gone").select(key, *[F.col("_row")[c].alias(c) for c in columns])

    def begin(self) -> Transaction:
        return Transaction(self, self.head())

    def change(self, make: Callable[[Transaction], None], attempts: int = 5) -> int:
        """Commits what ``make`` puts into a transaction, made anew on the newer version as often as another writer was
        first with the same keys. Returns the version."""
        for attempt in range(1, attempts + 1):
            t = self.begin()
            make(t)
            try:
                return t.commit()
            except Conflict:
                if attempt == attempts:
                    raise
        raise AssertionError


class Transaction:
    """Changes to be made on one version."""

    def __init__(self, tables: Versioned, base: int):
        self.tables, self.base = tables, base
        self.put: dict[str, str] = {}

    def read(self, name: str) -> DataFrame | None:
        return self.tables.read(name, self.base)

    def write(self, name: str, rows: DataFrame) -> None:
        """Rows to be put by key; a true ``gone`` takes the key away. All tables' changes become visible at once."""
        if "gone" not in rows.columns:
            rows = rows.withColumn("gone", F.lit(False))
        path = f"{self.tables.folder}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.put[name] = path

    def _meets(self, other: dict) -> bool:
        """Whether another version touches a key that this one does."""
        for name, path in self.put.items():
            if name in other["tables"]:
                key, read = self.tables.keys[name], self.tables.spark.read.parquet
                if not read(path).select(key).join(read(other["tables"][name]["rows"]).select(key), key, "left_semi").isEmpty():
                    return True
        return False

    def commit(self) -> int:
        """Makes the changes the next version. Raises Conflict if a version since the base touched one of the same keys."""
        entry = {"tables": {name: {"rows": path} for name, path in self.put.items()}}
        version = self.base + 1
        while True:
            for name in self.put if version % EVERY == 0 else ():
                entry["tables"][name]["whole"] = self._whole(name, version - 1)
            if _create(self.tables.spark, self.tables._entry(version), json.dumps(entry)):
                return version
            if self._meets(self.tables.entry(version)):
                raise Conflict(f"version {version} changed the same keys")
            version += 1

    def _whole(self, name: str, before: int) -> str:
        """Writes the table as it will be with this change on top of the version before."""
        key, spark = self.tables.keys[name], self.tables.spark
        mine, old = spark.read.parquet(self.put[name]), self.tables.read(name, before)
        now = mine.filter("not gone").drop("gone")
        if old is not None:
            now = now.unionByName(old.join(mine.select(key), key, "left_anti"))
        path = f"{self.tables.folder}/data/{uuid.uuid4().hex}"
        now.write.parquet(path)
        return path
