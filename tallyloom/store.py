"""Tables written to the shared folder, to cut lineage and to use a result twice."""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.session import ship_package


_made: dict[str, str] = {}  # temporary folders by application, where spark.checkpoint.dir is unset


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset in a local session, as in tests."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _made:
        _made[app] = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
    return _made[app]


class _Open(threading.local):
    """Tables written within each scratch() of a thread, innermost last."""

    def __init__(self) -> None:
        self.scopes: list[list] = []


_open = _Open()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are dropped at the end, but for those that keep() names: for work whose results are written as well."""
    _open.scopes.append([])
    try:
        yield
    finally:
        for made in _open.scopes.pop():
            made.drop()


def keep(made: Stored) -> Stored:
    """Let a table outlive the scratch() that it was written in."""
    if _open.scopes and made in _open.scopes[-1]:
        _open.scopes[-1].remove(made)
        if len(_open.scopes) > 1:
            _open.scopes[-2].append(made)
    return made


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of the shared file system, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Stored:
    """A written table; drop() removes it once nothing reads it any more."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)  # an empty table may have no file to read it from

    def drop(self) -> None:
        drop_path(self.spark, self.path)


@contextmanager
def _no_leftovers(spark: SparkSession) -> Iterator[None]:
    """What a write inside shuffles is removed at its end, not whenever the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def store(df: DataFrame, name: str, partition: str | None = None) -> Stored:
    """Write df to the shared folder and read it back; with a folder per value of `partition`."""
    spark = ship_package(df.sparkSession)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with _no_leftovers(spark):
        (writer.partitionBy(partition) if partition else writer).parquet(path)
    made = Stored(spark, path, df.schema)
    if _open.scopes:
        _open.scopes[-1].append(made)
    return made


class StoredBuckets:
    """A table in the session's catalog."""

    def __init__(self, spark: SparkSession, table: str, path: str):
        self.spark, self.table, self.path = spark, table, path

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        drop_path(self.spark, self.path)


def store_bucketed(df: DataFrame, name: str, key: str, buckets: int, partition: str | None = None) -> DataFrame:
    """As store(), dealt into buckets by `key`: a join by it with as many shuffle partitions leaves the table where it is."""
    spark = ship_package(df.sparkSession)
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{table}").bucketBy(buckets, key)
    with _no_leftovers(spark):
        (writer.partitionBy(partition) if partition else writer).saveAsTable(table)
    if _open.scopes:
        _open.scopes[-1].append(StoredBuckets(spark, table, f"{shared_folder(spark)}/{table}"))
    return spark.table(table)


def even_numbers(spark: SparkSession, n: int) -> list[int]:
    """n whole numbers that fall on all shuffle partitions alike, for keys of blocks that are dealt out by them."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_part = Window.partitionBy(F.expr(f"pmod(hash(b), {parts})")).orderBy("b")
    numbers = spark.range(32 * max(n, parts)).select(F.col("id").cast("int").alias("b")).select("b", F.row_number().over(of_part).alias("n"))
    return [r["b"] for r in numbers.orderBy("n", "b").limit(n).collect()]


def files_digest(spark: SparkSession, files: list[str]) -> str:
    """A name for these files as they are: their paths, sizes and times of change. Each folder is listed once."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    wanted, seen = {unquote(urlsplit(f).path) for f in files}, []
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        for s in path.getFileSystem(conf).listStatus(path):
            if (name := s.getPath().toUri().getPath()) in wanted:
                seen.append(f"{name}|{s.getLen()}|{s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]
