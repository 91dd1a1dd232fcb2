"""Tables written to the folder that every executor of the cluster can reach.

A written table cuts lineage: a lost executor costs at most the stage that was
running, and a table that is read twice is computed once.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}  # of applications without spark.checkpoint.dir
_unowned: dict[str, SparkSession] = {}
_owners: list[Owner] = []


def use_folder(spark: SparkSession, folder: str) -> None:
    """Names the shared folder of an application that has no ``spark.checkpoint.dir``."""
    _folders[spark.sparkContext.applicationId] = folder


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the folder set by ``use_folder``; in local mode, else a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        app = spark.sparkContext.applicationId
        if app not in _folders:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _folders[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
            _unowned[_folders[app]] = spark
        where = _folders[app]
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _delete_unowned() -> None:
    for path, spark in reversed(_unowned.items()):
        with contextlib.suppress(Exception):  # the JVM may have gone before us
            _delete(spark, path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a table written in the block has shuffled is deleted as soon as it is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Owner:
    """Owns the kept tables that are made in its ``with`` block; ``close`` deletes them.

    Results of operators read kept tables lazily: write or collect a result, then close its owner.
    Tables kept outside of any such block last until the process ends.
    """

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}

    def __enter__(self) -> Owner:
        _owners.append(self)
        return self

    def __exit__(self, *exc) -> None:
        _owners.remove(self)

    def close(self) -> None:
        while self.paths:
            path, spark = self.paths.popitem()
            _delete(spark, path)


class Scratch:
    """``with Scratch(spark) as s``: ``s.table(df)`` writes and rereads a DataFrame.

    Leaving the block deletes its tables, but for those written with ``keep=True``, which the innermost ``Owner`` deletes.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def folder(self, keep: bool = False) -> str:
        """A new path, deleted as a table's."""
        path = f"{shared_dir(self.spark)}/tessera-{uuid.uuid4().hex}"
        if not keep:
            self.paths.append(path)
        else:
            (_owners[-1].paths if _owners else _unowned)[path] = self.spark
        return path

    def table(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = self.folder(keep)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *exc) -> None:
        for path in self.paths:
            _delete(self.spark, path)
