"""What operators need from the cluster: tables that cut lineage, in the folder that driver and executors share, and the
package itself on the executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where it is set; where it is not, a temporary folder in local mode. A cluster has to
    name a folder that driver and executors share."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own[app] = tempfile.mkdtemp(prefix="lexloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, so that functions that run there can be imported
    wherever the driver was started. Does nothing if the package is itself in an archive that Spark has shipped."""
    app, home = spark.sparkContext.applicationId, os.path.dirname(os.path.abspath(__file__))
    if app in _shipped or not os.path.isdir(home):
        return
    _shipped.add(app)
    with tempfile.TemporaryDirectory() as d:
        shutil.copytree(home, f"{d}/root/{os.path.basename(home)}", ignore=shutil.ignore_patterns("__pycache__"))
        folder = tempfile.mkdtemp(prefix="lexloom-")
        made = shutil.make_archive(f"{folder}/lexloom-{uuid.uuid4().hex}", "zip", f"{d}/root")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors that come later fetch it too
    spark.sparkContext.addPyFile(made)  # served by the driver, fetched by every executor


class Scratch:
    """Scratch tables of one operator call. ``put`` writes a table and reads it again: executors that are lost
    later cost nothing, and later joins see a plain scan, whose partitions adaptive execution can split.

    An operator drops the tables that its result doesn't read. What the result reads is deleted when the ``scoped``
    block that the operator was called in ends, at the latest when the driver does."""

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark, self.root = spark, f"{scratch_dir(spark)}/lexloom-{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._tables: set[str] = set()
        _open.append(self)

    def put(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.options(**options).parquet(path)
        self._tables.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        path = self._path(path)
        path.getFileSystem(self._conf).delete(path, True)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        self._delete(f"{self.root}/{name}")
        self._tables.discard(name)

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        for name in sorted(self._tables - set(names)):
            self.drop(name)

    def close(self) -> None:
        self._delete(self.root)
        self._tables.clear()


_open: list[Scratch] = []


def _close(scratches: list[Scratch]) -> None:
    for s in scratches:
        with contextlib.suppress(Exception):  # the session may be gone
            s.close()


@contextlib.contextmanager
def scoped() -> Iterator[None]:
    """Deletes at its end the scratch tables of all operators that were called inside; by then their results must have
    been written."""
    before = len(_open)
    try:
        yield
    finally:
        made = _open[before:]
        del _open[before:]
        _close(made)


atexit.register(lambda: _close(_open))
