"""Written intermediate tables, and shipping this package to the workers."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import TypeVar

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_local_roots: dict[str, tempfile.TemporaryDirectory] = {}
_shipped: set[str] = set()
_scope = threading.local()
_BOUNDED = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8",
}


def staging_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.TemporaryDirectory(
            prefix="quintavote-", ignore_cleanup_errors=True
        )
    return _local_roots[app].name


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the staging root."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    A written table survives the loss of executors and is pruned by column
    when it is read, which a recomputed or cached plan is not.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _bounded(spark):
        df.write.parquet(path)
    _at_end_of_scopes(lambda: delete_folder(spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _bounded(spark: SparkSession) -> Iterator[None]:
    """What is written inside the block keeps less disk and memory.

    Its shuffle files go when it is written: a plan that wrote a table is not run again, and the files
    would else stay until the driver happens to collect its memory.  Lists are put together by sorting
    from a few groups on, as a group may be a block of thousands of rows and a task holds as many.
    """
    before = {name: spark.conf.get(name) for name in _BOUNDED}
    for name, value in _BOUNDED.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def share(spark: SparkSession, value: T) -> Broadcast[T]:
    """Broadcast ``value``; inside a staging scope it is destroyed when that ends."""
    shared = spark.sparkContext.broadcast(value)
    _at_end_of_scopes(shared.destroy)
    return shared


def _at_end_of_scopes(act: Callable[[], None]) -> None:
    stack = getattr(_scope, "open", [])
    if stack:
        stack[-1].append(act)


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables and broadcasts made inside the block when it ends.

    For work whose result is written within the block, such as a micro-batch.
    """
    acts: list[Callable[[], None]] = []
    stack = _scope.__dict__.setdefault("open", [])
    stack.append(acts)
    try:
        yield
    finally:
        stack.pop()
        for act in acts:
            act()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python tasks, once per application.

    Does what ``spark-submit --py-files`` does, for sessions started without it.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quintavote-py-")) / "quintavote.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
