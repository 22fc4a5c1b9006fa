"""Session-level helpers: the shared checkpoint folder and tables written there."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share for checkpoints.

    `spark.checkpoint.dir` wins. Where it is unset, a local master gets a temporary
    folder, and any other master a folder in the warehouse, which executors can reach.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if root is None:
        if sc.master.startswith("local["):
            root = tempfile.mkdtemp(prefix="echotrace-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return sc.getCheckpointDir() if sc.getCheckpointDir() else root


def ship(spark: SparkSession) -> None:
    """Give executors this package: their Python workers import the functions they run from it."""
    sc = spark.sparkContext
    if getattr(sc, "_echotrace_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="echotrace-"), "echotrace_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(target)
    sc._echotrace_shipped = True


ROWS_A_FILE = 1_000_000


def few_files(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A narrow frame dealt out to a file for each million rows, or for each core if `rows` is unknown.

    The exchange keeps the stage that makes the rows as wide as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores if rows is None else max(1, -(-rows // ROWS_A_FILE)))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _session_folder(spark: SparkSession) -> str:
    """A folder in the shared one for tables of this session; it goes when this Python ends."""
    sc = spark.sparkContext
    folder = getattr(sc, "_echotrace_folder", None)
    if folder is None:
        folder = sc._echotrace_folder = f"{checkpoint_root(spark).rstrip('/')}/echotrace-{uuid.uuid4().hex}"
        stop = sc.stop

        def clean() -> None:
            try:
                if sc._jsc is not None:
                    _delete(spark, folder)
            except Exception:  # the JVM may be gone; then the folder stays
                pass

        def stop_clean() -> None:
            clean()
            stop()

        sc.stop = stop_clean
        atexit.register(clean)
    return folder


_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """The tables that `cut` and `keep` write inside go at its end, whatever ends it."""
    folder = f"{_session_folder(spark)}/{uuid.uuid4().hex}"
    token = _scopes.set((*_scopes.get(), folder))
    try:
        yield
    finally:
        _scopes.reset(token)
        _delete(spark, folder)


def new_path(spark: SparkSession, outside: bool = False) -> str:
    """A path in the shared folder for one more table or folder of files; it goes as those of `cut` and `keep` do."""
    inner = _scopes.get()[: -1 if outside else None]
    return f"{inner[-1] if inner else _session_folder(spark)}/{uuid.uuid4().hex}"


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame of `make()`. If making it wrote tables, it is written itself and they are deleted; else it stays a plan."""
    with temporary(spark):
        df = make()
        folder = spark._jvm.org.apache.hadoop.fs.Path(_scopes.get()[-1])
        return keep(df, outside=True) if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) else df


def cut(df: DataFrame, rows: int | None = None, outside: bool = False) -> DataFrame:
    """Materialise a narrow frame in the shared folder, so that lost executors cost no recomputation.

    It is written as Parquet, so that later plans know its size and read the columns they need.
    With `outside` it outlives the innermost `temporary`.
    """
    return keep(few_files(df, rows), outside)


def keep(df: DataFrame, outside: bool = False, words: int | None = None) -> DataFrame:
    """Materialise a wide frame in the shared folder as it is dealt out, for plans that read parts of it several times.

    `words` are the most bytes of a dictionary of a column's values, if not Parquet's own number.
    """
    spark = df.sparkSession
    path = new_path(spark, outside)
    to = df.write.option("compression", "zstd")
    (to if words is None else to.option("parquet.dictionary.page.size", words)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores if it comes from fewer files than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def release(spark: SparkSession) -> None:
    """Let the driver notice what is no longer in use, so that executors delete those shuffle files now."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Parquet tables in the shared folder that live until `drop()`, or as a context until it ends.

    What is not dropped, as its readers need it, goes with the session.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def store(self, df: DataFrame, name: str, narrow: bool = True, rows: int | None = None) -> DataFrame:
        path = f"{self.path}/{name}"
        (few_files(df, rows) if narrow else df).write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, name: str) -> None:
        """Delete one table before the others, once nothing is read from it any more."""
        _delete(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        _delete(self.spark, self.path)
