"""Session helpers shared by every module: tables, the shared checkpoint folder, written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, lazily; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests,
    a laptop) a temporary folder of this machine takes its place; on a cluster that would lose data, so it raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_emberline_shared", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="emberline-")
        spark._emberline_shared = path
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: For rows of megabytes: groups of rows are closed by size after every row. Else Parquet looks at sizes after a hundred rows first, and a
#: task holds a group of up to 128 MB while it writes it, and whole, unpacked, when it reads it.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def stored(df: DataFrame, name: str = "t", options: dict[str, int] | None = None) -> DataFrame:
    """Write ``df`` as Parquet, with ``options`` of its writer, into the shared folder and read it back.

    This cuts the lineage and lets several consumers share one computation; the files survive the loss
    of any executor, which a cached or locally checkpointed frame does not. ``scratch`` deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with shuffles_removed(spark):
        df.write.options(**options or {}).parquet(path)
    _made(spark).append(path)
    return spark.read.schema(schema).parquet(path)


def _made(spark: SparkSession) -> list[str]:
    """Folders written through this session that nobody has deleted yet."""
    if not hasattr(spark, "_emberline_made"):
        spark._emberline_made = []
    return spark._emberline_made


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session, inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession):
    """Inside, Spark removes the shuffle files of a query as soon as it has ended; its result is written by then."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, rows: int = 1024):
    """Inside, Arrow batches of what is executed hold ``rows`` rows at most: both a worker and the JVM's buffers keep what their largest batch took."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    return setting(spark, name, str(min(now, rows) if now > 0 else rows))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    remove(spark, path)
    _made(spark).remove(path)


class scratch:
    """Owner of the tables that an operator stores on its way.

    ``with scratch(spark) as own: ... return own.result(frame)`` stores the frame and deletes every table stored
    inside before it; on an error all of them go. What a result's consumer must outlive stays: the result itself.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> scratch:
        self.mark = len(_made(self.spark))
        self.kept: list[str] = []
        return self

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        out = stored(df, name)
        self.kept.append(_made(self.spark)[-1])
        return out

    def __exit__(self, *_) -> None:
        made = _made(self.spark)
        for path in made[self.mark :]:
            if path not in self.kept:
                remove(self.spark, path)
        made[self.mark :] = self.kept


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder, for loops: Spark removes the files of dropped rounds."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
