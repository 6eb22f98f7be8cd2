"""Session helpers: configuration, the shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call-site capture for every Column call doubles the time to build a wide plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    ``conf`` keys use ``__`` for dots (``spark__driver__memory="8g"``). Partition counts are left to
    the cluster: AQE coalesces from whatever ``spark.sql.shuffle.partitions`` the cluster sets.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver and tasks
    share one file system, may fall back to a temporary folder, which goes when the process ends.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    context.setCheckpointDir(configured)
    return configured


#: paths that the innermost running :func:`settled` has written so far
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as a parquet table in the checkpoint folder and read back.

    A lost executor re-reads files instead of replaying the history, and later passes read only the
    columns they use. The folder belongs to the run; whoever set it cleans it up. Inside :func:`settled` the
    table goes when the result is written.
    """
    return written(df)[0]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """What :func:`cut_lineage` gives, and the folder of the table, for a caller that removes it when it is no longer read."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _written.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build`` written as a table; the tables that were written on the way are removed.

    Nothing that ``build`` keeps may be read afterwards, but what it returns.
    """
    paths: list[str] = []
    token = _written.set(paths)
    try:
        result = build()
    except BaseException:
        _written.reset(token)
        remove_tables(SparkSession.active(), paths)
        raise
    _written.reset(token)
    kept = cut_lineage(result)
    remove_tables(result.sparkSession, paths)
    return kept


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders by the file system that holds them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    collect_garbage(spark)


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files go when the driver's collector finds that nothing refers to them."""
    spark._jvm.System.gc()
