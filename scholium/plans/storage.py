"""Where intermediate tables are written."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder. On a cluster the setting is required,
    because a folder of one machine is lost with that machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="scholium-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/scholium/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled by a write in here is removed once the write has ended, not when the driver collects its garbage.

    So the disks hold the shuffles of one step at a time.
    """
    before = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)


def write_packed(df: DataFrame, path: str, mode: str = "errorifexists", by: tuple[str, ...] = (), **options: str) -> None:
    """Write ``df`` below ``path``, in the codec that takes the least room; nothing else stays on the disks."""
    with shuffles_removed(df.sparkSession):
        writer = df.write.mode(mode).options(compression="zstd", **options)
        (writer.partitionBy(*by) if by else writer).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table and read it back.

    This cuts the lineage, survives the loss of executors, and gives the planner the true size, so
    that it broadcasts the table in later joins only if it is small. ``discard`` removes the table.
    """
    path = scratch_path(df.sparkSession, name)
    write_packed(df, path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` returned, once all that reads them has been written."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
