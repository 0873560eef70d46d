"""Running totals, column hygiene and code shipping shared by the operators."""

import ctypes
import gc
import os
import shutil
import sys
import tempfile
import types
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.plans.storage import materialize

# Fixed value: the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_scholium_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):
        folder = tempfile.mkdtemp(prefix="scholium-code-")
        archive = shutil.make_archive(f"{folder}/scholium", "zip", os.path.dirname(top), os.path.basename(top))
        context.addPyFile(archive)
    context._scholium_shipped = True


def release_memory() -> None:
    """Give back what this worker has freed. Workers outlive their tasks, and what they hold on to
    counts against the tasks of the next job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(task):
    """``task`` for ``mapInArrow``, followed by ``release_memory``."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


# Settings of the batches in which Spark sends rows to Python, and their values in ``small_batches``.
_SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def small_batches(spark: SparkSession):
    """While it lasts, jobs that start send rows to Python in batches of some MB. An executor holds a batch of texts several
    times over: as vectors, as the stream it writes, and in the worker that reads it."""
    before = {name: spark.conf.get(name) for name in _SMALL_BATCHES}
    for name, value in _SMALL_BATCHES.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def on_plain_names(docs: DataFrame, named: Sequence[str], work) -> DataFrame:
    """``work(docs)``, which returns the columns of ``docs``. All columns but the ``named`` ones have names on
    the way that no operator uses and that need no quotes."""
    plain = [c if c in named else f"column_{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*plain)).toDF(*docs.columns)


def worker_state(name: str, make):
    """An object that a Python worker keeps between tasks, made on first use.

    A worker keeps one at a time: asking for another drops it, so what an earlier job has left
    takes no memory from the next.
    """
    states = sys.modules.setdefault("scholium_worker_state", types.ModuleType("scholium_worker_state"))
    if getattr(states, "name", None) != name:
        states.name = states.kept = None
        release_memory()
        states.kept = make()
        states.name = name
    return states.kept


def map_arrow(df: DataFrame, task, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` for columns of any names: ``task`` gets and gives them by position."""
    names = [f"c{i}" for i in range(len(schema))]
    numbered = T.StructType([T.StructField(name, field.dataType) for name, field in zip(names, schema)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in task(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(renamed, numbered).toDF(*schema.fieldNames())


def free_name(name: str, columns: Sequence[str]) -> str:
    """``name``, or with a number after it if one of ``columns`` is called so in any case."""
    taken, found, n = {c.lower() for c in columns}, name, 0
    while found.lower() in taken:
        n += 1
        found = f"{name}_{n}"
    return found


def id_hash_mod(column: str, n: int) -> Column:
    """``crc32`` of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def ordered_totals(
    df: DataFrame, order: Sequence[Column], sums: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """``df`` with the totals of all rows that come earlier in ``order``.

    Adds ``row_no`` (rows before), ``n_rows`` (rows in all) and for each column ``s`` of ``sums``
    ``before_s`` and ``total_s``. The rows are dealt into ranges and written with their range
    number; only one row per range meets the others, so nothing but ``partitions`` rows ever comes
    together. Rows that tie in ``order`` stand in any order, so it should name every column that
    tells rows apart.
    """
    parts = partitions or shuffle_partitions(df.sparkSession)
    dealt = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    totals = dealt.groupBy("__part").agg(
        F.count(F.lit(1)).alias("__rows"), *[F.sum(s).alias(f"__sum_{s}") for s in sums]
    )
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = totals.select(
        "__part",
        zero(F.sum("__rows").over(earlier)).alias("__rows_before"),
        F.sum("__rows").over(every).alias("n_rows"),
        *[zero(F.sum(f"__sum_{s}").over(earlier)).alias(f"__before_{s}") for s in sums],
        *[F.sum(f"__sum_{s}").over(every).alias(f"total_{s}") for s in sums],
    )
    within = Window.partitionBy("__part").orderBy(*order)
    run = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumns(
        {"__place": F.row_number().over(within) - 1, **{f"__run_{s}": zero(F.sum(s).over(run)) for s in sums}}
    ).join(F.broadcast(offsets), "__part")
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("__rows_before") + F.col("__place")).alias("row_no"),
        "n_rows",
        *[(F.col(f"__before_{s}") + F.col(f"__run_{s}")).alias(f"before_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums],
    )
