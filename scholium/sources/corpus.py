"""Folders of papers and the artifacts stored for them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: how a pdf file starts.
PDF_MAGIC = "%PDF"

# Most bytes per core that are moved to make use of all cores.
SPREAD_BYTES = 16 << 20


def scan_corpus(spark: SparkSession, path: str, skip_empty: bool = True) -> DataFrame:
    """``files(source, length, content)``: a file, or the files directly inside a folder.

    Content is only read when it is selected.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    files = files.select(F.col("path").alias("source"), "length", "content")
    return files.filter(F.col("length") > 0) if skip_empty else files


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose rows cost much more to process than to move.

    A small table in fewer files than there are cores is spread over all of them. Anything larger
    is read where it lies, whatever its number of files.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores:
        return df
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).head()[0]
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def scan_table(docs: DataFrame) -> DataFrame:
    """The same for a corpus table ``docs(source, text)``: rows that have text."""
    return docs.filter(F.length("text") > 0)


def artifact_kind(content: Column, declared: Column) -> Column:
    """``pdf`` by its leading bytes, ``txt`` where plain text was declared, else ``html``."""
    is_pdf = F.substring(content, 1, len(PDF_MAGIC)) == F.lit(PDF_MAGIC).cast("binary")
    return F.when(is_pdf, "pdf").when(declared == "text/plain", "txt").otherwise("html")


def write_artifacts(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store ``(pmid, source, content, declared)`` by kind, so that one kind can be read alone."""
    kind = artifact_kind(F.col("content"), F.col("declared"))
    df.select("pmid", "source", "content", kind.alias("kind")).write.mode(mode).partitionBy("kind").parquet(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pmid string, source string, content binary, kind string").parquet(path)
