"""Lists of paper ids as text files or comma lists."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions.arrays import unnest


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """``ids(pmid, name, ord)``: one id per line with an optional output name.

    The layout is decided per line and blank lines are skipped. ``ord`` is unique and follows the
    order of the lines within each input split.
    """
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    parts = F.split(F.trim("value", F.lit(" \t\r")), r"\s+")
    return (
        lines.select(parts.alias("parts"), "ord")
        .filter(F.get("parts", F.lit(0)) != "")
        .select(
            F.get("parts", F.lit(0)).alias("pmid"),
            F.coalesce(F.get("parts", F.lit(1)), F.get("parts", F.lit(0))).alias("name"),
            "ord",
        )
    )


def explode_id_list(df: DataFrame, col: str) -> DataFrame:
    """Add ``pos`` and ``pmid`` for each part of a comma list."""
    parts = unnest(df, ["*"], F.split(F.col(col), ","), "part", "pos")
    return parts.select(*df.columns, "pos", F.trim("part").alias("pmid"))


def write_id_list(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write one id per line; ``append`` adds without removing repeats."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    df.select(F.col("pmid").alias("value")).write.mode(mode).text(path)
