"""Contiguous shards of nearly equal bytes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.shared import ordered_totals


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row of ``docs``.

    A document's size is the UTF-8 bytes of its text plus 1. Documents stand in order of id; the
    global prefix sum of sizes is the sum of the totals of earlier ranges and a running sum inside
    the range. A document belongs to the shard in whose equal share of all bytes its middle lies,
    so shards are contiguous and no two differ by more than about one document. ``slot`` numbers
    the documents of a shard from 0. Only ids, sizes and checksums are moved.

    A null text is empty: size 1, checksum 0. Null ids come first. Rows with the same id stand in
    order of size and checksum; whole repeated rows are sharded one by one. An empty table gives
    no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = [F.col(id_col), F.col("size"), F.col("text_crc32")]
    placed = ordered_totals(narrow, order, ["size"])
    middle = F.expr(f"((2 * before_size + size) * {int(shards)}) div (2 * total_size)")
    placed = placed.select(
        id_col, "size", "text_crc32", F.least(middle, F.lit(shards - 1)).cast("int").alias("shard"), "row_no"
    )
    starts = placed.groupBy("shard").agg(F.min("row_no").alias("__start"))
    return placed.join(F.broadcast(starts), "shard").select(
        id_col, "size", "text_crc32", "shard", (F.col("row_no") - F.col("__start")).alias("slot")
    )
