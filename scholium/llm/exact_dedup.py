"""Exact duplicates, found by inserting whole texts into compressed radix tries."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.radix import RadixTrie
from scholium.llm.shared import on_plain_names, releasing, ship_package, shuffle_partitions
from scholium.plans.skew import hot_keys, lookup
from scholium.plans.storage import materialize

TRIE_BYTES = 192 << 20
# Up to so many rows, named by id and hash, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def normalized(text: str | None) -> bytes:
    """UTF-8 with A-Z, and no other letter, in lower case; null is empty."""
    return b"" if text is None else text.encode("utf-8").lower()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests = [], []
        for text in batch.column(2):
            data = normalized(text.as_py())
            sizes.append(len(data))
            digests.append(hashlib.sha256(data).hexdigest())
        columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "tag", "n_bytes", "text_sha256"])


def _merge(largest: bool):
    """Owners are (id, rows with that id, all rows)."""

    def merge(a, b):
        if a[0] == b[0]:
            return a[0], a[1] + b[1], a[2] + b[2]
        best = a if (a[0] > b[0]) == largest else b
        return best[0], best[1], a[2] + b[2]

    return merge


def _batches(entries, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Entries ``(text, owner)`` of a trie as Arrow batches of bounded size."""
    rows, size = [], 0

    def batch():
        texts, owners = zip(*rows, strict=True)
        columns = [
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            pa.array(texts, pa.binary()),
            *[pa.array([o[i] for o in owners], pa.int64()) for i in range(3)],
        ]
        names = ["n_bytes", "text_sha256", "data", "keep", "keep_rows", "group_size"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for text, owner in entries:
        rows.append((text, owner))
        size += len(text) + 64
        if size >= limit:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def _local_owners(largest: bool, budget: int):
    """Distinct texts of a task; a full trie is sent on and started anew."""
    none = _LOW if largest else _HIGH

    def owners(batches):
        trie = RadixTrie(_merge(largest), 1 << 62)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                trie.insert(normalized(text.as_py()), (none if i is None else i, 1, 1))
            if trie.size > budget:
                yield from _batches(trie.items())
        yield from _batches(trie.items())

    return owners


def _global_owners(largest: bool, budget: int):
    """One row per distinct text of a partition, without the text."""
    none = _LOW if largest else _HIGH

    def owners(batches):
        trie = RadixTrie(_merge(largest), budget)
        try:
            for batch in batches:
                triples = zip(*[batch.column(c).to_pylist() for c in ("keep", "keep_rows", "group_size")], strict=True)
                for text, owner in zip(batch.column("data"), triples, strict=True):
                    trie.insert(text.as_py(), owner)
            for found in _batches(trie.items()):
                keep = pa.array([None if k == none else k for k in found.column("keep").to_pylist()], pa.int64())
                columns = [found.column("text_sha256"), keep, found.column("keep_rows"), found.column("group_size")]
                yield pa.RecordBatch.from_arrays(columns, names=["text_sha256", "keep", "keep_rows", "group_size"])
        finally:
            trie.close()

    return owners


def find_copies(
    docs: DataFrame,
    keep: str = "largest",
    id_col: str = "doc_id",
    text_col: str = "text",
    tag_col: str | None = None,
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """``(id, tag, keep_id, group_size, kept, text_sha256, n_bytes)`` for every row of ``docs``.

    Texts are equal when their UTF-8 bytes are, after lower-casing A-Z. In every group the row with
    the largest (or ``keep="smallest"``) integer id is kept. Each task first inserts its own texts
    into a radix trie, so a text copied any number of times leaves a task once. The distinct texts
    are dealt by length and content hash, and each partition inserts the full byte strings into a
    trie whose terminals hold the owner; beyond ``trie_bytes`` it spills by subtree. Groups then
    meet the rows by digest; large groups, at most ``HOT_SHARE`` of them, by broadcast.

    A null text is empty. A null id is kept only if the group has no other. Of whole repeated rows
    that share the kept id exactly one is kept. An empty table gives no rows. ``tag`` tells rows
    apart; ``tag_col`` names a column that already does. Other columns are ignored.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    spark, largest = docs.sparkSession, keep == "largest"
    ship_package(spark)
    tag = F.col(tag_col) if tag_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), tag.alias("tag"), F.col(text_col).alias("text"))
    keys = rows.mapInArrow(releasing(_keys), "id long, tag long, n_bytes long, text_sha256 string")
    # Written once: the tags stay the same in all later uses.
    keys = materialize(keys, "text-keys")
    local = rows.select("id", "text").mapInArrow(
        releasing(_local_owners(largest, trie_bytes)),
        "n_bytes long, text_sha256 string, data binary, keep long, keep_rows long, group_size long",
    )
    dealt = local.repartition(shuffle_partitions(spark), "n_bytes", "text_sha256").drop("n_bytes", "text_sha256")
    owners = dealt.mapInArrow(
        releasing(_global_owners(largest, trie_bytes)), "text_sha256 string, keep long, keep_rows long, group_size long"
    )
    groups = materialize(owners.filter("group_size > 1"), "text-owners")
    found = lookup(keys, groups, hot_keys(groups, "group_size"), "text_sha256", null_keys=False)
    alone = F.col("group_size").isNull()
    own = F.col("id").eqNullSafe(F.col("keep"))
    kept = alone | own
    if not groups.filter("keep_rows > 1").isEmpty():
        twins = found.filter(own & (F.col("keep_rows") > 1))
        first = twins.groupBy("text_sha256").agg(F.min("tag").alias("first"))
        found = found.join(first, "text_sha256", "left")
        kept = alone | (own & ((F.col("keep_rows") == 1) | (F.col("tag") == F.col("first"))))
    return found.select(
        F.col("id").alias(id_col),
        "tag",
        F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        "text_sha256",
        "n_bytes",
    )


def row_mark(id_col: str, text_col: str) -> Column:
    """With the id, tells rows apart whose texts differ; the same whenever it is computed."""
    return F.xxhash64(id_col, text_col)


def drop_rows(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs``, all columns, as ``found(id, mark, kept)`` decides; rows it does not name stay.

    ``found`` has a row for every row of ``docs`` that it decides on. Of rows that agree in id and
    text and are kept, one stays. Few decisions are broadcast, more are shuffled. ``docs`` is not
    copied: rows are found again by what they hold.
    """
    counted = found.groupBy("id", "mark").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    decided = materialize(counted.filter("NOT kept OR rows > 1"), "decided")
    few = decided.count() <= BROADCAST_ROWS
    named = decided.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "kept")
    sized = lambda rows: F.broadcast(rows) if few else rows.hint("merge")
    rows = docs.withColumns({"__row_id": F.col(id_col).cast("long"), "__row_mark": row_mark(id_col, text_col)})
    same = F.col("__row_id").eqNullSafe(F.col("__id")) & (F.col("__row_mark") == F.col("__mark"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    left = rows.join(sized(named.drop("kept")), same, "left_anti").select(*columns)
    repeated = named.filter("kept").drop("kept")
    if repeated.isEmpty():
        return left
    once = rows.join(sized(repeated), same, "left_semi").dropDuplicates(["__row_id", "__row_mark"])
    return left.unionByName(once.select(*columns))


def drop_copies(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of every group of equal texts; see ``find_copies``.

    ``docs`` is read three times, so it should be a stored table.
    """
    mark = "__row_mark"

    def drop(docs: DataFrame) -> DataFrame:
        marked = docs.select(id_col, text_col, row_mark(id_col, text_col).alias(mark))
        found = find_copies(marked, keep, id_col, text_col, mark).filter("group_size > 1")
        return drop_rows(docs, found.select(F.col(id_col).alias("id"), F.col("tag").alias("mark"), "kept"), id_col, text_col)

    return on_plain_names(docs, [id_col, text_col], drop)
