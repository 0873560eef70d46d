"""Shuffles that hold when one key has a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.plans.storage import materialize

# A key is hot when it has more than one in HOT_SHARE of all rows. There can be at most HOT_SHARE
# such keys whatever the data is, so a table with one row per hot key may always be broadcast.
HOT_SHARE = 20_000
SALTS = 32
# Bits of the bitmap that tells which keys may be in a table; 64 of them make a row.
BITMAP_BITS = 23


def hot_keys(counts: DataFrame, count: str) -> DataFrame:
    """The rows of ``counts``, one per key, that are hot; at most HOT_SHARE of them."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.filter(F.col(count) * HOT_SHARE > total)


def frequent_keys(rows: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """Every key that has more than ``share`` of the rows, among at most ``1 / share`` keys in all.

    Found in one pass that keeps a few counters per task; no key is shuffled. The result may name
    some rarer keys too, and not the same ones each time, so it is written before it is used.
    """
    items = rows.select(key).stat.freqItems([key], share)
    found = items.select(F.explode_outer(f"{key}_freqItems").alias(key)).filter(F.col(key).isNotNull())
    return materialize(found.distinct(), "frequent")


def membership(rows: DataFrame, members: DataFrame, key: str, how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join of ``rows``, in which one key may repeat very often, with
    ``members``, which has one row per key.

    Rows with a frequent key stay where they are and meet the few members of such keys by
    broadcast; only the others are shuffled.
    """
    hot = F.broadcast(frequent_keys(rows, key))
    hot_members = members.join(hot, key, "left_semi")
    frequent = rows.join(hot, key, "left_semi").join(F.broadcast(hot_members), key, how)
    seldom = rows.join(hot, key, "left_anti").join(members, key, how)
    return frequent.unionByName(seldom)


def lookup(rows: DataFrame, table: DataFrame, hot: DataFrame, key: str, null_keys: bool = True) -> DataFrame:
    """Left join of stored ``rows`` with ``table``, which has one row per string ``key``.

    ``hot`` holds the rows of ``table`` whose keys are hot among ``rows``, see ``hot_keys``. They are
    joined by broadcast, so most rows of a skewed table are never shuffled for the join. Only rows
    with other keys are, and no one of those keys is large. Rows without a key meet nothing;
    ``null_keys`` says whether there can be any. ``rows`` is read once per part; pass a table.
    """
    values = [c for c in table.columns if c != key]
    columns = [*rows.columns, *values]
    hot = F.broadcast(hot.select(*table.columns))
    keyed = rows.filter(F.col(key).isNotNull())
    frequent = keyed.join(hot, key).select(*columns)
    seldom = keyed.join(hot.select(key), key, "left_anti").join(table, key, "left").select(*columns)
    if not null_keys:
        return frequent.unionByName(seldom)
    keyless = rows.filter(F.col(key).isNull())
    for value in values:
        keyless = keyless.withColumn(value, F.lit(None).cast(table.schema[value].dataType))
    return frequent.unionByName(seldom).unionByName(keyless)


def key_bitmap(table: DataFrame, key: str) -> DataFrame:
    """``(__word, __bits)``: the hashes of all keys, in 2^17 rows at most however many keys there are."""
    hashed = table.select(_hash_place(key).alias("__place")).select(
        F.shiftright("__place", 6).alias("__word"), F.expr("shiftleft(1L, CAST(__place & 63 AS INT))").alias("__bit")
    )
    return hashed.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))


def may_match(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is in ``table``, and a few whose key only has the hash of one that is.

    Only a bitmap is broadcast, so this is safe before a shuffle join with a table of any size; the more keys
    the table has, the fewer rows are left out.
    """
    placed = rows.withColumn("__place", _hash_place(key)).withColumn("__word", F.shiftright("__place", 6))
    found = placed.join(F.broadcast(key_bitmap(table, key)), "__word")
    return found.filter("shiftright(__bits, CAST(__place & 63 AS INT)) & 1 = 1").select(*rows.columns)


def _hash_place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITMAP_BITS)).cast("int")


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, spread_by: Sequence[str]) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` much smaller than them, one row per ``key``.

    The table is repeated once per salt, so each key's rows are split over SALTS tasks. It is never
    broadcast: the planner goes by its size before the repeats, and the driver would hold all of them.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int").alias("__salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    joined = rows.select("*", salt).join(table.select("*", every).hint("merge"), [key, "__salt"])
    return joined.drop("__salt")


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread_by: Sequence[str], out: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, numbered from 1 in ``out``.

    The planner limits each window group before its shuffle, so a task sends at most ``n`` rows per
    key. When ``n`` is large, a first round on (key, salt) keeps the last round of a hot key at
    ``n`` rows per salt instead of ``n`` rows per task.
    """
    if n > 100:
        salt = F.pmod(F.xxhash64(*spread_by), F.lit(64))
        window = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (
            df.withColumn("__salt", salt)
            .withColumn("__n", F.row_number().over(window))
            .filter(F.col("__n") <= n)
            .drop("__n", "__salt")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= n)


def number_rows(df: DataFrame, key: str, out: str = "row_no", range_bits: int = 18) -> DataFrame:
    """Number all rows from 1 by the unique integer ``key``, without one global sort.

    Keys that share all but their last ``range_bits`` bits form a range, which so has a bounded
    number of rows. Rows are numbered inside their range, and the running total of the ranges
    before is added. That total has one row per range: a few thousand for a billion rows.
    """
    ranged = df.withColumn("__range", F.shiftright(key, range_bits))
    totals = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__count"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__range", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__offset")
    )
    within = Window.partitionBy("__range").orderBy(key)
    return (
        ranged.withColumn("__n", F.row_number().over(within))
        .join(offsets, "__range")
        .withColumn(out, F.col("__offset") + F.col("__n"))
        .drop("__range", "__n", "__offset")
    )
