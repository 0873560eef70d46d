"""Mixing sources to target weights by Pareto order sampling."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.fingerprints import BLANKS
from scholium.llm.shared import SPACE, on_plain_names, ordered_totals
from scholium.plans.skew import hot_keys, lookup
from scholium.plans.storage import materialize

CAP = 3.0


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def source_sizes(rows: DataFrame) -> DataFrame:
    """``(source, rows, source_size)`` from ``(source, size)``; sources are few against documents."""
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    return materialize(sizes, "sources")


def cycle_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Adds ``weight``: the weights over and over, in order of source by code point, null last."""
    placed = ordered_totals(sources, [F.col("source").asc_nulls_last()], [])
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    number = (F.col("row_no") % len(weights)).cast("int")
    return placed.select(*sources.columns, F.get(cycle, number).alias("weight"))


def targets(sources: DataFrame, total: Column | None = None, cap: float = CAP) -> DataFrame:
    """Adds ``target``: ``total`` words (by default all there are) shared by ``weight``.

    No target exceeds ``cap`` times its source's size; the excess is shared again by weight among
    the others until none does. That is one level per unit of weight: sources stand in order of
    the level at which they are full, and the level follows from running totals.
    """
    full = sources.withColumn("__full", F.lit(cap) * F.col("source_size"))
    ratio = F.col("__full") / F.col("weight")
    order = [ratio, F.col("source").asc_nulls_last()]
    placed = ordered_totals(full, order, ["__full", "weight", "source_size"])
    whole = F.col("total_source_size") if total is None else total
    level = (whole - F.col("before___full")) / (F.col("total_weight") - F.col("before_weight"))
    placed = materialize(placed.withColumn("__level", level), "levels")
    reached = placed.filter(F.col("__level") <= ratio).agg(F.min_by("__level", "row_no")).head()[0]
    target = F.col("__full") if reached is None else F.least(F.col("__full"), F.lit(reached) * F.col("weight"))
    return placed.select(*sources.columns, target.alias("target"))


def length_odds(size: Column, mean: Column) -> Column:
    """Factor of a document's inclusion odds by its size: 2 for an empty one, 1 at the mean, towards 0 for very
    long ones. A very long document then seldom stands where a source reaches its target, which it would miss widely."""
    return F.coalesce(2 * mean / F.nullif(size + mean, F.lit(0.0)), F.lit(1.0))


def mix(rows: DataFrame, sources: DataFrame, seed: int = 7, weight_col: str | None = None, by_length: bool = False) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` to ``rows(source, size, mark, ...)``.

    Every document gets the whole part of target / source size as certain copies. The words still
    lacking are drawn from the fractional part: documents are ranked by random odds
    ``u / (1 - u)`` divided by their inclusion odds, and taken in that order until their words come
    nearest to what lacks, so a source misses its target by at most half a document. ``u`` is a
    hash of ``mark`` and ``seed``: reruns agree, also after lost executors. ``weight_col`` names a
    positive factor of a document's inclusion odds; ``by_length`` takes ``length_odds`` for it; without
    either the documents of a source are alike.

    Documents of a large source are ranked in many ranges at once, see ``ordered_totals``.
    Sources of which many rows are meet them by broadcast, see ``hot_keys``.
    """
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    table = ordered_totals(sources.withColumn("__source_key", key), [F.col("__source_key")], ["source_size"]).select(
        "__source_key", "source_size", "target", "rows", F.col("before_source_size").alias("__start"),
        (F.col("source_size") / F.col("rows")).alias("__mean"),
    )
    table = materialize(table, "targets")
    hot = hot_keys(table, "rows").drop("rows")
    rows = materialize(rows.withColumn("__source_key", key), "mix-rows")
    known = lookup(rows, table.drop("rows"), hot, "__source_key", null_keys=False)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mark"), 11).cast("double") + 0.5) / F.lit(2.0**53)
    known = known.withColumns({"__certain": F.floor(expected), "__part": expected - F.floor(expected), "__u": uniform})
    own = F.col(weight_col) if weight_col else length_odds(F.col("size"), F.col("__mean")) if by_length else F.lit(1.0)
    inclusion = F.col("__part") / (1 - F.col("__part")) * own
    rank = F.when(inclusion > 0, F.col("__u") / (1 - F.col("__u")) / inclusion)
    known = known.withColumn("__rank", rank).drop("__u", "__part", "__mean")
    order = [F.col("__source_key"), F.col("__rank"), F.col("mark"), F.col("size")]
    placed = ordered_totals(known, order, ["size"])
    lacking = F.col("target") - F.col("__certain") * F.col("source_size")
    before = F.col("before_size") - F.col("__start")
    extra = F.col("__rank").isNotNull() & (2 * before + F.col("size") <= 2 * lacking)
    copies = F.col("__certain") + F.when(extra, 1).otherwise(0)
    kept = [c for c in rows.columns if c != "__source_key"]
    return placed.select(*kept, "source_size", "target", copies.cast("int").alias("copies"))


def mix_documents(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    cap: float = CAP,
    seed: int = 7,
    even: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tag_col: str | None = None,
) -> DataFrame:
    """``(id, size, source_size, target, copies)`` for every row of ``docs``, whose size is its words.

    Sources in order of code point, null last, have ``weights`` over and over, and share all words
    there are; see ``targets`` and ``mix``. Beyond the certain copies a document's inclusion odds depend on its
    size, see ``length_odds``; ``even`` makes those of a source alike. ``tag_col`` names a column to carry along.

    A null text has size 0. A null source is a source. A source without words has target 0. Null
    ids are allowed; rows that repeat id and text tie and are taken one by one. An empty table
    gives no rows. Other columns are ignored.
    """
    tags = [F.col(tag_col).alias("tag")] if tag_col else []
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(id_col, text_col).alias("mark"),
        *tags,
    )
    rows = materialize(rows, "sized")
    sources = targets(cycle_weights(source_sizes(rows), weights), cap=cap)
    mixed = mix(rows, sources, seed, by_length=not even)
    carried = ["tag"] if tag_col else []
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", *carried)


def repeat_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = CAP, seed: int = 7) -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it; see ``mix_documents``."""
    return on_plain_names(docs, ["doc_id", "text", "source"], lambda docs: _repeat(docs, weights, cap, seed))


def _repeat(docs: DataFrame, weights: Sequence[float], cap: float, seed: int) -> DataFrame:
    tag = "__row_tag"
    tagged = materialize(docs.withColumn(tag, F.monotonically_increasing_id()), "tagged")
    mixed = mix_documents(tagged, weights, cap, seed, tag_col=tag).filter("copies > 0")
    mixed = mixed.select(F.col("tag").alias(tag), F.col("copies").alias("__copies"))
    repeated = tagged.join(mixed, tag).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
