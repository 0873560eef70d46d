"""Bottom-k sketches of word shingles, from built-in column functions only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.llm.shared import SPACE, ordered_totals
from scholium.plans.storage import materialize

SHINGLE_WORDS = 5
SKETCH_SIZE = 128
# Fixed value: the blank characters as a set for trimming.
BLANKS = " \t\n\x0b\x0c\r"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, however often they are used later.

    A generator over one element keeps the optimizer from copying the expression into its uses.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def fingerprint(df: DataFrame, text_col: str, out: str, k: int = SKETCH_SIZE, width: int = SHINGLE_WORDS) -> DataFrame:
    """Adds ``out``: the ``k`` smallest hashes of the distinct shingles of a text, ascending.

    A shingle is ``width`` consecutive words of the lower-cased text; a shorter text is one shingle.
    A null text, and one without words, has the empty sketch. With fewer than ``k`` distinct
    shingles the sketch holds them all, so every estimate from it is exact. Whole texts are read.

    Hashes are spread evenly, so those that can be among the ``k`` smallest are picked by a
    threshold before sorting; where it lets through fewer than ``k``, all are sorted.
    """
    columns = df.columns
    words = F.split(F.lower(F.btrim(F.col(text_col), F.lit(BLANKS))), SPACE)
    df = _once(df, __words=F.when(F.length(F.btrim(F.col(text_col), F.lit(BLANKS))) > 0, words))
    at = ", ".join(f"get(__words, i + {j})" for j in range(width))
    hashes = F.expr(
        f"""CASE WHEN __words IS NULL THEN CAST(array() AS array<bigint>)
                 WHEN size(__words) < {width} THEN array(xxhash64(__words))
                 ELSE transform(sequence(0, size(__words) - {width}), i -> xxhash64({at})) END"""
    )
    df = _once(df, __all=F.array_distinct(hashes)).drop("__words")
    # A share of 2k + 64 of n evenly spread hashes lies below this.
    limit = F.expr(f"-9223372036854775808D + 18446744073709551616D * ({2 * k + 64} / greatest(size(__all), 1))")
    df = _once(df, __limit=limit)
    few = F.expr(f"CASE WHEN size(__all) <= {3 * k} THEN __all ELSE filter(__all, h -> h < __limit) END")
    df = _once(df, __few=few)
    chosen = F.expr(f"slice(sort_array(CASE WHEN size(__few) >= {k} THEN __few ELSE __all END), 1, {k})")
    return _once(df, **{out: chosen}).select(*[F.col(f"`{c}`") for c in [*columns, out]])


def merge(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_rows(df: DataFrame, group: str, sketch: str, k: int = SKETCH_SIZE) -> DataFrame:
    """``(group, sketch)``: one sketch per group.

    Every task sends at most ``k`` hashes per group, so a group of any size may be merged.
    """
    hashes = df.select(group, F.explode(sketch).alias("__h"))
    # Hashes of a group are made distinct where they hash to, not where the group does.
    hashes = hashes.groupBy(group, "__h").agg(F.lit(1).alias("__one")).drop("__one")
    rank = F.row_number().over(Window.partitionBy(group).orderBy("__h"))
    least = hashes.withColumn("__r", rank).filter(F.col("__r") <= k)
    return least.groupBy(group).agg(F.sort_array(F.collect_list("__h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated Jaccard similarity, 0 to 1. Two empty sketches are alike, an empty and another are not."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 for an empty ``a``."""
    union = distinct_shingles(merge(a, b, k), k)
    shared = resemblance(a, b, k) * union
    own = distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / own))


def as_text(sketch: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprint_with_next(docs: DataFrame, k: int = SKETCH_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of every text, of the text edited with its successor's opening, and of the successor.

    Gives ``(id, n_chars, edited, sketch, edited_sketch, next_sketch)``. The last quarter of a text
    (``floor(n_chars / 4)`` code points) is replaced by as many, or all, of the next document's
    first; documents stand in order of id, and the first follows the last. The successor is found
    on ids and lengths alone. Texts are then shuffled once, and each row sends only the opening
    that its predecessor takes.

    A null text is empty. Null ids come first; rows that share an id stand in order of length and
    hash. Rows that repeat id and text are one document in this order, whose row comes as often as they do. A table of
    one document is its own successor. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    keyed = rows.select(
        F.coalesce(F.col("__id"), F.lit(0)).alias("__k"), F.xxhash64("__id", "__text").alias("__h"), "__id", "__text"
    )
    narrow = (
        keyed.select("__k", "__h", "__id", F.length("__text").cast("long").alias("__chars"))
        .groupBy("__k", "__h", "__id", "__chars")
        .agg(F.count(F.lit(1)).alias("__copies"))
    )
    placed = ordered_totals(narrow, [F.col("__id"), F.col("__chars"), F.col("__h")], [])
    following = placed.select(
        ((F.col("row_no") + 1) % F.col("n_rows")).alias("row_no"),
        F.col("__k").alias("__prev_k"),
        F.col("__h").alias("__prev_h"),
        F.expr("CAST(__chars div 4 AS int)").alias("__prev_take"),
    )
    places = materialize(placed.join(following, "row_no").drop("row_no", "n_rows"), "neighbours")
    texts = keyed.select("__k", "__h", "__text")
    if not places.filter("__copies > 1").isEmpty():
        texts = texts.dropDuplicates(["__k", "__h", "__text"])
    here = texts.join(places, ["__k", "__h"])
    opening = fingerprint(
        here.select("__prev_k", "__prev_h", "__text", F.substring("__text", F.lit(1), F.col("__prev_take")).alias("__opening")),
        "__text",
        "next_sketch",
        k,
    ).select(F.col("__prev_k").alias("__k"), F.col("__prev_h").alias("__h"), "__opening", "next_sketch")
    own = here.select("__k", "__h", "__id", "__chars", "__copies", "__text").join(opening, ["__k", "__h"])
    kept = F.substring("__text", F.lit(1), F.expr("CAST(__chars - __chars div 4 AS int)"))
    own = _once(own, edited=F.concat(kept, F.col("__opening")))
    own = fingerprint(fingerprint(own, "__text", "sketch", k), "edited", "edited_sketch", k)
    # As many rows as came.
    own = own.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return own.select(
        F.col("__id").alias(id_col), F.col("__chars").alias("n_chars"), "edited", "sketch", "edited_sketch", "next_sketch"
    )
