"""Documents whose word shingles overlap, joined by their grouped prefixes."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.components import components
from scholium.llm.exact_dedup import drop_rows, row_mark
from scholium.llm.shared import on_plain_names, releasing, ship_package, shuffle_partitions
from scholium.llm.shingles import shingle_sets
from scholium.llm.words import lowered, mix
from scholium.plans.skew import hot_keys, lookup
from scholium.plans.storage import discard, materialize

WIDTH = 5
PERCENT = 80
# Counters of shingle frequency: their number is fixed, so they may be sent everywhere.
SKETCH_BITS = 22
# Up to so many keys, 8 bytes each, are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

_BLOCK = 1 << 12


def _texts(column: pa.Array, size: int = 256) -> Iterator[list[bytes]]:
    for start in range(0, len(column), size):
        yield [lowered(t.as_py()) for t in column.slice(start, size)]


def frequency_levels(docs: DataFrame, width: int = WIDTH, bits: int = SKETCH_BITS, text_col: str = "text") -> np.ndarray:
    """For every value of the first ``bits`` bits of a shingle's hash, how often shingles with them
    occur in all documents, as twice the binary logarithm. An order by it puts rare shingles first."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for texts in _texts(batch.column(0)):
                found = np.concatenate(list(shingle_sets(texts, width)))
                counts += np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        blocks = counts.reshape(-1, _BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        for at in range(0, len(used), 64):
            part = used[at : at + 64]
            data = pa.array([blocks[b].astype("<i8").tobytes() for b in part], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part), data], names=["block", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(data.as_py(), "<i8")
                sums[block] = sums[block] + counts if block in sums else counts
        data = pa.array([s.tobytes() for s in sums.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), data], names=["block", "data"])

    schema = "block long, data binary"
    parts = docs.select(text_col).mapInArrow(releasing(count), schema)
    sums = parts.repartition(shuffle_partitions(docs.sparkSession), "block").mapInArrow(add, schema).toArrow()
    counts = np.zeros((1 << bits) // _BLOCK * _BLOCK, np.int64).reshape(-1, _BLOCK)
    for block, data in zip(sums.column(0).to_pylist(), sums.column(1), strict=True):
        counts[block] = np.frombuffer(data.as_py(), "<i8")
    return (2 * np.log2(counts.ravel() + 1)).astype(np.uint8)


def prefixes(rows: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """``(id, mark, set_key, n, group_key, prefix)`` from ``rows(id, mark, text)``.

    ``set_key`` is a hash of the whole set. ``prefix`` holds the rarest shingles, so many that two
    sets that are similar enough share one; each task gives it once for equal sets. ``group_key``
    is a hash of prefix and size.
    """
    shared = rows.sparkSession.sparkContext.broadcast(levels)
    shift = np.uint64(64 - int(len(levels)).bit_length() + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, given = shared.value, set()
        for batch in batches:
            keys, sizes, groups, found = [], [], [], []
            for texts in _texts(batch.column(2)):
                for hashes in shingle_sets(texts, width):
                    n = len(hashes)
                    sizes.append(n)
                    if not n:
                        keys.append(0), groups.append(0), found.append(None)
                        continue
                    key = int(mix(mix(hashes).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)).view(np.int64)[0])
                    keep = n - (percent * n + 99) // 100 + 1
                    rarity = (levels[(hashes >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))
                    first = np.argpartition(rarity, keep - 1)[:keep] if keep < n else np.arange(n)
                    prefix = hashes[first[np.argsort(rarity[first], kind="stable")]]
                    group = (prefix * (2 * np.arange(len(prefix), dtype=np.uint64) + np.uint64(1))).sum(keepdims=True, dtype=np.uint64)
                    keys.append(key)
                    groups.append(int(mix(group + np.uint64(n)).view(np.int64)[0]))
                    found.append(None if key in given else prefix.view(np.int64))
                    given.add(key)
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())]
            columns += [pa.array(groups, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "set_key", "n", "group_key", "prefix"])

    schema = "id long, mark long, set_key long, n long, group_key long, prefix array<bigint>"
    return rows.mapInArrow(releasing(cut), schema)


def _may_link(n: str, at: str, m: str, bt: str, percent: int) -> Column:
    """Sizes and places of a shared shingle leave room for enough overlap."""
    return F.expr(
        f"""100 * least({n}, {m}) >= {percent} * greatest({n}, {m})
            AND 1 + least({n} - {at} - 1, {m} - {bt} - 1)
                >= ({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}"""
    )


def _sharing(known: DataFrame, percent: int) -> DataFrame:
    """``(g, h)``: groups of ``known(shingle, group_key, n, at, low, high)`` that share a prefix shingle, may
    link by sizes and places, and do not lie in one component together.

    A set of ``n`` shingles whose shared one stands at ``at`` may link with sets of at most ``reach`` shingles.
    Of a pair the smaller set is looked up by the larger one, so only places with ``reach >= n`` are looked up
    at all: the first ninth of a set at 80 percent. A passage that many texts share stands behind their own
    rarer shingles in all but the texts that hold little else, so it makes no pairs of the others. Sizes are in
    bands as wide as the sizes that can link, so a larger set meets one or two bands.
    """
    base = max(100 / percent, 1.1)
    band = lambda size: F.floor(F.log(size.cast("double")) / F.log(F.lit(base))).cast("int")
    reach = F.expr(f"((100 + {percent}) * (n - at)) div {percent} - n")
    least = F.expr(f"({percent} * n + 99) div 100")
    known = known.withColumn("reach", reach)
    looked_up = known.filter("reach >= n").withColumn("band", band(F.col("n"))).alias("l")
    sizes = known.withColumns({"lo": least, "hi": F.least("n", "reach")}).filter("lo <= hi")
    asking = sizes.withColumn("band", F.explode(F.sequence(band(F.col("lo")), band(F.col("hi"))))).alias("r")
    met = looked_up.join(
        asking,
        (F.col("l.shingle") == F.col("r.shingle"))
        & (F.col("l.band") == F.col("r.band"))
        & F.expr("l.n BETWEEN r.lo AND r.hi AND r.n <= l.reach AND (l.n < r.n OR l.group_key < r.group_key)")
        & F.expr("NOT (l.low = l.high AND r.low = r.high AND l.low = r.low)"),
    )
    return met.select(F.col("l.group_key").alias("g"), F.col("r.group_key").alias("h")).distinct()


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def verify(pairs: DataFrame, rows: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` of set keys whose sets overlap enough, compared on whole texts.

    ``reps(set_key, mark)`` names a row of ``rows(mark, text)`` for each set; only those are moved.
    """
    needed = pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct()
    needed = materialize(needed.join(reps, "set_key"), "needed")
    few = needed.count() <= BROADCAST_KEYS
    texts = rows.select("mark", "text").join(F.broadcast(needed) if few else needed.hint("merge"), "mark")
    texts = materialize(texts.dropDuplicates(["set_key"]).select("set_key", "text"), "needed-texts")
    first = texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                text_of = dict(zip(a, part.column(2), strict=True)) | dict(zip(b, part.column(3), strict=True))
                sets = dict(zip(text_of, shingle_sets([lowered(t.as_py()) for t in text_of.values()], width), strict=True))
                for x, y in zip(a, b, strict=True):
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    linked.append(100 * common >= percent * (len(sets[x]) + len(sets[y]) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    links = materialize(both.mapInArrow(releasing(compare), "a long, b long"), "links")
    discard(needed, texts)
    return links


def link_documents(
    docs: DataFrame,
    width: int = WIDTH,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """``(id, n_shingles, component_id, component, mark)`` for every row of ``docs``.

    Two documents link when their sets of distinct ``width``-word shingles, of texts with A-Z in lower
    case, have ``percent`` of a hundred or more in common. ``component_id`` is the smallest id that
    links lead to. The steps:

    1. Equal sets are one. All shingles are put in one order, rare ones first by a fixed number of
       counters over the whole corpus; sets that are similar enough share one of their first ones,
       their prefix. Sets of equal prefix and size form a group.
    2. For every shingle, the group in whose prefix it stands first is its centre. Groups are paired
       with centres only, filtered by sizes and places, expanded to members and verified on texts.
    3. Components of those links are labelled. Then all other pairs of groups that share a prefix
       shingle, pass the filters and are not yet in one component are expanded and verified.

    So links inside a large group of near copies are not all formed, yet none between components is
    missed. Sets and shingles are compared by 64-bit hashes.

    A null text is empty. Texts without words have 0 shingles and link with nothing; their component
    is themselves. Null ids are not a smallest id unless alone. Repeated rows are equal sets. An
    empty table gives no rows. Other columns are ignored. ``mark`` is ``row_mark``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        row_mark(id_col, text_col).alias("mark"),
        F.col(text_col).alias("text"),
    )
    levels = frequency_levels(docs, width, sketch_bits, text_col)
    sets = materialize(prefixes(rows, levels, width, percent), "prefixes")
    filled = sets.filter("n > 0")
    reps = materialize(
        filled.groupBy("set_key").agg(
            F.min("mark").alias("mark"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("rows"),
            F.first("group_key").alias("group_key"),
        ),
        "sets",
    )
    members = reps.select("group_key", "set_key")
    postings = filled.filter("prefix IS NOT NULL").select("group_key", "n", F.posexplode("prefix").alias("at", "shingle"))
    centre = F.min(F.struct("at", "group_key", "n")).alias("centre")
    shared = postings.groupBy("shingle").agg(centre, F.min("group_key").alias("__low"), F.max("group_key").alias("__high"))
    shared = shared.filter("__low <> __high").select("shingle", "centre")
    postings = materialize(postings.join(shared, "shingle"), "postings")
    known_sets = materialize(sets.select("id", "mark", "n", "set_key"), "row-sets")
    discard(sets)

    near = postings.filter("group_key <> centre.group_key").filter(_may_link("n", "at", "centre.n", "centre.at", percent))
    near = near.select("group_key", F.col("centre.group_key").alias("other")).distinct()
    heads = members.groupBy("group_key").agg(F.min("set_key").alias("head"), F.max("set_key").alias("last"))
    own = members.join(heads.filter("head <> last"), "group_key").filter("set_key <> head").select(*_ordered("set_key", "head"))
    near = near.join(heads.select(F.col("group_key").alias("other"), "head"), "other").join(members, "group_key")
    tried = materialize(near.select(*_ordered("set_key", "head")).unionByName(own).distinct(), "pairs")
    links = verify(tried, rows, reps, width, percent)

    labels = components(links)
    labelled = members.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left")
    labelled = materialize(labelled.select("group_key", "set_key", F.coalesce("label", "set_key").alias("label")), "labels")
    groups = labelled.groupBy("group_key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")
    )
    known = postings.join(groups, "group_key").select("shingle", "group_key", "n", "at", "low", "high")
    # Shingles of several components that stand far enough in front of some set, see _sharing.
    front = F.max(F.expr(f"(100 + {percent}) * (n - at) >= 2 * {percent} * n")).alias("__front")
    open_ = known.groupBy("shingle").agg(F.min("low").alias("__low"), F.max("high").alias("__high"), front)
    open_ = open_.filter("__low <> __high AND __front")
    known = materialize(known.join(open_.select("shingle"), "shingle"), "open-postings")
    discard(postings)
    rest = _sharing(known, percent)
    # Members of one group are pairs too, where its members are in several components.
    split = groups.filter("low <> high").select(F.col("group_key").alias("g"), F.col("group_key").alias("h"))
    rest = rest.unionByName(split)
    of_g = labelled.select(F.col("group_key").alias("g"), F.col("set_key").alias("x"), F.col("label").alias("lx"))
    of_h = labelled.select(F.col("group_key").alias("h"), F.col("set_key").alias("y"), F.col("label").alias("ly"))
    rest = rest.join(of_g, "g").join(of_h, "h").filter("lx <> ly").select(*_ordered("x", "y")).distinct()
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    discard(tried, labelled, known)
    more = verify(rest, rows, reps, width, percent)

    if not more.isEmpty():
        labels = components(links.unionByName(more))
    labels = labels.withColumnRenamed("node", "set_key")
    named = reps.join(labels, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    named = materialize(named.select("set_key", "label", "least_id", "rows"), "named")
    discard(reps, rest, links, more)
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    table = materialize(named.join(least, "label").select("set_key", "component_id", "label", "rows"), "set-components")
    discard(named)
    found = lookup(
        known_sets, table.drop("rows"), hot_keys(table, "rows").drop("rows"), "set_key", null_keys=False
    )
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("label").alias("component"),
        "mark",
    )


def keep_first_of_component(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of every component of more than one row: that with the
    smallest id, and among texts with that id the one with the smallest hash. ``docs`` is read for
    every step on texts, so it should be a stored table. See ``link_documents``."""
    return on_plain_names(docs, [id_col, text_col], lambda docs: _keep_first(docs, width, percent, id_col, text_col))


def _keep_first(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    found = link_documents(docs, width, percent, id_col, text_col)
    found = materialize(found.filter("n_shingles > 0").select(F.col(id_col).alias("id"), "mark", "component"), "linked")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("mark"))
    first = found.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows"))
    first = first.filter("rows > 1").select("component", F.col("first.id").alias("first_id"), F.col("first.mark").alias("first_mark"), "rows")
    first = materialize(first, "first")
    met = lookup(found, first.drop("rows"), hot_keys(first, "rows").drop("rows"), "component", null_keys=False)
    kept = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    return drop_rows(docs, met.filter("first_mark IS NOT NULL").select("id", "mark", kept.alias("kept")), id_col, text_col)
