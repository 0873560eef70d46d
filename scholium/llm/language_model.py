"""Scores of texts under prediction by partial matching over bytes."""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.shared import ship_package, worker_state
from scholium.llm.words import CountTable, chunks, lowered, word_hashes
from scholium.plans.storage import materialize

ORDER = 5
# Contexts and their symbols that one pass over the texts holds, 24 bytes each or so.
BLOCK_GRAMS = 5_000_000
# A word is common when it is more than one in so many training tokens, so at most so many are.
COMMON_SHARE = 1 << 20
# Entries that a task counts before it sends them on.
BUFFER_ENTRIES = 1_500_000
# Rows whose texts are held as bytes at once.
_SLICE = 512

# Bytes that no UTF-8 text has: what stands before a text, and its end. The end is a symbol.
_BEFORE, _END = 0xFE, 0xFF
_SYMBOLS = 255
# The key of the token that ends every document.
_END_WORD = np.uint64(0)


def gram_codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, bounds)``: the symbol at every place of each text, its end included, below the
    ``order`` bytes before it; text ``i`` has the codes ``bounds[2i]`` to ``bounds[2i+1]``."""
    lead, end = bytes([_BEFORE]) * order, bytes([_END])
    data = np.frombuffer(b"".join([lead + t + end for t in texts] + [lead]), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes + order) - sizes - order
    codes = np.zeros(len(data) - order, np.uint64)
    for j in range(order + 1):
        codes <<= np.uint64(8)
        codes |= data[j : len(data) - order + j]
    return codes, np.stack([starts, starts + sizes], axis=1).ravel()


def _slices(column: pa.Array) -> Iterator[list[bytes]]:
    for start in range(0, len(column), _SLICE):
        yield [lowered(t.as_py()) for t in column.slice(start, _SLICE)]


class _Counter:
    """Counts of 64-bit keys, merged whenever enough new ones have come."""

    def __init__(self):
        self.keys, self.counts, self.pending, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.pending.append(np.unique(keys, return_counts=True))
        self.size += len(self.pending[-1][0])
        if self.size > max(1 << 20, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.pending]])
        counts = np.concatenate([self.counts, *[c for _, c in self.pending]])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(at, weights=counts, minlength=len(self.keys)).astype(np.int64)
        self.pending, self.size = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        found = self.keys, self.counts
        self.__init__()
        return found


def count_training(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """``(word, key, n)``: how often each word (``word`` true) and each symbol below its context
    occurs in all texts. Words are 64-bit hashes, symbols are codes; the end of a text is a word too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(is_word: bool, counter: _Counter):
            keys, counts = counter.take()
            for at in range(0, len(keys), 1 << 17):
                part = keys[at : at + (1 << 17)]
                columns = [pa.array(np.full(len(part), is_word)), pa.array(part.view(np.int64)), pa.array(counts[at : at + len(part)])]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "key", "n"])

        worker_state("context_trie", dict).clear()
        words, grams = _Counter(), _Counter()
        for batch in batches:
            for texts in _slices(batch.column(0)):
                for _, chunk in chunks(texts):
                    hashes, _ = word_hashes(chunk)
                    words.add(np.concatenate([hashes, np.full(len(chunk), _END_WORD)]))
                    codes, bounds = gram_codes(chunk, order)
                    inside = np.repeat(np.tile([True, False], len(chunk)), np.diff(np.append(bounds, len(codes))))
                    grams.add(codes[inside])
            if len(words.keys) + len(grams.keys) > BUFFER_ENTRIES:
                yield from rows(True, words)
                yield from rows(False, grams)
        yield from rows(True, words)
        yield from rows(False, grams)

    counted = docs.select(text_col).mapInArrow(count, "word boolean, key long, n long")
    return counted.groupBy("word", "key").agg(F.sum("n").alias("n"))


class ContextTrie:
    """Counts of symbols below contexts of 0 to ``order`` bytes, as sorted arrays for each length.

    Escapes are estimated by method D: a context that was seen with ``d`` symbols ``t`` times gives
    ``d / 2t`` to all others and ``(c - 1/2) / t`` to a symbol seen ``c`` times. The next shorter
    context then excludes those ``d`` symbols.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, low: np.ndarray, low_counts: np.ndarray, order: int):
        """``codes`` hold all symbols of the longest contexts wanted, those of one ending of two
        bytes together; ``low`` are the codes of one-byte contexts of the whole corpus."""
        self.order = order
        self.grams, self.counts = [None] * (order + 1), [None] * (order + 1)
        for k in range(order, -1, -1):
            source, n = (codes, counts) if k > 1 else (low, low_counts)
            kept = np.asarray(source, np.uint64) & np.uint64((1 << 8 * (k + 1)) - 1)
            self.grams[k], at = np.unique(kept, return_inverse=True)
            self.counts[k] = np.bincount(at, weights=n, minlength=len(self.grams[k])).astype(np.float32)
        self.contexts, self.totals, self.kinds, self.lower_totals, self.lower_kinds = [], [], [], [], []
        for k in range(order + 1):
            context, begin = np.unique(self.grams[k] >> np.uint64(8), return_index=True)
            self.contexts.append(context)
            self.totals.append(np.add.reduceat(self.counts[k], begin, dtype=np.float64) if len(begin) else np.zeros(0))
            self.kinds.append(np.diff(np.append(begin, len(self.grams[k]))).astype(np.int32))
            if k:
                below = np.uint64((1 << 8 * k) - 1)
                same = self.counts[k - 1][np.searchsorted(self.grams[k - 1], self.grams[k] & below)]
                up = np.searchsorted(self.contexts[k - 1], context & (below >> np.uint64(8)))
                excluded = np.add.reduceat(same, begin, dtype=np.float64) if len(begin) else np.zeros(0)
                self.lower_totals.append(self.totals[k - 1][up] - excluded)
                self.lower_kinds.append(self.kinds[k - 1][up] - self.kinds[k])
            else:
                self.lower_totals.append(np.zeros(len(context)))
                self.lower_kinds.append(_SYMBOLS - self.kinds[k])
        at = np.searchsorted(self.contexts[order], self.grams[order] >> np.uint64(8))
        likely = (self.counts[order] - 0.5) / self.totals[order][at]
        self.table = CountTable(self.grams[order], np.log10(likely).astype(np.float32))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each code's symbol after its context."""
        found, known = self.table.find(codes)
        found = found.astype(np.float64)
        if not known.all():
            left = np.flatnonzero(~known)
            distinct, at = np.unique(codes[left], return_inverse=True)
            found[left] = self._escaping(distinct)[at]
        return found

    def _escaping(self, codes: np.ndarray) -> np.ndarray:
        result = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        total, kinds = np.zeros(len(codes)), np.zeros(len(codes))
        escaped = np.zeros(len(codes), bool)
        for k in range(self.order, -1, -1):
            if not len(open_) or not len(self.contexts[k]):
                continue
            gram = codes[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.contexts[k], gram >> np.uint64(8)), len(self.contexts[k]) - 1)
            here = self.contexts[k][at] == gram >> np.uint64(8)
            fresh = here & ~escaped[open_]
            total[open_[fresh]], kinds[open_[fresh]] = self.totals[k][at[fresh]], self.kinds[k][at[fresh]]
            place = np.minimum(np.searchsorted(self.grams[k], gram), len(self.grams[k]) - 1)
            seen = here & (self.grams[k][place] == gram)
            hit = open_[seen]
            result[hit] += np.log10((self.counts[k][place[seen]] - 0.5) / total[hit])
            miss, at_miss = open_[here & ~seen], at[here & ~seen]
            some = kinds[miss] > 0
            result[miss[some]] += np.log10(kinds[miss[some]] / (2 * total[miss[some]]))
            total[miss], kinds[miss] = self.lower_totals[k][at_miss], self.lower_kinds[k][at_miss]
            escaped[miss] = True
            open_ = open_[~seen]
        # Never seen at all: evenly among the symbols that are left.
        left = np.where(escaped[open_], np.maximum(kinds[open_], 1), _SYMBOLS)
        result[open_] -= np.log10(left)
        return result


def _block(ending: np.ndarray, blocks: int) -> np.ndarray:
    return (ending * np.uint64(40503) >> np.uint64(4)) % np.uint64(blocks)


def score(
    docs: DataFrame,
    counts: DataFrame,
    order: int = ORDER,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_grams: int = BLOCK_GRAMS,
    common_share: int = COMMON_SHARE,
) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    ``counts`` is a table from ``count_training``. ``score`` is the log10 probability of the
    lower-cased text and its end under ``ContextTrie``. ``base_score`` is that of the words and the
    end by add-one smoothed counts. With more than ``block_grams`` codes the trie is used in blocks:
    contexts with the same last two bytes, and so all their shorter ones down to two bytes, are in
    one block, each pass scores the places of its block, and the sums are added.

    Words that are more than one in ``common_share`` training tokens are looked up where the text
    is; the others are shuffled by word to their counts, and one sum per text comes back.

    A null text is empty: one token, its end. Ids pass through; repeated rows are scored one by
    one. If nothing was learned, symbols are equally likely and ``n_known`` is 0. An empty table
    gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    words, grams = counts.filter("word"), counts.filter("NOT word")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).head()
    train_tokens, vocabulary = sums[0], sums[1]
    common = words.filter(F.col("n") * common_share > train_tokens).select("key", "n").toArrow()
    n_grams = grams.count()
    blocks = max(1, -(-n_grams // block_grams))
    low = grams.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    ending = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    block = F.shiftright(ending * 40503, 4) % blocks

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table.column("key").to_numpy().astype(np.int64).view(np.uint64), table.column("n").to_numpy().astype(np.int64)

    low, version = arrays(low), uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(arrays(common))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def word_part(texts: list[bytes], table: CountTable):
        n, known, likely, rare = [], [], [], []
        for _, chunk in chunks(texts):
            hashes, sizes = word_hashes(chunk)
            owner = np.repeat(np.arange(len(chunk)), sizes)
            c, found = table.find(hashes)
            end, _ = table.find(np.full(1, _END_WORD))
            n.append(sizes + 1)
            known.append(np.bincount(owner[found], minlength=len(chunk)) + (end[0] > 0))
            likely.append(np.bincount(owner, weights=np.log10(c + 1.0), minlength=len(chunk)) + np.log10(end[0] + 1.0))
            rest = owner[~found]
            bounds = np.searchsorted(rest, np.arange(len(chunk) + 1)).astype(np.int32)
            rare.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes[~found].view(np.int64))))
        return [pa.array(np.concatenate(x).astype(t)) for x, t in ((n, np.int64), (known, np.int64), (likely, np.float64))] + [
            pa.concat_arrays(rare)
        ]

    def scored(number: int, trie_data, with_words: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A worker keeps one trie, for all its tasks of this pass.
            kept = worker_state("context_trie", dict)
            for batch in batches:
                if not batch.num_rows:
                    continue
                if kept.get("key") != (version, number):
                    kept.clear()
                    kept["trie"] = ContextTrie(*trie_data.value, *low, order)
                    kept["words"] = CountTable(*shared.value)
                    kept["key"] = (version, number)
                trie, table = kept["trie"], kept["words"]
                for start in range(0, batch.num_rows, _SLICE):
                    part = batch.slice(start, _SLICE)
                    texts = [lowered(t.as_py()) for t in part.column(1)]
                    likely = []
                    for _, chunk in chunks(texts):
                        codes, bounds = gram_codes(chunk, order)
                        if blocks == 1:
                            values = trie.log10(codes)
                        else:
                            here = _block(codes >> np.uint64(8) & np.uint64(0xFFFF), blocks) == number
                            values = np.zeros(len(codes))
                            values[here] = trie.log10(codes[here])
                        # The codes between two texts span both and are left out.
                        likely.append(np.add.reduceat(np.append(values, 0.0), bounds)[::2])
                    columns = [part.column(0), part.column(2), pa.array(np.concatenate(likely))]
                    names = ["id", "tag", "likely"]
                    if with_words:
                        columns += word_part(texts, table)
                        names += ["n_tokens", "known", "common", "rare"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        return run

    whole = None
    if blocks > 1:
        # Row tags must be the same in every pass.
        rows = materialize(rows.withColumn("tag", F.monotonically_increasing_id()), "scored-rows")
    else:
        rows = rows.withColumn("tag", F.monotonically_increasing_id())
    for number in range(blocks):
        data = spark.sparkContext.broadcast(arrays(grams.filter(block == number).select("key", "n").toArrow()))
        columns = f"id {kind}, tag long, likely double"
        if number == 0:
            columns += ", n_tokens long, known long, common double, rare array<bigint>"
        passed = materialize(rows.mapInArrow(scored(number, data, number == 0), columns), "scores")
        if whole is None:
            whole = passed
        else:
            whole = whole.join(passed.select("tag", F.col("likely").alias("__more")), "tag")
            whole = whole.withColumn("likely", F.col("likely") + F.col("__more")).drop("__more")
    seldom = whole.select("tag", F.explode("rare").alias("key")).join(
        words.filter(F.col("n") * common_share <= train_tokens).select("key", "n"), "key"
    )
    seldom = seldom.groupBy("tag").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("__log"), F.count(F.lit(1)).alias("__known"))
    joined = whole.drop("rare").join(seldom, "tag", "left")
    unit = float(np.log10(train_tokens + vocabulary + 1.0))
    log = F.col("common") + F.coalesce("__log", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("__known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (log - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        F.col("likely").alias("score"),
    )


def train_and_score(
    docs: DataFrame, trained: str = "NOT held_out", order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Scores all ``docs`` under a model of those for which ``trained`` holds; see ``score``."""
    ship_package(docs.sparkSession)
    counts = materialize(count_training(docs.filter(trained), order, text_col), "lm-counts")
    return score(docs, counts, order, id_col, text_col, **options)
