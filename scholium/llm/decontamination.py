"""Passages of test items inside documents, found by streaming words through a suffix automaton of the items."""

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.llm.shared import free_name, map_arrow, ordered_totals, ship_package, worker_state
from scholium.llm.words import lowered
from scholium.plans.storage import materialize

WINDOW = 10
# Item text that one automaton holds, and text whose words are listed at once.
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 1 << 18

# Fixed value: a word is a run of digits, a-z and bytes of other characters, after lower-casing A-Z.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_EDGE = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")

MATCH = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("longest", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    ]
)


def word_lists(text: bytes, limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of ``text`` in order, in lists from about ``limit`` bytes each."""
    at = 0
    while at < len(text):
        edge = _EDGE.search(text, min(at + limit, len(text)))
        stop = edge.start() if edge else len(text)
        yield _WORD.findall(text, at, stop)
        at = max(stop, at + 1)


class SuffixAutomaton:
    """All runs of words that occur in any of the items.

    Built one word at a time with a restart before every item, so that one automaton holds them
    all. A state stands for runs that end at the same places; ``link`` leads to its longest suffix
    that ends at more.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._name_items(items)

    def _state(self, length: int, link: int, arcs: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(arcs)
        return len(self.length) - 1

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, known, word)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at != -1:
            to = self.next[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, to, word)
        return new

    def _split(self, at: int, to: int, word: bytes) -> int:
        """A state of its own for the shorter runs of ``to``, those that end ``at`` followed by ``word``."""
        part = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = part
        while at != -1 and self.next[at].get(word) == to:
            self.next[at][word] = part
            at = self.link[at]
        return part

    def _name_items(self, items: list[tuple[str, list[bytes]]]) -> None:
        """For each state that ends a window: the length of the window and the items that have it."""
        self.items: dict[int, set[str]] = {}
        own: dict[int, int] = {}
        for name, words in items:
            size = min(self.window, len(words))
            state = 0
            for place, word in enumerate(words, 1):
                state = self.next[state][word]
                if place >= size:
                    ends = state
                    while self.length[self.link[ends]] >= size:
                        ends = self.link[ends]
                    self.items.setdefault(ends, set()).add(name)
                    # A state may end windows of several lengths, as short items have their own.
                    own[ends] = own.get(ends, 0) | 1 << size
        # Windows that end at a state: its own and those of its suffixes, nearest first.
        self.ends: dict[int, list[tuple[int, int]]] = {}
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            sizes = [size for size in range(self.window, 0, -1) if own.get(state, 0) >> size & 1]
            found = [(size, state) for size in sizes] + self.ends.get(self.link[state], [])
            if found:
                self.ends[state] = found
        self.least = min((size for found in self.ends.values() for size, _ in found), default=0)


class Matcher:
    """Streams the words of one text and gathers windows and the longest run shared with an item."""

    def __init__(self, automaton: SuffixAutomaton):
        self.automaton = automaton

    def match(self, text: bytes) -> tuple[int, int, int, list[str], list[list[int]]]:
        """``(n_words, n_hit, longest, items, spans)``, spans as ``[first, after last]``."""
        auto = self.automaton
        arcs, link, length, ends = auto.next, auto.link, auto.length, auto.ends
        root, least = arcs[0], auto.least
        state = matched = longest = n_words = 0
        spans: list[list[int]] = []
        states: set[int] = set()
        for words in word_lists(text):
            for place, word in enumerate(words, n_words + 1):
                if not state:
                    state = root.get(word, 0)
                    matched = 1 if state else 0
                else:
                    to = arcs[state].get(word)
                    if to is None:
                        while state and to is None:
                            state = link[state]
                            to = arcs[state].get(word)
                        matched = length[state] + 1 if to is not None else 0
                        state = to or 0
                    else:
                        state = to
                        matched += 1
                if matched > longest:
                    longest = matched
                if matched >= least and state in ends:
                    widest = 0
                    for size, ending in ends[state]:
                        if size <= matched:
                            widest = widest or size
                            states.add(ending)
                    if widest:
                        start = place - widest
                        while spans and spans[-1][0] >= start:
                            spans.pop()
                        if spans and spans[-1][1] >= start:
                            spans[-1][1] = place
                        else:
                            spans.append([start, place])
            n_words += len(words)
        found: set[str] = set()
        for ending in states:
            found |= auto.items[ending]
        return n_words, sum(stop - start for start, stop in spans), longest, sorted(found), spans


def item_pieces(items: DataFrame, window: int, id_col: str, text_col: str, piece_bytes: int) -> DataFrame:
    """``(item, words, size)``: the words of each item, joined by blanks. Longer items are cut into pieces that share
    ``window - 1`` words, so every window is whole in one of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, pieces = [], []

            def put(name: str, words: list[bytes]) -> None:
                names.append(name)
                pieces.append(b" ".join(words).decode("utf-8"))

            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: list[bytes] = []
                started = False
                for words in word_lists(lowered(text), piece_bytes):
                    held += words
                    if sum(map(len, held)) + len(held) >= piece_bytes and len(held) >= window:
                        put(name, held)
                        held, started = held[len(held) - window + 1 :], True
                if len(held) >= window or held and not started:
                    put(name, held)
            sizes = pa.array([len(p.encode("utf-8")) + 1 for p in pieces], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.string()), sizes], names=["item", "words", "size"])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "item string, words string, size long").distinct()


def _scan(docs: DataFrame, text_col: str, block: list[tuple[str, str]], window: int, out: str) -> DataFrame:
    """All columns of ``docs`` and ``out``, what the automaton of one block finds in each text."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, MATCH)])
    kind = pa.struct(
        [("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(pa.string())),
         ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
    )
    number = uuid.uuid4().hex

    def automaton() -> SuffixAutomaton:
        return SuffixAutomaton([(name, words.encode("utf-8").split(b" ")) for name, words in shared.value], window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(worker_state(f"automaton:{number}", automaton))
        for batch in batches:
            found = []
            for text in batch.column(place):
                n_words, n_hit, longest, items, spans = matcher.match(lowered(text.as_py()))
                spans = [{"start": start, "stop": stop} for start, stop in spans]
                found.append({"n_words": n_words, "n_hit": n_hit, "longest": longest, "items": items, "spans": spans})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, out])

    return map_arrow(docs, scan, schema)


def _unite(a, row):
    """Adds a span to a list of joint spans that are sorted by their start."""
    last = F.element_at(a, -1)
    joint = F.concat(
        F.slice(a, 1, F.size(a) - 1),
        F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], row["stop"]).alias("stop"))),
    )
    return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["stop"] >= row["start"]), joint).otherwise(F.concat(a, F.array(row)))


def find_matches(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    out: str = "match",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns of ``docs`` and ``out``, a struct ``(n_words, n_hit, longest, items, spans)``.

    Words are runs of digits, letters a-z and characters beyond ASCII after lower-casing A-Z. Each
    ``window`` of consecutive words of an item counts, and an item of fewer words as a whole.
    ``spans`` are the words of a text inside any of them, as first and after last, ``n_hit`` their number, ``items`` the
    ids, as sorted strings, of the items that have one, ``longest`` the longest run of words shared with any item.

    The items' words make a generalised suffix automaton. Items are taken in blocks of ``block_bytes`` (longer items
    are cut with an overlap); a block is broadcast, so its size bounds what a worker holds. With one
    block the documents are read once and nothing is shuffled. With more, they are written once with
    a row number and read once per block; then ``longest`` is that within a block's pieces, and only rows
    with a hit are shuffled, by row.

    A null or empty text, document or item, has no words. Ids of items may repeat and count once; a null one is
    the empty string. Rows pass one by one, repeated ones too; a column that ``docs`` has under the name
    ``out`` is an error. Without items nothing is hit; an empty table gives no rows.
    """
    if out in docs.columns:
        raise ValueError(f"documents have a column {out!r} already; name another one in out")
    spark = docs.sparkSession
    ship_package(spark)
    pieces = ordered_totals(
        materialize(item_pieces(items, window, item_id_col, item_text_col, block_bytes), "items"), [F.col("item"), F.col("words")], ["size"]
    )
    pieces = materialize(pieces.select("item", "words", F.floor(F.col("before_size") / block_bytes).alias("block")), "blocks")
    blocks = [r["block"] for r in pieces.select("block").distinct().orderBy("block").collect()]

    def block(number) -> list[tuple[str, str]]:
        return [(r["item"], r["words"]) for r in pieces.filter(F.col("block") == number).collect()]

    if len(blocks) <= 1:
        return _scan(docs, text_col, block(blocks[0]) if blocks else [], window, out)

    row = free_name("row", docs.columns)
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    texts = numbered.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = None
    for number in blocks:
        hits = _scan(texts, "text", block(number), window, "match").select("row", "match.*").filter("longest > 0")
        hits = materialize(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    united = found.groupBy("row").agg(
        F.max("longest").alias("longest"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), spans.alias("spans")
    )
    united = united.withColumn("spans", F.aggregate("spans", F.slice("spans", 1, 0), _unite))
    # Every row has its number of words from a block of no items.
    counted = _scan(numbered, text_col, [], window, out)
    united = united.select(F.col("row").alias(row), F.struct("longest", "items", "spans").alias("united"))
    mine, both = F.col(f"{out}"), F.col("united")
    length = F.aggregate(both["spans"], F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    whole = F.struct(
        mine["n_words"].alias("n_words"),
        F.coalesce(length, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(both["longest"], F.lit(0).cast("long")).alias("longest"),
        F.coalesce(both["items"], mine["items"]).alias("items"),
        F.coalesce(both["spans"], mine["spans"]).alias("spans"),
    )
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return counted.join(united, row, "left").select(*kept, whole.alias(out))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    coded = text.encode("utf-8")
    kept, at, number, left = [], 0, 0, iter(spans)
    span = next(left, None)
    for word in _WORD.finditer(coded.lower()):
        if span is None:
            break
        if number == span[0]:
            kept.append(coded[at : word.start()])
        number += 1
        if number == span[1]:
            at = word.end()
            span = next(left, None)
    kept.append(coded[at:])
    return b"".join(kept).decode("utf-8")


def remove_matches(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_share: float = 0.5,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without the passages that ``find_matches`` finds.

    A document of which more than ``max_share`` of all words are hit goes as a whole; from the others each span is cut
    out, from its first word to its last. What is not hit stays as it is, nulls and empty texts too.
    """
    out = free_name("match", docs.columns)
    found = find_matches(docs, items, window, text_col, item_id_col, item_text_col, out, block_bytes)
    match = F.col(out)
    kept = found.filter((match["n_hit"] == 0) | (match["n_hit"] <= max_share * match["n_words"]))
    kept = kept.select(*[F.col(f"`{c}`") for c in docs.columns], match["spans"].alias(out))
    place, last = docs.columns.index(text_col), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, spans in enumerate(batch.column(last).to_pylist()):
                if spans:
                    texts[i] = without_spans(texts[i], [(s["start"], s["stop"]) for s in spans])
            columns = [*batch.columns[:place], pa.array(texts, batch.column(place).type), *batch.columns[place + 1 : last]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:last])

    return map_arrow(kept, cut, docs.schema)
