"""Packing token sequences: best-fit decreasing, certified by lower bounds, repacked where they leave a gap."""

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.shared import releasing, ship_package, small_batches, worker_state
from scholium.llm.token_counts import byte_letters
from scholium.plans.storage import materialize

CAPACITY = 4096
END_ID = 1
# Pieces that one task packs; a task holds a few numbers for each.
PIECES_PER_TASK = 1 << 16

_SPACE = re.compile("[ \n]")
_WORD = re.compile("[^ \t\n\v\f\r]+")
_PIECES = "piece int, start long, length long, ids_crc32 long"


# Fixed value: how the word tokenizer cuts lower-case text before merging.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
# Words, and runs in them, that a worker remembers, and the longest of these.
REMEMBERED, LONGEST_REMEMBERED = 250_000, 64


class Recent(dict):
    """Values by text, computed when missing. It holds the last ``limit`` to twice as many short texts."""

    def __init__(self, compute, limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, text: str) -> bytes:
        value = self.old.get(text)
        if value is None:
            value = self.compute(text)
        if len(text) <= LONGEST_REMEMBERED:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[text] = value
        return value


class WordIds:
    """Token ids of texts as little-endian 32-bit numbers.

    For tokenizers that compose and lower-case text, drop white space and merge the bytes of runs of
    letters, of digits or of marks: a text's ids are its words' ids, and those are their runs' ids. A new run is
    merged by the tokenizer's own model. Words with characters that composing might change, or that may hold special
    strings, go through the whole tokenizer. ``remembered`` bounds the memory, see ``Recent``; ids do not depend on it.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = dict(enumerate(byte_letters()))
        self.cut = regex.compile(RUNS)
        # Below U+0300 no character composes with others. Separators that libraries disagree on are left to the tokenizer.
        self.other = re.compile("[^\x00-\x1b\x20-\x84\x86-\u02ff]|<\\|")
        self.words, self.runs = Recent(self._word, remembered), Recent(self._run, remembered)

    def _run(self, run: str) -> bytes:
        spelled = run if run.isascii() else run.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = [token.id for token in self.tokenizer.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.runs[word.lower()]
        if self.other.search(word):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join([self.runs[run] for run in self.cut.findall(word.lower())])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORD.findall(text)))

    def encode_parts(self, text: str, limit: int = 1 << 18) -> Iterator[bytes]:
        """The same in parts, each from about ``limit`` characters up to the next white space."""
        at = 0
        while at < len(text):
            edge = _SPACE.search(text, at + limit)
            stop = edge.start() if edge else len(text)
            yield self.encode(text[at:stop])
            at = stop


def cut_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
    remembered: int = REMEMBERED,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: every text as ids and an end id, cut only where it
    is longer than ``capacity``. A null text is empty and has the end id alone."""
    ship_package(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"ids:{vocabulary}:{remembered}", lambda: WordIds(vocabulary, remembered))
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = b"".join([*encoder.encode_parts(value.as_py() or ""), end])
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                *[pa.array(values, pa.int64()) for values in (start, length, crc)],
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(releasing(cut), f"id {kind}, {_PIECES}")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and how full each bin is.

    Bins are kept by the room they have left, and a bit set tells which amounts occur, so the
    tightest bin for an item is found without a search.
    """
    place = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, room_of = 0, []
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(room_of)
            room_of.append(capacity)
        place[item], offset[item] = chosen, capacity - room
        room -= size
        room_of[chosen] = room
        if room:
            by_room[room].append(chosen)
            rooms |= 1 << room
    return place, offset, capacity - np.asarray(room_of, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; ``counts[s]`` items have size ``s``, up to ``capacity``.

    The largest of the bounds by dual-feasible functions: for every threshold ``t`` up to half the
    capacity, items above ``capacity - t`` fill a bin and those below ``t`` count nothing; and for
    ``k`` up to 100 sizes are rounded to ``k``-ths of a bin, exact multiples of ``1/(k+1)`` kept.
    """
    counts = np.asarray(counts, np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    volume = np.concatenate([[0], np.cumsum(counts * sizes)])
    number = np.concatenate([[0], np.cumsum(counts)])
    t = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - t + 1]
    middle = volume[capacity - t + 1] - volume[t]
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 101):
        scaled = (k + 1) * sizes
        worth = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((counts * worth).sum()) // (k * capacity)))
    return best


def _pack(capacity: int, round_no: int):
    """Packs a partition. Pieces of bins that the next round may repack are marked ``loose``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        part = TaskContext.get().partitionId()
        lengths = table.column("length").to_numpy().astype(np.int64)
        place, offset, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        # With a gap all bins with room are repacked; a certified partition offers its emptiest.
        loose = fill < capacity if len(fill) > bound else (fill == fill.min()) & (fill < capacity)
        numbers = ((round_no << 24 | part) << 28) + place
        made = table.select([c for c in table.column_names if c not in ("sequence_id", "offset", "loose", "bound")])
        made = made.append_column("sequence_id", pa.array(numbers, pa.int64()))
        made = made.append_column("offset", pa.array(offset, pa.int64()))
        made = made.append_column("loose", pa.array(loose[place], pa.bool_()))
        made = made.append_column("bound", pa.array(np.full(len(place), bound), pa.int64()))
        yield from made.to_batches(1 << 16)

    return pack


def _bins(packed: DataFrame) -> int:
    """How many sequences: each has one piece at its start."""
    return packed.filter("offset = 0").count()


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds ``sequence_id``, ``offset`` and ``least_sequences`` to ``pieces``, whose ``length`` is 1 to ``capacity``.

    Pieces are dealt evenly to tasks of at most about ``pieces_per_task``, each packed by best-fit
    decreasing and held against its lower bound. While there are more sequences than the bound of
    all pieces together, the sequences with room of the partitions that have a gap, and the
    emptiest of the others, are pooled, dealt anew and repacked, as long as that saves sequences.
    Only lengths and ids move. ``least_sequences`` is that bound: no packing has fewer sequences.
    """
    schema = pieces.schema.simpleString().removeprefix("struct<").removesuffix(">")
    schema += ", sequence_id: bigint, offset: bigint, loose: boolean, bound: bigint"
    sizes = pieces.groupBy("length").count().collect()  # one row per length, at most ``capacity``
    counts = np.zeros(capacity + 1, np.int64)
    for row in sizes:
        counts[row["length"]] = row["count"]
    need = lower_bound(counts, capacity)

    def packed(rows: DataFrame, n: int, round_no: int) -> DataFrame:
        dealt = rows.repartition(max(1, -(-n // pieces_per_task)))
        return materialize(dealt.mapInArrow(releasing(_pack(capacity, round_no)), schema), f"packed-{round_no}")

    settled, current = None, packed(pieces, int(counts.sum()), 1)
    total = _bins(current)
    round_no = 1
    while total > need:
        round_no += 1
        loose = current.filter("loose")
        again = packed(loose, loose.count(), round_no)
        saved = _bins(loose) - _bins(again)
        if saved <= 0:
            break
        done = current.filter("NOT loose")
        settled = done if settled is None else settled.unionByName(done)
        current, total = again, total - saved
    whole = current if settled is None else settled.unionByName(current)
    return whole.drop("loose", "bound").withColumn("least_sequences", F.lit(need))


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    pieces_per_task: int = PIECES_PER_TASK,
    id_col: str = "doc_id",
    text_col: str = "text",
    remembered: int = REMEMBERED,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset, least_sequences)``: all texts packed into
    sequences of at most ``capacity`` tokens.

    A text's ids come from the tokenizer file ``vocabulary`` and are followed by ``end_id``; only a
    longer one is cut, see ``cut_pieces``. Packing is ``pack_pieces``. A worker remembers the ids of up to twice
    ``remembered`` words: more take memory, fewer take time, the rows are the same.

    A null text is empty: its end id is packed. Ids pass through, null and repeated ones too, and
    repeated rows are packed one by one. An empty table gives no rows. Other columns are ignored.
    """
    with small_batches(docs.sparkSession):
        pieces = materialize(cut_pieces(docs, vocabulary, capacity, end_id, id_col, text_col, remembered), "pieces")
    return pack_pieces(pieces, capacity, pieces_per_task).withColumnRenamed("id", id_col)
