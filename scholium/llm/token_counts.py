"""Token counts by byte-pair merging with a heap over a linked list."""

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.shared import ship_package, worker_state

# Fixed value: how the byte-level tokenizers cut text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_ENTRIES = 600_000

_PLACE = 40
_PLACES = (1 << _PLACE) - 1

# Fixed value: characters that any of the libraries takes for white space.
WHITE = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_AFTER_BLANK = [" " + chr(c) for c in WHITE]
_AFTER_BLANK_ASCII = [pair for pair in _AFTER_BLANK if pair.isascii()]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the
    rest in order from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, other = [], 0
    for b in range(256):
        letters.append(chr(b if b in plain else 256 + other))
        other += b not in plain
    return letters


class Memo(dict):
    """A mapping that computes what it lacks and holds at most twice ``limit`` entries.

    When ``limit`` new entries have come, the ones before them are let go, except those used since.
    """

    def __init__(self, compute, limit: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class MergeCounter:
    """Counts tokens of texts under a byte-level merge list."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        merges = described["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.letters = byte_letters()
        self.cut = regex.compile(pattern)
        special = [t["content"] for t in described.get("added_tokens", [])]
        self.specials = sorted(special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.specials)))
        self.pieces = Memo(self.count_piece, MEMO_ENTRIES // 8)
        self.spaced = Memo(lambda word: sum(map(self.count_piece, self.cut.findall(" " + word))))

    def count_piece(self, piece: str) -> int:
        """Symbols of a piece less the merges made, lowest rank first, leftmost among equals."""
        symbols = [self.letters[b] for b in piece.encode("utf-8")]
        n, rank_of = len(symbols), self.ranks.get
        # An entry is a rank and the place of its left symbol in one number.
        heap = [r << _PLACE | i for i, p in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(p)) is not None]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & _PLACES, entry >> _PLACE
            j = after[i]
            if j >= n or rank_of((symbols[i], symbols[j])) != rank:
                continue  # one of the two has been merged meanwhile
            joined = symbols[i] = symbols[i] + symbols[j]
            symbols[j] = None
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank_of((joined, symbols[k]))) is not None:
                    heapq.heappush(heap, r << _PLACE | i)
            h = before[i]
            if h >= 0 and (r := rank_of((symbols[h], joined))) is not None:
                heapq.heappush(heap, r << _PLACE | h)
        return left

    def _cut_and_count(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.cut.findall(text)))

    def _plain(self, text: str) -> int:
        """Words between single blanks are counted once per distinct word.

        A cut never joins a character that is not white space with following white space, so text
        may be taken apart before a blank that is not followed by more white space.
        """
        pairs = _AFTER_BLANK_ASCII if text.isascii() else _AFTER_BLANK
        if text.endswith(" ") or any(pair in text for pair in pairs):
            return self._cut_and_count(text)
        first, *words = text.split(" ")
        return self._cut_and_count(first) + sum(map(self.spaced.__getitem__, words))

    def count(self, text: str) -> int:
        if not any(special in text for special in self.specials):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for every row: tokens of the whole text under a byte-level
    merge list, a ``tokenizers`` file whose path all executors can open.

    Every distinct piece of text is merged by a heap of adjacent pairs over a linked list; its count
    is its bytes less the merges. Counts of pieces are remembered within a worker, up to a bound.
    Special strings inside a text count as one token each, no others are added.

    A null text is empty, with 0 tokens. Ids pass through, null and repeated ones too. An empty
    table gives no rows. Other columns are ignored. Nothing is shuffled.
    """
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(f"merges:{vocabulary}", lambda: MergeCounter(vocabulary))
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode("utf-8")))
                tokens.append(counter.count(text))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumnRenamed("id", id_col)
