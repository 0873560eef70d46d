"""Alignment of two tokenizers over the same texts: groups of tokens that cover the same bytes, and linked ids."""

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.llm.shared import free_name, map_arrow, ship_package, worker_state
from scholium.llm.token_counts import PATTERN, WHITE, byte_letters
from scholium.plans.storage import materialize

# Characters that are encoded at once.
SEGMENT = 1 << 18
# Rows that are worked on at once after the tokenizers have run.
SLICE = 2048

ALIGNED = T.StructType(
    [
        T.StructField("n_a", T.LongType()),
        T.StructField("n_b", T.LongType()),
        T.StructField("n_groups", T.LongType()),
        T.StructField("groups", T.StringType()),
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("codes", T.ArrayType(T.IntegerType())),
        T.StructField("times", T.ArrayType(T.IntegerType())),
    ]
)
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def _bytes_of_a(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level ``tokenizers`` file; ids without any are empty."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    byte_of = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
    added = {t["id"]: t["content"].encode("utf-8") for t in described.get("added_tokens", [])}
    entries = described["model"]["vocab"]
    found = [b""] * (max([*entries.values(), *added]) + 1)
    for entry, i in entries.items():
        found[i] = added[i] if i in added else b"".join(byte_of[letter] for letter in entry)
    return found


def _bytes_of_b(model) -> list[bytes]:
    """The bytes of each piece of a ``sentencepiece`` model: U+2581 is a blank, <0xHH> a byte."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)
    ]


def _ranks_of_a(path: str, entries: list[bytes]) -> dict[bytes, int] | None:
    """Ids by bytes if the ids of all merges follow their order after the single bytes, else null."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(m)) for m in merges]
    if model.get("byte_fallback") or model.get("dropout") or made != [*range(256, 256 + len(made))]:
        return None
    return {entry: i for i, entry in enumerate(entries[: 256 + len(made)])}


class Links:
    """Numbers for all pairs of ids that a link can hold.

    Linked tokens end at the same byte, so one's bytes end with the other's; that leaves a few pairs
    for each entry of either vocabulary, however large the corpus. Code ``a`` below ``len(identity)``
    stands for the pair of ``a`` and ``identity[a]``, the entry of B with the same bytes; higher codes
    stand for the pairs in ``others``, sorted.
    """

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        by_a, by_b = {}, {}
        for table, entries in ((by_a, a_bytes), (by_b, b_bytes)):
            for i, entry in enumerate(entries):
                if entry:
                    table.setdefault(entry, []).append(i)
        self.identity = np.array([by_b.get(entry, [-1])[-1] if entry else -1 for entry in a_bytes], np.int64)
        pairs = set()
        for entry, own in by_a.items():
            pairs.update((a, b) for at in range(len(entry)) for b in by_b.get(entry[at:], ()) for a in own)
        for entry, own in by_b.items():
            pairs.update((a, b) for at in range(len(entry)) for a in by_a.get(entry[at:], ()) for b in own)
        self.n_b = len(b_bytes)
        self.others = np.array(sorted(a * self.n_b + b for a, b in pairs if self.identity[a] != b), np.int64)

    def __len__(self) -> int:
        return len(self.identity) + len(self.others)

    def encode(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Codes of the pairs of ids in ``a`` and ``b``."""
        codes, other = a.astype(np.int32), np.flatnonzero(self.identity[a] != b)
        codes[other] = len(self.identity) + np.searchsorted(self.others, a[other] * self.n_b + b[other])
        return codes

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of A and B of every code; those of B are -1 where A's entry has no like."""
        a = np.concatenate([np.arange(len(self.identity)), self.others // self.n_b])
        return a, np.concatenate([self.identity, self.others % self.n_b])


def _digits(n_a: int, n_b: int) -> np.ndarray:
    """The ids of A and of B as digits and the mark that follows each: a row for ``a,``, then for ``a|``,
    ``b,`` and ``b;``. What a row does not need is zero."""
    rows = [f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)]
    return np.array(rows, "S").view(np.uint8).reshape(len(rows), -1)


class Aligner:
    """Encodes texts with both tokenizers and cuts them where a token of each ends.

    Texts go through in segments. Those start at a single blank or line feed between other
    characters: there A's pattern cuts, and no piece of B holds a blank or a line feed after another
    character, so the segments of a text have its tokens, and no group reaches from one into the next.

    Where the ids of A follow the order of its merges, as they do when every merge has made the next
    entry, a ranked encoder of the same entries takes the place of the library that reads the file:
    it gives the same ids several times faster. Segments beyond twice the usual size, which
    have no place to cut, always go through that library.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a_bytes, self.b_bytes = _bytes_of_a(path_a), _bytes_of_b(self.b)
        self.a_sizes, self.b_sizes = (np.array([*map(len, entries)], np.int64) for entries in (self.a_bytes, self.b_bytes))
        self.links = Links(self.a_bytes, self.b_bytes)
        self.digits = _digits(len(self.a_bytes), len(self.b_bytes))
        ranks = _ranks_of_a(path_a, self.a_bytes)
        self.ranked = ranks and tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.blank = self.b.piece_to_id("▁")
        white = "".join(map(chr, WHITE))
        longer = [p.decode("utf-8", "replace") for p in self.b_bytes if len(p) > 1]
        breaks = " " * (not any(" " in p.lstrip(" ") for p in longer)) + "\n" * (not any("\n" in p for p in longer))
        # Where no place is safe the pattern never matches, and texts stay whole.
        self.edge = re.compile(f"(?<=[^{white}])(?=[{breaks}][^{white}])" if breaks else "(?!)")

    def _encode_a(self, segment: str) -> list[int]:
        if self.ranked and len(segment) <= 2 * SEGMENT:
            return self.ranked.encode_ordinary(segment)
        return self.a.encode(segment, add_special_tokens=False).ids

    def _encode_b(self, segment: str) -> list[int]:
        """Ids of a segment. The library puts a blank before it; where the segment starts with another
        character the blank goes again."""
        if segment.startswith(" "):
            return self.b.encode(segment[1:])
        ids = self.b.encode(segment)
        return ids[1:] if ids[:1] == [self.blank] else ids

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            edge = self.edge.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
            stop = edge.start() if edge else len(text)
            yield text[at:stop]
            at = stop

    def _align(self, a: np.ndarray, b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """``(groups as text, each with a semicolon after it, codes of the links)``."""
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        marks = np.zeros((2, ends_a[-1] + 1), bool)
        marks[0, ends_a] = marks[1, ends_b] = True
        cuts_a, cuts_b = marks[1, ends_a], marks[0, ends_b]
        last_a, last_b = np.flatnonzero(cuts_a), np.flatnonzero(cuts_b)
        # A token stands after the tokens of its own side before it and those of the other side in
        # earlier groups; in a group A comes first.
        group_a, group_b = np.cumsum(cuts_a) - cuts_a, np.cumsum(cuts_b) - cuts_b
        place_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
        place_b = np.arange(len(b)) + (last_a + 1)[group_b]
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        rows = np.empty(len(a) + len(b), np.int64)
        rows[place_a] = a + n_a * cuts_a
        rows[place_b] = b + 2 * n_a + n_b * cuts_b
        digits = self.digits[rows].ravel()
        return digits[digits != 0].tobytes(), self.links.encode(a[last_a], b[last_b])

    def align(self, text: str | None, keep_groups: bool) -> tuple:
        """The values of ``ALIGNED`` for one text."""
        none = (0, 0, 0, "" if keep_groups else None, "", np.empty(0, np.int32), np.empty(0, np.int32))
        if not text:
            return none
        n_a = n_b = n_groups = 0
        digest, kept, parts, joint = hashlib.sha256(), [], [], b""
        for segment in self._segments(" " + text):
            a, b, coded = self._encode_a(segment), self._encode_b(segment), segment.encode("utf-8")
            if b"".join([self.a_bytes[t] for t in a]) != coded or b"".join([self.b_bytes[t] for t in b]) != coded:
                return none
            groups, codes = self._align(np.array(a, np.int64), np.array(b, np.int64))
            n_a, n_b, n_groups = n_a + len(a), n_b + len(b), n_groups + len(codes)
            digest.update(joint + groups[:-1])
            joint = b";"
            if keep_groups:
                kept.append(groups)
            parts.append(np.unique(codes, return_counts=True))
        codes, times = parts[0]
        if len(parts) > 1:
            codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            times = np.bincount(place, np.concatenate([p[1] for p in parts]), len(codes))
        text_of_groups = b"".join(kept)[:-1].decode() if keep_groups else None
        return n_a, n_b, n_groups, text_of_groups, digest.hexdigest(), codes, times.astype(np.int32)


def _list_array(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a list column without nulls."""
    rows = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    return rows, column.flatten().to_numpy(zero_copy_only=False)


def align_documents(
    docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", out: str = "aligned", keep_groups: bool = False
) -> DataFrame:
    """All columns of ``docs`` but the text, and ``out``, a struct of what is found for each text.

    A blank and the text are encoded by A, a byte-level ``tokenizers`` file, and the text by B, a
    ``sentencepiece`` model that puts the blank there itself; strings of special tokens are plain
    text. Where tokens of both end the text is cut into groups. ``n_a``, ``n_b`` and ``n_groups`` count,
    ``groups`` (if ``keep_groups``) lists the ids as ``a1,a2|b1;a3|b2,b3``, ``groups_sha256`` is the hash of that,
    and ``codes`` and ``times`` tell how often the text has each link, see ``Links``. A link is a pair of occurrences that
    end at the same byte, so a group has one: its last token of A and its last of B.

    A null or empty text, and one of which either tokenizer does not give back all bytes, has zeros, empty
    strings and no codes. Rows pass one by one, repeated ones too; an empty table gives none. A column
    that has the name ``out`` already is an error; others may have any names. Nothing is shuffled. Long texts go through in segments;
    only a text without single blanks and line feeds is encoded as a whole.
    """
    rest = [c for c in docs.columns if c != text_col]
    if out in rest:
        raise ValueError(f"documents have a column {out!r} already; name another one in out")
    ship_package(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").cast("string"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_state(f"aligner:{path_a}:{path_b}", lambda: Aligner(path_a, path_b))
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                found = [aligner.align(text.as_py(), keep_groups) for text in batch.column(batch.num_columns - 1)]
                columns = [*zip(*found)]
                arrays = [pa.array(values, kind) for values, kind in zip(columns[:5], _ARROW)]
                arrays += [_list_array(list(values)) for values in columns[5:]]
                struct = pa.StructArray.from_arrays(arrays, names=ALIGNED.fieldNames())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], struct], names=[*batch.schema.names[:-1], out])

    return map_arrow(rows, align, T.StructType([*rows.schema.fields[:-1], T.StructField(out, ALIGNED)]))


def _links(path_a: str, path_b: str) -> Links:
    import sentencepiece

    return Links(_bytes_of_a(path_a), _bytes_of_b(sentencepiece.SentencePieceProcessor(model_file=path_b)))


def link_counts(aligned: DataFrame, n_identity: int, column: str = "aligned") -> DataFrame:
    """``(code, n)``: how many links of all texts hold each pair of ids.

    Links of entries with the same bytes are added up in one vector of A's vocabulary a task; only the
    others, summed over a batch, are shuffled as they come. No more codes can come than ``Links`` has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(n_identity, np.int64)

        def rows(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(n.astype(np.int64))], names=["code", "n"])

        for batch in batches:
            codes, times = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            same = codes < n_identity
            own += np.bincount(codes[same], times[same], n_identity).astype(np.int64)
            irregular, place = np.unique(codes[~same], return_inverse=True)
            if len(irregular):
                yield rows(irregular, np.bincount(place, times[~same]))
        used = np.flatnonzero(own)
        if len(used):
            yield rows(used, own[used])

    lists = aligned.select(F.col(f"`{column}`")["codes"].alias("codes"), F.col(f"`{column}`")["times"].alias("times"))
    return lists.mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def link_scores(aligned: DataFrame, path_a: str, path_b: str, column: str = "aligned") -> DataFrame:
    """``aligned``, written as a table, with ``n_best`` and ``count_sum``: over the links of each text, how many hold a
    pair that is the commonest of its id of B in all texts, ties included, and the sum of their pairs' counts.

    The counts are a vector with one number per code. Its length is that of ``Links``, which depends on the two
    vocabularies alone, so it is broadcast. Rows as in ``align_documents``.
    """
    links = _links(path_a, path_b)
    found = link_counts(aligned, len(links.identity), column).toArrow()
    counts = np.zeros(len(links), np.int64)
    counts[found.column("code").to_numpy()] = found.column("n").to_numpy()
    b = links.pairs()[1]
    highest = np.zeros(links.n_b, np.int64)
    np.maximum.at(highest, b[b >= 0], counts[b >= 0])
    best = (b >= 0) & (counts > 0) & (counts == highest[b])
    shared = aligned.sparkSession.sparkContext.broadcast((counts, best))
    place = aligned.columns.index(column)
    names = [free_name(n, aligned.columns) for n in ("n_best", "count_sum")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                struct = batch.column(place)
                rows, codes = _flat(pa.array(struct.field("codes")))
                times = _flat(struct.field("times"))[1].astype(np.int64)
                sums = np.zeros((2, batch.num_rows), np.int64)
                np.add.at(sums[0], rows, times * best[codes])
                np.add.at(sums[1], rows, times * counts[codes])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *map(pa.array, sums)], names=[*batch.schema.names, *names]
                )

    return map_arrow(aligned, score, T.StructType([*aligned.schema.fields, *[T.StructField(n, T.LongType()) for n in names]]))


def align_and_score(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", out: str = "aligned") -> DataFrame:
    """``align_documents`` and ``link_scores`` over it. The tokenizers run once: what they give is
    written as a table, counted, and read again."""
    aligned = materialize(align_documents(docs, path_a, path_b, text_col, out), "aligned")
    return link_scores(aligned, path_a, path_b, out)
