"""Repair of conversation structure: the cheapest edits that make turns alternate, found while they stream by."""

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.shared import ship_package, shuffle_partitions

# What the edits cost, and how much a kept turn that breaks off adds.
REROLE, DELETE, INSERT, BROKEN_OFF = 3, 4, 3, 3
BLANKS = " \t\n\v\f\r"
SENTENCE_ENDS = ".!?"

# Where the turns kept so far have led: nowhere yet, to a system, a user or an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
# Where a turn of each initial leads from each place, what a new or re-roled turn
# becomes there, and where a conversation may end.
KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
MADE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
LEGAL_PAIRS = ("su", "ua", "au")
FAR = 1 << 60

# What a conversation holds in memory before it goes to a file of its task.
SPOOL_BYTES = 1 << 20
DIGESTS_IN_MEMORY = 1 << 16
LONGEST_MERGE = 1 << 21
BLOCK = 1 << 16

# The word of a step: three bits per place for the edits of the row, one per place for a turn put in
# there, and two for the initial of the row.
_DELETED, _KEPT, _REROLED = 1, 2, 4
_INSERTS, _INITIAL = 12, 16
_INITIALS = "-sua"
_LENGTHS = struct.Struct("<ii")

_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Seen:
    """Digests of 16 bytes met before. Those that memory does not hold lie in sorted runs on disk."""

    def __init__(self, limit: int = DIGESTS_IN_MEMORY):
        self.limit, self.fresh, self.runs = limit, set(), []

    def add(self, digest: bytes) -> bool:
        """Whether ``digest`` is new; it is remembered."""
        if digest in self.fresh:
            return False
        key = np.frombuffer(digest, "S16")
        for run in self.runs:
            at = int(np.searchsorted(run, key)[0])
            if at < len(run) and run[at] == key[0]:
                return False
        self.fresh.add(digest)
        if len(self.fresh) >= self.limit:
            run = np.sort(np.frombuffer(b"".join(self.fresh), "S16"))
            self.fresh.clear()
            # A run is merged with those that are no longer than it, so there are few.
            while self.runs and len(self.runs[-1]) <= len(run) < LONGEST_MERGE:
                run = np.sort(np.concatenate([self.runs.pop(), run]))
            file = tempfile.TemporaryFile()
            file.write(run.tobytes())
            file.flush()
            self.runs.append(np.memmap(file, "S16", "r", shape=(len(run),)))
        return True


def _with_insertions(cost: list[int]) -> tuple[list[int], int]:
    """Least costs when turns may be put in, and from which places that is on a cheapest way."""
    cost = list(cost)
    for _ in range(2):
        for place, made in enumerate(MADE):
            cost[made] = min(cost[made], cost[place] + INSERT)
    word = 0
    for place, made in enumerate(MADE):
        if cost[place] < FAR and cost[place] + INSERT == cost[made]:
            word |= 1 << _INSERTS + place
    return cost, word


def _next_place(place: int, edit: int, word: int) -> int:
    if edit == _DELETED:
        return place
    return MADE[place] if edit == _REROLED else KEEPS[place][_INITIALS[word >> _INITIAL]]


class Conversation:
    """One conversation whose turns are added in order.

    Carried from turn to turn are the least cost of reaching each place, one digest per distinct
    turn and a few counts. Each step leaves a word that says which edits lie on a cheapest way to
    each place. Words and turns go to files of the task beyond ``spool_bytes``, digests beyond their
    number, so a conversation of any length takes bounded memory but for the audit itself.
    """

    def __init__(self, spool_bytes: int = SPOOL_BYTES, digests: int = DIGESTS_IN_MEMORY):
        self.words, self.marks, self.turns = (tempfile.SpooledTemporaryFile(spool_bytes) for _ in range(3))
        self.seen = Seen(digests)
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.before = None
        self.cost, word = _with_insertions([0, FAR, FAR, FAR])
        self.words.write(struct.pack("<I", word))

    def close(self) -> None:
        for file in (self.words, self.marks, self.turns):
            file.close()

    def _fault(self, role: bytes, text: bytes, shown: str) -> tuple[bool, int]:
        """Whether the turn has to go, and what keeping it adds."""
        digest = hashlib.blake2b(_LENGTHS.pack(len(role), len(text)) + role + text, digest_size=16).digest()
        new = self.seen.add(digest)
        if not shown:
            self.blank += 1
            return True, 0
        if not new:
            self.duplicate += 1
            return True, 0
        if shown[-1] not in SENTENCE_ENDS:
            self.truncated += 1
            return False, BROKEN_OFF
        return False, 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.rows += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL_PAIRS
        self.before = initial

        coded_role, coded = role.encode("utf-8"), text.encode("utf-8")
        must_go, extra = self._fault(coded_role, coded, text.rstrip(BLANKS))
        ways, cost = [], [FAR] * 4
        for place, now in enumerate(self.cost):
            if now >= FAR:
                continue
            ways.append((place, _DELETED, place, now + DELETE))
            if not must_go:
                ways.append((place, _REROLED, MADE[place], now + REROLE + extra))
                if initial in KEEPS[place]:
                    ways.append((place, _KEPT, KEEPS[place][initial], now + extra))
        for _, _, to, total in ways:
            cost[to] = min(cost[to], total)
        self.cost, word = _with_insertions(cost)
        for place, edit, to, total in ways:
            if total == self.cost[to]:
                word |= edit << 3 * place
        if initial and initial in _INITIALS[1:]:
            word |= _INITIALS.index(initial) << _INITIAL
        self.words.write(struct.pack("<I", word))
        coded = b"" if must_go else coded
        self.turns.write(_LENGTHS.pack(len(coded_role), len(coded)) + coded_role + coded)

    def _mark(self) -> None:
        """From the end back, note for each step which places lie on a cheapest way to the end."""
        marked = sum(1 << place for place in ENDS if self.cost[place] == self.least)
        stop = self.rows + 1
        while stop:
            start = max(0, stop - BLOCK)
            self.words.seek(4 * start)
            words = np.frombuffer(self.words.read(4 * (stop - start)), "<u4").tolist()
            marks = bytearray(len(words))
            for i in range(len(words) - 1, -1, -1):
                word = words[i]
                for _ in range(2):
                    for place, made in enumerate(MADE):
                        marked |= (word >> _INSERTS + place & marked >> made & 1) << place
                marks[i] = marked
                earlier = 0
                for place in range(4):
                    for edit in (_DELETED, _KEPT, _REROLED):
                        if word >> 3 * place & edit and marked >> _next_place(place, edit, word) & 1:
                            earlier |= 1 << place
                marked = earlier
            self.marks.seek(start)
            self.marks.write(marks)
            stop = start

    def _steps(self) -> Iterator[tuple[int, int]]:
        for start in range(0, self.rows + 1, BLOCK):
            self.words.seek(4 * start)
            self.marks.seek(start)
            words = np.frombuffer(self.words.read(4 * BLOCK), "<u4").tolist()
            yield from zip(words, self.marks.read(BLOCK))

    @property
    def least(self) -> int:
        return min(self.cost[place] for place in ENDS)

    def edits(self) -> Iterator[tuple[str, str, bytes]]:
        """``(initial of the edit, role, text)`` in order: the cheapest edits, of these the least by
        their initials. A deleted turn has no role."""
        self._mark()
        steps = self._steps()
        self.turns.seek(0)
        place = START
        word, marks = next(steps)
        following = next(steps, None)
        while True:
            # In the order of the initials: Delete, Insert, Keep, Rerole.
            ahead, marks_ahead = following or (0, 0)

            def leads(edit: int) -> bool:
                return bool(ahead >> 3 * place & edit) and bool(marks_ahead >> _next_place(place, edit, ahead) & 1)

            chosen = _DELETED if leads(_DELETED) else 0
            if not chosen and word >> _INSERTS + place & marks >> MADE[place] & 1:
                place = MADE[place]
                yield "I", ROLES[place], b""
                continue
            if following is None:
                return
            chosen = chosen or (_KEPT if leads(_KEPT) else _REROLED)
            n_role, n_text = _LENGTHS.unpack(self.turns.read(_LENGTHS.size))
            role, text = self.turns.read(n_role).decode("utf-8"), self.turns.read(n_text)
            place = _next_place(place, chosen, ahead)
            if chosen == _DELETED:
                yield "D", "", b""
            elif chosen == _KEPT:
                yield "K", role, text
            else:
                yield "R", ROLES[place], text
            (word, marks), following = following, next(steps, None)

    def report(self) -> tuple:
        """The values of the columns after the conversation's id."""
        digest, audit, joint = hashlib.sha256(), bytearray(), b""
        for edit, role, text in self.edits():
            audit += edit.encode()
            if edit != "D":
                digest.update(joint + role.encode("utf-8") + b":")
                digest.update(text)
                joint = b"\n"
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.least)
        return (*counts, audit.decode(), digest.hexdigest())


def _stream(rows: DataFrame, present, conv_col: str, turn_col: str, role_col: str, text_col: str, emit, columns: str) -> DataFrame:
    """What ``emit(conversation)`` gives for every conversation, its turns sorted and streamed once."""
    spark = rows.sparkSession
    ship_package(spark)
    turn = F.col(turn_col).cast("long")
    blank = F.lit(" ")
    prepared = rows.select(
        F.col(conv_col).cast("string").alias("conv"),
        turn.isNotNull().alias("numbered"),
        F.coalesce(turn, F.lit(0)).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), blank).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    dealt = prepared.repartition(shuffle_partitions(spark), "conv")
    ordered = dealt.sortWithinPartitions("conv", "numbered", "turn", "role", "text")
    names = ["conv", *[c.split()[0] for c in columns.split(", ")]]

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, conversation, made = None, None, []
        started = False
        for batch in batches:
            for conv, numbered, turn, role, text, is_row in batch.itertuples(index=False, name=None):
                conv = None if pd.isna(conv) else conv
                if not started or conv != current:
                    if started:
                        yield from emit(current, conversation, made, names)
                        conversation.close()
                    started, current, conversation = True, conv, Conversation()
                if is_row:
                    conversation.add(turn if numbered else None, role, text)
        if started:
            yield from emit(current, conversation, made, names)
            conversation.close()
        if made:
            yield pd.DataFrame(made, columns=names)

    kind = rows.select(F.col(conv_col)).schema[0].dataType
    found = ordered.mapInPandas(repair, f"conv string, {columns}")
    return found.select(F.col("conv").cast(kind).alias(conv_col), *names[1:])


def _flush(made: list, names: list[str], limit: int) -> Iterator[pd.DataFrame]:
    if len(made) >= limit:
        yield pd.DataFrame(made, columns=names)
        made.clear()


def _emit_report(conv, conversation: Conversation, made: list, names: list[str]) -> Iterator[pd.DataFrame]:
    made.append((conv, *conversation.report()))
    yield from _flush(made, names, 1000)


def _emit_turns(conv, conversation: Conversation, made: list, names: list[str]) -> Iterator[pd.DataFrame]:
    position = 0
    for edit, role, text in conversation.edits():
        if edit != "D":
            made.append((conv, position, role, text.decode("utf-8"), edit))
            position += 1
            yield from _flush(made, names, 1000)


def repair_report(
    rows: DataFrame, present=None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``: one row
    per conversation of ``rows``.

    Turns are dealt by conversation and sorted by turn (null first), ties by role and text, and each
    task streams through its conversations. A turn's first fault counts: ``blank`` (no character but
    white space), ``duplicate`` (role and text came before), ``truncated`` (does not end in ``.!?``).
    ``illegal`` counts neighbours whose roles' initials are not su, ua or au, and ``gaps`` the numbers
    missing between the least and the greatest turn. ``cost`` is that of the cheapest edits after which the
    roles' initials read ``(s?(ua)+)?``: keep 0, re-role to user or assistant 3, delete 4 (blank and
    duplicate turns have to go), put in an empty user or assistant turn 3, and 3 more for each
    truncated turn that stays. ``audit`` holds the initials of the edits in order, K, R, D and I, the
    least in ASCII order of all cheapest ones. ``repaired_sha256`` is that of the repaired turns as
    ``role:text`` lines.

    A null role or text counts as one blank; an empty role has no initial. A null conversation id is
    a conversation of its own, and repeated rows are duplicates. ``present`` is a condition for rows
    that are turns; the others only name their conversation, and one without turns has zeros and an
    empty audit. An empty table gives no rows. Other columns are ignored.

    One task sees a whole conversation, but holds only its digests, edit words and texts up to fixed
    sizes; the rest lies in files of that task, which a task that runs again makes anew.
    """
    return _stream(rows, present, conv_col, turn_col, role_col, text_col, _emit_report, _REPORT)


def repaired_turns(
    rows: DataFrame, present=None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv, position, role, text, edit)``: the turns that remain after the edits of
    ``repair_report``, numbered from 0. Nulls, repeats and empty tables as there; a conversation of
    which nothing remains has no rows."""
    columns = "position long, role string, text string, edit string"
    return _stream(rows, present, conv_col, turn_col, role_col, text_col, _emit_turns, columns)
