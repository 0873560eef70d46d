"""Documents, questions and outcomes that arrive over time.

Every stream takes a checkpoint folder, which must lie where all executors can reach it. Batches are
written so that a batch that runs again replaces what it wrote before.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from scholium.operators import index, retrieve
from scholium.sources import library_table

# Fixed value: the question that ends a session.
STOP_WORD = "exit"
SALTS = 64
SESSION_SALTS = 16
SESSION_BUCKETS = 256
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files as they land in a folder; files already seen are remembered in the checkpoint."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_library_ingest(docs: DataFrame, root: str, name: str, checkpoint: str) -> StreamingQuery:
    """Add arriving ``docs(source, text)`` to a library, one batch folder per micro-batch.

    A path that comes again is left out by ``library_add``. A batch is keyed by the checkpoint, which
    is the stream's own, and its number: one that runs again replaces only itself, and neither other
    streams nor plain additions.
    """
    stream_id = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()

    def add(batch: DataFrame, batch_id: int) -> None:
        library_table.library_add(batch, root, name, f"{stream_id}-{batch_id}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(
    docs: DataFrame, by_time: str | None = None, delay: str = "1 day", spread_by: str = "source"
) -> DataFrame:
    """``(dockey[, time])``: the key of each text that has not been seen before.

    Only keys are shuffled and kept as state. Copies are dropped per (key, salt) first, so the
    copies of one text meet in many tasks, and at most one row per salt goes on. The salt comes from
    the ``spread_by`` column, so that a task that runs again sends each row where it went before.
    With a time column the state is bounded by the watermark.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).alias("salt")
    keys = docs.select(F.md5("text").alias("dockey"), salt, *([by_time] if by_time else []))
    if by_time is None:
        return keys.dropDuplicates(["dockey", "salt"]).select("dockey").dropDuplicates(["dockey"])
    keys = keys.withWatermark(by_time, delay)
    return keys.dropDuplicatesWithinWatermark(["dockey", "salt"]).select("dockey", by_time).dropDuplicatesWithinWatermark(["dockey"])


def stream_new_documents(
    docs: DataFrame, known: DataFrame, by_time: str, delay: str = "1 day", spread_by: str = "source"
) -> DataFrame:
    """``(dockey, time)``: the key of each arriving text that neither ``known(dockey)`` nor the stream had before.

    ``known`` is a table, such as the keys of a library, as it was when the stream was started. The
    stream remembers keys for ``delay`` past their time, so state is bounded by what arrives in
    that span, however long it runs: a later copy is only left out if it is known by then. A row that is
    itself later than ``delay`` is left out; a row without text has no key.

    Copies are dropped per (key, salt) first, see ``stream_dedup``, so at most one row per salt of
    each key meets the table. In a ``stateful_session`` the keys lie on disk.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).alias("salt")
    keys = docs.filter(F.col("text").isNotNull()).select(F.md5("text").alias("dockey"), salt, by_time)
    first = keys.withWatermark(by_time, delay).dropDuplicatesWithinWatermark(["dockey", "salt"])
    new = first.join(known.select("dockey"), "dockey", "left_anti")
    return new.select("dockey", by_time).dropDuplicatesWithinWatermark(["dockey"])


def state_rows(query: StreamingQuery) -> int:
    """How many keys a stream remembers after its last batch, over all of its stateful steps."""
    progress = query.lastProgress
    return sum(step["numRowsTotal"] for step in progress["stateOperators"]) if progress else 0


def write_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def askable(questions: DataFrame) -> DataFrame:
    """Questions that are neither empty nor the stop word."""
    return questions.filter((F.length("text") > 0) & (F.col("text") != STOP_WORD))


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose streams keep their state in RocksDB, as ``session_questions`` needs."""
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set(STATE_STORE, ROCKSDB)
    return session


def _session_end():
    """The state of a bucket of sessions: the turn that ended each of them. Made here so that it travels by value."""

    class SessionEnd(StatefulProcessor):
        def init(self, handle) -> None:
            self.ended = handle.getMapState("ended", "name string", "turn long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            stops, waiting, names = {}, [], set()
            for part in rows:
                for name, turn in part.loc[part["stop"], ["name", "turn"]].groupby("name")["turn"].min().items():
                    stops[name] = min(int(turn), stops.get(name, int(turn)))
                waiting.append(part[~part["stop"]])
                names.update(waiting[-1]["name"].unique())
            ends = {}
            for name in names | stops.keys():
                before = self.ended.getValue((name,))[0] if self.ended.containsKey((name,)) else None
                turns = [turn for turn in (before, stops.get(name)) if turn is not None]
                if turns:
                    ends[name] = min(turns)
                    if ends[name] != before:
                        self.ended.updateValue((name,), (ends[name],))
            for part in waiting:
                is_open = [name not in ends or turn < ends[name] for name, turn in zip(part["name"], part["turn"])]
                open_rows = part[np.array(is_open, dtype=bool)]
                yield open_rows[["qid", "session", "turn", "text"]]

        def close(self) -> None:
            pass

    return SessionEnd()


def session_questions(questions: DataFrame) -> DataFrame:
    """``(qid, session, turn, text)`` of the arriving ``questions`` of the same columns that may be asked.

    The stop word ends its session: questions of that turn and of later turns get no answer, in
    its batch and in all batches after. Empty questions are refused. Rows without a session are one
    session; a row without a turn comes before all turns. A question that arrives before the stop
    word has been let through, whatever its turn.

    State is one number per (ended session, salt), and none for sessions that go on. Questions of a session are
    spread over salts by their id, and its stop words go to every salt, so a long session is many
    tasks' work. Sessions share buckets, as a group costs far more than a look at its state. A task holds
    the questions of one bucket, salt and batch.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))
    stop = F.col("text") == STOP_WORD
    kept = questions.filter(F.length("text") > 0).select("qid", "session", turn.alias("turn"), "text", stop.alias("stop"))
    own = F.array(F.pmod(F.xxhash64("qid"), F.lit(SESSION_SALTS)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(SESSION_SALTS - 1))
    spread = kept.withColumn("salt", F.explode(F.when(F.col("stop"), every).otherwise(own)))
    spread = spread.withColumn("bucket", F.pmod(F.xxhash64("session"), F.lit(SESSION_BUCKETS)).cast("int"))
    spread = spread.withColumn("name", F.coalesce(F.concat(F.lit("s"), F.col("session").cast("string")), F.lit("")))
    asked = kept.select("qid", "session", "turn", "text").schema
    return spread.groupBy("bucket", "salt").transformWithStateInPandas(_session_end(), asked, "Append", "None")


def stream_questions(
    questions: DataFrame, asked: index.Index, path: str, checkpoint: str, k: int = retrieve.DEFAULT_K
) -> StreamingQuery:
    """Answer arriving ``questions(qid, text)`` from an indexed library with ``evidence`` rows.

    Ranking is not possible on a stream itself, so each micro-batch is ranked as a table and
    written to a folder named by its batch. A batch reads the index; the library is not weighted
    again.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        index.topk(askable(batch), asked, k).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        questions.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_outcomes(outcomes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep ``(status, n)`` up to date while outcomes arrive.

    Counts combine on the map side, and there is one row of state per status.
    """
    counts = outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The last published counts. The table has one row per status and batch."""
    table = spark.read.parquet(path)
    last = table.agg(F.max("batch")).scalar()
    return table.filter(F.col("batch") == last).drop("batch")
