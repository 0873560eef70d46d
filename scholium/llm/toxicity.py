"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.llm.shared import map_arrow, releasing, ship_package, worker_state
from scholium.plans.storage import materialize

# Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE_PER_CLASS = 6000
NGRAMS = (3, 4, 5)
HASH_BITS = 22
FEATURES = 8192  # numbered by 16-bit integers
MIN_DOCUMENTS = 3
_CHUNK_CHARS = 1 << 18
# Rows whose n-grams are held at once, and counts sent on at once.
_SLICE = 256
_COUNTS_PER_BATCH = 1 << 18


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``_CHUNK_CHARS`` characters, with the number of the first."""
    first, chunk, size = 0, [], 0
    for i, text in enumerate(texts):
        chunk.append((text or "").lower())
        size += len(chunk[-1])
        if size >= _CHUNK_CHARS:
            yield first, chunk
            first, chunk, size = i + 1, [], 0
    if chunk:
        yield first, chunk


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # What an earlier operator left in this worker is not needed any more.
    worker_state("none", dict)
    for batch in batches:
        for start in range(0, batch.num_rows, _SLICE):
            yield batch.slice(start, _SLICE)


def text_features(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, feature)`` of every distinct character n-gram of each text, in order.

    A feature is a hash of the n-gram, its order included. ``wanted`` marks the features to report.
    """
    rows, features = [], []
    for first, chunk in _chunks(texts):
        codes = np.frombuffer("\0".join(["", *chunk, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(codes) < 3:
            continue
        lengths = np.fromiter(map(len, chunk), np.int64, len(chunk))
        owner = np.repeat(np.arange(len(chunk), dtype=np.int64), lengths + 1)
        owner = np.concatenate([owner, owner[-1:]])
        ends = np.cumsum(lengths + 1)
        # Marks around texts: an n-gram may begin or end with one, so it tells where a text begins or ends.
        gap = np.zeros(len(codes), bool)
        gap[0] = True
        gap[ends] = True
        found = []
        for n in NGRAMS:
            if len(codes) < n:
                continue
            m = len(codes) - n + 1
            h = np.full(m, n, np.uint64)
            inside = np.ones(m, bool)
            for j in range(n):
                h = (h ^ codes[j : m + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                if 0 < j < n - 1:
                    inside &= ~gap[j : m + j]
            h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - HASH_BITS)
            if wanted is not None:
                inside &= wanted[h]
            found.append((owner[np.flatnonzero(inside)].astype(np.uint64) << np.uint64(HASH_BITS)) | h[inside])
        pairs = np.unique(np.concatenate(found))
        rows.append((pairs >> np.uint64(HASH_BITS)).astype(np.int64) + first)
        features.append((pairs & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(features)


def fit_logistic(ends: np.ndarray, col: np.ndarray, scale: np.ndarray, label: np.ndarray,
                 l2: float = 3e-4, steps: int = 400, rate: float = 0.05, block: int = 512) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression by Adam on all rows of the sample.

    Row ``i`` holds the features ``col[ends[i]:ends[i + 1]]``, each with the value ``scale`` of that
    feature. ``block`` rows are expanded at a time, so memory is little more than ``col``.
    """
    n, n_cols = len(label), len(scale)
    params, m, v = np.zeros(n_cols + 1), np.zeros(n_cols + 1), np.zeros(n_cols + 1)
    for step in range(1, steps + 1):
        gradient = np.zeros(n_cols + 1)
        scaled = scale * params[:-1]
        for start in range(0, n, block):
            bounds = ends[start : start + block + 1]
            part, size = col[bounds[0] : bounds[-1]], len(bounds) - 1
            row = np.repeat(np.arange(size), np.diff(bounds))
            z = params[-1] + np.bincount(row, weights=scaled[part], minlength=size)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[start : start + size]) / n
            gradient[:-1] += np.bincount(part, weights=error[row], minlength=n_cols)
            gradient[-1] += error.sum()
        gradient[:-1] = scale * gradient[:-1] + l2 * params[:-1]
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        pace = rate * (1 - step / (steps + 1))
        params -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return params[:-1], float(params[-1])


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """``(features, weights, intercept)`` from ``labelled(id, text, label)`` with label 0 or 1.

    ``labelled`` is a bounded sample. Log-count ratios come from the document counts of every n-gram in
    it; the ``FEATURES`` n-grams whose ratio stands out most from chance are scaled by it and
    weighted by logistic regression. Only those reach the driver.

    A null text is empty. Repeated rows count each time. Without rows of one class, the other is certain; without
    any row, no text is toxic.
    """
    ship_package(labelled.sparkSession)

    def counts(batches):
        tally = np.zeros((2, 1 << HASH_BITS), np.int32)
        for batch in _slices(batches):
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            row, feature = text_features(batch.column(0).to_pylist())
            for kind in (0, 1):
                found, n = np.unique(feature[label[row] == kind], return_counts=True)
                tally[kind, found] += n.astype(np.int32)
        seen = np.flatnonzero(tally.any(axis=0))
        for start in range(0, len(seen), _COUNTS_PER_BATCH):
            part = seen[start : start + _COUNTS_PER_BATCH]
            columns = [part, tally[1, part].astype(np.int64), tally[0, part].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "toxic", "clean"])

    sums = labelled.select("text", "label").mapInArrow(releasing(counts), "feature long, toxic long, clean long")
    sums = sums.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sums = sums.filter(F.col("toxic") + F.col("clean") >= MIN_DOCUMENTS)
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        prior = 30.0 if n_toxic else -30.0
        return np.zeros(0, np.int64), np.zeros(0), prior
    ratio = F.log((F.col("toxic") + 1.0) / (n_toxic + 2.0)) - F.log((F.col("clean") + 1.0) / (n_clean + 2.0))
    noise = F.sqrt(1.0 / (F.col("toxic") + 1.0) + 1.0 / (F.col("clean") + 1.0))
    ranked = sums.select("feature", ratio.alias("ratio"), F.abs(ratio / noise).alias("stands_out"))
    top = ranked.orderBy(F.desc("stands_out"), "feature").limit(FEATURES).select("feature", "ratio").toPandas()
    top = top.sort_values("feature")
    features, ratios = top["feature"].to_numpy(np.int64), top["ratio"].to_numpy(np.float64)

    def present(batches):
        wanted = np.zeros(1 << HASH_BITS, bool)
        wanted[features] = True
        for batch in _slices(batches):
            row, feature = text_features(batch.column(0).to_pylist(), wanted)
            at = np.searchsorted(features, feature).astype(np.int16)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(at))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], names=["label", "present"])

    sample = labelled.select("text", "label").mapInArrow(releasing(present), "label int, present array<smallint>").toArrow()
    label = sample.column("label").to_numpy().astype(np.float64)
    lists = sample.column("present").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    del sample
    weights, intercept = fit_logistic(lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(), ratios, label)
    return features, weights * ratios, intercept


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, label)``: for each class the ``per_class`` rows of ``labels(id, label)`` that come
    first by a hash of the id. At most ``2 * per_class`` ids are broadcast to the texts.

    Rows of ``labels`` with a null id or a label other than 0 and 1 are left out; of several for one id the greater label counts.
    Every row of ``docs`` with a chosen id is in the sample, null and empty texts too. Empty tables give an empty sample."""
    labels = labels.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    labels = labels.groupBy("id").agg(F.max("label").cast("int").alias("label"))
    order = [F.xxhash64(F.lit(11), F.col("id")), F.col("id")]
    chosen = labels.filter("label = 1").orderBy(*order).limit(per_class)
    chosen = chosen.unionByName(labels.filter("label = 0").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialize(texts.join(F.broadcast(chosen), "id"), "labelled")


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], out: str = "score", text_col: str = "text") -> DataFrame:
    """Adds ``out``, the probability of label 1 of each whole text.

    A null text is empty; an empty one has the probability that the intercept gives. Rows pass one by
    one, repeated ones too, with all their columns, whatever these are called; ``out`` comes last, also where there is a column
    of that name already. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    features, weights, intercept = model
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    at_text = docs.columns.index(text_col)

    def scored(batches):
        wanted = np.zeros(1 << HASH_BITS, bool)
        wanted[features] = True
        weight = np.zeros(1 << HASH_BITS)
        weight[features] = weights
        for batch in _slices(batches):
            row, feature = text_features(batch.column(at_text).to_pylist(), wanted)
            z = intercept + np.bincount(row, weights=weight[feature], minlength=batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, out])

    return map_arrow(docs, releasing(scored), schema)
