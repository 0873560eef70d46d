"""Language identification by a convolutional network over bytes, trained in NumPy."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.llm.shared import map_arrow, ship_package
from scholium.plans.storage import materialize

UNKNOWN = "und"
# Labelled texts of each language that the network is trained on, at most; all of their windows are.
SAMPLE_PER_CLASS = 1500
# Training goes over all windows as often as it takes to make so many steps, once at least and 8 times at most.
STEPS, BATCH = 3000, 64
# Ranges of a text's mark, in which texts are counted before any are ranked.
MARK_BITS = 16
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
OVERLAP = max(WIDTHS) - 1
_BATCH_WINDOWS = 256


class ByteNetwork:
    """Bytes are embedded, filtered by windows of several widths, max-pooled and classified."""

    def __init__(self, classes: Sequence[str], seed: int = 3):
        self.classes = list(classes)
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.params = {"embed": rng.normal(0, 0.5, (256, EMBEDDING)), "out": rng.normal(0, 0.2, (n, len(classes)))}
        self.params["bias"] = np.zeros(len(classes))
        for w in WIDTHS:
            self.params[f"filter{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS))
            self.params[f"shift{w}"] = np.zeros(FILTERS)

    def tables(self) -> dict:
        """What a byte at each place of a filter adds to it, so that filtering is looking up and adding."""
        p = self.params
        return {w: [(p["embed"] @ p[f"filter{w}"][j]).astype(np.float32) for j in range(w)] for w in WIDTHS}

    def _pooled(self, x: np.ndarray, tables: dict) -> tuple[np.ndarray, dict]:
        parts, at = [], {}
        for w in WIDTHS:
            m = x.shape[1] - w + 1
            total = tables[w][0].take(x[:, :m], axis=0)
            for j in range(1, w):
                total += tables[w][j].take(x[:, j : j + m], axis=0)
            at[w] = total
            parts.append(total.max(axis=1) + self.params[f"shift{w}"].astype(np.float32))
        return np.concatenate(parts, axis=1), at

    def logits(self, windows: np.ndarray, tables: dict) -> np.ndarray:
        found = [np.zeros((0, len(self.classes)))]
        for start in range(0, len(windows), _BATCH_WINDOWS):
            pooled, _ = self._pooled(windows[start : start + _BATCH_WINDOWS], tables)
            found.append(np.maximum(pooled, 0) @ self.params["out"] + self.params["bias"])
        return np.concatenate(found)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01) -> None:
        """Adam on the cross entropy; classes weigh the same however many windows they have."""
        rng = np.random.default_rng(5)
        weights = 1 / np.maximum(np.bincount(labels, minlength=len(self.classes)), 1)
        weights = (weights / weights[labels].mean())[labels]
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        step, steps = 0, epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for start in range(0, len(order), batch):
                chosen = order[start : start + batch]
                gradient = self._gradient(windows[chosen], labels[chosen], weights[chosen])
                step += 1
                pace = rate * (1 - step / (steps + 1))
                for k, g in gradient.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.params[k] -= pace * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def _gradient(self, x: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict:
        p, rows = self.params, np.arange(len(x))[:, None]
        pooled, totals = self._pooled(x, self.tables())
        active = np.maximum(pooled, 0)
        z = active @ p["out"] + p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = z / z.sum(axis=1, keepdims=True)
        error[rows[:, 0], labels] -= 1
        error *= weights[:, None] / len(x)
        gradient = {"out": active.T @ error, "bias": error.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        back = (error @ p["out"].T) * (pooled > 0)
        for number, w in enumerate(WIDTHS):
            g = back[:, number * FILTERS : (number + 1) * FILTERS]
            best = totals[w].argmax(axis=1)
            gradient[f"shift{w}"] = g.sum(axis=0)
            gradient[f"filter{w}"] = np.zeros_like(p[f"filter{w}"])
            for j in range(w):
                byte = x[rows, best + j]
                gradient[f"filter{w}"][j] = np.einsum("nfe,nf->ef", p["embed"][byte], g)
                np.add.at(gradient["embed"], byte, g[:, :, None] * p[f"filter{w}"][j].T[None])
        return gradient


def windows_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(windows, text number)``: every text, whole, in windows of ``WINDOW`` bytes that overlap by
    one less than the widest filter; the last of a text is filled up with zeros."""
    pieces, owner, stride = [], [], WINDOW - OVERLAP
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8")
        count = max(1, -(-(len(data) - OVERLAP) // stride))
        pieces.append(data.ljust(count * stride + OVERLAP, b"\0"))
        owner.append(count)
    owner = np.asarray(owner, np.int64)
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum([0, *map(len, pieces)])[:-1] if pieces else np.zeros(0, np.int64)
    nth = np.arange(owner.sum()) - np.repeat(np.cumsum(owner) - owner, owner)
    begin = np.repeat(starts, owner) + nth * stride
    if not len(begin):
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[begin], np.repeat(np.arange(len(pieces)), owner)


def labelled_sample(
    docs: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang"
) -> DataFrame:
    """``(label, text)``: for each label the ``per_class`` rows that come first by a hash of id and text.

    Texts are counted by label and range of the hash first, which moves one row per task and range. Only the ranges up to
    the one in which a label has enough are ranked, so whatever share of the texts a label has, one task ranks about
    ``per_class`` rows and the texts of one range. Ids and hashes are moved, no texts. A row that repeats counts each time
    and is taken once. Null labels and null or empty texts are left out; an empty table gives an empty sample.
    """
    rows = docs.filter(F.col(label_col).isNotNull() & (F.length(text_col) > 0))
    rows = rows.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("mark"))
    bucket = F.shiftright("mark", 64 - MARK_BITS).alias("bucket")
    counts = rows.groupBy("label", bucket).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.select("label", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    needed = needed.filter(F.col("before") < per_class).groupBy("label").agg(F.max("bucket").alias("up_to"))
    marks = rows.select("label", "mark").join(F.broadcast(needed), "label").filter(F.shiftright("mark", 64 - MARK_BITS) <= F.col("up_to"))
    # One text a mark: repeated rows tie, and the mark is their only key.
    rank = F.row_number().over(Window.partitionBy("label").orderBy("mark"))
    marks = marks.select("label", "mark").withColumn("n", rank).filter(F.col("n") <= per_class)
    last = marks.groupBy("label").agg(F.max("mark").alias("last"), F.count(F.lit(1)).alias("n"))
    # One row a label, of which the network has an output each.
    chosen = rows.join(F.broadcast(last), "label").filter(F.col("mark") <= F.col("last"))
    chosen = chosen.dropDuplicates(["label", "mark"])
    return materialize(chosen.select("label", "text"), "languages")


def fit(sample: DataFrame) -> ByteNetwork | None:
    """A network trained on all windows of a bounded ``sample(label, text)``; None without a sample. The more
    windows there are, the fewer times each is seen, see ``STEPS``.

    The windows reach the driver: little more than the sample's bytes.
    """
    ship_package(sample.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, owner = windows_of(batch.column(1).to_pylist())
            for start in range(0, len(owner), 1 << 14):
                labels = batch.column(0).take(pa.array(owner[start : start + (1 << 14)]))
                data = pa.array([w.tobytes() for w in windows[start : start + (1 << 14)]], pa.binary())
                yield pa.RecordBatch.from_arrays([labels, data], names=["label", "data"])

    cut_rows = sample.mapInArrow(cut, "label string, data binary").toArrow()
    if not cut_rows.num_rows:
        return None
    # In a fixed order, so that training gives the same network every time.
    cut_rows = cut_rows.sort_by([("label", "ascending"), ("data", "ascending")])
    classes = sorted(set(cut_rows.column("label").to_pylist()))
    labels = pa.compute.index_in(cut_rows.column("label"), pa.array(classes)).to_numpy().astype(np.int64)
    x = np.frombuffer(b"".join(cut_rows.column("data").to_pylist()), np.uint8).reshape(-1, WINDOW)
    del cut_rows
    network = ByteNetwork(classes)
    network.train(x, labels, min(8, -(-STEPS * BATCH // len(x))), BATCH)
    return network


def predict(docs: DataFrame, network: ByteNetwork | None, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to ``docs``: the mean of the windows' outputs, through softmax.

    A null text, and one without any letter, is ``und`` with score 0, and so is all text where
    nothing was learned. Rows pass one by one, repeated ones too, with all their columns, whatever these are called; the
    two new ones come last, also where there are columns of their names already. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    at_text = docs.columns.index(text_col)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else None
        for batch in batches:
            names, scores = [], []
            column = batch.column(at_text)
            for start in range(0, batch.num_rows, 128):
                texts = column.slice(start, 128).to_pylist()
                found = _predict(network, tables, texts)
                names += found[0]
                scores += found[1]
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    return map_arrow(docs, label, T.StructType([*docs.schema.fields, *added]))


def _predict(network: ByteNetwork | None, tables: dict | None, texts: list) -> tuple[list[str], list[float]]:
    lettered = np.asarray([any(map(str.isalpha, t or "")) for t in texts])
    if network is None or not lettered.any():
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    windows, owner = windows_of(texts)
    z = network.logits(windows, tables)
    sums = np.stack([np.bincount(owner, weights=z[:, c], minlength=len(texts)) for c in range(z.shape[1])], axis=1)
    z = sums / np.bincount(owner, minlength=len(texts))[:, None]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    best = z.argmax(axis=1)
    names = [network.classes[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
    return names, np.where(lettered, z[np.arange(len(z)), best], 0.0).tolist()
