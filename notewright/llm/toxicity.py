"""Toxicity: a linear classifier on character n-grams, each scaled by its naive Bayes log-count ratio.

1. A text's features are the distinct n-grams of 2 to 5 of its characters, letters in lower case, named by 64-bit hashes.
2. Over labelled texts (a bounded number), documents of each label are counted for each n-gram. The log ratio of the two smoothed
   shares is the n-gram's scale; those whose counts differ most between the labels (by the likelihood ratio) are kept.
3. A logistic model on the scaled features is fitted to a smaller sample of labelled texts, its bias and slope are set
   on a part held back from the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.shared import drop, mix, pieces, small_batches, utf8, written

ORDERS = (2, 3, 4, 5)
#: Text of one batch, characters hashed at once, and n-grams held before a task passes its counts on.
BATCH_BYTES, WINDOW, HELD = 1 << 20, 1 << 18, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts of a column, A-Z in lower case and blanks alike, and where each text begins."""
    data, offsets = utf8(column)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    codes = np.where((codes >= 65) & (codes <= 90), codes + 32, np.where((codes >= 9) & (codes <= 13), 32, codes))
    return codes.astype(np.uint64), begins


def windows(codes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(order, first position, hashes, which of them lie in one text) of all n-grams, in windows of bounded size."""
    most = max(ORDERS)
    for at in range(0, len(codes), WINDOW):
        own = codes[at : at + WINDOW + most - 1]
        n = min(WINDOW, len(codes) - at)
        # What is left of the text at each position.
        text = np.searchsorted(begins, np.arange(at, at + n), "right")
        room = begins[text] - np.arange(at, at + n)
        h = np.full(n, 7, np.uint64)
        for order in range(1, most + 1):
            m = min(n, max(0, len(own) - order + 1))
            h = h[:m] * _BASE + own[order - 1 : order - 1 + m] + np.uint64(1)
            if order in ORDERS:
                yield order, at, mix(h ^ np.uint64(order)), room[:m] >= order


def grams_by_text(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct n-grams of each text."""
    texts, hashes = [], []
    for _, at, h, whole in windows(codes, begins):
        text = np.searchsorted(begins, np.arange(at, at + len(h))[whole], "right") - 1
        h = h[whole]
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        texts.append(text[new])
        hashes.append(h[new])
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    text, h = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]


def label_counts(labelled: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(gram, n0, n1): in how many labelled texts of each label an n-gram occurs. Tasks add up before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            grams, which = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return grams, *(np.bincount(which, np.concatenate([x[k] for x in held]), len(grams)) for k in (1, 2))

        for batch in pieces(batches, text_col, BATCH_BYTES):
            labels = np.asarray(batch.column(1), dtype=np.float64)
            text, h = grams_by_text(*characters(batch.column(0)))
            held.append((h, 1 - labels[text], labels[text]))
            size += len(h)
            if size > HELD:
                held = [added()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from rows(*held.pop())
                    size = 0
        if held:
            yield from rows(*added())

    def rows(grams: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(grams), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(grams[part].view(np.int64)), pa.array(n0[part].astype(np.int64)), pa.array(n1[part].astype(np.int64))], ["gram", "n0", "n1"])

    parts = labelled.select(text_col, label_col).mapInArrow(work, "gram long, n0 long, n1 long")
    return parts.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def log_ratio(n0: Column, n1: Column, texts0: Column, texts1: Column) -> Column:
    """The log of the smoothed share of texts of label 1 over that of label 0."""
    return F.log((n1 + 1) / (texts1 + 2)) - F.log((n0 + 1) / (texts0 + 2))


def strength(n0: Column, n1: Column, texts0: Column, texts1: Column) -> Column:
    """The likelihood ratio of one share of texts for each label against one share for both."""

    def fit(n: Column, of: Column, share: Column) -> Column:
        return F.when(n > 0, n * F.log(share)).otherwise(0) + F.when(n < of, (of - n) * F.log(1 - share)).otherwise(0)

    both = (n0 + n1) / (texts0 + texts1)
    return F.round(fit(n0, texts0, n0 / texts0) + fit(n1, texts1, n1 / texts1) - fit(n0, texts0, both) - fit(n1, texts1, both), 9)


@dataclass
class Model:
    """Kept n-grams in order of their hashes, their scales and weights, the bias and the slope of the logit."""

    grams: np.ndarray
    scales: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0

    def __post_init__(self) -> None:
        #: Whether some kept n-gram has these low bits: most n-grams of a text go no further.
        self._mask = np.uint64((1 << 20) - 1)
        self._seen = np.zeros(1 << 20, bool)
        self._seen[(self.grams & self._mask).astype(np.int64)] = True

    def features(self, column: pa.Array) -> np.ndarray:
        """Which kept n-grams each text holds, a row of booleans a text."""
        codes, begins = characters(column)
        out = np.zeros((len(begins) - 1, len(self.grams)), bool)
        if len(self.grams):
            for _, at, h, whole in windows(codes, begins):
                near = np.flatnonzero(whole & self._seen[(h & self._mask).astype(np.int64)])
                place = np.searchsorted(self.grams, h[near])
                hit = self.grams[np.minimum(place, len(self.grams) - 1)] == h[near]
                near, place = near[hit], place[hit]
                out[np.searchsorted(begins, at + near, "right") - 1, place] = True
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        logits = np.array([float((self.weights * self.scales)[row].sum()) for row in features])
        return 1 / (1 + np.exp(-np.clip(self.slope * (logits + self.bias), -60, 60)))


def fit(model: Model, packed: np.ndarray, labels: np.ndarray, epochs: int = 30, penalty: float = 1e-2, seed: int = 12) -> Model:
    """Weights by Adam on the log loss of four fifths of the rows (bits of ``packed``), bias and slope by Newton steps on the rest.
    Without rows, or with one label only, the model says that label's share."""
    y = labels.astype(np.float64)
    share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
    model.bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2 or len(y) < 10:
        return model
    rng = np.random.default_rng(seed)
    n = len(model.grams)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    scaled = lambda rows: np.unpackbits(packed[rows], axis=1, count=n).astype(np.float32) * model.scales.astype(np.float32)
    w, first, second, step = np.zeros(n), np.zeros(n), np.zeros(n), 0
    b = model.bias
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // 256)):
            x = scaled(rows)
            p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -60, 60)))
            d = (p - y[rows]) / len(rows)
            g = x.T @ d.astype(np.float32) + penalty * w
            step += 1
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            b -= rate * float(d.sum())
    model.weights, model.bias = w, b
    z = np.concatenate([scaled(rows) @ w for rows in np.array_split(held, max(1, len(held) // 256))]) + b
    slope, shift = 1.0, 0.0
    for _ in range(50):  # a penalty draws the slope to 1, so that parts which are told apart keep it finite
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -60, 60)))
        d, v = p - y[held], p * (1 - p) + 1e-9
        g = np.array([(d * z).sum() + (slope - 1), d.sum() + 0.1 * shift])
        h = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        move = np.linalg.solve(h, g)
        slope, shift = max(0.1, slope - float(move[0])), shift - float(move[1])
    model.slope, model.bias = slope, model.bias + shift / slope
    return model


def classify_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most_grams: int = 2048, least_texts: int = 5, most_counted: int = 200_000, most_labelled: int = 20_000, threshold: float = 0.7, folds: int = 3, held_fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every document.

    Rows whose crc32(id as text) mod ``folds`` is ``held_fold`` are held out: their labels are never read. N-grams are counted over
    at most ``most_counted`` of the other labelled documents; the ``most_grams`` strongest of those in ``least_texts`` texts or
    more are the model's features, and its weights are fitted to at most ``most_labelled`` of them. Both samples are the
    first by a hash of the id; their ids and labels go to all tasks, so that no text is shuffled. Scores use the text alone, whole, in windows, so very long texts take no more memory than their characters.
    Null and empty texts are scored by the bias. Null ids are in the fold of the empty text and have no label; of
    an id labelled twice the smaller label counts; null labels are left out, labels above 0 count as 1; repeated
    rows are scored each by itself; no other column is read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold != held_fold)).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    known = known.withColumn("_label", (F.col("_label") > 0).cast("int"))
    # At most most_counted ids with a label: 12 bytes each, small enough to send to each task.
    counted = written(known.orderBy(F.xxhash64(id_col), id_col).limit(most_counted), "counted")
    labelled = docs.select(id_col, text_col).join(F.broadcast(counted), id_col)
    sizes = labelled.agg(F.count(F.when(F.col("_label") == 0, 1)).alias("texts0"), F.count(F.when(F.col("_label") == 1, 1)).alias("texts1")).first()
    model = Model(np.empty(0, np.uint64), np.empty(0), np.empty(0))
    if sizes["texts0"] and sizes["texts1"]:
        n0, n1, t0, t1 = F.col("n0"), F.col("n1"), F.lit(float(sizes["texts0"])), F.lit(float(sizes["texts1"]))
        counts = label_counts(labelled, text_col, "_label").where(n0 + n1 >= least_texts)
        best = counts.select("gram", log_ratio(n0, n1, t0, t1).alias("scale"), strength(n0, n1, t0, t1).alias("strength")).orderBy(F.desc("strength"), "gram").limit(most_grams).collect()
        grams = np.array([r["gram"] for r in best], np.int64).view(np.uint64)
        order = np.argsort(grams)
        model = Model(grams[order], np.array([r["scale"] for r in best])[order], np.zeros(len(best)))

    chosen = written(counted.orderBy(F.xxhash64(id_col), id_col).limit(most_labelled), "labelled")
    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, BATCH_BYTES):
            x = np.packbits(model.features(batch.column(1)), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], [id_col, "x", "y"])

    # Rows of most_grams / 8 bytes each.
    rows = sample.select(id_col, text_col, "_label").mapInArrow(learn, f"`{id_col}` {id_type}, x binary, y int").groupBy(id_col).agg(F.min(F.struct("x", "y")).alias("r")).select(id_col, "r.*").collect()
    rows.sort(key=lambda r: r[0])
    packed = np.array([np.frombuffer(r["x"], np.uint8) for r in rows]).reshape(len(rows), -(-len(model.grams) // 8))
    drop(counted, chosen)
    fit(model, packed, np.array([r["y"] for r in rows], np.int64))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, BATCH_BYTES):
            score = model.score(model.features(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return docs.select(id_col, (fold == held_fold).alias("held_out"), text_col).mapInArrow(judge, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")
