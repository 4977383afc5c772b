"""Quality classifier: random-indexing word vectors pooled for each document, and a two-layer network in numpy.

1. Each token has a fixed sparse index vector: one signed place from its hash and one from its shape. A word's
   context vector is the sum of its neighbours' index vectors over the whole corpus. Words share a table of
   WORDS slots, so the sums of any corpus fit in 4 MB.
2. A document's vector is the mean of its words' context vectors.
3. A network with one hidden layer is fitted on the driver to a bounded sample of labelled documents, and its
   temperature to a part held back from the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.shared import mix, pieces, small_batches, span_hashes, utf8, written

WORDS, HASHED, SHAPES, WINDOW = 1 << 14, 48, 16, 2
WIDTH = HASHED + SHAPES
BLOCK_BYTES, SLOTS_A_ROW = 1 << 20, 256

# Bytes: 0 blank, 1 letter or digit or part of a longer character, 2 other.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, *range(9, 14)]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Tokens:
    """Slots, index places and signs of all tokens of a block, and each text's first token."""

    slot: np.ndarray
    place: np.ndarray
    sign: np.ndarray
    shape: np.ndarray
    first: np.ndarray


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Runs of letters or digits and runs of marks. Shape: case and digits of a word, or which marks."""
    kind = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    edges = np.append(np.flatnonzero(new), len(data))
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0 if len(starts) else np.empty(0, bool)
    starts, ends = starts[real], ends[real]
    hashes = span_hashes(_LOWER[data], starts, ends)
    sums = [np.concatenate(([0], np.cumsum(t[data]))) for t in (_UPPER, _DIGIT)]
    upper, digit = (s[ends] - s[starts] for s in sums)
    length = ends - starts
    word = kind[starts] == 1 if len(starts) else np.empty(0, bool)
    shape = np.where(digit == length, 4, np.where(digit > 0, 5, np.where((upper > 1) & (2 * upper > length), 3, np.where(upper > 1, 2, np.where(upper == 1, 1, 0)))))
    marks = np.where(length > 1, 11 + (hashes % np.uint64(5)).astype(np.int64), 6 + (hashes % np.uint64(5)).astype(np.int64))
    shape = np.where(word, shape, marks)
    slot = (mix(hashes + shape.astype(np.uint64)) % np.uint64(WORDS)).astype(np.int64)
    again = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    return Tokens(slot, (again % np.uint64(HASHED)).astype(np.int64), 1.0 - 2.0 * ((again >> np.uint64(40)) & np.uint64(1)).astype(np.float64), shape, np.searchsorted(starts, offsets))


def context_sums(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """What a block adds to the words' context vectors, and to their numbers of neighbours."""
    n = len(tokens.slot)
    total, count = np.zeros(WORDS * WIDTH), np.zeros(WORDS)
    owner = np.repeat(np.arange(len(tokens.first) - 1), np.diff(tokens.first))
    for gap in range(1, WINDOW + 1):
        left = np.flatnonzero(owner[gap:] == owner[:-gap]) if n > gap else np.empty(0, np.int64)
        right = left + gap
        for a, b in ((left, right), (right, left)):
            row = tokens.slot[a] * WIDTH
            total += np.bincount(row + tokens.place[b], tokens.sign[b], WORDS * WIDTH)
            total += np.bincount(row + HASHED + tokens.shape[b], minlength=WORDS * WIDTH)
            count += np.bincount(tokens.slot[a], minlength=WORDS)
    return total.reshape(WORDS, WIDTH), count


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors of all slots over the neighbours they had: a table of fixed size from the whole corpus.

    Each task sends the sums of its slots; they are added as they stream in, first by (row, salt), then by row.
    """
    small_batches(docs.sparkSession)
    schema = "slots int, salt int, sums binary, counts binary"

    def rows(sums: np.ndarray, counts: np.ndarray, salt: int) -> pa.RecordBatch:
        cuts = range(0, WORDS, SLOTS_A_ROW)
        return pa.RecordBatch.from_arrays([pa.array([c // SLOTS_A_ROW for c in cuts], pa.int32()), pa.array([salt] * len(cuts), pa.int32()), pa.array([sums[c : c + SLOTS_A_ROW].tobytes() for c in cuts], pa.binary()), pa.array([counts[c : c + SLOTS_A_ROW].tobytes() for c in cuts], pa.binary())], ["slots", "salt", "sums", "counts"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums, counts = np.zeros((WORDS, WIDTH)), np.zeros(WORDS)
        for batch in pieces(batches, text_col, BLOCK_BYTES):
            s, c = context_sums(tokens_of(*utf8(batch.column(0))))
            sums += s
            counts += c
        yield rows(sums.astype(np.float32), counts, TaskContext.get().partitionId() % 64)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                s, c = np.frombuffer(r["sums"], np.float32), np.frombuffer(r["counts"])
                old = got.get(r["slots"])
                got[r["slots"]] = (s.astype(np.float64), c.copy()) if old is None else (old[0] + s, old[1] + c)
        if got:
            keys = sorted(got)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([0] * len(keys), pa.int32()), pa.array([got[k][0].astype(np.float32).tobytes() for k in keys], pa.binary()), pa.array([got[k][1].tobytes() for k in keys], pa.binary())], ["slots", "salt", "sums", "counts"])

    parts = docs.select(text_col).mapInArrow(work, schema)
    merged = parts.repartition("slots", "salt").mapInArrow(added, schema).repartition("slots").mapInArrow(added, schema)
    table, counts = np.zeros((WORDS, WIDTH), np.float32), np.zeros(WORDS)
    for r in written(merged, "word-vectors").collect():  # WORDS / SLOTS_A_ROW rows
        at = r["slots"] * SLOTS_A_ROW
        table[at : at + SLOTS_A_ROW] = np.frombuffer(r["sums"], np.float32).reshape(-1, WIDTH)
        counts[at : at + SLOTS_A_ROW] = np.frombuffer(r["counts"])
    return table / np.maximum(counts, 1)[:, None].astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The mean of each text's word vectors; without words, zeros."""
    data, offsets = utf8(column)
    tokens = tokens_of(data, offsets)
    n = len(tokens.first) - 1
    size = np.diff(tokens.first)
    sums = np.zeros((n, WIDTH))
    at = np.flatnonzero(size)
    if len(at):
        sums[at] = np.add.reduceat(vectors[tokens.slot], tokens.first[at], axis=0)
    return (sums / np.maximum(size, 1)[:, None]).astype(np.float32)


@dataclass
class Network:
    """Standardised inputs, a hidden layer of tanh units, one logistic output with a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 7) -> Network:
    """Adam on the log loss over four fifths of the rows; the temperature minimises the log loss of the rest.
    Without rows, or with one label only, the network says that label's share."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    width = x.shape[1]
    share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
    net = Network(x.mean(0) if len(x) else np.zeros(width), (x.std(0) + 1e-6) if len(x) else np.ones(width), rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2 or len(y) < 10:
        return net
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - net.mean) / net.scale
    net.w2 = rng.normal(0, 1 / np.sqrt(hidden), hidden)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // 256)):
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -60, 60)))
            d = (p - y[rows]) / len(rows)
            dh = np.outer(d, params[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((z[rows].T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()]))):
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, target = net.logits(x[held]), y[held]
    losses = [(float(np.mean(np.logaddexp(0, logits / t) - target * logits / t)), t) for t in np.geomspace(0.25, 8, 61)]
    net.temperature = float(min(losses)[1])
    return net


def classify_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_labelled: int = 20000, threshold: float = 0.7, folds: int = 4, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every document.

    Rows whose crc32(id as text) mod ``folds`` is ``held_fold`` are held out: their labels are never read. The network
    learns from at most ``most_labelled`` labelled documents, the first by a hash of the id; word vectors come from
    all texts. Scores use the text alone. Null and empty texts are scored as the zero vector. Null ids are in
    fold 0 mod ``folds`` of the empty string and have no label; of an id labelled twice the smaller label counts;
    null labels are left out; repeated rows are scored each by itself; no other column is read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds
    vectors = word_vectors(docs, text_col)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold != held_fold)).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    chosen = written(chosen.orderBy(F.xxhash64(id_col), id_col).limit(most_labelled), "labelled")
    # At most most_labelled ids: small enough to send to each task.
    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, BLOCK_BYTES):
            x = pooled(batch.column(1), vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2).cast(pa.float64())], [id_col, "x", "y"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = sample.select(id_col, text_col, "_label").mapInArrow(learn, f"`{id_col}` {id_type}, x binary, y double").dropDuplicates([id_col]).collect()
    rows.sort(key=lambda r: r[0])
    net = fit(np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, WIDTH), np.array([r["y"] for r in rows]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, BLOCK_BYTES):
            score = net.score(pooled(batch.column(2), vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return docs.select(id_col, (fold == held_fold).alias("held_out"), text_col).mapInArrow(judge, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")
