"""Quality classification with random-indexing word vectors.

A text's tokens are its runs of letters and digits and its runs of other signs. Each token has a
shape (letter case, digits, length, whether it repeats the token before). A token's entry is its
word, if the word is among the ``WORDS`` most common of the training sample, and else its shape.
Every entry has a fixed sparse random index vector; an entry's word vector is the sum of the
index vectors of the entries next to it in the sample, at unit length. A document is the mean of
the vectors of its entries, and of those of its shapes alone. Two numpy layers turn that into a
logit, and a temperature fitted on texts kept from the training makes it a probability.

All fitting is done on a bounded sample of labelled whole texts (``ROWS`` of each class,
``SAMPLE_BYTES`` of text); all texts are scored whole, long ones piece by piece.

A null text counts as empty; a text without tokens has the zero vector, which is scored like any
other. Without both classes in the sample the score is the share of good rows in it. Repeated rows
give a result each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from latewise.llm.common import _BYTE, PIECE_BYTES, _powers, byte_table, cut, mix, runs, small_batches
from latewise.llm.labelled import sample
from latewise.llm.toxicity import held_out

#: Texts of each class (0 poor, 1 good) and bytes of the training sample, at most about.
ROWS, SAMPLE_BYTES = {0: 1500, 1: 1500}, 12 << 20
#: Words with vectors of their own, dimensions, entries of an index vector that are not zero,
#: and how far a token's context reaches.
WORDS, DIMENSIONS, NONZERO, REACH = 4096, 48, 4, 2
#: Units of the hidden layer, passes, and the share of texts kept for the temperature.
HIDDEN, PASSES, KEPT = 32, 400, 0.25
SHAPES = 4 * 2 * 4 * 2 + 4 * 2

_CLASS = np.array([0 if chr(b).isspace() and b < 128 or b == 0 else 1 if b > 127 or chr(b).isalnum() else 2 for b in range(256)], np.int8)
_UPPER = np.array([65 <= b <= 90 or b == 0xC3 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SOLID = byte_table(lambda b: _CLASS[b] > 0)


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, start) of the tokens of a buffer."""
    kind = _CLASS[data]
    edge = np.concatenate(([True], kind[1:] != kind[:-1]))
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    size = ends - starts
    hashes = mix((total[ends] - total[starts]) * down[starts] + size.astype(np.uint64))
    count = lambda table: (lambda c: c[ends] - c[starts])(np.concatenate(([0], np.cumsum(table[data]))))
    capital, digits = count(_UPPER), count(_DIGIT)
    case = np.where(capital == 0, 0, np.where((capital == 1) & _UPPER[data[starts]], 1, np.where(capital * 2 >= size, 2, 3)))
    again = np.zeros(len(starts), np.int64)
    again[1:] = hashes[1:] == hashes[:-1]
    word = ((case * 2 + (digits > 0)) * 4 + np.searchsorted([4, 8, 13], size, "right")) * 2 + again
    sign = 64 + np.minimum(size, 4) * 2 - 2 + again
    return hashes, np.where(kind[starts] == 1, word, sign), starts


def token_blocks(texts: list[str]):
    """(text, hash, shape) of the tokens of about a megabyte of texts at a time."""
    parts = [(i, piece) for i, t in enumerate(texts) for piece in cut((t or "").encode("utf-8", "replace"), _SOLID)]
    for a, b in runs([len(p) + 1 for _, p in parts], PIECE_BYTES):
        own = parts[a:b]
        data = np.frombuffer(b" ".join(p for _, p in own) + b" ", np.uint8)
        hashes, shape, starts = _tokens(data)
        yield np.array([i for i, _ in own])[np.searchsorted(np.cumsum([len(p) + 1 for _, p in own]), starts, "right")], hashes, shape


class Vectors:
    """Random-indexing vectors of the common words and the shapes of a sample."""

    def __init__(self, texts: list[str]):
        blocks = list(token_blocks(texts))
        words, counts = np.unique(np.concatenate([h for _, h, _ in blocks]), return_counts=True)
        self.words = np.sort(words[np.argsort(-counts, kind="stable")[:WORDS]])
        n = len(self.words) + SHAPES
        rng = np.random.default_rng(11)
        index = np.zeros((n, DIMENSIONS))
        for _ in range(NONZERO):
            index[np.arange(n), rng.integers(0, DIMENSIONS, n)] += rng.choice([-1.0, 1.0], n)
        self.entry, self.shape = np.zeros((n, DIMENSIONS)), np.zeros((SHAPES, DIMENSIONS))
        for text, hashes, shape in blocks:
            entry = self.entries(hashes, shape)
            for step in range(1, REACH + 1):
                near = text[step:] == text[:-step]
                for a, b in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
                    vectors = index[entry[b][near]]
                    for d in range(DIMENSIONS):
                        self.entry[:, d] += np.bincount(entry[a][near], vectors[:, d], n)
                        self.shape[:, d] += np.bincount(shape[a][near], vectors[:, d], SHAPES)
        for v in (self.entry, self.shape):
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def entries(self, hashes: np.ndarray, shape: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, len(self.words) + shape)

    def documents(self, texts: list[str]) -> np.ndarray:
        total, n = np.zeros((len(texts), 2 * DIMENSIONS)), np.zeros(len(texts))
        for text, hashes, shape in token_blocks(texts):
            if not len(text):
                continue
            first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            at = text[first]
            total[at, :DIMENSIONS] += np.add.reduceat(self.entry[self.entries(hashes, shape)], first)
            total[at, DIMENSIONS:] += np.add.reduceat(self.shape[shape], first)
            n[at] += np.diff(np.append(first, len(text)))
        return total / np.maximum(n, 1)[:, None]


class Network:
    """Two layers trained by Adam, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(12)
        kept = rng.random(len(x)) < KEPT
        if len(np.unique(y[kept])) < 2 or len(np.unique(y[~kept])) < 2:
            kept = np.zeros(len(x), bool)
        self.mean, self.scale = x[~kept].mean(0), x[~kept].std(0) + 1e-6
        z, t = (x[~kept] - self.mean) / self.scale, y[~kept]
        shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), (1,)]
        self.p = [rng.normal(0, 1 / np.sqrt(s[0]), s) if i in (0, 2) else np.zeros(s) for i, s in enumerate(shapes)]
        m, v = [[np.zeros(s) for s in shapes] for _ in range(2)]
        for step in range(1, PASSES + 1):
            w1, b1, w2, _ = self.p
            hidden = np.maximum(z @ w1 + b1, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + self.p[3], -30, 30))) - t) / len(t)
            back = (error[:, None] * w2) * (hidden > 0)
            slopes = [z.T @ back + 1e-4 * w1, back.sum(0), hidden.T @ error + 1e-4 * w2, error.sum(keepdims=True)]
            for i, g in enumerate(slopes):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if kept.any():
            logit, t = self.logit(x[kept]), y[kept]
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.mean(np.logaddexp(0, logit / g) - t * logit / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


class Model:
    def __init__(self, texts: dict[int, list[str]]):
        poor, good = texts[0], texts[1]
        self.prior = len(good) / max(1, len(good) + len(poor))
        self.vectors = self.network = None
        if min(len(poor), len(good)) >= 2:
            self.vectors = Vectors(poor + good)
            self.network = Network(self.vectors.documents(poor + good), np.array([0.0] * len(poor) + [1.0] * len(good)))

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.network(self.vectors.documents(texts)) if self.network else np.full(len(texts), self.prior)


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    return Model(sample(docs, labels, "quality", learn, ROWS, SAMPLE_BYTES))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): the calibrated probability that each whole text is good."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("score", DoubleType())])

    def work(batches):
        for b in batches:
            p = sent.value(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(work, schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs, fit(docs, labels, ~held_out(3, 1)))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
