"""Language identification by multinomial naive Bayes over hashed character n-grams.

Each character n-gram (lengths ``ORDERS``, of the lower-cased text) is hashed to one of
``BUCKETS`` columns. A language's model is the smoothed log probability of every column and the
log of its share of the training rows. The counts are summed by Spark; the matrix of languages
by buckets, whose size is fixed by ``BUCKETS`` and ``MAX_LANGUAGES``, goes to all tasks. A batch
of texts is scored as a sparse matrix (a row a text, its n-grams' columns) times that matrix.

The classifier is fitted on at most about ``PER_LANGUAGE`` whole texts of each language, picked
by a hash of id and text; every text is predicted whole.

A text that is null or without letters is ``und`` with score 0, as is every text when there is
nothing to learn from. Training rows need a text and a language. Equal texts score alike, ties go
to the first language in the alphabet, repeated rows give a result each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from latewise.llm.common import runs, small_batches

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Training texts of a language, about (rows are picked by a hash).
PER_LANGUAGE = 2000
MAX_LANGUAGES = 256
#: Added to every bucket's count.
SMOOTHING = 0.5
#: Characters whose n-grams are hashed together.
CHARS = 1 << 19
#: Cells of a batch's gathered log probabilities.
CELLS = 1 << 22

LETTER = regex.compile(r"\p{L}")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def gram_columns(codes: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the n-grams of one order, and where each begins; ``ends``: for every
    character where its text ends."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for j in range(order):
        x = (x ^ codes[j: j + n]) * _FACTORS[j]
        x ^= x >> np.uint32(15)
    inside = np.arange(n) + order <= ends[:n]
    return (x[inside] & np.uint32(BUCKETS - 1)).astype(np.int64), np.flatnonzero(inside)


def text_grams(texts: list[str]):
    """(text, columns) for blocks of texts: parallel arrays of text indices (sorted within an
    order) and columns. A long text comes in several blocks, each with the characters that its
    last n-grams reach into."""
    parts = [(i, at, min(len(t), at + CHARS)) for i, t in enumerate(texts) for at in range(0, len(t), CHARS)]
    for a, b in runs([to - at for _, at, to in parts], CHARS):
        more = max(ORDERS) - 1
        pieces = [texts[i][at: to + more] for i, at, to in parts[a:b]]
        size = np.array([len(p) for p in pieces])
        codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(size)
        own = np.repeat([i for i, _, _ in parts[a:b]], size)
        begins = np.arange(len(codes)) < np.repeat(ends - size + [to - at for _, at, to in parts[a:b]], size)
        for order in ORDERS:
            column, at = gram_columns(codes, np.repeat(ends, size), order)
            at_begin = begins[at]
            yield own[at[at_begin]], column[at_begin]


def lowered(column) -> list[str]:
    return [(t or "").lower() for t in column.to_pylist()]


class Model:
    def __init__(self, languages: list[str], rows: list[int], counts: np.ndarray):
        self.languages = languages
        self.prior = np.log(np.array(rows) / sum(rows)) if rows else np.zeros(0)
        log = np.log(counts + SMOOTHING) - np.log(counts.sum(1, keepdims=True) + SMOOTHING * counts.shape[1]) if languages else counts
        self.matrix = np.ascontiguousarray((log - log.mean(0) if languages else log).T)

    def log_likelihoods(self, texts: list[str]) -> np.ndarray:
        """Texts by languages, up to a term that all languages share."""
        out = np.tile(self.prior, (len(texts), 1))
        step = max(1, CELLS // max(1, len(self.languages)))
        for text, column in text_grams(texts):
            for at in range(0, len(text), step):
                t = text[at: at + step]
                first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
                out[t[first]] += np.add.reduceat(self.matrix[column[at: at + step]], first, axis=0)
        return out


def fit(docs: DataFrame, learn: Column, doc_id: str, text: str, lang: str) -> Model:
    spark = docs.sparkSession
    rows = docs.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = sorted((r[0], r[1]) for r in rows.groupBy(F.col(lang).cast("string")).count().limit(MAX_LANGUAGES + 1).collect())
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not counts:
        return Model([], [], np.zeros((0, BUCKETS)))
    share = F.create_map(*(F.lit(x) for name, n in counts for x in (name, min(1.0, PER_LANGUAGE / n))))
    picked = rows.where(F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1_000_000)) < F.element_at(share, F.col(lang).cast("string")) * 1_000_000)
    index = F.array_position(F.array(*(F.lit(name) for name, _ in counts)), F.col(lang).cast("string")).cast("int") - 1

    def count(batches):
        total = np.zeros((len(counts), BUCKETS), np.int64)
        for b in batches:
            own = b.column("lang").to_numpy()
            for t, column in text_grams(lowered(b.column("text"))):
                np.add.at(total.reshape(-1), own[t].astype(np.int64) * BUCKETS + column, 1)
        which, column = total.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(column, pa.int32()), pa.array(total[which, column])], names=["lang", "col", "n"])

    found = (picked.select(F.col(text).alias("text"), index.alias("lang")).mapInArrow(count, "lang int, col int, n long")
             .groupBy("lang", "col").agg(F.sum("n").alias("n")).toArrow())
    table = np.zeros((len(counts), BUCKETS))
    table[found["lang"].to_numpy(), found["col"].to_numpy()] = found["n"].to_numpy()
    return Model([name for name, _ in counts], [n for _, n in counts], table)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language of each whole text and its posterior
    probability."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def work(batches):
        m = sent.value
        for b in batches:
            texts = lowered(b.column("text"))
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if m.languages:
                log = m.log_likelihoods(texts)
                best = log.argmax(1)
                top = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
                for i, t in enumerate(texts):
                    if LETTER.search(t):
                        names[i], scores[i] = m.languages[best[i]], top[i]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(work, schema)


def identify(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Predictions for all of ``docs``, learnt from the rows where ``learn`` holds."""
    return predict(docs, fit(docs, learn, doc_id, text, lang), doc_id, text)


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return identify(docs, ~F.coalesce(held_out, F.lit(False))).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
