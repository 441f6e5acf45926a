"""Toxicity by compression distance.

Two zstandard dictionaries are built, one of ordinary and one of toxic text. A text's windows
are compressed with either; how many bytes the toxic dictionary saves on a window says how much
it resembles toxic text. Windows are words (parts of very long ones), lower-cased and padded, as
the compressor never looks for matches in the last bytes of its input.

Fitting, on a bounded sample of labelled texts (``ROWS`` of each class, ``SAMPLE_BYTES`` of
text): one half makes the dictionaries, the other calibrates. Toxic documents are mostly
ordinary words, which an ordinary dictionary knows as well; so the toxic one is made of the words
that bear a sign by far more common in toxic documents, one for each of ``SETTINGS``. Signs are
whole words, beginnings of words and n-grams of eight bytes: shorter n-grams of toxic words are
found in ordinary words too. A
window counts as a hit from some bytes saved on; the texts' numbers and shares of hits and their
largest savings are calibrated to a probability by logistic regression. All texts are scored
whole.

A null text counts as empty and gets the score of a text without hits. Without both classes in
the sample the score is the share of toxic rows in it (zero without rows). Rows of ``labels``
without a document, and documents without a label, teach nothing; repeated rows give a result
each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from latewise.llm.common import small_batches
from latewise.llm.labelled import Logistic, sample

#: Texts of each class (0 ordinary, 1 toxic) and bytes of the training sample, at most about.
ROWS, SAMPLE_BYTES = {0: 6000, 1: 3000}, 32 << 20
#: Toxic texts that a sign needs, and their share at least; bytes of a word's beginnings (from, to) and of its n-grams.
LEAST, SHARE, STARTS, GRAM = 3, 0.01, (3, 16), 8
#: (name, times as common in toxic texts, log-likelihood of that, match finder, least match)
SETTINGS = (
    ("wide", 5.0, 6.0, zstandard.STRATEGY_FAST, 4),
    ("sure", 8.0, 10.0, zstandard.STRATEGY_DFAST, 5),
)
#: Bytes of the dictionaries.
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 16_384
#: Bytes of a window at most, and how far the next one of a long word begins.
WINDOW, STEP = 64, 48
#: Bytes saved from which a window counts as a hit.
HITS = (3, 4)
#: Windows whose savings a task remembers.
REMEMBERED = 200_000
_BEFORE, _AFTER = b" ", bytes(10)


def windows(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode("utf-8", "replace").split()
    if max(map(len, words), default=0) <= WINDOW:
        return words
    return [w[i: i + WINDOW] for w in words for i in range(0, max(1, len(w) - WINDOW + STEP), STEP)]


def _signs(word: bytes) -> Iterator[bytes]:
    """What may tell a word from ordinary ones: its beginnings, itself and its longer n-grams."""
    start = _BEFORE + word
    yield start + _BEFORE
    for n in range(STARTS[0], min(STARTS[1], len(word)) + 1):
        yield start[: n + 1]
    for i in range(1, len(word) - GRAM + 1):
        yield word[i: i + GRAM]


def toxic_signs(toxic: list[set[bytes]], plain: list[set[bytes]]) -> dict[bytes, tuple[int, float, float]]:
    """The signs of ``LEAST`` toxic texts and the share ``SHARE`` of them that are more common there than in the plain
    ones: number of toxic texts, lift, and the log-likelihood of a number so high over its
    expectation. Of the plain texts only the signs that are left are counted."""
    often = Counter(g for s in toxic for g in {g for w in s for g in _signs(w)})
    often = {g: c for g, c in often.items() if c >= max(LEAST, SHARE * len(toxic))}
    usual = Counter(g for s in plain for g in {g for w in s for g in _signs(w) if g in often})
    out = {}
    for g, c in often.items():
        expected = len(toxic) * (usual[g] + 1) / (len(plain) + 2)
        if c > expected:
            out[g] = (c, c / expected, c * math.log(c / expected) - c + expected)
    return out


def _content(words: Counter, size: int) -> bytes:
    """The most common words, the commonest last, where matches are cheapest."""
    out, n = [], 0
    for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0])):
        n += len(w) + 1
        if n > size:
            break
        out.append(w)
    return b" ".join(out[::-1])


class Savings:
    """How many bytes fewer the toxic dictionary needs for a window than the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes, strategy: int, least: int):
        settings = zstandard.ZstdCompressionParameters.from_level(
            3, dict_size=ORDINARY_BYTES, strategy=strategy, min_match=least, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.packers = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                                 compression_params=settings).compress for d in (ordinary, toxic)]
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, (plain, toxic) = self.known, self.packers
        for w in set(words):
            if w not in known:
                padded = _BEFORE + w + _AFTER
                known[w] = len(plain(padded)) - len(toxic(padded))
        return np.array([known[w] for w in words], np.int64)


def features(savings: list[Savings], text: str | None) -> np.ndarray:
    words = windows(text) or [b""]
    out = [np.log(len(words))]
    for s in savings:
        saved = s(words)
        top = np.partition(saved, -3)[-3:] if len(saved) > 3 else saved
        hits = np.array([(saved >= h).sum() for h in HITS])
        out += [top.max(), top.mean(), *np.log1p(hits), *np.log(hits / len(saved) + 1e-3)]
    return np.array(out)


class Model:
    """Dictionaries, match finders and calibration; plain data that any task can take."""

    def __init__(self, texts: dict[int, list[str]]):
        toxic, plain = texts[1], texts[0]
        self.calibration, self.packs = None, []
        self.prior = len(toxic) / max(1, len(toxic) + len(plain))
        if min(len(toxic), len(plain)) < 4:
            return
        own = [[set(windows(t)) for t in part] for part in (toxic[::2], plain[::2])]
        size = [len(part) for part in own]
        words = [Counter(w for s in part for w in s) for part in own]
        ordinary = _content(words[1], ORDINARY_BYTES)
        signs = toxic_signs(own[0], own[1])
        for _, lift, rare, strategy, least in SETTINGS:
            toxic_words: Counter = Counter()
            for w, c in words[0].items():
                found = [signs[g] for g in _signs(w) if g in signs and signs[g][1] >= lift and signs[g][2] >= rare]
                if found:
                    toxic_words[w] = max(found)[0] + c
            self.packs.append((ordinary, _content(toxic_words, TOXIC_BYTES), strategy, least))
        del own, words, signs
        savings = self.savings()
        held = toxic[1::2] + plain[1::2]
        y = np.array([1.0] * len(toxic[1::2]) + [0.0] * len(plain[1::2]))
        self.calibration = Logistic(np.array([features(savings, t) for t in held]), y)

    def savings(self) -> list[Savings]:
        return [Savings(*pack) for pack in self.packs]

    def probabilities(self, savings: list[Savings], texts: list[str | None]) -> np.ndarray:
        if savings and texts:
            return self.calibration(np.array([features(savings, t) for t in texts]))
        return np.full(len(texts), self.prior)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): the calibrated probability that each whole text is toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("score", DoubleType())])

    def work(batches):
        model = sent.value
        savings = model.savings()
        for b in batches:
            p = model.probabilities(savings, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(work, schema)


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    return Model(sample(docs, labels, "toxic", learn, ROWS, SAMPLE_BYTES))


def held_out(modulus: int, rest: int) -> Column:
    """Whether a row is kept from training by the checksum of its id (a null id is not)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic, row by row whatever their ids. All columns are kept."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(fit(docs, labels, ~held_out(5, 0)))

    def work(batches):
        model = sent.value
        savings = model.savings()
        for b in batches:
            yield b.filter(pa.array(model.probabilities(savings, b.column("text").to_pylist()) < 0.5))

    return docs.mapInArrow(work, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs, fit(docs, labels, ~held_out(5, 0)))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
