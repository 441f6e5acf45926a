"""Document fingerprints by a randomised edit embedding.

All texts take the same random walk: at step j the walk stands at a character and writes it
down, and a shared random bit of (j, character) says whether it moves on. Texts that differ by
few edits fall into step again soon after each, so the Hamming distance of what they write is
small where their edit distance is. The bits repeat after ``PERIOD`` steps, so a table gives the
steps until the walk leaves a character, and many texts walk together, a numpy step for each
character.

A fingerprint samples ``SLOTS`` steps of the walk. A slot's step is drawn evenly from those of
the walk by a rule shared by all texts (the last of a fixed sequence of records that the walk
reaches), so walks of like length are sampled at the same steps. A slot holds 16 bits of a hash
of the ``SYMBOL`` characters from where the walk stands. The likeness of two fingerprints is the
share of equal slots, an estimate of one less the Hamming distance. Near texts are found by bands
of slots (bit sampling) and verified by their likeness.

A null text counts as empty; an empty text has zero in all slots. Equal texts have equal
fingerprints, and repeated rows a result each. Where texts are taken in order, ids descend, null
ids come last, and rows of one id go by a hash of their text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from latewise.llm.common import mix, partitions_for, small_batches, text_bytes

SLOTS, SYMBOL, PERIOD = 64, 4, 2048
#: Characters (with those of the edited texts) that walk together.
CHARS = 6 << 20
#: Bytes of text of a range of ids.
RANGE_BYTES = 16 << 20


def _gaps() -> np.ndarray:
    """For each class of characters and step: how many steps until the walk moves on."""
    bits = np.random.default_rng(4).random((256, PERIOD)) < 0.5
    bits[:, -1] = True  # every walk leaves its character within a period
    gap = np.zeros((256, PERIOD), np.int64)
    gap[:, -1] = 1
    for j in range(PERIOD - 2, -1, -1):
        gap[:, j] = np.where(bits[:, j], 1, gap[:, j + 1] + 1)
    return gap.ravel()


def _records() -> np.ndarray:
    """A row for each slot: rising steps, of which the last one that a walk of n steps reaches is
    spread evenly over the n (the places where a sequence of random numbers has a new minimum)."""
    rng = np.random.default_rng(5)
    rows = np.zeros((SLOTS, 64), np.int64)
    for k in range(1, 64):
        rows[:, k] = np.minimum(np.floor((rows[:, k - 1] + 1) / rng.random(SLOTS)), 1 << 60)
    return rows


_GAP, _RECORD = _gaps(), _records()


def fingerprints(texts: list[str]) -> np.ndarray:
    """The slots of texts, a row each."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), SLOTS), np.uint16)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return out
    start = np.cumsum(size) - size
    kind = ((codes * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.int64) * PERIOD
    order = np.argsort(-size, kind="stable")
    first, active = start[order], len(order) - np.searchsorted(np.sort(size), np.arange(size.max()), "right")
    step = np.zeros(len(order), np.int64)
    left = np.zeros(len(codes), np.int64)  # the step at which the walk comes to each character
    for i in range(size.max()):
        m = active[i]
        at, j = first[:m] + i, step[:m]
        left[at] = j
        j += _GAP[kind[at] + (j & (PERIOD - 1))]
    length = np.zeros(len(texts), np.int64)
    length[order] = step
    # where each walk stands at the steps of its slots
    full = np.flatnonzero(size)
    for at in range(0, len(full), 4096):
        own = full[at: at + 4096]
        sampled = np.zeros((len(own), SLOTS), np.int64)
        for k in range(SLOTS):
            sampled[:, k] = _RECORD[k, np.searchsorted(_RECORD[k], length[own]) - 1]
        wide = int(length[own].max()) + 1
        lo, hi = start[own[0]], start[own[-1]] + size[own[-1]]
        text = np.repeat(np.arange(len(own)), size[own])  # empty texts between them have no characters
        place = np.searchsorted(left[lo:hi] + text * wide, (sampled + np.arange(len(own))[:, None] * wide).ravel(), "right") - 1 + lo
        end = np.repeat(start[own] + size[own], SLOTS)
        h = np.zeros(len(place), np.uint64)
        for s in range(SYMBOL):
            inside = place + s < end
            h = mix(h + np.where(inside, codes[np.minimum(place + s, len(codes) - 1)] + np.uint32(1), 0).astype(np.uint64))
        out[own] = (h >> np.uint64(48)).astype(np.uint16).reshape(len(own), SLOTS) | np.uint16(1)
    return out


def text_of(slots: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in slots]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(range, doc_id, text, extra) in ranges of ids, each sorted by descending id in its
    partition. The row that begins a range is also given, with ``extra``, to the end of the range
    before it (the first range's to the last), so every row's successor is at hand and texts are
    shuffled once. Only one id a range comes to the driver."""
    spark = docs.sparkSession
    n = partitions_for(spark, text_bytes(docs, text), RANGE_BYTES)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), key.alias("__key"), (-key.cast("double")).alias("__down"))
    cuts = sorted(set(rows.agg(F.percentile_approx("__down", [i / n for i in range(1, n)], 10_000)).first()[0] or [])) if n > 1 else []
    splits = [-float("inf"), *(c for c in cuts if abs(c) != float("inf")), float("inf")]
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="__down", outputCol="__range").transform(rows)
    else:
        rows = rows.withColumn("__range", F.lit(0.0))
    rows = rows.withColumn("__range", F.col("__range").cast("int"))
    heads = sorted((r[0], r[1]) for r in rows.groupBy("__range").agg(F.max("__key")).collect())
    to = {heads[i][1]: heads[i - 1][0] for i in range(len(heads))}
    begins = spark.createDataFrame(list(to.items()) or [(None, None)], "__head long, __to int")
    # as many rows as ranges
    marked = rows.join(F.broadcast(begins), F.col("__key") == F.col("__head"), "left")
    copies = F.array(F.struct(F.col("__range").alias("range"), F.lit(0).alias("extra")), F.struct(F.col("__to").alias("range"), F.lit(1).alias("extra")))
    dealt = marked.select("doc_id", "text", "__key", F.explode(F.filter(copies, lambda x: x["range"].isNotNull())).alias("at"))
    return (dealt.select("doc_id", "text", "__key", "at.range", "at.extra").repartition(n, "range")
            .sortWithinPartitions("range", "extra", F.desc("__key"), F.xxhash64("text")).select("range", "extra", "doc_id", "text"))


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as many first characters of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _work(batches):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def flush(ids, texts):
        """All rows but the last, which is the last one's successor."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        slots = fingerprints(texts + changed)
        own, other = slots[: len(texts)], slots[len(texts):]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[:-1], id_type), pa.array([len(t) for t in texts[:-1]], pa.int64()),
             pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
             pa.array(text_of(own[:-1]), pa.string()), pa.array(text_of(other), pa.string()),
             pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:]))], names=names)

    ids, texts, size, now, closed, id_type = [], [], 0, None, False, None
    for b in batches:
        id_type = b.column("doc_id").type
        for part, extra, i, t in zip(*(b.column(c).to_pylist() for c in ("range", "extra", "doc_id", "text")), strict=True):
            if part != now:
                ids, texts, size, now, closed = [], [], 0, part, False
            if closed:
                continue
            ids.append(i)
            texts.append(t or "")
            size += 2 * len(texts[-1])
            if extra or size >= CHARS and len(texts) > 1:
                yield flush(ids, texts)
                ids, texts, size = ids[-1:], texts[-1:], 2 * len(texts[-1])
                closed = bool(extra)


def edit_prints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's fingerprint, that of its edited text (see ``edited``; the next text is that of
    the next lower id, after the last the first), and their likeness to it and to the next's."""
    small_batches(docs.sparkSession)
    rows = with_next(docs, doc_id, text)
    schema = StructType([rows.schema["doc_id"], StructField("n_chars", LongType()), StructField("edited_sha256", StringType()),
                         StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()),
                         StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())])
    return rows.mapInArrow(_work, schema)


def near_pairs(prints: DataFrame, threshold: float = 0.8, band: int = 4) -> tuple[DataFrame, DataFrame]:
    """Pairs of different fingerprints (a < b) with a likeness of ``threshold`` at least, among
    those that agree on ``band`` neighbouring slots, and the fingerprint of every document.
    ``prints``: doc_id and fingerprint. Copies share a fingerprint and make no pairs."""
    width = 4 * band
    classes = prints.select("fingerprint").distinct()
    bands = classes.select("fingerprint", F.posexplode(F.array(*(F.substring("fingerprint", 1 + i * width, width) for i in range(SLOTS // band)))).alias("place", "value"))
    other = bands.select(F.col("fingerprint").alias("b"), "place", "value")
    # a pair is taken at the first band that it shares, so none comes twice
    slots = lambda c: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.substring(c, i * 4 + 1, F.lit(4)))
    first = F.array_position(F.zip_with(F.array(*(F.substring("a", 1 + i * width, width) for i in range(SLOTS // band))),
                                        F.array(*(F.substring("b", 1 + i * width, width) for i in range(SLOTS // band))), lambda x, y: x == y), True) - 1
    equal = F.size(F.filter(F.zip_with(slots(F.col("a")), slots(F.col("b")), lambda x, y: x == y), lambda x: x)) / SLOTS
    pairs = (bands.withColumnRenamed("fingerprint", "a").join(other, ["place", "value"]).where("a < b").where(first == F.col("place"))
             .select("a", "b", equal.alias("likeness")).where(F.col("likeness") >= threshold))
    return pairs, prints.select("doc_id", "fingerprint")


def op4_edit_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edit_prints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
