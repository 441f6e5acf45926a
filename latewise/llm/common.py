"""Helpers the text operators share: staged tables, bounded batches, hashed words."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts average some thousand bytes and may be far longer, so the
#: default of 10,000 rows would let a run of long texts fill a worker.
ARROW_ROWS = 1000
#: Bytes of text that array work holds at a time.
PIECE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. Only a
    local session may go without it: it gets a folder of its own, once."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="latewise-llm-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: what follows does
    not run it twice, and a lost executor costs no more than the reading of a file."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for the session (see ``ARROW_ROWS``)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def partitions_for(spark: SparkSession, n: float, each: float) -> int:
    """Shuffle partitions for ``n`` units at ``each`` a partition, the session's at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / each), 1)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column (null: none)."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def runs(weights, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose weights add up to ``limit`` at most (one item may
    exceed it alone)."""
    start, total = 0, 0
    for i, w in enumerate(weights):
        if i > start and total + w > limit:
            yield start, i
            start, total = i, 0
        total += w
    if start < len(weights):
        yield start, len(weights)


def id_batch(schema: pa.Schema, ids, **columns) -> pa.RecordBatch:
    """A record batch with the given id array first, cast to ``schema``."""
    arrays = [ids, *columns.values()]
    return pa.RecordBatch.from_arrays(
        [(a if isinstance(a, pa.Array) else pa.array(a)).cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE_BYTES + 4096)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[key] = np.cumprod(table, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _piece_words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the runs of word bytes in a buffer."""
    flag = np.zeros(len(data) + 2, np.int8)
    flag[1:-1] = is_word[data]
    edge = np.diff(flag)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def hashed_words(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text (a word: a maximal run of bytes for which
    ``is_word`` holds) and the offsets of each text's words. Works on about a megabyte at a
    time; a longer text is cut between words."""
    hashes, counts, hold, size = [], np.zeros(len(texts), np.int64), [], 0

    def flush():
        if not hold:
            return
        data = np.frombuffer(b"\x00".join(x for _, x in hold), np.uint8)
        h, starts, _ = _piece_words(data, is_word)
        bounds = np.cumsum([len(x) + 1 for _, x in hold])
        which = np.array([i for i, _ in hold])[np.searchsorted(bounds, starts, "right")]
        np.add.at(counts, which, 1)
        hashes.append(h)
        hold.clear()

    for i, text in enumerate(texts):
        for piece in cut(text, is_word):
            if size + len(piece) > PIECE_BYTES:
                flush()
                size = 0
            hold.append((i, piece))
            size += len(piece) + 1
    flush()
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), offsets


def cut(text: bytes, is_word: np.ndarray, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes, none of which breaks a word (a single word
    longer than that stays whole)."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and is_word[text[end]] and is_word[text[end - 1]]:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def byte_table(rule) -> np.ndarray:
    """A table of 256 flags from a rule on a byte. Byte zero separates texts: never a word."""
    return np.array([i > 0 and bool(rule(i)) for i in range(256)])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every run, one after the other."""
    total = np.cumsum(lengths)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) - np.repeat(total - lengths - starts, lengths)
