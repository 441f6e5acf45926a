"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are looked for inside long documents: an item is found in a document that
holds at least ``threshold`` of the item's distinct shingles (five words).

Items fall into classes of like size (powers of two). An item's sketch is its bottom-k MinHash,
the k smallest hashes of its shingles. A document that holds the share ``threshold`` of an
item of n shingles misses at most floor((1 - threshold) * n) of them, so one more sketch value
than the largest item of the class may miss is a k at which every such document shares a value:
the search loses nothing, whatever the sizes of the documents. A document is looked up only in
classes whose items it is large enough to hold. Every candidate is then verified on its words:
the shingles themselves are compared, not their hashes.

The sketches of a block of items (``BLOCK_BYTES`` of their text) go to all tasks, and all
documents pass each block once; the items are the stated query set, and no document is shuffled.

A word is a run of letters and digits a-z, 0-9 and of characters beyond ASCII, after lower-casing.
A text of fewer words than a shingle has one shingle, all its words; without words it has none
and neither holds nor is held. Null texts count as empty, repeated rows give a result each, an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from latewise.llm.common import byte_table, hashed_words, mix, runs, small_batches, text_bytes

#: Bytes of item texts whose sketches are sent to the tasks together.
BLOCK_BYTES = 16 << 20
#: Bytes of document text whose shingles a task hashes together.
TEXT_BYTES = 4 << 20
#: Bits of the table that tells most hashes apart from the sketches' at once.
FILTER_BITS = 20

WORD = re.compile(r"[^\x00-/:-`{-\x7f]+")
IS_WORD = byte_table(lambda b: b > 127 or chr(b).isalnum())


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(text: str, k: int) -> set[str]:
    """The distinct shingles of a text: k words joined by spaces."""
    w = words(text)
    return {" ".join(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def shingle_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and the index of each one's text."""
    h, at = hashed_words([t.lower().encode("utf-8", "replace") for t in texts], IS_WORD)
    n = np.diff(at)
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k if len(out) else 0):
        out = mix(out + h[j: j + len(out)])
    # shingles that cross into the next text go
    text = np.repeat(np.arange(len(texts)), n)
    whole = text[: len(out)] == text[k - 1:]
    long_h, long_t = out[whole], text[: len(out)][whole]
    short = np.flatnonzero((n > 0) & (n < k))
    short_h = np.zeros(len(short), np.uint64)
    for i, t in enumerate(short):
        for x in h[at[t]: at[t + 1]]:
            short_h[i] = mix(short_h[i: i + 1] + x)[0]
    return np.concatenate((long_h, short_h)), np.concatenate((long_t, short))


class Sketches:
    """Bottom-k sketches of a block of items, by size class."""

    def __init__(self, items: list[str], k: int, threshold: float):
        self.k, self.threshold = k, threshold
        self.texts = items
        h, item = shingle_hashes(items, k)
        pairs = np.unique(np.stack((item.astype(np.uint64), h), 1), axis=0)
        item, h = pairs[:, 0].astype(np.int64), pairs[:, 1]
        n = np.bincount(item, minlength=len(items))
        upper = 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
        sketch = np.floor((1 - threshold) * upper + 1e-9).astype(np.int64) + 1
        rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)  # hashes of an item are sorted
        own = rank < sketch[item]
        order = np.argsort(h[own], kind="stable")
        self.hashes, self.items = h[own][order], item[own][order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes & np.uint64((1 << FILTER_BITS) - 1)] = True
        # the fewest shingles that a document needs to hold the smallest item of a class
        self.least = np.ceil(threshold * (upper // 2 + 1) - 1e-9).astype(np.int64)
        self.n = n

    def candidates(self, texts: list[str]) -> np.ndarray:
        """Pairs (index of a text, index of an item) that share a sketch value."""
        h, text = shingle_hashes(texts, self.k)
        size = np.bincount(text, minlength=len(texts))
        maybe = self.filter[h & np.uint64((1 << FILTER_BITS) - 1)]
        h, text = h[maybe], text[maybe]
        first, last = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        hit = last > first
        first, count, text = first[hit], (last - first)[hit], text[hit]
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        pairs = np.stack((np.repeat(text, count), self.items[at]), 1)
        pairs = pairs[(size[pairs[:, 0]] >= self.least[pairs[:, 1]])]
        return np.unique(pairs, axis=0)


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): every document that holds at least
    ``threshold`` of an item's distinct shingles, with each such item."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    id_type, item_type = rows.schema["doc_id"], items.schema["item_id"]
    schema = StructType([id_type, item_type, StructField("n_shingles", LongType()), StructField("n_shared", LongType()), StructField("containment", DoubleType())])
    found = None
    for own in _item_blocks(items):
        part = _search(spark, rows, own, k, threshold, schema)
        found = part if found is None else found.unionByName(part)
    return found


def _item_blocks(items: DataFrame):
    """The items (item_id, text) in blocks of about ``BLOCK_BYTES`` of text; one block at least."""
    items = items.where("text is not null")
    n_blocks = max(1, math.ceil(text_bytes(items) / BLOCK_BYTES))
    for block in range(n_blocks):
        yield (items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)).collect()


def _matches(sketches: Sketches, sets: dict[int, set[str]], texts: list[str], k: int, threshold: float):
    """(index of a text, index of an item, its shingles, shared ones) of all verified finds."""
    for at, to in runs([len(t) for t in texts], TEXT_BYTES):
        by_text = defaultdict(list)
        for t, i in sketches.candidates(texts[at:to]).tolist():
            by_text[at + t].append(i)
        for t, candidates in by_text.items():
            has = shingles(texts[t], k)
            for i in candidates:
                if i not in sets:
                    sets[i] = shingles(sketches.texts[i], k)
                shared = len(sets[i] & has)
                if shared >= threshold * len(sets[i]) - 1e-9:
                    yield t, i, len(sets[i]), shared


def _search(spark, rows, block, k, threshold, schema):
    ids = [r[0] for r in block]
    sent = spark.sparkContext.broadcast((Sketches([r[1] for r in block], k, threshold), ids))

    def search(batches):
        sketches, item_ids = sent.value
        sets: dict[int, set[str]] = {}
        for b in batches:
            out = list(_matches(sketches, sets, [t or "" for t in b.column("text").to_pylist()], k, threshold))
            if out:
                t, i, n, shared = (list(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").take(pa.array(t)), "item_id": [item_ids[x] for x in i], "n_shingles": pa.array(n, pa.int64()),
                    "n_shared": pa.array(shared, pa.int64()), "containment": pa.array(np.array(shared) / np.array(n), pa.float64())})

    return rows.mapInArrow(search, schema)


def clean(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without those that hold an item, row by row whatever their ids. All columns are kept."""
    spark, schema = docs.sparkSession, docs.schema
    small_batches(spark)
    for block in _item_blocks(items.select("item_id", "text")):
        sent = spark.sparkContext.broadcast(Sketches([r[1] for r in block], k, threshold))

        def work(batches, sent=sent):
            sets: dict[int, set[str]] = {}
            for b in batches:
                gone = {t for t, *_ in _matches(sent.value, sets, [t or "" for t in b.column("text").to_pylist()], k, threshold)}
                yield b.filter(pa.array([t not in gone for t in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(work, schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _shingles_sql(table: str, key: str) -> str:
    return f"""
SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-/:-`{{-\\x7f]+') AS w FROM {table})"""


OP1_SQL = f"""
WITH item AS ({_shingles_sql("benchmark", "item_id")}),
doc AS ({_shingles_sql("documents", "doc_id")}),
item_n AS (SELECT item_id, count(*) AS n_shingles FROM item GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared::DOUBLE / n_shingles AS containment
FROM (SELECT doc_id, item_id, count(*) AS n_shared FROM item JOIN doc USING (s) GROUP BY doc_id, item_id) JOIN item_n USING (item_id)
WHERE n_shared >= 0.8 * n_shingles
"""
