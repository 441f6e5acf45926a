"""BPE encoding and decoding by batched merge rounds.

The vocabulary is a published tokenizer file of the ``tokenizers`` library with byte symbols
and word ends; its path is a parameter, and the driver sends the tables (their size is that of
the vocabulary, under ``MAX_MERGES``) to the tasks. Texts are split into special tokens and
words as the file's normaliser and pattern say. The symbols of all new words of a batch lie in
one flat array: each round looks up every neighbouring pair by binary search over the sorted
pair keys, takes the lowest rank of each word, and merges that pair wherever it stands in the
word, from left to right. A word's ids are kept for the batches that follow.

Null texts count as empty: no ids, an empty decoded text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from latewise.llm.common import ragged, runs, small_batches

#: Ids must fit 16 bits for a pair to be one key.
MAX_MERGES = 1 << 16
#: Words whose ids a task remembers, and bytes of text that it encodes together.
REMEMBERED, TEXT_BYTES = 200_000, 2 << 20


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: a printable Latin
    one for itself, the others by turns from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Vocabulary:
    """The arrays of a tokenizer file; small enough to send to every task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if (model["type"], normal, [x["type"] for x in steps], spec["decoder"]) != ("BPE", ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], None):
            raise ValueError(f"{path}: another normaliser, splitter or decoder than this operator knows")
        self.pattern = steps[0]["pattern"]["Regex"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ids, end = model["vocab"], model["end_of_word_suffix"]
        if max(ids.values()) >= MAX_MERGES:
            raise ValueError(f"{path}: more ids than {MAX_MERGES}")
        self.names = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for name, i in [*ids.items(), *self.special.items()]:
            self.names[i] = name
        self.inner = np.array([ids[x] for x in byte_symbols()], np.int64)
        self.last = np.array([ids[x + end] for x in byte_symbols()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] << 16 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        # a pair must rank after the merges that make its parts: then merging all places of a
        # word's lowest pair at once is the same as merging one place at a time
        first = np.full(MAX_MERGES, -1)
        first[made[::-1]] = np.arange(len(made))[::-1]
        if len(np.unique(made)) != len(made) or (np.maximum(first[keys >> 16], first[keys & 0xFFFF]) >= np.arange(len(keys))).any():
            raise ValueError(f"{path}: merges are not in the order in which their parts are made")
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order, made[order]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, all in one array, and how many each word has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ids, word = self.inner[data], np.repeat(np.arange(len(words)), size)
        ends = np.cumsum(size) - 1
        ids[ends] = self.last[data[ends]]
        done_ids, done_word = [], []
        none = len(self.keys)
        while len(ids):
            key = ids[:-1] << 16 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(ids)))
            whole = np.repeat(least == none, length)  # no pair left in these words
            if whole.any():
                done_ids.append(ids[whole])
                done_word.append(word[whole])
            hit = (rank == np.repeat(least, length)) & (rank < none)
            # of hits in a row (a pair of equal symbols) every other one, from the left
            places = np.flatnonzero(hit)
            first = np.concatenate(([True], np.diff(places) > 1))
            in_row = np.arange(len(places)) - np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
            places = places[in_row % 2 == 0]
            ids[places] = self.made[at[places]]
            keep = ~whole
            keep[places + 1] = False
            ids, word = ids[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))


class Encoder:
    """Ids of texts, batch by batch."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split_words = regex.compile(vocabulary.pattern).findall
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")").split
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.ids, self.decoded = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for name, i in self.v.special.items():
            self._add([name], np.array([i]), np.array([1]))

    def _add(self, words, ids, sizes):
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        ends = np.cumsum(sizes)
        self.starts = np.concatenate((self.starts, len(self.ids) + ends - sizes))
        self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))
        names, at = self.v.names, 0
        for to in ends.tolist():
            self.decoded.append(" ".join([names[i] for i in ids[at:to].tolist()]))
            at = to

    def _words(self, text: str) -> list[str]:
        # lower case goes character by character in the library: no final sigma
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.split_words(text)

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens in their order. A special token keeps its name; no word
        can have it, as the pattern parts letters from signs."""
        if "<|" not in text:
            return self._words(text)
        return [w for part in self.split_special(text) for w in ([part] if part in self.v.special else self._words(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids in one array, how many each text has, and the decoded texts."""
        if len(self.known) > REMEMBERED:
            self._forget()
        split = [self.pieces(t) for t in texts]
        new = [w for w in set(chain.from_iterable(split)) if w not in self.known]
        if new:
            self._add(new, *self.v.merge([w.encode("utf-8", "replace") for w in new]))
        known, decoded = self.known, self.decoded
        at = [[known[w] for w in words] for words in split]
        text_out = [" ".join([decoded[i] for i in x]) for x in at]
        flat = np.fromiter(chain.from_iterable(at), np.int64)
        counts = np.array([int(self.sizes[x].sum()) for x in at], np.int64)
        return self.ids[ragged(self.starts[flat], self.sizes[flat])], counts, text_out


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text: its ids without special ones added, and
    what the library's ``decode(ids, skip_special_tokens=False)`` makes of them."""
    spark = docs.sparkSession
    small_batches(spark)
    tables = spark.sparkContext.broadcast(Vocabulary(path))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def work(batches):
        encoder = Encoder(tables.value)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for at, to in runs([len(t) for t in texts], TEXT_BYTES):
                ids, counts, decoded = encoder.encode(texts[at:to])
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[at:to], pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(decoded, pa.string())],
                    names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(work, schema)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode(docs, public_tokenizers.path("word_bpe_49k.json")))


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, n_tokens and the SHA-256 of the ids and of the decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", *keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
