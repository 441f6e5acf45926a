"""Best-fit packing of token sequences.

Documents are encoded, closed by an end token and cut into pieces of at most ``size`` tokens. All
pieces of the corpus are packed best-fit decreasing: longest first, each into the open sequence
with the least room that still holds it, a new one where there is none. Lengths are whole
numbers up to ``size``, so what best-fit decreasing does depends only on how many pieces have each
length: the driver gets those ``size`` counts, however large the corpus, and places all pieces of
a length together. A segment tree over the remaining capacities (one leaf for each) finds the
tightest open sequences in logarithmic time; sequences with equal room are held as ranges of
numbers. The plan says which ranks among the pieces of a length go where. It has a bounded number
of steps: for each length at most one range is split and one opened, and a range that takes as
many pieces of a length as it can keeps less than half its room, so it is moved some log2(size)
times; for 2,048 tokens that is under 100,000 steps.

A piece's rank among those of its length is its rank inside its block (an encoding task) plus the
counts of earlier blocks, so no task sees all pieces of a common length; it only sees one count a
block. Pieces are encoded once and staged: a task that is run again gives no other ranks.

Null text: empty, which is one end token. Rows with a null or a repeated id are documents of
their own. Pieces of equal length are interchangeable: which of them shares a sequence with
which depends on the order of the blocks. Texts are encoded whole. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from latewise.llm.bpe import Encoder, Vocabulary
from latewise.llm.common import ragged, runs, small_batches, staged

#: Chunks of text (between white space) whose ids a task remembers; bytes encoded together.
REMEMBERED, TEXT_BYTES = 500_000, 2 << 20
#: Signs that are a word of their own after letters.
PUNCTUATION = frozenset(b"%c" % c for c in b",.;:!?)")
#: Ranks of a length in a plan's keys.
RANKS = 1 << 48


class Numbers(dict):
    """Numbers keys as they are first asked for; ``new`` lists those since it was last emptied."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        self.new.append(key)
        self[key] = number = len(self)
        return number

    def of(self, keys, n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, n)


class Lists:
    """Many lists of ids in one array."""

    def __init__(self):
        self.starts, self.sizes, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))

    def joined(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists ``at`` one after the other, and the length of each group of ``counts`` lists."""
        sizes = self.sizes[at]
        return self.ids[ragged(self.starts[at], sizes)], totals(sizes, counts)


class ChunkEncoder:
    """Ids of whole texts. No word crosses ASCII white space, so the chunks between it are
    encoded one by one. A chunk's ids, and those of the words in it, are kept for the texts that
    follow."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.split = vocabulary, Encoder(vocabulary).pieces
        self._forget()

    def _forget(self):
        self.chunks, self.chunk_ids, self.words, self.word_ids = Numbers(), Lists(), Numbers(), Lists()
        special = self.vocabulary.special
        self.words.of(special, len(special))
        self.words.new = []
        self.word_ids.add(np.fromiter(special.values(), np.int64, len(special)), np.ones(len(special), np.int64))

    def _pieces(self, chunk: bytes) -> list[str]:
        if chunk.isalpha():  # ASCII letters only
            return [chunk.decode().lower()]
        if chunk[-1:] in PUNCTUATION and chunk[:-1].isalpha():
            return [chunk[:-1].decode().lower(), chunk[-1:].decode()]
        return self.split(chunk.decode("utf-8"))

    def _learn(self, chunks: list[bytes]) -> None:
        parts = [self._pieces(c) for c in chunks]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        at = self.words.of(chain.from_iterable(parts), int(counts.sum()))
        if self.words.new:
            self.word_ids.add(*self.vocabulary.merge([w.encode("utf-8") for w in self.words.new]))
            self.words.new = []
        self.chunk_ids.add(*self.word_ids.joined(at, counts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array and how many each text has."""
        if len(self.chunks) > REMEMBERED:
            self._forget()
        split = [t.encode("utf-8").split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = self.chunks.of(chain.from_iterable(split), int(counts.sum()))
        if self.chunks.new:
            self._learn(self.chunks.new)
            self.chunks.new = []
        return self.chunk_ids.joined(at, counts)


def totals(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups of the given sizes."""
    upto = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


def pieces(docs: DataFrame, path: str, size: int, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, block, rank): the documents' ids, ``end`` after each,
    in pieces of ``size`` ids (the last may be shorter); ids are little-endian 32-bit numbers.
    rank counts the pieces of this length before it in its block."""
    spark = docs.sparkSession
    small_batches(spark)
    tables = spark.sparkContext.broadcast(Vocabulary(path))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
                         StructField("ids", BinaryType()), StructField("block", IntegerType()), StructField("rank", LongType())])

    def work(batches):
        encoder, seen, block = ChunkEncoder(tables.value), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for at, to in runs([len(t) for t in texts], TEXT_BYTES):
                ids, counts = encoder.encode(texts[at:to])
                ids = np.insert(ids, np.cumsum(counts), end).astype("<u4")
                counts = counts + 1
                n = -(-counts // size)
                piece = ragged(np.zeros(len(n), np.int64), n)
                length = np.minimum(np.repeat(counts, n) - piece * size, size)
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - first
                rank += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                ends = np.concatenate(([0], np.cumsum(length)))
                data = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[at:to].take(pa.array(np.repeat(np.arange(to - at), n))), pa.array(piece, pa.int32()), pa.array(piece * size),
                     pa.array(length), pa.array([data[4 * s:4 * e] for s, e in zip(ends, ends[1:], strict=False)], pa.binary()),
                     pa.array(np.full(len(piece), block), pa.int32()), pa.array(rank)], names=schema.names)

    return rows.mapInArrow(work, schema)


class Capacities:
    """A segment tree over the room left in open sequences: which rooms have any, and their
    ranges of sequence numbers."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, room: int) -> None:
        at = room + self.leaves
        self.any[at] = bool(self.ranges[room])
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def add(self, room: int, first: int, n: int) -> None:
        """``n`` sequences from number ``first`` on have ``room`` left (full ones are closed)."""
        if n and room:
            self.ranges[room].append((first, n))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        """Some range of sequences with just that room, which is taken out."""
        got = self.ranges[room].pop()
        self._mark(room)
        return got

    def tightest(self, need: int) -> int | None:
        """The least room of an open sequence that is ``need`` or more."""
        at = need + self.leaves
        if self.any[at]:
            return need
        # up to the first right neighbour with an open sequence, then down to its leftmost leaf
        while at > 1 and (at & 1 or not self.any[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], size: int) -> np.ndarray:
    """The plan of best-fit decreasing for ``counts[length]`` pieces, rows (length * RANKS + first
    rank, first sequence, pieces to a sequence, room before), sorted: the pieces of a length
    from that rank on go into consecutive sequences, so many into each, up to the next row."""
    open_ones, plan, opened = Capacities(size), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = open_ones.tightest(length)
            if room is None:
                room, first, n = size, opened, -(-left // (size // length))
                opened += n
            else:
                first, n = open_ones.take(room)
            # a sequence that took one of these is now the tightest, while it holds another
            each = room // length
            whole = min(n, left // each)
            rest = left - whole * each if whole < n else 0
            plan.append((length * RANKS + rank, first, each, room))
            open_ones.add(room - each * length, first, whole)
            if rest:
                open_ones.add(room - rest * length, first + whole, 1)
            used = whole + (rest > 0)
            open_ones.add(room, first + used, n - used)
            rank, left = rank + whole * each + rest, left - whole * each - rest
    return np.array(sorted(plan), np.int64).reshape(-1, 4)


def place(cut: DataFrame, size: int) -> DataFrame:
    """``cut`` (a stored table of pieces with length, block and rank) with sequence_id and offset
    in place of block and rank. Sequences are gapless and at most ``size`` long."""
    spark = cut.sparkSession
    counts = staged(cut.groupBy("length", "block").agg(F.count("*").alias("__n")), "packing-counts")
    # at most ``size`` rows
    plan = best_fit({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}, size)
    steps = spark.sparkContext.broadcast(plan)
    earlier = F.sum("__n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("length", "block", F.coalesce(earlier, F.lit(0)).alias("__before"))
    ranked = cut.join(before, ["length", "block"]).select(*[c for c in cut.columns if c not in ("block", "rank")],
                                                          (F.col("rank") + F.col("__before")).alias("rank"))
    schema = StructType([*(ranked.schema[c] for c in ranked.columns if c != "rank"),
                         StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def work(batches):
        key, first, each, room = steps.value.T
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length * RANKS + rank, "right") - 1
            within = rank - key[at] % RANKS
            kept = [b.column(c) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(first[at] + within // each[at]),
                                              pa.array(size - room[at] + within % each[at] * length)], names=schema.names)

    return ranked.mapInArrow(work, schema)


def pack(docs: DataFrame, path: str, size: int, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece."""
    return place(staged(pieces(docs, path, size, end, doc_id, text), "packing-pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences' ids, little-endian 32-bit numbers; a sequence
    has at most ``size`` pieces, each of one id or more."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def op13_best_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)
    # the digest is taken where the ids are made, so that only small rows are stored and shuffled
    digests = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "block", "rank")
    return place(staged(digests, "packing-pieces"), 2048)
