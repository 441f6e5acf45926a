"""Periodic runs of words, by block convolution.

A run is a maximal stretch of words with a smallest period q, of at least ``MIN_EXPONENT`` periods
and ``MIN_WORDS`` words. At each dyadic scale S the words are cut into blocks at multiples of S,
and a block is sought at all distances from S to 2S - 1 (from 1 on at the first scale): the sum
of the squared differences of word numbers between the block and each place of the windows that
follow is sum(b^2) + sum(w^2) - 2 sum(b w), whose last term is a correlation, taken for all places
at once by number-theoretic transforms modulo 65537 in exact integers. Where the sum is zero the
block occurs again. Every run of period q holds such a block at the scale of q, together with its
next occurrence (a run less one period is twice as long as the block). The distance is then a
seed: the stretch in which words that far apart are equal is extended to both sides, word by word
on the whole numbers of the words, so a sum that is only zero modulo the prime leaves no trace.
Stretches of three periods or more are runs, each with the least distance that gives it.

Blocks of more than ``BLOCK`` words are represented by their first ``BLOCK``; these transforms are
shared by all larger scales. Once a run with a period of at most a block is known, places inside
it are not extended again for multiples of its period: a text that repeats one word costs no more
than any other. A scale costs a fixed number of transforms a word, so a text of n words costs
n log n; texts are worked on in batches, a long one alone.

Words are compared byte by byte, case-sensitively. Null and empty texts have no words and no
runs. Ids take no part in finding runs; rows with a null or a repeated id are texts of their own.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from latewise.llm.common import ragged, runs, small_batches

#: The prime 2^16 + 1 has roots of unity of every order 2^k up to 2^16; 3 generates them.
P = 65537
#: Words of a block in the transforms, the first scale, and words worked on together.
BLOCK, FIRST, ROWS = 512, 8, 1 << 13
#: Rows multiplied at a time.
GROUP = 64
MIN_WORDS, MIN_EXPONENT = 24, 3
#: Bytes of text of a batch; a longer text is a batch of its own.
TEXT_BYTES = 1 << 20


def reduce(x: np.ndarray) -> np.ndarray:
    """Whole numbers below 2^53 in float64, modulo the prime, in place."""
    x -= np.floor((x + 0.5) * (1 / P)) * P
    return x


class Transform:
    """The number-theoretic transform of rows of n = a * b numbers: b-point transforms of columns,
    twiddle factors, a-point transforms of rows, each a product with a small matrix. Sums of at
    most 32 products of numbers below 2^17 are exact in float64."""

    def __init__(self, n: int, inverse: bool = False):
        root = pow(3, (P - 1) // n, P)
        if inverse:
            root = pow(root, -1, P)
        self.a = 1 << (n.bit_length() - 1) // 2 if n > 32 else 1
        self.b = n // self.a
        power = [1]
        for _ in range(n - 1):
            power.append(power[-1] * root % P)
        table = np.array(power, np.float64)
        grid = lambda x, y, step: table[np.outer(np.arange(x), np.arange(y)) * step % n]
        self.columns, self.rows, self.twiddle = grid(self.b, self.b, self.a), grid(self.a, self.a, self.b), grid(self.b, self.a, 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Input i = i1 * a + i2; output k = k1 + k2 * b."""
        if self.a == 1:
            # a few rows at a time: for one large product the linear algebra library starts threads
            n = len(x) // GROUP * GROUP
            y = np.empty_like(x)
            np.matmul(x[:n].reshape(-1, GROUP, x.shape[1]), self.columns, out=y[:n].reshape(-1, GROUP, x.shape[1]))
            np.matmul(x[n:], self.columns, out=y[n:])
            return reduce(y)
        y = reduce(np.matmul(self.columns, x.reshape(-1, self.b, self.a)))
        y *= self.twiddle
        y = reduce(np.matmul(reduce(y), self.rows))
        return np.ascontiguousarray(y.transpose(0, 2, 1)).reshape(len(x), -1)


class Convolution:
    """Zero-mismatch places of blocks of ``size`` words in the two blocks after some other."""

    def __init__(self, size: int):
        n = 2 * size
        self.size, self.forward, self.back = size, Transform(n), Transform(n, inverse=True)
        # moving a block by half the transform's length is a change of sign at odd frequencies
        self.sign = np.where(np.arange(n) % 2, -1.0, 1.0)
        self.mirror = -np.arange(n) % n
        self.scale = float(pow(n, -1, P))

    def transforms(self, blocks: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(blocks), 2 * self.size))
        wide[:, : self.size] = blocks
        return self.forward(wide)

    def zeros(self, values, squares, spectra, block, first) -> tuple[np.ndarray, np.ndarray]:
        """(row, lag): ``block[row]`` occurs ``lag`` words after the start of ``first[row]``, lags
        below the size of a block. ``squares``: the sums of squares of each block's beginnings."""
        size = self.size
        window = spectra[first] + self.sign * spectra[first + 1]
        product = reduce(reduce(window) * spectra[block][:, self.mirror])
        cross = self.back(product)[:, :size]
        # squares under the block at each lag: the rest of one block and the beginning of the next
        under = squares[first, -1:] - squares[first, :-1] + squares[first + 1, :-1]
        difference = squares[block, -1:] + under - 2 * reduce(cross * self.scale)
        return np.nonzero(reduce(difference) == 0)


def seeds(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, scale: int, tools: dict[int, Convolution]):
    """(place, distance) of blocks at multiples of ``scale`` in texts x[start: start + size] that
    occur again at a distance of the scale; texts must be as long as one block and a distance."""
    size = min(scale, BLOCK)
    tool = tools.setdefault(size, Convolution(size))
    per = scale // size
    # whole blocks of each text, and one block after its last word (no word is like another there)
    n_blocks = sizes // size
    at = np.repeat(starts, n_blocks + 2) + ragged(np.zeros(len(sizes), np.int64), n_blocks + 2) * size
    index = np.minimum(at[:, None] + np.arange(size), len(x) - 1)
    ends = np.repeat(starts + sizes, n_blocks + 2)
    values = np.where(index < ends[:, None], x[index] % P, 0).astype(np.float64)
    squares = np.zeros((len(values), size + 1))
    np.cumsum(reduce(values * values), axis=1, out=squares[:, 1:])
    spectra = np.concatenate([tool.transforms(values[i:i + ROWS]) for i in range(0, len(values), ROWS)])
    base = np.cumsum(n_blocks + 2) - (n_blocks + 2)
    # blocks at multiples of the scale, each with the first blocks of its windows
    n_own = np.maximum(0, (sizes - size - scale) // scale + 1)
    own = np.repeat(base, n_own) + ragged(np.zeros(len(n_own), np.int64), n_own) * per
    last = np.repeat(base + n_blocks, n_own)
    offsets = np.arange(0 if scale == FIRST else per, 2 * per)
    block, first = np.repeat(own, len(offsets)), (own[:, None] + offsets).ravel()
    inside = first <= np.repeat(last, len(offsets)) - 1
    block, first = block[inside], first[inside]
    place, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(block), ROWS):
        b, f = block[i:i + ROWS], first[i:i + ROWS]
        row, lag = tool.zeros(values, squares, spectra, b, f)
        place.append(at[b[row]])
        distance.append(at[f[row]] - at[b[row]] + lag)
    place, distance = np.concatenate(place), np.concatenate(distance)
    true = distance > 0
    return place[true], distance[true]


def extend(x: np.ndarray, place: np.ndarray, distance: np.ndarray, step: int, limit: int) -> np.ndarray:
    """How far beyond ``place`` (in direction ``step``, ``place`` itself included) words are equal
    to those ``distance`` after them, up to ``limit`` words."""
    reach, todo, width = np.zeros(len(place), np.int64), np.arange(len(place)), 8
    while len(todo):
        i = place[todo, None] + step * (reach[todo, None] + np.arange(width))
        differ = x[np.clip(i, 0, len(x) - 1)] != x[np.clip(i + distance[todo, None], 0, len(x) - 1)]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        reach[todo] += first
        todo = todo[(first == width) & (reach[todo] < limit)]
        width = max(8, min(2 * width, (1 << 20) // max(len(todo), 1)))
    return reach


def find_runs(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tools: dict[int, Convolution]) -> np.ndarray:
    """(start, length, period) of the runs of all texts x[start: start + size], sorted. Between
    texts, before the first and after the last, ``x`` must hold numbers that occur once."""
    found = np.zeros((0, 3), np.int64)
    scale = FIRST
    # at the first scale a distance may be as little as one word
    while (use := sizes >= max(MIN_WORDS, MIN_EXPONENT * scale if scale > FIRST else 0)).any():
        block = min(scale, BLOCK)
        place, distance = seeds(x, starts[use], sizes[use], scale, tools)
        short = found[found[:, 2] <= block]
        if len(short) and len(place):
            # the furthest end of the known runs that start at or before a place
            ends = np.maximum.accumulate(short[:, 0] + short[:, 1])
            k = np.searchsorted(short[:, 0], place, "right") - 1
            new = (k < 0) | (ends[k] < place + block + distance)
            place, distance = place[new], distance[new]
        if len(place):
            # words beyond the next block of the scale are its own seed's
            right = extend(x, place, distance, 1, scale + 2 * block)
            true = right >= block
            place, distance, right = place[true], distance[true], right[true]
        if len(place):
            left = extend(x, place - 1, distance, -1, scale + block)
            order = np.lexsort((place, distance))
            u, v, d = (place - left)[order], (place + right)[order], distance[order]
            # stretches of one distance that overlap are parts of one
            reach = np.maximum.accumulate(v + d * (len(x) + 1)) - d * (len(x) + 1)
            fresh = np.concatenate(([True], (d[1:] != d[:-1]) | (u[1:] > reach[:-1])))
            at = np.flatnonzero(fresh)
            u, v, d = np.minimum.reduceat(u, at), np.maximum.reduceat(v, at), d[at]
            length = v - u + d
            good = length >= np.maximum(MIN_WORDS, MIN_EXPONENT * d)
            found = np.concatenate((found, np.stack((u[good], length[good], d[good]), axis=1)))
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            # the same stretch at a multiple of its period
            found = found[np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(axis=1)))] if len(found) else found
        scale *= 2
    return found[np.lexsort((found[:, 2], found[:, 0]))]


class Finder:
    """Words and runs of texts, batch by batch; keeps the transforms' tables."""

    def __init__(self):
        self.tools: dict[int, Convolution] = {}

    def __call__(self, lists: list[list[bytes]]) -> list[np.ndarray]:
        """For each list of words its runs: rows (start, length, period) by start, then period."""
        number = {w: i for i, w in enumerate(set(chain.from_iterable(lists)), 1)}
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        starts = np.cumsum(sizes + 1) - sizes
        x = np.arange(len(number) + 1, len(number) + 1 + int(sizes.sum()) + len(lists) + 1, dtype=np.int64)
        x[ragged(starts, sizes)] = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
        out = find_runs(x, starts, sizes, self.tools)
        owner = np.searchsorted(starts, out[:, 0], "right") - 1
        out[:, 0] -= starts[owner]
        cuts = np.searchsorted(owner, np.arange(len(lists) + 1))
        return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The words as the contract of the query has them: of every tenth checksum of an id the end
    of the text repeats itself."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words of no run or of the first period of every run that holds them."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prepare=None) -> DataFrame:
    """(doc_id, runs, collapsed) of every whole text: its runs by start, then period, and its kept
    words joined by blanks. ``prepare(words, doc_id)``, if given, makes the words to look at."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])

    def work(batches):
        finder = Finder()
        for b in batches:
            texts, ids = [(t or "").encode() for t in b.column("text").to_pylist()], b.column("doc_id").to_pylist()
            for at, to in runs([len(t) for t in texts], TEXT_BYTES):
                # white space of bytes is just 20 and 09 to 0D
                lists = [t.split() for t in texts[at:to]]
                if prepare:
                    lists = [prepare(w, i) for w, i in zip(lists, ids[at:to], strict=True)]
                found = finder(lists)
                sizes = np.concatenate(([0], np.cumsum([len(f) for f in found])))
                flat = np.concatenate(found)
                entries = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], names=RUN.names)
                kept = [b" ".join(collapsed(w, f)).decode() for w, f in zip(lists, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[at:to], pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), entries), pa.array(kept, pa.string())],
                    names=schema.names)

    return rows.mapInArrow(work, schema)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = periodic_runs(docs, prepare=planted)
    # the exponent length / period is compared exactly, as a product of whole numbers
    by_exponent = lambda a, x: F.when(
        a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast(RUN), by_exponent)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                                 r["period"].cast("string"), F.lit("\n"))), "")
    rows = rows.withColumn("best", best)
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                       F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
