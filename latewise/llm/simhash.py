"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has bit i set if over half of its shingles' XXH64 values have it.
Texts whose fingerprints differ in at most ``max_bits`` bits are linked, and a component is
what links reach.

Equal fingerprints are one class, so copies cost one row. ``max_bits + 1`` rotations put each
block of bits in front in turn: codes within the distance agree on one whole block, so each
rotation's trie starts at the nodes of its first block, which are dealt to the tasks. In a
task, pairs of nodes are taken down the trie together; a pair of unlike branches costs an
error, a pair over the budget goes, and so does a pair of nodes whose codes are in one
component already. A task returns a star per component that it found, never all pairs, and
the stars are united by alternating large-star and small-star joins.

Null texts count as empty. A text without words has fingerprint zero and is linked like any
other. Repeated rows are kept, each with the component of its fingerprint; a component whose
ids are all null has a null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from latewise.llm.common import id_batch, partitions_for, ragged, small_batches, staged

#: Seed of the shingles' hash: a fixed value of the operator's contract.
SEED = 42
#: Codes of a task (its rotations together).
CODES_EACH = 500_000
#: Node pairs, or code pairs, that a task looks at together.
FRONTIER = 1 << 18
#: Pairs of nodes with so few pairs of codes are compared code by code.
LEAF = 32


def text_code(text: str | None, shingle: int) -> int:
    """The fingerprint of one text as a signed 64-bit value."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    line = b" ".join(words)
    counts, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 14):
        to = min(n, at + (1 << 14))
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in
                           zip(starts[at:to].tolist(), ends[at + k - 1: to + k - 1].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, code): the fingerprint of every whole text as a long."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("code", LongType())])

    def encode(batches):
        for b in batches:
            codes = pa.array([text_code(t.as_py(), shingle) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), codes], names=["doc_id", "code"])

    return rows.mapInArrow(encode, schema)


def _children(codes, lo, hi, depth):
    """Where the nodes [lo, hi) at ``depth`` split: the first code whose next bit is set."""
    bit = np.uint64(1) << (np.uint64(63) - depth)
    first = (codes[lo] & ~((bit << np.uint64(1)) - np.uint64(1))) | bit
    return np.clip(np.searchsorted(codes, first), lo, hi)


def _unite(label, i, j):
    """Unite the components of i and j; every label is the smallest index it reaches."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def trie_components(codes: np.ndarray, start_bits: int, max_bits: int) -> np.ndarray:
    """Labels of sorted distinct codes: those within ``max_bits`` that share the first
    ``start_bits`` bits, and all they reach, have the same label."""
    n = len(codes)
    label = np.arange(n)
    if n < 2:
        return label
    top = codes >> np.uint64(64 - start_bits)
    lo = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    hi = np.append(lo[1:], n)
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    # a node pair: two ranges of codes, the bits they share, the errors so far
    stack = [np.stack([lo, hi, lo, hi, np.full(len(lo), start_bits), np.zeros(len(lo), np.int64)])] if len(lo) else []
    while stack:
        f = stack.pop()
        if f.shape[1] > FRONTIER:
            stack += [f[:, FRONTIER:]]
            f = f[:, :FRONTIER]
        # nodes that lie in one component together have nothing to add
        change = np.append(np.flatnonzero(label[1:] != label[:-1]) + 1, n)
        whole = (change[np.searchsorted(change, f[0], "right")] >= f[1]) & (change[np.searchsorted(change, f[2], "right")] >= f[3])
        f = f[:, ~(whole & (label[f[0]] == label[f[2]]))]
        size_a, size_b = f[1] - f[0], f[3] - f[2]
        leaf = (size_a * size_b <= LEAF) | (f[4] >= 64)
        for at, to in _blocks((size_a * size_b)[leaf]):
            a, b, c, d = f[:4, leaf][:, at:to]
            left = ragged(a, b - a)
            width = np.repeat(d - c, b - a)
            i, j = np.repeat(left, width), ragged(np.repeat(c, b - a), width)
            near = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= max_bits)
            label = _unite(label, i[near], j[near])
        f = f[:, ~leaf]
        if not f.shape[1]:
            continue
        depth = f[4].astype(np.uint64)
        mid_a, mid_b = _children(codes, f[0], f[1], depth), _children(codes, f[2], f[3], depth)
        same, deep = f[0] == f[2], f[4] + 1
        pairs = [np.stack([f[0], mid_a, f[2], mid_b, deep, f[5]]), np.stack([mid_a, f[1], mid_b, f[3], deep, f[5]]),
                 np.stack([f[0], mid_a, mid_b, f[3], deep, f[5] + 1]),
                 np.stack([mid_a, f[1], f[2], mid_b, deep, f[5] + 1])[:, ~same]]
        f = np.concatenate(pairs, axis=1)
        f = f[:, (f[1] > f[0]) & (f[3] > f[2]) & (f[5] <= max_bits) & ~((f[0] == f[2]) & (f[1] - f[0] == 1))]
        if f.shape[1]:
            stack.append(f)
    return label


def _blocks(weights):
    """Ranges of items of at most FRONTIER pairs."""
    total = np.cumsum(weights)
    at = 0
    while at < len(weights):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + FRONTIER, "right")))
        yield at, to
        at = to


def _rotate(codes: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return codes if not by else (codes << np.uint64(by)) | (codes >> np.uint64(64 - by))


def stars(codes: DataFrame, n_codes: int, max_bits: int) -> DataFrame:
    """(a, b): links between distinct codes (column ``code``) that span every component of
    the codes that share a block."""
    spark = codes.sparkSession
    bounds = [64 * i // (max_bits + 1) for i in range(max_bits + 2)]
    blocks = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft("code", at), 64 - (to - at)).alias("key"))
              for i, (at, to) in enumerate(zip(bounds, bounds[1:], strict=False))]
    n = partitions_for(spark, n_codes * len(blocks), CODES_EACH)
    dealt = (codes.select("code", F.explode(F.array(*blocks)).alias("at"))
             .select("code", "at.block", "at.key").repartition(n, "block", "key").select("code", "block"))
    schema = "a long, b long"

    def join(batches):
        parts = [(b.column("code").to_numpy(), b.column("block").to_numpy()) for b in batches]
        if not parts:
            return
        all_codes, block = (np.concatenate(x) for x in zip(*parts, strict=True))
        for i, (at, to) in enumerate(zip(bounds, bounds[1:], strict=False)):
            own = np.sort(_rotate(all_codes[block == i].view(np.uint64), at))
            label = trie_components(own, to - at, max_bits)
            linked = np.flatnonzero(label != np.arange(len(own)))
            back = _rotate(own, 64 - at).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(back[linked]), pa.array(back[label[linked]])], names=["a", "b"])

    return dealt.mapInArrow(join, schema)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches. Alternating large-star
    and small-star joins; every round is written to the shared folder, none is collected."""
    now = staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now, before = staged(after, "links"), mark
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, code, root, component_id) of every row: its fingerprint, the smallest code
    that it reaches, and the smallest doc_id of that component."""
    prints = staged(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    classes = staged(prints.groupBy("code").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(stars(classes.select("code"), classes.count(), max_bits))
    classes = classes.join(roots, classes["code"] == roots["node"], "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(classes.select("code", "root").join(least, "root"), "code").select("doc_id", "code", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` without near-duplicates: of each component one row stays, that with the smallest
    doc_id (null after all others, rows of one id by a digest of their texts). All columns are
    kept. A row is known by its id and that digest, so rows that share an id, or have none, are
    told apart; equal ones are one component."""
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    rows = docs.withColumn("__row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("digest")))
    found = near_duplicates(rows, shingle, max_bits, "__row").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    counts = staged(found.groupBy(F.col("doc_id").alias("__kept")).count(), "kept")
    once, again = counts.where("count = 1").select("__kept"), counts.where("count > 1").select("__kept")
    kept = rows.join(once, rows["__row"].eqNullSafe(once["__kept"]), "left_semi")
    if not again.isEmpty():
        kept = kept.unionByName(rows.join(again, rows["__row"].eqNullSafe(again["__kept"]), "left_semi").dropDuplicates(["__row"]))
    return kept.drop("__row")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
