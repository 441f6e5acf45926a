"""Exact substring dedup with a logarithmic family of suffix arrays.

Every byte goes that is covered by a string of ``length`` bytes which also starts earlier (in a
document with a smaller id, or earlier in the same one). Texts are UTF-8 bytes; matches stay
inside documents, may overlap, and are judged on the input.

Where suffixes meet. A window of ``length`` bytes has an anchor: its ``gram``-byte substring
with the least hash (the leftmost of equals). Equal windows have equal anchors at equal places,
so it is enough to compare windows of one anchor. Consecutive windows with one anchor form a
fragment (about one for 35 bytes of text); only its hashes travel, and of fragments alike in a
batch only the first does, so a passage held by a third of all documents costs one row a batch.
Fragments alike are one class: all but its first member are repeats. An anchor with one class is
done.

Suffix arrays. The first members of the classes of an anchor that has several meet as bytes, in
the order of the documents. Each batch gets a suffix array of its windows (sorted starts,
compared on ``length`` bytes), is scanned against its own neighbours and, by merge, against the
levels of the index built so far, and then enters the index as a new level; levels of like size
merge, so there are logarithmically many. An anchor with over ``HOT`` classes (a common line
between ever other neighbours) is anchored anew with ``gram = length``, which parts its windows
among all tasks, and equal windows are one class. Anchors that hold over a millionth of all
fragments, by a sample of the documents, are so from the start, so no task meets all of one.

Cases: a null text counts as empty; texts under ``length`` bytes have nothing to remove; equal
rows (same id and text) are one document twice and get the same result; rows of one id with
different texts, and rows with null ids (which come last), are ordered by a hash of the text;
an empty table gives an empty result. Cut texts are decoded without the parts of characters
that a cut left over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewise.llm.common import _BYTE, _powers, mix, partitions_for, ragged, runs, small_batches, staged, text_bytes

#: Bytes of an anchor in the first round.
GRAM = 32
#: Classes of an anchor from which its windows are dealt out one by one.
HOT = 512
#: One document in SAMPLE (by a hash of its id) shows which anchors are hot from the start: those
#: of LEAST sampled classes at least, and of so large a share that there are at most MOST.
SAMPLE, LEAST, MOST = 64, 64, 1_000_000
#: Bytes of text that are hashed together; positions in them fit POS_BITS.
CHUNK, POS_BITS = 1 << 20, np.uint64(21)
#: Bytes of text behind one partition of fragments, and windows behind one of suffix arrays.
TEXT_EACH, WINDOWS_EACH = 16 << 20, 250_000
#: Windows of a batch of the suffix index.
BATCH = 32_768

FRAGMENTS = "kind int, anchor long, class long, d long, sub long, start long, n int, bytes binary"
FOUND = "kind int, anchor long, d long, sub long, start long, n int"
#: kinds of rows: bytes to remove, first member of a class to compare, the same of a hot anchor
REMOVE, COMPARE, COMPARE_HOT = 0, 1, 2


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size:]) if width > size else v


def fragments(data: np.ndarray, ok: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, class) of the fragments of a buffer. ``ok``: whether a window
    may start at a byte (it must not leave its document)."""
    empty = np.zeros(0, np.int64)
    if len(data) < length or not ok.any():
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])
    low = (np.uint64(1) << POS_BITS) - np.uint64(1)
    at = (_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
    ok = ok[: len(at)]
    before = np.concatenate(([-1], np.where(ok, at, -1)[:-1]))
    start = np.flatnonzero(ok & (at != before))
    last = np.flatnonzero(ok & np.append(at[1:] != at[:-1], True) | ok & ~np.append(ok[1:], False))
    n = last - start + 1
    anchor = grams[at[start]]
    end = start + n + length - 1
    own = mix((total[end] - total[start]) * down[start] + n.astype(np.uint64) + (at[start] - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return start, n, anchor, own


def _chunks(texts: list[bytes], length: int):
    """(buffer, ok, document, offset) of about CHUNK bytes each: the bytes of several texts, or
    part of a long one with the bytes that its last windows need; document and offset say where
    each byte of the buffer comes from."""
    parts = [(i, at, min(len(t), at + CHUNK + length - 1)) for i, t in enumerate(texts) for at in range(0, max(0, len(t) - length + 1), CHUNK)]
    for a, b in runs([to - at for _, at, to in parts], CHUNK + length):
        own = parts[a:b]
        size = np.array([to - at for _, at, to in own])
        data = np.frombuffer(b"".join(texts[i][at:to] for i, at, to in own), np.uint8)
        ok = np.ones(len(data), bool)
        ends = np.cumsum(size)
        for e in range(1, length):
            ok[ends - e] = False
        yield data, ok, np.repeat([i for i, _, _ in own], size), np.arange(len(data)) - np.repeat(ends - size - np.array([at for _, at, _ in own]), size)


def _first(order_keys, same_keys):
    """Sort by same_keys then order_keys: the order, whether a row begins a group, and whether it
    is a repeat (a later place than the first of its group)."""
    order = np.lexsort((*order_keys[::-1], *same_keys[::-1]))
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in same_keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    repeat = np.zeros(len(order), bool)
    for k in order_keys:
        k = k[order]
        repeat |= k != k[head]
    return order, new, repeat


def _joined(start, end, *keys):
    """Spans sorted by their keys and start, those that touch made one."""
    order = np.lexsort((start, *keys[::-1]))
    start, end, keys = start[order], end[order], [k[order] for k in keys]
    if not len(start):
        return start, end, *keys
    other = np.zeros(len(start), bool)
    other[0] = True
    for k in keys:
        other[1:] |= k[1:] != k[:-1]
    group = np.cumsum(other) - 1
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * wide)
    new = other.copy()
    new[1:] |= start[1:] + group[1:] * wide > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], np.maximum.reduceat(end, first), *(k[first] for k in keys)


def _rows(kind, anchor, own, d, sub, start, n, data=None):
    size = len(d)
    whole = lambda x, t: pa.array(np.broadcast_to(x, size), t)
    signed = lambda x: pa.array(np.broadcast_to(x, size).astype(np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [whole(kind, pa.int32()), signed(anchor), signed(own), whole(d, pa.int64()), whole(sub, pa.int64()), whole(start, pa.int64()),
         pa.array(np.asarray(n), pa.int32()), pa.array([None] * size if data is None else data, pa.binary())],
        names=["kind", "anchor", "class", "d", "sub", "start", "n", "bytes"])


def _once(length, parts):
    """The rows of hashed fragments: of fragments alike the first, and the others' spans."""
    doc, sub, start, n, anchor, own = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, new, repeat = _first((doc, sub, start), (anchor, own))
    keep, gone = order[new], order[repeat]
    yield _rows(COMPARE, anchor[keep], own[keep], doc[keep], sub[keep], start[keep], n[keep])
    s, e, d, u = _joined(start[gone], start[gone] + n[gone] + length - 1, doc[gone], sub[gone])
    yield _rows(REMOVE, mix(d.astype(np.uint64)), 0, d, u, s, e - s)


def _hash_texts(length: int, gram: int, hot=None):
    """Documents to rows of FRAGMENTS; the windows of ``hot`` anchors (a broadcast, sorted) go
    one by one."""

    def work(batches):
        known = hot.value if hot is not None else np.zeros(0, np.uint64)
        for b in batches:
            texts = [t or b"" for t in b.column("bytes").to_pylist()]
            d, sub = (b.column(c).to_numpy(zero_copy_only=False) for c in ("d", "sub"))
            parts = []
            for data, ok, doc, offset in _chunks(texts, length):
                start, n, anchor, own = fragments(data, ok, gram, length)
                if len(known) and len(anchor):
                    apart = known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor
                    if apart.any():
                        single = np.zeros(len(data), bool)
                        single[ragged(start[apart], n[apart])] = True
                        alone = fragments(data, single, length, length)
                        start, n, anchor, own = (np.concatenate((x[~apart], y)) for x, y in zip((start, n, anchor, own), alone, strict=True))
                parts.append((d[doc[start]], sub[doc[start]], offset[start], n, anchor, own))
            if parts:
                yield from _once(length, parts)

    return work


def _cut_texts(length: int):
    """Documents with the fragments asked of them (``asked``: kind, anchor, start, n) to rows of
    FRAGMENTS: bytes, or for hot anchors the hashes of single windows."""

    def work(batches):
        for b in batches:
            d, sub = (b.column(c).to_numpy(zero_copy_only=False) for c in ("d", "sub"))
            rows, parts = [], []
            for i, (text, asked) in enumerate(zip(b.column("bytes").to_pylist(), b.column("asked").to_pylist(), strict=True)):
                data = None
                for x in asked:
                    piece = text[x["start"]: x["start"] + x["n"] + length - 1]
                    if x["kind"] == COMPARE:
                        rows.append((x["anchor"], d[i], sub[i], x["start"], x["n"], piece))
                    else:
                        data = np.frombuffer(piece, np.uint8)
                        ok = np.arange(len(data)) < x["n"]
                        start, n, anchor, own = fragments(data, ok, length, length)
                        parts.append((np.full(len(n), d[i]), np.full(len(n), sub[i]), start + x["start"], n, anchor, own))
            for at in range(0, len(rows), 1 << 16):
                anchor, doc, s, start, n, piece = (list(x) for x in zip(*rows[at: at + (1 << 16)], strict=True))
                yield _rows(COMPARE_HOT, np.array(anchor, np.int64).view(np.uint64), 0, np.array(doc), np.array(s), np.array(start), n, piece)
            if parts:
                yield from _once(length, parts)

    return work


class SuffixLevels:
    """The index: levels of sorted distinct windows, each over twice the size of the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, windows: np.ndarray) -> np.ndarray:
        """Add a batch of windows in the order of their places; whether each one is a repeat."""
        order = np.argsort(windows, kind="stable")  # the batch's suffix array
        run = windows[order]
        repeat = np.zeros(len(run), bool)
        repeat[1:] = run[1:] == run[:-1]
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, run), len(level) - 1)
            repeat |= level[at] == run
        out = np.zeros(len(run), bool)
        out[order] = repeat
        new = run[~repeat]
        while len(self.levels) and len(self.levels[-1]) <= 2 * len(new):
            new = np.sort(np.concatenate((self.levels.pop(), new)), kind="stable")
        if len(new):
            self.levels.append(new)
        return out


def _compare_bytes(length, anchor, d, sub, start, n, data):
    """Spans of repeats among fragments given as bytes."""
    order = np.lexsort((start, sub, d))
    index, found = SuffixLevels(), []
    for a, b in runs(n[order].tolist(), BATCH):
        own = order[a:b]
        pieces = [data[i] for i in own]
        buffer = np.frombuffer(b"".join(pieces), np.uint8)
        size = n[own] + length - 1
        at = ragged(np.cumsum(size) - size, n[own])
        windows = np.lib.stride_tricks.sliding_window_view(buffer, length)[at].view(f"S{length}")[:, 0]
        repeat = index.add(windows)
        which, place = np.repeat(own, n[own])[repeat], ragged(start[own], n[own])[repeat]
        found.append((place, place + length, d[which], sub[which]))
    return _joined(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _meet(length: int):
    """Rows of FRAGMENTS that share anchors to rows of FOUND."""

    def out(kind, anchor, d, sub, start, n):
        row = _rows(kind, anchor, 0, d, sub, start, n)
        return row.select(["kind", "anchor", "d", "sub", "start", "n"])

    def work(batches):
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        kind, anchor, own, d, sub, start, n = (table.column(c).to_numpy() for c in table.column_names[:-1])
        done = kind == REMOVE
        yield out(REMOVE, 0, d[done], sub[done], start[done], n[done])
        i = np.flatnonzero(kind == COMPARE)
        order, new, repeat = _first((d[i], sub[i], start[i]), (anchor[i], own[i]))
        gone, first = i[order[repeat]], i[order[new]]
        yield out(REMOVE, 0, d[gone], sub[gone], start[gone], n[gone] + length - 1)
        # classes of an anchor are neighbours now
        head = np.flatnonzero(np.concatenate(([True], anchor[first][1:] != anchor[first][:-1]))) if len(first) else first
        classes = np.diff(np.append(head, len(first)))
        classes = np.repeat(classes, classes)
        for what, those in ((COMPARE, (classes > 1) & (classes <= HOT)), (COMPARE_HOT, classes > HOT)):
            f = first[those]
            yield out(what, anchor[f].view(np.uint64), d[f], sub[f], start[f], n[f])
        i = np.flatnonzero(kind == COMPARE_HOT)
        if len(i):
            s, e, d, sub = _compare_bytes(length, anchor[i], d[i], sub[i], start[i], n[i].astype(np.int64), table.column("bytes").take(pa.array(i)).to_pylist())
            yield out(REMOVE, 0, d, sub, s, e - s)

    return work


def _hot_anchors(docs: DataFrame, length: int) -> np.ndarray:
    """Sorted hashes of the anchors with the most classes in a sample; at most MOST of them."""
    sampled = docs.where(F.pmod(F.xxhash64("d", "sub"), F.lit(SAMPLE)) == 0).mapInArrow(_hash_texts(length, min(GRAM, length)), FRAGMENTS)
    counts = staged(sampled.where(F.col("kind") == COMPARE).groupBy("anchor").agg(F.count("*").alias("classes")).where(F.col("classes") >= LEAST), "hot")
    total = counts.agg(F.sum("classes")).first()[0] or 0
    found = counts.where(F.col("classes") > total / MOST).select("anchor").toArrow()["anchor"].to_numpy()
    return np.sort(found.view(np.uint64) if len(found) else np.zeros(0, np.uint64))


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(d, sub, start, n): spans to remove, of documents given as (d, sub, bytes)."""
    spark = docs.sparkSession
    small_batches(spark)
    size = text_bytes(docs, "bytes")
    n = partitions_for(spark, size, TEXT_EACH)
    long_enough = docs.where(F.length("bytes") >= length)
    hot = spark.sparkContext.broadcast(_hot_anchors(long_enough, length))
    rows = long_enough.mapInArrow(_hash_texts(length, min(GRAM, length), hot), FRAGMENTS)
    first = staged(rows.repartition(n, "anchor").mapInArrow(_meet(length), FOUND), "fragments")
    open_ = first.where(F.col("kind") != REMOVE)
    windows = open_.agg(F.sum("n")).first()[0] or 0
    spans = first.where(F.col("kind") == REMOVE).select("d", "sub", "start", "n")
    if not windows:
        return spans
    asked = open_.groupBy("d", "sub").agg(F.collect_list(F.struct("kind", "anchor", "start", "n")).alias("asked"))
    cut = docs.join(asked, ["d", "sub"]).mapInArrow(_cut_texts(length), FRAGMENTS)
    second = cut.repartition(partitions_for(spark, windows, WINDOWS_EACH), "anchor").mapInArrow(_meet(length), FOUND)
    return spans.unionByName(second.select("d", "sub", "start", "n"))


def _removed(columns, as_text):
    """Rows with ``__spans`` (start, n) to rows with joined spans and what stays of the text."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        for b in batches:
            texts = [t or b"" for t in b.column("__text").cast(pa.binary()).to_pylist()]
            spans, kept = [], []
            for text, own in zip(texts, b.column("__spans").to_pylist(), strict=True):
                s, e = np.zeros((2, 0), np.int64)
                if own:
                    s = np.array([x["start"] for x in own])
                    s, e, _ = _joined(s, s + np.array([x["n"] for x in own]), np.zeros(len(own), np.int64))
                edges = [0, *np.stack((s, e), 1).ravel().tolist(), len(text)]
                rest = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                spans.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in columns), pa.array(map(len, texts), pa.int64()), pa.array(spans, span), pa.array(kept, pa.string() if as_text else pa.binary())],
                names=[*columns, "__n_bytes", "__spans", "__kept"])

    return work


def cleaned(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them) with ``__n_bytes`` (of the text),
    ``__spans`` (start, end of the maximal removed runs) and ``__kept`` (the bytes that stay, or
    ``as_text`` their whole characters)."""
    keep = docs.columns if keep is None else keep
    ids = docs.agg(F.count("*"), F.count_distinct(doc_id)).first()
    clash = ids[0] != ids[1]
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))
    sub = F.xxhash64(data) if clash else F.lit(0).cast("long")
    found = repeats(docs.select(d.alias("d"), sub.alias("sub"), data.alias("bytes")), length)
    spans = found.groupBy("d", "sub").agg(F.collect_list(F.struct("start", "n")).alias("__spans")).withColumnsRenamed({"d": "__d", "sub": "__sub"})
    joined = docs.join(spans, (d == F.col("__d")) & (sub == F.col("__sub")), "left").select(*keep, F.col(text).alias("__text"), "__spans")
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")))
    schema = docs.select(*keep, F.lit(0).cast("long").alias("__n_bytes"), span.alias("__spans"), F.lit("" if as_text else b"").alias("__kept")).schema
    return joined.mapInArrow(_removed(keep, as_text), schema)


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with the repeats cut from their texts; a row of whose text nothing stays goes.
    All columns are kept; n_chars, if there, is counted anew where a text was cut."""
    cut = F.size("__spans") > 0
    found = cleaned(docs, length, as_text=True).where(~cut | (F.length("__kept") > 0))
    new = {"text": F.when(cut, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(*docs.columns)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    gone = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", F.col("__n_bytes").alias("n_bytes"), gone.alias("n_removed"),
                        F.size("__spans").cast("long").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))
