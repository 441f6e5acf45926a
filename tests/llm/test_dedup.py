"""SimHash and suffix-array dedup against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from latewise.llm import simhash, suffix

from .conftest import LONG, ROWS, SHARED, words


def plain_code(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i: i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(codes):
    left, label = set(codes), {}
    while left:
        todo = [left.pop()]
        seen = list(todo)
        while todo:
            c = todo.pop()
            near = [x for x in left if (x ^ c).bit_count() <= 3]
            left.difference_update(near)
            todo += near
            seen += near
        for c in seen:
            label[c] = seen[0]
    return label


def check_components(rows, got):
    codes = [plain_code(t) for _, t in rows]
    label = plain_components(codes)
    least = {}
    for (i, _), c in zip(rows, codes, strict=True):
        if i is not None:
            least[label[c]] = min(i, least.get(label[c], i))
    want = sorted(((i, f"{c:016x}", least.get(label[c])) for (i, _), c in zip(rows, codes, strict=True)), key=str)
    assert sorted(got, key=str) == want


def found(df):
    out = simhash.near_duplicates(df)
    return [tuple(r) for r in out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")), "component_id").collect()]


def test_simhash_odd_rows(odd, empty):
    check_components([r[:2] for r in ROWS], found(odd))
    assert found(empty) == []


def test_simhash_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_components([tuple(r) for r in docs.select("doc_id", "text").collect()], found(docs))


def test_trie_finds_every_link_in_a_ball():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for flips in (1, 2, 3, 4):
        more = codes[:200].copy()
        for _ in range(flips):
            more ^= np.uint64(1) << rng.integers(0, 64, len(more)).astype(np.uint64)
        codes = np.concatenate((codes, more))
    ball = np.full(800, codes[0])
    for _ in range(4):
        ball ^= np.uint64(1) << rng.integers(0, 64, len(ball)).astype(np.uint64)
    codes = np.unique(np.concatenate((codes, ball)))
    label = np.arange(len(codes))
    for at in range(0, 64, 16):
        turned = simhash._rotate(codes, at)
        order = np.argsort(turned)
        label = simhash._unite(label, order, order[simhash.trie_components(turned[order], 16, 3)])
    want = plain_components([int(c) for c in codes])
    groups = {}
    for c, x in zip(codes, label, strict=True):
        groups.setdefault(x, set()).add(want[int(c)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_keep_one(odd):
    kept = simhash.keep_one(odd).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(18) == 1 and 4 in ids and 5 not in ids and 1 in ids and 2 not in ids
    assert kept[0].asDict().keys() == odd.first().asDict().keys()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    roots = dict(simhash.components(links).collect())
    assert roots == {i: 0 for i in range(1, 61)} | {101: 100}


def plain_repeats(rows, length):
    """(bytes, removed flags) of documents in order."""
    seen, out = {}, []
    for key, data in rows:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i: i + length]
            if seen.setdefault(w, (key, i)) != (key, i):
                gone[i: i + length] = b"\1" * length
        out.append((data, gone))
    return out


def digest(data, gone):
    kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
    spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
    return len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def digests(df, length=100):
    gone = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    out = suffix.cleaned(df, length, keep=["doc_id"])
    return [tuple(r) for r in out.select("doc_id", "__n_bytes", gone, F.size("__spans"), F.sha2("__kept", 256)).collect()]


def test_suffix_odd_rows(odd, empty):
    rows = sorted(((i is None, i or 0), (t or "").encode()) for i, t, *_ in ROWS)
    want = sorted(((None if k[0] else k[1]), *digest(d, g)) for (k, _), (d, g) in zip(rows, plain_repeats(rows, 100), strict=True) if not k[0])
    got = digests(odd)
    assert sorted(r for r in got if r[0] is not None) == want
    assert digests(empty) == []


@pytest.mark.parametrize(("hot", "sampled"), [(2, 64), (2048, 64), (2048, 1)])
def test_suffix_hot_anchors_and_short_lengths(spark, hot, sampled, monkeypatch):
    line = words(14, 77)
    rows = [(i, f"{words(9, i)} {line} {words(12, 500 + i % 7)} {line[:60]} {words(5, i % 3)}") for i in range(60)]
    rows += [(100 + i, SHARED[i * 3: 240 + i]) for i in range(20)] + [(200, LONG[:5000]), (201, LONG[2000:7000]), (202, "é" * 400)]
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SAMPLE", sampled)
    monkeypatch.setattr(suffix, "LEAST", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (100, 40):
        plain = [(i, t.encode()) for i, t in rows]
        want = sorted((i, *digest(d, g)) for (i, _), (d, g) in zip(plain, plain_repeats(plain, length), strict=True))
        assert sorted(digests(df, length)) == want
        data = df.select(F.col("doc_id").alias("d"), F.lit(0).cast("long").alias("sub"), F.col("text").cast("binary").alias("bytes"))
        assert len(suffix._hot_anchors(data, length)) > 0 or sampled > 1


def test_suffix_text_longer_than_a_chunk(spark):
    text = words(140_000, 31) + SHARED + words(500, 32) + SHARED
    assert len(text) > suffix.CHUNK
    rows = [(1, text), (2, SHARED + words(40, 33))]
    plain = [(i, t.encode()) for i, t in rows]
    want = sorted((i, *digest(d, g)) for (i, _), (d, g) in zip(plain, plain_repeats(plain, 100), strict=True))
    assert sorted(digests(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_levels_are_logarithmic():
    index = suffix.SuffixLevels()
    rng = np.random.default_rng(1)
    for _ in range(64):
        index.add(rng.integers(0, 256, (50, 100)).astype(np.uint8).view("S100")[:, 0])
    assert len(index.levels) <= 8 and sum(map(len, index.levels)) == 64 * 50


def test_cut_texts_keep_columns(odd):
    out = {r.doc_id: r for r in suffix.without_repeats(odd).where("doc_id is not null").collect()}
    assert SHARED in out[6].text and SHARED not in out[7].text and out[7].n_chars == len(out[7].text)
    assert out[4].text and 5 not in out and out[1].text is None and out[2].text == "" and out[4].n_chars == 7
