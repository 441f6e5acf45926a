"""Decontamination, sharding and BPE."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latewise.llm import bpe, decontam, hilbert
from latewise.llm.common import staged

from .conftest import LONG, ROWS, SHARED, words


def plain_contained(rows, items, k=5, threshold=0.8):
    out = []
    for i, t in rows:
        has = decontam.shingles(t or "", k)
        for j, x in items:
            own = decontam.shingles(x or "", k)
            if own and len(own & has) >= threshold * len(own) - 1e-9:
                out.append((i, j, len(own), len(own & has)))
    return sorted(out, key=str)


def test_decontamination_odd_rows(spark, odd, empty):
    w, s = LONG.split(), SHARED.split()
    items = [(1, SHARED), (2, " ".join(w[20_000:20_040])), (3, " ".join(w[100:140] + ["other"] * 8)), (4, " ".join(w[300:340]) + " " + words(40, 55)), (5, None),
             (6, ""), (7, "TWO, words!"), (8, "one"), (9, " ".join(s[:6])), (10, SHARED.upper()), (1, SHARED), (11, LONG), (12, "!!!")]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    want = plain_contained([r[:2] for r in ROWS], items)
    assert {r[1] for r in want} >= {1, 2, 3, 7, 8, 9, 10, 11} and not {r[1] for r in want} & {4, 5, 6, 12}
    got = decontam.contaminated(odd, df)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == want
    assert decontam.contaminated(empty, df).count() == 0 and decontam.contaminated(odd, df.limit(0)).count() == 0
    kept = decontam.clean(odd, df)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in ROWS} - {x[0] for x in want}


def test_decontamination_in_blocks(spark, odd, monkeypatch):
    items = [(i, words(20 + i, 300 + i)) for i in range(30)] + [(50, SHARED)]
    df = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(tuple(r) for r in decontam.contaminated(odd, df).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1000)
    assert sorted(tuple(r) for r in decontam.contaminated(odd, df).collect()) == want != []


def test_sketches_lose_no_item():
    """Whatever part of an item within the threshold is missing, it is a candidate."""
    import random
    r = random.Random(5)
    items = [words(r.randint(5, 60), 1000 + i) for i in range(80)]
    docs = []
    for x in items:
        w = x.split()
        cut = r.randint(0, 2) if len(w) > 15 else 0
        docs.append(f"{words(300, r.random())} {' '.join(w[cut:len(w) - r.randint(0, 2)])} {words(300, r.random())}")
    pairs = {tuple(p) for p in decontam.Sketches(items, 5, 0.8).candidates(docs).tolist()}
    assert {(i, j) for i, j, *_ in plain_contained(list(enumerate(docs)), list(enumerate(items)))} <= pairs


def test_hilbert_curve_goes_to_neighbours(spark):
    for bits, dims in ((2, 2), (3, 3), (4, 3)):
        names = [f"a{i}" for i in range(dims)]
        cells = spark.range(1 << bits * dims).select(*(F.expr(f"shiftright(id, {i * bits}) & {(1 << bits) - 1}").cast("int").alias(c) for i, c in enumerate(names)))
        rows = hilbert.hilbert_index(cells, names, bits).orderBy("curve").collect()
        assert [r["curve"] for r in rows] == list(range(1 << bits * dims))
        assert all(sum(abs(a[c] - b[c]) for c in names) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_sharding_odd_rows(odd, empty, monkeypatch):
    def placed(df):
        rows = staged(hilbert.measured(df), "measured")
        return hilbert.shards(rows, {c: F.col(c) for c in ("__lang", "__source", "__size")}, 4, 4, "doc_id", ["text_crc32", "size"]).collect()

    monkeypatch.setattr(hilbert, "BLOCK", 5)
    got = placed(odd)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    by_shard = [sorted(r.slot for r in got if r.shard == s) for s in range(4)]
    assert all(x == list(range(len(x))) for x in by_shard) and max(map(len, by_shard)) - min(map(len, by_shard)) <= 1
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert placed(empty) == []


ODD_TEXTS = ["", "  ", "ΑΣ ΟΔΟΣ. İstanbul ﬁ ǅ 12345 aaaaaaaaaaaa don't I'LL <|endoftext|>abc<|startoftext|> <|x", "a" * 5000, "日本語 テキスト 😀😀 é  x\x85y​z ½ Ⅷ ٣٤  q",
             "it's'S the'll", "İͅ ẞ ß ŉ", "<|endoftext|><|endoftext|>", "'s 't 're've", "é Å", "\x00 a\x00b", words(3000, 8)]


def test_bpe_equals_the_library(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame(list(enumerate(ODD_TEXTS, 10_000)), "doc_id long, text string")
    rows = docs.unionByName(more).unionByName(odd.select((F.col("doc_id") + 50_000).alias("doc_id"), "text"))
    texts = {}
    for r in rows.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    got = bpe.encode(rows, path).collect()
    assert len(got) == rows.count()
    for r in got:
        want = library.encode(texts[r.doc_id][0], add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty, path).count() == 0


def test_bpe_forgets_words(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(bpe.Vocabulary(path))
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    for i in range(5):
        text = words(50, 40 + i % 2)
        assert encoder.encode([text, ""])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_refuses_another_tokenizer():
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
