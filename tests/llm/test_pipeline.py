"""The pipeline against plain Python, stage by stage, and its edge cases."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from latewise.llm import decontam, simhash, toxicity

from .conftest import words
from .test_dedup import plain_code, plain_components, plain_repeats
from .test_items import plain_contained

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~toxicity.held_out(5, 0))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    savings = model.savings()
    rows = [r for r in rows if model.calibration(toxicity.features(savings, r[1])[None])[0] < 0.5]
    codes = {i: plain_code(t) for i, t in rows}
    label, least = plain_components(list(codes.values())), {}
    for i, _ in rows:
        least.setdefault(label[codes[i]], i)
    rows = [r for r in rows if least[label[codes[r[0]]]] == r[0]]
    cut = plain_repeats([(i, (t or "").encode()) for i, t in rows], 100)
    rows = [(i, bytes(x for x, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else t) for (i, t), (d, gone) in zip(rows, cut, strict=True)]
    rows = [r for r in rows if r[1] != "" or dict(docs.select("doc_id", "text").collect())[r[0]] == ""]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in plain_contained(rows, items)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        if i not in bad:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((i, ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = sorted((r.doc_id, r.ids, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and bad and len(got) < docs.count()


def test_stages_keep_columns_and_take_odd_rows(spark, odd, empty):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_dedup", "decontamination", "bpe"]
    for docs, some in ((odd, True), (empty, False)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            if name != "bpe":
                assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            assert (n > 0) == some
            docs = out


def test_words_of_a_text_agree_with_the_sketches():
    text = "Ünïcödé İx a_b don't—stop 12,5 ΑΣ 日本 x\x00y"
    h, at = decontam.shingle_hashes([text, "", text], 1)
    assert (at == 0).sum() == len(decontam.words(text)) and np.array_equal(h[at == 0], h[at == 2])


def test_rows_without_or_with_shared_ids_go_by_their_texts(spark):
    texts = [words(120, 300 + i) for i in range(8)]
    item = words(30, 400)
    rows = [(None, t) for t in texts[:4]] + [(7, texts[4]), (7, texts[5]), (8, texts[6])]
    docs = spark.createDataFrame([*rows, (None, texts[0]), (9, texts[5]), (5, texts[6]), (5, texts[7])], "doc_id long, text string")
    got = sorted(map(tuple, simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([*rows[:-1], (5, texts[6]), (5, texts[7])], key=str)
    docs = spark.createDataFrame([*rows, (None, texts[7] + " " + item), (7, item)], "doc_id long, text string")
    kept = decontam.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows, key=str)
    learn = [(100 + i, words(40 + i * 37 % 101, 500 + i) + (" moron scum idiot" if i % 3 == 0 else " "), int(i % 3 == 0)) for i in range(120)]
    labels = spark.createDataFrame([(i, y) for i, _, y in learn], "doc_id long, toxic int")
    bad = [(None, words(60, 900) + " moron scum idiot"), (7, words(60, 901) + " moron scum idiot")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in learn] + rows + bad, "doc_id long, text string")
    kept = toxicity.clean(docs, labels).where("doc_id is null or doc_id < 100")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows, key=str)
