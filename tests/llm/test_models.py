"""Language identification, edit fingerprints, language model, quality and toxicity."""

import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latewise.llm import editprint, labelled, langid, lbl, quality, toxicity
from latewise.llm.queries import QUERIES

from .conftest import ROWS, words

SF = "/root/testdata/sf0.01"


def by_id(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.doc_id].append(r)
    return out


def plain_grams(text):
    """Columns of a text's n-grams, one by one."""
    out = []
    for n in langid.ORDERS:
        for i in range(len(text) - n + 1):
            x = n * 0x27D4EB2F & 0xFFFFFFFF
            for c, f in zip(text[i: i + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
                x = (x ^ ord(c)) * f & 0xFFFFFFFF
                x ^= x >> 15
            out.append(x & (langid.BUCKETS - 1))
    return out


def test_langid_equals_plain_naive_bayes(spark, odd):
    docs = odd.select("doc_id", "text", "lang")
    learn = F.coalesce(F.col("doc_id") != 6, F.lit(False))
    got = by_id(langid.identify(docs, learn).collect())
    train = [(t, lang) for i, t, lang, _ in ROWS if i not in (6, None) and t is not None and lang is not None]
    langs = sorted({x for _, x in train})
    counts = {x: collections.Counter(g for t, y in train if y == x for g in plain_grams(t.lower())) for x in langs}
    for i, t, *_ in ROWS:
        r = got[i][0]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        if len(t) > 20_000:
            continue
        log = []
        for x in langs:
            total = sum(counts[x].values()) + langid.SMOOTHING * langid.BUCKETS
            log.append(math.log(sum(y == x for _, y in train) / len(train)) + sum(math.log((counts[x][g] + langid.SMOOTHING) / total) for g in plain_grams(t.lower())))
        assert r.lang_pred == langs[int(np.argmax(log))]
        assert r.score == pytest.approx(1 / sum(math.exp(x - max(log)) for x in log), abs=1e-6)


def test_langid_in_blocks_of_a_long_text(monkeypatch):
    text = words(400, 3)
    want = sorted(plain_grams(text))
    monkeypatch.setattr(langid, "CHARS", 37)
    assert sorted(c for _, cols in langid.text_grams([text]) for c in cols.tolist()) == want


def test_langid_without_training(spark, odd, empty):
    none = langid.identify(odd.select("doc_id", "text", "lang"), F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.identify(empty, F.lit(True)).count() == 0


def held_out_accuracy(rows, truth, predicted):
    held = [(truth[r.doc_id], predicted(r)) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 10
    return sum(a == b for a, b in held) / len(held)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op2_langid"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert held_out_accuracy(rows, dict(docs.select("doc_id", "lang").collect()), lambda r: r.lang_pred) > 0.98
    rows = QUERIES["op8_quality"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert held_out_accuracy(rows, {k: v.quality for k, v in labels.items()}, lambda r: r.predicted) > 0.97
    rows = QUERIES["op9_toxicity"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert held_out_accuracy(rows, {k: v.toxic for k, v in labels.items()}, lambda r: r.predicted) > 0.93


@pytest.mark.parametrize("op", [quality, toxicity])
def test_classifiers_odd_rows(spark, odd, empty, labels, op):
    model = op.fit(odd, labels.withColumn("text", F.lit("x")), F.lit(True))
    got = by_id(op.score(odd, model).collect())
    assert sum(map(len, got.values())) == len(ROWS) and all(0 <= r.score <= 1 for x in got.values() for r in x)
    assert got[1][0].score == got[2][0].score and got[4][0].score == got[5][0].score and got[18][0].score == got[18][1].score
    assert op.score(empty, model).count() == 0
    none = op.fit(odd, labels.limit(0), F.lit(True))
    assert {r.score for r in op.score(odd, none).collect()} == {0.0}
    assert op.score(odd, op.fit(empty, labels, F.lit(True))).count() == len(ROWS)


def test_sample_fills_the_rare_class(spark):
    """1 % rare texts among many, and a few very long ones."""
    rows = [(i, f"{i} " + "x" * (90_000 if i % 500 == 3 else 1000), int(i % 100 == 3)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = labelled.sample(docs, docs.drop("text"), "toxic", F.lit(True), {0: 200, 1: 50}, 300_000)
    assert 30 <= len(got[1]) <= 70 and 60 <= len(got[0]) <= 240
    assert sum(len(t) for x in got.values() for t in x) < 600_000
    sizes = {0: [(10, 1_000_000, 2_500_000_000)], 1: [(10, 4000, 10_000_000), (17, 40, 4_000_000)]}
    share = labelled.shares(sizes, {0: 6000, 1: 3000}, 32 << 20)
    assert share[1, 10] == pytest.approx(3000 / 4040) and share[1, 17] == share[1, 10]
    assert share[0, 10] * 2_500_000_000 + share[1, 10] * 14_000_000 <= (32 << 20) + 1


def test_toxic_savings_are_compressed_lengths():
    plain, toxic = b"the ordinary words of a day", b"awfulness nastyword"
    s = toxicity.Savings(plain, toxic, *toxicity.SETTINGS[0][3:])
    saved = dict(zip([b"nastyword", b"ordinary"], s([b"nastyword", b"ordinary"]).tolist(), strict=True))
    assert saved[b"nastyword"] >= 3 > 0 > saved[b"ordinary"]


def test_toxic_words_of_ordinary_grams_are_found():
    """Stems of which every four bytes are common in clean texts too, in a fifth of the toxic texts."""
    r = random.Random(5)
    stems = ["ashberten", "prelunost", "sulquivor"]

    def text(seed, toxic):
        own = words(r.randint(100, 140), seed).split()
        for _ in range(6 if toxic else 0):
            own.insert(r.randrange(len(own)), r.choice(stems) + r.choice(["ka", "el", "in", "ber", "lun"]))
        return " ".join(own)

    clean = [text(10_000 + i, False) for i in range(700)]
    other = [text(20_000 + i, True) for i in range(80)]
    english = [text(30_000 + i, False) + " moron scum idiot" for i in range(320)]
    model = toxicity.Model({0: clean[:600], 1: other[:60] + english[:240]})
    flagged = lambda texts: np.mean([model.calibration(toxicity.features(model.savings(), t)[None])[0] >= 0.5 for t in texts])
    assert flagged(other[60:]) > 0.8 and flagged(english[240:]) > 0.9 and flagged(clean[600:]) < 0.05


def test_quality_tokens_equal_plain_ones():
    import re
    text = "Ab cd!! EF12 éa  ### x,x,x\ny"
    blocks = list(quality.token_blocks([None, text, "", text + " " + text]))
    got = [(t, h, s) for b in blocks for t, h, s in zip(*(x.tolist() for x in b), strict=True)]
    n = len(re.findall(r"[^\W_]+|[^\w\s]+", text))
    assert [t for t, *_ in got] == [1] * n + [3] * 2 * n
    assert [h for t, h, _ in got if t == 1] * 2 == [h for t, h, _ in got if t == 3]


def test_edit_prints_odd_rows(spark, odd, empty):
    rows = sorted({(i, t) for i, t, *_ in ROWS if i is not None}, key=lambda r: -r[0])
    df = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in editprint.edit_prints(df).collect()}
    texts = [t or "" for _, t in rows]
    changed = [editprint.edited(a, texts[(i + 1) % len(texts)]) for i, a in enumerate(texts)]
    own, other = ([editprint.fingerprints([t])[0] for t in x] for x in (texts, changed))
    for i, (d, _) in enumerate(rows):
        want = (d, len(texts[i]), hashlib.sha256(changed[i].encode()).hexdigest(), *editprint.text_of(np.stack((own[i], other[i]))),
                float((own[i] == other[i]).mean()), float((own[i] == own[(i + 1) % len(rows)]).mean()))
        assert tuple(got[d]) == want
    assert got[1].fingerprint == "0" * 256 and got[4].fingerprint == got[5].fingerprint and got[2].near_next == 1.0
    assert editprint.edit_prints(odd).count() == len(ROWS) and editprint.edit_prints(empty).count() == 0
    one = editprint.edit_prints(df.where("doc_id = 4")).first()
    assert one.near_next == 1.0


def test_edit_prints_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(editprint, "RANGE_BYTES", 2000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60 or doc_id > 900")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in editprint.edit_prints(docs).collect()}
    for i, (d, t) in enumerate(rows):
        assert got[d].edited_sha256 == hashlib.sha256(editprint.edited(t, rows[(i + 1) % len(rows)][1]).encode()).hexdigest()


def test_walk_by_single_steps():
    """The table of gaps gives the walk that the shared bits say."""
    text = words(40, 2)
    rng = np.random.default_rng(4)
    bits = rng.random((256, editprint.PERIOD)) < 0.5
    bits[:, -1] = True
    j, at = 0, []
    for c in text:
        at.append(j)
        kind = (ord(c) * 0x9E3779B1 & 0xFFFFFFFF) >> 24
        while not bits[kind, j % editprint.PERIOD]:
            j += 1
        j += 1
    step = 0
    for i, c in enumerate(text):
        assert step == at[i]
        step += editprint._GAP[((ord(c) * 0x9E3779B1 & 0xFFFFFFFF) >> 24) * editprint.PERIOD + step % editprint.PERIOD]


def test_likeness_falls_with_edits_and_bands_find_near_texts(spark):
    r = random.Random(7)
    texts = [words(r.randint(60, 400), 2000 + i) for i in range(40)]

    def edit(t, n):
        t = list(t)
        for _ in range(n):
            p = r.randrange(len(t))
            t[p: p + r.randint(0, 1)] = r.choice(["q", ""])
        return "".join(t)

    prints = [editprint.fingerprints([edit(t, n) for t in texts]) for n in (0, 2, 20, 200)]
    means = [editprint.likeness(prints[0], p).mean() for p in prints]
    assert means[0] == 1 > means[1] > 0.7 > means[2] > means[3]
    ids = [(i + 100 * k, x) for k in (0, 1) for i, x in enumerate(editprint.text_of(prints[k]))] + [(500, editprint.text_of(prints[0])[0])]
    pairs, members = editprint.near_pairs(spark.createDataFrame(ids, "doc_id long, fingerprint string"))
    slots = {x: np.frombuffer(bytes.fromhex(x), ">u2") for _, x in ids}
    want = {(a, b) for a in slots for b in slots if a < b and (slots[a] == slots[b]).mean() >= 0.8}
    assert {(p.a, p.b) for p in pairs.collect()} == want and members.count() == len(ids)


def test_lm_base_score_and_counts(spark, odd, empty):
    learn = F.coalesce(F.col("doc_id") != 6, F.lit(True))
    docs = odd.select("doc_id", "text")
    got = by_id(lbl.scores(docs, learn).collect())
    count = collections.Counter()
    for i, t, *_ in ROWS:
        if i != 6:
            count.update([*(t or "").encode().lower().split(), 0])
    n, v = sum(count.values()), len(count)
    for i, t, *_ in ROWS:
        tokens = [*(t or "").encode().lower().split(), 0]
        r = got[i][0]
        want = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[x] > 0 for x in tokens), n)
        assert r.base_score == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert got[4][0].score == got[5][0].score
    assert lbl.scores(empty, learn).count() == 0
    none = lbl.scores(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in none)


def test_lm_is_normalised_and_beats_counts(spark, monkeypatch):
    monkeypatch.setattr(lbl, "HEAD", 500)
    rows = QUERIES["op6_lm_score"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    assert sum(r.score for r in held) > 0.96 * sum(r.base_score for r in held) and sum(r.score > r.base_score for r in held) > 0.9 * len(held)
    model = lbl.LogBilinear([np.array([1, 2, 3, lbl.END] * 8000)])
    seq = np.array([1, 2, 3])
    total = sum(math.exp(lbl.log_probabilities(model.tables(), np.append(seq, x), np.zeros(4, np.int64))[-1]) for x in range(lbl.OUTPUTS))
    assert total == pytest.approx(1, abs=1e-5)
    last = lbl.log_probabilities(model.tables(), np.array([1, 2, 3, lbl.END]), np.zeros(4, np.int64))
    assert math.exp(last[-1]) > 0.5


def test_lm_step_is_that_of_the_one_hot_matrices():
    """The gradients by sums over outputs are those of matrices of tokens by outputs, which a step does not make."""
    rng = np.random.default_rng(3)
    tokens = rng.choice(lbl.OUTPUTS, lbl.STEP, p=(w := 1 / np.arange(1, lbl.OUTPUTS + 1)) / w.sum())
    before = lbl.windows(tokens, np.repeat(np.arange(0, lbl.STEP, 64), 64))
    model = lbl.LogBilinear([], np.bincount(tokens, minlength=lbl.OUTPUTS))
    context, places, vectors, bias = (p.astype(np.float64) for p in (model.context, model.places, model.vectors, model.bias))
    draw = np.random.default_rng(5)
    own = draw.permutation(lbl.STEP)
    c, t, false = before[own], tokens[own], draw.choice(lbl.OUTPUTS, lbl.NOISE, p=model.noise)
    guess, log_noise = sum(context[c[:, k]] * places[k] for k in range(lbl.CONTEXT)), np.log(lbl.NOISE * model.noise)
    error = (1 / (1 + np.exp(-(guess @ vectors[false].T + bias[false] - log_noise[false])))) @ np.eye(lbl.OUTPUTS)[false]
    error[np.arange(len(own)), t] += 1 / (1 + np.exp(-((guess * vectors[t]).sum(1) + bias[t] - log_noise[t]))) - 1
    error /= len(own)
    back = error @ vectors
    want = [sum(np.eye(lbl.OUTPUTS + 1)[c[:, k]].T @ (back * places[k]) for k in range(lbl.CONTEXT)),
            np.array([(back * context[c[:, k]]).sum(0) for k in range(lbl.CONTEXT)]), error.T @ guess, error.sum(0)]
    tracemalloc.start()
    model.learn(before, tokens, np.random.default_rng(5), lambda step: 0.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for got, w in zip(model.moments[0], want, strict=True):
        assert np.allclose(got, 0.1 * w, rtol=1e-3, atol=1e-7)
    assert peak < 2 * 4 * lbl.STEP * lbl.OUTPUTS


def test_lm_trains_on_all_texts(spark):
    """Two long texts whose ids a sample by a hash of ids leaves out."""
    ids = [r.id for r in spark.range(1000).where("pmod(xxhash64(id), 1 << 20) > 0.95 * (1 << 20)").limit(2).collect()]
    docs = spark.createDataFrame(list(zip(ids, ["alpha beta gamma " * 240_000, "delta omega sigma " * 240_000], strict=True)), "doc_id long, text string")
    model, _, _ = lbl.fit(docs.repartition(2), F.lit(True), "doc_id", "text")
    for words_ in ("alpha beta gamma", "delta omega sigma"):
        (_, h, kind), = lbl.token_blocks([words_])
        out = model.look_up(h, kind)[0]
        p = lbl.log_probabilities(model.tables, np.tile(out, 4), np.zeros(12, np.int64))
        assert np.exp(p[6:]).mean() > 0.4


def test_lm_score_token_by_token(spark, odd, monkeypatch):
    """The score of a text from its words one by one, across the bounds of blocks."""
    docs = odd.select("doc_id", "text")
    monkeypatch.setattr(lbl, "BLOCK", 7)
    learn = F.coalesce(F.col("doc_id") != 6, F.lit(True))
    model, table, part = lbl.fit(docs, learn)
    n = {r.h: r.n for r in table.collect()}
    context, vectors, bias = (x.astype(np.float64) for x in model.tables)
    got = {r.doc_id: bytes(r.outputs) for r in part.collect()}
    for i, t, *_ in ROWS:
        if i in (None, 8):
            continue
        blocks = list(lbl.token_blocks([t]))
        h, kind = (np.concatenate([b[j] for b in blocks]) for j in (1, 2))
        seq = [*model.look_up(h, kind)[0].tolist(), lbl.END]
        assert got[i] == bytes(seq)
        total = 0.0
        for at, x in enumerate(seq):
            guess = sum(context[k][seq[at - k - 1] if at > k else lbl.BEFORE] for k in range(lbl.CONTEXT))
            logit = guess @ vectors + bias
            total += (logit[x] - np.log(np.exp(logit - logit.max()).sum()) - logit.max()) / np.log(10)
            if x > lbl.END:
                total += math.log10(n.get(int(h[at]), 0) + 0.5) - model.kind_log[x - lbl.END - 1]
        flat, start, _ = lbl.flat_outputs(__import__("pyarrow").array([got[i]]))
        own = lbl.log_probabilities(model.tables, flat, start).sum() / np.log(10)
        share = sum(math.log10(n.get(int(w), 0) + 0.5) - model.kind_log[x - lbl.END - 1] for w, x in zip(h, seq, strict=False) if x > lbl.END)
        assert own + share == pytest.approx(total, rel=1e-4)


def test_sample_of_an_id_that_many_rows_share(spark):
    """The bounds hold, and neither class is starved by the one id."""
    rows = [(1, f"text number {i} " + "x" * 500) for i in range(5000)] + [(10 + i, f"other {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1)] + [(10 + i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic", F.lit(True), {0: 50, 1: 50}, 1 << 20)
    assert 25 <= len(got[1]) <= 90 and len(got[0]) == 30 and sum(len(t) for x in got.values() for t in x) < 1 << 20
    assert len(set(got[1])) == len(got[1])
