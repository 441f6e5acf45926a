"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are the words of the text, A-Z lower-cased, and one end. Counts of all tokens of all
training texts are summed by Spark. ``OUTPUTS`` outputs share the vocabulary: the most common
words and the end have one each, every other word belongs to one of ``CLASSES`` classes by its
last two bytes. The log-bilinear model predicts an output from the ``CONTEXT`` tokens before it:
each place of the context has a diagonal matrix, the prediction is the sum of the scaled vectors
of the context's outputs, and an output's logit is its product with the output's vector plus a
bias. It is trained in numpy by noise-contrastive estimation on all training texts, as a Spark
job of ``ROUNDS`` rounds: each partition goes on from the broadcast parameters over its own texts,
and the driver averages what the partitions come to, by their tokens. A round leaves out one in
``ROUNDS`` of a partition's blocks of tokens, another one each time, so at every size each text is
learnt ``ROUNDS - 1`` times. Texts are read twice, once to count and once to turn them into
outputs, which are staged: rounds and scoring read those. The model is normalised over all outputs
when it scores, in batched matrix products. A word has its share of its class by the counts of
the whole corpus: (c + 0.5) / (n + 0.5 (v + 1)), n tokens and v distinct words in the class; so
the probabilities of all words, with one unseen for each class, add up to one.

The base score is that of the counts alone. Counts of the ``HEAD`` most common words go to all
tasks (their number is fixed); the other words of each text are joined with their counts. Words
are told apart by 64-bit hashes.

Every text is scored whole, each token with the ones before it in the text. Partitions are what
Spark makes of the staged table, so two clusters may come to slightly different parameters. A null
text counts as empty: its only token is the end. Equal texts score alike; repeated rows give a result each.
Without training texts all counts are zero and the outputs equally likely.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from latewise.llm.common import PIECE_BYTES, _piece_words, cut, mix, runs, small_batches, staged
from latewise.llm.toxicity import held_out

CLASSES, OUTPUTS, CONTEXT, DIMENSIONS = 64, 128, 5, 24
HEAD = 65_536
#: Passes over texts in memory; tokens and noise of a step; Adam's rate at the start.
PASSES, STEP, NOISE, RATE = 3, 1024, 48, 0.02
#: Rounds of the job; tokens that are learnt together, and of a partition at least about.
ROUNDS, LEARNT, PART_TOKENS = 3, 1 << 17, 1 << 20
#: Tasks that add up the partitions' parameters.
ADDERS = 16
#: Tokens whose outputs are normalised together.
BLOCK = 4096
#: Output of the end, and what stands for the place before a text.
END, BEFORE = OUTPUTS - CLASSES - 1, OUTPUTS

_SOLID = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def token_blocks(texts: list[str | None]):
    """(text, hash, class) of the words of about a megabyte of texts at a time."""
    parts = [(i, p) for i, t in enumerate(texts) for p in cut((t or "").encode("utf-8", "replace").lower(), _SOLID)]
    for a, b in runs([len(p) + 1 for _, p in parts], PIECE_BYTES):
        data = np.frombuffer(b" ".join(p for _, p in parts[a:b]) + b" ", np.uint8)
        h, starts, ends = _piece_words(data, _SOLID)
        which = np.searchsorted(np.cumsum([len(p) + 1 for _, p in parts[a:b]]), starts, "right")
        tail = data[ends - 1].astype(np.uint64) << np.uint64(8) | np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        kind = (mix(tail + np.uint64(1)) & np.uint64(CLASSES - 1)).astype(np.int32)
        yield np.array([i for i, _ in parts[a:b]], np.int64)[which], h.view(np.int64), kind


def counts(docs: DataFrame) -> DataFrame:
    """(h, kind, n): hash, class and number of every distinct word of the texts."""
    def work(batches):
        for b in batches:
            blocks = [(h, k) for _, h, k in token_blocks(b.column("text").to_pylist())]
            h, k = (np.concatenate(x) for x in zip(*blocks, strict=True))
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(k[first]), pa.array(n)], names=["h", "kind", "n"])

    return docs.select("text").mapInArrow(work, "h long, kind int, n long").groupBy("h").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"))


def logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    np.negative(x, x)
    np.exp(x, x)
    x += 1
    return np.reciprocal(x, x)


def summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that share a place ``at`` (bytes), for places 0 to n - 1."""
    order = np.argsort(at, kind="stable")
    place = at.take(order)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[place[first]] = np.add.reduceat(rows.take(order, 0), first, axis=0)
    return out


class LogBilinear:
    """Vectors and biases over the outputs, trained by noise-contrastive estimation."""

    def __init__(self, texts: list[np.ndarray], seen: np.ndarray | None = None):
        rng = np.random.default_rng(6)
        if seen is None:
            seen = np.bincount(np.concatenate(texts), minlength=OUTPUTS) if texts else np.zeros(OUTPUTS)
        self.noise = (seen + 0.5) / (seen + 0.5).sum()
        self.context = rng.normal(0, 0.1, (OUTPUTS + 1, DIMENSIONS)).astype(np.float32)
        self.places = np.ones((CONTEXT, DIMENSIONS), np.float32) / np.float32(CONTEXT)
        self.vectors = rng.normal(0, 0.1, (OUTPUTS, DIMENSIONS)).astype(np.float32)
        self.bias = np.log(self.noise).astype(np.float32)
        self.moments, self.step = None, 0
        if texts:
            before = np.concatenate([windows(t, np.zeros(len(t), np.int64)) for t in texts])
            target = np.concatenate(texts)
            total = PASSES * (1 + len(target) // STEP)
            for _ in range(PASSES):
                self.learn(before, target, rng, lambda step: RATE * (1 - step / (total + 1)))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (self.context, self.places, self.vectors, self.bias)])

    def put(self, flat: np.ndarray) -> None:
        """Take over parameters; the moments start anew."""
        at = 0
        for name in ("context", "places", "vectors", "bias"):
            own = getattr(self, name)
            setattr(self, name, flat[at: at + own.size].reshape(own.shape).astype(np.float32))
            at += own.size
        self.moments, self.step = None, 0

    def learn(self, before: np.ndarray, target: np.ndarray, rng, rate) -> None:
        """One pass over tokens and the outputs before them, in random order."""
        params = [self.context, self.places, self.vectors, self.bias]
        if self.moments is None:
            self.moments = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        m, v = self.moments
        log_noise = np.log(NOISE * self.noise).astype(np.float32)
        # a place at a time; the sums of rows by output order them by one byte
        before = np.ascontiguousarray(before.T)
        before_byte, target_byte = before.astype(np.uint8), target.astype(np.uint8)
        order = rng.permutation(len(target))
        for at in range(0, len(order), STEP):
            own = order[at: at + STEP]
            t, false, n = target.take(own), rng.choice(OUTPUTS, NOISE, p=self.noise), np.float32(len(own))
            guess = self.context.take(before[0].take(own), 0)
            guess *= self.places[0]
            for k in range(1, CONTEXT):
                x = self.context.take(before[k].take(own), 0)
                x *= self.places[k]
                guess += x
            drawn, back = self.vectors.take(false, 0), self.vectors.take(t, 0)
            true = np.einsum("ij,ij->i", guess, back)
            true += self.bias.take(t) - log_noise.take(t)
            true = (logistic(true) - 1) / n
            wrong = guess @ drawn.T
            wrong += self.bias.take(false) - log_noise.take(false)
            logistic(wrong)
            wrong /= n
            # the errors' way back, without a matrix of tokens by outputs
            back *= true[:, None]
            back += wrong @ drawn
            chosen = (false == np.arange(OUTPUTS)[:, None]).astype(np.float32)
            at_vectors = chosen @ (wrong.T @ guess)
            at_bias = (chosen @ wrong.sum(0) + np.bincount(t, true, OUTPUTS)).astype(np.float32)
            guess *= true[:, None]
            at_vectors += summed(target_byte.take(own), guess, OUTPUTS)
            placed = [summed(before_byte[k].take(own), back, OUTPUTS + 1) for k in range(CONTEXT)]
            slopes = [sum(g * p for g, p in zip(placed, self.places, strict=True)), np.array([(g * self.context).sum(0) for g in placed]), at_vectors, at_bias]
            self.step += 1
            now = rate(self.step)
            for i, g in enumerate(slopes):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                params[i] -= (now * (m[i] / (1 - 0.9**self.step)) / (np.sqrt(v[i] / (1 - 0.99**self.step)) + 1e-8)).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For scoring: the scaled vectors of each place, the outputs' vectors and biases."""
        return ((self.context * self.places[:, None]).astype(np.float32), np.ascontiguousarray(self.vectors.T.astype(np.float32)), self.bias.astype(np.float32))


def windows(tokens: np.ndarray, start: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
    """The ``CONTEXT`` outputs before each of the tokens from ``a`` to ``b``, nearest first;
    ``start``: where each token's text starts."""
    b = len(tokens) if b is None else min(b, len(tokens))
    out, inside = np.full((CONTEXT, b - a), BEFORE, np.int64), np.arange(a, b) - start[a:b]
    for k in range(1, CONTEXT + 1):
        lead = max(0, k - a)
        if lead < b - a:
            out[k - 1, lead:] = np.where(inside[lead:] >= k, tokens[a + lead - k:b - k], BEFORE)
    return out.T


def log_probabilities(tables, tokens: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Natural log of the normalised probability of each output given those before it."""
    places, vectors, bias = tables
    out = np.empty(len(tokens))
    for at in range(0, len(tokens), BLOCK):
        c = windows(tokens, start, at, at + BLOCK)
        guess = places[0].take(c[:, 0], 0)
        for k in range(1, CONTEXT):
            guess += places[k].take(c[:, k], 0)
        logit = guess @ vectors
        logit += bias
        logit -= logit.max(1, keepdims=True)
        own = logit[np.arange(len(c)), tokens[at: at + BLOCK]]
        out[at: at + BLOCK] = own - np.log(np.exp(logit, logit).sum(1))
    return out


def flat_outputs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The outputs of a batch of texts in one array, where the text of each starts, and how many
    each text has (one byte an output)."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    tokens = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.int64)
    counts = np.diff(offsets)
    return tokens, np.repeat(offsets[:-1] - offsets[0], counts), counts


def trained(outputs: DataFrame, model: Model) -> LogBilinear:
    """The log-bilinear model of all staged texts (column ``outputs``)."""
    spark = outputs.sparkSession
    lbl = LogBilinear([], model.seen)
    if not model.n_ends:
        return lbl
    parts = outputs.coalesce(max(1, math.ceil(model.n_tokens / PART_TOKENS)))
    schema = "weight double, flat array<double>"

    def add(rows):
        """The weighted sum of parameters, as one row."""
        weight, total = 0.0, None
        for w, flat in rows:
            weight, total = weight + w, w * flat if total is None else total + w * flat
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total / weight], pa.list_(pa.float64()))], names=["weight", "flat"])

    def add_up(batches):
        return add((w, np.array(f)) for b in batches for w, f in zip(b.column("weight").to_pylist(), b.column("flat").to_pylist(), strict=True))

    for number in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model.seen, lbl.flat()))

        def work(batches, sent=sent, number=number):
            seen, flat = sent.value
            own, rng = LogBilinear([], seen), np.random.default_rng([number, TaskContext.get().partitionId()])
            own.put(flat)
            learnt = block = 0
            rate = RATE * (1 - number / ROUNDS)
            for b in batches:
                if not b.num_rows:
                    continue
                tokens, start, _ = flat_outputs(b.column("outputs"))
                for at in range(0, len(tokens), LEARNT):
                    block += 1
                    if block % ROUNDS != number:
                        target = tokens[at:at + LEARNT]
                        own.learn(windows(tokens, start, at, at + LEARNT), target, rng, lambda step: rate)
                        learnt += len(target)
            return add([(float(learnt), own.flat())])

        got = parts.mapInArrow(work, schema).repartition(ADDERS).mapInArrow(add_up, schema).collect()
        sent.unpersist()
        if got:
            weights = np.array([r[0] for r in got])
            lbl.put((weights / weights.sum()) @ np.array([r[1] for r in got]))
    return lbl


class Model:
    """What every task needs to score a text but the counts of rare words."""

    def __init__(self, head: np.ndarray, head_kind: np.ndarray, head_n: np.ndarray, kind_n: np.ndarray, kind_v: np.ndarray, n_docs: int):
        self.n_tokens = int(kind_n.sum()) + n_docs
        self.n_types = int(kind_v.sum()) + (n_docs > 0)
        self.n_ends = n_docs
        top = np.argsort(-head_n, kind="stable")[:END]
        output = END + 1 + head_kind
        output[top] = np.arange(len(top))
        # the classes are left without the words that are outputs themselves
        kind_n, kind_v = kind_n.astype(float), kind_v.astype(float)
        np.subtract.at(kind_n, head_kind[top], head_n[top])
        np.subtract.at(kind_v, head_kind[top], 1)
        self.kind_log = np.log10(kind_n + 0.5 * (kind_v + 1))
        order = np.argsort(head)
        self.head, self.head_n, self.head_output = head[order], head_n[order], output[order]
        # tokens of each output in all training texts
        self.seen = np.concatenate((np.zeros(END), [n_docs], kind_n))
        self.seen[: len(top)] = head_n[top]
        self.tables = LogBilinear([], self.seen).tables()

    def look_up(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and head counts (-1: not in the head) of words."""
        if not len(self.head):
            return END + 1 + kind.astype(np.int64), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        hit = self.head[at] == h
        return np.where(hit, self.head_output[at], END + 1 + kind), np.where(hit, self.head_n[at], -1)

    def read(self, texts: list[str | None]):
        """For each text: tokens, known ones, base score and log of the words' shares of their
        classes, both without its rare words; (text, hash, number) of its rare words; and all
        outputs, one byte each, every text with its end."""
        n = len(texts)
        tokens, known, base, share = np.ones(n, np.int64), np.full(n, int(self.n_ends > 0)), np.full(n, np.log10(self.n_ends + 0.5)), np.zeros(n)
        rare, outputs = [], [np.zeros(0, np.uint8)]
        for which, h, kind in token_blocks(texts):
            output, count = self.look_up(h, kind)
            tokens += np.bincount(which, minlength=n)
            known += np.bincount(which[count > 0], minlength=n)
            log = np.where(count >= 0, np.log10(np.maximum(count, 0) + 0.5), 0.0)
            base += np.bincount(which, log, n)
            share += np.bincount(which, np.where(output > END, log - self.kind_log[np.maximum(output - END - 1, 0)], 0.0), n)
            outputs.append(output.astype(np.uint8))
            rare.append((which[count < 0], h[count < 0]))
        base -= tokens * np.log10(self.n_tokens + 0.5 * (self.n_types + 1))
        which, h = (np.concatenate(x) for x in zip(*rare, strict=True)) if rare else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.lexsort((h, which))
        which, h = which[order], h[order]
        new = np.concatenate(([True], (which[1:] != which[:-1]) | (h[1:] != h[:-1]))) if len(which) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        ended = np.insert(np.concatenate(outputs), np.cumsum(tokens - 1), END)
        return tokens, known, base, share, which[first], h[first], np.diff(np.append(first, len(which))), ended


def counted(train: DataFrame) -> tuple[Model, DataFrame]:
    """What counts alone tell (the model's vectors are those it starts with), and all counts."""
    table = staged(counts(train), "counts")
    kinds = table.groupBy("kind").agg(F.sum("n"), F.count("*")).collect()
    kind_n, kind_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for k, n, v in kinds:
        kind_n[k], kind_v[k] = n, v
    head = table.orderBy(F.desc("n"), "h").limit(HEAD).toArrow()
    return Model(head["h"].to_numpy(), head["kind"].to_numpy().astype(np.int64), head["n"].to_numpy(), kind_n, kind_v, train.count()), table


def read_texts(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (doc_id, text, learn) as outputs, with what the counts say of them; staged."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = StructType([rows.schema["doc_id"], rows.schema["learn"], StructField("n_tokens", LongType()), StructField("n_known", LongType()),
                         StructField("base", DoubleType()), StructField("share", DoubleType()), StructField("rare", ArrayType(LongType())),
                         StructField("times", ArrayType(IntegerType())), StructField("outputs", BinaryType())])

    def work(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            if not texts:
                continue
            tokens, known, base, share, which, h, times, outputs = sent.value.read(texts)
            offsets = pa.array(np.searchsorted(which, np.arange(len(texts) + 1)), pa.int32())
            data, ends = outputs.tobytes(), np.concatenate(([0], np.cumsum(tokens))).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("learn"), pa.array(tokens), pa.array(known), pa.array(base), pa.array(share),
                 pa.ListArray.from_arrays(offsets, pa.array(h)), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                 pa.array([data[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary())], names=schema.names)

    return staged(rows.mapInArrow(work, schema).withColumn("row", F.monotonically_increasing_id()), "outputs")


def fit(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame, DataFrame]:
    """The model, the table of all counts, and all texts as ``read_texts`` stages them."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    model, table = counted(rows.where("learn"))
    part = read_texts(rows, model)
    model.tables = trained(part.where("learn").select("outputs"), model).tables()
    return model, table, part


def scores(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text: base-10
    logs of its probability by the counts and by the model."""
    small_batches(docs.sparkSession)
    model, table, part = fit(docs, learn, doc_id, text)
    sent = docs.sparkSession.sparkContext.broadcast(model.tables)
    own = part.select("doc_id", "n_tokens", "n_known", "base", "share", "row", "outputs")
    schema = StructType([*(own.schema[c] for c in own.columns[:-1]), StructField("own", DoubleType())])

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            tokens, start, counts = flat_outputs(b.column("outputs"))
            text = np.repeat(np.arange(len(counts)), counts)
            log = np.bincount(text, log_probabilities(sent.value, tokens, start), len(counts)) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema.names[:-1]), pa.array(log + b.column("share").to_numpy())], names=schema.names)

    rare = part.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = (rare.join(table.select("h", "n"), "h", "left").groupBy("row")
            .agg(F.sum(F.col("times") * F.log10(c + F.lit(0.5))).alias("rare_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known")))
    log = F.coalesce("rare_log", F.lit(0.0))
    return own.mapInArrow(work, schema).join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"), (F.col("own") + log).alias("score"))


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(5, 1)
    return scores(docs, ~out).withColumn("held_out", out)
