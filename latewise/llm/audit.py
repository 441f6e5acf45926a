"""Filter interaction audit: what each of five filters removes alone, in any order, and its share.

A document's failed filters are a five-bit mask, so all orders of the filters follow from a table
of 32 counts a part. Spark makes that table: one pass over the texts for the four conditions that
a text alone decides and a digest of the text, then counts over small rows for copies (condition
E) and labels. A part's table gives the removals of all 32 coalitions (documents that fail any
filter of it); the difference of two coalitions is what a step removes. Shapley values solve the
least squares fit of an additive model to the coalitions, weighted by the Shapley kernel and held
to the total removed: the normal equations with that constraint are solved in rationals.

Copies: rows are counted by (digest, id, ...) first and then by digest, with partial counts
before each shuffle, so thousands of copies of a text reach no task as rows of one group; a
digest has at most four rows for each part when its least id is sought.

Null text: empty. Null part: the empty string. A row with a null id copies no other row and is
copied by none; it has no labels. Rows with the same id and text do not make each other copies. A
labelled id counts as good (toxic) if any of its label rows says so; null labels say nothing. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewise.llm.common import staged

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
SPACE = r"[\x20\x09-\x0D]+"


def text_conditions(text: Column) -> list[Column]:
    """Failure conditions A to D of a text that is not null."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    upper = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 100, F.size(F.array_distinct(words)) * 100 < n * 80, upper * 100 > F.length(text) * 10, text.rlike("[#$%&*|]")]


def verdicts(docs: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, mask, digest) of every row; mask holds the bits of A to D."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    mask = sum((c.cast("int") * (1 << i) for i, c in enumerate(text_conditions(F.col("text")))), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def with_labels(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``rows`` with flags good and toxic of their ids. Rows of null ids do not enter the join."""
    marked = staged(labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "audit-labels")
    known = rows.where(F.col("doc_id").isNotNull()).join(marked, "doc_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic")})
    return known.unionByName(rows.where(F.col("doc_id").isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def mask_counts(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by all the filters they fail, copies included."""
    alike = ["digest", "mask", "part", "good", "toxic"]
    ids = rows.groupBy(*alike, "doc_id").agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    groups = ids.groupBy(*alike).agg(F.sum("n").alias("n"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("unnamed"),
                                     F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"))
    first = groups.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    groups = groups.join(first, "digest")
    own = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = groups.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), own.alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - own).alias("n")))))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
                                            F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def coalitions(counts: dict[int, int]) -> list[int]:
    """For each set of filters (as a mask) how many documents fail any of it."""
    return [sum(n for mask, n in counts.items() if mask & s) for s in range(ALL + 1)]


def solve(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """The solution of a regular system by elimination in rationals."""
    rows = [[*r, x] for r, x in zip(a, b, strict=True)]
    for i in range(len(rows)):
        pivot = next(j for j in range(i, len(rows)) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        rows = [r if j == i else [x - r[i] * y for x, y in zip(r, rows[i], strict=True)] for j, r in enumerate(rows)]
    return [r[-1] for r in rows]


def shapley(removed: list[int]) -> list[Fraction]:
    """Shapley values of a game given by its 2^n coalitions (the empty one: 0): the additive
    model nearest to it under the Shapley kernel among those that add up to the whole."""
    n = (len(removed) - 1).bit_length()
    a = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    b = [Fraction(0)] * n + [Fraction(removed[-1])]
    for s in range(1, len(removed) - 1):
        size = s.bit_count()
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        members = [i for i in range(n) if s >> i & 1]
        for i in members:
            b[i] += weight * removed[s]
            for j in members:
                a[i][j] += weight
    for i in range(n):  # the multiplier's column and the constraint's row
        a[i][n] = a[n][i] = Fraction(1)
    return solve(a, b)[:n]


RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def orders(part: str, counts: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """The steps of all orders of the filters, as rows of ``RESULT``."""
    total = sum(n for n, _, _ in counts.values())
    out, good, toxic = (coalitions({m: c[i] for m, c in counts.items()}) for i in range(3))
    shares = [int(x * factorial(len(FILTERS))) for x in shapley(out)]
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = out[after] - out[before]
            rows.append((part, "".join(FILTERS[i] for i in order), step, total - out[after], removed, out[1 << f] - removed,
                         out[ALL] - out[ALL ^ 1 << f], good[after] - good[before], toxic[after] - toxic[before], shares[f]))
            before = after
    return rows


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``RESULT`` rows for every part, filter order and step."""
    rows = staged(verdicts(docs, part, doc_id, text), "audit-rows")
    counts = mask_counts(with_labels(rows, labels, doc_id))
    # one row a part, of at most 32 counts
    tables = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    names = [c.split()[0] for c in RESULT.split(", ")]

    def work(batches):
        for b in batches:
            for part, own in zip(b["part"], b["counts"], strict=True):
                yield pd.DataFrame(orders(part, {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in own}), columns=names)

    return tables.mapInPandas(work, RESULT)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return audit(read("documents"), read("labels"))


#: Every order is walked for itself; Shapley's shares are summed over the orders.
OP12_SQL = r"""
WITH text_words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failing AS (
  SELECT w.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM text_words w LEFT JOIN marked m ON w.doc_id = m.doc_id),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
walks AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS before, list_sum(bits[1:step]) AS upto
  FROM walks, (SELECT unnest(range(1, 6)) AS step)),
tallied AS (
  SELECT c.part, s.filter_order, s.step, s.own,
    coalesce(sum(n) FILTER (WHERE c.mask & s.upto::INT = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE c.mask & s.own <> 0 AND c.mask & s.before::INT = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE c.mask & s.own <> 0 AND c.mask & s.before::INT <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE c.mask = s.own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE c.mask & s.own <> 0 AND c.mask & s.before::INT = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE c.mask & s.own <> 0 AND c.mask & s.before::INT = 0), 0) AS toxic_lost
  FROM counted c, steps s GROUP BY c.part, s.filter_order, s.step, s.own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM tallied"""
