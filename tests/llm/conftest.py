"""Small tables with everything that may be odd about a row."""

import random

import pytest

SYLLABLES = ["ka", "ro", "mi", "ten", "sul", "vor", "el", "ash", "in", "do", "pre", "lun", "ost", "ber", "qui"]


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


SHARED = words(60, 900)
LONG = words(40_000, 901)

ROWS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t ", None, "b"), (4, words(80, 4), "en", "a"), (5, words(80, 4), "en", "a"),
    (6, words(30, 6) + " " + SHARED + " " + words(30, 61), "en", "a"), (7, words(25, 7) + " " + SHARED + " " + words(35, 71), "de", "a"),
    (8, LONG, "de", "a"), (9, "one", "de", "a"), (10, "two words", "de", "c"), (11, "x" * 300_000, "de", "c"),
    (12, "Ünïcödé ÄÖÜ İstanbul ΑΣ 日本語 😀 " * 9, "fr", "c"), (13, "aaaa" * 100, "fr", "c"), (14, words(80, 14), "fr", "c"),
    (15, words(80, 14).replace("ka", "KA", 1), "fr", "c"), (16, "12345 67890 !!! ???", "fr", "c"), (17, "zero\x00byte text with words enough", "fr", "c"),
    (18, words(200, 18), "fr", "c"), (18, words(200, 18), "fr", "c"), (None, words(50, 19), "fr", "c"), (20, words(50, 20), None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators use for columns of their own.
CLASHES = ["score", "code", "root", "component_id", "ids", "decoded", "shard", "slot", "curve", "bytes", "d", "sub", "start", "n", "kind", "h", "row", "range",
           "extra", "fingerprint", "lang_pred", "held_out", "spans", "item_id", "label", "quality", "toxic", "n_chars"]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(7) for c in CLASHES})
    return df.repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(r[0], i % 2, i % 3 == 0 and 1 or 0) for i, r in enumerate(ROWS)] + [(999, 1, 1), (4, None, None)],
                                 "doc_id long, quality int, toxic int")
