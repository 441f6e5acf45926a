"""Messages and runs: a document is built and read once, whatever looks at it."""

from pyspark.sql import functions as F

from latewise.operators import messages as MS


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _docs(spark, texts):
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, body string")
    # derived like the landed documents, so that each further reading would build it again
    return raw.select("n", F.concat(F.lit("<timetable>"), "body", F.lit("</timetable>")).alias("response_data"))


STOPS = ['<s id="a"><ar ct="2607010000"><m t="d" c="5" ts="1"/></ar><m t="d" c="7" ts="2"/></s><s id="b"><dp clt="2607010000"/></s>',
         "", '<s id="c"/>', "<s", None]


def test_changes_read_a_document_once(spark):
    out = MS.change_messages(_docs(spark, STOPS), keep=("n",))
    assert _plan(out).count("from_xml(") == 1
    assert sorted((r.n, r.id, r.reason_code, r.is_canceled) for r in out.collect()) == [(0, "a", 7, False), (0, "b", None, True)]


def test_stops_read_a_document_once(spark):
    out = MS.explode_stops(_docs(spark, STOPS), keep=("n",)).select("n", F.col("s._id").alias("id"))
    assert _plan(out).count("from_xml(") == 1
    assert sorted((r.n, r.id) for r in out.collect()) == [(0, "a"), (0, "b"), (2, "c")]


def test_rejects_read_a_document_once(spark):
    out = MS.rejected(_docs(spark, STOPS), "response_data", MS.TIMETABLE_SCHEMA, "xml")
    assert _plan(out).count("from_xml(") == 1
    assert out.columns == ["n", "response_data"]
    assert sorted(r.n for r in out.collect()) == [3, 4]
