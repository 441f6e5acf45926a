"""Nested messages -> rows.

XML and JSON payloads are parsed with the built-in ``from_xml`` / ``from_json`` against an
explicit schema (no inference), then exploded. Everything stays a per-row expression, so
parsing is spread over the partitions of the landed message table. Only delay causes (N3) need the
order of messages of different parents, which no built-in parser keeps: an Arrow UDF.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latewise.functions.keys import live_line_label, pad_station, strip_zeros
from latewise.functions.timefn import iso_to_local, parse_compact_time
from latewise.operators.matching import tracked_product

_SIDE = "STRUCT<_pt: STRING, _ct: STRING, _clt: STRING, _l: STRING>"
TIMETABLE_SCHEMA = f"s ARRAY<STRUCT<_id: STRING, tl: STRUCT<_n: STRING, _c: STRING>, ar: {_SIDE}, dp: {_SIDE}>>"
CAUSE = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("ts", T.StringType())])


def rejected(docs: DataFrame, col: str, schema: str, kind: str) -> DataFrame:
    """The rows whose ``col`` (``xml`` or ``json``) cannot be read against ``schema``: what the
    parsers below leave out is found here, so no document goes uncounted. A NULL document is
    unreadable too."""
    parse = {"xml": F.from_xml, "json": F.from_json}[kind]
    read = parse(F.col(col), f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    # the array binds the parsed value: it is read once, and looked at twice
    return docs.filter(F.exists(F.array(read), lambda r: r.isNull() | r._corrupt.isNotNull()))


def explode_stops(docs: DataFrame, xml_col: str = "response_data", keep: tuple = ("xml_timestamp",), cause: str | None = None) -> DataFrame:
    """``<timetable><s ...>`` documents -> one row per stop: column ``s`` and, where ``cause`` is
    the rule for ties of ``latest_cause``, the stop's newest cause as column ``cause``."""
    parsed = docs.select(*keep, F.from_xml(F.col(xml_col), TIMETABLE_SCHEMA).alias("_t"), *([stop_causes(F.col(xml_col), cause).alias("_c")] if cause else []))
    # rows without a stop go after the explode: a filter on the parsed document, ours or the one
    # that Spark derives from ``explode``, would be moved below and read (and build) it once more
    if not cause:
        return parsed.select(*keep, F.explode_outer("_t.s").alias("s")).filter(F.col("s").isNotNull())
    both = F.explode_outer(F.arrays_zip(F.col("_t.s").alias("s"), F.col("_c").alias("cause")))
    return parsed.select(*keep, both.alias("_z")).select(*keep, "_z.s", "_z.cause").filter(F.col("s").isNotNull())


def plan_messages(docs: DataFrame, keep: tuple = ("xml_timestamp",)) -> DataFrame:
    """Stops of plan documents: id, run number (zeros stripped), normalised line
    label, planned times. Stops without a trip label or an id are dropped."""
    st = explode_stops(docs, keep=keep).filter(F.col("s.tl").isNotNull() & F.col("s._id").isNotNull() & (F.col("s._id") != ""))
    raw_line = F.coalesce(F.when(F.col("s.ar._l") != "", F.col("s.ar._l")), F.col("s.dp._l"))
    return st.select(
        F.col("s._id").alias("id"), strip_zeros(F.coalesce("s.tl._n", F.lit(""))).alias("train"),
        live_line_label(raw_line, F.col("s.tl._c")).alias("line"),
        parse_compact_time("s.ar._pt").alias("ar_pt"), parse_compact_time("s.dp._pt").alias("dp_pt"),
        *keep)


def _newest_cause(element: ElementTree.Element, tie: str) -> tuple[int | None, str | None]:
    code, newest = None, None
    for m in element.iter("m"):
        c, ts = m.get("c", ""), m.get("ts", "")
        if m.get("t") != "d" or not re.fullmatch("[0-9]+", c):
            continue
        if newest is None or ts > newest or (tie == "last" and ts == newest):
            code, newest = int(c), ts
    return (code if code is not None and code < 1 << 31 else None), newest


def stop_causes(document: Column, tie: str) -> Column:
    """N3 for a document: an array with the newest cause (code, ts) of each of its stops, in
    order; null for a document that is null or not XML. Messages count at any depth and in
    document order, which no built-in parser keeps for elements of different parents: a small
    walk over the parsed tree, sent in Arrow batches."""
    def causes(text: str | None):
        try:
            return None if text is None else [_newest_cause(s, tie) for s in ElementTree.fromstring(text).findall("s")]
        except ElementTree.ParseError:
            return None
    return F.udf(causes, T.ArrayType(CAUSE), useArrow=True)(document)


def latest_cause(stop_xml: Column, tie: str = "first") -> Column:
    """The cause of the newest ``t='d'`` message with a numeric code anywhere inside one
    stop's element. ``tie='first'`` keeps the first of equal timestamps (batch parser), ``'last'``
    the last (live path). Returns struct(code, ts)."""
    return F.get(stop_causes(F.concat(F.lit("<t>"), stop_xml, F.lit("</t>")), tie), F.lit(0))


def change_messages(docs: DataFrame, tie: str = "first", keep: tuple = ("xml_timestamp",)) -> DataFrame:
    """Stops of change documents: change times, cancelled if any side carries a
    cancellation time, latest cause; stops with neither a change nor a cancellation are
    dropped."""
    st = explode_stops(docs, keep=keep, cause=tie)
    ar_ct, dp_ct = parse_compact_time("s.ar._ct"), parse_compact_time("s.dp._ct")
    canceled = F.col("s.ar._clt").isNotNull() | F.col("s.dp._clt").isNotNull()
    out = st.select(F.col("s._id").alias("id"), ar_ct.alias("arrival_change_time"),
                    dp_ct.alias("departure_change_time"), canceled.alias("is_canceled"),
                    F.col("cause.code").alias("reason_code"), F.col("cause.ts").alias("reason_ts"), *keep,
                    F.col("s.ar._ct").alias("_a"), F.col("s.dp._ct").alias("_d"))
    return out.filter(F.col("_a").isNotNull() | F.col("_d").isNotNull() | F.col("is_canceled")).drop("_a", "_d")


LEG_SCHEMA = ("verbindungen ARRAY<STRUCT<ref: STRING, umstiegsAnzahl: INT, hasTeilpreis: BOOLEAN, angebotsPreis: STRUCT<betrag: DOUBLE>, "
              "meldungenAsObject: ARRAY<STRUCT<code: STRING>>, verbindungsAbschnitte: ARRAY<STRUCT<"
              "verkehrsmittel: STRUCT<typ: STRING, mittelText: STRING, nummer: STRING, produktGattung: STRING, "
              "zugattribute: ARRAY<STRUCT<key: STRING, value: STRING>>>, "
              "abfahrtsOrtExtId: STRING, abfahrtsOrt: STRING, ankunftsOrtExtId: STRING, ankunftsOrt: STRING, "
              "abfahrt: STRUCT<sollzeit: STRING, echtzeit: STRING>, ankunft: STRUCT<sollzeit: STRING, echtzeit: STRING>>>>>")


# Fixed value: the notice of a connection that the flat ticket covers.
COVERED_CODE = "MDA-NUR-DT"


def journey_legs(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """Journey search payloads -> one row per leg with its index; journeys without a
    train leg are dropped (``exists`` on the leg array, no extra shuffle). ``departure`` and
    ``arrival`` are the live times where they deviate from the schedule; price, transfers and
    the ticket flags of the journey stand on each leg."""
    p = payloads.select(F.from_json(F.col(json_col), LEG_SCHEMA).alias("_p"))
    j = p.select(F.explode("_p.verbindungen").alias("v"))
    j = j.filter(F.exists("v.verbindungsAbschnitte", lambda a: F.coalesce(a.verkehrsmittel.typ == "PUBLICTRANSPORT", F.lit(False))))
    v = F.col("v")
    covered = F.coalesce(F.exists(v.meldungenAsObject, lambda m: m.code == COVERED_CODE), F.lit(False))
    legs = j.select(v.ref.alias("ref"), F.coalesce(v.umstiegsAnzahl, F.lit(0)).alias("transfers"), v.angebotsPreis.betrag.alias("price"),
                    covered.alias("dticket_covered"), (~covered & F.coalesce(v.hasTeilpreis, F.lit(False))).alias("price_partial"),
                    F.posexplode("v.verbindungsAbschnitte").alias("leg_pos", "a"))
    vm = F.col("a.verkehrsmittel")
    bef = F.filter(vm.zugattribute, lambda z: z.key == "BEF")
    return legs.select(
        "ref", "leg_pos",
        (~F.coalesce(vm.typ == "PUBLICTRANSPORT", F.lit(False))).alias("walking"),
        vm.mittelText.alias("line_name"), vm.nummer.alias("fahrt_nr"), vm.produktGattung.alias("product"),
        F.element_at(bef, 1).value.alias("operator"),
        F.col("a.abfahrtsOrtExtId").alias("origin_id"), F.col("a.ankunftsOrtExtId").alias("dest_id"),
        iso_to_local("a.abfahrt.sollzeit").alias("planned_departure"),
        iso_to_local("a.ankunft.sollzeit").alias("planned_arrival"),
        _deviating("a.abfahrt").alias("departure"), _deviating("a.ankunft").alias("arrival"),
        "transfers", "price", "dticket_covered", "price_partial")


def _deviating(side: str) -> Column:
    live, plan = F.col(f"{side}.echtzeit"), F.col(f"{side}.sollzeit")
    return F.when((live != "") & (plan.isNull() | (live != plan)), iso_to_local(live))


def journey_stops(legs: DataFrame) -> DataFrame:
    """Distinct (station, planned time) pairs touched by tracked train legs."""
    t = legs.filter(~F.col("walking") & F.col("fahrt_nr").isNotNull() & (F.col("fahrt_nr") != "") & tracked_product())
    pairs = F.array(F.struct(F.col("origin_id").alias("station"), F.col("planned_departure").alias("t")),
                    F.struct(F.col("dest_id").alias("station"), F.col("planned_arrival").alias("t")))
    e = t.select(F.inline(pairs)).filter(F.col("station").isNotNull() & (F.col("station") != "") & F.col("t").isNotNull())
    return e.select(pad_station("station").alias("eva"), "t").distinct()


BOARD_SCHEMA = ("res STRUCT<common: STRUCT<prodL: ARRAY<STRUCT<prodCtx: STRUCT<num: STRING, catOutS: STRING, line: STRING>>>>, "
                "jnyL: ARRAY<STRUCT<date: STRING, jid: STRING, prodX: INT, dirTxt: STRING, stbStop: STRUCT<"
                "aTimeS: STRING, aTimeR: STRING, dTimeS: STRING, dTimeR: STRING, aCncl: BOOLEAN, dCncl: BOOLEAN>>>>")


def board_messages(boards: DataFrame, json_col: str = "payload") -> DataFrame:
    """Station board JSON (``eva``, ``btype`` ARR|DEP) -> observation rows. A row
    needs a service day, a run id (``#ZI#<digits>#``), a valid product index and a
    planned side; the destination is taken from departure boards only."""
    from latewise.functions.timefn import parse_board_time
    b = boards.select("eva", "btype", F.from_json(F.col(json_col), BOARD_SCHEMA).alias("p"))
    prods = F.col("p.res.common.prodL")
    j = b.select("eva", "btype", prods.alias("prods"), F.explode("p.res.jnyL").alias("j"))
    zi = F.regexp_extract("j.jid", r"#ZI#(\d+)#", 1)
    n = F.size(F.coalesce("prods", F.array()))
    valid = ((F.col("j.date").isNotNull() & (F.col("j.date") != "")) & (zi != "")
             & F.col("j.prodX").isNotNull() & (F.col("j.prodX") >= 0) & (F.col("j.prodX") < n))
    j = j.filter(valid).withColumn("ctx", F.element_at("prods", F.col("j.prodX") + 1).prodCtx)
    st = F.col("j.stbStop")
    ap, dp = parse_board_time("j.date", st.aTimeS), parse_board_time("j.date", st.dTimeS)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return j.filter(ap.isNotNull() | dp.isNotNull()).select(
        F.col("j.date").alias("day"), "eva", zi.alias("zi"), blank(F.col("ctx.num")).alias("train_number"),
        blank(F.col("ctx.catOutS")).alias("category"), blank(F.col("ctx.line")).alias("line"),
        F.when(F.col("btype") == "DEP", F.col("j.dirTxt")).alias("final_dest"),
        ap.alias("arr_plan"), parse_board_time("j.date", st.aTimeR).alias("arr_real"),
        dp.alias("dep_plan"), parse_board_time("j.date", st.dTimeR).alias("dep_real"),
        F.when(F.coalesce(st.aCncl, F.lit(False)), 1).otherwise(0).alias("arr_cncl"),
        F.when(F.coalesce(st.dCncl, F.lit(False)), 1).otherwise(0).alias("dep_cncl"))


TRIP_SCHEMA = ("trip_update STRUCT<trip: STRUCT<trip_id: STRING, start_date: STRING, schedule_relationship: INT>, "
               "stop_time_update: ARRAY<STRUCT<stop_id: STRING, arrival: STRUCT<time: BIGINT, delay: BIGINT>, "
               "departure: STRUCT<time: BIGINT, delay: BIGINT>, schedule_relationship: INT>>>")


def trip_updates(entities: DataFrame, json_col: str = "entity") -> DataFrame:
    """Trip-update entities -> stop rows. A cancelled trip without stop updates keeps
    one marker row with an empty stop; rows without times are dropped unless the stop is
    skipped or the trip cancelled."""
    from latewise.functions.keys import fr_train_number, stop_uic8
    e = entities.select(F.from_json(F.col(json_col), TRIP_SCHEMA).alias("e")).select(F.col("e.trip_update").alias("tu"))
    e = e.filter(F.col("tu").isNotNull())
    trip_rel = F.col("tu.trip.schedule_relationship")
    stus = F.coalesce(F.col("tu.stop_time_update"), F.array())
    marker = (F.size(stus) == 0) & (trip_rel == 3)
    e = e.withColumn("stus", F.when(marker, F.array(F.struct(
        F.lit("").alias("stop_id"), F.lit(None).cast("struct<time: bigint, delay: bigint>").alias("arrival"),
        F.lit(None).cast("struct<time: bigint, delay: bigint>").alias("departure"),
        F.lit(None).cast("int").alias("schedule_relationship")))).otherwise(stus)).withColumn("marker", marker)
    r = e.select("tu", "marker", F.explode("stus").alias("s"))
    keep = (F.col("s.arrival.time").isNotNull() | F.col("s.departure.time").isNotNull()
            | F.coalesce(F.col("s.schedule_relationship") == 1, F.lit(False)) | (F.col("tu.trip.schedule_relationship") == 3))
    r = r.filter(keep)
    return r.select(F.col("tu.trip.start_date").alias("start_date"), F.col("tu.trip.trip_id").alias("trip_id"),
                    F.col("s.stop_id").alias("stop_id"), fr_train_number(F.col("tu.trip.trip_id")).alias("train_number"),
                    F.when(~F.col("marker"), stop_uic8(F.col("s.stop_id"))).alias("uic8"),
                    F.col("s.arrival.time").alias("arr_time"), F.col("s.arrival.delay").alias("arr_delay"),
                    F.col("s.departure.time").alias("dep_time"), F.col("s.departure.delay").alias("dep_delay"),
                    F.col("tu.trip.schedule_relationship").alias("trip_rel"),
                    F.col("s.schedule_relationship").alias("stop_rel"))


NL_TRIP_SCHEMA = ("trip_update STRUCT<trip: STRUCT<start_date: STRING, schedule_relationship: INT, ext: STRUCT<realtime_id: STRING>>, "
                  "ext: STRUCT<headsign: STRING>, "
                  "stop_time_update: ARRAY<STRUCT<ext: STRUCT<station_id: STRING>, arrival: STRUCT<time: BIGINT, delay: BIGINT>, "
                  "departure: STRUCT<time: BIGINT, delay: BIGINT>, schedule_relationship: INT>>>")


def trip_updates_nl(entities: DataFrame, json_col: str = "entity") -> DataFrame:
    """N5, NL flavour (landed as JSON, the feed's extension fields by name): entities without an
    ``IFF:type:number`` identity are dropped, as are stops without a station id; ids are
    lower-cased; a cancelled trip without stop updates keeps one marker row with an empty
    station; rows without times stay only if the stop is skipped or the trip cancelled."""
    from latewise.functions.keys import realtime_id_parts
    tu = entities.select(F.from_json(F.col(json_col), NL_TRIP_SCHEMA).alias("e")).select("e.trip_update.*")
    tu = tu.withColumn("id", realtime_id_parts("trip.ext.realtime_id")).filter(F.col("id").isNotNull())
    trip_rel = F.col("trip.schedule_relationship")
    marker = (F.size(F.coalesce("stop_time_update", F.array())) == 0) & (trip_rel == 3)
    stops = tu.select("id", "trip", F.col("ext.headsign").alias("headsign"), F.explode("stop_time_update").alias("s"))
    stops = stops.withColumn("station_code", F.lower("s.ext.station_id")).filter(F.col("station_code") != "")
    keep = (F.col("s.arrival.time").isNotNull() | F.col("s.departure.time").isNotNull()
            | F.coalesce(F.col("s.schedule_relationship") == 1, F.lit(False)) | F.coalesce(trip_rel == 3, F.lit(False)))
    cols = ["trip.start_date", "id.train_key", "station_code", "id.train_number", "id.train_type", "headsign"]
    rows = stops.filter(keep).select(
        *cols, F.col("s.arrival.time").alias("arr_time"), F.col("s.arrival.delay").alias("arr_delay"), F.col("s.departure.time").alias("dep_time"),
        F.col("s.departure.delay").alias("dep_delay"), trip_rel.alias("trip_rel"), F.col("s.schedule_relationship").alias("stop_rel"))
    none = [F.lit(None).cast("long").alias(c) for c in ("arr_time", "arr_delay", "dep_time", "dep_delay")]
    bare = tu.filter(marker).withColumns({"station_code": F.lit(""), "headsign": F.col("ext.headsign")}).select(
        *cols, *none, trip_rel.alias("trip_rel"), F.lit(None).cast("int").alias("stop_rel"))
    return rows.unionByName(bare)
