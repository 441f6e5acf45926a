"""Per-country source rows derived from the fixture, in each feed's own shape.

The national normalisers need their native inputs (Swiss CSV text, the NL archive's
columns, board and trip-update observations, crosswalks). These builders derive them
from the newest responses by arithmetic; the oracle rebuilds them the same way.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewise.functions.keys import fr_train_number, stop_uic8, strip_zeros
from latewise.functions.timefn import minute_diff, seconds_between

# The NL archive's service-type names mapped to the live feed's codes.
NL_TYPE_MAP = {
    "Intercity": "IC", "Sprinter": "SPR", "Stoptrein": "ST", "Sneltrein": "S", "Intercity direct": "ICD",
    "ICE": "ICE", "EuroCity": "ECC", "Eurocity Direct": "ECD", "Eurostar": "EST", "Nightjet": "NJ", "GoVolta": "GV",
}
# Fixture values (our own): archive service types and CH forecast states by index.
NL_SERVICE_TYPES = ["Intercity", "Sprinter", "Bus", "Stoptrein ipv trein", "ICE", "Thalys"]
CH_STATUS = ["REAL", "GESCHAETZT", "PROGNOSE", "UNBEKANNT"]
FR_BRANDS = ["TER", "TGV", "IC", "X"]


def _pick(values, idx) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _x() -> Column:
    """Five-digit station number of the fixture's eva (without the country prefix)."""
    return F.substring("eva", 4, 5)


def _st_idx() -> Column:
    return F.expr("(sk div 6) % 12")


def ch_raw(latest: DataFrame) -> DataFrame:
    ok, ln, pk = F.col("ok"), F.col("ln"), F.col("pk")
    fmt = lambda c, f: F.date_format(F.col(c), f)
    return latest.select(
        F.date_format(F.coalesce("arrival_planned_time", "departure_planned_time"), "dd.MM.yyyy").alias("BETRIEBSTAG"),
        F.concat(F.lit("85:11:"), ok.cast("string")).alias("FAHRT_BEZEICHNER"),
        F.when(pk % 9 == 0, F.lit("Bus")).otherwise(F.lit("Zug")).alias("PRODUKT_ID"),
        F.col("train_number").alias("LINIEN_ID"),
        F.coalesce(F.col("line_number"), F.concat(F.col("train_type"), (pk % 9).cast("string"))).alias("LINIEN_TEXT"),
        F.when((F.col("train_type") == "S") & (ok % 2 == 0), F.lit("SN")).otherwise(F.col("train_type")).alias("VERKEHRSMITTEL_TEXT"),
        F.when(F.col("is_canceled"), F.lit("true")).otherwise(F.lit("false")).alias("FAELLT_AUS_TF"),
        strip_zeros("eva").alias("BPUIC"),
        F.col("station_name").alias("HALTESTELLEN_NAME"),
        F.when(ln % 2 == 0, fmt("arrival_planned_time", "dd.MM.yyyy HH:mm"))
         .otherwise(fmt("arrival_planned_time", "dd.MM.yyyy HH:mm:ss")).alias("ANKUNFTSZEIT"),
        fmt("arrival_change_time", "dd.MM.yyyy HH:mm:ss").alias("AN_PROGNOSE"),
        _pick(CH_STATUS, ok % 4).alias("AN_PROGNOSE_STATUS"),
        fmt("departure_planned_time", "dd.MM.yyyy HH:mm").alias("ABFAHRTSZEIT"),
        fmt("departure_change_time", "dd.MM.yyyy HH:mm:ss").alias("AB_PROGNOSE"),
        F.when((ln == 5) & (ok % 7 == 0), F.lit("true")).when(ok % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.lit("false")).alias("DURCHFAHRT_TF"))


def nl_raw(latest: DataFrame) -> DataFrame:
    ok, ln, pk = F.col("ok"), F.col("ln"), F.col("pk")
    code = F.concat(F.lit("c"), _x())
    canc = F.col("is_canceled")
    return latest.select(
        ok.alias("Service:RDT-ID"),
        F.to_date(F.coalesce("arrival_planned_time", "departure_planned_time")).alias("Service:Date"),
        _pick(NL_SERVICE_TYPES, pk % 6).alias("Service:Type"),
        F.when(pk % 23 == 0, F.lit(None).cast("long")).otherwise(pk % 40).alias("Service:Train number"),
        (canc & (ok % 2 == 0)).alias("Service:Completely cancelled"),
        F.col("id").alias("Stop:RDT-ID"),
        F.when((ln == 4) & (ok % 5 == 0), F.lit(None).cast("string"))
         .when(ok % 3 == 0, F.upper(code)).otherwise(code).alias("Stop:Station code"),
        F.when((ln == 3) & (ok % 4 == 1), F.lit(None).cast("string")).otherwise(F.col("station_name")).alias("Stop:Station name"),
        F.col("arrival_planned_time").alias("Stop:Arrival time"),
        minute_diff("arrival_planned_time", "arrival_change_time").alias("Stop:Arrival delay"),
        (canc & (ok % 2 == 1) & (ln % 2 == 0)).alias("Stop:Arrival cancelled"),
        F.col("departure_planned_time").alias("Stop:Departure time"),
        minute_diff("departure_planned_time", "departure_change_time").alias("Stop:Departure delay"),
        (canc & (ok % 2 == 1) & (ln % 2 == 1)).alias("Stop:Departure cancelled"))


def station_dim(latest: DataFrame, prefix: str, code: Column, skip_idx: int) -> DataFrame:
    """Crosswalk of the stations seen, for one country (one station index left out)."""
    return (latest.filter(_st_idx() != skip_idx)
            .select(code.alias("code"), F.concat(F.lit(prefix), _x()).alias("eva"),
                    F.col("xml_station_name").alias("name")).distinct())


def nl_crosswalk(latest):
    return station_dim(latest, "084", F.concat(F.lit("c"), _x()), 11)


def at_stations(latest):
    return latest.filter(_st_idx() != 10).select("eva", F.col("xml_station_name").alias("name")).distinct()


def fr_crosswalk(latest):
    return station_dim(latest, "087", F.concat(F.lit("87"), _x(), F.lit("0")), 9)


def it_stations(latest):
    return station_dim(latest, "083", F.concat(F.lit("S"), _x()), 8)


def type_map(spark) -> DataFrame:
    return spark.createDataFrame(list(NL_TYPE_MAP.items()), "src string, code string")


def at_obs(latest: DataFrame) -> DataFrame:
    ln = F.col("ln")
    canc = F.col("is_canceled")
    return latest.select(
        F.date_format(F.coalesce("arrival_planned_time", "departure_planned_time"), "yyyyMMdd").alias("day"),
        "eva", F.col("id").alias("zi"), "train_number", F.lower("train_type").alias("category"),
        F.col("line_number").alias("line"),
        F.when(ln % 2 == 1, F.col("final_destination_station")).alias("final_dest"),
        F.col("arrival_planned_time").alias("arr_plan"), F.col("arrival_change_time").alias("arr_real"),
        F.col("departure_planned_time").alias("dep_plan"), F.col("departure_change_time").alias("dep_real"),
        (canc & (ln % 2 == 0)).cast("int").alias("arr_cncl"), (canc & (ln % 2 == 1)).cast("int").alias("dep_cncl"))


def _epoch_of_local(c: str) -> Column:
    utc = F.convert_timezone(F.lit("Europe/Berlin"), F.lit("UTC"), F.col(c))
    return seconds_between(F.lit(_dt.datetime(1970, 1, 1)), utc)


def fr_obs(latest: DataFrame) -> DataFrame:
    ok, ln, pk = F.col("ok"), F.col("ln"), F.col("pk")
    trip = F.when(ok % 97 == 0, F.concat(F.lit("OCE"), ok.cast("string"), F.lit(":TER:FR"))).otherwise(
        F.concat(F.lit("OCESN"), F.lpad((pk % 40).cast("string"), 6, "0"), F.lit("F"), ok.cast("string"),
                 F.lit(":"), _pick(FR_BRANDS, pk % 4), F.lit(":FR")))
    stop_id = F.concat(F.lit("StopPoint:OCETrain TER-87"), _x(), F.lit("0"))
    base = latest.select(
        F.date_format(F.coalesce("arrival_planned_time", "departure_planned_time"), "yyyyMMdd").alias("start_date"),
        trip.alias("trip_id"), stop_id.alias("stop_id"),
        _epoch_of_local("arrival_change_time").alias("arr_time"),
        seconds_between("arrival_planned_time", "arrival_change_time").alias("arr_delay"),
        _epoch_of_local("departure_change_time").alias("dep_time"),
        seconds_between("departure_planned_time", "departure_change_time").alias("dep_delay"),
        F.when(F.col("is_canceled") & (ln == 1), F.lit(3)).otherwise(F.lit(0)).alias("trip_rel"),
        F.when((ln == 6) & (ok % 3 == 0), F.lit(1)).otherwise(F.lit(0)).alias("stop_rel"),
        ((ln == 1) & (ok % 17 == 0)).alias("_marker"))
    marker = base.filter("_marker").select(
        "start_date", "trip_id", F.lit("").alias("stop_id"), *[F.lit(None).cast("long").alias(c) for c in
                                                               ("arr_time", "arr_delay", "dep_time", "dep_delay")],
        F.lit(3).alias("trip_rel"), F.lit(None).cast("int").alias("stop_rel"), F.lit(True).alias("_marker"))
    rows = base.unionByName(marker).drop("_marker")
    return (rows.withColumn("train_number", fr_train_number("trip_id"))
            .withColumn("station_code", stop_uic8("stop_id")))


def it_obs(latest: DataFrame) -> DataFrame:
    ok, ln, pk, sk = F.col("ok"), F.col("ln"), F.col("pk"), F.col("sk")
    canc = F.col("is_canceled").cast("int")
    return latest.select(
        F.date_format(F.coalesce("arrival_planned_time", "departure_planned_time"), "yyyyMMdd").alias("day"),
        F.concat(F.lit("S"), F.lpad((sk % 100000).cast("string"), 5, "0"), F.lit("-"), (pk % 40).cast("string"),
                 F.lit("-"), ok.cast("string")).alias("train_key"),
        F.concat(F.lit("S"), _x()).alias("stop_code"), (ln - 1).alias("stop_num"),
        F.when(pk % 19 == 0, F.lit("")).otherwise(F.col("train_number")).alias("number"),
        F.col("train_type").alias("category"), F.col("final_destination_station").alias("dest"),
        F.col("arrival_planned_time").alias("arr_plan"), F.col("arrival_change_time").alias("arr_real"),
        F.col("departure_planned_time").alias("dep_plan"), F.col("departure_change_time").alias("dep_real"),
        canc.alias("arr_cncl"), canc.alias("dep_cncl"))


# -- station universes, seeds and landed lookup answers ---------------------------------

COUNTRIES = ["NL", "BE", "DE", "FR", "CH", "AT"]


def station_list_raw(latest: DataFrame) -> DataFrame:
    """A station list file (S7): codes with blanks, case and duplicates; file order = order and line."""
    ok = F.col("ok")
    code = F.concat(F.lit("c"), _x())
    return latest.select(
        F.when(ok % 5 == 0, F.concat(F.lit(" "), F.upper(code), F.lit(" "))).when(ok % 5 == 1, F.lit(""))
         .when(ok % 5 == 2, F.lit(None).cast("string")).otherwise(code).alias("code"),
        F.concat(F.lit("84"), _x()).alias("uic"), F.col("station_name").alias("name_long"),
        _pick(COUNTRIES, F.col("sk") % 6).alias("country"), (ok * 10 + F.col("ln")).alias("line_no"))


def _code() -> Column:
    return F.when(_st_idx() == 3, F.concat(F.lit("N"), _x())).otherwise(F.concat(F.lit("S"), _x()))


def it_universe(latest):
    return latest.select(_code().alias("code"), F.col("xml_station_name").alias("name"),
                         F.when(_st_idx() % 4 == 0, 1).otherwise(2).alias("tipo")).distinct()


def it_existing(latest):
    return (latest.filter(_st_idx().isin(0, 1))
            .select(_code().alias("code"), F.concat(F.lit("083"), _x()).alias("eva"),
                    F.col("xml_station_name").alias("name")).distinct())


def it_seed(latest):
    return (latest.filter((_st_idx() <= 7) & (_st_idx() != 3))
            .select(_code().alias("code"),
                    F.when(_st_idx() == 5, F.lit("08399999")).otherwise(F.concat(F.lit("083"), _x())).alias("eva"),
                    F.col("xml_station_name").alias("name"), (_st_idx() % 3 == 0).alias("main")).distinct())


def it_candidates(latest):
    u = latest.select(_code().alias("code"), F.col("xml_station_name").alias("name"), _x().alias("x"),
                      _st_idx().alias("st")).distinct()
    u = u.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(3))))
    r = F.col("rank")
    token = F.when(r == 1, F.concat(F.lit("85"), "x")).otherwise(F.concat(F.lit("83"), "x"))
    ext = (F.when(r == 1, F.concat(F.lit("85"), "x"))
           .when(r == 2, F.when(F.col("st") == 6, F.lit("")).otherwise(F.concat(F.lit("83"), "x")))
           .otherwise(F.concat(F.lit("830"), "x")))
    return u.select("code", "rank", F.concat(F.lit("A=1@O="), "name", F.lit("@i=U.00"), token, F.lit("@")).alias("loc_id"),
                    ext.alias("ext_id"), F.concat("name", F.lit(" ("), r.cast("string"), F.lit(")")).alias("c_name"))


def it_board_counts(latest):
    return latest.groupBy(_code().alias("code")).agg(F.count(F.lit(1)).alias("n"))


def gtfs_tables(latest):
    """stops, routes, trips, stop_times of a static timetable, all columns text."""
    ok, sk = F.col("ok"), F.col("sk")
    child = latest.select(
        F.concat(F.lit("sp"), "eva").alias("stop_id"),
        F.when(sk % 6 < 3, F.concat(F.lit("P"), _x())).alias("parent_station"),
        F.col("xml_station_name").alias("stop_name"),
        F.concat(F.lit("47."), F.lpad((_st_idx() * 37 + sk % 6).cast("string"), 3, "0")).alias("stop_lat"),
        F.concat(F.lit("9."), F.lpad((_st_idx() * 53).cast("string"), 3, "0")).alias("stop_lon")).distinct()
    parent = latest.select(
        F.concat(F.lit("P"), _x()).alias("stop_id"), F.lit(None).cast("string").alias("parent_station"),
        F.concat("xml_station_name", F.when(_st_idx() % 4 == 1, " Bahnhof").when(_st_idx() % 4 == 2, "  Bahnhst").otherwise("")).alias("stop_name"),
        F.concat(F.lit("47."), F.lpad((_st_idx() * 37).cast("string"), 3, "0")).alias("stop_lat"),
        F.concat(F.lit("9."), F.lpad((_st_idx() * 53).cast("string"), 3, "0")).alias("stop_lon")).distinct()
    stops = child.unionByName(parent)
    routes = latest.select(F.concat(F.lit("r"), (ok % 40).cast("string")).alias("route_id"),
                           F.when((ok % 40) % 5 == 0, F.lit("3")).otherwise(F.lit("2")).alias("route_type")).distinct()
    trips = latest.select(F.concat(F.lit("t"), ok.cast("string")).alias("trip_id"),
                          F.concat(F.lit("r"), (ok % 40).cast("string")).alias("route_id")).distinct()
    stop_times = latest.select(F.concat(F.lit("t"), ok.cast("string")).alias("trip_id"),
                               F.concat(F.lit("sp"), "eva").alias("stop_id"))
    return stops, routes, trips, stop_times


def geo_candidates(stops: DataFrame) -> DataFrame:
    """Landed name-search answers: four candidates per station name, near and far."""
    base = (stops.filter(F.col("parent_station").isNull() & F.col("stop_id").startswith("P"))
            .select(F.regexp_replace("stop_name", r"\s+(Bahnhof|Bahnhst)$", "").alias("query"), F.substring("stop_id", 2, 5).alias("x"),
                    F.col("stop_lat").cast("double").alias("lat"), F.col("stop_lon").cast("double").alias("lon"),
                    F.substring("stop_id", 5, 2).cast("int").alias("st")))
    b = base.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(4))))
    r = F.col("rank")
    return b.select(
        "query", "rank",
        F.when(r == 1, F.lit("POI")).otherwise(F.lit("ST")).alias("type"),
        F.when(r == 2, F.concat(F.lit("80"), "x")).otherwise(F.concat(F.lit("81"), "x")).alias("ext_id"),
        F.when(r == 3, F.when(F.col("st") % 2 == 0, F.array(F.lit("BUS"))).otherwise(F.array(F.lit("REGIONAL"))))
         .otherwise(F.array(F.lit("ICE"), F.lit("BUS"))).alias("products"),
        (F.col("lat") + F.when(r == 4, F.when(F.col("st") % 3 == 0, F.lit(0.05)).otherwise(F.lit(0.005)))
         .otherwise(F.lit(0.001))).alias("c_lat"),
        F.col("lon").alias("c_lon"),
        F.concat("query", F.lit(" Hbf")).alias("c_name"))


# -- IT run snapshots and board rows ------------------------------------------------------

def _ms_rome(c: str) -> Column:
    return _ms_rome_of(F.col(c))


def _ms_rome_of(c: Column) -> Column:
    """Epoch ms of a local time in Rome, whole seconds (sessions run in UTC)."""
    return F.unix_seconds(F.to_utc_timestamp(c.cast("timestamp_ltz"), "Europe/Rome")) * 1000


def it_runs(latest: DataFrame, *more: Column) -> DataFrame:
    """Per run (order): origin, number, category, destination, departure ms, and the aggregates ``more``."""
    first_t = F.min_by(F.coalesce("departure_planned_time", "arrival_planned_time"), "ln")
    r = latest.groupBy("ok").agg(first_t.alias("first_t"), F.min_by(F.concat(F.lit("S"), _x()), "ln").alias("origin"),
                                 F.min_by("train_type", "ln").alias("category"),
                                 F.min_by("final_destination_station", "ln").alias("dest"), *more)
    extra = r.columns[5:]
    r = r.select(
        *extra, "ok", "origin", "category", "dest", (F.col("ok") % 900 + 100).cast("string").alias("number"),
        F.when(F.col("ok") % 23 == 0, 1).otherwise(0).alias("provv"),
        F.date_format("first_t", "yyyyMMdd").alias("day"),
        _ms_rome_of(F.col("first_t")).alias("dep_ms"))
    return r.withColumn("train_key", F.concat_ws("-", "origin", "number", F.col("dep_ms").cast("string")))


def it_run_payloads(latest: DataFrame) -> DataFrame:
    ok, ln = F.col("ok"), F.col("ln")
    shift = F.when((ln >= 4) & (ok % 5 == 0), F.lit(86_400_000)).otherwise(F.lit(0))
    f = F.struct(
        F.when((ln == 3) & (ok % 5 == 0), F.lit(None).cast("string")).otherwise(F.concat(F.lit("S"), _x())).alias("id"),
        (_ms_rome("arrival_planned_time") - shift).alias("arrivo_teorico"),
        (_ms_rome("arrival_change_time") - shift).alias("arrivoReale"),
        (_ms_rome("departure_planned_time") - shift).alias("partenza_teorica"),
        (_ms_rome("departure_change_time") - shift).alias("partenzaReale"),
        F.when((ln == 2) & (ok % 6 == 0), 3).otherwise(0).alias("actualFermataType"))
    r = it_runs(latest, F.sort_array(F.collect_list(F.struct("ln", f.alias("f")))).alias("fs"))
    payload = F.to_json(F.struct(
        F.col("number").alias("numeroTreno"), F.col("category").alias("categoria"), F.col("dest").alias("destinazione"),
        F.col("provv").alias("provvedimento"), F.col("dep_ms").alias("dataPartenzaTreno"),
        F.transform("fs", lambda x: x.f).alias("fermate")))
    return r.select("day", "train_key", "number", payload.alias("payload"))


def it_board_rows(latest: DataFrame) -> DataFrame:
    ok = F.col("ok")
    r = it_runs(latest).select("ok", F.col("origin").alias("r_origin"), F.col("number").alias("r_number"), "dep_ms")
    b = latest.join(r, "ok")
    fetch = (_ms_rome_of(F.coalesce("arrival_planned_time", "departure_planned_time")) / 1000).cast("long") - 3600
    return b.select(F.when(ok % 31 == 0, F.lit("")).otherwise(F.col("r_number")).alias("num"),
                    F.when(ok % 29 == 0, F.lit(None).cast("string")).otherwise(F.col("r_origin")).alias("origin"),
                    "dep_ms", F.col("train_type").alias("category"), fetch.alias("fetch_ts"),
                    F.col("ln").alias("seq"), F.col("id").alias("board_id"))


# -- AT station boards and FR trip-update entities ----------------------------------------

def at_boards(latest: DataFrame) -> DataFrame:
    """One board JSON per (station, hour, board type); product list per board; some
    journeys carry an invalid product index or no run id."""
    ok, ln = F.col("ok"), F.col("ln")
    base = latest.withColumn("day", F.date_format(F.coalesce("arrival_planned_time", "departure_planned_time"), "yyyyMMdd")) \
        .withColumn("btype", F.when(ln % 2 == 0, F.lit("ARR")).otherwise(F.lit("DEP"))) \
        .withColumn("hour", F.hour(F.coalesce("arrival_planned_time", "departure_planned_time")))
    base = base.withColumn("prod", F.struct(F.struct(F.when(ok % 9 == 0, F.lit(" ")).otherwise(F.col("train_number")).alias("num"),
                                                     F.lower("train_type").alias("catOutS"),
                                                     F.col("line_number").alias("line")).alias("prodCtx")))
    # a board is cut into parts of a bounded size, as a hub hour grows with the data
    base = base.withColumn("part", F.floor((ok * 10 + ln) / 4096))
    key = ["eva", "day", "btype", "hour", "part"]
    w = F.struct("id", "prod", "ok", "ln", "day", "arrival_planned_time", "arrival_change_time",
                 "departure_planned_time", "departure_change_time", "is_canceled", "final_destination_station")
    g = base.groupBy(*key).agg(F.sort_array(F.collect_list(w)).alias("rows"))
    g = g.withColumn("prodL", F.transform("rows", lambda r: r.prod))
    jny = F.transform("rows", lambda r, i: F.struct(
        F.when(r.ln == 5, F.lit(None).cast("string")).otherwise(r.day).alias("date"),
        F.when(r.ok % 13 == 0, F.concat(F.lit("1|x|"), r.ok.cast("string"))).otherwise(
            F.concat(F.lit("1|#ZI#"), (r.ok * 10 + r.ln).cast("string"), F.lit("#"))).alias("jid"),
        F.when(r.ok % 11 == 0, F.size("rows") + 1).otherwise(i).alias("prodX"),
        r.final_destination_station.alias("dirTxt"),
        F.struct(_hafas_f(r.arrival_planned_time, r.day).alias("aTimeS"), _hafas_f(r.arrival_change_time, r.day).alias("aTimeR"),
                 _hafas_f(r.departure_planned_time, r.day).alias("dTimeS"), _hafas_f(r.departure_change_time, r.day).alias("dTimeR"),
                 (r.is_canceled & (r.ln % 2 == 0)).alias("aCncl"), (r.is_canceled & (r.ln % 2 == 1)).alias("dCncl")).alias("stbStop")))
    payload = F.to_json(F.struct(F.struct(F.struct(F.col("prodL").alias("prodL")).alias("common"), jny.alias("jnyL")).alias("res")))
    return g.select("eva", "btype", "day", "hour", payload.alias("payload"))


def _hafas_f(ts: Column, day: Column) -> Column:
    d = F.datediff(F.to_date(ts), F.to_date(day, "yyyyMMdd"))
    hms = F.date_format(ts, "HHmmss")
    return F.when(ts.isNull(), F.lit(None)).when(d == 0, hms).otherwise(F.concat(F.lpad(d.cast("string"), 2, "0"), hms))


def fr_entities(latest: DataFrame) -> DataFrame:
    """One trip-update entity per trip and service day (JSON), plus bare cancellation
    entities without stop updates."""
    o = fr_obs(latest)
    rows = o.filter(F.col("stop_id") != "")
    stu = F.struct(F.col("stop_id"),
                   F.when(F.col("arr_time").isNotNull() | F.col("arr_delay").isNotNull(),
                          F.struct(F.col("arr_time").alias("time"), F.col("arr_delay").alias("delay"))).alias("arrival"),
                   F.when(F.col("dep_time").isNotNull() | F.col("dep_delay").isNotNull(),
                          F.struct(F.col("dep_time").alias("time"), F.col("dep_delay").alias("delay"))).alias("departure"),
                   F.col("stop_rel").alias("schedule_relationship"))
    g = rows.groupBy("start_date", "trip_id").agg(F.max("trip_rel").alias("trip_rel"),
                                                  F.sort_array(F.collect_list(stu)).alias("stus"))
    marks = o.filter(F.col("stop_id") == "").select("start_date", "trip_id", "trip_rel").distinct() \
        .withColumn("stus", F.array().cast(g.schema["stus"].dataType))
    ent = g.unionByName(marks)
    e = F.to_json(F.struct(F.struct(F.struct("trip_id", "start_date", F.col("trip_rel").alias("schedule_relationship")).alias("trip"),
                                    F.col("stus").alias("stop_time_update")).alias("trip_update")))
    return ent.select(e.alias("entity"))


def nl_obs(latest: DataFrame) -> DataFrame:
    """NL live observations: keyed by ``type:number`` and IFF station code; same time,
    cancellation and marker rules as the FR feed."""
    ok, ln = F.col("ok"), F.col("ln")
    code = F.when(ok % 3 == 0, F.upper(F.concat(F.lit("c"), _x()))).otherwise(F.concat(F.lit("c"), _x()))
    base = latest.select(
        F.date_format(F.coalesce("arrival_planned_time", "departure_planned_time"), "yyyyMMdd").alias("start_date"),
        F.concat_ws(":", "train_type", "train_number").alias("train_key"),
        strip_zeros("train_number").alias("train_number"), "train_type",
        F.col("final_destination_station").alias("headsign"), code.alias("station_code"),
        _epoch_of_local("arrival_change_time").alias("arr_time"),
        seconds_between("arrival_planned_time", "arrival_change_time").alias("arr_delay"),
        _epoch_of_local("departure_change_time").alias("dep_time"),
        seconds_between("departure_planned_time", "departure_change_time").alias("dep_delay"),
        F.when(F.col("is_canceled") & (ln == 1), F.lit(3)).otherwise(F.lit(0)).alias("trip_rel"),
        F.when((ln == 6) & (ok % 3 == 1), F.lit(1)).otherwise(F.lit(0)).alias("stop_rel"))
    return base


def nl_entities(latest: DataFrame) -> DataFrame:
    """NL trip-update entities as landed JSON, one per train and service day: the identity and
    station ids in the feed's extension fields; every seventh number is an added service
    without the feed's identity, some stops lack a station id, and cancelled trains of one
    type come without stops."""
    o = nl_obs(latest)
    number = F.element_at(F.split("train_key", ":"), 2)
    rid = F.when(number.cast("int") % 7 == 3, F.concat(F.lit("ADD:"), "train_key")).otherwise(F.concat(F.lit("IFF:"), "train_key"))
    side = lambda t, d: F.when(F.col(t).isNotNull() | F.col(d).isNotNull(), F.struct(F.col(t).alias("time"), F.col(d).alias("delay")))
    stu = F.struct(F.struct(F.when(F.col("arr_delay") == 0, F.lit("")).otherwise(F.col("station_code")).alias("station_id")).alias("ext"),
                   side("arr_time", "arr_delay").alias("arrival"), side("dep_time", "dep_delay").alias("departure"),
                   F.col("stop_rel").alias("schedule_relationship"))
    g = o.groupBy("start_date", "train_key", "train_type").agg(
        F.max("trip_rel").alias("trip_rel"), F.max("headsign").alias("headsign"), F.sort_array(F.collect_list(stu)).alias("stus"))
    bare = (F.col("trip_rel") == 3) & (F.col("train_type") == "IC")
    e = F.struct(F.struct(
        F.struct("start_date", F.col("trip_rel").alias("schedule_relationship"), F.struct(rid.alias("realtime_id")).alias("ext")).alias("trip"),
        F.struct("headsign").alias("ext"), F.when(~bare, F.col("stus")).alias("stop_time_update")).alias("trip_update"))
    return g.select(F.to_json(e).alias("entity"))
