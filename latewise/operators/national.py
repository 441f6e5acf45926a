"""National sources -> the 17-column stop event.

Each normaliser is one projection over its source rows plus joins with small station
dimensions (crosswalks are bounded by the number of stations of a country). The joins
are left to Spark's planner: AQE turns them into broadcast joins after measuring the
dimension side at runtime; nothing is broadcast on trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewise.functions.keys import at_train_key, ch_train_key, strip_zeros
from latewise.functions.timefn import (epoch_to_local, minute_diff, parse_local_time, round_minutes,
                                       seconds_between)
from latewise.operators.dedup import run_final_stop
from latewise.schema import CORE_COLUMNS



def _ns() -> Column:
    return F.lit(None).cast("string")


def _ni() -> Column:
    return F.lit(None).cast("int")


def _time(*cols: str) -> Column:
    return F.coalesce(*[F.col(c) for c in cols])


def ch_normalise(raw: DataFrame) -> DataFrame:
    """Swiss daily CSV (all text). Keep trains, not pass-through (a NULL flag drops
    the row), Swiss ids, planned arrival present, and cancelled or a REAL/GESCHAETZT
    actual arrival. Delay = arrival difference only; cancelled rows lose change times."""
    t = (raw.withColumn("ank_plan", parse_local_time("ANKUNFTSZEIT"))
         .withColumn("ank_real", parse_local_time("AN_PROGNOSE"))
         .withColumn("abf_plan", parse_local_time("ABFAHRTSZEIT"))
         .withColumn("abf_real", parse_local_time("AB_PROGNOSE")))
    canc = F.col("FAELLT_AUS_TF") == "true"
    keep = ((F.col("PRODUKT_ID") == "Zug") & (F.col("DURCHFAHRT_TF") != "true") & F.col("BPUIC").startswith("85")
            & F.col("ank_plan").isNotNull()
            & (canc | (F.col("ank_real").isNotNull() & F.col("AN_PROGNOSE_STATUS").isin("REAL", "GESCHAETZT"))))
    return t.filter(keep).select(
        F.col("HALTESTELLEN_NAME").alias("station_name"), _ns().alias("xml_station_name"),
        F.lpad("BPUIC", 8, "0").alias("eva"),
        ch_train_key("VERKEHRSMITTEL_TEXT", "LINIEN_TEXT", "LINIEN_ID").alias("train_number"),
        F.col("LINIEN_TEXT").alias("line_number"), _ns().alias("final_destination_station"),
        minute_diff("ank_plan", "ank_real").alias("delay_in_min"),
        _time("abf_real", "ank_real", "abf_plan", "ank_plan").alias("time"),
        canc.alias("is_canceled"), F.col("VERKEHRSMITTEL_TEXT").alias("train_type"),
        F.col("FAHRT_BEZEICHNER").alias("train_line_ride_id"), _ni().alias("train_line_station_num"),
        F.col("ank_plan").alias("arrival_planned_time"),
        F.when(~canc, F.col("ank_real")).alias("arrival_change_time"),
        F.col("abf_plan").alias("departure_planned_time"),
        F.when(~canc, F.col("abf_real")).alias("departure_change_time"),
        F.concat_ws(":", "FAHRT_BEZEICHNER", "BETRIEBSTAG", "BPUIC").alias("id"))


def type_map_join(df: DataFrame, type_map: DataFrame, src_col: str, out: str = "train_type") -> DataFrame:
    """Service type -> code, else keep the original (left join + coalesce)."""
    tm = type_map.select(F.col("src").alias("_src"), F.col("code").alias("_code"))
    return (df.join(tm, df[src_col] == tm._src, "left")
            .withColumn(out, F.coalesce("_code", F.col(src_col))).drop("_src", "_code"))


def crosswalk_join(df: DataFrame, crosswalk: DataFrame, code: Column) -> DataFrame:
    """Station code -> (eva, name); unmapped rows are dropped (inner join)."""
    cw = crosswalk.select(F.col("code").alias("_cw_code"), F.col("eva").alias("_cw_eva"), F.col("name").alias("_cw_name"))
    return df.join(cw, code == cw._cw_code).drop("_cw_code")


def nl_archive_normalise(raw: DataFrame, crosswalk: DataFrame, type_map: DataFrame) -> DataFrame:
    """NL archive rows. Replacement services and buses dropped; the station code is
    matched lower-cased; final destination = name of the run's last stop by time."""
    s = raw.filter(~F.col("`Service:Type`").like("%ipv trein%") & (F.col("`Service:Type`") != "Bus")
                   & F.col("`Stop:Station code`").isNotNull())
    s = crosswalk_join(s, crosswalk, F.lower(F.col("`Stop:Station code`")))
    s = type_map_join(s, type_map, "Service:Type")
    s = s.filter(F.col("`Service:Train number`").isNotNull())
    # the last stop is taken over the rows that survive the joins and filters above
    s = s.withColumn("_t", F.coalesce("`Stop:Departure time`", "`Stop:Arrival time`"))
    s = run_final_stop(s, "Service:RDT-ID", "Stop:Station name", "_t", "final_destination_station")
    whole = F.col("`Service:Completely cancelled`")
    a_c = whole | F.col("`Stop:Arrival cancelled`")
    d_c = whole | F.col("`Stop:Departure cancelled`")
    apt, dpt = F.col("`Stop:Arrival time`"), F.col("`Stop:Departure time`")
    act = F.when(~a_c, apt + F.make_dt_interval(mins=F.coalesce("`Stop:Arrival delay`", F.lit(0))))
    dct = F.when(~d_c, dpt + F.make_dt_interval(mins=F.coalesce("`Stop:Departure delay`", F.lit(0))))
    out = s.select(
        F.col("`Service:Date`").alias("svc_date"),
        F.col("_cw_name").alias("station_name"), _ns().alias("xml_station_name"), F.col("_cw_eva").alias("eva"),
        strip_zeros(F.col("`Service:Train number`").cast("string")).alias("train_number"),
        _ns().alias("line_number"), "final_destination_station",
        F.coalesce("`Stop:Departure delay`", "`Stop:Arrival delay`").cast("int").alias("delay_in_min"),
        (whole | F.col("`Stop:Arrival cancelled`") | F.col("`Stop:Departure cancelled`")).alias("is_canceled"),
        "train_type",
        F.concat(F.lit("NLA:"), F.col("`Service:RDT-ID`").cast("string")).alias("train_line_ride_id"),
        _ni().alias("train_line_station_num"),
        apt.alias("arrival_planned_time"), act.alias("arrival_change_time"),
        dpt.alias("departure_planned_time"), dct.alias("departure_change_time"),
        F.concat(F.lit("NLA:"), F.col("`Stop:RDT-ID`").cast("string")).alias("id"))
    out = out.withColumn("time", _time("departure_change_time", "arrival_change_time",
                                       "departure_planned_time", "arrival_planned_time"))
    return out.filter(F.col("time").isNotNull()).select("svc_date", *CORE_COLUMNS)


def at_normalise(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """Austrian board observations of a day. Unmapped stations and empty run numbers
    are dropped; cancelled rows lose change times but keep their delay (arrival
    difference, else departure, rounded half to even)."""
    num = at_train_key("category", "line", "train_number")
    st = stations.select(F.col("eva").alias("_eva"), F.col("name").alias("_name"))
    o = obs.withColumn("_num", num).filter(F.col("_num").isNotNull()).join(st, obs.eva == st._eva)
    canc = F.coalesce(F.col("arr_cncl") == 1, F.lit(False)) | F.coalesce(F.col("dep_cncl") == 1, F.lit(False))
    delay = F.coalesce(round_minutes(seconds_between("arr_plan", "arr_real")),
                       round_minutes(seconds_between("dep_plan", "dep_real")))
    act, dct = F.when(~canc, F.col("arr_real")), F.when(~canc, F.col("dep_real"))
    return o.select(
        F.col("_name").alias("station_name"), _ns().alias("xml_station_name"), F.col("eva"),
        F.col("_num").alias("train_number"), F.col("line").alias("line_number"),
        F.col("final_dest").alias("final_destination_station"), delay.alias("delay_in_min"),
        F.coalesce(dct, act, F.col("dep_plan"), F.col("arr_plan")).alias("time"),
        canc.alias("is_canceled"), F.col("category").alias("train_type"),
        F.concat(F.col("day"), F.lit(":"), F.col("zi")).alias("train_line_ride_id"), _ni().alias("train_line_station_num"),
        F.col("arr_plan").alias("arrival_planned_time"), act.alias("arrival_change_time"),
        F.col("dep_plan").alias("departure_planned_time"), dct.alias("departure_change_time"),
        F.concat_ws(":", "zi", F.date_format(F.to_date("day", "yyyyMMdd"), "yyyy-MM-dd"), "eva").alias("id"))


TRIP_CANCELED = 3
STOP_SKIPPED = 1


def with_trip_cancelled(obs: DataFrame, day: str, trip: str, rel: str = "trip_rel", out: str = "trip_canceled") -> DataFrame:
    """A trip cancelled in any row cancels every row of that trip on that day. The
    cancelled trips are collected by a distinct (partial before the shuffle) and joined back."""
    marked = obs.filter(F.col(rel) == TRIP_CANCELED).select(day, trip).distinct().withColumn(out, F.lit(True))
    return obs.join(marked, [day, trip], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def gtfsrt_normalise(obs: DataFrame, crosswalk: DataFrame, flavour: str = "FR") -> DataFrame:
    """FR/NL trip-update observations (epoch seconds + delay seconds). Planned =
    actual - delay (before the local conversion); rows without either planned side are
    dropped; FR needs a run number, its brand defaults to 'SNCF'."""
    trip = "trip_id" if flavour == "FR" else "train_key"
    o = with_trip_cancelled(obs, "start_date", trip, out="_trip_canc")
    cw = crosswalk.select(F.col("code").alias("_code"), F.col("eva").alias("_eva"), F.col("name").alias("_name"))
    o = o.join(cw, F.col("station_code") == cw._code)
    if flavour == "FR":
        o = o.filter(F.col("train_number").isNotNull() & (F.col("train_number") != ""))
    canc = F.col("_trip_canc") | F.coalesce(F.col("stop_rel") == STOP_SKIPPED, F.lit(False))
    ap = F.when(F.col("arr_time").isNotNull() & F.col("arr_delay").isNotNull(), epoch_to_local(F.col("arr_time") - F.col("arr_delay")))
    dp = F.when(F.col("dep_time").isNotNull() & F.col("dep_delay").isNotNull(), epoch_to_local(F.col("dep_time") - F.col("dep_delay")))
    o = o.withColumn("_ap", ap).withColumn("_dp", dp).filter(F.col("_ap").isNotNull() | F.col("_dp").isNotNull())
    act = F.when(~canc, epoch_to_local("arr_time"))
    dct = F.when(~canc, epoch_to_local("dep_time"))
    delay_s = F.coalesce("dep_delay", "arr_delay")
    if flavour == "FR":
        from latewise.functions.keys import fr_brand
        ttype, ride, head = fr_brand(F.col("trip_id")), F.col("trip_id"), _ns()
        sid = F.concat_ws(":", "trip_id", F.date_format(F.to_date("start_date", "yyyyMMdd"), "yyyy-MM-dd"), "stop_id")
    else:
        ttype, ride, head = F.col("train_type"), F.concat(F.lit("NL:"), "train_key"), F.col("headsign")
        sid = F.concat(F.lit("NL:"), F.concat_ws(":", "train_key", F.date_format(F.to_date("start_date", "yyyyMMdd"), "yyyy-MM-dd"),
                                                 "station_code"))
    return o.select(
        F.col("_name").alias("station_name"), _ns().alias("xml_station_name"), F.col("_eva").alias("eva"),
        "train_number", _ns().alias("line_number"), head.alias("final_destination_station"),
        round_minutes(delay_s).alias("delay_in_min"),
        F.coalesce(dct, act, F.col("_dp"), F.col("_ap")).alias("time"),
        canc.alias("is_canceled"), ttype.alias("train_type"), ride.alias("train_line_ride_id"),
        _ni().alias("train_line_station_num"),
        F.col("_ap").alias("arrival_planned_time"), act.alias("arrival_change_time"),
        F.col("_dp").alias("departure_planned_time"), dct.alias("departure_change_time"), sid.alias("id"))


def unmapped_code_report(obs: DataFrame, crosswalk: DataFrame, code: str = "station_code") -> DataFrame:
    """distinct non-numeric codes without a crosswalk entry."""
    o = obs.filter(F.col(code).isNotNull() & (F.col(code) != "") & ~F.col(code).rlike(r"^[0-9]+$"))
    return o.join(crosswalk, o[code] == crosswalk.code, "left_anti").select(F.col(code).alias("code")).distinct()


def it_normalise(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """Italian run observations; as F3, with the stop order kept."""
    st = stations.select(F.col("code").alias("_code"), F.col("eva").alias("_eva"), F.col("name").alias("_name"))
    o = obs.withColumn("_num", strip_zeros(F.coalesce("number", F.lit(""))))
    o = o.join(st, o.stop_code == st._code).filter(F.col("_num") != "")
    canc = F.coalesce(F.col("arr_cncl") == 1, F.lit(False)) | F.coalesce(F.col("dep_cncl") == 1, F.lit(False))
    delay = F.coalesce(round_minutes(seconds_between("arr_plan", "arr_real")),
                       round_minutes(seconds_between("dep_plan", "dep_real")))
    act, dct = F.when(~canc, F.col("arr_real")), F.when(~canc, F.col("dep_real"))
    return o.select(
        F.col("_name").alias("station_name"), _ns().alias("xml_station_name"), F.col("_eva").alias("eva"),
        F.col("_num").alias("train_number"), _ns().alias("line_number"), F.col("dest").alias("final_destination_station"),
        delay.alias("delay_in_min"), F.coalesce(dct, act, F.col("dep_plan"), F.col("arr_plan")).alias("time"),
        canc.alias("is_canceled"), F.col("category").alias("train_type"),
        F.concat(F.col("day"), F.lit(":"), F.col("train_key")).alias("train_line_ride_id"),
        F.col("stop_num").cast("int").alias("train_line_station_num"),
        F.col("arr_plan").alias("arrival_planned_time"), act.alias("arrival_change_time"),
        F.col("dep_plan").alias("departure_planned_time"), dct.alias("departure_change_time"),
        F.concat_ws(":", "train_key", F.date_format(F.to_date("day", "yyyyMMdd"), "yyyy-MM-dd"), "stop_code").alias("id"))


def shrink_guard(new_counts: DataFrame, old_counts: DataFrame, ratio: float = 0.5) -> DataFrame:
    """K5: per day, keep the existing day when the new build has fewer than ``ratio`` of
    its rows; an empty build writes nothing. Inputs: ``(day, rows)``."""
    n = new_counts.select("day", F.col("rows").alias("new_rows"))
    o = old_counts.select("day", F.col("rows").alias("old_rows"))
    j = n.join(o, "day", "full_outer")
    newr, oldr = F.coalesce("new_rows", F.lit(0)), F.col("old_rows")
    decision = (F.when(oldr.isNotNull() & (newr < ratio * oldr), F.lit("keep"))
                .when(newr == 0, F.lit("skip")).otherwise(F.lit("write")))
    return j.select("day", newr.alias("new_rows"), "old_rows", decision.alias("decision"))
