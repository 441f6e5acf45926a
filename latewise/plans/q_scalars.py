"""Scalar functions X1-X28 and F11, each applied to inputs derived from the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewise.functions import journey as J
from latewise.functions import keys as K
from latewise.functions import text as X
from latewise.functions import timefn as T
from latewise.plans.oracle_fixture import tod_distance_sql
from latewise.plans.registry import fixture, query


def _se(spark, sf_dir):
    return fixture(spark, sf_dir).stop_events


def _r(spark, sf_dir):
    return fixture(spark, sf_dir).responses


@query("minute_diff", """
SELECT id, CAST(date_diff('minute', arrival_planned_time, arrival_change_time) AS INTEGER) AS arr_delay,
       CAST(date_diff('minute', departure_change_time, arrival_planned_time) AS INTEGER) AS back_diff
FROM stop_events""")
def minute_diff(spark, sf_dir):
    se = _se(spark, sf_dir)
    return se.select("id", T.minute_diff("arrival_planned_time", "arrival_change_time").alias("arr_delay"),
                     T.minute_diff("departure_change_time", "arrival_planned_time").alias("back_diff"))


@query("round_minutes", """
SELECT id, s, CAST(round_even(s / 60.0, 0) AS INTEGER) AS minutes
FROM (SELECT id, CAST(pk % 301 - 150 AS BIGINT) AS s FROM responses)""")
def round_minutes(spark, sf_dir):
    r = _r(spark, sf_dir).select("id", (F.col("pk") % 301 - 150).alias("s"))
    return r.select("id", "s", T.round_minutes("s").alias("minutes"))


@query("tod_distance", f"""
SELECT id, {tod_distance_sql('arrival_planned_time', 'departure_change_time')} AS tod_diff FROM stop_events""")
def tod_distance(spark, sf_dir):
    se = _se(spark, sf_dir)
    return se.select("id", T.tod_distance(T.minute_of_day("arrival_planned_time"),
                                          T.minute_of_day("departure_change_time")).alias("tod_diff"))


@query("train_key", "SELECT id, train_no FROM keyed")
def train_key(spark, sf_dir):
    return _se(spark, sf_dir).select("id", K.train_key().alias("train_no"))


# suburban trains with a number in the line's text go by it: that of the line, else one made up
@query("ch_train_key", """
SELECT id, ltrim(CAST(CASE WHEN pk % 3 = 2 OR ln % 2 = 1 THEN pk % 40 WHEN line_number IS NULL THEN pk % 7 ELSE pk % 9 END AS VARCHAR), '0') AS train_number
FROM responses""")
def ch_train_key(spark, sf_dir):
    r = _r(spark, sf_dir)
    pk, ln = F.col("pk"), F.col("ln")
    inp = r.select("id", F.when(pk % 3 == 0, "S").when(pk % 3 == 1, "SN").otherwise("IC").alias("vm"),
                   F.when(ln % 2 == 0, F.coalesce("line_number", F.concat(F.lit("S 0"), (pk % 7).cast("string"))))
                    .otherwise(F.lit("RE")).alias("lt"),
                   F.col("train_number").alias("li"))
    return inp.select("id", K.ch_train_key("vm", "lt", "li").alias("train_number"))


@query("at_train_key", """
SELECT id, CASE WHEN k = '' THEN NULL ELSE k END AS train_number FROM (
  SELECT id, ltrim(coalesce(CASE WHEN cat = 's' AND line_number IS NOT NULL AND line_number <> ''
                                      AND regexp_extract(line_number, '(\\d+)', 1) <> ''
                                 THEN regexp_extract(line_number, '(\\d+)', 1) ELSE num END, ''), '0') AS k
  FROM (SELECT id, lower(train_type) AS cat, line_number,
               CASE WHEN pk % 17 = 0 THEN '000' ELSE train_number END AS num FROM responses))""")
def at_train_key(spark, sf_dir):
    r = _r(spark, sf_dir)
    num = F.when(F.col("pk") % 17 == 0, F.lit("000")).otherwise(F.col("train_number"))
    return r.select("id", K.at_train_key(F.lower("train_type"), F.col("line_number"), num).alias("train_number"))


@query("pad_station", """
SELECT id, raw, CASE WHEN length(raw) < 8 THEN lpad(raw, 8, '0') ELSE raw END AS eva FROM (
  SELECT id, CASE WHEN ln = 2 THEN eva || '12' WHEN ln = 3 THEN substr(eva, 5) ELSE ltrim(eva, '0') END AS raw
  FROM responses)""")
def pad_station(spark, sf_dir):
    r = _r(spark, sf_dir)
    raw = (F.when(F.col("ln") == 2, F.concat("eva", F.lit("12")))
           .when(F.col("ln") == 3, F.substring("eva", 5, 100)).otherwise(K.strip_zeros("eva")))
    return r.select("id", raw.alias("raw")).select("id", "raw", K.pad_station("raw").alias("eva"))


@query("fold_name", """
SELECT DISTINCT name, trim(regexp_replace(translate(replace(replace(translate(lower(name), 'üöäéèêáà', 'uoaeeeaa'),
       'ß', 'ss'), 'hauptbahnhof', 'hbf'), '-.,', '   '), '\\s+', ' ', 'g')) AS norm
FROM (SELECT station_name AS name FROM responses UNION ALL SELECT final_destination_station FROM responses
      UNION ALL SELECT '  Haupt-Bahnhof,  ' || station_name FROM responses WHERE ok % 50 = 0)""")
def fold_name(spark, sf_dir):
    r = _r(spark, sf_dir)
    names = (r.select(F.col("station_name").alias("name"))
             .unionByName(r.select(F.col("final_destination_station").alias("name")))
             .unionByName(r.filter(F.col("ok") % 50 == 0).select(
                 F.concat(F.lit("  Haupt-Bahnhof,  "), "station_name").alias("name"))))
    return names.select("name", X.fold_name("name").alias("norm")).distinct()


LOCAL_TEXT = """
SELECT id, ln, arrival_planned_time, CASE WHEN ln % 3 = 0 THEN strftime(arrival_planned_time, '%-d.%-m.%Y %-H:%M:%S')
                WHEN ln % 3 = 1 THEN strftime(arrival_planned_time, '%d.%m.%Y %H:%M')
                ELSE 'xx.' || CAST(ln AS VARCHAR) END AS txt
FROM responses"""


@query("parse_local_time", f"""
SELECT id, txt, CASE ln % 3 WHEN 0 THEN date_trunc('second', arrival_planned_time) WHEN 1 THEN date_trunc('minute', arrival_planned_time) END AS t
FROM ({LOCAL_TEXT})""")
def parse_local_time(spark, sf_dir):
    r = _r(spark, sf_dir)
    a, ln = F.col("arrival_planned_time"), F.col("ln")
    txt = (F.when(ln % 3 == 0, F.date_format(a, "d.M.yyyy H:mm:ss"))
           .when(ln % 3 == 1, F.date_format(a, "dd.MM.yyyy HH:mm"))
           .otherwise(F.concat(F.lit("xx."), ln.cast("string"))))
    return r.select("id", txt.alias("txt")).select("id", "txt", T.parse_local_time("txt").alias("t"))


@query("parse_compact_time", """
SELECT id, txt, try_strptime(txt, '%y%m%d%H%M') AS t FROM (
  SELECT id, CASE WHEN ln = 3 THEN '26139912' || CAST(ln AS VARCHAR) || '0'
                  WHEN ln = 4 THEN NULL
                  ELSE strftime(departure_change_time, '%y%m%d%H%M') END AS txt FROM responses)""")
def parse_compact_time(spark, sf_dir):
    r = _r(spark, sf_dir)
    ln = F.col("ln")
    txt = (F.when(ln == 3, F.concat(F.lit("26139912"), ln.cast("string"), F.lit("0")))
           .when(ln == 4, F.lit(None).cast("string"))
           .otherwise(F.date_format("departure_change_time", "yyMMddHHmm")))
    return r.select("id", txt.alias("txt")).select("id", "txt", T.parse_compact_time("txt").alias("t"))


@query("parse_board_time", """
SELECT id, d, tt, CAST(strptime(d, '%Y%m%d') AS DATE) + CAST(CASE WHEN length(tt) = 8 THEN CAST(substr(tt, 1, 2) AS INTEGER) ELSE 0 END AS INTEGER)
       + CAST(strptime(CASE WHEN length(tt) = 8 THEN substr(tt, 3) ELSE tt END, '%H%M%S') AS TIME) AS t
FROM (SELECT id, strftime(xml_timestamp, '%Y%m%d') AS d,
             CASE WHEN ln % 2 = 0 THEN strftime(arrival_planned_time, '%H%M%S')
                  ELSE '0' || CAST(ln % 3 AS VARCHAR) || strftime(arrival_planned_time, '%H%M%S') END AS tt
      FROM responses WHERE arrival_planned_time IS NOT NULL)""")
def parse_board_time(spark, sf_dir):
    r = _r(spark, sf_dir).filter(F.col("arrival_planned_time").isNotNull())
    ln = F.col("ln")
    tt = (F.when(ln % 2 == 0, F.date_format("arrival_planned_time", "HHmmss"))
          .otherwise(F.concat(F.lit("0"), (ln % 3).cast("string"), F.date_format("arrival_planned_time", "HHmmss"))))
    d = F.date_format("xml_timestamp", "yyyyMMdd")
    return r.select("id", d.alias("d"), tt.alias("tt")).select("id", "d", "tt", T.parse_board_time("d", "tt").alias("t"))


EPOCHS = """
SELECT id, CAST(epoch(arrival_planned_time) AS BIGINT) + CAST(pk % 7 AS BIGINT) * 86400 * 30 - 86400 * 200 AS ep,
       CAST(ok % 600 AS BIGINT) - 300 AS dl
FROM responses WHERE arrival_planned_time IS NOT NULL"""


def _epochs(spark, sf_dir):
    r = _r(spark, sf_dir).filter(F.col("arrival_planned_time").isNotNull())
    ep = (T.seconds_between(F.lit(T._dt.datetime(1970, 1, 1)), F.col("arrival_planned_time"))
          + F.col("pk") % 7 * 86400 * 30 - 86400 * 200)
    return r.select("id", ep.alias("ep"), (F.col("ok") % 600 - 300).alias("dl"))


@query("epoch_to_local", f"""
SELECT id, ep, timezone('Europe/Berlin', to_timestamp(ep)) AS t_local,
       CAST(timezone('Europe/Berlin', to_timestamp(ep)) AS DATE) AS service_day,
       timezone('Europe/Rome', to_timestamp(ep * 1000 / 1000.0)) AS t_ms
FROM ({EPOCHS})""")
def epoch_to_local(spark, sf_dir):
    e = _epochs(spark, sf_dir)
    return e.select("id", "ep", T.epoch_to_local("ep").alias("t_local"),
                    F.to_date(T.epoch_to_local("ep")).alias("service_day"),
                    T.epoch_ms_to_local(F.col("ep") * 1000, "Europe/Rome").alias("t_ms"))


@query("planned_from_delay", f"""
SELECT id, CASE WHEN ep IS NOT NULL AND d IS NOT NULL THEN timezone('Europe/Berlin', to_timestamp(ep - d)) END AS planned
FROM (SELECT id, ep, CASE WHEN dl % 5 = 0 THEN NULL ELSE dl END AS d FROM ({EPOCHS}))""")
def planned_from_delay(spark, sf_dir):
    e = _epochs(spark, sf_dir).withColumn("d", F.when(F.col("dl") % 5 != 0, F.col("dl")))
    return e.select("id", T.planned_from_delay("ep", "d").alias("planned"))


@query("iso_to_local", """
SELECT id, CASE WHEN ln % 3 = 0 THEN timezone('Europe/Berlin', CAST(txt AS TIMESTAMPTZ))
                ELSE CAST(txt AS TIMESTAMP) END AS t
FROM (SELECT id, ln, CASE WHEN ln % 3 = 0 THEN strftime(arrival_planned_time, '%Y-%m-%dT%H:%M:%S') ||
                          CASE WHEN pk % 2 = 0 THEN '+02:00' ELSE '-05:30' END
                          ELSE strftime(arrival_planned_time, '%Y-%m-%dT%H:%M:%S') END AS txt
      FROM responses WHERE arrival_planned_time IS NOT NULL)""")
def iso_to_local(spark, sf_dir):
    r = _r(spark, sf_dir).filter(F.col("arrival_planned_time").isNotNull())
    base = F.date_format("arrival_planned_time", "yyyy-MM-dd'T'HH:mm:ss")
    txt = F.when(F.col("ln") % 3 == 0, F.concat(base, F.when(F.col("pk") % 2 == 0, F.lit("+02:00"))
                                                 .otherwise(F.lit("-05:30")))).otherwise(base)
    return r.select("id", txt.alias("txt")).select("id", T.iso_to_local("txt").alias("t"))


TRIP_IDS = """
SELECT id, CASE ln % 4 WHEN 0 THEN 'OCESN' || lpad(CAST(pk % 900 AS VARCHAR), 6, '0') || 'F' || CAST(ok % 9 AS VARCHAR) || ':' || train_type || ':FR:Line::x'
                       WHEN 1 THEN 'OCE' || CAST(pk AS VARCHAR) || ':TGV:x'
                       WHEN 2 THEN 'OCESN12F:ab:' ELSE 'StopPoint:OCETrain TER-87' || lpad(CAST(sk AS VARCHAR), 6, '0') END AS tid
FROM responses"""


@query("trip_id_parts", f"""
SELECT id, tid,
  CASE WHEN regexp_extract(tid, '^OCESN(\\d+)F', 1) <> '' THEN ltrim(regexp_extract(tid, '^OCESN(\\d+)F', 1), '0') END AS train_number,
  CASE WHEN regexp_extract(tid, '^[^:]*:([A-Z]{{2,4}}):', 1) <> '' THEN regexp_extract(tid, '^[^:]*:([A-Z]{{2,4}}):', 1) ELSE 'SNCF' END AS brand,
  CASE WHEN regexp_extract(tid, '(\\d{{8}})$', 1) <> '' THEN regexp_extract(tid, '(\\d{{8}})$', 1) END AS uic8
FROM ({TRIP_IDS})""")
def trip_id_parts(spark, sf_dir):
    r = _r(spark, sf_dir)
    ln, pk, ok, sk = F.col("ln"), F.col("pk"), F.col("ok"), F.col("sk")
    tid = (F.when(ln % 4 == 0, F.concat(F.lit("OCESN"), F.lpad((pk % 900).cast("string"), 6, "0"), F.lit("F"),
                                        (ok % 9).cast("string"), F.lit(":"), F.col("train_type"), F.lit(":FR:Line::x")))
           .when(ln % 4 == 1, F.concat(F.lit("OCE"), pk.cast("string"), F.lit(":TGV:x")))
           .when(ln % 4 == 2, F.lit("OCESN12F:ab:"))
           .otherwise(F.concat(F.lit("StopPoint:OCETrain TER-87"), F.lpad(sk.cast("string"), 6, "0"))))
    t = r.select("id", tid.alias("tid"))
    return t.select("id", "tid", K.fr_train_number("tid").alias("train_number"),
                    K.fr_brand("tid").alias("brand"), K.stop_uic8("tid").alias("uic8"))


@query("realtime_id_parts", """
SELECT id, rid, CASE WHEN starts_with(rid, 'IFF:') AND len(string_split(rid, ':')) = 3 THEN string_split(rid, ':')[2] END AS train_type,
       CASE WHEN starts_with(rid, 'IFF:') AND len(string_split(rid, ':')) = 3 THEN string_split(rid, ':')[2] || ':' || string_split(rid, ':')[3] END AS train_key,
       CASE WHEN starts_with(rid, 'IFF:') AND len(string_split(rid, ':')) = 3 THEN ltrim(string_split(rid, ':')[3], '0') END AS train_number
FROM (SELECT id, CASE ln % 3 WHEN 0 THEN 'IFF:' || train_type || ':' || train_number
                             WHEN 1 THEN 'IFF:' || train_type || ':' || train_number || ':x'
                             ELSE 'NS:' || train_number END AS rid FROM responses)""")
def realtime_id_parts(spark, sf_dir):
    r = _r(spark, sf_dir)
    ln = F.col("ln")
    rid = (F.when(ln % 3 == 0, F.concat_ws(":", F.lit("IFF"), "train_type", "train_number"))
           .when(ln % 3 == 1, F.concat_ws(":", F.lit("IFF"), "train_type", "train_number", F.lit("x")))
           .otherwise(F.concat(F.lit("NS:"), "train_number")))
    t = r.select("id", rid.alias("rid")).withColumn("p", K.realtime_id_parts("rid"))
    return t.select("id", "rid", F.col("p.train_type").alias("train_type"),
                    F.col("p.train_key").alias("train_key"), F.col("p.train_number").alias("train_number"))


@query("station_code_to_uic", """
SELECT id, code, CASE WHEN regexp_matches(code, '^S\\d{5}$') THEN '83' || substr(code, 2) END AS uic7
FROM (SELECT id, CASE ln % 3 WHEN 0 THEN 'S' || lpad(CAST(sk % 100000 AS VARCHAR), 5, '0')
                             WHEN 1 THEN 'S' || CAST(sk AS VARCHAR) || '9' ELSE 'N' || lpad(CAST(sk AS VARCHAR), 5, '0') END AS code
      FROM responses)""")
def station_code_to_uic(spark, sf_dir):
    r = _r(spark, sf_dir)
    ln, sk = F.col("ln"), F.col("sk")
    code = (F.when(ln % 3 == 0, F.concat(F.lit("S"), F.lpad((sk % 100000).cast("string"), 5, "0")))
            .when(ln % 3 == 1, F.concat(F.lit("S"), sk.cast("string"), F.lit("9")))
            .otherwise(F.concat(F.lit("N"), F.lpad(sk.cast("string"), 5, "0"))))
    return r.select("id", code.alias("code")).select("id", "code", K.station_code_to_uic("code").alias("uic7"))


@query("geo_distance", """
SELECT id, round(sqrt(pow((lon2 - lon1) * 111.32 * cos(radians((lat1 + lat2) / 2)), 2) + pow((lat2 - lat1) * 111.32, 2)), 6) AS km
FROM (SELECT id, 47.0 + (sk % 100) / 100.0 AS lat1, 8.0 + (pk % 100) / 100.0 AS lon1,
             47.0 + (sk % 97) / 100.0 AS lat2, 8.0 + (pk % 89) / 100.0 AS lon2 FROM responses)""")
def geo_distance(spark, sf_dir):
    r = _r(spark, sf_dir)
    sk, pk = F.col("sk"), F.col("pk")
    return r.select("id", F.round(X.geo_distance_km(47.0 + (sk % 100) / 100.0, 8.0 + (pk % 100) / 100.0,
                                                      47.0 + (sk % 97) / 100.0, 8.0 + (pk % 89) / 100.0), 6).alias("km"))


@query("name_tokens", """
SELECT DISTINCT a, b, len(list_intersect(ta, tb)) > 0 AS overlap FROM (
  SELECT station_name AS a, final_destination_station AS b,
         list_filter(string_split_regex(lower(station_name), '[^a-zäöüß]+'), lambda t: length(t) >= 4) AS ta,
         list_filter(string_split_regex(lower(final_destination_station), '[^a-zäöüß]+'), lambda t: length(t) >= 4) AS tb
  FROM responses)""")
def name_tokens(spark, sf_dir):
    r = _r(spark, sf_dir)
    return r.select(F.col("station_name").alias("a"), F.col("final_destination_station").alias("b"),
                    X.names_overlap("station_name", "final_destination_station").alias("overlap")).distinct()


@query("coordinates_from_lid", """
SELECT id, CASE WHEN regexp_extract(lid, '@X=(-?\\d+)@Y=(-?\\d+)@', 1) <> ''
                THEN CAST(regexp_extract(lid, '@X=(-?\\d+)@Y=(-?\\d+)@', 2) AS BIGINT) / 1e6 END AS lat,
       CASE WHEN regexp_extract(lid, '@X=(-?\\d+)@Y=(-?\\d+)@', 1) <> ''
                THEN CAST(regexp_extract(lid, '@X=(-?\\d+)@Y=(-?\\d+)@', 1) AS BIGINT) / 1e6 END AS lon
FROM (SELECT id, CASE WHEN ln = 5 THEN 'A=1@O=' || station_name || '@'
                      ELSE 'A=1@O=' || station_name || '@X=' || CAST(8000000 + pk * 37 - (ln * 9000000) AS VARCHAR)
                           || '@Y=' || CAST(47000000 + sk * 1001 AS VARCHAR) || '@L=' || eva || '@' END AS lid FROM responses)""")
def coordinates_from_lid(spark, sf_dir):
    r = _r(spark, sf_dir)
    lid = F.when(F.col("ln") == 5, F.concat(F.lit("A=1@O="), "station_name", F.lit("@"))).otherwise(
        F.concat(F.lit("A=1@O="), "station_name", F.lit("@X="), (F.lit(8000000) + F.col("pk") * 37 - F.col("ln") * 9000000).cast("string"),
                 F.lit("@Y="), (F.lit(47000000) + F.col("sk") * 1001).cast("string"), F.lit("@L="), "eva", F.lit("@")))
    c = X.coordinates_from_lid(lid)
    return r.select("id", c.lat.alias("lat"), c.lon.alias("lon"))


@query("month_bounds", """
SELECT DISTINCT CAST(xml_timestamp AS DATE) AS d, CAST(date_trunc('month', xml_timestamp) AS DATE) AS first_day,
       CAST(last_day(xml_timestamp) AS DATE) AS last_day,
       CAST(date_trunc('month', xml_timestamp) - INTERVAL 1 MONTH AS DATE) AS prev_first_day,
       CAST(date_trunc('month', xml_timestamp) AS DATE) - 1 AS prev_last_day
FROM responses""")
def month_bounds(spark, sf_dir):
    r = _r(spark, sf_dir)
    b = T.month_bounds("xml_timestamp")
    return r.select(F.to_date("xml_timestamp").alias("d"), b.first_day.alias("first_day"), b.last_day.alias("last_day"),
                    b.prev_first_day.alias("prev_first_day"), b.prev_last_day.alias("prev_last_day")).distinct()


@query("five_minute_bucket", """
SELECT id, time_bucket(INTERVAL 5 MINUTE, departure_change_time) AS bucket FROM responses""")
def five_minute_bucket(spark, sf_dir):
    r = _r(spark, sf_dir)
    return r.select("id", T.five_minute_bucket("departure_change_time").alias("bucket"))


@query("hour_buckets", """
SELECT id, strftime(arrival_planned_time, '%y%m%d') AS bucket_day, hour(arrival_planned_time) AS bucket_hour FROM responses
WHERE arrival_planned_time IS NOT NULL
UNION ALL
SELECT id, strftime(arrival_planned_time + INTERVAL 1 HOUR, '%y%m%d'), hour(arrival_planned_time + INTERVAL 1 HOUR) FROM responses
WHERE minute(arrival_planned_time) >= 55
UNION ALL
SELECT id, strftime(arrival_planned_time - INTERVAL 1 HOUR, '%y%m%d'), hour(arrival_planned_time - INTERVAL 1 HOUR) FROM responses
WHERE minute(arrival_planned_time) < 5""")
def hour_buckets(spark, sf_dir):
    r = _r(spark, sf_dir).filter(F.col("arrival_planned_time").isNotNull())
    return r.select("id", F.inline(T.hour_buckets("arrival_planned_time")))


@query("compensation_pct", """
SELECT id, d, CASE WHEN d IS NULL THEN NULL WHEN d >= 120 THEN 50 WHEN d >= 60 THEN 25 ELSE 0 END AS pct
FROM (SELECT id, delay_in_min * 3 AS d FROM stop_events)""")
def compensation_pct(spark, sf_dir):
    se = _se(spark, sf_dir).select("id", (F.col("delay_in_min") * 3).alias("d"))
    return se.select("id", "d", J.compensation_pct("d").alias("pct"))


@query("delay_band", """
SELECT journey_id, leg_idx, median_delay,
       CASE WHEN median_delay IS NULL THEN 'gray' WHEN median_delay < 3 THEN 'green'
            WHEN median_delay < 10 THEN 'yellow' ELSE 'red' END AS band
FROM o_leg_stats""")
def delay_band(spark, sf_dir):
    from latewise.plans.q_journeys import leg_stats
    st = leg_stats(spark, sf_dir)
    return st.select("journey_id", "leg_idx", "median_delay", J.delay_band("median_delay").alias("band"))


@query("live_line_label", """
SELECT id, CASE WHEN l <> '' AND regexp_matches(l, '^\\d+$') AND train_type = 'S' THEN 'S' || l
                WHEN l <> '' THEN l END AS line
FROM (SELECT id, train_type, replace(coalesce(line_number, ''), ' ', '') AS l FROM responses)""")
def live_line_label(spark, sf_dir):
    r = _r(spark, sf_dir)
    return r.select("id", K.live_line_label(F.coalesce("line_number", F.lit("")), F.col("train_type")).alias("line"))


@query("trip_price", """
SELECT o.journey_id AS out_id, r.journey_id AS ret_id,
  CASE WHEN (CASE WHEN o.dticket_covered THEN 0.0 ELSE o.price END) IS NOT NULL
        AND (CASE WHEN r.dticket_covered THEN 0.0 ELSE r.price END) IS NOT NULL
       THEN (CASE WHEN o.dticket_covered THEN 0.0 ELSE o.price END) + (CASE WHEN r.dticket_covered THEN 0.0 ELSE r.price END) END AS total,
  o.dticket_covered AND r.dticket_covered AS covered,
  o.dticket_covered OR r.dticket_covered OR o.price_partial OR r.price_partial AS partial
FROM journeys o JOIN journeys r ON r.journey_id = o.journey_id + 1
WHERE o.has_return""")
def trip_price(spark, sf_dir):
    j = fixture(spark, sf_dir).journeys
    o = j.filter("has_return").select([F.col(c).alias("o_" + c) for c in j.columns])
    r = j.select([F.col(c).alias("r_" + c) for c in j.columns])
    p = o.join(r, r.r_journey_id == o.o_journey_id + 1).withColumn("tp", J.trip_price(
        "o_price", "o_dticket_covered", "o_price_partial", "r_price", "r_dticket_covered", "r_price_partial"))
    return p.select(F.col("o_journey_id").alias("out_id"), F.col("r_journey_id").alias("ret_id"),
                    F.col("tp.total").alias("total"), F.col("tp.covered").alias("covered"),
                    F.col("tp.partial").alias("partial"))
