"""Station lists and crosswalk builders: S5, S7, A21, J4, J8-J11, T4, U2."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewise.operators import stations as S
from latewise.plans.oracle_fixture import register
from latewise.plans.q_national import scratch
from latewise.plans.registry import fixture, query
from latewise.sources import feeds, files

X = "substr(eva, 4, 5)"
ST = "((sk // 6) % 12)"
CODE = f"CASE WHEN {ST} = 3 THEN 'N' || {X} ELSE 'S' || {X} END"

register("o_station_raw", f"""
SELECT CASE WHEN ok % 5 = 0 THEN ' ' || upper('c' || {X}) || ' ' WHEN ok % 5 = 1 THEN '' WHEN ok % 5 = 2 THEN NULL
            ELSE 'c' || {X} END AS code,
       '84' || {X} AS uic, station_name AS name_long,
       ['NL', 'BE', 'DE', 'FR', 'CH', 'AT'][CAST(sk % 6 AS INTEGER) + 1] AS country, ok * 10 + ln AS line_no
FROM fx_latest""")
register("o_station_list", """
SELECT lower(trim(code)) AS code, trim(uic) AS uic, trim(name_long) AS name_long, trim(country) AS country
FROM o_station_raw WHERE code IS NOT NULL AND lower(trim(code)) <> ''
QUALIFY row_number() OVER (PARTITION BY lower(trim(code)) ORDER BY line_no DESC) = 1""")
register("o_it_universe", f"SELECT DISTINCT {CODE} AS code, xml_station_name AS name, CASE WHEN {ST} % 4 = 0 THEN 1 ELSE 2 END AS tipo FROM fx_latest")
register("o_it_existing", f"SELECT DISTINCT {CODE} AS code, '083' || {X} AS eva, xml_station_name AS name FROM fx_latest WHERE {ST} IN (0, 1)")
register("o_it_seed", f"""
SELECT DISTINCT {CODE} AS code, CASE WHEN {ST} = 5 THEN '08399999' ELSE '083' || {X} END AS eva,
       xml_station_name AS name, {ST} % 3 = 0 AS main
FROM fx_latest WHERE {ST} <= 7 AND {ST} <> 3""")
register("o_it_cands", f"""
SELECT code, rank, 'A=1@O=' || name || '@i=U.00' || CASE WHEN rank = 1 THEN '85' ELSE '83' END || x || '@' AS loc_id,
       CASE WHEN rank = 1 THEN '85' || x WHEN rank = 2 THEN CASE WHEN st = 6 THEN '' ELSE '83' || x END ELSE '830' || x END AS ext_id,
       name || ' (' || CAST(rank AS VARCHAR) || ')' AS c_name
FROM (SELECT DISTINCT {CODE} AS code, xml_station_name AS name, {X} AS x, {ST} AS st FROM fx_latest), range(1, 4) r(rank)""")
register("o_crosswalk", """
SELECT code, eva, name, 'existing' AS src FROM o_it_existing
UNION ALL
SELECT u.code, s.eva, u.name, 'seed' FROM o_it_universe u JOIN o_it_seed s ON s.code = u.code
WHERE u.code NOT IN (SELECT code FROM o_it_existing)""")
ACCEPT_SQL = ("""
SELECT q.code, CASE WHEN length(c.ext_id) < 8 THEN lpad(c.ext_id, 8, '0') ELSE c.ext_id END AS eva,
       coalesce(c.c_name, q.name) AS name
FROM (SELECT *, CASE WHEN regexp_matches(code, '^S\\d{5}$') THEN '83' || substr(code, 2, 5) END AS uic7 FROM Q) q
JOIN o_it_cands c ON c.code = q.code
WHERE q.uic7 IS NOT NULL AND regexp_extract(c.loc_id, 'i=U.00(\\d{7})', 1) = q.uic7 AND c.ext_id IS NOT NULL AND c.ext_id <> ''
QUALIFY row_number() OVER (PARTITION BY q.code ORDER BY c.rank) = 1""")

GT_STOPS = f"""
SELECT DISTINCT 'sp' || eva AS stop_id, CASE WHEN sk % 6 < 3 THEN 'P' || {X} END AS parent_station, xml_station_name AS stop_name,
       '47.' || lpad(CAST({ST} * 37 + sk % 6 AS VARCHAR), 3, '0') AS stop_lat, '9.' || lpad(CAST({ST} * 53 AS VARCHAR), 3, '0') AS stop_lon
FROM fx_latest
UNION
SELECT DISTINCT 'P' || {X}, NULL, xml_station_name || CASE {ST} % 4 WHEN 1 THEN ' Bahnhof' WHEN 2 THEN '  Bahnhst' ELSE '' END, '47.' || lpad(CAST({ST} * 37 AS VARCHAR), 3, '0'),
       '9.' || lpad(CAST({ST} * 53 AS VARCHAR), 3, '0') FROM fx_latest"""
register("o_gt_stops", GT_STOPS)
# every stop of a rail route counts for its parent, or for itself; name and place follow from it
register("o_gt_rank", f"""
SELECT pid, any_value(label) AS stop_name, any_value(lat) AS lat, any_value(lon) AS lon, count(*) AS n
FROM (SELECT CASE WHEN grouped THEN 'P' || {X} ELSE 'sp' || eva END AS pid, 47 + (st * 37 + CASE WHEN grouped THEN 0 ELSE sk % 6 END) / 1000 AS lat,
             9 + st * 53 / 1000 AS lon, xml_station_name || CASE WHEN NOT grouped THEN '' ELSE ['', ' Bahnhof', '  Bahnhst', ''][CAST(st % 4 AS INTEGER) + 1] END AS label
      FROM (SELECT *, sk % 6 < 3 AS grouped, {ST} AS st FROM fx_latest WHERE ok % 5 > 0))
GROUP BY pid""")


def _lt(spark, sf_dir):
    return fixture(spark, sf_dir).latest


@query("station_csv_scan", "SELECT * FROM o_station_list")
def station_csv_scan(spark, sf_dir):
    return S.station_list(feeds.station_list_raw(_lt(spark, sf_dir)), value_cols=("uic", "name_long", "country"))


@query("country_station_counts", "SELECT country, count(*) AS n FROM o_station_list GROUP BY country ORDER BY n DESC, country")
def country_station_counts(spark, sf_dir):
    st = S.station_list(feeds.station_list_raw(_lt(spark, sf_dir)), value_cols=("uic", "name_long", "country"))
    return S.country_station_counts(st)


GTFS_ROWS = {"stops": ["stop_id", "parent_station", "stop_name", "stop_lat", "stop_lon"], "routes": ["route_id", "route_type"],
             "trips": ["trip_id", "route_id"], "stop_times": ["trip_id", "stop_id"]}


@query("gtfs_scan", """
SELECT 'stops' AS tbl, concat_ws('|', stop_id, coalesce(parent_station, '-'), stop_name, stop_lat, stop_lon) AS line FROM o_gt_stops
UNION ALL SELECT DISTINCT 'routes', 'r' || ok % 40 || '|' || CASE WHEN ok % 5 = 0 THEN 3 ELSE 2 END FROM fx_latest
UNION ALL SELECT DISTINCT 'trips', 't' || ok || '|r' || ok % 40 FROM fx_latest
UNION ALL SELECT 'stop_times', 't' || ok || '|sp' || eva FROM fx_latest""")
def gtfs_scan(spark, sf_dir):
    """The four files of the static timetable, landed as CSV and read as text."""
    path = scratch(spark, "gtfs")
    for name, df in zip(("stops", "routes", "trips", "stop_times"), feeds.gtfs_tables(_lt(spark, sf_dir)), strict=True):
        df.write.option("header", True).csv(f"{path}/{name}.txt")
    found, out = files.gtfs_scan(spark, path), None
    for name, cols in GTFS_ROWS.items():
        df = found[name].select(F.lit(name).alias("tbl"), F.concat_ws("|", *(F.coalesce(c, F.lit("-")) for c in cols)).alias("line"))
        out = df if out is None else out.unionByName(df)
    return out


def ranked(spark, sf_dir):
    stops, routes, trips, stop_times = feeds.gtfs_tables(_lt(spark, sf_dir))
    return S.gtfs_rank(stop_times, trips, routes, stops)


@query("gtfs_rank_join", "SELECT pid, stop_name, round(lat, 6) AS lat, round(lon, 6) AS lon, n FROM o_gt_rank")
def gtfs_rank_join(spark, sf_dir):
    return ranked(spark, sf_dir).select("pid", "stop_name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n")


@query("geo_match", """
WITH c AS (
  SELECT query, rank, CASE WHEN rank = 1 THEN 'POI' ELSE 'ST' END AS type,
         CASE WHEN rank = 2 THEN '80' || x ELSE '81' || x END AS ext_id,
         CASE WHEN rank = 3 THEN CASE WHEN st % 2 = 0 THEN ['BUS'] ELSE ['REGIONAL'] END ELSE ['ICE', 'BUS'] END AS products,
         lat + CASE WHEN rank = 4 THEN CASE WHEN st % 3 = 0 THEN 0.05 ELSE 0.005 END ELSE 0.001 END AS c_lat,
         lon AS c_lon, query || ' Hbf' AS c_name
  FROM (SELECT trim(replace(replace(stop_name, ' Bahnhof', ''), '  Bahnhst', '')) AS query, substr(stop_id, 2, 5) AS x,
               CAST(stop_lat AS DOUBLE) AS lat, CAST(stop_lon AS DOUBLE) AS lon, CAST(substr(stop_id, 5, 2) AS INTEGER) AS st
        FROM o_gt_stops WHERE parent_station IS NULL AND starts_with(stop_id, 'P')), range(1, 5) r(rank))
SELECT pid, stop_name, ext_id, c_name AS bahn_name FROM (SELECT *, trim(replace(replace(stop_name, ' Bahnhof', ''), '  Bahnhst', '')) AS asked FROM o_gt_rank) g
JOIN c ON g.asked = c.query
WHERE c.type = 'ST' AND starts_with(c.ext_id, '81') AND length(c.ext_id) = 7
  AND len(list_intersect(c.products, ['ICE', 'EC_IC', 'IR', 'REGIONAL', 'SBAHN'])) > 0
  AND sqrt(pow((c.c_lon - g.lon) * 111.32 * cos(radians((g.lat + c.c_lat) / 2)), 2) + pow((c.c_lat - g.lat) * 111.32, 2)) < 2.0
QUALIFY row_number() OVER (PARTITION BY pid ORDER BY rank) = 1""")
def geo_match(spark, sf_dir):
    return S.geo_match(ranked(spark, sf_dir), feeds.geo_candidates(feeds.gtfs_tables(_lt(spark, sf_dir))[0]))


@query("geo_near", """
WITH c AS (
  SELECT rank, '81' || x AS ext_id, CASE WHEN rank = 3 THEN CASE WHEN st % 2 = 0 THEN ['BUS'] ELSE ['REGIONAL'] END ELSE ['ICE', 'BUS'] END AS products,
         lat + CASE WHEN rank = 4 THEN CASE WHEN st % 3 = 0 THEN 0.05 ELSE 0.005 END ELSE 0.001 END AS c_lat,
         lon AS c_lon, trim(replace(replace(stop_name, ' Bahnhof', ''), '  Bahnhst', '')) || ' Hbf' AS c_name
  FROM (SELECT stop_name, substr(stop_id, 2, 5) AS x, CAST(stop_lat AS DOUBLE) AS lat, CAST(stop_lon AS DOUBLE) AS lon, CAST(substr(stop_id, 5, 2) AS INTEGER) AS st
        FROM o_gt_stops WHERE parent_station IS NULL AND starts_with(stop_id, 'P')), (VALUES (3), (4)) r(rank)),
pairs AS (
  SELECT g.pid, g.stop_name, c.*, sqrt(pow((c.c_lon - g.lon) * 111.32 * cos(radians((g.lat + c.c_lat) / 2)), 2) + pow((c.c_lat - g.lat) * 111.32, 2)) AS km
  FROM o_gt_rank g, c WHERE length(ext_id) = 7 AND len(list_intersect(c.products, ['ICE', 'EC_IC', 'IR', 'REGIONAL', 'SBAHN'])) > 0)
SELECT pid, stop_name, ext_id, c_name AS bahn_name, round(km, 6) AS km FROM pairs WHERE km < 2.0
QUALIFY row_number() OVER (PARTITION BY pid, stop_name ORDER BY km, rank, ext_id, c_name) = 1""")
def geo_near(spark, sf_dir):
    """J10 by a grid join on the position alone, against all candidates."""
    return S.geo_near(ranked(spark, sf_dir), feeds.geo_candidates(feeds.gtfs_tables(_lt(spark, sf_dir))[0]))


@query("seed_crosswalk", "SELECT * FROM o_crosswalk")
def seed_crosswalk(spark, sf_dir):
    lt = _lt(spark, sf_dir)
    return S.seed_crosswalk(feeds.it_universe(lt), feeds.it_existing(lt), feeds.it_seed(lt))


def _accept_sql(q: str) -> str:
    return ACCEPT_SQL.replace("FROM Q)", f"FROM ({q}))")


@query("token_match", _accept_sql("SELECT * FROM o_it_universe WHERE code NOT IN (SELECT code FROM o_crosswalk)"))
def token_match(spark, sf_dir):
    lt = _lt(spark, sf_dir)
    cw = S.seed_crosswalk(feeds.it_universe(lt), feeds.it_existing(lt), feeds.it_seed(lt))
    return S.token_match(feeds.it_universe(lt), cw, feeds.it_candidates(lt))


@query("seed_verify", f"""
WITH s AS (SELECT u.code, u.name, c.eva AS seed_eva FROM o_it_universe u JOIN o_it_seed sd ON sd.code = u.code
           JOIN o_crosswalk c ON c.code = u.code),
h AS ({_accept_sql("SELECT code, name FROM s")})
SELECT s.code, s.seed_eva, h.eva AS lookup_eva, h.eva IS NOT NULL AND h.eva <> s.seed_eva AS mismatch
FROM s LEFT JOIN h ON h.code = s.code""")
def seed_verify(spark, sf_dir):
    lt = _lt(spark, sf_dir)
    cw = S.seed_crosswalk(feeds.it_universe(lt), feeds.it_existing(lt), feeds.it_seed(lt))
    return S.seed_verify(feeds.it_universe(lt), cw, feeds.it_seed(lt), feeds.it_candidates(lt))


HUB_SQL = f"""
WITH m AS (SELECT u.* FROM o_it_universe u WHERE u.code IN (SELECT code FROM o_crosswalk)),
flagged AS (SELECT m.code, m.name FROM m LEFT JOIN o_it_seed s ON s.code = m.code WHERE coalesce(s.main, false) OR m.tipo = 1),
busiest AS (SELECT m.code, m.name FROM m JOIN (SELECT {CODE} AS code, count(*) AS n FROM fx_latest GROUP BY 1) b ON b.code = m.code
            ORDER BY b.n DESC, m.code LIMIT 2)
SELECT * FROM (SELECT * FROM flagged UNION SELECT * FROM busiest) ORDER BY code"""


@query("hub_select", HUB_SQL)
def hub_select(spark, sf_dir):
    lt = _lt(spark, sf_dir)
    cw = S.seed_crosswalk(feeds.it_universe(lt), feeds.it_existing(lt), feeds.it_seed(lt))
    return S.hub_select(feeds.it_universe(lt), cw, feeds.it_seed(lt), feeds.it_board_counts(lt), 2)


@query("hub_union", f"WITH h AS ({HUB_SQL}) SELECT code, count(*) AS times FROM h GROUP BY code")
def hub_union(spark, sf_dir):
    """Every hub comes out of the union once, flagged, busiest or both."""
    lt = _lt(spark, sf_dir)
    cw = S.seed_crosswalk(feeds.it_universe(lt), feeds.it_existing(lt), feeds.it_seed(lt))
    h = S.hub_select(feeds.it_universe(lt), cw, feeds.it_seed(lt), feeds.it_board_counts(lt), 2)
    return h.groupBy("code").agg(F.count(F.lit(1)).alias("times"))
