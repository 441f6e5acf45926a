"""Serving table and station queries: K3, A4-A7, T1, T2."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewise.operators import serving as S
from latewise.plans.oracle_fixture import register
from latewise.plans.registry import fixture, query

FOLD_SQL = ("trim(regexp_replace(translate(replace(replace(translate(lower({x}), 'üöäéèêáà', 'uoaeeeaa'), "
            "'ß', 'ss'), 'hauptbahnhof', 'hbf'), '-.,', '   '), '\\s+', ' ', 'g'))")

register("o_volume", """
SELECT eva, station_name, count(*) AS cnt FROM stop_events
WHERE station_name IS NOT NULL AND station_name <> '' AND eva IS NOT NULL GROUP BY eva, station_name""")
register("o_index", f"""
SELECT norm, station_name AS name, eva, ltrim(eva, '0') AS ext_id,
       'A=1@O=' || station_name || '@L=' || ltrim(eva, '0') || '@' AS loc_id, total,
       list_contains(string_split(norm, ' '), 'hbf') AS is_main
FROM (SELECT *, sum(cnt) OVER (PARTITION BY norm) AS total,
             row_number() OVER (PARTITION BY norm ORDER BY cnt DESC, eva, station_name) AS rn
      FROM (SELECT *, {FOLD_SQL.format(x='station_name')} AS norm FROM o_volume))
WHERE rn = 1""")
register("o_search_queries", """
SELECT DISTINCT q AS query_id, q AS query FROM (
  SELECT substring(station_name, 1, 3) AS q FROM stop_events
  UNION ALL SELECT substring(station_name, 4, 4) FROM stop_events
  UNION ALL SELECT split_part(station_name, ' ', 2) FROM stop_events
  UNION ALL SELECT lower(substring(final_destination_station, 1, 5)) FROM stop_events) t""")


@query("serving_table", "SELECT * FROM keyed")
def serving_table(spark, sf_dir):
    return S.serving_table(fixture(spark, sf_dir).stop_events)


@query("coverage", """
SELECT min(CAST(arrival_planned_time AS DATE)) AS min_day, max(CAST(arrival_planned_time AS DATE)) AS max_day
FROM stop_events WHERE arrival_planned_time IS NOT NULL""")
def coverage(spark, sf_dir):
    return S.coverage(fixture(spark, sf_dir).stop_events)


@query("row_count", "SELECT count(*) AS rows FROM stop_events")
def row_count(spark, sf_dir):
    return S.row_count(fixture(spark, sf_dir).stop_events)


@query("station_volume", "SELECT * FROM o_volume")
def station_volume(spark, sf_dir):
    return S.station_volume(fixture(spark, sf_dir).stop_events)


@query("station_index", "SELECT * FROM o_index")
def station_index(spark, sf_dir):
    return S.station_index(fixture(spark, sf_dir).stop_events)


@query("busiest_stations", "SELECT eva, count(*) AS events FROM stop_events GROUP BY eva ORDER BY events DESC, eva LIMIT 10")
def busiest_stations(spark, sf_dir):
    return S.busiest_stations(fixture(spark, sf_dir).stop_events, 10)


def search_queries(fx):
    se = fx.stop_events
    qs = (se.select(F.substring("station_name", 1, 3).alias("q"))
          .unionByName(se.select(F.substring("station_name", 4, 4).alias("q")))
          .unionByName(se.select(F.split_part("station_name", F.lit(" "), F.lit(2)).alias("q")))
          .unionByName(se.select(F.lower(F.substring("final_destination_station", 1, 5)).alias("q"))))
    return qs.distinct().select(F.col("q").alias("query_id"), F.col("q").alias("query"))


@query("station_search", f"""
SELECT query_id, pos, loc_id, ext_id, name FROM (
  SELECT q.query_id, i.loc_id, i.ext_id, i.name,
         row_number() OVER (PARTITION BY q.query_id ORDER BY
            CASE WHEN starts_with(i.norm, q.fq) THEN 0 WHEN contains(i.norm, ' ' || q.fq) THEN 1 ELSE 2 END,
            CASE WHEN i.is_main THEN 0 ELSE 1 END, i.total DESC, i.norm) AS pos
  FROM (SELECT *, {FOLD_SQL.format(x='query')} AS fq FROM o_search_queries) q
  JOIN o_index i ON contains(i.norm, q.fq)
  WHERE q.fq <> '')
WHERE pos <= 8""")
def station_search(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return S.station_search(S.station_index(fx.stop_events), search_queries(fx), limit=8)
