"""Station lists and crosswalk building over landed tables.

The reference resolves stations by remote lookups; here the lookup answers are landed
as candidate tables and every rule is a join: seeding is an anti-join plus a union,
candidate acceptance a join on the query key plus a first-by-rank pick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latewise.functions.keys import pad_station, station_code_to_uic
from latewise.functions.text import geo_distance_km

# Product classes that prove a location sees trains.
TRAIN_PRODUCT_NAMES = ["ICE", "EC_IC", "IR", "REGIONAL", "SBAHN"]
UIC_TOKEN = r"i=U.00(\d{7})"


def _first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def station_list(raw: DataFrame, code: str = "code", value_cols: tuple = ("uic", "name_long"),
                 order: str = "line_no") -> DataFrame:
    """Trim, lower-case the code, drop blanks; a repeated code keeps its last row
    (dictionary semantics, by file order ``order``)."""
    c = F.lower(F.trim(F.col(code)))
    r = raw.withColumn("_code", c).filter(F.col("_code").isNotNull() & (F.col("_code") != ""))
    last = _first(r, ["_code"], [F.col(order).desc()])
    return last.select(F.col("_code").alias("code"), *[F.trim(F.col(v)).alias(v) for v in value_cols])


def country_station_counts(stations: DataFrame, country: str = "country") -> DataFrame:
    """Stations per country, most common first."""
    return stations.groupBy(country).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), country)


def gtfs_rank(stop_times: DataFrame, trips: DataFrame, routes: DataFrame, stops: DataFrame, top: int | None = None) -> DataFrame:
    """Rail stop events per parent station (else the stop itself), joined back to
    the stops for name and position; all of them, or the ``top`` busiest, busiest first."""
    s = stops.select("stop_id", "parent_station")
    ev = (stop_times.select("trip_id", "stop_id").join(trips.select("trip_id", "route_id"), "trip_id")
          .join(routes.filter(F.col("route_type") == "2").select("route_id"), "route_id")
          .join(s, "stop_id")
          .groupBy(F.coalesce("parent_station", "stop_id").alias("pid")).agg(F.count(F.lit(1)).alias("n")))
    p = stops.select(F.col("stop_id").alias("pid"), "stop_name", F.col("stop_lat").cast("double").alias("lat"),
                     F.col("stop_lon").cast("double").alias("lon"))
    ranked = ev.join(p, "pid").select("pid", "stop_name", "lat", "lon", "n")
    return ranked if top is None else ranked.orderBy(F.desc("n"), "pid").limit(top)


def geo_match(ranked: DataFrame, candidates: DataFrame, max_km: float = 2.0) -> DataFrame:
    """Per ranked station the first candidate (by rank) that is a station (type
    'ST') with a 7-digit '81' id, a train product, coordinates, and within ``max_km``.
    Candidates are joined on the query name (the lookup they answer), which is the stop's name
    without a trailing "Bahnhof" or "Bahnhst" (those pull the lookup toward bus stops)."""
    c = candidates.filter((F.col("type") == "ST") & F.col("ext_id").startswith("81") & (F.length("ext_id") == 7)
                          & F.arrays_overlap(F.col("products"), F.array(*[F.lit(p) for p in TRAIN_PRODUCT_NAMES]))
                          & F.col("c_lat").isNotNull() & F.col("c_lon").isNotNull())
    j = ranked.join(c, F.regexp_replace("stop_name", r"\s+(Bahnhof|Bahnhst)$", "") == c.query)
    j = j.filter(geo_distance_km("lat", "lon", "c_lat", "c_lon") < max_km)
    return _first(j, ["pid"], [F.col("rank")]).select("pid", "stop_name", "ext_id", F.col("c_name").alias("bahn_name"))


def _acceptable(candidates: DataFrame) -> DataFrame:
    """J10's candidates: stations with a 7-digit '81' id, a train product and coordinates."""
    return candidates.filter((F.col("type") == "ST") & F.col("ext_id").startswith("81") & (F.length("ext_id") == 7)
                             & F.arrays_overlap(F.col("products"), F.array(*[F.lit(p) for p in TRAIN_PRODUCT_NAMES]))
                             & F.col("c_lat").isNotNull() & F.col("c_lon").isNotNull())


KM_PER_DEGREE = 111.32


def _band_width(band: Column, height: float) -> Column:
    """Degrees of longitude of a grid cell in a latitude band: what ``height`` degrees of latitude
    measure at the end of the neighbouring band that is nearer to a pole."""
    edge = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * height, F.lit(89.9))
    return F.lit(height) / F.cos(F.radians(edge))


def within_distance(points: DataFrame, places: DataFrame, max_km: float) -> DataFrame:
    """All pairs of a point (``lat``, ``lon``) and a place (``c_lat``, ``c_lon``) less than
    ``max_km`` apart, with ``km``. A place is filed in a grid cell whose sides measure ``max_km``
    or more; a point asks the nine cells around it, an equi-join, and the exact distance
    decides. Rows without a position are in no pair."""
    height = max_km / KM_PER_DEGREE
    band = lambda lat: F.floor(F.col(lat) / height).cast("long")
    cell = lambda lon: F.floor(F.col(lon) / _band_width(F.col("_band"), height)).cast("long")
    around = F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))
    p = (points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("_step", around).withColumn("_band", band("lat") + F.col("_step"))
         .withColumn("_step", around).withColumn("_cell", cell("lon") + F.col("_step")).drop("_step"))
    c = places.filter(F.col("c_lat").isNotNull() & F.col("c_lon").isNotNull()).withColumn("_band", band("c_lat"))
    c = c.withColumn("_cell", cell("c_lon"))
    j = p.join(c, ["_band", "_cell"]).withColumn("km", geo_distance_km("lat", "lon", "c_lat", "c_lon"))
    return j.filter(F.col("km") < max_km).drop("_band", "_cell")


def geo_near(ranked: DataFrame, candidates: DataFrame, max_km: float = 2.0) -> DataFrame:
    """J10 by place alone, for stations whose name no lookup answered: the nearest acceptable
    candidate within ``max_km`` (ties: rank, id), however it is called."""
    j = within_distance(ranked.select("pid", "stop_name", "lat", "lon"), _acceptable(candidates), max_km)
    best = F.min(F.struct("km", "rank", "ext_id", "c_name"))
    return j.groupBy("pid", "stop_name").agg(best.alias("b")).select("pid", "stop_name", "b.ext_id", F.col("b.c_name").alias("bahn_name"), F.round("b.km", 6).alias("km"))


def seed_crosswalk(universe: DataFrame, existing: DataFrame, seed: DataFrame) -> DataFrame:
    """Universe codes without an entry take the seed's id (and the universe name)."""
    new = (universe.join(existing.select("code"), "code", "left_anti")
           .join(seed.select("code", F.col("eva").alias("s_eva")), "code")
           .select("code", F.col("s_eva").alias("eva"), "name", F.lit("seed").alias("src")))
    return existing.select("code", "eva", "name", F.lit("existing").alias("src")).unionByName(new)


def accepted_lookup(codes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per code the first candidate (by rank) whose location id carries the code's
    national 7-digit token and that has an id; the id is padded to 8."""
    q = codes.withColumn("uic7", station_code_to_uic("code")).filter(F.col("uic7").isNotNull())
    c = candidates.withColumn("token", F.regexp_extract("loc_id", UIC_TOKEN, 1))
    j = q.join(c, "code").filter((F.col("token") == F.col("uic7")) & F.col("ext_id").isNotNull() & (F.col("ext_id") != ""))
    best = _first(j, ["code"], [F.col("rank")])
    return best.select("code", pad_station("ext_id").alias("eva"), F.coalesce("c_name", "name").alias("name"))


def token_match(universe: DataFrame, crosswalk: DataFrame, candidates: DataFrame) -> DataFrame:
    """J9 applied to the codes still missing from the crosswalk."""
    missing = universe.join(crosswalk.select("code"), "code", "left_anti")
    return accepted_lookup(missing, candidates)


def seed_verify(universe: DataFrame, crosswalk: DataFrame, seed: DataFrame, candidates: DataFrame,
                sample: int | None = None) -> DataFrame:
    """The seeded codes are looked up (on request the first ``sample`` in code order); a
    differing answer overrides the seed. Returns (code, seed_eva, lookup_eva, mismatch)."""
    seeded = (universe.select("code", "name").join(seed.select("code"), "code")
              .join(crosswalk.select("code", F.col("eva").alias("seed_eva")), "code"))
    s = seeded if sample is None else seeded.orderBy("code").limit(sample)
    hit = accepted_lookup(s.select("code", "name"), candidates).select("code", F.col("eva").alias("lookup_eva"))
    r = s.join(hit, "code", "left")
    return r.select("code", "seed_eva", "lookup_eva",
                    (F.col("lookup_eva").isNotNull() & (F.col("lookup_eva") != F.col("seed_eva"))).alias("mismatch"))


def hub_select(universe: DataFrame, crosswalk: DataFrame, seed: DataFrame, board_counts: DataFrame, top: int) -> DataFrame:
    """Flagged (seed main) or type-1 mapped stations, set-united with the ``top``
    busiest mapped stations by board size; sorted by code."""
    mapped = universe.join(crosswalk.select("code"), "code")
    flagged = (mapped.join(seed.select("code", "main"), "code", "left")
               .filter(F.coalesce("main", F.lit(False)) | (F.col("tipo") == 1)).select("code", "name"))
    busiest = (mapped.join(board_counts, "code").orderBy(F.desc("n"), "code").limit(top).select("code", "name"))
    return flagged.union(busiest).distinct().orderBy("code")
