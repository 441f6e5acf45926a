"""Journey scoring over exploded legs.

A batch of journeys is a leg table (``journey_id, leg_idx, walking, ...``). Every
per-journey rule is a window over ``journey_id`` or a grouped aggregate, so the work
is spread by journey; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latewise.functions.timefn import seconds_between
from latewise.operators.ordered import suffix_min
from latewise.session import stored

TRANSFER_TOLERANCE_MIN = 2
UNLIKELY_EXCESS_MIN = 30


def minutes_between(a, b) -> Column:
    return seconds_between(a, b) / 60.0


def transfer_pairs(legs: DataFrame) -> DataFrame:
    """Consecutive train legs (a, b) with the transfer time: b's departure minus a's
    arrival (live beats planned) minus the walking legs in between. Pairs missing a's
    planned arrival or b's planned departure are dropped."""
    w = Window.partitionBy("journey_id").orderBy("leg_idx")
    walk = F.when(F.col("walking") & F.col("planned_arrival").isNotNull() & F.col("planned_departure").isNotNull(),
                  minutes_between("planned_departure", "planned_arrival")).otherwise(F.lit(0.0))
    t = (legs.withColumn("cum_walk", F.sum(walk).over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .filter(~F.col("walking")))
    nxt = lambda c: F.lead(c).over(w)
    t = t.select("journey_id", F.col("leg_idx").alias("a_idx"), F.col("dest_name").alias("station"),
                 F.col("planned_arrival").alias("a_planned_arrival"), F.col("live_arrival").alias("a_live_arrival"),
                 F.col("cum_walk").alias("a_cum"),
                 nxt("leg_idx").alias("b_idx"), nxt("planned_departure").alias("b_planned_departure"),
                 nxt("live_departure").alias("b_live_departure"), nxt("cum_walk").alias("b_cum"))
    t = t.filter(F.col("b_idx").isNotNull() & F.col("a_planned_arrival").isNotNull()
                 & F.col("b_planned_departure").isNotNull())
    gap = minutes_between(F.coalesce("a_live_arrival", "a_planned_arrival"),
                          F.coalesce("b_live_departure", "b_planned_departure"))
    return t.select("journey_id", "a_idx", "b_idx", "station", "a_planned_arrival", "b_planned_departure",
                    (F.col("b_cum") - F.col("a_cum")).alias("walk_min"),
                    (gap - (F.col("b_cum") - F.col("a_cum"))).alias("transfer_min"))


def _with_stats(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    s = stats.select("journey_id", F.col("leg_idx").alias("a_idx"), "median_delay")
    return pairs.join(s, ["journey_id", "a_idx"]).filter(F.col("median_delay").isNotNull())


def tight_transfers(legs: DataFrame, stats: DataFrame) -> DataFrame:
    """M4: transfers where the arriving leg's median delay leaves <= 2 min; unlikely if
    the median exceeds the transfer by more than 30; minutes floored at 0."""
    p = _with_stats(transfer_pairs(legs), stats)
    p = p.filter(F.col("transfer_min") - F.col("median_delay") <= TRANSFER_TOLERANCE_MIN)
    return p.select("journey_id", F.col("a_idx").alias("leg_index"), F.col("b_idx").alias("dep_leg_index"),
                    "station", "walk_min", "a_planned_arrival", "b_planned_departure",
                    F.greatest(F.lit(0), F.bround("transfer_min", 0).cast("int")).alias("transfer_minutes"),
                    "median_delay",
                    (F.col("median_delay") - F.col("transfer_min") > UNLIKELY_EXCESS_MIN).alias("unlikely"))


def journey_metrics(legs: DataFrame, stats: DataFrame) -> DataFrame:
    """Per journey with a train leg: the final train leg's median (delay score), the
    worst leg median, and the smallest transfer margin after the median (1 decimal)."""
    s = stats.select("journey_id", "leg_idx", "median_delay")
    tl = legs.filter(~F.col("walking")).select("journey_id", "leg_idx").join(s, ["journey_id", "leg_idx"], "left")
    per = tl.groupBy("journey_id").agg(F.max_by("median_delay", "leg_idx").alias("delay_score"),
                                       F.max("median_delay").alias("max_leg_median"))
    m = (_with_stats(transfer_pairs(legs), stats)
         .groupBy("journey_id").agg(F.bround(F.min(F.col("transfer_min") - F.col("median_delay")), 1)
                                    .alias("min_transfer_margin")))
    return per.join(m, "journey_id", "left")


def journey_score(legs: DataFrame, stats: DataFrame) -> DataFrame:
    """A19 plus the tight transfers (count, any unlikely, sorted list) per journey."""
    tt = tight_transfers(legs, stats)
    agg = tt.groupBy("journey_id").agg(
        F.count(F.lit(1)).alias("n_tight"), F.max(F.col("unlikely").cast("int")).cast("boolean").alias("any_unlikely"),
        F.sort_array(F.collect_list(F.struct("leg_index", "dep_leg_index", "station", "transfer_minutes",
                                             "median_delay", "unlikely"))).alias("tight"))
    return (journey_metrics(legs, stats).join(agg, "journey_id", "left")
            .withColumn("n_tight", F.coalesce("n_tight", F.lit(0)))
            .withColumn("any_unlikely", F.coalesce("any_unlikely", F.lit(False))))


def page_order(legs: DataFrame, search_id: Column) -> DataFrame:
    """Per journey: its search page and its position by first planned departure (the
    order the upstream sends; ties by journey id)."""
    w = Window.partitionBy("search_id").orderBy(F.col("first_dep").asc_nulls_last(), "journey_id")
    j = (legs.groupBy("journey_id").agg(
        F.min_by("planned_departure", "leg_idx").alias("first_dep"),
        F.max_by("planned_arrival", "leg_idx").alias("last_arr"),
        F.sum(F.when(~F.col("walking"), 1).otherwise(0)).alias("n_train"))
         .withColumn("search_id", search_id))
    return j.withColumn("orig_pos", F.row_number().over(w))


def _position(df: DataFrame, keys: list[Column], out: str) -> DataFrame:
    w = Window.partitionBy("search_id").orderBy(*keys, F.col("orig_pos"))
    return df.withColumn(out, F.row_number().over(w))


def sort_delay(scored: DataFrame, past: bool = False) -> DataFrame:
    """T5: missing score last, those in page order; then (future mode) unlikely transfers after
    reliable ones, the score, the worst leg median (unknown = 0); ties keep the page order. Past
    mode orders by the delay that was (``arrival_delay``), which already holds the misses."""
    score = F.col("arrival_delay" if past else "delay_score")
    known = lambda c: F.when(score.isNotNull(), c)
    keys = [score.isNull()] + ([] if past else [known(F.col("any_unlikely"))]) + [score.asc_nulls_last()]
    if not past or "max_leg_median" in scored.columns:
        keys.append(known(F.coalesce("max_leg_median", F.lit(0.0))))
    return _position(scored, keys, "pos_delay")


def sort_price(j: DataFrame) -> DataFrame:
    """Covered by the flat ticket = 0; missing price last; ties keep page order."""
    p = F.when(F.col("dticket_covered"), F.lit(0.0)).otherwise(F.col("price"))
    return _position(j, [p.isNull(), p.asc_nulls_last()], "pos_price")


def sort_transfers(j: DataFrame) -> DataFrame:
    """Transfer count, else train legs - 1 (at least 0); ties keep page order."""
    n = F.coalesce(F.col("transfers"), F.greatest(F.col("n_train") - 1, F.lit(0)))
    return _position(j, [n], "pos_transfers")


def sort_risk(j: DataFrame, past: bool = False) -> DataFrame:
    """Future mode by tier (0 no tight transfer, 1 tight, 2 unlikely) and within a tier the
    largest margin first - direct journeys +inf, unknown margin -inf. Past mode by what
    happened: journeys that missed a transfer (``missed_at_leg_idx``) last."""
    if past:
        return _position(j, [F.col("missed_at_leg_idx").isNotNull()], "pos_risk")
    tier = F.when(F.col("any_unlikely"), 2).when(F.col("n_tight") > 0, 1).otherwise(0)
    n = F.coalesce(F.col("transfers"), F.col("n_train") - 1)
    margin = (F.when(n <= 0, F.lit(float("inf")))
              .otherwise(F.coalesce(F.col("min_transfer_margin"), F.lit(float("-inf")))))
    return _position(j, [tier, margin.desc()], "pos_risk")


def journey_key(legs: DataFrame) -> DataFrame:
    """Per journey: first planned departure | last planned arrival | train names (an unknown
    name leaves an empty part)."""
    tr = F.array_join(F.transform(
        F.array_sort(F.filter(F.collect_list(F.struct("leg_idx", "walking", "line_name")), lambda x: ~x.walking)),
        lambda x: F.coalesce(x.line_name, F.lit(""))), "|")
    return legs.groupBy("journey_id").agg(
        F.concat_ws("|", F.date_format(F.min_by("planned_departure", "leg_idx"), "yyyy-MM-dd'T'HH:mm:ss"),
                    F.date_format(F.max_by("planned_arrival", "leg_idx"), "yyyy-MM-dd'T'HH:mm:ss"), tr).alias("jkey"))


def journey_dedup(shown: DataFrame, page: DataFrame) -> DataFrame:
    """Rows of a new page whose key is already shown are dropped; the rest is appended."""
    fresh = page.join(shown.select("search_id", "jkey"), ["search_id", "jkey"], "left_anti")
    return shown.unionByName(fresh)


def flix_leg(operator="operator", name="line_name") -> Column:
    """F8: a leg of a foreign tariff (operator contains 'flix', or the name starts 'FLX')."""
    return (F.coalesce(F.lower(F.col(operator)).contains("flix"), F.lit(False))
            | F.coalesce(F.upper(F.col(name)).startswith("FLX"), F.lit(False)))


def foreign_tariff_journeys(legs: DataFrame) -> DataFrame:
    """F8: journeys with any train leg of a foreign tariff."""
    return (legs.filter(~F.col("walking")).groupBy("journey_id")
            .agg(F.max(flix_leg().cast("int")).cast("boolean").alias("foreign_tariff")))


def return_floor_filter(outbound: DataFrame, returns: DataFrame) -> DataFrame:
    """return journeys (``trip_id, journey_id, first_dep``) leaving at or after the
    outbound's last planned arrival (``trip_id, last_arr``); seconds precision."""
    o = outbound.select("trip_id", F.date_trunc("second", "last_arr").cast("timestamp_ntz").alias("floor"))
    r = returns.join(o, "trip_id")
    return r.filter(F.col("floor").isNull() | (F.col("first_dep") >= F.col("floor"))).drop("floor")


def day_slots(stats: DataFrame) -> DataFrame:
    """One slot per calendar day from window start to end, with the day's record where
    tracked, NULL where not."""
    spine = stats.select("journey_id", "leg_idx", F.explode(F.sequence("window_start", "window_end")).alias("day"), "days")
    rec = F.get(F.filter("days", lambda d: d.day == F.col("day")), F.lit(0))
    return spine.select("journey_id", "leg_idx", "day", rec.delay.alias("delay"), rec.canceled.alias("canceled"), rec.reason.alias("reason"))


def if_missed(tight: DataFrame, jlegs: DataFrame, connections: DataFrame) -> DataFrame:
    """M5: for a tight transfer, the next connection from the departing leg's origin to
    the journey's destination, if missed: ready = planned arrival + walk + median; the
    earliest planned arrival among candidates leaving more than 2 min after ready, of
    no foreign tariff. Transfers that wait for the same thing ask once, and a route's answers
    are minima running back over its departures (:func:`suffix_min`)."""
    w_last = jlegs.filter(~F.col("walking")).groupBy("journey_id").agg(
        F.max_by("dest_id", "leg_idx").alias("final_dest"))
    origin = jlegs.select("journey_id", F.col("leg_idx").alias("dep_leg_index"), "origin_id")
    wait = (F.col("walk_min") + F.col("median_delay") + TRANSFER_TOLERANCE_MIN) * 60
    t = (tight.join(origin, ["journey_id", "dep_leg_index"]).join(w_last, "journey_id")
         .select("journey_id", "leg_index", "origin_id", "final_dest",
                 (F.col("a_planned_arrival") + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))).alias("t")))
    t = stored(t, "tight")  # the statistics behind it are not computed once for each use below
    c = connections.filter(~flix_leg("conn_operator", "conn_name")).select(
        "origin_id", "final_dest", F.col("conn_departure").alias("t"), F.lit(False).alias("at_t"),
        F.struct("conn_arrival", "conn_id").alias("val"))
    best = suffix_min(t, c, ["origin_id", "final_dest"])
    return t.join(best, ["origin_id", "final_dest", "t"]).select(
        "journey_id", "leg_index", F.col("val.conn_id").alias("conn_id"), F.col("val.conn_arrival").alias("arrival"))


def cap_enrichment(tight: DataFrame, pages: DataFrame, cap: int | None = None) -> DataFrame:
    """The tight transfers of a search that get enriched, in page order, then leg order:
    all of them, or on request the first ``cap`` (a bound for an upstream service, which a batch
    job does not ask)."""
    t = tight.join(pages.select("journey_id", "search_id", "orig_pos"), "journey_id")
    if cap is None:
        return t
    w = Window.partitionBy("search_id").orderBy("orig_pos", "leg_index")
    return t.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")
