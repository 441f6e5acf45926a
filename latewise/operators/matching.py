"""Matching planned legs to stop-event history.

A leg is matched on (train key, station) plus time of day within a tolerance; per
calendar day the closest observation wins. Lookups are distinct; the closest is found by
running over the minutes of a day, all pairs within the tolerance (J5) by an equi-join on
hour buckets. Spark picks broadcast vs. sort-merge at runtime (AQE) from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latewise.functions.keys import pad_station, strip_zeros
from latewise.functions.timefn import minute_diff, minute_of_day, tod_distance

# Products that are never looked up (unknown or NULL products pass).
UNTRACKED_PRODUCTS = ["BUS", "TRAM", "UBAHN", "SCHIFF", "ANRUFPFLICHTIG"]
TOD_TOLERANCE_MIN = 120


def tracked_product(product="product") -> Column:
    """legs of bus/tram/metro/ship/on-demand get no lookup."""
    p = F.col(product) if isinstance(product, str) else product
    return ~F.coalesce(p, F.lit("")).isin(*UNTRACKED_PRODUCTS)


def lookup_legs(legs: DataFrame, train="fahrt_nr", station="dest_id", planned="planned_arrival",
                walking="walking", product="product") -> DataFrame:
    """Legs that get a history lookup, with the normalised lookup key columns
    ``q_train_no`` (blanks and leading zeros removed) and ``q_eva`` (padded)."""
    tn = F.col(train).cast("string")
    return (legs
            .filter(~F.col(walking) & tracked_product(product)
                    & tn.isNotNull() & (tn != "") & F.col(planned).isNotNull() & F.col(station).isNotNull())
            .withColumn("q_train_no", strip_zeros(F.regexp_replace(tn, " ", "")))
            .withColumn("q_eva", pad_station(F.col(station).cast("string"))))


def coverage_max_day(events: DataFrame, planned="arrival_planned_time") -> Column:
    """Newest planned-arrival day of the table as a scalar subquery (A4's max): a scan of
    that one column."""
    return F.to_date(events.select(F.max(planned)).scalar())


def history_side(events: DataFrame, side: str = "arrival") -> DataFrame:
    """Projection of the keyed stop events needed for matching on one side."""
    planned, change = f"{side}_planned_time", f"{side}_change_time"
    cols = [F.col("train_no").alias("h_train_no"), F.col("eva").alias("h_eva"),
            F.col(planned).alias("h_planned"), F.col(change).alias("h_change"),
            minute_diff(planned, change).alias("h_delay"),
            F.col("is_canceled").alias("h_canceled"), F.col("id").alias("h_id"),
            F.to_date(planned).alias("h_day")]
    if "reason_code" in events.columns:
        cols.append(F.col("reason_code").alias("h_reason"))
    else:
        cols.append(F.lit(None).cast("int").alias("h_reason"))
    if "service_day" in events.columns:
        cols.append("service_day")
    return events.filter(F.col(planned).isNotNull()).select(*cols)


def service_day() -> Column:
    """The day a stop event is filed under: that of its planned arrival, else departure."""
    return F.to_date(F.coalesce("arrival_planned_time", "departure_planned_time"))


def _window_history(keyed: DataFrame, window_days: int, max_day: Column | None) -> tuple[DataFrame, Column, Column]:
    """The arrivals of the ``window_days`` days that end at ``max_day``: (events, cutoff, max_day)."""
    max_day = coverage_max_day(keyed) if max_day is None else max_day
    cutoff = F.date_sub(max_day, window_days - 1)
    hist = history_side(keyed, "arrival").filter(F.col("h_day") >= cutoff)
    if "service_day" in hist.columns:
        # the partition column of the stored table: only the window's folders are read
        hist = hist.filter(F.col("service_day") >= cutoff)
    return hist, cutoff, max_day


def history_candidates(legs: DataFrame, keyed: DataFrame, window_days: int = 7,
                       max_day: Column | None = None, key_cols=("journey_id", "leg_idx")):
    """Lookups (legs by train key, station, time of day) joined with the stop events
    of the window on (train key, station), kept within 120 min of time of day.
    Returns (lookup legs, candidates: a row per leg and event, cutoff, max_day)."""
    ql = lookup_legs(legs).withColumn("q_tod", minute_of_day("planned_arrival"))
    hist, cutoff, max_day = _window_history(keyed, window_days, max_day)
    # band join on the time-of-day circle as an equi-join on hours: an event stands in the 5 hours
    # that +-120 min can reach it from, a lookup asks in its own; the exact distance is filtered
    # afterwards. This also spreads a hot (train, station) key over 24 join keys. Pairs grow with
    # the square of the input, so they are made last, as the output of the one join, and are not
    # shuffled: legs and events travel, with the columns that tell a pair
    q = ql.select(*key_cols, *LOOKUP_KEY, F.floor(F.col("q_tod") / 60).cast("int").alias("bucket"))
    hist = hist.select("h_train_no", "h_eva", "h_planned", "h_id", F.explode(F.transform(
        F.sequence(F.lit(-2), F.lit(2)), lambda k: F.pmod(F.hour("h_planned") + k, F.lit(24)))).alias("h_bucket"))
    cand = (q.join(hist, (q.q_train_no == hist.h_train_no) & (q.q_eva == hist.h_eva) & (q.bucket == hist.h_bucket))
            .withColumn("tod_diff", tod_distance(minute_of_day("h_planned"), F.col("q_tod")))
            .filter(F.col("tod_diff") <= TOD_TOLERANCE_MIN))
    return ql, cand, cutoff, max_day


LOOKUP_KEY = ["q_train_no", "q_eva", "q_tod"]


def _beside(events: DataFrame, probes: DataFrame, place: list[str], near: Column) -> DataFrame:
    """``probes`` (``place``, minute ``_at``, any other columns) with the events of their place
    next to them, as struct ``near`` of an event row (``place``, ``_at``, ...): ``_before``, at or
    before the probe's minute, and ``_after``, at or after it. Two runs over each place."""
    kind = events.select(near.alias("n")).schema["n"].dataType
    more = [c for c in probes.columns if c not in (*place, "_at")]
    none = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in more]
    rows = (events.select(*place, "_at", F.lit(0).alias("_asks"), *none, near.alias("_near"))
            .unionByName(probes.select(*place, "_at", F.lit(1).alias("_asks"), *more, F.lit(None).cast(kind).alias("_near"))))
    # an event comes before a probe of its own minute in either direction
    upto = lambda t: Window.partitionBy(*place).orderBy(t, "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn("_before", F.last("_near", ignorenulls=True).over(upto(F.col("_at").asc())))
            .withColumn("_after", F.last("_near", ignorenulls=True).over(upto(F.col("_at").desc())))
            .filter("_asks = 1").drop("_asks", "_near"))


#: What the matching returns of the chosen event, and the order among equally near ones.
CHOSEN = ["h_planned", "h_change", "h_id", "h_delay", "h_canceled", "h_reason"]


def _first_of_minute(hist: DataFrame) -> DataFrame:
    """Per train, station, day and minute of :func:`history_side` rows the event that comes first
    among equally near ones (planned time, known change time, stop id), as struct ``_e``."""
    order = ["h_planned", F.col("h_change").isNull().alias("_no_change"), "h_change", F.col("h_id").isNull().alias("_no_id"), "h_id"]
    return (hist.filter(F.col("h_train_no").isNotNull() & F.col("h_eva").isNotNull())
            .groupBy(F.col("h_train_no").alias("q_train_no"), F.col("h_eva").alias("q_eva"), "h_day", minute_of_day("h_planned").alias("_tod"))
            .agg(F.min(F.struct(*order, "h_delay", "h_canceled", "h_reason")).alias("_e")))


def nearest_per_day(legs: DataFrame, keyed: DataFrame, window_days: int = 7, max_day: Column | None = None):
    """Per distinct lookup and calendar day of the window the stop event nearest in time of
    day, within 120 min; ties by planned time, known change time, stop id. Returns (lookup legs,
    chosen events, cutoff, max_day).

    No lookup is compared with all events of its train and station: of the events of one minute
    only the first can be chosen, and what is nearest to a lookup is the last event before it or
    the first one after it. Both come from running over the (at most 1,440) minutes of a train,
    station and day. An event near midnight stands on both ends of its day, as times of day are
    compared on the circle."""
    ql = lookup_legs(legs).withColumn("q_tod", minute_of_day("planned_arrival"))
    hist, cutoff, max_day = _window_history(keyed, window_days, max_day)
    place = ["q_train_no", "q_eva", "h_day"]
    minutes = _first_of_minute(hist)
    early, late = F.col("_tod") <= TOD_TOLERANCE_MIN, F.col("_tod") >= 1440 - TOD_TOLERANCE_MIN
    at = F.explode(F.when(early, F.array("_tod", F.col("_tod") + 1440)).when(late, F.array("_tod", F.col("_tod") - 1440)).otherwise(F.array("_tod")))
    events = minutes.select(*place, at.alias("_at"), "_e")
    asked = ql.select(*LOOKUP_KEY).distinct().join(minutes.select(*place).distinct(), ["q_train_no", "q_eva"])
    best = _beside(events, asked.withColumn("_at", F.col("q_tod")), place, F.struct("_at", "_e"))
    # (struct of the distance and the event's order; a side without an event is null)
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}._at") - F.col("q_tod")).alias("tod_diff"), F.col(f"{c}._e").alias("e")))
    best = best.select(*LOOKUP_KEY, "h_day", F.least(side("_before"), side("_after")).alias("_b"))
    best = best.filter(F.col("_b.tod_diff") <= TOD_TOLERANCE_MIN)
    return ql, best.select(*LOOKUP_KEY, "h_day", "_b.tod_diff", *(F.col(f"_b.e.{c}").alias(c) for c in CHOSEN)), cutoff, max_day


def closest_per_day(legs: DataFrame, keyed: DataFrame, window_days: int = 7) -> DataFrame:
    """W3 per leg: the chosen observation of each calendar day."""
    ql, best, _, _ = nearest_per_day(legs, keyed, window_days)
    return ql.join(best, LOOKUP_KEY).select("journey_id", "leg_idx", F.col("h_day").alias("day"),
                                            F.col("h_id").alias("id"), "tod_diff")


def leg_delay_stats(legs: DataFrame, keyed: DataFrame, window_days: int = 7,
                    max_day: Column | None = None, with_days: bool = True) -> DataFrame:
    """Per leg, over the ``window_days`` days ending at the table's last day: median
    (1 decimal) and max of non-cancelled known delays, days matched, cancelled days,
    the window bounds and the per-day array sorted by day. Legs without any match
    are absent.

    ``legs`` must carry ``journey_id, leg_idx`` plus the lookup columns of
    :func:`lookup_legs`.
    """
    ql, best, cutoff, max_day = nearest_per_day(legs, keyed, window_days, max_day)
    key = LOOKUP_KEY

    ok = ~F.col("h_canceled") & F.col("h_delay").isNotNull()
    aggs = [F.bround(F.median(F.when(ok, F.col("h_delay"))), 1).alias("median_delay"),
            F.max(F.when(ok, F.col("h_delay"))).alias("max_delay"),
            F.count(F.lit(1)).alias("days_matched"),
            F.sum(F.when(F.col("h_canceled"), 1).otherwise(0)).cast("long").alias("canceled_days")]
    if with_days:
        aggs.append(F.sort_array(F.collect_list(F.struct(
            F.col("h_day").alias("day"),
            F.when(~F.col("h_canceled"), F.col("h_delay")).alias("delay"),
            F.col("h_canceled").alias("canceled"),
            F.col("h_reason").alias("reason")))).alias("days"))
    stats = best.groupBy(*key).agg(*aggs)
    out = (ql.join(stats, key)
           .withColumn("window_start", cutoff)
           .withColumn("window_end", max_day))
    cols = ["journey_id", "leg_idx", "median_delay", "max_delay", "days_matched",
            "canceled_days", "window_start", "window_end"]
    return out.select(*cols, *(["days"] if with_days else []))


def leg_delay_windows(legs: DataFrame, keyed: DataFrame, windows: tuple[int, ...] = (7, 15, 30), max_day: Column | None = None) -> DataFrame:
    """A8 for several windows in one scan: a row per leg and window in which it has a match, with
    the columns of :func:`leg_delay_stats` and ``window_days``. The longest window is matched
    once; a day's chosen observation is the same in every window that holds the day, so each
    lookup keeps a count of days by (delay, window), and the windows are read from those counts."""
    ql, best, _, max_day = nearest_per_day(legs, keyed, max(windows), max_day)
    best = best.withColumn("window_end", max_day)
    starts = F.array(*(F.struct(F.lit(w).alias("window_days"), F.date_sub("window_end", w - 1).alias("window_start")) for w in sorted(windows)))
    # a few windows a day: which of them hold it
    held = best.select(*LOOKUP_KEY, "h_delay", "h_canceled", "h_day", "window_end", F.inline(starts)).filter(F.col("window_start") <= F.col("h_day"))
    window = ["window_days", "window_start", "window_end"]
    counted = held.groupBy(*LOOKUP_KEY, *window, "h_canceled", "h_delay").agg(F.count(F.lit(1)).alias("c"))
    known = F.when(~F.col("h_canceled"), F.col("h_delay"))
    stats = counted.groupBy(*LOOKUP_KEY, *window).agg(
        F.bround(F.percentile(known, F.lit(0.5), F.col("c")), 1).alias("median_delay"), F.max(known).alias("max_delay"),
        F.sum("c").alias("days_matched"), F.sum(F.when(F.col("h_canceled"), F.col("c")).otherwise(0)).alias("canceled_days"))
    return ql.join(stats, LOOKUP_KEY).select(
        "journey_id", "leg_idx", "window_days", "median_delay", "max_delay", "days_matched", "canceled_days", "window_start", "window_end")


def leg_on_date(legs: DataFrame, keyed: DataFrame, side: str = "arrival",
                planned_col: str | None = None, key_cols=("journey_id", "leg_idx"),
                train="fahrt_nr", station="dest_id") -> DataFrame:
    """The exact delay of a leg on its own calendar day. Same train,
    station and time-of-day match; the observation with the planned instant nearest the
    leg's wins. Unknown change -> 0 (on time), cancelled -> delay NULL. Legs without a
    match are absent."""
    planned_col = planned_col or f"planned_{side}"
    tn = F.col(train).cast("string")
    legs = (legs.filter(tn.isNotNull() & (tn != "") & F.col(planned_col).isNotNull() & F.col(station).isNotNull())
            .select(*key_cols,
                    strip_zeros(F.regexp_replace(tn, " ", "")).alias("q_train_no"),
                    pad_station(F.col(station).cast("string")).alias("q_eva"),
                    F.col(planned_col).alias("q_planned")))
    # distinct lookups: a popular leg is matched once, however many journeys ride it
    asked = ["q_train_no", "q_eva", "q_planned"]
    q = legs.select(*asked).distinct().withColumns({"h_day": F.to_date("q_planned"), "_tod": minute_of_day("q_planned")})
    hist = history_side(keyed, side)
    if "service_day" in hist.columns:
        # events are filed under the day of the arrival, which may be the one before a departure's
        back = 0 if side == "arrival" else 1
        lo, hi = (legs.select(f(F.to_date("q_planned"))).scalar() for f in (F.min, F.max))
        hist = hist.filter((F.col("service_day") >= F.date_sub(lo, back)) & (F.col("service_day") <= hi))
        hist = hist.filter((F.col("service_day") <= F.col("h_day")) & (F.col("service_day") >= F.date_sub("h_day", back)))
    # on one day the nearest is beside the lookup, or, if none is within the tolerance there, the
    # nearest of those at the other end of the day that are within it on the circle
    place, far = ["q_train_no", "q_eva", "h_day"], 1440 - TOD_TOLERANCE_MIN
    at = F.explode(F.filter(F.array(F.col("_tod"), F.col("_tod") + far, F.col("_tod") - far), lambda t: (t >= 0) & (t < 1440)))
    near = _beside(_first_of_minute(hist).withColumn("_at", F.col("_tod")), q.select(*asked, "h_day", "_tod", at.alias("_at")), place, F.struct("_at", "_e"))

    def reached(c: str) -> Column:
        diff = F.abs(F.col(f"{c}._at") - F.col("_tod"))
        return F.when((diff <= TOD_TOLERANCE_MIN) | (diff >= far), F.struct(diff.alias("abs_diff"), F.col(f"{c}._e").alias("e")))
    best = (near.select(*place, "q_planned", F.least(reached("_before"), reached("_after")).alias("_b"))
            .groupBy(*place, "q_planned").agg(F.min("_b").alias("_b")).filter(F.col("_b").isNotNull())
            .select(*asked, *(F.col(f"_b.e.{c}").alias(c) for c in CHOSEN)))
    cols = [*key_cols,
            F.when(~F.col("h_canceled"), F.coalesce(F.col("h_delay"), F.lit(0))).alias("delay_min"),
            F.col("h_canceled").alias("canceled")]
    if side == "arrival":
        cols.append(F.col("h_reason").alias("reason"))
    return legs.join(best, asked).select(*cols)
