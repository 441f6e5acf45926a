"""Persistence studies: do a train's past delays predict its future ones.

The unit of these studies is a train (type + run number), so the per-train tables are
bounded by the number of distinct trains, not by the number of stop events; the event
scan and the per-train averages are ordinary partial aggregations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latewise.functions.keys import strip_zeros
from latewise.operators.ordered import average_rank, linear_quantile, positions, ranked_values
from latewise.session import stored


def train_label() -> Column:
    return F.concat(F.col("train_type"), F.lit(" "), strip_zeros("train_number"))


def _usable(events: DataFrame, cancelled: Column) -> DataFrame:
    return events.filter(~cancelled & F.col("delay_in_min").isNotNull() & F.col("train_number").isNotNull()
                         & (F.col("train_number") != ""))


def period_profile(events: DataFrame, start, split, end, min_stops: int,
                   cancelled: Column | None = None) -> DataFrame:
    """Per train the average delay and stop count before and from ``split``
    (days in [start, end]); trains with fewer than ``min_stops`` in either part dropped."""
    cancelled = F.col("is_canceled") if cancelled is None else cancelled
    e = (_usable(events, cancelled)
         .withColumn("day", F.to_date("time"))
         .filter((F.col("day") >= F.lit(start)) & (F.col("day") <= F.lit(end))))
    first = F.col("day") < F.lit(split)
    g = e.groupBy(train_label().alias("train")).agg(
        F.min("train_type").alias("train_type"),
        F.avg(F.when(first, F.col("delay_in_min"))).alias("h1_avg"),
        F.avg(F.when(~first, F.col("delay_in_min"))).alias("h2_avg"),
        F.count(F.when(first, 1)).alias("h1_n"),
        F.count(F.when(~first, 1)).alias("h2_n"))
    return g.filter((F.col("h1_n") >= min_stops) & (F.col("h2_n") >= min_stops))


def persistence_correlation(profile: DataFrame, min_group: int = 10) -> DataFrame:
    """Pearson and Spearman of first vs second part, overall and per train type;
    groups under ``min_group`` trains dropped; all trains first, then larger groups."""
    allg = profile.withColumn("grp", F.lit("ALL"))
    per = profile.withColumn("grp", F.col("train_type"))
    both = stored(allg.unionByName(per).select("grp", "h1_avg", "h2_avg"), "groups")
    # the ranks of both parts in one pass over their values
    sides = both.select("grp", F.inline(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("v")) for c in ("h1_avg", "h2_avg")))))
    rank = (F.col("_before") + (F.col("_c") + 1) / 2.0).alias("r")
    ranks = stored(ranked_values(sides, "v", ["grp", "side"]).select("grp", "side", "v", rank), "ranks")
    for c, r in (("h1_avg", "r1"), ("h2_avg", "r2")):
        both = both.join(ranks.filter(F.col("side") == c).select("grp", F.col("v").alias(c), F.col("r").alias(r)), ["grp", c])
    g = both.groupBy("grp").agg(F.count(F.lit(1)).alias("n"),
                                F.corr("h1_avg", "h2_avg").alias("pearson"),
                                F.corr("r1", "r2").alias("spearman"))
    g = g.filter(F.col("n") >= min_group)
    return g.select("grp", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"),
                    F.when(F.col("grp") == "ALL", F.lit(0)).otherwise(F.lit(1)).alias("is_type")).orderBy("is_type", F.desc("n"), "grp")


def persistence_quintiles(profile: DataFrame) -> DataFrame:
    """Quintile of the first-part average's percent rank; per quintile trains,
    mean h1, mean h2, median h2 (2 decimals, half to even)."""
    profile = stored(profile.select("h1_avg", "h2_avg"), "profile")
    r = average_rank(profile, "h1_avg", None, "r1")
    q = (F.floor(F.least(F.col("r1_pct") * 5, F.lit(4.999))) + 1).cast("int")
    r = stored(r.select(q.alias("quintile"), "h1_avg", "h2_avg"), "quintiles")
    median = positions(r, "h2_avg", ["quintile"]).groupBy("quintile").agg(F.bround(linear_quantile("h2_avg", 0.5), 2).alias("h2_median"))
    return r.groupBy("quintile").agg(
        F.count(F.lit(1)).alias("trains"), F.bround(F.avg("h1_avg"), 2).alias("h1_avg"),
        F.bround(F.avg("h2_avg"), 2).alias("h2_avg")).join(median, "quintile")


AXIS_MAX = 12.0
# Violin bands on the first-part average (lower bound inclusive).
BANDS = [(None, 1.0), (1.0, 2.0), (2.0, 4.0), (4.0, 6.0), (6.0, None)]


def trend_line(profile: DataFrame, axis_max: float = AXIS_MAX) -> DataFrame:
    """Least-squares line over trains inside 0..axis_max on both axes, share inside,
    Pearson over all trains."""
    inside = ((F.col("h1_avg") >= 0) & (F.col("h2_avg") >= 0) & (F.col("h1_avg") <= axis_max)
              & (F.col("h2_avg") <= axis_max))
    y, x = F.when(inside, F.col("h2_avg")), F.when(inside, F.col("h1_avg"))
    return profile.agg(
        F.count(F.lit(1)).alias("trains"), F.count(F.when(inside, 1)).alias("inside"),
        F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"),
        F.round(F.count(F.when(inside, 1)) / F.count(F.lit(1)), 6).alias("share_inside"),
        F.round(F.corr("h1_avg", "h2_avg"), 6).alias("pearson"))


def band_of(h1) -> Column:
    c = F.col(h1) if isinstance(h1, str) else h1
    expr = None
    for i, (lo, hi) in enumerate(BANDS):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (c >= lo)
        if hi is not None:
            cond = cond & (c < hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def violin_groups(profile: DataFrame, axis_max: float = AXIS_MAX) -> DataFrame:
    """Per band n, quartiles of h2 (linear interpolation), share of h2 over the axis."""
    b = positions(profile.withColumn("band", band_of("h1_avg")).select("band", "h2_avg"), "h2_avg", ["band"])
    over = F.sum(F.when(F.col("h2_avg") > axis_max, F.col("_c") * 100.0).otherwise(0.0)) / F.sum("_c")
    return b.groupBy("band").agg(
        F.sum("_c").alias("n"),
        *(F.round(linear_quantile("h2_avg", p), 6).alias(c) for c, p in (("q1", 0.25), ("med", 0.5), ("q3", 0.75))),
        F.round(over, 6).alias("pct_over"))


def violin_density(profile: DataFrame, axis_max: float = AXIS_MAX, step: float = 0.1,
                   bandwidth: float = 0.4) -> DataFrame:
    """Gaussian kernel density of h2 on a fixed grid per band, scaled to the band's
    maximum. Equal values are counted once (exact pre-aggregation), then every distinct
    value contributes to each of the fixed grid points."""
    steps = int(round(axis_max / step))
    vals = (profile.withColumn("band", band_of("h1_avg")).groupBy("band", "h2_avg").agg(F.count(F.lit(1)).alias("k")))
    n = vals.groupBy("band").agg(F.sum("k").alias("n"))
    g = vals.withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    z = (F.col("gi") * step - F.col("h2_avg")) / bandwidth
    d = (g.groupBy("band", "gi").agg(F.sum(F.col("k") * F.exp(-0.5 * z * z)).alias("s"))
         .join(n, "band")
         .withColumn("dens", F.col("s") / math.sqrt(2 * math.pi) / (F.col("n") * bandwidth)))
    w = Window.partitionBy("band")
    return d.select("band", "gi", F.round(F.try_divide(F.col("dens"), F.max("dens").over(w)), 6).alias("width"))


def scatter_sample(profile: DataFrame, n: int, seed: int, axis_max: float = AXIS_MAX) -> DataFrame:
    """A seeded, deterministic sample of n trains inside the axes."""
    inside = ((F.col("h1_avg") >= 0) & (F.col("h2_avg") >= 0) & (F.col("h1_avg") <= axis_max)
              & (F.col("h2_avg") <= axis_max))
    return profile.filter(inside).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "train").cast("binary")), "train").limit(n)
