"""Journey-level scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def compensation_pct(arrival_delay) -> Column:
    """Share of the fare refunded: NULL -> NULL; >= 120 min -> 50; >= 60 -> 25; else 0."""
    d = _c(arrival_delay)
    return F.when(d.isNull(), F.lit(None).cast("int")).when(d >= 120, 50).when(d >= 60, 25).otherwise(0)


def delay_band(median_delay) -> Column:
    """green < 3, yellow < 10, else red; gray if unknown."""
    v = _c(median_delay)
    return F.when(v.isNull(), "gray").when(v < 3, "green").when(v < 10, "yellow").otherwise("red")


def effective_price(price, covered) -> Column:
    """A ticket-covered journey costs nothing on top; otherwise its price (may be NULL)."""
    return F.when(F.coalesce(_c(covered), F.lit(False)), F.lit(0.0)).otherwise(_c(price))


def trip_price(out_price, out_covered, out_partial, ret_price, ret_covered, ret_partial) -> Column:
    """struct(total, covered, partial) of an outbound + return pair. The total is
    NULL if either side is unknown; covered only if both are; partial as soon as any
    side is covered or partial."""
    o = effective_price(out_price, out_covered)
    r = effective_price(ret_price, ret_covered)
    oc, rc = F.coalesce(_c(out_covered), F.lit(False)), F.coalesce(_c(ret_covered), F.lit(False))
    op, rp = F.coalesce(_c(out_partial), F.lit(False)), F.coalesce(_c(ret_partial), F.lit(False))
    return F.struct(F.when(o.isNotNull() & r.isNotNull(), o + r).alias("total"),
                    (oc & rc).alias("covered"), (oc | rc | op | rp).alias("partial"))


def live_if_deviating(live, planned) -> Column:
    """The live time only where it deviates from the schedule."""
    lv, pl = _c(live), _c(planned)
    return F.when(lv.isNotNull() & (pl.isNull() | (lv != pl)), lv)


def is_walking(transport_type) -> Column:
    """A leg is walking unless its transport type is public transport."""
    return ~F.coalesce(_c(transport_type) == "PUBLICTRANSPORT", F.lit(False))
