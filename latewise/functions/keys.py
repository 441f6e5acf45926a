"""Identity helpers: train keys, station ids, ids carried by the national feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_zeros(x) -> Column:
    """Leading zeros removed (``ltrim(x, '0')``)."""
    return F.regexp_replace(_c(x), r"^0+", "")


def nullif_empty(x) -> Column:
    x = _c(x)
    return F.when(x != "", x)


def train_key(train_type="train_type", eva="eva", line_number="line_number",
              train_number="train_number") -> Column:
    """Lookup key of a stop event: German suburban rows key on the line label (blanks
    removed; bare digits get an 'S'), every other row on the run number without zeros."""
    tt, ev, ln, tn = _c(train_type), _c(eva), _c(line_number), _c(train_number)
    de_suburban = (tt == "S") & ev.startswith("080")
    return (F.when(de_suburban & ln.startswith("S"), F.regexp_replace(ln, " ", ""))
            .when(de_suburban & ln.rlike(r"^[0-9]+$"), F.concat(F.lit("S"), ln))
            .otherwise(strip_zeros(tn)))


def ch_train_key(vm_text, line_text, line_id) -> Column:
    """Swiss rows: suburban (S/SN) with a digit in the line text key on those digits,
    everything else on the line id; zeros stripped."""
    vm, lt, li = _c(vm_text), _c(line_text), _c(line_id)
    return (F.when(vm.isin("S", "SN") & lt.rlike(r"\d"), strip_zeros(F.regexp_extract(lt, r"(\d+)", 1)))
            .otherwise(strip_zeros(li)))


def at_train_key(category, line, number) -> Column:
    """Austrian rows: category 's' keys on the first digits of the line, else the run
    number; zeros stripped; empty -> NULL."""
    cat, ln, num = _c(category), _c(line), _c(number)
    digits = F.regexp_extract(ln, r"(\d+)", 1)
    picked = F.when((cat == "s") & ln.isNotNull() & (ln != "") & (digits != ""), digits).otherwise(num)
    return nullif_empty(strip_zeros(F.coalesce(picked, F.lit(""))))


def ride_id(stop_id) -> Column:
    """Ride part of a stop id: everything before ``-<10 digits>-<n>`` ('' if no match)."""
    return F.regexp_extract(_c(stop_id), r"^(.*)-\d{10}-\d+$", 1)


def stop_number(stop_id) -> Column:
    """Last dash-separated part of a stop id as an integer."""
    return F.split_part(_c(stop_id), F.lit("-"), F.lit(-1)).try_cast("int")


def pad_station(stop_id) -> Column:
    """Left-pad to 8 with zeros; longer ids are kept whole (no truncation)."""
    s = _c(stop_id)
    return F.when(F.length(s) < 8, F.lpad(s, 8, "0")).otherwise(s)


# Country of a padded station id (the two digits after the first).
COUNTRY_BY_PREFIX = {"80": "DE", "81": "AT", "83": "IT", "84": "NL", "85": "CH", "87": "FR"}


def country_of(eva) -> Column:
    code = F.substring(_c(eva), 2, 2)
    expr = None
    for k, v in COUNTRY_BY_PREFIX.items():
        expr = (F.when(code == k, F.lit(v)) if expr is None else expr.when(code == k, F.lit(v)))
    return expr.otherwise(code)


def fr_train_number(trip_id) -> Column:
    """Run number out of an ``OCESN<digits>F...`` trip id, zeros stripped, else NULL."""
    d = F.regexp_extract(_c(trip_id), r"^OCESN(\d+)F", 1)
    return F.when(d != "", strip_zeros(d))


def fr_brand(trip_id) -> Column:
    """Brand token of a trip id (``...:TER:...``), default 'SNCF'."""
    b = F.regexp_extract(_c(trip_id), r"^[^:]*:([A-Z]{2,4}):", 1)
    return F.when(b != "", b).otherwise(F.lit("SNCF"))


def stop_uic8(stop_id) -> Column:
    """Trailing 8-digit station code of a stop id, else NULL."""
    d = F.regexp_extract(_c(stop_id), r"(\d{8})$", 1)
    return F.when(d != "", d)


def realtime_id_parts(rid) -> Column:
    """``IFF:<type>:<number>`` with exactly two colons -> struct(train_type, train_key,
    train_number); anything else -> NULL."""
    r = _c(rid)
    parts = F.split(r, ":")
    ok = r.startswith("IFF:") & (F.size(parts) == 3)
    return F.when(ok, F.struct(
        parts.getItem(1).alias("train_type"),
        F.concat_ws(":", parts.getItem(1), parts.getItem(2)).alias("train_key"),
        strip_zeros(parts.getItem(2)).alias("train_number")))


def station_code_to_uic(code) -> Column:
    """``S`` + 5 digits -> '83' + digits, else NULL."""
    c = _c(code)
    return F.when(c.rlike(r"^S\d{5}$"), F.concat(F.lit("83"), F.substring(c, 2, 5)))


def live_line_label(line, category) -> Column:
    """Line label without blanks; bare digits of category S get an 'S'."""
    ln = F.regexp_replace(_c(line), " ", "")
    return F.when((ln != "") & ln.rlike(r"^\d+$") & (_c(category) == "S"), F.concat(F.lit("S"), ln)) \
        .otherwise(F.when(ln != "", ln))
