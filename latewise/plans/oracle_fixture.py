"""DuckDB twin of ``latewise.sources.fixture``: the same derived tables as SQL CTEs.

``cte(body)`` prepends only the CTEs the body mentions (and their dependencies), so each
oracle query is one self-contained statement over the driver's pre-registered views.
"""

from __future__ import annotations

import re

from latewise.sources.fixture import (CONNECTION_OFFSETS_MIN, EVA_PREFIX, STATION_LONG,
                                      STATION_SHORT, TRAIN_TYPES)


def _lst(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def minutes_sql(a: str, b: str) -> str:
    """Minute boundaries crossed from a to b, by whole minutes since the epoch."""
    return f"CAST(floor(epoch({b}) / 60) - floor(epoch({a}) / 60) AS INTEGER)"


def tod_distance_sql(a: str, b: str) -> str:
    """Distance of two times of day on the 24 h circle, in minutes."""
    step = f"(hour({a}) * 60 + minute({a}) - hour({b}) * 60 - minute({b}))"
    return f"least(({step} + 1440) % 1440, (1440 - {step}) % 1440)"


# the label of a German suburban line, else the run number
LABEL_SQL = ("CASE WHEN left(line_number, 1) = 'S' THEN replace(line_number, ' ', '') "
             "WHEN line_number <> '' AND translate(line_number, '0123456789', '') = '' THEN 'S' || line_number END")
TRAIN_NO = f"coalesce(CASE WHEN train_type = 'S' AND left(eva, 3) = '080' THEN {LABEL_SQL} END, ltrim(train_number, '0'))"

CTES: dict[str, str] = {}

CTES["fx_r0"] = f"""
SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
       l_extendedprice AS price, l_quantity AS qty, l_returnflag AS rf, l_shipdate AS ship,
       (((l_orderkey*7 + l_partkey*13 + l_linenumber*17) % 91) * (l_partkey % 8)) // 8 - 10 AS dm,
       TIMESTAMP '2026-07-01'
         + to_days(CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 31 AS INTEGER))
         + to_minutes(CAST((l_suppkey*37 + l_linenumber*53) % 1440 AS BIGINT)) AS pa,
       CAST((l_suppkey // 6) % 12 AS INTEGER) AS st_idx
FROM lineitem"""

CTES["responses"] = f"""
SELECT ok, ln, pk, sk, price,
  '-' || CAST(ok*31 AS VARCHAR) || '-' || lpad(CAST(ok AS VARCHAR), 10, '0') || '-' || CAST(ln AS VARCHAR) AS id,
  ship AS xml_timestamp,
  CASE WHEN ok % 10 = 0 THEN {_lst(STATION_SHORT)}[st_idx + 1] ELSE {_lst(STATION_LONG)}[st_idx + 1] END AS station_name,
  {_lst(STATION_LONG)}[st_idx + 1] AS xml_station_name,
  {_lst(EVA_PREFIX)}[CAST(sk % 6 AS INTEGER) + 1] || lpad(CAST(st_idx AS VARCHAR), 5, '0') AS eva,
  lpad(CAST(pk % 40 AS VARCHAR), 5, '0') AS train_number,
  CASE WHEN pk % 4 = 2 THEN CASE WHEN pk % 3 = 0 THEN 'S ' || CAST(pk % 9 AS VARCHAR)
                                 WHEN pk % 3 = 1 THEN 'S' || CAST(pk % 9 AS VARCHAR)
                                 ELSE CAST(pk % 9 AS VARCHAR) END END AS line_number,
  {_lst(STATION_LONG)}[CAST(pk % 12 AS INTEGER) + 1] AS final_destination_station,
  {_lst(TRAIN_TYPES)}[CAST(pk % 4 AS INTEGER) + 1] AS train_type,
  CASE WHEN ln = 1 AND ok % 4 = 0 THEN NULL ELSE pa END AS arrival_planned_time,
  CASE WHEN ln = 7 THEN NULL ELSE pa + INTERVAL 3 MINUTE END AS departure_planned_time,
  CASE WHEN (ln % 5 = 0 AND ok % 3 = 0) OR (ln = 1 AND ok % 4 = 0) THEN NULL
       ELSE pa + to_minutes(CAST(dm AS BIGINT)) + to_seconds(CAST(ok % 60 AS BIGINT)) END AS arrival_change_time,
  CASE WHEN (ln % 5 = 0 AND ok % 3 = 0) OR ln = 7 THEN NULL
       ELSE pa + to_minutes(CAST(dm + 2 AS BIGINT)) + to_seconds(CAST(ok % 60 AS BIGINT)) END AS departure_change_time,
  (rf = 'R' AND ln % 3 = 0) AS is_canceled,
  CASE WHEN dm >= 30 AND pk % 3 > 0 THEN CAST(CAST(floor(qty) AS BIGINT) % 69 + 1 AS INTEGER) END AS reason_code,
  ship + to_minutes(CAST(pk % 5 AS BIGINT)) AS reason_ts
FROM fx_r0"""

CTES["fx_latest"] = """
SELECT * FROM responses
QUALIFY row_number() OVER (PARTITION BY id ORDER BY xml_timestamp DESC, pk DESC, sk DESC, price DESC) = 1"""

CTES["stop_events"] = f"""
SELECT e.* EXCLUDE (ok, ln, pk, sk, price, xml_timestamp, reason_ts), d.delay_in_min, d.time,
  '-' || e.ok * 31 AS train_line_ride_id, CAST(e.ln AS INTEGER) AS train_line_station_num
FROM fx_latest e JOIN (
  SELECT id, coalesce({minutes_sql('departure_planned_time', 'departure_change_time')},
                      {minutes_sql('arrival_planned_time', 'arrival_change_time')}) AS delay_in_min,
         coalesce(departure_change_time, arrival_change_time, departure_planned_time, arrival_planned_time) AS time
  FROM fx_latest) d ON d.id = e.id"""

CTES["keyed"] = f"""
SELECT *, {TRAIN_NO} AS train_no, CAST(coalesce(arrival_planned_time, departure_planned_time) AS DATE) AS service_day
FROM stop_events"""

CTES["plan_msgs"] = """
SELECT id, station_name, xml_station_name, eva, train_number, line_number, final_destination_station,
       train_type, arrival_planned_time, departure_planned_time, xml_timestamp,
       pk AS tb_part, sk AS tb_supp, price AS tb_price
FROM responses"""

CTES["change_msgs"] = """
SELECT id, arrival_change_time, departure_change_time, is_canceled, reason_code, reason_ts, xml_timestamp,
       pk AS tb_part, sk AS tb_supp, price AS tb_price
FROM responses
WHERE arrival_change_time IS NOT NULL OR departure_change_time IS NOT NULL OR is_canceled"""

CTES["legs"] = f"""
SELECT ok AS journey_id, ln AS leg_idx, ln % 4 = 0 AS walking, {TRAIN_NO} AS fahrt_nr,
  eva AS dest_id, station_name AS dest_name,
  concat_ws(' ', train_type, {TRAIN_NO}) AS line_name,
  CASE WHEN pk % 11 = 0 THEN 'BUS' WHEN pk % 11 = 1 THEN NULL ELSE train_type END AS product,
  CASE WHEN (ok + ln) % 13 = 0 THEN 'FlixTrain' ELSE 'DB Fernverkehr AG' END AS operator,
  pdep AS planned_departure,
  pdep + to_minutes(CAST(45 + pk % 20 AS BIGINT)) AS planned_arrival,
  CASE WHEN ok % 5 = 0 AND (ok + ln) % 4 > 0 THEN pdep + to_minutes(CAST((ok + ln) % 4 AS BIGINT)) END AS live_departure,
  CASE WHEN ok % 5 = 1 AND (ok + ln) % 4 > 0
       THEN pdep + to_minutes(CAST(45 + pk % 20 + (ok + ln) % 4 AS BIGINT)) END AS live_arrival
FROM (SELECT *, TIMESTAMP '2026-07-01' + to_days(CAST(ok % 10 + 14 AS INTEGER))
                + to_minutes(CAST(ok * 11 % 600 + ln * 70 AS BIGINT)) AS pdep FROM fx_latest)"""

CTES["jlegs"] = """
SELECT *, COALESCE(lag(dest_id) OVER (PARTITION BY journey_id ORDER BY leg_idx), '08000999') AS origin_id,
       COALESCE(lag(dest_name) OVER (PARTITION BY journey_id ORDER BY leg_idx), 'Start') AS origin_name,
       last_value(dest_id) OVER (PARTITION BY journey_id ORDER BY leg_idx
                           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_dest
FROM legs"""

CTES["connections"] = f"""
SELECT journey_id*100 + leg_idx*10 + k AS conn_id, origin_id, final_dest, fahrt_nr AS conn_train_no,
  planned_departure + to_minutes(CAST({_lst([str(x) for x in CONNECTION_OFFSETS_MIN]).replace("'", "")}[k + 1] AS BIGINT)) AS conn_departure,
  planned_arrival + to_minutes(CAST(40 + (journey_id*3 + leg_idx*5 + k*29) % 75 AS BIGINT)) AS conn_arrival,
  CASE WHEN (journey_id + k) % 7 = 0 THEN 'FlixTrain' ELSE 'DB' END AS conn_operator,
  CASE WHEN (journey_id + k) % 7 = 0 THEN 'FLX ' ELSE 'RE ' END || fahrt_nr AS conn_name,
  product AS conn_product, journey_id AS jid, k
FROM jlegs, range(0, 4) t(k)
WHERE NOT walking"""

CTES["connection_legs"] = f"""
SELECT *, origin_id AS origin_name, false AS walking FROM (
  SELECT conn_id, final_dest, conn_operator AS operator, conn_name AS line_name, conn_product AS product, 0 AS leg_idx,
    conn_train_no AS fahrt_nr, origin_id, CASE WHEN two THEN via ELSE final_dest END AS dest_id, conn_departure AS planned_departure,
    CASE WHEN two THEN conn_departure + INTERVAL 12 MINUTE ELSE conn_arrival END AS planned_arrival
  FROM cvia
  UNION ALL
  SELECT conn_id, final_dest, conn_operator, conn_name, conn_product, 1, CAST((jid * 7 + k * 3) % 40 AS VARCHAR), via, final_dest,
    conn_departure + INTERVAL 12 MINUTE + to_minutes(CAST(3 + jid % 9 AS BIGINT)), conn_arrival
  FROM cvia WHERE two)"""

CTES["cvia"] = f"""
SELECT *, {_lst(EVA_PREFIX)}[CAST(jid % 6 AS INTEGER) + 1] || lpad(CAST((jid * 5 + k) % 12 AS VARCHAR), 5, '0') AS via,
       (jid + k) % 3 = 0 AND k < 3 AS two
FROM connections"""

CTES["journeys"] = """
SELECT journey_id,
  CASE WHEN journey_id % 6 = 0 THEN NULL ELSE round(19.9 + CAST(journey_id % 80 AS DOUBLE), 2) END AS price,
  journey_id % 9 = 0 AS dticket_covered,
  (journey_id % 9 = 4 AND NOT journey_id % 9 = 0) AS price_partial,
  CASE WHEN journey_id % 8 = 0 THEN NULL ELSE CAST(greatest(n_train - 1, 0) AS INTEGER) END AS transfers,
  journey_id % 3 = 0 AS has_return
FROM (SELECT journey_id, sum(CASE WHEN NOT walking THEN 1 ELSE 0 END) AS n_train FROM legs GROUP BY journey_id)"""

CTES["observations"] = """
SELECT CAST(ts + to_hours(CAST(user_id % 3 * 3 - 4 AS INTEGER)) AS DATE) AS service_day, user_id AS obs_key, event_id AS seq, ts AS fetch_ts,
  CASE WHEN event_type IN ('error', 'signup') THEN ts END AS arr_time,
  CASE WHEN event_type IN ('error', 'signup') THEN CAST(round(value) AS INTEGER) END AS arr_delay,
  CASE WHEN event_type NOT IN ('error', 'signup') THEN ts END AS dep_time,
  CASE WHEN event_type NOT IN ('error', 'signup') THEN CAST(round(value) AS INTEGER) END AS dep_delay,
  event_type AS status,
  CASE WHEN event_type <> 'view' THEN props END AS descr
FROM events"""

_ORDER = list(CTES)


def register(name: str, sql: str) -> None:
    """Add a further CTE (used by query modules for shared intermediate results)."""
    CTES[name] = sql
    if name not in _ORDER:
        _ORDER.append(name)


def _deps(sql: str) -> set[str]:
    return {n for n in CTES if re.search(r"\b" + re.escape(n) + r"\b", sql)}


def cte(body: str) -> str:
    """Prepend the CTEs ``body`` needs, dependencies first."""
    names: list[str] = []

    def visit(n: str, seen: set[str]) -> None:
        if n in names or n in seen:
            return
        seen.add(n)
        for d in sorted(_deps(CTES[n]) - {n}, key=_ORDER.index):
            visit(d, seen)
        names.append(n)

    for n in sorted(_deps(body), key=_ORDER.index):
        visit(n, set())
    if not names:
        return body.strip()
    body = body.strip()
    recursive = body[:14].upper() == "WITH RECURSIVE"
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in names)
    if recursive:
        return head + ",\n" + body[14:].lstrip()
    if body[:4].upper() == "WITH":
        return head + ",\n" + body[4:].lstrip()
    return head + "\n" + body
