"""The bindings of ``flowspark/bindings.py`` once more, as DuckDB common table expressions."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: str, sql: str) -> None:
    CTES[name] = (tuple(deps.split()), sql)


def with_ctes(names, body: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    body = body.strip()
    if not order:
        return body
    rec = " RECURSIVE" if body.upper().startswith("WITH RECURSIVE") else ""
    head = f"WITH{rec} " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    if body[:5].upper() == "WITH ":
        rest = body[5:].lstrip()
        if rest.upper().startswith("RECURSIVE "):
            rest = rest[10:]
        return head + ",\n" + rest
    return head + "\n" + body


SERVICE_DAY = "CAST({0} - INTERVAL 5 HOUR AS DATE)"
DAYTYPE = "CASE WHEN isodow({0})=7 OR {0} IN (DATE '2024-01-01') THEN 2 WHEN isodow({0})=6 THEN 1 ELSE 0 END"
TOD = "CAST(floor(((hour({0})*60+minute({0})-300+1440)%1440)/15) AS INTEGER)"
SLOT = "time_bucket(INTERVAL 15 MINUTE, {0})"


def hav(a, b):
    """Great-circle distance in km between two SQL aliases that carry lat and lon."""
    return (
        f"2*6371.0*asin(sqrt(pow(sin(radians({b}.lat-{a}.lat)/2),2)"
        f"+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2),2)))"
    )


def station_of(e):
    return f"'S'||lpad(CAST({e} AS VARCHAR),2,'0')"


cte(
    "flows", "",
    f"SELECT {station_of('user_id%25')} AS station_key, {SLOT.format('ts')} AS slot, "
    "CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS reading FROM events "
    "WHERE hour(ts)>=5 OR hour(ts)=0 GROUP BY 1,2",
)
cte(
    "fd", "flows",
    f"SELECT *, {TOD.format('slot')} AS tod, {DAYTYPE.format('day')} AS daytype "
    f"FROM (SELECT *, {SERVICE_DAY.format('slot')} AS day FROM flows)",
)
cte(
    "spine", "",
    f"SELECT day, CAST(tod AS INTEGER) AS tod, day + INTERVAL 5 HOUR + to_minutes(CAST(tod*15 AS BIGINT)) AS slot, {DAYTYPE.format('day')} AS daytype FROM ("
    f"SELECT CAST(unnest(generate_series({SERVICE_DAY.format('min(ts)')}, {SERVICE_DAY.format('max(ts)')}, INTERVAL 1 DAY)) AS DATE) AS day FROM events) d, range(80) r(tod)",
)
cte(
    "dense", "spine flows",
    f"SELECT k.station_key, s.slot, s.day, s.tod, s.daytype, coalesce(f.reading,0) AS reading FROM spine s "
    f"CROSS JOIN (SELECT {station_of('i')} AS station_key FROM range(25) r(i)) k LEFT JOIN flows f ON f.station_key=k.station_key AND f.slot=s.slot",
)
cte(
    "weather", "spine",
    "SELECT s.slot, s.day, CAST(12 + hour(s.slot)%12 + day(s.day)%7 AS DOUBLE) AS temp, 0.5*least(4, coalesce(n_err,0)) AS prcp, "
    "CAST(5*floor(minute(s.slot)/15) AS DOUBLE) AS wspd, CAST(1+coalesce(n,0)%9 AS DOUBLE) AS coco FROM spine s LEFT JOIN ("
    f"SELECT {SLOT.format('ts')} AS slot, count(*) AS n, count_if(event_type='error') AS n_err FROM events GROUP BY 1) c ON c.slot=s.slot",
)
cte(
    "crowd", "",
    "SELECT event_id AS crowd_id, 'Show '||CAST(user_id%40 AS VARCHAR) AS event_name, st AS start, "
    "st + CASE WHEN user_id%2=0 THEN INTERVAL 3 HOUR ELSE INTERVAL 2 HOUR END AS \"end\", "
    "CASE WHEN user_id%2=0 THEN 'Music' ELSE 'Other' END AS segment, CAST(floor(value*10) AS BIGINT) AS attendance, "
    f"'V'||CAST(user_id%5 AS VARCHAR) AS venue_key FROM (SELECT *, {SLOT.format('ts')} AS st FROM events WHERE event_type='purchase' AND value>=150)",
)
cte(
    "venues", "",
    "SELECT 'V'||CAST(n_nationkey//5 AS VARCHAR) AS venue_key, 52.405::DOUBLE+n_nationkey*0.01::DOUBLE AS lat, "
    "13.204::DOUBLE+((n_nationkey*7)%25)*0.003::DOUBLE AS lon FROM nation WHERE n_nationkey%5=0",
)
cte(
    "closures", "",
    f"SELECT event_id AS closure_id, {station_of('user_id%25')} AS station_key, ts AS start, "
    "ts + to_hours(CAST(1+user_id%3 AS BIGINT)) AS \"end\", 'Station NATION_'||CAST(user_id%25 AS VARCHAR)||' closed due to track maintenance.' AS description "
    "FROM events WHERE event_type='signup' AND value>=150",
)
cte(
    "stations", "",
    f"SELECT {station_of('n_nationkey')} AS station_key, n_name AS name, n_nationkey AS k, 52.40::DOUBLE+n_nationkey*0.01::DOUBLE AS lat, "
    "13.20::DOUBLE+((n_nationkey*7)%25)*0.003::DOUBLE AS lon, CASE WHEN n_nationkey%4=0 THEN ['L'||CAST(n_regionkey AS VARCHAR),'L'||CAST((n_regionkey+1)%5 AS VARCHAR)] "
    "ELSE ['L'||CAST(n_regionkey AS VARCHAR)] END AS lines, n_nationkey%6=0 AS is_rail FROM nation",
)
cte(
    "line_stops", "stations",
    "SELECT line, station_key, CAST(row_number() OVER (PARTITION BY line ORDER BY station_key) AS INTEGER) AS seq FROM (SELECT unnest(lines) AS line, station_key FROM stations)",
)
cte(
    "edges", "line_stops",
    "SELECT a.station_key AS src, b.station_key AS dst, a.line FROM line_stops a JOIN line_stops b ON a.line=b.line AND abs(a.seq-b.seq)=1",
)
cte(
    "suspensions", "line_stops",
    "SELECT e.event_id AS closure_id, ts AS start, ts + to_hours(CAST(1+user_id%3 AS BIGINT)) AS \"end\", a.line, a.station_key AS a, b.station_key AS b, a.seq AS sa, b.seq AS sb, "
    "'Line '||a.line||' suspended between NATION_'||CAST(CAST(substr(a.station_key,2) AS INTEGER) AS VARCHAR)||' and NATION_'||CAST(CAST(substr(b.station_key,2) AS INTEGER) AS VARCHAR)||' due to signal failure' AS description "
    "FROM events e JOIN line_stops a ON a.line='L'||CAST(user_id%5 AS VARCHAR) AND a.seq=1+event_id%3 JOIN line_stops b ON b.line=a.line AND b.seq=a.seq+2 "
    "WHERE event_type='error' AND value>=200",
)
cte(
    "lineitem_daily", "",
    "SELECT CAST(l_shipdate AS DATE) AS day, s_nationkey, sum(CAST(l_quantity AS BIGINT)) AS riders, sum(CAST(round(l_extendedprice) AS BIGINT)) AS wh "
    "FROM lineitem JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1,2",
)
cte("daily_station", "lineitem_daily", f"SELECT day, {station_of('s_nationkey')} AS station_key, riders FROM lineitem_daily")
cte(
    "energy", "lineitem_daily",
    "SELECT day, 'L'||CAST(n_regionkey AS VARCHAR) AS line, CAST(sum(wh) AS DOUBLE)/1e6 AS mwh FROM lineitem_daily JOIN nation ON s_nationkey=n_nationkey GROUP BY 1,2",
)
cte(
    "stops", "",
    "SELECT s_suppkey AS stop_id, s_name AS stop_name, 52.40::DOUBLE+((s_suppkey*37)%1009)*0.0002::DOUBLE AS lat, 13.20::DOUBLE+((s_suppkey*91)%1013)*0.0003::DOUBLE AS lon, "
    "'L'||CAST(s_nationkey%5 AS VARCHAR) AS line FROM supplier",
)
cte(
    "homes", "",
    "SELECT c_custkey AS home_id, 52.40::DOUBLE+((c_custkey*53)%1009)*0.0002::DOUBLE AS lat, 13.20::DOUBLE+((c_custkey*29)%1013)*0.0003::DOUBLE AS lon FROM customer",
)
cte(
    "stop_times", "",
    "SELECT trip_id, stop_sequence, stop_id, departure, CASE o_custkey%3 WHEN 0 THEN 'M' WHEN 1 THEN 'X' ELSE 'U' END||substr(o_orderpriority,1,1) AS line, CAST(o_custkey%2 AS INTEGER) AS direction_id FROM ("
    "SELECT l_orderkey AS trip_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS stop_sequence, l_suppkey AS stop_id, l_shipdate AS departure FROM lineitem) JOIN orders ON o_orderkey=trip_id",
)
