"""DuckDB SQL for the registered queries, assembled from shared table expressions."""

from __future__ import annotations

import math

from zonecast.functions import geo
from zonecast.functions.stations import STATIONS, URBAN_CORE


def d(v: float) -> str:
    """A double literal DuckDB reads exactly."""
    return f"{float(v):.17e}"


def hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        f"(pow(sin(radians({lat2}-{lat1})/2),2.0)+cos(radians({lat1}))*cos(radians({lat2}))"
        f"*pow(sin(radians({lng2}-{lng1})/2),2.0))"
    )


def metres(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = hav(lat1, lng1, lat2, lng2)
    return f"({d(2 * geo.EARTH_RADIUS_M)}*atan2(sqrt({a}),sqrt(1.0e0-{a})))"


def kilometres(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return f"({d(2 * geo.EARTH_RADIUS_KM)}*asin(sqrt({hav(lat1, lng1, lat2, lng2)})))"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b}>0 THEN CAST({a} AS DOUBLE)/{b} ELSE 0.0e0 END)"


def seg_sq(px, py, ax, ay, bx, by) -> str:
    """Squared distance of a point to a segment, on plane coordinates."""
    ln = f"(({bx}-{ax})*({bx}-{ax})+({by}-{ay})*({by}-{ay}))"
    t = (
        f"coalesce(greatest(0e0,least(1e0,(({px}-{ax})*({bx}-{ax})+({py}-{ay})*({by}-{ay}))/nullif({ln},0e0))),0e0)"
    )
    return f"(pow({px}-({ax}+{t}*({bx}-{ax})),2)+pow({py}-({ay}+{t}*({by}-{ay})),2))"


CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (sql, deps)


def q(body: str, *names: str) -> str:
    """``WITH`` the named expressions and everything they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in order) + "\n" + body


# --- shared tables ---------------------------------------------------------------

cte(
    "rep",
    f"""SELECT CAST(event_id AS VARCHAR) report_id, event_id,
 {d(22.2)}+CAST(user_id*37%300 AS DOUBLE)/1.0e3+CAST(event_id%7 AS DOUBLE)*{d(0.00003)} lat,
 {d(113.9)}+CAST(user_id*53%400 AS DOUBLE)/1.0e3+CAST(event_id%5 AS DOUBLE)*{d(0.00003)} lng,
 'addr-'||CAST(user_id%50 AS VARCHAR) address, event_type report_type, ts create_dt,
 CAST(regexp_extract(props,'(\\d+)',1) AS BIGINT)%6 upvote, CAST(regexp_extract(props,'(\\d+)',1) AS BIGINT)%5 downvote,
 ts seen_at FROM events""",
)
cte(
    "rc",
    """SELECT report_id, address, upvote, downvote, create_dt, seen_at FROM rep UNION ALL
 SELECT report_id, address||'-later', (upvote+1)%6, (downvote+2)%5, create_dt, seen_at+INTERVAL 1 HOUR
 FROM rep WHERE event_id%10=0""",
    "rep",
)
cte(
    "st",
    "SELECT * FROM (VALUES "
    + ",".join(
        f"({i},'{n}','{r}',{d(a)},{d(b)})" for i, (n, r, a, b) in enumerate(STATIONS)
    )
    + ") v(seq,name,region,slat,slng)",
)
cte(
    "loc",
    f"""SELECT lat,lng,name district,region FROM (SELECT p.lat,p.lng,name,region,
 row_number() OVER (PARTITION BY p.lat,p.lng ORDER BY {hav('p.lat', 'p.lng', 'slat', 'slng')},seq) rn
 FROM (SELECT DISTINCT lat,lng FROM rep) p CROSS JOIN st) WHERE rn=1""",
    "rep",
    "st",
)


def hex_sql(src: str, lat: str = "lat", lng: str = "lng", res: int = 9) -> str:
    """Rows of ``src`` with axial coordinates hq, hr."""
    edge = geo.hex_edge_m(res)
    x = f"(({lng}-{d(geo.HEX_ORIGIN[1])})*{d(geo._lng_scale() / edge)})"
    y = f"(({lat}-{d(geo.HEX_ORIGIN[0])})*{d(geo.M_PER_LAT / edge)})"
    return f"""SELECT * EXCLUDE (qf,rf,sf,q0,r0,s0),
 CAST(CASE WHEN abs(q0-qf)>abs(r0-rf) AND abs(q0-qf)>abs(s0-sf) THEN 0-r0-s0 ELSE q0 END AS BIGINT) hq,
 CAST(CASE WHEN NOT (abs(q0-qf)>abs(r0-rf) AND abs(q0-qf)>abs(s0-sf)) AND abs(r0-rf)>abs(s0-sf) THEN 0-q0-s0 ELSE r0 END AS BIGINT) hr
 FROM (SELECT *, round_even(qf,0) q0, round_even(rf,0) r0, round_even(sf,0) s0 FROM (
 SELECT *, 0.0e0-qf-rf sf FROM (SELECT *, {x}*{d(math.sqrt(3.0) / 3.0)}-{y}/3.0e0 qf, {y}*{d(2.0 / 3.0)} rf FROM {src})))"""


def hex_name(q_: str = "hq", r_: str = "hr", res: int = 9) -> str:
    return f"printf('h{res}:%d:%d',{q_},{r_})"


def hex_lat(r_: str = "hr", res: int = 9) -> str:
    return f"({d(geo.HEX_ORIGIN[0])}+CAST({r_} AS DOUBLE)*{d(1.5 * geo.hex_edge_m(res) / geo.M_PER_LAT)})"


def hex_lng(q_: str = "hq", r_: str = "hr", res: int = 9) -> str:
    return (
        f"({d(geo.HEX_ORIGIN[1])}+(CAST({q_} AS DOUBLE)+CAST({r_} AS DOUBLE)/2.0e0)"
        f"*{d(math.sqrt(3.0) * geo.hex_edge_m(res) / geo._lng_scale())})"
    )


def cell_sql(lat: str = "lat", lng: str = "lng") -> str:
    i, j = f"round_even({lat}/{d(0.005)},0)", f"round_even({lng}/{d(0.005)},0)"
    return f"printf('%.3f_%.3f',{i}*{d(0.005)},{j}*{d(0.005)})"


def ev_sql(res: int) -> str:
    return f"""SELECT h.event_id, h.lat, h.lng, h.address, h.create_dt ts, h.event_id%3+1 report_count,
 h.upvote total_upvotes, h.downvote total_downvotes, {cell_sql('h.lat', 'h.lng')} grid_cell, hq, hr,
 {hex_name(res=res)} zone_id, {hex_lat(res=res)} zone_lat, {hex_lng(res=res)} zone_lng, loc.district, loc.region
 FROM ({hex_sql('rep', res=res)}) h JOIN loc ON loc.lat=h.lat AND loc.lng=h.lng"""


def bucket(h: str) -> str:
    return (
        f"CASE WHEN {h}>=7 AND {h}<10 THEN 'commute_am' WHEN {h}>=10 AND {h}<15 THEN 'midday' "
        f"WHEN {h}>=15 AND {h}<20 THEN 'commute_pm' WHEN {h}>=20 OR {h}<2 THEN 'late' ELSE 'overnight' END"
    )


HOUR = "CAST(hour({t}) AS INTEGER)"
DOW = "CAST((dayofweek({t})+6)%7 AS INTEGER)"


def hour(t: str) -> str:
    return HOUR.format(t=t)


def dow(t: str) -> str:
    return DOW.format(t=t)


def zone_ctes(res: int, suffix: str = "") -> None:
    """Zone feature tables for a 7-day lookback and 2-hour horizon."""
    s = suffix
    cte(f"ev{s}", ev_sql(res), "rep", "loc")
    cte(f"tt{s}", f"SELECT unnest(generate_series(date_trunc('hour',min(ts))+INTERVAL 7 DAY, date_trunc('hour',max(ts)), INTERVAL 1 HOUR)) t FROM ev{s}", f"ev{s}")
    cte(f"zs{s}", f"SELECT zone_id, min(hq) hq, min(hr) hr FROM ev{s} GROUP BY 1", f"ev{s}")
    n = lambda h: f"count(e.ts) FILTER (e.ts>=t-INTERVAL {h} HOUR)"
    cte(
        f"zc{s}",
        f"""SELECT t, z.zone_id, any_value(z.hq) hq, any_value(z.hr) hr, {n(1)} c1, {n(3)} c3, {n(24)} c24, count(e.ts) c7,
 count(e.ts) FILTER (hour(e.ts)=hour(t)) ch, max(e.ts) last_ts, arg_max(e.district,e.ts) ld, arg_max(e.region,e.ts) lr
 FROM tt{s} CROSS JOIN zs{s} z LEFT JOIN ev{s} e ON e.zone_id=z.zone_id AND e.ts<t AND e.ts>=t-INTERVAL 7 DAY GROUP BY 1,2""",
        f"tt{s}",
        f"zs{s}",
        f"ev{s}",
    )
    cte(
        f"zf{s}",
        f"SELECT t, e.zone_id, count(*) fut, count(*) FILTER (e.ts<t+INTERVAL 30 MINUTE) fut30 FROM tt{s} JOIN ev{s} e ON e.ts>=t AND e.ts<t+INTERVAL 2 HOUR GROUP BY 1,2",
        f"tt{s}",
        f"ev{s}",
    )
    cte(
        f"dc{s}",
        f"""SELECT t, district, {n(3)} d3, {n(24)} d24, count(*) d7, count(*) FILTER (hour(e.ts)=hour(t)) dh,
 count(DISTINCT zone_id) FILTER (e.ts>=t-INTERVAL 24 HOUR) da, count(DISTINCT grid_cell) FILTER (e.ts>=t-INTERVAL 24 HOUR) dcell
 FROM tt{s} JOIN ev{s} e ON e.ts<t AND e.ts>=t-INTERVAL 7 DAY GROUP BY 1,2""",
        f"tt{s}",
        f"ev{s}",
    )
    cte(
        f"zb{s}",
        f"""SELECT zc.t target_time, zc.zone_id, zc.hq, zc.hr, coalesce(ld,'Unknown') district, coalesce(lr,'Unknown') region,
 {hex_lat('zc.hr', res)} zone_lat, {hex_lng('zc.hq', 'zc.hr', res)} zone_lng, c1, c3, c24, c7,
 coalesce(epoch_us(zc.t)-epoch_us(last_ts),-1) since_us, {ratio('ch', 'c7')} zsame, coalesce(d3,0) d3, coalesce(d24,0) d24,
 coalesce(da,0) da, {ratio('coalesce(dh,0)', 'coalesce(d7,0)')} dsame, coalesce(fut,0) fut, coalesce(fut30,0) fut30,
 CAST(coalesce(fut,0)>0 AS INTEGER) actual, {hour('zc.t')} hr_, {dow('zc.t')} dw
 FROM zc{s} zc LEFT JOIN dc{s} dc ON dc.t=zc.t AND dc.district=coalesce(ld,'Unknown') LEFT JOIN zf{s} zf ON zf.t=zc.t AND zf.zone_id=zc.zone_id""",
        f"zc{s}",
        f"dc{s}",
        f"zf{s}",
    )


zone_ctes(9)
zone_ctes(8, "8")
zone_ctes(10, "10")

cte(
    "ring",
    "SELECT * FROM (VALUES "
    + ",".join(f"(1,{a},{b})" for a, b in geo.RING1)
    + ","
    + ",".join(f"(2,{a},{b})" for a, b in geo.RING2)
    + ") v(ring,dq,dr)",
)
cte(
    "nb",
    f"SELECT z.zone_id, ring, {hex_name('z.hq+dq', 'z.hr+dr')} neighbor_id FROM zs z CROSS JOIN ring",
    "zs",
    "ring",
)
cte(
    "zr",
    """SELECT a.target_time, a.zone_id,
 CAST(coalesce(sum(b.c3) FILTER (ring=1),0) AS BIGINT) n3, CAST(coalesce(sum(b.c24) FILTER (ring=1),0) AS BIGINT) n24,
 CAST(coalesce(sum(b.c7) FILTER (ring=1),0) AS BIGINT) n7, count(*) FILTER (ring=1 AND b.c24>0) na,
 CAST(coalesce(sum(b.c24) FILTER (ring=2),0) AS BIGINT) r24, CAST(coalesce(sum(b.c7) FILTER (ring=2),0) AS BIGINT) r7,
 count(*) FILTER (ring=2 AND b.c24>0) ra
 FROM zb a LEFT JOIN nb ON nb.zone_id=a.zone_id LEFT JOIN zb b ON b.target_time=a.target_time AND b.zone_id=nb.neighbor_id GROUP BY 1,2""",
    "zb",
    "nb",
)
cte(
    "sc",
    "SELECT target_time, zone_id, district, region, zone_lat, zone_lng, hr_, c24, c7, d24, zsame, "
    "CAST((c7*7+hr_)%101 AS DOUBLE)/1.0e2 score, actual FROM zb",
    "zb",
)
cte("rk", "SELECT *, row_number() OVER (ORDER BY score DESC, zone_id, target_time) rank, row_number() OVER (PARTITION BY target_time ORDER BY score DESC, zone_id) trank FROM sc", "sc")
cte(
    "ms",
    """SELECT 'a' model, CAST(day(target_time)%4+1 AS INTEGER) fold, target_time, zone_id, district, region, actual, score FROM sc UNION ALL
 SELECT 'b', CAST(day(target_time)%4+1 AS INTEGER), target_time, zone_id, district, region, actual, CAST((c24*5+hr_)%97 AS DOUBLE)/9.6e1 FROM sc""",
    "sc",
)
cte(
    "curve",
    """SELECT model, fold, score, sum(actual) pos, count(*) n, sum(sum(actual)) OVER w tp, sum(count(*)) OVER w nn
 FROM ms GROUP BY 1,2,3 WINDOW w AS (PARTITION BY model, fold ORDER BY score DESC)""",
    "ms",
)
cte(
    "fs",
    f"""SELECT r.model, r.fold, CAST(any_value(n) AS DOUBLE) "rows", CAST(any_value(p) AS DOUBLE) positives, avg(actual) base_rate,
 {",".join(f"avg(actual) FILTER (rn<={k}) precision_at_{k}, CASE WHEN any_value(p)>0 THEN sum(actual) FILTER (rn<={k})/any_value(p) ELSE 0 END recall_at_{k}" for k in (20, 50, 100))},
 avg(pow(least(1e0,greatest(0e0,score))-actual,2)) brier_score,
 coalesce((avg(actual) FILTER (rn<=greatest(1,ceil(n*0.1e0))))/nullif(avg(actual),0),0) top_decile_lift
 FROM (SELECT *, row_number() OVER (PARTITION BY model,fold ORDER BY score DESC, zone_id, target_time) rn,
 count(*) OVER (PARTITION BY model,fold) n, sum(actual) OVER (PARTITION BY model,fold) p FROM ms) r GROUP BY 1,2""",
    "ms",
)
cte(
    "ap",
    """SELECT model, fold, CASE WHEN sum(pos)>0 THEN sum(pos*(tp/nn))/sum(pos) ELSE 0 END average_precision,
 CASE WHEN sum(pos)>0 AND sum(n-pos)>0 THEN sum((n-pos)*(tp-pos+pos/2.0))/(sum(pos)*CAST(sum(n-pos) AS DOUBLE)) ELSE 0 END roc_auc
 FROM (SELECT model, fold, CAST(pos AS DOUBLE) pos, CAST(n AS DOUBLE) n, CAST(tp AS DOUBLE) tp, CAST(nn AS DOUBLE) nn FROM curve) GROUP BY 1,2""",
    "curve",
)
cte(
    "ece",
    """SELECT model, fold, sum(n*abs(conf-acc))/sum(n) e FROM (SELECT model, fold, least(floor(least(1e0,greatest(0e0,score))*10),9) b,
 count(*) n, avg(score) conf, avg(actual) acc FROM ms GROUP BY 1,2,3) GROUP BY 1,2""",
    "ms",
)
cte("days_", "SELECT CAST(count(DISTINCT CAST(create_dt AS DATE)) AS BIGINT) n FROM rep", "rep")
cte(
    "obs",
    f"SELECT DISTINCT hq, hr FROM ({hex_sql('rep')}) WHERE lat BETWEEN {d(22.15)} AND {d(22.58)} AND lng BETWEEN {d(113.82)} AND {d(114.45)}",
    "rep",
)
cte(
    "gz",
    "SELECT DISTINCT hq+dq hq, hr+dr hr FROM obs CROSS JOIN (SELECT 0 dq, 0 dr UNION ALL SELECT dq, dr FROM ring WHERE ring=1)",
    "obs",
    "ring",
)
cte(
    "grid",
    f"""SELECT zone_id, hq, hr, zone_lat, zone_lng, seen has_observed_history, 1-seen is_zero_history,
 CASE WHEN seen=1 THEN 'observed_and_grid' ELSE 'fixed_grid' END coverage_source, name district, region FROM (
 SELECT g.*, name, region, row_number() OVER (PARTITION BY zone_id ORDER BY {hav('zone_lat', 'zone_lng', 'slat', 'slng')}, seq) rn
 FROM (SELECT {hex_name('gz.hq', 'gz.hr')} zone_id, gz.hq, gz.hr, {hex_lat('gz.hr')} zone_lat, {hex_lng('gz.hq', 'gz.hr')} zone_lng,
 CAST(obs.hq IS NOT NULL AS INTEGER) seen FROM gz LEFT JOIN obs ON obs.hq=gz.hq AND obs.hr=gz.hr) g CROSS JOIN st) WHERE rn=1""",
    "gz",
    "obs",
    "st",
)
cte(
    "poly",
    f"""SELECT n_nationkey poly_id, n_name district, r_name region, {d(113.9)}+CAST(n_nationkey%5 AS DOUBLE)*{d(0.08)} x0,
 {d(22.2)}+floor(n_nationkey/5.0e0)*{d(0.06)} y0 FROM nation JOIN region ON n_regionkey=r_regionkey""",
)
_RING = ((0.0, 0.0), (0.08, 0.0), (0.08, 0.03), (0.05, 0.06), (0.0, 0.06), (0.0, 0.0))
cte(
    "edge",
    "SELECT poly_id, district, region, x0+ax x1, y0+ay y1, x0+bx x2, y0+by_ y2 FROM poly CROSS JOIN (VALUES "
    + ",".join(f"({d(a[0])},{d(a[1])},{d(b[0])},{d(b[1])})" for a, b in zip(_RING, _RING[1:]))
    + ") v(ax,ay,bx,by_)",
    "poly",
)


def covers_sql(src: str, key: str) -> str:
    """(key, poly_id, district, region) of the first covering polygon."""
    cross = "((y1>lat)<>(y2>lat)) AND lng<(x2-x1)*(lat-y1)/nullif(y2-y1,0e0)+x1"
    return f"""SELECT {key}, min(poly_id) poly_id, arg_min(district,poly_id) district, arg_min(region,poly_id) region FROM (
 SELECT {key}, poly_id, any_value(district) district, any_value(region) region FROM {src} CROSS JOIN edge GROUP BY 1,2
 HAVING count(*) FILTER ({cross})%2=1 OR count(*) FILTER (sqrt({seg_sq('lng', 'lat', 'x1', 'y1', 'x2', 'y2')})<=1e-12)>0) GROUP BY 1"""


cte("pip", covers_sql("rep", "report_id"), "rep", "edge")
cte(
    "pipall",
    f"""SELECT report_id, district, region FROM pip UNION ALL
 SELECT report_id, district, region FROM (SELECT report_id, district, region, row_number() OVER (PARTITION BY report_id ORDER BY
 round(sqrt({seg_sq('lng', 'lat', 'x1', 'y1', 'x2', 'y2')}),12), poly_id) rn FROM rep CROSS JOIN edge
 WHERE report_id NOT IN (SELECT report_id FROM pip)) WHERE rn=1""",
    "pip",
    "rep",
    "edge",
)
cte(
    "segs",
    f"""SELECT user_id segment_id, CASE user_id%4 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary' WHEN 2 THEN 'service' ELSE 'tertiary' END road_class,
 'road-'||user_id AS name, lat_a, lng_a, lat_a+CAST(user_id%3 AS DOUBLE)*{d(0.003)} lat_b, lng_a+CAST(user_id%5 AS DOUBLE)*{d(0.002)} lng_b
 FROM (SELECT user_id, {d(22.2)}+CAST(user_id*37%300 AS DOUBLE)/1.0e3 lat_a, {d(113.9)}+CAST(user_id*53%400 AS DOUBLE)/1.0e3 lng_a
 FROM (SELECT DISTINCT user_id FROM events))""",
)


def segment_m(lat: str, lng: str, a: str, b: str, c: str, e: str) -> str:
    kx, ky = f"({d(geo.M_PER_LNG_EQUATOR)}*cos(radians({lat})))", d(geo.M_PER_LAT)
    return f"sqrt({seg_sq(f'({lng}*{kx})', f'({lat}*{ky})', f'({b}*{kx})', f'({a}*{ky})', f'({e}*{kx})', f'({c}*{ky})')})"


def _bin(v: str) -> str:
    return f"CAST(floor({v}/{d(0.01)}) AS BIGINT)"


def _reach(k: int) -> str:
    return (
        f"{_bin('least(lat_a,lat_b)')}<={_bin('zone_lat')}+{k} AND {_bin('greatest(lat_a,lat_b)')}>={_bin('zone_lat')}-{k} "
        f"AND {_bin('least(lng_a,lng_b)')}<={_bin('zone_lng')}+{k} AND {_bin('greatest(lng_a,lng_b)')}>={_bin('zone_lng')}-{k}"
    )


cte(
    "lines",
    f"""SELECT g.zone_id, round(m.dist,1) nearest_line_m, coalesce(m.name,'') nearest_line_name, coalesce(m.n,0) line_count,
 coalesce(m.cls,'') line_classes, CAST(coalesce(m.n,0)>0 AS INTEGER) has_line, has_observed_history FROM grid g LEFT JOIN (
 SELECT zone_id, min(dist) dist, arg_min(name, dist) AS name, count(*) FILTER (dist<=60) n,
 string_agg(DISTINCT road_class,'|' ORDER BY road_class) FILTER (dist<=60) cls FROM (
 SELECT zone_id, name, road_class, {segment_m('zone_lat', 'zone_lng', 'lat_a', 'lng_a', 'lat_b', 'lng_b')} dist,
 {_reach(1)} near1, bool_or({_reach(1)}) OVER (PARTITION BY zone_id) any1 FROM grid CROSS JOIN segs WHERE {_reach(3)})
 WHERE near1=any1 GROUP BY 1) m ON m.zone_id=g.zone_id""",
    "grid",
    "segs",
)

ORACLE: dict[str, str] = {}
O = ORACLE

# --- ingest ------------------------------------------------------------------------

O["i1_read_report_archive"] = q(
    """SELECT report_id, lat, lng, address, report_type, strftime(create_dt,'%Y-%m-%d %H:%M:%S') create_dt, upvote,
 CASE WHEN event_id%4>0 THEN downvote ELSE 0 END downvote FROM rep""",
    "rep",
)
O["i1_split_archive"] = O["i1_read_report_archive"]
O["i2_salvage_quarantine"] = q("SELECT event_id//500 b, 1::BIGINT pieces FROM rep GROUP BY 1", "rep")
O["i2_salvage_reports"] = q(
    """SELECT report_id, lat, lng, '{at} "'||address address, upvote, CASE WHEN event_id%4>0 THEN downvote ELSE 0 END downvote FROM rep
 WHERE event_id NOT IN (SELECT max(event_id) FROM rep GROUP BY event_id//500)""",
    "rep",
)
O["i2_split_reports"] = O["i2_salvage_reports"]
O["i2_split_leftovers"] = O["i2_salvage_quarantine"]
O["i3_ingest_audit"] = q(
    'SELECT count(*) "rows", count(DISTINCT report_id) distinct_ids, min(create_dt) min_time, max(create_dt) max_time FROM rc', "rc"
)
O["i4_resolve_columns"] = q(
    """SELECT report_id, round(lat,6) lat, round(lng,6) lng, date_trunc('second',create_dt) event_time FROM rep
 WHERE event_id%11<>0 AND event_id%13<>0 AND event_id%17<>0""",
    "rep",
)
O["i5_append_and_rebuild"] = q("SELECT 2*count(*) appended_rows, count(*) rebuilt_rows FROM rep", "rep")
O["i5_replace_days"] = q(
    """SELECT CAST(create_dt AS DATE) "day", count(*) reports, max(report_id) last_id FROM rep WHERE CASE WHEN CAST(create_dt AS DATE) IN (DATE '2024-01-05', DATE '2024-01-06')
 THEN event_id%2=0 ELSE CAST(create_dt AS DATE)<>DATE '2024-01-07' END GROUP BY 1""",
    "rep",
)
O["i6_events_since"] = q("SELECT event_id, ts, zone_id FROM ev WHERE ts>=TIMESTAMP '2024-01-20 12:00:00' ORDER BY ts, event_id", "ev")
O["i6_all_events"] = q("SELECT event_id, ts, grid_cell FROM ev ORDER BY ts, event_id", "ev")
O["i7_coverage_days"] = q(
    "SELECT n days_collected, 14 days_needed, greatest(0,14-n) days_remaining, CAST(n>=14 AS INTEGER) ready FROM days_", "days_"
)
O["i9_csv_mart"] = q(
    """SELECT g.zone_id, g.district, g.region, count(e.ts) event_count FROM grid g LEFT JOIN ev e ON e.zone_id=g.zone_id GROUP BY 1,2,3""",
    "grid",
    "ev",
)
O["i10_explode_lines"] = q(
    """SELECT road_class, CASE WHEN segment_id%3=0 THEN 'R'||segment_id ELSE name END AS name, round(lat_a,6) lat_a, round(lng_a,6) lng_a,
 round(lat_b,6) lat_b, round(lng_b,6) lng_b FROM (SELECT * FROM segs UNION ALL
 SELECT segment_id, road_class, name, lat_b, lng_b, lat_a, lng_a FROM segs WHERE segment_id%2=0) WHERE segment_id%4<>3""",
    "segs",
)

O["i10_read_polygons"] = """SELECT n_name district, r_name region, CASE WHEN n_nationkey%5<2 THEN 2 ELSE 1 END::BIGINT rings,
 (CASE WHEN n_nationkey%5<2 THEN 2 ELSE 1 END*6)::BIGINT points FROM nation JOIN region ON n_regionkey=r_regionkey WHERE n_nationkey%5<>2"""

# --- filters, dedupe, clustering -----------------------------------------------------

VALID = f"lat<>0 AND lng<>0 AND lat BETWEEN {d(22.15)} AND {d(22.56)} AND lng BETWEEN {d(113.83)} AND {d(114.41)} AND NOT ({{u}}=0 AND {{v}}>=3)"
O["f1_valid_reports"] = q(
    f"SELECT report_id, round(lat,6) lat, round(lng,6) lng, create_dt, upvote, downvote FROM rep WHERE {VALID.format(u='upvote', v='downvote')} ORDER BY create_dt, report_id",
    "rep",
)
O["f2_in_bbox"] = q(
    f"""SELECT report_id, 'inclusive' kind FROM rep WHERE lat BETWEEN {d(22.3)} AND {d(22.4)} AND lng BETWEEN {d(114.0)} AND {d(114.2)} UNION ALL
 SELECT report_id, 'strict' FROM rep WHERE lat>{d(22.3)} AND lat<{d(22.4)} AND lng>{d(114.0)} AND lng<{d(114.2)}""",
    "rep",
)
O["d1_dedupe_keep_first"] = q(
    "SELECT report_id, arg_min(address,seen_at) address, arg_min(upvote,seen_at) upvote, arg_min(downvote,seen_at) downvote, min(seen_at) seen_at FROM rc GROUP BY 1",
    "rc",
)
_LAST = "coalesce(arg_max({c},seen_at) FILTER ({c}<>0), arg_min({c},seen_at)) {c}"
O["d2_dedupe_refresh"] = q(
    f"SELECT report_id, arg_min(address,seen_at) address, {_LAST.format(c='upvote')}, {_LAST.format(c='downvote')}, min(seen_at) first_seen, max(seen_at) last_seen FROM rc GROUP BY 1",
    "rc",
)
O["d2_new_per_batch"] = q(
    "SELECT batch, count(*) new_reports FROM (SELECT report_id, min(date_trunc('hour',seen_at)) batch FROM rc GROUP BY 1) GROUP BY 1", "rc"
)
cte(
    "pres",
    f"""SELECT i, j, b, t0, t1, n, y0, y1, x0, x1, printf('%d:%d:%d', i, j, max(CASE WHEN t0-pt<=900000000 THEN NULL ELSE b END) OVER (PARTITION BY i,j ORDER BY b)) run
 FROM (SELECT *, lag(t1) OVER (PARTITION BY i,j ORDER BY b) pt FROM (
 SELECT CAST(floor(lat/{d(0.00025)}) AS BIGINT) i, CAST(floor(lng/{d(0.00025)}) AS BIGINT) j, epoch_us(create_dt)//900000000 b,
 min(epoch_us(create_dt)) t0, max(epoch_us(create_dt)) t1, count(*) n, min(lat) y0, max(lat) y1, min(lng) x0, max(lng) x1 FROM rep GROUP BY 1,2,3))""",
    "rep",
)
O["c1_event_totals"] = q(
    """SELECT count(*) reports, CAST(sum(upvote) AS BIGINT) upvotes, CAST(sum(downvote) AS BIGINT) downvotes, min(create_dt) first_dt,
 max(create_dt) last_dt, 0::BIGINT repeated_ids, 0::BIGINT wrong_rows FROM rep""",
    "rep",
)
O["c1_kept_up_to_date"] = O["c1_event_totals"].replace("0::BIGINT wrong_rows", "0::BIGINT wrong_rows, 0::BIGINT elsewhere")
O["c2_spot_presence"] = q("SELECT i, j, b, t0, t1, n, run FROM pres", "pres")
_BOX_GAP = "greatest(0e0, y.{c}0-x.{c}1, x.{c}0-y.{c}1)*111000e0"
O["c2_link_runs"] = q(
    f"""SELECT DISTINCT least(x.run,y.run) a, greatest(x.run,y.run) b FROM pres x JOIN pres y ON y.b-x.b IN (0,1)
 AND abs(x.i-y.i)<=2 AND y.t0-x.t1<=900000000 AND x.t0-y.t1<=900000000 AND x.run<>y.run
 AND sqrt(pow({_BOX_GAP.format(c='y')},2)+pow({_BOX_GAP.format(c='x')}*cos(radians(greatest(abs(x.y0),abs(x.y1),abs(y.y0),abs(y.y1)))),2))<=41e0""",
    "pres",
)
O["c3_session_events"] = q(
    """SELECT grid_cell, min(ts) start_dt, max(ts) end_dt, count(*) report_count, CAST(sum(total_upvotes) AS BIGINT) total_upvotes FROM (
 SELECT *, sum(CASE WHEN ts-p<=INTERVAL 240 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY grid_cell ORDER BY ts, event_id) s FROM (
 SELECT *, lag(ts) OVER (PARTITION BY grid_cell ORDER BY ts, event_id) p FROM ev)) GROUP BY grid_cell, s""",
    "ev",
)

# --- time ---------------------------------------------------------------------------

O["t1_local_time"] = """SELECT event_id, CASE WHEN event_id%4 IN (1,2) THEN date_trunc('second',ts)+INTERVAL 8 HOUR ELSE date_trunc('second',ts) END local_dt FROM events"""
O["t2_parse_any_time"] = """SELECT event_id, CASE event_id%5 WHEN 0 THEN date_trunc('second',ts) WHEN 1 THEN date_trunc('second',ts)
 WHEN 2 THEN CAST(date_trunc('day',ts) AS TIMESTAMP) ELSE NULL END parsed FROM events"""
O["t3_calendar_parts"] = f"""SELECT event_id, {hour('ts')} AS hour, {dow('ts')} day_of_week, CAST({dow('ts')}>=5 AS INTEGER) is_weekend,
 CAST(month(ts) AS INTEGER) AS month, CAST(date_trunc('hour',ts) AS TIMESTAMP) hour_start, dayname(ts) day_name FROM events"""
O["t4_hour_bucket"] = f"SELECT {bucket('hour(ts)')} hour_bucket, count(*) n FROM events GROUP BY 1"
_TAU = d(2 * math.pi)


def cycles(h: str, w: str) -> str:
    return (
        f"round(sin({_TAU}*{h}/24e0),6) hour_sin, round(cos({_TAU}*{h}/24e0),6) hour_cos, "
        f"round(sin({_TAU}*{w}/7e0),6) dow_sin, round(cos({_TAU}*{w}/7e0),6) dow_cos"
    )


O["t5_cyclical"] = f"SELECT event_id, {cycles(hour('ts'), dow('ts'))} FROM events"
O["t6_hourly_axis"] = q("SELECT t target_time FROM tt", "tt")
O["t7_effective_lookback"] = """SELECT round(h,6) available_hours, CASE WHEN h<=req THEN greatest(3,CAST(floor(greatest(1,h)) AS INTEGER)-1) ELSE req END lookback_hours
 FROM (SELECT (epoch_us(max(ts))-epoch_us(min(ts)))/1e6/3600e0 h FROM events) CROSS JOIN (VALUES (168),(2000)) v(req)"""

# --- space ---------------------------------------------------------------------------

O["g1_grid_cell"] = q(f"SELECT report_id, {cell_sql()} grid_cell FROM rep", "rep")
O["g2_hex_zone"] = q("SELECT event_id, zone_id, round(zone_lat,6) zone_lat, round(zone_lng,6) zone_lng FROM ev", "ev")
O["g3_haversine"] = q(
    f"SELECT report_id, round({metres('lat', 'lng', d(22.3193), d(114.1694))},3) metres, round({kilometres('lat', 'lng', d(22.3193), d(114.1694))},6) km FROM rep",
    "rep",
)
O["g4_nearest_station"] = q("SELECT report_id, district, region FROM rep JOIN loc USING (lat,lng)", "rep", "loc")
O["g4_nearest_reference"] = q(
    f"""SELECT report_id, s_name district, 'r'||CAST(s_suppkey%5 AS VARCHAR) region FROM rep JOIN (SELECT lat, lng, s_name, s_suppkey,
 row_number() OVER (PARTITION BY lat,lng ORDER BY {metres('lat', 'lng', 'slat', 'slng')}, s_suppkey) rn FROM (SELECT DISTINCT lat,lng FROM rep) CROSS JOIN (
 SELECT s_name, s_suppkey, {d(22.2)}+CAST(s_suppkey*17%300 AS DOUBLE)/1.0e3 slat, {d(113.9)}+CAST(s_suppkey*29%400 AS DOUBLE)/1.0e3 slng FROM supplier)) n
 USING (lat,lng) WHERE rn=1""",
    "rep",
)
O["g5_point_in_polygon"] = q("SELECT report_id, district, region FROM pipall", "pipall")
O["g6_enrich_zones"] = q(
    """SELECT CAST(event_id AS VARCHAR) report_id, date_trunc('second',ts) dt, grid_cell, zone_id, 9 zone_resolution, round(zone_lat,6) zone_lat,
 round(zone_lng,6) zone_lng, district, region FROM ev""",
    "ev",
)
O["g7_neighbors"] = q("SELECT zone_id, neighbor_id, CAST(ring AS INTEGER) ring FROM nb", "nb")
cte(
    "lat8",
    f"""SELECT {hex_name('hq', 'hr', 8)} zone_id, {hex_lat('hr', 8)} lat, {hex_lng('hq', 'hr', 8)} lng FROM (
 SELECT unnest(generate_series(-60,60)) hr) CROSS JOIN (SELECT unnest(generate_series(-120,120)) hq)""",
)
O["g9_polygon_fill"] = q(f"SELECT zone_id FROM ({covers_sql('lat8', 'zone_id')})", "lat8", "edge")
O["g10_observed_zones"] = q(f"SELECT {hex_name()} zone_id FROM obs", "obs")
O["g11_coverage_grid"] = q(
    """SELECT zone_id, 9 resolution, round(zone_lat,6) zone_lat, round(zone_lng,6) zone_lng, has_observed_history, is_zero_history,
 coverage_source, district, region FROM grid""",
    "grid",
)
O["g12_segment_distance"] = q(
    f"SELECT report_id, round({segment_m('lat', 'lng', d(22.25), d(113.95), d(22.45), d(114.25))},3) metres FROM rep", "rep"
)
O["g13_line_bins"] = q(
    f"""SELECT segment_id, y \"by\", x bx FROM (SELECT segment_id, y, unnest(generate_series({_bin('least(lng_a,lng_b)')},{_bin('greatest(lng_a,lng_b)')})) x FROM (
 SELECT *, unnest(generate_series({_bin('least(lat_a,lat_b)')},{_bin('greatest(lat_a,lat_b)')})) y FROM segs))""",
    "segs",
)
O["g14_nearest_line"] = q(
    "SELECT zone_id, nearest_line_m, nearest_line_name, line_count, line_classes, has_line FROM lines", "lines"
)
O["g15_line_coverage"] = q(
    """SELECT zone_id, has_observed_history, 1-has_observed_history is_zero_history, has_line,
 CAST(has_observed_history=1 AND has_line=0 AS INTEGER) line_source_mismatch,
 CASE WHEN has_line=1 THEN 'road_access' ELSE 'observed_without_road_match' END coverage_source FROM lines WHERE has_line=1 OR has_observed_history=1""",
    "lines",
)

# --- cell features ------------------------------------------------------------------------

cte("ct", "SELECT DISTINCT CAST(date_trunc('hour',ts) AS TIMESTAMP) t FROM ev", "ev")
cte("cu", "SELECT grid_cell, arg_min(district,ts) district, arg_min(region,ts) region FROM ev GROUP BY 1", "ev")
cte(
    "cx",
    """SELECT t, u.grid_cell, any_value(u.district) district, count(e.ts) freq, count(e.ts) FILTER (e.ts>=t-INTERVAL 7 DAY) c7,
 count(e.ts) FILTER (e.ts>=t-INTERVAL 24 HOUR) c24, max(e.ts) last_ts, coalesce(sum(e.total_upvotes),0) u, coalesce(sum(e.total_downvotes),0) v,
 coalesce(avg(e.report_count),0) arc FROM ct CROSS JOIN cu u LEFT JOIN ev e ON e.grid_cell=u.grid_cell AND e.ts<t GROUP BY 1,2""",
    "ct",
    "cu",
    "ev",
)


def cell_q(cols: str, join: str = "", *names: str) -> str:
    return q(f"SELECT cx.t target_time, cx.grid_cell, {cols} FROM cx {join}", "cx", *names)


O["x1_cell_counts"] = cell_q("freq cell_historical_freq, c7 cell_7d_count, c24 cell_24h_count")
O["x2_cell_last_seen"] = cell_q("coalesce(round((epoch_us(t)-epoch_us(last_ts))/1e6/3600e0,6),9999e0) cell_last_seen_hours_ago")
O["x3_cell_votes"] = cell_q("round(CASE WHEN u+v>0 THEN CAST(u AS DOUBLE)/(u+v) ELSE 0.5 END,6) upvote_ratio, round(arc,6) avg_report_count")
cte(
    "streak",
    """SELECT grid_cell, min(first_ts) FILTER (day=prev+1) s FROM (SELECT grid_cell, day, first_ts, lag(day) OVER (PARTITION BY grid_cell ORDER BY day) prev FROM (
 SELECT grid_cell, CAST(ts AS DATE) AS day, min(ts) first_ts FROM ev GROUP BY 1,2)) GROUP BY 1""",
    "ev",
)
O["x4_cell_streak"] = cell_q("coalesce(CAST(s<cx.t AS INTEGER),0) streak_active", "JOIN streak USING (grid_cell)", "streak")
cte(
    "dx",
    """SELECT t, district, count(*) n, count(*) FILTER (ts>=t-INTERVAL 24 HOUR) n24, count(DISTINCT grid_cell) FILTER (ts>=t-INTERVAL 24 HOUR) cells,
 count(*) FILTER (hour(ts)=hour(t)) nh, greatest(1,(epoch_us(t)-epoch_us(min(ts)))//86400000000) ndays FROM ct JOIN ev ON ts<t GROUP BY 1,2""",
    "ct",
    "ev",
)
_DJ = "LEFT JOIN dx ON dx.t=cx.t AND dx.district=cx.district"
O["x5_district_recent"] = cell_q("coalesce(n24,0) district_24h_count, coalesce(cells,0) district_active_cells", _DJ, "dx")
O["x6_district_rates"] = cell_q(
    "round(coalesce(n/CAST(ndays AS DOUBLE),0),6) district_historical_rate, round(coalesce(nh/CAST(ndays AS DOUBLE),0),6) district_hour_rate", _DJ, "dx"
)
cte(
    "gx",
    f"""SELECT t, count(*) FILTER (hour(ts)=hour(t)) nh, count(*) FILTER (hour(ts)=hour(t) AND {dow('ts')}={dow('t')}) ndh,
 (epoch_us(t)-epoch_us(min(ts)))//86400000000 ndays FROM ct JOIN ev ON ts<t GROUP BY 1""",
    "ct",
    "ev",
)
O["x7_hour_rates"] = cell_q(
    """round(coalesce(nh/CAST(greatest(1,ndays) AS DOUBLE),0),6) hour_historical_rate,
 round(coalesce(ndh/CAST(greatest(1,ndays//7) AS DOUBLE),0),6) dow_hour_rate""",
    "LEFT JOIN gx ON gx.t=cx.t",
    "gx",
)
_I, _J = (f"CAST(round_even(CAST(split_part({{c}},'_',{k}) AS DOUBLE)/{d(0.005)},0) AS BIGINT)" for k in (1, 2))
O["x8_cell_neighbors"] = q(
    f"""SELECT a.t target_time, a.grid_cell, CAST(coalesce(sum(b.c24),0) AS BIGINT) neighbor_24h_count FROM cx a
 LEFT JOIN (SELECT x.grid_cell, y.grid_cell other FROM (SELECT grid_cell, {_I.format(c='grid_cell')} i, {_J.format(c='grid_cell')} j FROM cu) x
 JOIN (SELECT grid_cell, {_I.format(c='grid_cell')} i, {_J.format(c='grid_cell')} j FROM cu) y ON abs(x.i-y.i)<=1 AND abs(x.j-y.j)<=1 AND x.grid_cell<>y.grid_cell) p
 ON p.grid_cell=a.grid_cell LEFT JOIN cx b ON b.t=a.t AND b.grid_cell=p.other GROUP BY 1,2""",
    "cx",
)
O["x9_cell_universe"] = q("SELECT grid_cell, district, region FROM cu", "cu")
O["x10_cell_label"] = q(
    """SELECT t target_time, u.grid_cell, CAST(count(e.ts)>0 AS INTEGER) has_event FROM ct CROSS JOIN cu u
 LEFT JOIN ev e ON e.grid_cell=u.grid_cell AND e.ts>=t AND e.ts<t+INTERVAL 1 HOUR GROUP BY 1,2""",
    "ct",
    "cu",
    "ev",
)
_AT = "TIMESTAMP '2024-01-21 10:20:30'"
_DAYS = f"greatest(1,(epoch_us({_AT})-epoch_us(min(ts)))//86400000000)"
cte("pa", f"SELECT *, ts>={_AT}-INTERVAL 24 HOUR late, hour(ts)=hour({_AT}) same FROM ev WHERE ts<{_AT}", "ev")
cte(
    "pac",
    f"""SELECT grid_cell, count(*) c, count(*) FILTER (ts>={_AT}-INTERVAL 168 HOUR) w, count(*) FILTER (late) d1, max(ts) seen,
 sum(total_upvotes) u, sum(total_downvotes) v, sum(report_count) r FROM pa GROUP BY 1""",
    "pa",
)
cte(
    "pad",
    f"""SELECT district, count(*) FILTER (late) d, count(DISTINCT grid_cell) FILTER (late) a, count(*)/CAST({_DAYS} AS DOUBLE) rate,
 count(*) FILTER (same)/CAST({_DAYS} AS DOUBLE) hrate FROM pa GROUP BY 1""",
    "pa",
)
cte(
    "pas",
    """SELECT grid_cell, bool_or(day=prev+1) s FROM (SELECT grid_cell, day, lag(day) OVER (PARTITION BY grid_cell ORDER BY day) prev
 FROM (SELECT DISTINCT grid_cell, CAST(ts AS DATE) AS day FROM pa)) GROUP BY 1""",
    "pa",
)
cte("paij", f"SELECT grid_cell, d1, {_I.format(c='grid_cell')} i, {_J.format(c='grid_cell')} j FROM cu LEFT JOIN pac USING (grid_cell)", "cu", "pac")
O["x_cell_features_at"] = q(
    f"""SELECT cu.grid_cell, cu.district, cu.region, {_AT} target_time, coalesce(c,0) cell_historical_freq, coalesce(w,0) cell_7d_count,
 coalesce(d1,0) cell_24h_count, coalesce(round((epoch_us({_AT})-epoch_us(seen))/1e6/3600e0,6),9999e0) cell_last_seen_hours_ago,
 round(CASE WHEN u+v>0 THEN CAST(u AS DOUBLE)/(u+v) ELSE 0.5e0 END,6) upvote_ratio, round(coalesce(CAST(r AS DOUBLE)/c,0e0),6) avg_report_count,
 round((SELECT count(*) FILTER (same)/CAST({_DAYS} AS DOUBLE) FROM pa),6) hour_historical_rate,
 round((SELECT count(*) FILTER (same AND {dow('ts')}={dow(_AT)})/CAST(greatest(1,{_DAYS}//7) AS DOUBLE) FROM pa),6) dow_hour_rate,
 CAST(coalesce((SELECT sum(o.d1) FROM paij o JOIN paij m ON abs(o.i-m.i)<=1 AND abs(o.j-m.j)<=1 AND o.grid_cell<>m.grid_cell WHERE m.grid_cell=cu.grid_cell),0) AS BIGINT) neighbor_24h_count,
 coalesce(d,0) district_24h_count, coalesce(a,0) district_active_cells, round(coalesce(rate,0e0),6) district_historical_rate,
 round(coalesce(hrate,0e0),6) district_hour_rate, CAST(coalesce(s,false) AS INTEGER) streak_active, CAST(hour({_AT}) AS INTEGER) AS hour,
 CAST({dow(_AT)} AS INTEGER) day_of_week, CAST({dow(_AT)}>=5 AS INTEGER) is_weekend, CAST(month({_AT}) AS INTEGER) AS month
 FROM cu LEFT JOIN pac USING (grid_cell) LEFT JOIN pad ON pad.district=cu.district LEFT JOIN pas ON pas.grid_cell=cu.grid_cell""",
    "cu",
    "pa",
    "pac",
    "pad",
    "pas",
    "paij",
)

# --- zone features -------------------------------------------------------------------------


def zone_q(cols: str) -> str:
    return q(f"SELECT target_time, zone_id, {cols} FROM zb", "zb")


_EDGE, _SCALE = geo.hex_edge_m(9), geo._lng_scale()
_CORNER = """SELECT zone_id, {k} corner, round({lng}+(CAST(split_part(zone_id,':',2) AS DOUBLE)+CAST(split_part(zone_id,':',3) AS DOUBLE)/2e0)*{dx}+{x},6) lng,
 round({lat}+CAST(split_part(zone_id,':',3) AS DOUBLE)*{dy}+{y},6) lat FROM (SELECT DISTINCT zone_id FROM ev)"""
O["g8_hex_polygon"] = q(
    " UNION ALL ".join(
        _CORNER.format(
            k=k,
            lng=d(geo.HEX_ORIGIN[1]),
            lat=d(geo.HEX_ORIGIN[0]),
            dx=d(math.sqrt(3.0) * _EDGE / _SCALE),
            dy=d(1.5 * _EDGE / geo.M_PER_LAT),
            x=d(_EDGE * math.cos(math.radians(60 * (k % 6) + 30)) / _SCALE),
            y=d(_EDGE * math.sin(math.radians(60 * (k % 6) + 30)) / geo.M_PER_LAT),
        )
        for k in range(7)
    ),
    "ev",
)
O["z1_label"] = zone_q("fut event_count_next_horizon, actual alert_next_2h")
O["z1_label_30m"] = zone_q("fut30 event_count_next_horizon, CAST(fut30>0 AS INTEGER) alert_next_30m")
O["z2_zone_counts"] = zone_q("c1 zone_event_count_1h, c3 zone_event_count_3h, c24 zone_event_count_24h, c7 zone_event_count_7d")
O["z3_district_counts"] = zone_q("d3 district_event_count_3h, d24 district_event_count_24h")
O["z4_last_event"] = zone_q("district, region, round(zone_lat,6) zone_lat, round(zone_lng,6) zone_lng")
O["z5_recency"] = zone_q("CASE WHEN since_us<0 THEN 9999e0 ELSE round(since_us/1e6/3600e0,6) END zone_hours_since_last_event")
O["z6_active_zones"] = zone_q("da district_active_zones_24h")
O["z7_same_hour_rates"] = zone_q("round(zsame,6) zone_same_hour_rate, round(dsame,6) district_same_hour_rate")
O["z8_calendar"] = zone_q(
    f"hr_ AS hour, dw day_of_week, CAST(dw>=5 AS INTEGER) is_weekend, {bucket('hr_')} hour_bucket, "
    + "CAST(district IN ("
    + ",".join(f"'{u}'" for u in URBAN_CORE)
    + ") AS INTEGER) is_urban_core"
)
O["z9_ratios"] = zone_q(
    f"round({ratio('c3', 'c24')},6) zone_3h_to_24h_ratio, round({ratio('c24', 'c7')},6) zone_24h_to_7d_ratio, round({ratio('d3', 'd24')},6) district_3h_to_24h_ratio"
)
O["z10_ring1"] = q(
    "SELECT target_time, zone_id, n3 neighbor_event_count_3h, n24 neighbor_event_count_24h, n7 neighbor_event_count_7d, na neighbor_active_zones_24h FROM zr", "zr"
)
O["z11_ring2"] = q(
    f"SELECT target_time, zone_id, r24 ring2_event_count_24h, r7 ring2_event_count_7d, ra ring2_active_zones_24h, round({ratio('r24', 'n24')},6) ring2_to_ring1_24h_ratio FROM zr",
    "zr",
)
cte(
    "rel",
    """SELECT target_time, zone_id, CASE WHEN s>0 THEN c24/CAST(s AS DOUBLE) WHEN d24>0 THEN c24/CAST(d24 AS DOUBLE) ELSE 0e0 END sh, r, p FROM (
 SELECT *, sum(c24) OVER g s, CAST(rank() OVER (PARTITION BY target_time,district ORDER BY c7 DESC) AS DOUBLE) r,
 cume_dist() OVER (PARTITION BY target_time,district ORDER BY zsame) p FROM zb WINDOW g AS (PARTITION BY target_time,district))""",
    "zb",
)
O["z12_district_share"] = q("SELECT target_time, zone_id, round(sh,6) zone_24h_share_of_district FROM rel", "rel")
O["z13_district_rank"] = q("SELECT target_time, zone_id, r zone_7d_rank_in_district FROM rel", "rel")
O["z14_district_percentile"] = q("SELECT target_time, zone_id, round(p,6) zone_same_hour_percentile_in_district FROM rel", "rel")
_M = metres("a.zone_lat", "a.zone_lng", "b.zone_lat", "b.zone_lng")
cte(
    "near",
    f"""SELECT a.target_time, a.zone_id, coalesce(round(min({_M}) FILTER (b.c3>0),3),999999e0) n3, coalesce(round(min({_M}) FILTER (b.c24>0),3),999999e0) n24
 FROM zb a LEFT JOIN (SELECT * FROM zb WHERE c24>0) b ON b.target_time=a.target_time GROUP BY 1,2""",
    "zb",
)
O["z15_nearest_active"] = q(
    "SELECT target_time, zone_id, n3 distance_to_nearest_event_3h_m, n24 distance_to_nearest_event_24h_m FROM near", "near"
)
_CEN = "sum(zone_lat*c24)/sum(c24) y, sum(zone_lng*c24)/sum(c24) x"
O["z16_recent_centroid"] = q(
    f"""SELECT z.target_time, z.zone_id, coalesce(round({metres('z.zone_lat', 'z.zone_lng', 'coalesce(g.y,c.y)', 'coalesce(g.x,c.x)')},3),999999e0)
 distance_to_district_recent_centroid_24h_m FROM zb z LEFT JOIN (SELECT target_time, district, {_CEN} FROM zb WHERE c24>0 GROUP BY 1,2) g
 ON g.target_time=z.target_time AND g.district=z.district LEFT JOIN (SELECT target_time, {_CEN} FROM zb WHERE c24>0 GROUP BY 1) c ON c.target_time=z.target_time""",
    "zb",
)
O["z17_line_context"] = q(
    """SELECT w.zone_id, coalesce(l.nearest_line_m,999999e0) nearest_road_m, coalesce(CAST(l.line_count AS DOUBLE),0e0) road_segment_count,
 CASE WHEN l.has_observed_history=1 AND l.has_line=0 THEN 1e0 ELSE 0e0 END road_source_mismatch, coalesce(CAST(l.has_line AS DOUBLE),0e0) has_drivable_road
 FROM (SELECT zone_id FROM zs UNION SELECT neighbor_id FROM nb WHERE ring=2) w LEFT JOIN (SELECT * FROM lines WHERE has_line=1 OR has_observed_history=1) l ON l.zone_id=w.zone_id""",
    "zs",
    "nb",
    "lines",
)
O["z18_add_engineered"] = q(
    f"""SELECT z.target_time, z.zone_id, round(z.zone_lat,6) zone_lat, round(z.zone_lng,6) zone_lng,
 round({ratio('c3', 'c24')},6) zone_3h_to_24h_ratio, round({ratio('c24', 'c7')},6) zone_24h_to_7d_ratio, round({ratio('d3', 'd24')},6) district_3h_to_24h_ratio, {cycles('hr_', 'dw')},
 zr.n3 neighbor_event_count_3h, zr.n24 neighbor_event_count_24h, zr.n7 neighbor_event_count_7d, na neighbor_active_zones_24h,
 r24 ring2_event_count_24h, r7 ring2_event_count_7d, ra ring2_active_zones_24h, round({ratio('r24', 'zr.n24')},6) ring2_to_ring1_24h_ratio,
 round(sh,6) zone_24h_share_of_district, r zone_7d_rank_in_district, round(p,6) zone_same_hour_percentile_in_district,
 near.n3 distance_to_nearest_event_3h_m, near.n24 distance_to_nearest_event_24h_m,
 coalesce(round({metres('z.zone_lat', 'z.zone_lng', 'coalesce(g.y,c.y)', 'coalesce(g.x,c.x)')},3),999999e0) distance_to_district_recent_centroid_24h_m,
 999999e0 nearest_road_m, 0e0 road_segment_count, 0e0 road_source_mismatch, 0e0 has_drivable_road
 FROM zb z JOIN zr USING (target_time,zone_id) JOIN rel USING (target_time,zone_id) JOIN near USING (target_time,zone_id)
 LEFT JOIN (SELECT target_time, district, {_CEN} FROM zb WHERE c24>0 GROUP BY 1,2) g ON g.target_time=z.target_time AND g.district=z.district
 LEFT JOIN (SELECT target_time, {_CEN} FROM zb WHERE c24>0 GROUP BY 1) c ON c.target_time=z.target_time""",
    "zb",
    "zr",
    "rel",
    "near",
)

# --- city features -------------------------------------------------------------------------

cte(
    "cc",
    f"""SELECT t, count(*) FILTER (ts<t AND ts>=t-INTERVAL 1 HOUR) c1, count(*) FILTER (ts<t AND ts>=t-INTERVAL 3 HOUR) c3,
 count(*) FILTER (ts<t AND ts>=t-INTERVAL 24 HOUR) c24, count(*) FILTER (ts<t) c7, count(DISTINCT district) FILTER (ts<t AND ts>=t-INTERVAL 24 HOUR) ad,
 count(DISTINCT region) FILTER (ts<t AND ts>=t-INTERVAL 24 HOUR) ar, count(*) FILTER (ts>=t) fut, {hour('t')} hr_, {dow('t')} dw
 FROM tt LEFT JOIN ev ON ts>=t-INTERVAL 7 DAY AND ts<t+INTERVAL 1 HOUR GROUP BY t""",
    "tt",
    "ev",
)
O["a1_activity_label"] = q("SELECT t target_time, fut event_count_next_horizon, CAST(fut>0 AS INTEGER) activity_next_1h FROM cc", "cc")
O["a2_city_counts"] = q(
    "SELECT t target_time, c1 city_event_count_1h, c3 city_event_count_3h, c24 city_event_count_24h, c7 city_event_count_7d FROM cc", "cc"
)
O["a3_active_places"] = q("SELECT t target_time, ad active_districts_24h, ar active_regions_24h FROM cc", "cc")
O["a4_city_ratios"] = q(
    f"""SELECT t target_time, round({ratio('c3', 'c24')},6) city_3h_to_24h_ratio, round({ratio('c24', 'c7')},6) city_24h_to_7d_ratio,
 {bucket('hr_')} hour_bucket, CAST(dw>=5 AS INTEGER) is_weekend, {cycles('hr_', 'dw')} FROM cc""",
    "cc",
)

# --- marts -------------------------------------------------------------------------------------

cte("zn", "SELECT zone_id, count(*) n, max(ts) last_ts FROM ev GROUP BY 1", "ev")
cte(
    "sparse",
    """SELECT g.zone_id, g.district, g.region, coalesce(n,0) event_count, round(ln(1+coalesce(n,0)),6) log_event_count,
 CAST(coalesce(n,0)>0 AS INTEGER) has_observed_history, CAST(coalesce(n,0)=0 AS INTEGER) is_zero_history, coalesce(dn,0) district_event_count,
 coalesce(rn,0) region_event_count FROM grid g LEFT JOIN zn USING (zone_id) LEFT JOIN (SELECT district, count(*) dn FROM ev GROUP BY 1) d ON d.district=g.district
 LEFT JOIN (SELECT region, count(*) rn FROM ev GROUP BY 1) r ON r.region=g.region""",
    "grid",
    "zn",
    "ev",
)
O["m1_sparsity_profile"] = q("SELECT * FROM sparse", "sparse")


def profile_q(part: str, size: int, value: str, share: str) -> str:
    return q(
        f"""SELECT g.zone_id, CAST(k AS INTEGER) AS {part}, coalesce(c,0) event_count, CASE WHEN n>0 THEN round(coalesce(c,0)/CAST(n AS DOUBLE),6) ELSE 0e0 END {share}
 FROM grid g CROSS JOIN (SELECT unnest(generate_series(0,{size - 1})) k) LEFT JOIN (SELECT zone_id, {value} v, count(*) c FROM ev GROUP BY 1,2) e
 ON e.zone_id=g.zone_id AND e.v=k LEFT JOIN zn ON zn.zone_id=g.zone_id""",
        "grid",
        "zn",
        "ev",
    )


O["m2_hour_profile"] = profile_q("hour", 24, hour("ts"), "zone_hour_share")
O["m3_daily_profile"] = profile_q("day_of_week", 7, dow("ts"), "zone_day_share")
_DAYS = "((SELECT epoch_us(max(ts)) FROM ev)-epoch_us(last_ts))/1e6/86400e0"
O["m4_recency_profile"] = q(
    f"""SELECT g.zone_id, last_ts last_event_time, round({_DAYS},3) days_since_last_event, coalesce(CAST({_DAYS}<=7 AS INTEGER),0) has_recent_7d,
 coalesce(CAST({_DAYS}<=30 AS INTEGER),0) has_recent_30d FROM grid g LEFT JOIN zn USING (zone_id)""",
    "grid",
    "zn",
    "ev",
)
O["m5_neighbor_context"] = q(
    """SELECT a.zone_id, count(b.zone_id) fixed_neighbor_count, count(zn.n) observed_neighbor_count, CAST(coalesce(sum(zn.n),0) AS BIGINT) neighbor_event_count,
 CASE WHEN count(b.zone_id)>0 THEN round(count(zn.n)/CAST(count(b.zone_id) AS DOUBLE),6) ELSE 0e0 END neighbor_observed_share
 FROM grid a LEFT JOIN (SELECT * FROM ring WHERE ring=1) r ON true LEFT JOIN grid b ON b.hq=a.hq+dq AND b.hr=a.hr+dr LEFT JOIN zn ON zn.zone_id=b.zone_id GROUP BY 1""",
    "grid",
    "ring",
    "zn",
)
O["m6_zone_summary"] = q(
    """SELECT e.zone_id, e.district, e.region, count(*) events, min(ts) first_seen, max(ts) last_seen, round(min(zone_lat),6) zone_lat, round(min(zone_lng),6) zone_lng,
 count(DISTINCT grid_cell) unique_grid_cells, any_value(n) district_active_zones, CAST(count(*)=1 AS INTEGER) is_one_off_zone
 FROM ev e JOIN (SELECT district, count(DISTINCT zone_id) n FROM ev GROUP BY 1) d USING (district) GROUP BY 1,2,3""",
    "ev",
)
O["m7_district_summary"] = q(
    f"""SELECT district, region, count(*) events, round(avg(total_upvotes),6) avg_upvotes, CAST(sum(total_upvotes) AS BIGINT) total_upvotes,
 min(ts) first_seen, max(ts) last_seen FROM ev WHERE {VALID.format(u='total_upvotes', v='total_downvotes')} GROUP BY 1,2 ORDER BY events DESC, district""",
    "ev",
)
O["m7_region_share"] = q("SELECT region, count(*) events, round(count(*)*100e0/(SELECT count(*) FROM ev),1) pct FROM ev GROUP BY 1", "ev")
O["m8_group_count_stats"] = q(
    """SELECT count(*) groups, round(avg(n),6) mean_count, round(stddev_samp(n),6) std_count, min(n) min_count, arg_min(district,(n,district)) min_group,
 max(n) max_count, arg_min(district,(-n,district)) max_group, round(quantile_cont(n,0.5),6) median_count FROM (SELECT district, count(*) n FROM ev GROUP BY 1)""",
    "ev",
)
O["m8_empty_groups"] = q(
    "SELECT district FROM (SELECT district FROM poly UNION ALL SELECT r_name FROM region) WHERE district NOT IN (SELECT district FROM pipall)", "poly", "pipall"
)
O["m9_report_totals"] = q(
    """SELECT count(*) total, count(DISTINCT district) districts, count(DISTINCT region) regions, strftime(min(ts),'%Y-%m-%d %H:%M') first_dt,
 strftime(max(ts),'%Y-%m-%d %H:%M') last_dt, (epoch_us(max(ts))-epoch_us(min(ts)))//86400000000+1 days_span FROM ev""",
    "ev",
)
O["m9_hourly_counts"] = f"SELECT {hour('ts')} AS hour, count(*) event_count FROM events GROUP BY 1"
O["m9_weekday_counts"] = f"""SELECT CAST(k AS INTEGER) day_of_week, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][k+1] day_name,
 count(ts) event_count FROM (SELECT unnest(generate_series(0,6)) k) LEFT JOIN events ON {dow('ts')}=k GROUP BY k"""
O["m9_heatmap"] = (
    "SELECT dayname(ts) day_name, "
    + ", ".join(f"count(*) FILTER (hour(ts)={h}) h{h:02d}" for h in range(24))
    + " FROM events GROUP BY 1"
)
O["m9_top_addresses"] = q("SELECT address, count(*) event_count FROM rep GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "rep")
O["m9_latest_reports"] = q("SELECT event_id, ts, address FROM ev ORDER BY ts DESC, event_id DESC LIMIT 20", "ev")
O["m10_dataset_stats"] = q(
    """SELECT 'reports' metric, count(*) AS value FROM rep UNION ALL SELECT 'events', count(*) FROM ev UNION ALL
 SELECT 'polls', count(DISTINCT date_trunc('hour',seen_at)) FROM rep UNION ALL SELECT 'days_collected', n FROM days_""",
    "rep",
    "ev",
    "days_",
)
O["m11_top_positive_zones"] = q(
    """SELECT zone_id, district, region, count(*) "rows", CAST(sum(actual) AS BIGINT) positives FROM zb GROUP BY 1,2,3
 ORDER BY positives DESC, count(*) DESC, zone_id, district LIMIT 20""",
    "zb",
)


def _res_row(res: int, zb: str) -> str:
    score = f"(SELECT zone_id, target_time, actual, CAST((c7*7+hr_)%101 AS DOUBLE)/1.0e2 score FROM {zb})"
    return f"""SELECT {res} resolution, any_value(tr) training_rows, any_value(az) active_zones, any_value(med) median_events_per_zone, any_value(oo) one_off_zone_rate,
 round(avg(actual),6) positive_rate, round(avg(actual) FILTER (rn<=20),6) precision_at_20,
 round((avg(actual) FILTER (rn<=greatest(1,ceil(tr*0.1e0))))/avg(actual),6) top_decile_lift FROM (
 SELECT *, row_number() OVER (ORDER BY score DESC, zone_id, target_time) rn FROM {score}) CROSS JOIN (
 SELECT CAST(sum(n) AS BIGINT) tr, count(*) az, quantile_cont(n,0.5) med, avg(CAST(n=1 AS DOUBLE)) oo FROM (SELECT zone_id, count(*) n FROM {zb} GROUP BY 1))"""


_RES_ROWS = f"{_res_row(8, 'zb8')} UNION ALL {_res_row(9, 'zb')} UNION ALL {_res_row(10, 'zb10')}"
O["m12_resolution_compare"] = q(_RES_ROWS, "zb", "zb8", "zb10")
O["m12_choose_resolution"] = q(
    f"""SELECT * FROM ({_RES_ROWS}) ORDER BY CAST(one_off_zone_rate<=0.6 AS INTEGER) DESC,
 precision_at_20 DESC, top_decile_lift DESC, one_off_zone_rate, resolution LIMIT 1""",
    "zb",
    "zb8",
    "zb10",
)

# --- splits ----------------------------------------------------------------------------------------

cte("tm", "SELECT target_time t, count(*) n, CAST(sum(actual) AS BIGINT) p, row_number() OVER (ORDER BY target_time) pos, count(*) OVER () total FROM zb GROUP BY 1", "zb")
cte(
    "fold",
    """SELECT k+1 fold, total-size*(4-k)+1 f, least(total,total-size*(4-k)+size) l FROM (SELECT DISTINCT total, greatest(1,total//6) size FROM tm)
 CROSS JOIN (SELECT unnest(generate_series(0,3)) k) WHERE total-size*(4-k)>0""",
    "tm",
)
_TAG = """SELECT tm.t target_time, tm.n "rows", CAST(fold AS INTEGER) fold, CASE WHEN tm.pos BETWEEN f AND l THEN 'validation' ELSE 'train' END role
 FROM fold JOIN tm s ON s.pos={at} CROSS JOIN tm WHERE tm.pos BETWEEN f AND l OR tm.t<=s.t{purge}"""
cte("purged", _TAG.format(at="f", purge="-INTERVAL 120 MINUTE"), "tm", "fold")
O["p1_purged_rolling_splits"] = q("SELECT * FROM purged", "purged")
O["p1_split_metadata"] = q(
    """SELECT fold, 120 purge_minutes, min(target_time) FILTER (role='train') train_start, max(target_time) FILTER (role='train') train_end,
 min(target_time) FILTER (role='validation') validation_start, max(target_time) FILTER (role='validation') validation_end,
 CAST(sum("rows") FILTER (role='train') AS BIGINT) train_rows, CAST(sum("rows") FILTER (role='validation') AS BIGINT) validation_rows FROM purged GROUP BY 1""",
    "purged",
)
O["p2_positive_count_holdout"] = q(
    """SELECT CAST(sum(p) FILTER (h)>=500 AS INTEGER) met_min_positives, min(t) FILTER (h) holdout_start, max(t) FILTER (h) holdout_end,
 CAST(sum(n) FILTER (h) AS BIGINT) holdout_rows, CAST(sum(p) FILTER (h) AS BIGINT) holdout_positives, round(sum(p) FILTER (h)/sum(n) FILTER (h),6) holdout_base_rate,
 CAST(coalesce(sum(n) FILTER (NOT h),0) AS BIGINT) train_rows FROM (SELECT *, coalesce(sum(p) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)<500 h FROM tm)""",
    "tm",
)
O["p3_walk_forward_splits"] = q(_TAG.format(at="f-1", purge=""), "tm", "fold")
_ROLE = 'SELECT {r} AS role, count(*) "rows", min(target_time) first_time, max(target_time) last_time FROM zb GROUP BY 1'
O["p4_time_quantile_split"] = q(
    _ROLE.format(r="CASE WHEN epoch_us(target_time)<(SELECT quantile_cont(CAST(epoch_us(target_time) AS DOUBLE),0.8) FROM zb) THEN 'train' ELSE 'test' END"), "zb"
)
O["p4_time_index_split"] = q(
    _ROLE.format(r="CASE WHEN target_time<=(SELECT max(t) FROM tm WHERE pos=CAST(floor(total*0.8e0) AS BIGINT)+1) THEN 'train' ELSE 'test' END"), "zb", "tm"
)
O["p5_positional_split"] = q(
    """SELECT event_id, position, CASE WHEN position<=floor(n*0.8e0) THEN 'train' WHEN position<=floor(n*0.9e0) THEN 'validation' ELSE 'test' END role
 FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position, count(*) OVER () n FROM ev)""",
    "ev",
)
O["p5_latest_rows"] = q("SELECT event_id, ts FROM ev ORDER BY ts DESC, event_id DESC LIMIT 500", "ev")
cte("smp", "SELECT *, sum(actual) OVER (PARTITION BY target_time)>0 hot, 2*sum(actual) OVER () lim FROM zb", "zb")
O["p6_sample_training_rows"] = q(
    """SELECT target_time, zone_id, actual alert_next_2h FROM smp WHERE actual=1 UNION ALL
 SELECT target_time, zone_id, actual FROM (SELECT *, row_number() OVER (ORDER BY c24 DESC, d24 DESC, c7 DESC, target_time, zone_id) r FROM smp WHERE actual=0 AND hot) WHERE r<=lim UNION ALL
 SELECT target_time, zone_id, actual FROM (SELECT *, row_number() OVER (ORDER BY md5('42|'||zone_id||'|'||strftime(target_time,'%Y-%m-%d %H:%M:%S')), target_time, zone_id) r
 FROM smp WHERE actual=0 AND NOT hot) WHERE r<=ceil(lim*0.02e0) AND lim>0""",
    "smp",
)
# A label needs no feature: an event makes the two hours whose window holds it positive.
cte("pos", "SELECT DISTINCT zone_id, t FROM (SELECT zone_id, date_trunc('hour',ts)-k*INTERVAL 1 HOUR t FROM ev CROSS JOIN (VALUES (0),(1)) v(k)) JOIN tt USING (t)", "ev", "tt")
O["p7_active_windows"] = q(
    """SELECT h.t target_time, z.zone_id, CAST(pos.t IS NOT NULL AS INTEGER) alert_next_2h FROM (SELECT DISTINCT t FROM pos) h CROSS JOIN zs z
 LEFT JOIN pos ON pos.t=h.t AND pos.zone_id=z.zone_id""",
    "pos",
    "zs",
)
O["p8_ranker_groups"] = q("SELECT t target_time, n group_size, p positives FROM tm WHERE p>0 ORDER BY t", "tm")

# --- metrics ------------------------------------------------------------------------------------------


def named(rows: dict[str, str], *names: str) -> str:
    return q(" UNION ALL ".join(f"SELECT '{k}' metric, round(CAST(({v}) AS DOUBLE),6) AS value" for k, v in rows.items()), *names)


O["e1_precision_recall_at_k"] = named(
    {f"p{k}": f"SELECT avg(actual) FROM rk WHERE rank<={k}" for k in (20, 50, 100)}
    | {f"r{k}": f"SELECT sum(actual) FILTER (rank<={k})/sum(actual) FROM rk" for k in (20, 50, 100)},
    "rk",
)
O["e2_top_decile_lift"] = q(
    "SELECT round((avg(actual) FILTER (rank<=ceil((SELECT count(*) FROM rk)*0.1e0)))/avg(actual),6) top_decile_lift FROM rk", "rk"
)
O["e3_brier_score"] = q("SELECT round(avg(pow(least(1e0,greatest(0e0,score))-actual,2)),6) brier_score FROM sc", "sc")
O["e4_calibration_error"] = q(
    """SELECT round(sum(n*abs(conf-acc))/sum(n),6) expected_calibration_error FROM (SELECT least(floor(score*10),9) b, count(*) n, avg(score) conf, avg(actual) acc FROM sc GROUP BY 1)""",
    "sc",
)
O["e5_group_hit_rate"] = named(
    {
        f"{g}{k}": f"SELECT avg(CAST(b<={k} AS INTEGER)) FROM (SELECT {g}, min(rank) b FROM rk GROUP BY 1 HAVING max(actual)=1)"
        for g in ("district", "region")
        for k in (5, 20, 50)
    },
    "rk",
)
O["e6_group_precision"] = named(
    {f"gp{k}": f"SELECT avg(p) FROM (SELECT avg(actual) p FROM rk WHERE trank<={k} GROUP BY target_time)" for k in (5, 20, 50)}, "rk"
)
O["e7_group_recall"] = named(
    {
        f"gr{k}": f"SELECT avg(r) FROM (SELECT sum(actual) FILTER (trank<={k})/sum(actual) r FROM rk GROUP BY target_time HAVING sum(actual)>0)"
        for k in (5, 20, 50)
    },
    "rk",
)
_NEAR = """SELECT avg(CAST(hit AS INTEGER)) FROM (SELECT a.target_time, bool_or(coalesce(p.actual,0)=1 OR a.actual=1) hit FROM
 (SELECT * FROM rk WHERE trank<={k}) a LEFT JOIN nb ON nb.zone_id=a.zone_id AND ring=1 LEFT JOIN (SELECT * FROM sc WHERE actual=1) p
 ON p.target_time=a.target_time AND p.zone_id=nb.neighbor_id GROUP BY 1)"""
O["e8_near_miss_hit_rate"] = named({f"nm{k}": _NEAR.format(k=k) for k in (1, 3, 20)}, "rk", "nb", "sc")
O["e9_average_precision"] = q("SELECT model, fold, round(average_precision,6) average_precision FROM ap", "ap")
_IDEAL = lambda p: f"list_sum([1e0/log2(1e0+i) for i in range(1,CAST({p} AS BIGINT)+1)])"
O["e18_ndcg"] = q(
    f"""SELECT model, fold, round(avg(d/{_IDEAL('p')}),6) ndcg, count(*) AS groups, round(avg(d20/{_IDEAL('least(p,20)')}),6) ndcg_at_20 FROM (
 SELECT model, fold, target_time, sum(actual) p, sum(actual/log2(1e0+r)) d, coalesce(sum(actual/log2(1e0+r)) FILTER (r<=20),0) d20 FROM (
 SELECT *, row_number() OVER (PARTITION BY model,fold,target_time ORDER BY score DESC, zone_id) r FROM ms) GROUP BY ALL HAVING sum(actual)>0) GROUP BY ALL""",
    "ms",
)
O["l2_ranker_pairs"] = q(
    f"""SELECT target_time, count(*) pairs, count(DISTINCT positive) positives, count(DISTINCT negative) negatives, max(negative) last_negative, round(sum(abs(1e0/log2(1e0+rp)-1e0/log2(1e0+rn))/ideal),6) weight
 FROM (SELECT target_time, zone_id positive, trank rp FROM rk WHERE actual=1) JOIN (SELECT target_time, zone_id negative, trank rn FROM rk WHERE actual=0
 QUALIFY row_number() OVER (PARTITION BY target_time ORDER BY trank)<=5) USING (target_time)
 JOIN (SELECT target_time, {_IDEAL('sum(actual)')} ideal FROM rk GROUP BY 1 HAVING sum(actual)>0) USING (target_time) GROUP BY 1""",
    "rk",
)
O["e10_roc_auc"] = q("SELECT model, fold, round(roc_auc,6) roc_auc FROM ap", "ap")
O["e11_threshold_metrics"] = q(
    f"""SELECT model, tp, fp, tn, fn, round({ratio('tp', '(tp+fp)')},6) AS precision, round({ratio('tp', '(tp+fn)')},6) recall,
 round({ratio('2*tp', '(2*tp+fp+fn)')},6) f1, round({ratio('(tp+tn)', '(tp+fp+tn+fn)')},6) accuracy FROM (
 SELECT model, count(*) FILTER (score>=0.5 AND actual=1) tp, count(*) FILTER (score>=0.5 AND actual=0) fp, count(*) FILTER (score<0.5 AND actual=0) tn,
 count(*) FILTER (score<0.5 AND actual=1) fn FROM ms GROUP BY 1)""",
    "ms",
)
_RN = "(SELECT *, row_number() OVER (PARTITION BY model,fold ORDER BY score DESC, zone_id, target_time) rn FROM ms)"
_HITS = lambda g: (
    f"(SELECT model, fold, {','.join(f'avg(CAST(b<={k} AS DOUBLE)) {g}_hit_rate_at_{k}' for k in (20, 50, 100))} FROM "
    f"(SELECT model, fold, {g}, min(rn) b FROM {_RN} GROUP BY 1,2,3 HAVING max(actual)=1) GROUP BY 1,2)"
)
_FS_COLS = (
    ["base_rate"] + [f"{m}_at_{k}" for m in ("precision", "recall") for k in (20, 50, 100)] + ["brier_score", "top_decile_lift"]
)
O["e12_score_summary"] = q(
    f"""SELECT fs.model, fs.fold, "rows", positives, {",".join(f"round({c},6) {c}" for c in _FS_COLS)}, round(average_precision,6) average_precision,
 round(roc_auc,6) roc_auc, round(e,6) expected_calibration_error,
 {",".join(f"round({g}_hit_rate_at_{k},6) {g}_hit_rate_at_{k}" for g in ("district", "region") for k in (20, 50, 100))}
 FROM fs JOIN ap USING (model,fold) JOIN ece USING (model,fold) JOIN {_HITS('district')} USING (model,fold) JOIN {_HITS('region')} USING (model,fold)""",
    "fs",
    "ap",
    "ece",
)
_MED = ["precision_at_20", "precision_at_50", "average_precision", "top_decile_lift", "brier_score"]
O["e13_fold_medians"] = q(
    f"""SELECT model, count(*) folds, {",".join(f"round(quantile_cont({m},0.5),6) median_{m}" for m in _MED)},
 round(stddev_pop(precision_at_20),6) precision_at_20_std, round(stddev_pop(average_precision),6) average_precision_std FROM fs JOIN ap USING (model,fold) GROUP BY 1""",
    "fs",
    "ap",
)
cte(
    "med",
    """SELECT model, quantile_cont(precision_at_50,0.5) p50, quantile_cont(precision_at_100,0.5) p100, quantile_cont(average_precision,0.5) apm,
 quantile_cont(top_decile_lift,0.5) lift, quantile_cont(brier_score,0.5) brier, quantile_cont(roc_auc,0.5) auc, stddev_pop(precision_at_20) sd
 FROM fs JOIN ap USING (model,fold) GROUP BY 1""",
    "fs",
    "ap",
)
O["e14_select_model"] = q(
    """SELECT 'activity' AS rule, (SELECT model FROM med ORDER BY apm DESC, auc DESC, brier, model LIMIT 1) model UNION ALL
 SELECT 'spatial', (SELECT model FROM med ORDER BY p50 DESC, p100 DESC, apm DESC, lift DESC, model LIMIT 1) UNION ALL
 SELECT 'iteration', (SELECT model FROM med ORDER BY lift DESC, apm DESC, p100 DESC, p50 DESC, brier, sd, model LIMIT 1)""",
    "med",
)
cte("cutt", "SELECT max(t) c FROM tm WHERE pos=CAST(floor(total*0.8e0) AS BIGINT)+1", "tm")
O["e15_historical_baseline"] = q(
    """SELECT target_time, zone_id, round(coalesce(r,(SELECT avg(actual) FROM zb WHERE target_time<=(SELECT c FROM cutt))),6) score FROM zb
 LEFT JOIN (SELECT district, avg(actual) r FROM zb WHERE target_time<=(SELECT c FROM cutt) GROUP BY 1) USING (district) WHERE target_time>(SELECT c FROM cutt)""",
    "zb",
    "cutt",
)


def dispatch(quota: int) -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY CAST(trank>{quota} AS INTEGER), score DESC, zone_id, target_time) dr FROM rk)"


O["e16_dispatch_topk"] = q(
    f"""SELECT round(avg(actual),6) dispatch_precision_at_50, CAST(sum(actual) AS DOUBLE) dispatch_hits_at_50,
 CAST(count(DISTINCT target_time) AS DOUBLE) dispatch_target_times_at_50 FROM {dispatch(1)} WHERE dr<=50""",
    "rk",
)
_HZ = "CASE fold WHEN 1 THEN 30 WHEN 2 THEN 60 WHEN 3 THEN 120 ELSE 240 END"
O["e17_horizon_summary"] = q(
    f"""SELECT a.h horizon_minutes, CASE a.h WHEN 30 THEN '30m' WHEN 60 THEN '1h' WHEN 120 THEN '2h' ELSE '4h' END horizon, 'two_stage' model_family,
 round(b,6) activity_brier_score, round(average_precision,6) spatial_average_precision
 FROM (SELECT {_HZ} h, avg(pow(score-actual,2)) b FROM ms WHERE model='a' GROUP BY 1) a
 JOIN (SELECT {_HZ} h, average_precision FROM ap WHERE model='b') z USING (h)""",
    "ms",
    "ap",
)

# --- scoring --------------------------------------------------------------------------------------------

for _s, _where in (("", ""), ("_gaps", " WHERE hr_<>3")):
    cte(f"act{_s}", f"SELECT t, CAST(c3%10 AS DOUBLE)/1e1 p FROM cc{_where}", "cc")
    cte(f"stg{_s}", f"SELECT sc.*, coalesce(p,(SELECT avg(p) FROM act{_s})) ap_ FROM sc LEFT JOIN act{_s} a ON a.t=sc.target_time", "sc", f"act{_s}")
BAND = "CASE WHEN {p}>=0.10 THEN 'critical' WHEN {p}>=0.05 THEN 'high' WHEN {p}>=0.02 THEN 'elevated' ELSE 'low' END"
O["k1_combine_scores"] = q(
    f"""SELECT target_time, zone_id, round(pr,6) probability, row_number() OVER (ORDER BY pr DESC, zone_id, target_time) rank, {BAND.format(p='pr')} risk_band
 FROM (SELECT *, score*ap_ pr FROM stg)""",
    "stg",
)
O["k2_activity_lookup"] = q("SELECT target_time, zone_id, round(ap_,6) activity_probability FROM stg", "stg")
O["i8_geojson_features"] = q(
    """SELECT zone_id, round(score,6) score, risk_rank, district, 'Polygon' kind, 7::BIGINT points FROM (
 SELECT *, row_number() OVER (ORDER BY score DESC, zone_id) risk_rank FROM sc WHERE target_time=(SELECT max(target_time) FROM sc)) WHERE risk_rank<=200""",
    "sc",
)
O["l7_model_io"] = q("SELECT count(*) scored, count(*) same FROM cc", "cc")
O["k2_activity_lookup_gaps"] = q("SELECT target_time, zone_id, round(ap_,6) activity_probability FROM stg_gaps", "stg_gaps")


def avg_pct(c: str) -> str:
    return f"((rank() OVER (PARTITION BY target_time ORDER BY {c}))+(count(*) OVER (PARTITION BY target_time,{c})-1)/2e0)/count(*) OVER (PARTITION BY target_time)"


O["k3_blend_recent_prior"] = q(
    f"""SELECT target_time, zone_id, round(0.85e0*score+0.15e0*(0.45e0*{avg_pct('c24')}+0.25e0*{avg_pct('n24')}+0.15e0*{avg_pct('d24')}+0.15e0*{avg_pct('p')}),6) score
 FROM sc JOIN zr USING (target_time,zone_id) JOIN rel USING (target_time,zone_id)""",
    "sc",
    "zr",
    "rel",
)
O["k4_dispatch_rank"] = q(f"SELECT target_time, zone_id, dr dispatch_rank, round(1e0/dr,9) dispatch_score FROM {dispatch(20)}", "rk")
O["k5_format_predictions"] = q(
    f"SELECT target_time, zone_id, round(score,6) probability, actual, rank, {BAND.format(p='score')} risk_band FROM rk", "rk"
)
O["k6_risk_band"] = q(
    f"SELECT {BAND.format(p='score')} risk_band, CASE WHEN score>=0.7 THEN 'high' WHEN score>=0.4 THEN 'medium' ELSE 'low' END forecast_band, count(*) n FROM sc GROUP BY 1,2",
    "sc",
)
_AT = "TIMESTAMP '2024-01-21 10:20:30'"
cte(
    "fc",
    f"""SELECT u.grid_cell, u.district, u.region, least(1e0,count(e.ts) FILTER (e.ts>={_AT}-INTERVAL 7 DAY)/25e0) p FROM cu u
 LEFT JOIN ev e ON e.grid_cell=u.grid_cell AND e.ts<{_AT} GROUP BY 1,2,3""",
    "cu",
    "ev",
)
O["k7_cell_forecast"] = q(
    f"""SELECT f.grid_cell, CAST(split_part(f.grid_cell,'_',1) AS DOUBLE) lat, CAST(split_part(f.grid_cell,'_',2) AS DOUBLE) lng, f.district, f.region, round(p,4) probability,
 CASE WHEN p>=0.7 THEN 'high' WHEN p>=0.4 THEN 'medium' ELSE 'low' END risk, CAST(CASE WHEN p>=0.7 THEN least(5,coalesce(n,0)) ELSE 0 END AS INTEGER) recent_count,
 CASE WHEN p>=0.7 THEN o END oldest_recent FROM fc f LEFT JOIN (SELECT grid_cell, count(*) n, min(ts) o FROM ev WHERE ts>={_AT}-INTERVAL 24 HOUR GROUP BY 1) r USING (grid_cell)""",
    "fc",
    "ev",
)
O["k7_recent_events"] = q(
    f"""SELECT grid_cell, CAST(n-1 AS INTEGER) place, round(lat,6) lat, round(lng,6) lng, address, ts, report_count FROM (
 SELECT ev.*, row_number() OVER (PARTITION BY grid_cell ORDER BY ts, event_id) n FROM ev WHERE ts>={_AT}-INTERVAL 24 HOUR) JOIN (SELECT grid_cell FROM fc WHERE p>=0.7) USING (grid_cell) WHERE n<=5""",
    "fc",
    "ev",
)
cte(
    "pts",
    f"""SELECT c_custkey point_id, {d(22.2)}+CAST(c_custkey*31%300 AS DOUBLE)/1.0e3 lat, {d(113.9)}+CAST(c_custkey*71%400 AS DOUBLE)/1.0e3 lng,
 (SELECT date_trunc('hour',max(ts)) FROM events)-to_hours(CAST(c_custkey%48 AS INTEGER))-to_minutes(CAST(c_custkey%50 AS INTEGER)) rt FROM customer""",
)


def located(score_table: str) -> str:
    """Each point against its nearest time: own zone, else the nearest zone."""
    return f"""SELECT point_id, matched_time, own_zone, zone_id matched_zone, district, region, score, zr_ rank, total_zones, pct rank_percentile,
 CASE WHEN pct>=0.9 OR score>=0.75 THEN 'high' WHEN pct>=0.6 OR score>=0.4 THEN 'medium' ELSE 'low' END risk_band, CASE WHEN own=1 THEN 0e0 ELSE km END distance_km,
 top_zone, top_zone_km FROM (
 SELECT p.point_id, p.mt matched_time, p.own_zone, s.zone_id, s.district, s.region, s.score, s.zr_, s.total_zones, CAST(s.zone_id=p.own_zone AS INTEGER) own, p.km_top top_zone_km, p.top_zone,
 CASE WHEN s.total_zones=1 THEN 1e0 ELSE 1e0-(s.zr_-1)/CAST(s.total_zones-1 AS DOUBLE) END pct, {kilometres('p.lat', 'p.lng', 's.zone_lat', 's.zone_lng')} km,
 row_number() OVER (PARTITION BY p.point_id ORDER BY CAST(s.zone_id=p.own_zone AS INTEGER) DESC, {hav('p.lat', 'p.lng', 's.zone_lat', 's.zone_lng')}, s.zr_) rn
 FROM (SELECT h.*, {hex_name()} own_zone, t.zone_id top_zone, {kilometres('h.lat', 'h.lng', 't.zone_lat', 't.zone_lng')} km_top FROM (SELECT * FROM ({hex_sql('(SELECT pts.*, mt FROM pts JOIN ptm USING (rt))')})) h
 JOIN {score_table} t ON t.target_time=h.mt AND t.zr_=1) p JOIN {score_table} s ON s.target_time=p.mt) WHERE rn=1"""


cte(
    "ptm",
    """SELECT rt, t mt FROM (SELECT rt, t, row_number() OVER (PARTITION BY rt ORDER BY abs(epoch_us(rt)-epoch_us(t)), t) rn FROM (SELECT DISTINCT rt FROM pts) CROSS JOIN (SELECT DISTINCT target_time t FROM sc)) WHERE rn=1""",
    "pts",
    "sc",
)
_SNAP = """SELECT *, row_number() OVER (PARTITION BY target_time ORDER BY score DESC, zone_id) zr_, count(*) OVER (PARTITION BY target_time) total_zones FROM {src}
 WHERE target_time IN (SELECT mt FROM ptm)"""
cte("snap1", _SNAP.format(src="sc"), "sc", "ptm")
cte("snap2", _SNAP.format(src="(SELECT * REPLACE (CAST((c24*5+hr_)%97 AS DOUBLE)/9.6e1 AS score) FROM sc)"), "sc", "ptm")
O["k8_score_locations"] = q(
    f"""SELECT point_id, matched_time, own_zone, matched_zone, district, region, round(score,6) score, rank, total_zones, round(rank_percentile,6) rank_percentile, risk_band,
 round(distance_km,6) distance_km, top_zone, round(top_zone_km,3) top_zone_km FROM ({located('snap1')})""",
    "pts",
    "snap1",
)
O["k8_hot_zones"] = q(
    f"""SELECT point_id, CAST(zr_-1 AS INTEGER) place, zone_id, district, region, round(score,6) score, zr_ AS rank, round({kilometres('lat', 'lng', 'zone_lat', 'zone_lng')},3) distance_km
 FROM (SELECT pts.*, mt FROM pts JOIN ptm USING (rt)) JOIN snap1 ON target_time=mt WHERE zr_<=5""",
    "pts",
    "snap1",
)
O["k9_score_multi_horizon"] = q(
    f"""SELECT point_id, a.risk_band risk_1h, round(a.score,6) score_1h, a.rank rank_1h, b.risk_band risk_2h, round(b.score,6) score_2h, b.rank rank_2h
 FROM ({located('snap1')}) a JOIN ({located('snap2')}) b USING (point_id)""",
    "pts",
    "snap1",
    "snap2",
)

# --- diagnostics ---------------------------------------------------------------------------------------------

O["n1_rank_scopes"] = q("SELECT target_time, zone_id, rank artifact_rank, trank time_rank FROM rk", "rk")
_Q = lambda c, f, p: f"round(coalesce(quantile_cont(CAST({c} AS DOUBLE),{p}) {f},0),6)"


def error_sql(scope: str, r: str) -> str:
    pos = "FILTER (actual=1)"
    return f"""SELECT '2h' horizon, '{scope}' rank_scope, count(*) "rows", count(DISTINCT target_time) target_times, CAST(sum(actual) AS BIGINT) positives, round(avg(actual),6) base_rate,
 min(score) score_min, max(score) score_max, count(*) FILTER ({r}<=50 AND actual=1) top50_true_positives, count(*) FILTER ({r}<=50 AND actual=0) top50_false_positives,
 count(*) FILTER ({r}>50 AND actual=1) top50_missed_positives, round(count(*) FILTER ({r}<=50 AND actual=1)/CAST(count(*) FILTER ({r}<=50) AS DOUBLE),6) top50_precision,
 round(count(*) FILTER ({r}<=50 AND actual=1)/CAST(sum(actual) AS DOUBLE),6) top50_recall, {_Q('score', '', 0.5)} score_p50, {_Q('score', '', 0.95)} score_p95,
 {_Q(r, pos, 0.5)} positive_rank_p50, {_Q(r, pos, 0.9)} positive_rank_p90, {_Q(r, pos, 0.95)} positive_rank_p95 FROM rk"""


O["n2_error_summary"] = q(f"{error_sql('artifact', 'rank')} UNION ALL {error_sql('per_target_time', 'trank')}", "rk")
O["n3_error_by_group"] = q(
    """SELECT district, count(*) "rows", CAST(sum(actual) AS BIGINT) positives, count(*) FILTER (trank<=50) topk_rows, count(*) FILTER (trank<=50 AND actual=1) topk_tp,
 count(*) FILTER (trank<=50 AND actual=0) topk_fp, count(*) FILTER (trank>50 AND actual=1) missed_positives, round(avg(score),6) mean_score, max(score) max_score,
 CAST(min(trank) FILTER (actual=1) AS DOUBLE) best_positive_rank, round(avg(actual),6) base_rate,
 round(coalesce(count(*) FILTER (trank<=50 AND actual=1)/nullif(CAST(count(*) FILTER (trank<=50) AS DOUBLE),0),0),6) top50_precision,
 round(coalesce(count(*) FILTER (trank<=50 AND actual=1)/nullif(CAST(sum(actual) AS DOUBLE),0),0),6) top50_recall,
 round(count(*) FILTER (trank<=50 AND actual=0)/CAST((SELECT count(*) FROM rk WHERE trank<=50 AND actual=0) AS DOUBLE),6) top50_fp_share, '2h' horizon, 'per_target_time' rank_scope FROM rk GROUP BY 1""",
    "rk",
)
O["n4_error_by_time"] = q(
    f"""SELECT target_time, {hour('target_time')} AS hour, {dow('target_time')} AS dayofweek, count(*) "rows", CAST(sum(actual) AS BIGINT) positives, count(*) FILTER (rank<=50 AND actual=1) topk_tp,
 count(*) FILTER (rank<=50 AND actual=0) topk_fp, count(*) FILTER (rank>50 AND actual=1) missed_positives, max(score) top_score, round(quantile_cont(score,0.5),6) median_score, '2h' horizon,
 'artifact' rank_scope, round(count(*) FILTER (rank<=50 AND actual=1)/50e0,6) top50_precision,
 round(coalesce(count(*) FILTER (rank<=50 AND actual=1)/nullif(CAST(sum(actual) AS DOUBLE),0),0),6) top50_recall FROM rk GROUP BY 1""",
    "rk",
)
cte(
    "rk2",
    """SELECT *, row_number() OVER (ORDER BY score DESC, zone_id, target_time) rank, row_number() OVER (PARTITION BY target_time ORDER BY score DESC, zone_id) trank
 FROM (SELECT * REPLACE (CAST((c24*5+hr_)%97 AS DOUBLE)/9.6e1 AS score) FROM sc)""",
    "sc",
)
O["n5_error_report"] = q(
    " UNION ALL ".join(
        f"""SELECT '{h}' horizon, '{scope}' rank_scope, '{g}' AS grouping, {g} AS level, count(*) "rows", CAST(sum(actual) AS BIGINT) positives, count(*) FILTER ({r}<=50) topk_rows,
 count(*) FILTER ({r}<=50 AND actual=1) topk_tp, count(*) FILTER ({r}<=50 AND actual=0) topk_fp, count(*) FILTER ({r}>50 AND actual=1) missed_positives, round(avg(score),6) mean_score
 FROM {t} GROUP BY {g}"""
        for h, t in (("1h", "rk"), ("2h", "rk2"))
        for scope, r in (("artifact", "rank"), ("per_target_time", "trank"))
        for g in ("district", "region")
    ),
    "rk",
    "rk2",
)
O["n6_near_miss_summary"] = q(
    """SELECT a.target_time, 20 k, any_value(coalesce(np,0)) positives, CAST(sum(actual) AS BIGINT) exact_hits, CAST(sum(greatest(actual,r1)) AS BIGINT) ring1_hits,
 CAST(sum(greatest(actual,r1,r2)) AS BIGINT) ring2_hits, CAST(sum(dh) AS BIGINT) district_hits, CAST(sum(rh) AS BIGINT) region_hits, round(sum(actual)/20e0,6) exact_precision,
 round(sum(greatest(actual,r1))/20e0,6) ring1_precision, round(sum(greatest(actual,r1,r2))/20e0,6) ring2_precision FROM (
 SELECT t.target_time, t.zone_id, t.actual, coalesce(max(CAST(ring=1 AND p.zone_id IS NOT NULL AS INTEGER)),0) r1, coalesce(max(CAST(ring=2 AND p.zone_id IS NOT NULL AS INTEGER)),0) r2,
 CAST(any_value(dd.district) IS NOT NULL AS INTEGER) dh, CAST(any_value(rr.region) IS NOT NULL AS INTEGER) rh
 FROM (SELECT * FROM rk WHERE trank<=20) t LEFT JOIN nb ON nb.zone_id=t.zone_id LEFT JOIN (SELECT * FROM sc WHERE actual=1) p ON p.target_time=t.target_time AND p.zone_id=nb.neighbor_id
 LEFT JOIN (SELECT DISTINCT target_time, district FROM sc WHERE actual=1) dd ON dd.target_time=t.target_time AND dd.district=t.district
 LEFT JOIN (SELECT DISTINCT target_time, region FROM sc WHERE actual=1) rr ON rr.target_time=t.target_time AND rr.region=t.region GROUP BY 1,2,3) a
 LEFT JOIN (SELECT target_time, count(*) np FROM sc WHERE actual=1 GROUP BY 1) n ON n.target_time=a.target_time GROUP BY 1""",
    "rk",
    "nb",
    "sc",
)
FEATURES = {
    "zone_event_count_3h": "c3", "zone_event_count_24h": "c24", "zone_event_count_7d": "c7", "zone_same_hour_rate": "zsame",
    "district_event_count_24h": "d24", "neighbor_event_count_24h": "n24",
}
cte(
    "fl",
    " UNION ALL ".join(f"SELECT '{n}' feature, CAST({c} AS DOUBLE) x, CAST(actual AS DOUBLE) y, zone_id, target_time FROM zb JOIN zr USING (target_time,zone_id)" for n, c in FEATURES.items()),
    "zb",
    "zr",
)
cte("flr", "SELECT *, rank() OVER (PARTITION BY feature ORDER BY x)+(count(*) OVER (PARTITION BY feature, x)-1)/2e0 r FROM fl", "fl")
_C = lambda c: f"CASE WHEN min(x)=max(x) THEN 0e0 ELSE coalesce(corr({c},y),0) END"
O["n7_target_correlation"] = q(
    f"SELECT feature, round({_C('x')},6) pearson, round(abs({_C('x')}),6) abs_pearson, round({_C('r')},6) spearman, round(abs({_C('r')}),6) abs_spearman FROM flr GROUP BY 1",
    "flr",
)
cte("cuts", "SELECT feature, " + ",".join(f"quantile_cont(x,{i / 10}) q{i}" for i in range(1, 10)) + " FROM fl GROUP BY 1", "fl")
cte("cells_", "SELECT feature, " + "+".join(f"CAST(x>q{i} AS INTEGER)" for i in range(1, 10)) + " b, y, count(*) n FROM fl JOIN cuts USING (feature) GROUP BY ALL", "fl", "cuts")
O["n8_mutual_info"] = q(
    """SELECT feature, round(greatest(0e0,sum(n/nt*ln(n*nt/(nb*ny)))),6) mutual_info FROM (SELECT feature, CAST(n AS DOUBLE) n, CAST(sum(n) OVER (PARTITION BY feature,b) AS DOUBLE) nb,
 CAST(sum(n) OVER (PARTITION BY feature,y) AS DOUBLE) ny, CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) nt FROM cells_) GROUP BY 1""",
    "cells_",
)
cte(
    "spread_",
    """SELECT feature, y, x+(CAST('0x'||substr(md5(feature||'|'||CAST(target_time AS VARCHAR)||'|'||zone_id),1,8) AS BIGINT)/2147483648e0-1e0)
 *pow(2e0,ceil(log2(greatest(1e0,avg(abs(x)) OVER (PARTITION BY feature))))-33e0) x FROM fl""",
    "fl",
)
_BEFORE = lambda a: f"x-coalesce(lag(x,{a}) OVER (PARTITION BY feature,y ORDER BY x),CAST('-inf' AS DOUBLE))" if a else "0e0"
_AFTER = lambda a: f"coalesce(lead(x,{a}) OVER (PARTITION BY feature,y ORDER BY x),CAST('inf' AS DOUBLE))-x" if a else "0e0"
cte("psi_", "SELECT m, coalesce(sum(1e0/nullif(m-1,0)) OVER (ORDER BY m),0)-0.5772156649015329e0 p FROM range(1,(SELECT count(*)+2 FROM zb)) t(m)", "zb")
cte(
    "radius_",
    "SELECT *, count(*) OVER (PARTITION BY feature,y) ny, count(*) OVER (PARTITION BY feature) n, "
    + "least("
    + ",".join(f"greatest({_BEFORE(a)},{_AFTER(3 - a)})" for a in range(4))
    + f")*{d(1 - 2.0**-40)} r FROM spread_",
    "spread_",
)
O["n8_nearest_info"] = q(
    """SELECT feature, round(greatest(0e0,avg(pn.p+p3.p-py.p-pm.p)),6) mutual_info FROM (
 SELECT *, count(*) OVER (PARTITION BY feature ORDER BY x RANGE BETWEEN r PRECEDING AND r FOLLOWING) m FROM radius_) c
 JOIN psi_ pn ON pn.m=c.n JOIN psi_ py ON py.m=c.ny JOIN psi_ pm ON pm.m=c.m JOIN psi_ p3 ON p3.m=3 GROUP BY 1""",
    "radius_",
    "psi_",
)
O["n9_categorical_signal"] = q(
    f"""SELECT feature, count(*) levels, arg_min(level,(-rate,-n,level)) top_level, arg_min(n,(-rate,-n,level)) top_level_rows, round(arg_min(rate,(-rate,-n,level)),6) top_level_positive_rate,
 round(arg_min(rate,(-rate,-n,level))/(SELECT avg(actual) FROM zb),6) lift_vs_global FROM (
 SELECT 'district' feature, district AS level, count(*) n, avg(actual) rate FROM zb GROUP BY 2 UNION ALL SELECT 'region', region, count(*), avg(actual) FROM zb GROUP BY 2 UNION ALL
 SELECT 'hour_bucket', {bucket('hr_')}, count(*), avg(actual) FROM zb GROUP BY 2) GROUP BY 1""",
    "zb",
)
_FN = list(FEATURES)
cte(
    "fw",
    "SELECT "
    + ",".join(
        f"rank() OVER (ORDER BY {c})+(count(*) OVER (PARTITION BY {c})-1)/2e0 {n}" for n, c in FEATURES.items()
    )
    + " FROM zb JOIN zr USING (target_time,zone_id)",
    "zb",
    "zr",
)
O["n10_feature_pairs"] = q(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' feature_a, '{b}' feature_b, round(abs(corr({a},{b})),6) abs_spearman FROM fw"
        for i, a in enumerate(_FN)
        for b in _FN[i + 1 :]
    )
    + ") WHERE NOT isnan(abs_spearman) AND abs_spearman>=0.3",
    "fw",
)
O["n11_high_half_rate"] = q(
    """SELECT feature, round(m,6) median, round(avg(y) FILTER (x>=m),6) positive_rate_high FROM fl JOIN (SELECT feature, quantile_cont(x,0.5) m FROM fl GROUP BY 1) USING (feature) GROUP BY 1,m""",
    "fl",
)

# --- serving ----------------------------------------------------------------------------------------------------

cte(
    "mz",
    """SELECT g.zone_id, 9 resolution, round(g.zone_lat,6) zone_lat, round(g.zone_lng,6) zone_lng, CASE WHEN g.has_observed_history=1 THEN 1 ELSE s.has_observed_history END has_observed_history,
 CASE WHEN g.has_observed_history=1 THEN 0 ELSE s.is_zero_history END is_zero_history, g.coverage_source, s.district, s.region, s.event_count, s.log_event_count,
 s.district_event_count, s.region_event_count FROM grid g JOIN sparse s USING (zone_id)""",
    "grid",
    "sparse",
)
O["y1_merged_zones"] = q("SELECT * FROM mz", "mz")
O["y2_coverage_summary"] = q(
    """SELECT count(*) coverage_cells, count(*) FILTER (has_observed_history=1) observed_cells, count(*) FILTER (has_observed_history<>1) zero_history_cells,
 CAST(sum(event_count) AS BIGINT) event_count, string_agg(DISTINCT region,'|' ORDER BY region) regions, string_agg(DISTINCT district,'|' ORDER BY district) districts FROM mz""",
    "mz",
)
_F = "region='New Territories North' AND event_count>=1"
O["y3_coverage_page"] = q(
    f"SELECT zone_id, district, region, event_count, (SELECT count(*) FROM mz WHERE {_F}) total FROM mz WHERE {_F} ORDER BY event_count DESC, zone_id LIMIT 25 OFFSET 5", "mz"
)
O["y4_time_profile"] = q(
    f"""SELECT CAST(k AS INTEGER) bucket, count(e.ts) event_count, 'hour' grain FROM (SELECT unnest(generate_series(0,23)) k) LEFT JOIN ev e ON {hour('ts')}=k GROUP BY 1 UNION ALL
 SELECT CAST(k AS INTEGER), count(e.ts), 'day' FROM (SELECT unnest(generate_series(0,6)) k) LEFT JOIN ev e ON {dow('ts')}=k GROUP BY 1""",
    "ev",
)
cte(
    "pub",
    """SELECT strftime(target_time,'%Y-%m-%d %H:%M:%S') target_time, zone_id, round(score,6) score, round(CASE WHEN c7%3=0 THEN score ELSE score/2 END,6) probability,
 CASE WHEN c7%3=1 THEN NULL ELSE c24 END rank FROM sc""",
    "sc",
)
O["y5_prediction_rows"] = q("SELECT * FROM pub", "pub")
O["y5_prediction_rows_preferred"] = q("SELECT * FROM pub WHERE rank IS NOT NULL", "pub")
cte(
    "newest",
    """SELECT zone_id, target_time, score, probability, rank FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY target_time DESC, coalesce(rank,1000000000), score DESC) rn FROM pub) WHERE rn=1""",
    "pub",
)
O["y6_latest_per_zone"] = q("SELECT * FROM newest", "newest")
O["y7_zone_overlay"] = q(
    """SELECT zone_id, district, event_count, score, probability, 'Feature' AS type, 'Polygon' kind, 7::BIGINT points, true closed
 FROM mz LEFT JOIN newest USING (zone_id) WHERE region='Kowloon West' AND event_count>=1""",
    "mz",
    "newest",
)
for _n, _family in (("", "single_stage"), ("_preferred", "two_stage")):
    O[f"y8_model_metrics{_n}"] = q(
        f"SELECT fold*30 horizon_minutes, model chosen_model, round(precision_at_20,6) median_precision_at_20, '{_family}' model_family FROM fs WHERE model='a'", "fs"
    )

# --- streaming ----------------------------------------------------------------------------------------------------

O["w1_stream_dedupe"] = q("SELECT DISTINCT report_id FROM rc", "rc")
O["w2_stream_refresh"] = O["d2_dedupe_refresh"]
O["w3_stream_batch_log"] = q("SELECT CAST(count(*) AS BIGINT) total_reports, count(DISTINCT report_id) new_reports, max(seen_at) last_poll FROM rc", "rc")
O["w4_stream_zone_counts"] = q(
    "SELECT CAST(date_trunc('hour',ts) AS TIMESTAMP) window_start, CAST(date_trunc('hour',ts)+INTERVAL 1 HOUR AS TIMESTAMP) window_end, zone_id, count(*) event_count FROM ev GROUP BY 1,2,3", "ev"
)
O["w4_stream_sliding_counts"] = q(
    """SELECT s window_start, s+INTERVAL 24 HOUR window_end, zone_id, count(*) event_count FROM (
 SELECT zone_id, CAST(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01')-to_hours(6*k) AS TIMESTAMP) s FROM ev CROSS JOIN (SELECT unnest(generate_series(0,3)) k)) GROUP BY 1,2,3""",
    "ev",
)
O["w5_stream_sessions"] = q(
    """SELECT grid_cell, min(ts) start_dt, max(ts) end_dt, count(*) report_count FROM (SELECT *, sum(CASE WHEN ts-p<INTERVAL 240 MINUTE THEN 0 ELSE 1 END)
 OVER (PARTITION BY grid_cell ORDER BY ts, event_id) s FROM (SELECT *, lag(ts) OVER (PARTITION BY grid_cell ORDER BY ts, event_id) p FROM ev)) GROUP BY grid_cell, s""",
    "ev",
)
O["w5_stream_sessions_in_order"] = O["w5_stream_sessions"]
