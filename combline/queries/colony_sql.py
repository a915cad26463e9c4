"""The colony queries in plain SQL, put together from common table expressions."""

from __future__ import annotations

from combline.functions.weather import CODES, RAINY_CODES
from combline.operators.scoring import TRENDS


def q(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits}"


def _with(parts: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


R = """r AS (SELECT hive_id || ':' || colony_side AS c, hive_id AS hive, colony_side AS side, reading_id AS id, ts_epoch AS ts, CAST(floor(epoch(observed_at)) AS BIGINT) AS wall,
  CAST(observed_at AS DATE) AS day, weight_kg AS w, internal_temp_f AS t, internal_humidity_pct AS h, external_temp_f AS et, external_humidity_pct AS eh FROM sensor_readings
  WHERE hive_id IS NOT NULL AND colony_side IS NOT NULL AND reading_id IS NOT NULL AND ts_epoch IS NOT NULL AND observed_at IS NOT NULL
    AND weight_kg IS NOT NULL AND internal_temp_f IS NOT NULL AND internal_humidity_pct IS NOT NULL)"""
BAD = """concat_ws(', ', CASE WHEN w NOT BETWEEN 0.45 AND 136.08 THEN 'weight' END, CASE WHEN t NOT BETWEEN 32 AND 120 THEN 'temperature' END, CASE WHEN h NOT BETWEEN 0 AND 100 THEN 'humidity' END)"""
OUTER = """concat_ws(', ', CASE WHEN et NOT BETWEEN -40 AND 130 THEN 'external temperature' END, CASE WHEN eh NOT BETWEEN 0 AND 100 THEN 'external humidity' END)"""
P = """p AS MATERIALIZED (SELECT *, lag(w) OVER x AS pw, lag(t) OVER x AS pt, lag(h) OVER x AS ph, lag(wall) OVER x AS pwall FROM r WINDOW x AS (PARTITION BY c ORDER BY ts, id))"""


def jump(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> str:
    near = f"({b[0]} - {a[0]} > 0 AND {b[0]} - {a[0]} <= 21600)"
    dw = f"abs({b[1]} - {a[1]})"
    return (
        f"concat_ws(', ', CASE WHEN {near} AND {dw} > 3.63e0 AND CASE WHEN {a[1]} <> 0 THEN {dw} / {a[1]} * 100 ELSE 0 END > 12 THEN 'weight' END, "
        f"CASE WHEN {near} AND abs({b[2]} - {a[2]}) > 25 THEN 'temperature' END, CASE WHEN {near} AND abs({b[3]} - {a[3]}) > 45 THEN 'humidity' END)"
    )


CAND = """cand AS MATERIALIZED (SELECT *, CASE WHEN delta >= 3 THEN 'addition' WHEN abs(t - pt) >= 5 OR abs(h - ph) >= 10 THEN 'swarm' ELSE 'harvest' END AS kind
  FROM (SELECT *, (wall - pwall) / 3600e0 AS elapsed, w - pw AS delta, (w - pw) / pw * 100 AS pct FROM p WHERE wall - pwall > 0 AND wall - pwall <= 28800 AND pw > 0 AND w > 0)
  WHERE delta >= 3 OR (delta < 0 AND abs(pct) >= 3 AND abs(delta) >= 1))"""
CLUS = """clus AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY ts, id) AS k
  FROM (SELECT *, coalesce((wall - lag(wall) OVER (PARTITION BY c ORDER BY ts, id)) / 3600e0 > 12, true) AS fresh FROM cand))"""
NET = """grp AS (SELECT c, hive, side, k, count(*) AS steps, first(pw ORDER BY ts, id) AS before, last(w ORDER BY ts, id) AS after, min(wall) AS wall0, max(wall) AS wall1,
  first({'id': id, 'ts': ts, 'wall': wall, 'kind': kind, 'delta': delta, 'pct': pct, 'elapsed': elapsed} ORDER BY abs(delta) DESC, ts, id) AS d FROM clus GROUP BY c, hive, side, k),
net AS (SELECT c, hive, side, d.id AS id, d.ts AS ts, d.wall AS wall, steps, before, after, delta, pct, CASE WHEN steps = 1 THEN d.elapsed ELSE (wall1 - wall0) / 3600e0 END AS elapsed,
    CASE WHEN steps = 1 THEN d.kind WHEN delta > 0 THEN 'addition' WHEN delta < 0 AND d.delta > 0 THEN 'harvest' ELSE d.kind END AS kind
  FROM (SELECT *, CASE WHEN steps = 1 THEN d.delta ELSE after - before END AS delta, CASE WHEN steps = 1 THEN d.pct ELSE (after - before) / before * 100 END AS pct FROM grp)
  WHERE steps = 1 OR (delta > 0 AND delta >= 3) OR (delta <= 0 AND abs(pct) >= 3 AND abs(delta) >= 1))"""
CONF = """conf AS MATERIALIZED (SELECT * FROM (SELECT n.c, n.hive, n.side, n.id, n.ts, n.wall, n.kind, n.before, n.delta, n.pct, n.steps, median(r.w) AS level FROM net n
    JOIN r ON r.c = n.c AND r.w > 0 AND (r.ts > n.ts OR (r.ts = n.ts AND r.id >= n.id)) AND r.wall - n.wall <= 43200 GROUP BY ALL)
  WHERE delta <> 0 AND (level - before > 0) = (delta > 0) AND abs(level - before) >= 0.5e0 * abs(delta))"""
EV = """ev AS MATERIALIZED (SELECT e.*, EXISTS (SELECT 1 FROM conf o WHERE o.hive = e.hive AND o.side <> e.side AND abs(o.wall - e.wall) <= 28800)
    AND e.hive IN (SELECT hive FROM r GROUP BY hive HAVING count(DISTINCT side) = 2) AS corroborated FROM conf e)"""
STEPS = [R, P, CAND, CLUS, NET, CONF, EV]
SEG = f"""valid AS (SELECT * FROM r WHERE {BAD} = '')"""


def segments(src: str) -> list[str]:
    return [
        f"""sg AS MATERIALIZED (SELECT v.c, v.hive, v.id, v.ts, v.wall, v.w, count(e.id) AS segment FROM {src} v LEFT JOIN ev e ON e.c = v.c AND e.wall <= v.wall GROUP BY v.c, v.hive, v.id, v.ts, v.wall, v.w)""",
        """ss AS (SELECT *, CASE WHEN row_number() OVER x = 1 THEN 1 WHEN (wall1 - wall0) / 3600e0 < 12 THEN 0 ELSE 1 END AS opens FROM
  (SELECT c, segment, first(wall ORDER BY ts, id) AS wall0, last(wall ORDER BY ts, id) AS wall1 FROM sg GROUP BY c, segment) WINDOW x AS (PARTITION BY c ORDER BY segment))""",
        """mg AS MATERIALIZED (SELECT sg.*, m.merged FROM sg JOIN (SELECT c, segment, sum(opens) OVER (PARTITION BY c ORDER BY segment) AS merged FROM ss) m USING (c, segment))""",
        """sl AS (SELECT *, CASE WHEN w0 <> 0 THEN slope / w0 * 100 ELSE 0 END AS slope_pct FROM (SELECT c, CAST(merged AS BIGINT) AS merged, count(*) AS n, first(w ORDER BY ts, id) AS w0, last(w ORDER BY ts, id) AS w1,
    first(wall ORDER BY ts, id) AS wall0, last(wall ORDER BY ts, id) AS wall1,
    CASE WHEN count(*) >= 2 AND min(wall) < max(wall) THEN regr_slope(w, wall / 86400e0 - 19000) ELSE 0 END AS slope FROM mg GROUP BY c, merged))""",
        """tr AS (SELECT c, segments, delta_kg, CASE WHEN start IS NOT NULL AND start <> 0 THEN delta_kg / start * 100 ELSE 0 END AS weight_pct_change,
    CASE WHEN s > 0 THEN a / s ELSE 0 END AS weight_slope_kg_per_day, CASE WHEN s > 0 THEN b / s ELSE 0 END AS weight_slope_pct_per_day FROM
  (SELECT c, count(*) AS segments, coalesce(sum(w1 - w0) FILTER (n >= 2), 0) AS delta_kg, first(w0 ORDER BY merged) FILTER (n >= 2) AS start,
     coalesce(sum(slope * span) FILTER (n >= 2), 0) AS a, coalesce(sum(slope_pct * span) FILTER (n >= 2), 0) AS b, coalesce(sum(span) FILTER (n >= 2), 0) AS s
   FROM (SELECT *, greatest((wall1 - wall0) / 86400e0, 1e0 / 24) AS span FROM sl) GROUP BY c))""",
    ]


SETTLE = """settled AS MATERIALIZED (SELECT DISTINCT r.c, r.id FROM r JOIN ev e ON e.c = r.c AND r.wall BETWEEN e.wall AND e.wall + 10800)"""
_NOW = "{'id': o.id, 'wall': o.wall, 'w': o.w, 't': o.t, 'h': o.h, 'why': ''}"
_KIND = "STRUCT(id BIGINT, wall BIGINT, w DOUBLE, t DOUBLE, h DOUBLE, why VARCHAR)"
_OUT = "STRUCT(id BIGINT, kept BOOLEAN, reasons VARCHAR, note_n INTEGER, note_kg DOUBLE)"
_FLUSH = "list_transform(p, lambda x: {'id': x.id, 'kept': false, 'reasons': x.why, 'note_n': NULL::INTEGER, 'note_kg': NULL::DOUBLE})"
FOLD = f"""o AS MATERIALIZED (SELECT r.c, r.id, r.wall, r.w, r.t, r.h, {BAD} AS bad, s.id IS NOT NULL AS settle, row_number() OVER (PARTITION BY r.c ORDER BY r.ts, r.id) AS n
  FROM r LEFT JOIN settled s ON s.c = r.c AND s.id = r.id),
f AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS n, NULL::{_KIND} AS a, CAST([] AS {_KIND}[]) AS p, CAST([] AS {_OUT}[]) AS e FROM o
  UNION ALL
  SELECT c, n, CASE WHEN step = 'bad' THEN a WHEN step = 'keep' OR len(p2) >= 3 THEN now ELSE a END,
    CASE WHEN step <> 'hold' OR len(p2) >= 3 THEN CAST([] AS {_KIND}[]) ELSE p2 END,
    CAST(CASE WHEN step = 'bad' THEN list_append({_FLUSH}, {{'id': now.id, 'kept': false, 'reasons': bad, 'note_n': NULL::INTEGER, 'note_kg': NULL::DOUBLE}})
      WHEN step = 'keep' THEN list_append({_FLUSH}, {{'id': now.id, 'kept': true, 'reasons': NULL::VARCHAR, 'note_n': NULL::INTEGER, 'note_kg': NULL::DOUBLE}})
      ELSE list_concat(CASE WHEN broken THEN {_FLUSH} ELSE [] END, CASE WHEN len(p2) >= 3 THEN list_transform(p2, lambda x, i: {{'id': x.id, 'kept': true, 'reasons': NULL::VARCHAR,
        'note_n': CASE WHEN i = 1 THEN len(p2)::INTEGER END, 'note_kg': CASE WHEN i = 1 THEN abs(now.w - a.w) END}}) ELSE [] END) END AS {_OUT}[])
  FROM (SELECT *, CASE WHEN bad <> '' THEN 'bad' WHEN settle OR a IS NULL OR why = '' THEN 'keep' ELSE 'hold' END AS step,
      CASE WHEN broken THEN [{{'id': now.id, 'wall': now.wall, 'w': now.w, 't': now.t, 'h': now.h, 'why': why}}]
        ELSE list_append(p, {{'id': now.id, 'wall': now.wall, 'w': now.w, 't': now.t, 'h': now.h, 'why': why}}) END AS p2
    FROM (SELECT f.c, o.n, f.a, f.p, o.bad, o.settle, {_NOW} AS now, {jump(("f.a.wall", "f.a.w", "f.a.t", "f.a.h"), ("o.wall", "o.w", "o.t", "o.h"))} AS why,
        len(f.p) > 0 AND {jump(("f.p[-1].wall", "f.p[-1].w", "f.p[-1].t", "f.p[-1].h"), ("o.wall", "o.w", "o.t", "o.h"))} <> '' AS broken
      FROM f JOIN o ON o.c = f.c AND o.n = f.n + 1))),
said AS (SELECT c, unnest(e) AS v FROM f UNION ALL SELECT c, unnest({_FLUSH}) FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC) = 1)),
jd AS MATERIALIZED (SELECT r.*, v.kept, v.reasons, v.note_n, v.note_kg FROM r JOIN (SELECT c, v FROM said) s ON s.c = r.c AND s.v.id = r.id),
kept AS MATERIALIZED (SELECT * FROM jd WHERE kept)"""
FLAGS = """fl AS (SELECT c, day, 'excluded' AS flag FROM jd WHERE NOT kept UNION ALL SELECT c, day, 'missed' FROM jd WHERE note_n IS NOT NULL
  UNION ALL SELECT c, day, 'external' FROM jd WHERE w BETWEEN 0.45 AND 136.08 AND t BETWEEN 32 AND 120 AND h BETWEEN 0 AND 100 AND et NOT BETWEEN -40 AND 130
  UNION ALL SELECT c, day, 'external' FROM jd WHERE w BETWEEN 0.45 AND 136.08 AND t BETWEEN 32 AND 120 AND h BETWEEN 0 AND 100 AND eh NOT BETWEEN 0 AND 100),
qc AS (SELECT c, count(*) AS issues, count(*) FILTER (flag = 'excluded') AS excluded, count(DISTINCT day) AS issue_days FROM fl GROUP BY c)"""
_RAIN = ", ".join(map(str, RAINY_CODES))
WX = """wx AS (SELECT * FROM weather_readings WHERE hive_id IS NOT NULL AND observed_date IS NOT NULL)"""
DAYS = f"""dt AS (SELECT hive_id, observed_date, CASE WHEN rainy OR temp < 50 OR temp > 95 OR cloud >= 85 THEN 'poor'
    WHEN temp BETWEEN 55 AND 90 AND coalesce(cloud < 75, true) AND coalesce(humid < 90, true) THEN 'favorable' ELSE 'neutral' END AS day_type FROM
  (SELECT hive_id, observed_date, coalesce(bool_or(weather_code IN ({_RAIN})), false) AS rainy, avg(temperature_f) AS temp, avg(cloudiness_pct) AS cloud, avg(humidity_pct) AS humid FROM wx GROUP BY ALL))"""


def daily(src: str, skip: bool) -> str:
    where = "WHERE (c, day) NOT IN (SELECT c, CAST(make_timestamp(wall * 1000000) AS DATE) FROM ev)" if skip else ""
    return f"""dc AS (SELECT c, hive, day, n, CASE WHEN a = 0 THEN 0 ELSE (z - a) / a * 100 END AS pct FROM (SELECT c, hive, day, count(*) AS n, first(w ORDER BY ts, id) AS a, last(w ORDER BY ts, id) AS z FROM {src} {where} GROUP BY c, hive, day) WHERE n >= 2)"""


def ends(src: str) -> str:
    return f"""fla AS (SELECT *, greatest((end_wall - start_wall) / 86400e0, 1e0 / 24) AS days_observed FROM (SELECT c, hive, side, count(*) AS sample_count, first(wall ORDER BY ts, id) AS start_wall, last(wall ORDER BY ts, id) AS end_wall, last(w ORDER BY ts, id) AS latest FROM {src} GROUP BY c, hive, side))"""


MILES = "2 * 3958.7613e0 * asin(sqrt(least(1e0, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"
SITES = f"""st AS MATERIALIZED (SELECT DISTINCT hive_id, latitude, longitude FROM hive_sites WHERE hive_id IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180),
prs AS MATERIALIZED (SELECT a.hive_id AS a, b.hive_id AS b FROM st a JOIN st b ON a.hive_id <> b.hive_id WHERE {MILES} <= 10),
reach AS (SELECT hive_id AS a, hive_id AS b FROM st UNION SELECT reach.a, prs.b FROM reach JOIN prs ON reach.b = prs.a),
rg AS MATERIALIZED (SELECT a AS hive_id, min(b) AS region_id FROM reach GROUP BY a)"""
FEAT = [
    *STEPS, SETTLE, FOLD, FLAGS, *segments("kept"), ends("kept"), WX.replace("IS NOT NULL)", "IS NOT NULL AND observed_date IN (SELECT day FROM kept))"), DAYS, daily("kept", True),
    """ww AS (SELECT c, count(*) FILTER (day_type = 'favorable') AS nf, count(*) FILTER (day_type = 'poor') AS np, coalesce(avg(pct) FILTER (day_type = 'favorable'), 0) AS fav,
  coalesce(avg(abs(least(0e0, pct))) FILTER (day_type = 'poor'), 0) AS poor FROM dc JOIN dt ON dt.hive_id = dc.hive AND dt.observed_date = dc.day GROUP BY c)""",
    SITES,
    """feat AS MATERIALIZED (SELECT fla.c AS colony_id, fla.hive AS hive_id, fla.side AS colony_side, coalesce(rg.region_id, fla.hive) AS region_id, sample_count, segments, coalesce(nf, 0) AS favorable_weather_window_count, coalesce(np, 0) AS poor_weather_window_count,
  coalesce(ne, 0) AS weight_event_count, coalesce(excluded, 0) AS excluded_reading_count, coalesce(issue_days, 0) AS data_quality_issue_days, latest AS latest_weight_kg, weight_pct_change, weight_slope_pct_per_day,
  coalesce(fav, 0) AS favorable_weather_weight_slope_pct_per_day, coalesce(poor, 0) AS poor_weather_weight_loss_pct FROM fla LEFT JOIN tr USING (c) LEFT JOIN ww USING (c) LEFT JOIN qc USING (c) LEFT JOIN rg ON rg.hive_id = fla.hive
  LEFT JOIN (SELECT c, count(*) AS ne FROM ev GROUP BY c) USING (c))""",
]
CMP = [
    *FEAT,
    """lg AS (SELECT region_id, colony_id, hive_id, colony_side, 0 AS ord, 'latest_weight_kg' AS metric, 0.45e0 AS weight, 1 AS sign, latest_weight_kg AS v FROM feat
  UNION ALL SELECT region_id, colony_id, hive_id, colony_side, 1, 'weight_pct_change', 0.26e0, 1, weight_pct_change FROM feat
  UNION ALL SELECT region_id, colony_id, hive_id, colony_side, 2, 'weight_slope_pct_per_day', 0.14e0, 1, weight_slope_pct_per_day FROM feat
  UNION ALL SELECT region_id, colony_id, hive_id, colony_side, 3, 'favorable_weather_weight_slope_pct_per_day', 0.09e0, 1, favorable_weather_weight_slope_pct_per_day FROM feat WHERE favorable_weather_window_count >= 1
  UNION ALL SELECT region_id, colony_id, hive_id, colony_side, 4, 'poor_weather_weight_loss_pct', 0.06e0, -1, poor_weather_weight_loss_pct FROM feat WHERE poor_weather_window_count >= 1)""",
    """cp AS MATERIALIZED (SELECT *, sqrt(n - 1) AS zb, CASE WHEN n <= 2 OR (sd > 0 AND sqrt(n - 1) > 0 AND abs(z) >= 0.999e0 * sqrt(n - 1)) THEN 'low' ELSE 'normal' END AS confidence FROM
  (SELECT *, CASE WHEN sd < 1e-6 THEN 0 ELSE floor((mu - v) / sd * sign * 1e9 + 0.5e0) / 1e9 END AS z FROM (SELECT *, count(*) OVER x AS n, avg(v) OVER x AS mu, stddev_pop(v) OVER x AS sd FROM lg WINDOW x AS (PARTITION BY region_id, metric))) WHERE n >= 2)""",
]
SCORE = [
    *CMP,
    """sc AS MATERIALIZED (SELECT *, CASE WHEN score >= 55 OR performance_flags >= 3 THEN 'underperforming' WHEN score >= 30 OR performance_flags > 0 OR ((excluded_reading_count > 0 OR data_quality_issue_days > 0) AND data_quality_issue_days > 0.3e0 * 7) THEN 'watch' ELSE 'normal' END AS status FROM
  (SELECT feat.*, floor(floor(least(100e0, coalesce(raw, 0) / greatest(coalesce(ws, 0), 0.001e0) * 35) * 1e6 + 0.5e0) / 1e6 * 10 + 0.5e0) / 10 AS score, coalesce(mf, 0) + CASE WHEN weight_pct_change <= -5 THEN 1 ELSE 0 END AS performance_flags, coalesce(lc, 0) AS low_confidence
   FROM feat LEFT JOIN (SELECT colony_id, sum(greatest(0e0, z) * weight) AS raw, sum(weight) AS ws, count(*) FILTER (z >= 1) AS mf, count(*) FILTER (confidence = 'low') AS lc FROM cp GROUP BY colony_id) USING (colony_id)))""",
]
GAPS = """gp AS (SELECT *, (mx - last_wall) / 86400e0 AS gap FROM (SELECT s.hive_id, x.side AS colony_side, s.hive_id || ':' || x.side AS colony_id, l.last_wall, (SELECT max(wall) FROM r) AS mx
  FROM (SELECT DISTINCT hive_id FROM hive_sites WHERE hive_id IS NOT NULL) s CROSS JOIN (VALUES ('L'), ('R')) x(side) LEFT JOIN (SELECT c, max(wall) AS last_wall FROM r GROUP BY c) l ON l.c = s.hive_id || ':' || x.side)
  WHERE last_wall IS NULL OR (mx - last_wall) / 86400e0 > 1)"""
_TREND = ", ".join(f"'{t}'" for t in TRENDS)
SIS = [
    *CMP,
    """sm AS MATERIALIZED (SELECT hive_id, metric, ord, lv, rv, CASE WHEN gap > 0 THEN 'L' WHEN gap < 0 THEN 'R' END AS worse_side, abs(gap) AS raw_gap, least(100e0, CASE WHEN sd > 0 THEN abs(gap) / sd ELSE 0 END * weight * 35) AS impact FROM
  (SELECT l.hive_id, l.metric, l.ord, l.weight, l.v AS lv, r2.v AS rv, CASE WHEN l.sign = 1 THEN r2.v - l.v ELSE l.v - r2.v END AS gap, CASE WHEN l.sd > 0 AND r2.sd > 0 THEN (l.sd + r2.sd) / 2 ELSE greatest(l.sd, r2.sd) END AS sd
   FROM cp l JOIN cp r2 ON l.hive_id = r2.hive_id AND l.metric = r2.metric AND l.colony_side = 'L' AND r2.colony_side = 'R'))""",
]
SISTER = [
    *SIS,
    """sv AS (SELECT hive_id, left_score, right_score, CASE WHEN sides < 2 OR abs(left_score - right_score) < 5 THEN NULL WHEN left_score > right_score THEN 'L' ELSE 'R' END AS weaker_side,
   CASE WHEN sides < 2 THEN 'incomplete' WHEN abs(left_score - right_score) < 5 THEN 'similar' WHEN greatest(left_score, right_score) >= 25 OR abs(left_score - right_score) >= 15 THEN 'notably weaker' ELSE 'mildly weaker' END AS verdict
  FROM (SELECT f.hive_id, count(DISTINCT f.colony_side) AS sides, floor(coalesce(max(x.l), 0) * 10 + 0.5e0) / 10 AS left_score, floor(coalesce(max(x.r), 0) * 10 + 0.5e0) / 10 AS right_score
    FROM feat f LEFT JOIN (SELECT hive_id, sum(impact) FILTER (worse_side = 'L') AS l, sum(impact) FILTER (worse_side = 'R') AS r FROM sm GROUP BY hive_id) x ON x.hive_id = f.hive_id GROUP BY f.hive_id))""",
    f"""cn AS (SELECT sm.hive_id, first(worse_side ORDER BY impact DESC, ord) AS declining_side FROM sm JOIN sv USING (hive_id) WHERE metric IN ({_TREND}) AND worse_side IS NOT NULL AND (weaker_side IS NULL OR worse_side <> weaker_side) AND impact >= 4
   AND CASE WHEN metric = 'poor_weather_weight_loss_pct' THEN CASE worse_side WHEN 'L' THEN lv ELSE rv END > 0 ELSE CASE worse_side WHEN 'L' THEN lv ELSE rv END < 0 END GROUP BY sm.hive_id)""",
]
VARY = [
    *CMP,
    """ms AS (SELECT * FROM (VALUES (0, 'latest_weight_kg', 0.45e0), (1, 'weight_pct_change', 0.26e0), (2, 'weight_slope_pct_per_day', 0.14e0), (3, 'favorable_weather_weight_slope_pct_per_day', 0.09e0), (4, 'poor_weather_weight_loss_pct', 0.06e0)) t(i, metric, w)),
va AS (SELECT CAST(0 AS BIGINT) AS variant, metric, w FROM ms UNION ALL SELECT 1 + v.i * 4 + f.j, ms.metric, CASE WHEN ms.i = v.i THEN ms.w * f.x ELSE ms.w END FROM ms v CROSS JOIN (VALUES (0, 0.5e0), (1, 0.75e0), (2, 1.25e0), (3, 1.5e0)) f(j, x) CROSS JOIN ms)""",
    """rs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY variant, region_id ORDER BY score DESC, colony_id) AS rank FROM (SELECT variant, region_id, colony_id, floor(floor(least(100e0, sum(greatest(0e0, z) * va.w) / greatest(sum(va.w), 0.001e0) * 35) * 1e6 + 0.5e0) / 1e6 * 10 + 0.5e0) / 10 AS score
  FROM cp JOIN va USING (metric) GROUP BY ALL))""",
]
LAB = """rc AS (SELECT c, id AS record, ts AS t1, CASE WHEN id % 300 = 0 THEN 'non_event' ELSE 'event' END AS label FROM r WHERE id % 100 = 0),
ar AS (SELECT hive, min(ts) AS a, min(ts) + 30 * 86400 AS z FROM r WHERE side = 'L' GROUP BY hive)"""
REPLAY = f"""bounds AS (SELECT min(wall) AS a, max(wall) AS z FROM base),
r AS (SELECT b.* REPLACE (b.c || '#' || k AS c, b.hive || '#' || k AS hive), k AS win FROM base b, bounds, range(0, 2000) t(k) WHERE b.wall BETWEEN a + k * 1296000 AND a + 2592000 + k * 1296000 AND a + 2592000 + k * 1296000 <= z + 1296000)"""
SEEN = """seen AS (SELECT regexp_replace(c, '#\\d+$', '') AS c, wall, min(CAST(regexp_extract(c, '#(\\d+)$', 1) AS BIGINT)) AS first_window, arg_min(kind, CAST(regexp_extract(c, '#(\\d+)$', 1) AS BIGINT)) AS kind FROM ev GROUP BY 1, 2)"""
REPLAYED = [R.replace("r AS", "base AS", 1), REPLAY, *STEPS[1:], SEEN]
NORMAL = """nm AS MATERIALIZED (SELECT p.* FROM p ANTI JOIN settled s ON s.c = p.c AND s.id = p.id WHERE wall - pwall > 0 AND wall - pwall <= 21600 AND w > 0 AND pw > 0),
mv AS MATERIALIZED (SELECT 'weight_kg' AS channel, abs(w - pw) AS x, 3.63e0 AS lim FROM nm UNION ALL SELECT 'weight_pct', abs(w - pw) / pw * 100, 12 FROM nm UNION ALL SELECT 'temp_f', abs(t - pt), 25 FROM nm UNION ALL SELECT 'humidity_pp', abs(h - ph), 45 FROM nm)"""
_MEMBERS = ", ".join(f"('{m}')" for m in ("wL", "tL", "hL", "wR", "tR", "hR", "tE", "hE"))
JSON = f"""js AS (SELECT raw_id, m.member, TRY_CAST(json_extract_string(sensor_data, '$.' || m.member || '.N') AS DOUBLE) AS value FROM (SELECT * FROM sensor_raw WHERE json_valid(sensor_data)) CROSS JOIN (VALUES {_MEMBERS}) m(member))"""

_EVENT = "STRUCT(t0 BIGINT, id BIGINT, kind VARCHAR, aud BOOLEAN)"
GREEDY = f"""ed AS (SELECT ev.c, ev.ts, ev.id, ev.kind, ev.side = 'L' AND coalesce(ev.ts >= ar.a AND ev.ts < ar.z, false) AS aud FROM ev LEFT JOIN ar ON ar.hive = ev.hive),
rn AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY label <> 'event', record) AS n FROM rc),
g AS (SELECT c, CAST(0 AS BIGINT) AS n, CAST(coalesce(pool, []) AS {_EVENT}[]) AS pool, NULL::BIGINT AS record, NULL::BIGINT AS t1, NULL::VARCHAR AS label, NULL::{_EVENT} AS hit FROM (SELECT c FROM rc UNION SELECT c FROM ed) k
    LEFT JOIN (SELECT c, list({{'t0': ts, 'id': id, 'kind': kind, 'aud': aud}} ORDER BY ts, id) AS pool FROM ed GROUP BY c) USING (c)
  UNION ALL SELECT c, n, CASE WHEN best IS NULL THEN pool ELSE list_filter(pool, lambda x: x.id <> best.e.id) END, record, t1, label, best.e FROM
  (SELECT g.c, rn.n, g.pool, rn.record, rn.t1, rn.label, list_sort(list_transform(list_filter(g.pool, lambda x: x.kind IN ('harvest', 'swarm') AND abs(x.t0 - rn.t1) <= 21600), lambda x: {{'d': abs(x.t0 - rn.t1), 'e': x}}))[1] AS best FROM g JOIN rn ON rn.c = g.c AND rn.n = g.n + 1)),
om AS (SELECT c, record, hit.t0 AS detected, hit.kind AS kind, (hit.t0 - t1) / 3600e0 AS off, CASE WHEN label = 'event' THEN CASE WHEN hit IS NULL THEN 'false_negative' ELSE 'true_positive' END ELSE CASE WHEN hit IS NULL THEN 'true_negative' ELSE 'false_positive' END END AS outcome FROM g WHERE n > 0
  UNION ALL SELECT c, NULL, x.t0, x.kind, NULL, CASE WHEN x.aud THEN 'false_positive' ELSE 'unaudited_detection' END FROM (SELECT c, unnest(pool) AS x FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC) = 1)))"""
_CODE = "CASE weather_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in CODES.items()) + " ELSE 'weather code ' || weather_code END"
_SENTENCE = f"""CASE WHEN temperature_f < 32 THEN 'Freezing' WHEN temperature_f < 50 THEN 'Cool' WHEN temperature_f < 70 THEN 'Mild' WHEN temperature_f < 85 THEN 'Warm' WHEN temperature_f IS NOT NULL THEN 'Hot' END || ' and '
  || CASE WHEN humidity_pct < 40 THEN 'dry' WHEN humidity_pct < 65 THEN 'moderately humid' WHEN humidity_pct IS NOT NULL THEN 'humid' END || ' ' || CASE WHEN CAST(left(clock_time, 2) AS INT) < 12 THEN 'morning' WHEN CAST(left(clock_time, 2) AS INT) < 17 THEN 'afternoon' ELSE 'evening' END
  || ' with ' || CASE WHEN cloudiness_pct < 20 THEN 'mostly clear' WHEN cloudiness_pct < 60 THEN 'partly cloudy' WHEN cloudiness_pct IS NOT NULL THEN 'mostly cloudy' END || ' skies and ' || {_CODE} || ' conditions.'"""

SQL = {
    "weather_sentences": _with([WX], f"SELECT obs_id, sentence FROM (SELECT obs_id, {_SENTENCE} AS sentence FROM wx WHERE clock_time IS NOT NULL) WHERE sentence IS NOT NULL"),
    "run_metadata": _with(FEAT, f"SELECT count(*) AS colony_count, count(DISTINCT region_id) AS region_count, CAST(sum(sample_count) AS BIGINT) AS valid_sensor_reading_count, CAST(sum(excluded_reading_count) AS BIGINT) AS excluded_sensor_reading_count, CAST(sum(weight_event_count) AS BIGINT) AS weight_event_count, count(*) FILTER (weight_event_count > 0) AS colonies_with_weight_events, (SELECT {q('min(days_observed)')} FROM fla) AS min_colony_days_observed, (SELECT {q('max(days_observed)')} FROM fla) AS max_colony_days_observed FROM feat"),
    "greedy_match": _with([*STEPS, LAB, GREEDY], f"SELECT c AS colony_id, record, detected, kind, {q('off')} AS offset_hours, outcome FROM om"),
    "readings_projection": _with([R], "SELECT c AS colony_id, id AS reading_id, ts AS ts_epoch, wall, w, t, h FROM r"),
    "rolling_window_filter": _with([R], "SELECT c AS colony_id, id AS reading_id FROM r WHERE wall >= (SELECT max(wall) FROM r) - 7 * 86400"),
    "json_attribute_decode": _with([JSON], "SELECT raw_id, member, value FROM js WHERE value IS NOT NULL"),
    "side_split": _with([JSON], "SELECT raw_id, right(member, 1) AS colony_side, max(value) FILTER (left(member, 1) = 'w') AS w, max(value) FILTER (left(member, 1) = 't') AS t, max(value) FILTER (left(member, 1) = 'h') AS h FROM js WHERE right(member, 1) IN ('L', 'R') GROUP BY ALL HAVING count(value) = 3"),
    "impossible_bounds": _with([R], f"SELECT id AS reading_id, {BAD} AS reasons FROM r WHERE {BAD} <> ''"),
    "external_anomalies": _with([R], f"SELECT id AS reading_id, {OUTER} AS reasons FROM r WHERE {OUTER} <> ''"),
    "adjacent_jump_flags": _with([R, P], f"SELECT * FROM (SELECT id AS reading_id, {jump(('pwall', 'pw', 'pt', 'ph'), ('wall', 'w', 't', 'h'))} AS reasons FROM p) WHERE reasons <> ''"),
    "step_candidates": _with([R, P, CAND], f"SELECT c AS colony_id, ts, wall, {q('pw')} AS before, {q('w')} AS after, {q('delta')} AS delta, {q('pct')} AS pct, {q('elapsed')} AS elapsed FROM cand"),
    "step_classify": _with([R, P, CAND], "SELECT c AS colony_id, kind, count(*) AS n FROM cand GROUP BY ALL"),
    "step_clusters": _with([R, P, CAND, CLUS], "SELECT c AS colony_id, CAST(k AS BIGINT) AS cluster, count(*) AS n, min(wall) AS first_wall, max(wall) AS last_wall FROM clus GROUP BY ALL"),
    "step_cluster_net": _with(STEPS[:5], f"SELECT c AS colony_id, ts, kind, steps, {q('before')} AS before, {q('after')} AS after, {q('delta')} AS delta, {q('pct')} AS pct, {q('elapsed')} AS elapsed FROM net"),
    "step_confirmed": _with(STEPS[:6], f"SELECT c AS colony_id, ts, kind, {q('delta')} AS delta, {q('level')} AS level FROM conf"),
    "step_corroborated": _with(STEPS, "SELECT c AS colony_id, ts, kind, corroborated FROM ev"),
    "window_replay_dedupe": _with(REPLAYED, "SELECT c AS colony_id, wall, kind, first_window FROM seen"),
    "segment_ids": _with([*STEPS, SEG, *segments("valid")], "SELECT id AS reading_id, CAST(segment AS INTEGER) AS segment FROM sg"),
    "short_segment_merge": _with([*STEPS, SEG, *segments("valid")], f"SELECT c AS colony_id, merged, n, wall0, wall1, {q('w0')} AS w0, {q('w1')} AS w1 FROM sl"),
    "segment_slopes": _with([*STEPS, SEG, *segments("valid")], f"SELECT c AS colony_id, merged, {q('slope', 4)} AS slope, {q('slope_pct', 4)} AS slope_pct FROM sl"),
    "segmented_trend": _with([*STEPS, SEG, *segments("valid")], f"SELECT c AS colony_id, segments, {', '.join(q(x, 4) + ' AS ' + x for x in ('delta_kg', 'weight_pct_change', 'weight_slope_kg_per_day', 'weight_slope_pct_per_day'))} FROM tr"),
    "range_settle_semi": _with([*STEPS, SETTLE], "SELECT id AS reading_id FROM settled"),
    "quality_fold": _with([*STEPS, SETTLE, FOLD], f"SELECT id AS reading_id, kept, reasons, note_n, {q('note_kg')} AS note_kg FROM jd"),
    "quality_summary": _with([*STEPS, SETTLE, FOLD, FLAGS], "SELECT c AS colony_id, issues, excluded, issue_days FROM qc"),
    "weather_day_types": _with([WX, DAYS], "SELECT hive_id, observed_date, day_type FROM dt"),
    "weather_aggregates": _with([WX], f"SELECT hive_id, {q('avg(temperature_f)')} AS avg_weather_temp_f, {q('avg(humidity_pct)')} AS avg_weather_humidity_pct, {q(f'coalesce(100 * avg(CASE WHEN weather_code IN ({_RAIN}) THEN 1e0 WHEN weather_code IS NOT NULL THEN 0e0 END), 0)')} AS rainy_weather_reading_pct, {q('100 * avg(CASE WHEN cloudiness_pct >= 70 THEN 1e0 ELSE 0e0 END)')} AS cloudy_weather_reading_pct FROM wx GROUP BY hive_id"),
    "dominant_overview": _with([WX], "SELECT hive_id, overview AS dominant_weather_overview FROM (SELECT hive_id, overview, count(*) AS n, min(obs_id) AS o FROM wx WHERE overview <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY hive_id ORDER BY n DESC, o) = 1"),
    "weather_date_filter": _with([R, WX], "SELECT obs_id FROM wx WHERE observed_date IN (SELECT day FROM r)"),
    "daily_pct_change": _with([R, daily("r", False)], f"SELECT c AS colony_id, CAST(day AS VARCHAR) AS day, n, {q('pct')} AS pct FROM dc"),
    "event_day_antijoin": _with([*STEPS, daily("r", True)], "SELECT c AS colony_id, CAST(day AS VARCHAR) AS day FROM dc"),
    "colony_first_last": _with([R, ends("r")], f"SELECT c AS colony_id, sample_count, start_wall, end_wall, {q('latest')} AS latest_weight_kg, {q('days_observed')} AS days_observed FROM fla"),
    "features_flat": _with(FEAT, "SELECT colony_id, region_id, sample_count, segments, favorable_weather_window_count, poor_weather_window_count, weight_event_count, excluded_reading_count, data_quality_issue_days, " + ", ".join(f"{q(x, 4)} AS {x}" for x in ("latest_weight_kg", "weight_pct_change", "favorable_weather_weight_slope_pct_per_day", "poor_weather_weight_loss_pct", "weight_slope_pct_per_day")) + " FROM feat"),
    "percentiles": _with([*STEPS, SETTLE, NORMAL], f"SELECT channel, q, {q('value')} AS value FROM (SELECT channel, unnest([0.5e0, 0.9e0, 0.99e0, 0.999e0, 1e0]) AS q, unnest(quantile_cont(x, [0.5, 0.9, 0.99, 0.999, 1])) AS value FROM mv GROUP BY channel)"),
    "threshold_rank": _with([*STEPS, SETTLE, NORMAL], f"SELECT channel, count(*) AS pairs, count(*) FILTER (x <= lim) AS below, count(*) FILTER (x > lim * 0.75e0) AS over_075, count(*) FILTER (x > lim) AS over_100, count(*) FILTER (x > lim * 1.25e0) AS over_125, {q('count(*) FILTER (x <= lim) * 100e0 / count(*)')} AS rank_pct FROM mv GROUP BY channel"),
    "peer_stats": _with(CMP, f"SELECT colony_id, metric, n AS peer_count, {q('mu', 4)} AS peer_mean, {q('sd', 4)} AS peer_std FROM cp"),
    "badness_z": _with(CMP, f"SELECT colony_id, metric, {q('z', 4)} AS badness_z FROM cp"),
    "metric_confidence": _with(CMP, f"SELECT colony_id, metric, {q('zb', 4)} AS z_bound, confidence FROM cp"),
    "colony_score": _with(SCORE, "SELECT colony_id, score, CAST(performance_flags AS BIGINT) AS performance_flags, CAST(low_confidence AS BIGINT) AS low_confidence FROM sc"),
    "status": _with(SCORE, "SELECT colony_id, status FROM sc"),
    "reporting_gaps": _with([R, GAPS], f"SELECT colony_id, last_wall, {q('gap')} AS gap_days FROM gp"),
    "silent_placeholders": _with([*SCORE, GAPS], "SELECT sc.colony_id, CASE WHEN gp.colony_id IS NOT NULL THEN 'underperforming' ELSE sc.status END AS status, gp.colony_id IS NOT NULL AS silent, sc.sample_count FROM sc LEFT JOIN gp USING (colony_id) UNION ALL SELECT colony_id, 'underperforming', true, 0 FROM gp WHERE colony_id NOT IN (SELECT colony_id FROM sc)"),
    "region_summary": _with(SCORE, "SELECT region_id, count(DISTINCT hive_id) AS site_count, count(*) AS colony_count, count(*) FILTER (status = 'normal') AS normal_count, count(*) FILTER (status = 'watch') AS watch_count, count(*) FILTER (status = 'underperforming') AS underperforming_count, list(colony_id ORDER BY score, colony_id) FILTER (status = 'normal')[1] AS best_1, list(colony_id ORDER BY score, colony_id) FILTER (status = 'normal')[2] AS best_2 FROM sc GROUP BY region_id"),
    "top_drivers": _with(CMP, "SELECT colony_id, metric, rank FROM (SELECT colony_id, metric, row_number() OVER (PARTITION BY colony_id ORDER BY z DESC, ord) AS rank FROM cp WHERE z > 0) WHERE rank <= 3"),
    "sister_metrics": _with(SIS, f"SELECT hive_id, metric, worse_side, {q('raw_gap', 4)} AS raw_gap, {q('impact', 4)} AS impact FROM sm"),
    "sister_verdict": _with(SISTER, "SELECT hive_id, left_score, right_score, weaker_side, verdict, declining_side FROM sv LEFT JOIN cn USING (hive_id)"),
    "weight_variants": _with(VARY, "SELECT variant, region_id, colony_id, score, rank FROM rs"),
    "kendall_tau": _with([*VARY, "jr AS (SELECT a.*, b.rank AS r0 FROM rs a JOIN rs b ON b.variant = 0 AND b.region_id = a.region_id AND b.colony_id = a.colony_id)", "pw AS (SELECT x.variant, x.region_id, sum(CASE WHEN y.rank > x.rank THEN 1 ELSE -1 END) AS s FROM jr x JOIN jr y ON x.variant = y.variant AND x.region_id = y.region_id AND x.r0 < y.r0 GROUP BY ALL)"], f"SELECT variant, region_id, colonies, max_shift, {q('CASE WHEN colonies < 2 THEN 1 ELSE s * 2e0 / (colonies * (colonies - 1)) END')} AS tau FROM (SELECT variant, region_id, count(*) AS colonies, max(abs(rank - r0)) AS max_shift FROM jr GROUP BY ALL) LEFT JOIN pw USING (variant, region_id)"),
    "haversine_pairs": _with([SITES], "SELECT a AS id_a, b AS id_b FROM prs WHERE a < b"),
    "components": _with([SITES], "SELECT hive_id, region_id FROM rg"),
    "nearest_region": _with([SITES], f"SELECT component, nearest, {q('miles', 4)} AS miles FROM (SELECT ra.region_id AS component, rb.region_id AS nearest, {MILES} AS miles FROM st a JOIN rg ra ON ra.hive_id = a.hive_id JOIN st b ON true JOIN rg rb ON rb.hive_id = b.hive_id WHERE ra.region_id <> rb.region_id AND ra.region_id IN (SELECT region_id FROM rg GROUP BY 1 HAVING count(*) < 2) QUALIFY row_number() OVER (PARTITION BY ra.region_id ORDER BY miles, rb.region_id) = 1)"),
    "audited_ranges": _with([*STEPS, LAB], "SELECT ev.c AS colony_id, ev.ts, ev.side = 'L' AND coalesce(ev.ts >= ar.a AND ev.ts < ar.z, false) AS audited FROM ev LEFT JOIN ar ON ar.hive = ev.hive"),
    "precision_recall": _with([*REPLAYED, *[x for x in (R.replace("r AS", "r2 AS", 1),)], *(s.replace("JOIN r ON", "JOIN r2 r ON").replace("FROM r WINDOW", "FROM r2 WINDOW").replace("p AS MAT", "p2 AS MAT").replace("FROM p WHERE", "FROM p2 WHERE").replace("cand AS", "cand2 AS").replace("FROM cand)", "FROM cand2)").replace("clus AS", "clus2 AS").replace("FROM clus GROUP", "FROM clus2 GROUP").replace("grp AS", "grp2 AS").replace("FROM grp)", "FROM grp2)").replace("net AS", "net2 AS").replace("FROM net n", "FROM net2 n").replace("conf AS", "conf2 AS") for s in STEPS[1:6])], f"""SELECT tp AS true_positive, fn AS false_negative, fp AS false_positive, {q('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END')} AS precision, {q('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END')} AS recall,
  {q('CASE WHEN tp > 0 THEN 2e0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) WHEN fp + fn = 0 THEN 1 ELSE 0 END')} AS f1
  FROM (SELECT count(*) FILTER (a.c IS NOT NULL AND s.c IS NOT NULL) AS tp, count(*) FILTER (s.c IS NULL) AS fn, count(*) FILTER (a.c IS NULL) AS fp FROM (SELECT DISTINCT c, wall FROM conf2) a FULL JOIN seen s ON s.c = a.c AND s.wall = a.wall)"""),
}
