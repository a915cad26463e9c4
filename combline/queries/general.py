"""Queries over the general data-preparation operators (problems 1, 4, 5, 6, 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from combline.operators.grid import FILLED, regular_grid
from combline.operators.instants import normalise_instants, stamp_rows
from combline.operators.outliers import implausible
from combline.operators.rolling import trailing_totals
from combline.operators.spatial import near_counts, near_pairs
from combline.operators.standing import standing
from combline.session import shared_dir


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


COLONY = ["hive_id", "colony_side"]


def standing_readings(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    return standing(_table(spark, d, "sensor_readings"), [*COLONY, "ts_epoch"], "reading_id", keep)


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(standing_readings(spark, d, ["weight_kg"]), COLONY, "ts_epoch", "weight_kg", "reading_id", 3600, 336)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_grid(spark, d).where(F.col("status") == FILLED).select(*COLONY, "slot_epoch")


def p7_trailing(spark: SparkSession, d: str) -> DataFrame:
    rows = standing_readings(spark, d, ["weight_kg", "observed_at"]).where(F.col("weight_kg").between(0.45, 136.08))
    return trailing_totals(rows, COLONY, "observed_at", "weight_kg", (7, 30))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    low = (F.col("count_7") > 0) & (F.col("avg_7") < 0.96 * F.col("avg_30"))
    return p7_trailing(spark, d).where(low).select(*COLONY, F.date_format("day", "yyyy-MM-dd").alias("obs_day"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = stamp_rows(_table(spark, d, "sensor_raw"), "raw_id", "ts_raw", "sensor").unionByName(
        stamp_rows(_table(spark, d, "weather_raw"), "wraw_id", "clock_time", "weather", day="observed_date")
    )
    return normalise_instants(rows, f"{shared_dir(spark)}/combline-stamps-1").select(F.col("source").alias("raw_table"), "row_id", "epoch_s")


#: What the three measures can be.
BOUNDS = {"weight_kg": (0.45, 136.08), "internal_temp_f": (32.0, 120.0), "internal_humidity_pct": (0.0, 100.0)}


def p5_implausible(spark: SparkSession, d: str) -> DataFrame:
    return implausible(standing_readings(spark, d, list(BOUNDS)), ("hive_id", "colony_side"), "ts_epoch", "reading_id", BOUNDS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_implausible(spark, d).select("reading_id", "field_name").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_pairs(_table(spark, d, "hive_sites"), "hive_id", "latitude", "longitude", 1.0)
    return pairs.select(F.col("id_a").alias("hive_id_a"), F.col("id_b").alias("hive_id_b"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_counts(_table(spark, d, "hive_sites"), "hive_id", "latitude", "longitude", 1.0)


_STANDING = """standing AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hive_id, colony_side, ts_epoch ORDER BY reading_id) AS nth FROM sensor_readings
                 WHERE hive_id IS NOT NULL AND colony_side IS NOT NULL AND ts_epoch IS NOT NULL AND reading_id IS NOT NULL) WHERE nth = 1)"""

_P1 = f"""WITH {_STANDING},
slots AS (SELECT DISTINCT hive_id, colony_side, ts_epoch // 3600 AS slot FROM standing WHERE weight_kg IS NOT NULL),
gaps AS (SELECT *, lead(slot) OVER (PARTITION BY hive_id, colony_side ORDER BY slot) AS after FROM slots)
SELECT hive_id, colony_side, unnest(range(slot + 1, after)) * 3600 AS slot_epoch FROM gaps WHERE after - slot - 1 BETWEEN 1 AND 336"""

_P7 = f"""WITH {_STANDING},
daily AS (SELECT hive_id, colony_side, CAST(observed_at AS DATE) AS day, sum(weight_kg) AS s, count(*) AS n FROM standing
          WHERE weight_kg BETWEEN 0.45 AND 136.08 GROUP BY ALL),
days AS (SELECT hive_id, colony_side, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS day
         FROM daily GROUP BY hive_id, colony_side),
dense AS (SELECT hive_id, colony_side, day, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM days LEFT JOIN daily USING (hive_id, colony_side, day)),
rolled AS (SELECT *, sum(s) OVER week AS s7, sum(n) OVER week AS n7, sum(s) OVER month AS s30, sum(n) OVER month AS n30 FROM dense
  WINDOW week AS (PARTITION BY hive_id, colony_side ORDER BY day ROWS 6 PRECEDING), month AS (PARTITION BY hive_id, colony_side ORDER BY day ROWS 29 PRECEDING))
SELECT hive_id, colony_side, strftime(day, '%Y-%m-%d') AS obs_day FROM rolled WHERE n7 > 0 AND s7 / n7 < 0.96 * (s30 / n30)"""

_P6 = """WITH sites AS (SELECT DISTINCT hive_id, latitude AS y, longitude AS x FROM hive_sites
  WHERE hive_id IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)
SELECT a.hive_id AS hive_id_a, b.hive_id AS hive_id_b FROM sites a JOIN sites b ON a.hive_id < b.hive_id
  AND abs(a.y - b.y) < 0.02
  AND 2 * 3958.7613 * asin(sqrt(least(1.0, pow(sin(radians(b.y - a.y) / 2), 2)
        + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) <= 1.0"""

_P6_CLASSES = f"""WITH pairs AS ({_P6}), ends AS (SELECT hive_id_a AS a FROM pairs UNION ALL SELECT hive_id_b FROM pairs),
sites AS (SELECT DISTINCT hive_id AS site, latitude AS y, longitude AS x FROM hive_sites WHERE hive_id IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)
SELECT site, min(site) OVER (PARTITION BY x, y) AS class_id, (SELECT count(*) FROM ends WHERE a = site) AS links FROM sites"""

# levels: medians of up to five readings within six hours before and after a stretch of one to three readings
_P5 = f"""WITH {_STANDING},
long AS (SELECT hive_id, colony_side, ts_epoch AS t, reading_id AS id, unnest(['weight_kg', 'internal_temp_f', 'internal_humidity_pct']) AS field_name,
                unnest([weight_kg, internal_temp_f, internal_humidity_pct]) AS v FROM standing),
vals AS (SELECT * FROM long WHERE v IS NOT NULL),
runs0 AS (SELECT *, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM vals WINDOW w AS (PARTITION BY hive_id, colony_side, field_name ORDER BY t)),
runs1 AS (SELECT *, sum(CASE WHEN v = pv AND t - pt <= 172800 THEN 0 ELSE 1 END) OVER (PARTITION BY hive_id, colony_side, field_name ORDER BY t) AS run,
                 CASE WHEN t - pt <= 172800 THEN round(abs(v - pv), 6) END AS step FROM runs0),
frozen AS (SELECT id, field_name FROM runs1 QUALIFY count(*) OVER (PARTITION BY hive_id, colony_side, field_name, run) >= 8),
bounds AS (SELECT id, field_name FROM vals WHERE CASE field_name WHEN 'weight_kg' THEN v NOT BETWEEN 0.45 AND 136.08
                  WHEN 'internal_temp_f' THEN v NOT BETWEEN 32 AND 120 ELSE v NOT BETWEEN 0 AND 100 END),
typical AS (SELECT hive_id, colony_side, field_name, median(step) AS mac FROM runs1 GROUP BY ALL),
near AS (SELECT hive_id, colony_side, field_name, t, id, v,
   [lag(CASE WHEN true THEN {{'t': t, 'v': v}} END, 5) OVER w, lag({{'t': t, 'v': v}}, 4) OVER w, lag({{'t': t, 'v': v}}, 3) OVER w, lag({{'t': t, 'v': v}}, 2) OVER w, lag({{'t': t, 'v': v}}, 1) OVER w] AS b,
   [lead({{'t': t, 'v': v}}, 1) OVER w, lead({{'t': t, 'v': v}}, 2) OVER w, lead({{'t': t, 'v': v}}, 3) OVER w, lead({{'t': t, 'v': v}}, 4) OVER w, lead({{'t': t, 'v': v}}, 5) OVER w] AS a
   FROM vals WINDOW w AS (PARTITION BY hive_id, colony_side, field_name ORDER BY t)),
levels AS (SELECT *, list_median(list_transform(list_filter(b, lambda x: x IS NOT NULL AND t - x.t <= 21600), lambda x: x.v)) AS lb,
                  list_median(list_transform(list_filter(a, lambda x: x IS NOT NULL AND x.t - t <= 21600), lambda x: x.v)) AS la FROM near),
ahead AS (SELECT *, lead(la, 1) OVER w AS la1, lead(la, 2) OVER w AS la2 FROM levels WINDOW w AS (PARTITION BY hive_id, colony_side, field_name ORDER BY t)),
cases AS (
  SELECT hive_id, colony_side, field_name, [id] AS ids, t AS t0, t AS t1, v AS lo, v AS hi, lb, la, b[5].v AS l, a[1].v AS r, [t] AS ts FROM ahead
  UNION ALL SELECT hive_id, colony_side, field_name, [id], t, a[1].t, least(v, a[1].v), greatest(v, a[1].v), lb, la1, b[5].v, a[2].v, [t, a[1].t] FROM ahead WHERE a[1] IS NOT NULL
  UNION ALL SELECT hive_id, colony_side, field_name, [id], t, a[2].t, least(v, a[1].v, a[2].v), greatest(v, a[1].v, a[2].v), lb, la2, b[5].v, a[3].v, [t, a[1].t, a[2].t] FROM ahead WHERE a[2] IS NOT NULL),
offs AS (SELECT *, greatest(lo - greatest(la, lb), least(la, lb) - hi) AS off FROM cases WHERE la IS NOT NULL AND lb IS NOT NULL AND t1 - t0 <= 21600),
hits AS (SELECT hive_id, colony_side, o.field_name, unnest(ts) AS t FROM offs o JOIN typical USING (hive_id, colony_side, field_name)
  WHERE off > 0 AND off > 10 * mac AND abs(la - lb) <= off / 2 AND abs(l - lb) <= off / 2 AND abs(r - la) <= off / 2),
spikes AS (SELECT v.id, v.field_name FROM vals v SEMI JOIN hits h ON v.hive_id = h.hive_id AND v.colony_side = h.colony_side AND v.field_name = h.field_name AND v.t = h.t)
SELECT id AS reading_id, field_name FROM (SELECT * FROM bounds UNION SELECT * FROM frozen UNION SELECT * FROM spikes)"""

# one expression per notation; a local time must lead to one instant and back
_ZONE = r"(z|utc|gmt|[ecmp][sd]t|[+-]\d{2}:?\d{2}|[+-]\d{2}|\[?america/new_york\]?)?"
_P4 = rf"""WITH raws AS (SELECT 'sensor' AS raw_table, raw_id AS row_id, NULL::DATE AS day, ts_raw AS txt FROM sensor_raw UNION ALL SELECT 'weather', wraw_id, observed_date, clock_time FROM weather_raw WHERE observed_date IS NOT NULL),
t AS (SELECT raw_table, row_id, day, lower(regexp_replace(regexp_replace(txt, '^[\s"''\x{{a0}}]+', ''), '[\s"''.\x{{a0}}]+$', '')) AS t FROM raws WHERE txt IS NOT NULL AND row_id IS NOT NULL),
num AS (SELECT raw_table, row_id, coalesce(try_cast(t AS DECIMAL(38, 9)), try_cast(try_cast(t AS DOUBLE) AS DECIMAL(38, 9))) AS v FROM t WHERE day IS NULL AND regexp_full_match(t, '[+]?\d+([.]\d*)?(e[+-]?\d+)?')),
numbers AS (SELECT raw_table, row_id, CAST(floor(v / u) AS BIGINT) AS epoch_s FROM num CROSS JOIN (VALUES (1), (1000), (1000000), (1000000000)) x(u) WHERE v >= 946684800::DECIMAL(38, 9) * u AND v < 2082758400::DECIMAL(38, 9) * u),
dated AS (SELECT raw_table, row_id, day, t, CASE WHEN day IS NOT NULL THEN [CAST(year(day) AS VARCHAR), CAST(month(day) AS VARCHAR), CAST(day(day) AS VARCHAR), regexp_replace(t, '^t', '')]
    WHEN regexp_full_match(t, '\d{{4}}-\d{{1,2}}-\d{{1,2}}[t\s]\s*.+') THEN regexp_extract_all(t, '^(\d{{4}})', 1) || regexp_extract_all(t, '^\d{{4}}-(\d+)', 1) || regexp_extract_all(t, '^\d{{4}}-\d+-(\d+)', 1) || regexp_extract_all(t, '^\d{{4}}-\d+-\d+[t\s]\s*(.+)$', 1)
    WHEN regexp_full_match(t, '\d{{8}}[t\s]\s*\d{{4,6}}.*') THEN [t[1:4], t[5:6], t[7:8], regexp_replace(regexp_extract(t, '^\d{{8}}[t\s]\s*(.+)$', 1), '^(\d\d)(\d\d)', '\1:\2')]
    WHEN regexp_full_match(t, '\d{{1,2}}/\d{{1,2}}/\d{{4}},?\s.+') THEN [regexp_extract(t, '/(\d{{4}})', 1), regexp_extract(t, '^(\d+)', 1), regexp_extract(t, '^\d+/(\d+)', 1), regexp_extract(t, '/\d{{4}},?\s+(.+)$', 1)]
    WHEN regexp_full_match(t, '\d{{1,2}}[.]\d{{1,2}}[.]\d{{4}},?\s.+') THEN [regexp_extract(t, '[.](\d{{4}})', 1), regexp_extract(t, '^\d+[.](\d+)', 1), regexp_extract(t, '^(\d+)', 1), regexp_extract(t, '[.]\d{{4}},?\s+(.+)$', 1)]
    WHEN regexp_full_match(t, '(?:[a-z]{{3,9}},?\s+)?[a-z]{{3,9}}[.]?\s+\d{{1,2}},?\s+\d{{4}},?\s.+') THEN [regexp_extract(t, '\s(\d{{4}})', 1), CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', regexp_extract(t, '([a-z]{{3}})[a-z]*[.]?\s+\d', 1)) + 2) // 3 AS VARCHAR), regexp_extract(t, '[a-z.]\s+(\d+)', 1), regexp_extract(t, '\s\d{{4}},?\s+(.+)$', 1)]
    WHEN regexp_full_match(t, '(?:[a-z]{{3,9}},?\s+)?\d{{1,2}}\s+[a-z]{{3,9}}[.]?,?\s+\d{{4}},?\s.+') THEN [regexp_extract(t, '\s(\d{{4}})', 1), CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', regexp_extract(t, '\d\s+([a-z]{{3}})', 1)) + 2) // 3 AS VARCHAR), regexp_extract(t, '(\d{{1,2}})\s+[a-z]', 1), regexp_extract(t, '\s\d{{4}},?\s+(.+)$', 1)] END AS p FROM t),
clock AS (SELECT raw_table, row_id, p, CASE
    WHEN regexp_full_match(p[4], '\d{{1,2}}[:.h]\d{{2}}(:?\d{{2}}([.,]\d+)?)?\s*([ap][.]?m[.]?|uhr)?\s*{_ZONE}') THEN [regexp_extract(p[4], '^(\d+)', 1), regexp_extract(p[4], '^\d+.(\d\d)', 1), coalesce(nullif(regexp_extract(p[4], '^\d+[:.h]\d\d:?(\d\d)', 1), ''), '0')]
    WHEN regexp_full_match(p[4], '\d{{1,2}}\s*[ap][.]?m[.]?\s*{_ZONE}') THEN [regexp_extract(p[4], '^(\d+)', 1), '0', '0']
    WHEN day IS NOT NULL AND regexp_full_match(p[4], '\d{{4}}\s*{_ZONE}') THEN [p[4][1:2], p[4][3:4], '0'] END AS c,
    regexp_extract(p[4], '\d\s*([ap])[.]?m(?:[^a-z]|$)', 1) AS half, regexp_extract(p[4], '{_ZONE}$', 1) AS zone FROM dated WHERE p IS NOT NULL),
walls AS (SELECT raw_table, row_id, zone, CASE WHEN CAST(c[1] AS INT) <= 23 AND (half = '' OR CAST(c[1] AS INT) BETWEEN 1 AND 12) THEN
    try_cast(p[1] || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[3], 2, '0') || ' ' || lpad(CAST(CASE half WHEN '' THEN CAST(c[1] AS INT) WHEN 'a' THEN CAST(c[1] AS INT) % 12 ELSE CAST(c[1] AS INT) % 12 + 12 END AS VARCHAR), 2, '0') || ':' || c[2] || ':' || lpad(c[3], 2, '0') AS TIMESTAMP) END AS w FROM clock WHERE c IS NOT NULL),
local AS (SELECT *, timezone('America/New_York', w) AS z FROM walls WHERE w IS NOT NULL AND (zone = '' OR zone LIKE '%/%')),
found AS (SELECT * FROM numbers
  UNION ALL SELECT raw_table, row_id, CAST(epoch(z) AS BIGINT) FROM local WHERE timezone('America/New_York', z) = w AND timezone('America/New_York', z - INTERVAL 1 HOUR) <> w AND timezone('America/New_York', z + INTERVAL 1 HOUR) <> w
  UNION ALL SELECT raw_table, row_id, CAST(epoch(w) AS BIGINT) - CASE WHEN zone IN ('z', 'utc', 'gmt') THEN 0 WHEN length(zone) = 3 AND zone LIKE '%t' THEN (CASE zone WHEN 'est' THEN -5 WHEN 'cst' THEN -6 WHEN 'mst' THEN -7 ELSE -8 END) * 3600
      WHEN zone LIKE '%t' THEN 0 ELSE (CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END) * (CAST(zone[2:3] AS INT) * 3600 + CAST(coalesce(nullif(right(regexp_replace(zone, '[^0-9]', '', 'g')[3:], 2), ''), '0') AS INT) * 60) END
    FROM walls WHERE w IS NOT NULL AND zone <> '' AND zone NOT LIKE '%/%' AND zone NOT LIKE '_dt'
  UNION ALL SELECT raw_table, row_id, CAST(epoch(w) AS BIGINT) - (CASE zone WHEN 'edt' THEN -4 WHEN 'cdt' THEN -5 WHEN 'mdt' THEN -6 ELSE -7 END) * 3600 FROM walls WHERE w IS NOT NULL AND zone LIKE '_dt')
SELECT raw_table, row_id, epoch_s FROM found WHERE epoch_s >= 946684800 AND epoch_s < 2082758400"""

QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_classes": p6_classes, "p7_found": p7_found}
SQL = {"p1_found": _P1, "p4_found": _P4, "p5_found": _P5, "p6_found": _P6, "p6_classes": _P6_CLASSES, "p7_found": _P7}
