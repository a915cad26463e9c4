import random

from pyspark.sql import functions as F

from combline.llm.nearest import match_nearest
from combline.llm.runs import between, collapse_runs, one_letter, related, truly_different, with_said

H = 3600


def runs(spark, rows, gap=48 * H):
    df = with_said(spark.createDataFrame(rows, "e string, t long, i long, x string"), "x").selectExpr("*", "1 as n", "2 as first_id")
    got = collapse_runs(df, "e", "t", "i", "says", gap, compare=related, settle=truly_different).collect()
    return sorted((r.e, r.first_id, r.last_id, r.n, r.duration_s) for r in got)


def texts(spark, *xs):
    return [(r.first_id, r.last_id) for r in sorted((x for x in _rows(spark, xs)), key=lambda r: r.first_id)]


def _rows(spark, xs):
    df = with_said(spark.createDataFrame([("A", k * H, k, x) for k, x in enumerate(xs)], "e string, t long, i long, x string"), "x")
    return collapse_runs(df, "e", "t", "i", "says", 48 * H, compare=related, settle=truly_different).collect()


def test_what_does_not_count(spark):
    same = ["Warm and humid morning with clear skies.", "warm & humid  AFTERNOON w/ clear skies", "Warm_and_humid_evening_with_clear_skies!", "Warm n humid mornimg with clear skies", "Warm + humid night w clear skies"]
    assert texts(spark, *same) == [(0, 4)]


def test_one_letter_in_each_text(spark):
    assert texts(spark, "warm wind", "worm wind", "warm wynd", "warm wind") == [(0, 3)]
    # two letters in one text are no slip
    assert texts(spark, "warm wind", "worm wend") == [(0, 0), (1, 1)]
    # swapped neighbours are one slip
    assert texts(spark, "clear skies", "claer skies", "clear sikes") == [(0, 2)]
    assert texts(spark, "weather code 4", "weather code 3") == [(0, 0), (1, 1)]
    assert texts(spark, "cool and dry", "mild and dry", None, "mild and dry", " ", "mild and dry") == [(0, 0), (1, 1), (3, 3), (5, 5)]


def test_a_run_depends_on_its_entity_only(spark):
    rows = [("A", 0, 1, "worm wind"), ("A", H, 2, "warm wynd"), *(("B", k * H, 10 + k, "warm wind") for k in range(50))]
    assert [r[:3] for r in runs(spark, rows) if r[0] == "A"] == [("A", 1, 1), ("A", 2, 2)]
    assert [r[:3] for r in runs(spark, [*rows, ("A", 500 * H, 3, "warm wind")]) if r[0] == "A"] == [("A", 1, 2), ("A", 3, 3)]


def test_against_one_after_another(spark):
    rng = random.Random(6)
    day = 86_400
    rows = [(rng.choice("AAAB"), rng.randint(0, 400 * day), i, rng.choice(["cool fog", "hot sun", "hot sun", None, ""])) for i in range(1_500)]
    want = []
    for e in "AB":
        prev = None
        for _, t, i, x in sorted((r for r in rows if r[0] == e), key=lambda r: (r[1], r[2])):
            if x and prev and prev[3] == x and t - prev[1] <= 48 * H:
                want[-1][2:5] = [i, want[-1][3] + 1, t - want[-1][5]]
            elif x:
                want.append([e, i, i, 1, 0, t])
            prev = (e, t, i, x)
    assert runs(spark, rows) == sorted(tuple(w[:5]) for w in want)
    assert runs(spark, [(None, 1, 1, "x"), ("A", None, 2, "x"), ("A", 1, None, "x")]) == []


def test_between_holds_every_text_between():
    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choice("abc") for _ in range(6))
        slip = lambda s: (lambda k, o: [s[:k] + s[k + 1 :], s[:k] + rng.choice("abc") + s[k:], s[:k] + rng.choice("abc") + s[k + 1 :]][o])(rng.randrange(len(s)), rng.randrange(3))
        a, b = slip(t), slip(t)
        assert one_letter(a, t) and one_letter(b, t)
        if not one_letter(a, b):
            assert t in between(a, b)


def test_nearest(spark):
    left = spark.createDataFrame([(1, "A", 1000), (2, "A", 5000), (3, None, 1000), (4, "A", None), (1, "A", 1000), (5, "C", 0)], "lid long, e string, t long").withColumn("gap_s", F.lit("x"))
    right = spark.createDataFrame([(10, "A", "L", 900), (11, "A", "L", 1100), (12, "A", "L", 900), (13, "A", "R", 1301), (14, "A", "R", 700), (15, "A", None, 1000), (16, "B", "L", 1000)], "rid long, e string, side string, t2 long")
    got = sorted((r.lid, r.side or "", r.rid, r.gap_s) for r in match_nearest(left, right, "e", "lid", "t", "rid", "t2", ["side"], 300).collect())
    assert got == [(1, "", 15, 0), (1, "L", 10, 100), (1, "R", 14, 300)]
    assert match_nearest(left.limit(0), right, "e", "lid", "t", "rid", "t2", ["side"], 300).collect() == []


def test_wall_times_do_not_look_at_the_session_zone(spark):
    from combline.llm.queries import _instant, _wall

    df = spark.createDataFrame([("2026-07-01", "19:00"), ("2026-01-01", "07:00"), ("2026-01-01", "7 pm"), ("2026-01-01", None)], "observed_date string, clock_time string").withColumn("observed_date", F.col("observed_date").cast("date"))
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = []
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got.append([r.x for r in df.select(_instant(_wall()).alias("x")).collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert got[0] == got[1] == got[2] == [1782946800, 1767268800, None, None]
