import random
from datetime import date, timedelta

from combline.operators.grid import regular_grid
from combline.operators.rolling import trailing_totals
from combline.operators.standing import standing


def grid(spark, rows, max_gap=4, block=6):
    df = spark.createDataFrame(rows, "k string, s string, t long, v double, id long").selectExpr("*", "'x' as status", "1 as slot_epoch", "2 as _block")
    got = regular_grid(df, ["k", "s"], "t", "v", "id", 3600, max_gap, block).collect()
    return sorted((r.k, r.s, r.slot_epoch // 3600, r.v, r.status, r.gap_slots) for r in got)


def plain_grid(rows, max_gap):
    out = []
    for key in sorted({(r[0], r[1]) for r in rows if None not in r[:4]}):
        slots = {}
        for k, s, t, v, i in sorted((r for r in rows if r[:2] == key and None not in r[:4]), key=lambda r: (r[2], r[4])):
            slots[t // 3600] = v
        taken = sorted(slots)
        for a, b in zip(taken, [*taken[1:], None]):
            out.append((*key, a, slots[a], "observed", 0))
            gap = b - a - 1 if b is not None else 0
            for x in range(a + 1, a + 1 + gap):
                out.append((*key, x, slots[a] if gap <= max_gap else None, "filled" if gap <= max_gap else "missing", gap))
    return sorted(out, key=lambda r: r[:3])


def test_grid_against_one_after_another(spark):
    rng = random.Random(1)
    rows = [(rng.choice("AB"), rng.choice("LR"), rng.randint(-40, 400) * 1800, rng.choice([None, 1.0, 2.5, 3.25]), i) for i in range(160)]
    rows += [("A", "L", None, 1.0, 900), (None, "L", 5, 1.0, 901), rows[0], rows[1]]
    assert sorted(grid(spark, rows), key=lambda r: r[:3]) == plain_grid(rows, 4)
    assert grid(spark, [("A", "L", 5, None, 1)]) == [] and grid(spark, [("A", "L", 0, 7.0, 1)]) == [("A", "L", 0, 7.0, "observed", 0)]
    # a silence over many blocks, at the limit and one beyond it
    assert {r[4] for r in grid(spark, [("A", "L", 0, 7.0, 1), ("A", "L", 5 * 3600, 8.0, 2)])} == {"observed", "filled"}
    assert {r[4] for r in grid(spark, [("A", "L", 0, 7.0, 1), ("A", "L", 60 * 3600, 8.0, 2)])} == {"observed", "missing"}


def test_trailing_totals_against_brute_force(spark):
    rng = random.Random(2)
    start = date(2024, 1, 1)
    rows = [(rng.choice(["A", "B"]), start + timedelta(rng.choice([rng.randint(0, 40), rng.randint(100, 140)])), rng.choice([None, float(rng.randint(0, 50))])) for _ in range(120)]
    rows += [(None, start, 1.0), ("A", None, 1.0), rows[0]]
    df = spark.createDataFrame(rows, "k string, d date, v double").selectExpr("*", "1 as total_3", "2 as _d")
    got = {(r.k, r.day): (r.total_3, r.count_3, r.total_5, r.count_5) for r in trailing_totals(df, ["k"], "d", "v", (3, 5)).collect()}
    want = {}
    for k in "AB":
        own = [(d, v) for kk, d, v in rows if kk == k and d is not None and v is not None]
        day, end = min(d for d, _ in own), max(d for d, _ in own) + timedelta(2)
        while day <= end:
            cells = []
            for n in (3, 5):
                vs = [v for d, v in own if 0 <= (day - d).days < n]
                cells += [sum(vs), len(vs)]
            want[k, day] = tuple(cells)
            day += timedelta(1)
    assert got == want
    assert trailing_totals(df.limit(0), ["k"], "d", "v").collect() == []


def test_standing(spark):
    df = spark.createDataFrame([("A", 1, 5, "x"), ("A", 1, 3, None), ("A", 2, 9, "z"), (None, 1, 1, "n"), ("A", 2, 9, "z")], "k string, t long, id long, c string")
    assert sorted((r.k, r.t, r.id, r.c) for r in standing(df, ["k", "t"], "id", ["c"]).collect()) == [("A", 1, 3, None), ("A", 2, 9, "z")]
