import random
from collections import Counter

import numpy as np
import pytest

from combline.functions.geo import haversine_miles_np
from combline.operators import outliers
from combline.operators.outliers import implausible, spike_starts
from combline.operators.spatial import near_counts, near_pairs, split_leaves

FIELDS = {"w": (0.0, 100.0), "t": (0.0, 50.0)}


def find(spark, rows):
    df = spark.createDataFrame(rows, "k string, s string, ts long, id long, w double, t double").selectExpr("*", "'x' as field_name", "1 as _block", "2 as kind")
    return sorted((r.id, r.field_name, r.reason) for r in implausible(df, ("k", "s"), "ts", "id", FIELDS).collect())


def series(values, k="A", s="L", start=0, id0=0, step=600):
    return [(k, s, start + i * step, id0 + i, v, 20.0 + (i % 7) * 0.1) for i, v in enumerate(values)]


def walk(n, seed=1, base=40.0):
    rng = random.Random(seed)
    return [round(base + 0.01 * i + rng.uniform(-0.05, 0.05), 3) for i in range(n)]


def test_the_three_kinds(spark):
    v = walk(300)
    v[50] = -3.0
    v[100] = v[101] = v[99] + 9
    v[200:210] = [41.5] * 10
    v[250:] = [x + 8 for x in v[250:]]  # a change that stays
    got = find(spark, series(v))
    assert {(i, r) for i, f, r in got if f == "w"} == {(50, "impossible"), (50, "spike"), (100, "spike"), (101, "spike"), *((i, "frozen") for i in range(200, 210))}


def test_frozen_run_over_blocks_nulls_and_silences(spark):
    step = outliers.BLOCK_S // 5
    v = [30.0] * 12
    rows = series(v, start=outliers.BLOCK_S - 5 * 3600, step=3600)
    rows[4] = (*rows[4][:4], None, 20.0)
    got = {i for i, f, r in find(spark, rows) if f == "w" and r == "frozen"}
    assert got == set(range(12)) - {4}
    assert not [1 for i, f, r in find(spark, series([30.0] * 12, step=step)) if r == "frozen" and f == "w"]


def test_nulls_and_empty_tables(spark):
    rows = [("A", "L", 1, 1, None, None), (None, "L", 1, 2, -5.0, 1.0), ("A", None, 1, 3, -5.0, 1.0), ("A", "L", None, 4, -5.0, 1.0), ("A", "L", 5, None, -5.0, 1.0), ("A", "L", 9, 6, float("nan"), 99.0)]
    assert find(spark, rows) == [(6, "t", "impossible")]
    assert find(spark, []) == []


def test_candidates_lose_nothing(spark):
    rng = np.random.default_rng(3)
    v = 40 + np.cumsum(rng.normal(0, 0.05, 4000))
    for k in rng.integers(10, 3990, 60):
        v[k : k + rng.integers(1, 4)] += rng.choice([-1, 1]) * rng.uniform(0.5, 9)
    t, g = np.arange(4000) * 1800, np.zeros(4000, int)
    wide = spike_starts(v, t, g, times=-1.0)
    sieve = spike_starts(v, t, g)
    limit = 10 * np.median(np.abs(np.diff(v)))
    for (n, a, x), (m, b, y) in zip(wide, sieve):
        assert n == m and set(a[x > limit]) == set(b[y > limit])


def brute(sites, miles):
    ok = [(i, y, x) for i, y, x in dict.fromkeys(sites) if i is not None and None not in (y, x) and y == y and abs(y) <= 90 and abs(x) <= 180]
    return {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and haversine_miles_np(a[1], a[2], b[1], b[2]) <= miles}


@pytest.mark.parametrize("sample", [20, 20_000])
def test_pairs_against_brute_force(spark, sample):
    rng = random.Random(4)
    sites = [(f"s{i:04d}", round(35 + rng.gauss(0, 0.2), 4), round(-82 + rng.gauss(0, 0.2), 4)) for i in range(400)]
    sites += [(f"d{i}", 0.0, x) for i, x in enumerate((179.99, -179.99, 180.0, -180.0))] + [(f"p{i}", 89.999, x) for i, x in enumerate((0.0, 90.0, 180.0))]
    sites += [("e1", 35.0, -82.0), ("e2", 35.0, -82.0), ("e3", 35.0, -82.0), ("e1", 35.0, -82.0), ("n1", None, 1.0), ("n2", 91.0, 1.0), (None, 35.0, -82.0), ("n3", float("nan"), 0.0)]
    df = spark.createDataFrame(sites, "site string, y double, x double").selectExpr("*", "1 as leaf", "2 as rep")
    for miles in (1.0, 30.0):
        got = [(r.id_a, r.id_b) for r in near_pairs(df, "site", "y", "x", miles, leaf_rows=20, tile_rows=50, sample_rows=sample).collect()]
        want = brute(sites, miles)
        assert len(got) == len(set(got)) and set(got) == want
        links = {r.site: (r.class_id, r.links) for r in near_counts(df, "site", "y", "x", miles, leaf_rows=20, tile_rows=50, sample_rows=sample).collect()}
        count = Counter(s for p in want for s in p)
        assert {s: n for s, (_, n) in links.items()} == {s: count[s] for s in links} and links["e3"][0] == "e1"
    assert near_pairs(df.limit(0), "site", "y", "x", 1.0).collect() == near_counts(df.limit(0), "site", "y", "x", 1.0).collect() == []


def test_leaves_split_down_to_the_least_size():
    starts, boxes = np.array([0]), np.array([[-180.0, -90.0, 180.0, 90.0]])
    for _ in range(3):
        starts, boxes, cut = split_leaves(starts, boxes, set(range(len(starts))), 40.0)
    assert (len(starts), cut) == (16, 0) and (np.diff(starts) > 0).all() and boxes[:, 0].min() == -180 and boxes[:, 3].max() == 90
