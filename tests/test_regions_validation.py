import random

import numpy as np
import pytest
from helpers import frame, readings

from combline.config import Thresholds
from combline.operators import regions, steps, validation
from combline.operators.quantiles import quantiles
from combline.operators.spatial import near_pairs

CFG = Thresholds(env={})
SITES = [("DR_WLKS", 36.247479, -81.90097), ("6LR", 36.212598, -81.679678), ("PRT_1", 36.203096, -81.625792), ("WTG_HSCHL", 36.214155, -81.649756)]


def labelled(spark, sites, miles):
    s = spark.createDataFrame(sites, "hive_id string, latitude double, longitude double")
    return s, regions.components(s, near_pairs(s, "hive_id", "latitude", "longitude", miles), "hive_id")


def test_components_and_merging(spark):
    s, c = labelled(spark, SITES, 10.0)
    comp = {r.hive_id: r.component for r in c.collect()}
    assert comp == {"DR_WLKS": "DR_WLKS", "6LR": "6LR", "PRT_1": "6LR", "WTG_HSCHL": "6LR"}
    rows = [(h, comp[h], y, x) for h, y, x in SITES]
    assert set(regions.merge_undersized(rows, 1).values()) == {"geo_region_01", "geo_region_02"}
    assert set(regions.merge_undersized(rows, 2).values()) == {"geo_region_01"}
    assert regions.merge_undersized(rows[:1], 5) == {"DR_WLKS": "geo_region_01"} and regions.merge_undersized([], 2) == {}
    near = regions.nearest_region(s, c, 2).collect()
    assert [(r.component, r.nearest) for r in near] == [("DR_WLKS", "6LR")] and near[0].miles == pytest.approx(12.5, abs=0.5)


def test_a_long_chain_is_one_component(spark):
    chain = [(f"S{i:03d}", 30.0 + i * 0.1, -80.0) for i in range(40)]
    _, c = labelled(spark, chain, 7.0)
    assert {r.component for r in c.collect()} == {"S000"}


@pytest.mark.parametrize("few", [0, 20_000])
def test_rounds_do_not_grow_with_the_width(spark, few):
    # names fall towards the least one, so that labels handed from neighbour to neighbour would need a round for each link
    chain = [("S000", "S099"), *((f"S{i:03d}", f"S{i - 1:03d}") for i in range(99, 1, -1)), ("T1", "T2"), ("T2", "T1"), ("T1", "T1")]
    nodes = spark.createDataFrame([(n,) for n in [*{x for p in chain for x in p}, "U", None]], "n string")
    got = {r.n: r.component for r in regions.components(nodes, spark.createDataFrame(chain, "id_a string, id_b string"), "n", 24, few=few).collect()}
    assert got == {f"S{i:03d}": "S000" for i in range(100)} | {"T1": "T1", "T2": "T1", "U": "U"}


def test_nearest_region_across_the_globe(spark):
    s, c = labelled(spark, [("A", 0.0, 179.9), ("B", 0.0, -179.9), ("C", 80.0, 0.0)], 1.0)
    assert {r.component: r.nearest for r in regions.nearest_region(s, c, 2).collect()} == {"A": "B", "B": "A", "C": "A"}


def test_matching_scenarios(spark):
    def run(events, records, ranges=(), tolerance=6.0):
        e = spark.createDataFrame([(f"{h}:{s}", h, s, i, t * 3600, k) for i, (h, s, t, k) in enumerate(events)], "colony_id string, hive_id string, colony_side string, seq long, ts long, kind string")
        r = spark.createDataFrame([(i, f"{h}:{s}", t * 3600, lab, k) for i, (h, s, t, lab, k) in enumerate(records)], "ord long, colony_id string, at long, label string, kinds array<string>")
        a = spark.createDataFrame([(h, s, x * 3600, z * 3600) for h, s, x, z in ranges], "hive_id string, side string, start long, end long")
        return validation.match_events(e, r, a, tolerance)

    def told(*args, **kw):
        return sorted(x.outcome for x in run(*args, **kw).collect())

    hit = [("A", "L", 100, "harvest")]
    assert told(hit, [("A", "L", 101, "event", ["harvest"])]) == ["true_positive"]
    assert told(hit, [("A", "L", 106, "event", ["harvest"])]) == ["true_positive"]
    assert told(hit, [("A", "L", 107, "event", ["harvest"])]) == ["false_negative", "unaudited_detection"]
    assert told(hit, [("A", "L", 101, "event", ["addition"])]) == ["false_negative", "unaudited_detection"]
    assert told(hit, [("A", "R", 101, "event", ["harvest"])]) == ["false_negative", "unaudited_detection"]
    assert told(hit, [("A", "L", 101, "non_event", ["harvest"])]) == ["false_positive"]
    assert told(hit, [("A", "L", 300, "non_event", ["harvest"])]) == ["true_negative", "unaudited_detection"]
    assert told(hit, [], [("A", "*", 100, 101)]) == ["false_positive"]
    assert told(hit, [], [("A", "R", 100, 101), ("A", "L", 90, 100)]) == ["unaudited_detection"]
    # one detection serves one record; the first record takes the nearer of two
    assert told(hit, [("A", "L", 99, "event", ["harvest"]), ("A", "L", 100, "event", ["harvest"])]) == ["false_negative", "true_positive"]
    two = run([("A", "L", 97, "harvest"), ("A", "L", 101, "swarm")], [("A", "L", 100, "event", ["harvest", "swarm"])])
    assert {x.detected: x.outcome for x in two.collect()} == {101 * 3600: "true_positive", 97 * 3600: "unaudited_detection"}
    r = validation.rates(run(hit, [("A", "L", 101, "event", ["harvest"]), ("B", "L", 5, "event", ["harvest"])])).first()
    assert (r.precision, r.recall, round(r.f1, 6)) == (1.0, 0.5, 0.666667)
    assert validation.rates(run([], [])).first().f1 == 1.0


def test_replay_finds_what_each_window_shows_once(spark):
    r = frame(spark, readings([40.0] * 240 + [30.0] * 240))
    e = validation.first_seen(steps.detect(validation.replayed(r, 7, 1), CFG)).collect()
    assert [(x.colony_id, x.kind) for x in e] == [("H1:L", "harvest")] and validation.replayed(r.limit(0), 7).collect() == []


def test_quantiles_against_sorting(spark):
    rng = random.Random(2)
    values = [("a", round(rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 6), 6)) for _ in range(3001)] + [("b", 0.0)] * 7 + [("c", None)]
    df = spark.createDataFrame(values, "k string, x double").selectExpr("k", "x", "1 as n")
    got = {(r.k, r.q): r.value for r in quantiles(df, ["k"], "x", "n", (0.0, 0.1, 0.5, 0.999, 1.0)).collect()}
    a = sorted(v for k, v in values if k == "a")
    for q in (0.0, 0.1, 0.5, 0.999, 1.0):
        at = q * (len(a) - 1)
        lo = int(at)
        want = a[lo] + (at - lo) * (a[min(lo + 1, len(a) - 1)] - a[lo])
        assert got["a", q] == pytest.approx(want) and got["b", q] == 0.0
    assert ("c", 0.5) not in got


def test_cells_hang_together_like_sites(spark):
    """A crowd makes links between cells, not pairs of sites; the components are those of all pairs, at poles and antimeridian, too."""
    from pyspark.sql import functions as F

    from combline.functions.geo import haversine_miles_np
    from combline.operators.spatial import cell_of, near_classes

    rng = np.random.default_rng(5)
    lat = np.concatenate([rng.normal(40, 0.15, 200), rng.normal(-33, 2, 300), 90 - rng.random(40) * 0.4, rng.normal(10, 0.2, 60), [0.0, 0.05, -0.05]])
    lon = np.concatenate([rng.normal(-80, 0.2, 200), rng.normal(20, 2, 300), rng.random(40) * 360 - 180, (rng.normal(0, 0.3, 60) + 360) % 360 - 180, [1.0, 1.0, 1.0]])
    cell = cell_of(lat, lon, 10.0, 3958.7613)
    for c in np.unique(cell):
        k = np.flatnonzero(cell == c)
        assert (haversine_miles_np(lat[k][:, None], lon[k][:, None], lat[k][None], lon[k][None], 3958.7613) <= 10).all()
    s = spark.createDataFrame([(f"S{i:04d}", float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon))], "hive_id string, latitude double, longitude double")
    members, links = near_classes(s, "hive_id", "latitude", "longitude", 10.0, 3958.7613, cells=True)
    found = regions.components(members.select("rep"), links.withColumnsRenamed({"rep_a": "id_a", "rep_b": "id_b"}), "rep")
    names = members.join(found, "rep").groupBy("component").agg(F.min("_site").alias("name"), F.collect_list("_site").alias("all"))
    got = {x: r.name for r in names.collect() for x in r.all}
    pairs = near_pairs(s, "hive_id", "latitude", "longitude", 10.0, 3958.7613)
    assert got == {r.hive_id: r.component for r in regions.components(s, pairs, "hive_id").collect()}
    assert links.count() * 4 < pairs.count()
