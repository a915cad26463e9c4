"""Regions of sites: connected components of a distance graph, and undersized ones merged into their nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combline.functions.geo import EARTH_RADIUS_MILES, haversine_miles, haversine_miles_np
from combline.session import written


def _least_of(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each end of links with the least end that it hangs together with."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return [(x, top(x)) for x in list(up)]


def components(nodes: DataFrame, pairs: DataFrame, node: str, max_rounds: int = 64, few: int = 20_000) -> DataFrame:
    """node, component: the smallest node that can be reached over pairs (id_a, id_b). Repeated pairs and loops do no harm.

    Each round draws a number for every node that still has links, and each of them goes to the least one of itself and
    its neighbours; what has gone to one place is one node of the next round, and links within it are gone. The draw is
    another one each round, so no order of names or positions keeps a part of the nodes from shrinking, and the rounds
    grow with the logarithm of the nodes, not with a component's width. Each round is written. Once at most `few` links are
    left, whatever their number was, they are joined up on the driver; more never leave the executors.
    """
    named = written(nodes.where(F.col(node).isNotNull()).select(node).distinct().withColumn("_i", F.monotonically_increasing_id()), "nodes")
    end = lambda c: named.select(F.col(node).alias(f"id_{c}"), F.col("_i").alias(c))
    links = written(pairs.select("id_a", "id_b").where("id_a <> id_b").join(end("a"), "id_a").join(end("b"), "id_b").select("a", "b"), "links")
    label = named.select("_i", F.col("_i").alias("c"))
    for k in range(max_rounds):
        if (left := links.count()) <= few:
            if left:
                c, to = zip(*_least_of([tuple(r) for r in links.collect()]))
                to = nodes.sparkSession.createDataFrame(pa.table({"c": pa.array(c, pa.int64()), "to": pa.array(to, pa.int64())}))
                label = label.join(to, "c", "left").select("_i", F.coalesce("to", "c").alias("c"))
            break
        drawn = lambda c: F.xxhash64(F.col(c), F.lit(k))  # noqa: B023, E731
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min_by("b", drawn("b")).alias("m"))
        to = written(near.select("a", F.when(drawn("m") < drawn("a"), F.col("m")).otherwise(F.col("a")).alias("to")), "contracted")
        label = written(label.join(to.withColumnRenamed("a", "c"), "c", "left").select("_i", F.coalesce("to", "c").alias("c")), "labels")
        ends = links.join(to.withColumnRenamed("to", "x"), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        links = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    member = named.join(label, "_i")
    return member.join(member.groupBy("c").agg(F.min(node).alias("component")), "c").select(node, "component")


def nearest_region(sites: DataFrame, labelled: DataFrame, least: int, start_miles: float = 20.0, radius: float = EARTH_RADIUS_MILES) -> DataFrame:
    """component, nearest, miles for each component with fewer than least sites: the component with the nearest site; of equally near ones the smallest.

    Sites lie in cubes of space as wide as the reach; a site of an undersized component looks into its own and the 26 around
    it. Those that find nothing look again with four times the reach, and so on round the globe, so each round joins on
    cubes and only what is left goes on. Without a second component there are no rows.
    """
    s = sites.join(labelled, "hive_id").select("component", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    y, x = F.radians("lat"), F.radians("lon")
    s = written(s.withColumns({"px": F.cos(y) * F.cos(x), "py": F.cos(y) * F.sin(x), "pz": F.sin(y)}), "sited")
    small = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least).select("component")
    left = written(s.join(small, "component", "left_semi"), "undersized")
    out, miles, around = None, start_miles, np.pi * radius
    while True:
        reach = min(miles, around)
        side = 2 * float(np.sin(reach / radius / 2)) * (1 + 1e-9)
        cube = lambda c: F.floor(F.col(c) / side)
        near = [F.sequence(cube(c) - 1, cube(c) + 1) for c in ("px", "py", "pz")]
        probe = left.select(F.col("component").alias("mine"), F.col("lat").alias("a"), F.col("lon").alias("o"), F.explode(near[0]).alias("x"), near[1].alias("_y"), near[2].alias("_z"))
        probe = probe.withColumn("y", F.explode("_y")).withColumn("z", F.explode("_z")).drop("_y", "_z")
        found = probe.join(s.withColumns({"x": cube("px"), "y": cube("py"), "z": cube("pz")}), ["x", "y", "z"]).where(F.col("mine") != F.col("component"))
        found = found.withColumn("miles", haversine_miles(F.col("a"), F.col("o"), F.col("lat"), F.col("lon"), radius)).where(F.col("miles") <= reach)
        best = F.min(F.struct("miles", F.col("component").alias("c"))).alias("b")
        hits = written(found.groupBy("mine").agg(best).select(F.col("mine").alias("component"), F.col("b.c").alias("nearest"), F.col("b.miles").alias("miles")), "nearest")
        out = hits if out is None else out.unionByName(hits)
        left = written(left.join(hits.select("component"), "component", "left_anti"), "left")
        if reach >= around or left.isEmpty():
            return out
        miles *= 4


def merge_undersized(rows: list[tuple[str, str, float, float]], least: int, radius: float = EARTH_RADIUS_MILES) -> dict[str, str]:
    """hive_id to region id. rows: hive_id, component, latitude, longitude of the inventory, which is one small table.

    While a region has fewer than least sites and another one is there, the undersized one whose sorted members come first
    joins the region with the nearest site (of equally near ones that whose members come first). Regions are numbered by
    their smallest member.
    """
    groups: dict[str, list[int]] = {}
    for k, r in enumerate(rows):
        groups.setdefault(r[1], []).append(k)
    regions = [sorted(g, key=lambda k: rows[k][0]) for g in groups.values()]
    lat, lon = (np.array([r[c] for r in rows], float) for c in (2, 3))
    names = lambda g: [rows[k][0] for k in g]
    while len(regions) > 1 and (small := [g for g in regions if len(g) < least]):
        mine = min(small, key=names)
        others = [g for g in regions if g is not mine]
        away = [min(float(haversine_miles_np(lat[k], lon[k], lat[g], lon[g], radius).min()) for k in mine) for g in others]
        into = min(zip(away, map(names, others), range(len(others))))[2]
        others[into] = sorted(others[into] + mine, key=lambda k: rows[k][0])
        regions = others
    return {rows[k][0]: f"geo_region_{i:02d}" for i, g in enumerate(sorted(regions, key=names), 1) for k in g}
