"""Points near other points: sampled quadtree, boundary replication, a bulk-loaded R-tree per leaf, exact refinement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combline.functions.geo import EARTH_RADIUS_MILES, haversine_miles_np
from combline.session import written

#: The quadtree is fitted on at most so many positions; every position is then placed in it.
SAMPLE = 20_000
#: About so many leaves there are at most, so that they can go with the tasks: some 40 bytes each.
LEAVES = 100_000
#: Depth at which cells are numbered.
DEPTH = 24
FANOUT = 32


class Quadtree:
    """Leaves as ranges of Morton numbers over longitude -180..180 and latitude -90..90."""

    def __init__(self, x: np.ndarray, y: np.ndarray, capacity: int, least_deg: float):
        self.starts: list[int] = []
        self.boxes: list[tuple[float, float, float, float]] = []
        self._split(x, y, -180.0, -90.0, 360.0, 180.0, 0, 0, max(1, capacity), least_deg)

    def _split(self, x, y, x0, y0, w, h, level, code, capacity, least) -> None:
        if len(x) <= capacity or min(w, h) / 2 < least or level == DEPTH:
            self.starts.append(code << 2 * (DEPTH - level))
            self.boxes.append((x0, y0, x0 + w, y0 + h))
            return
        w, h = w / 2, h / 2
        right, upper = x >= x0 + w, y >= y0 + h
        for k in range(4):
            at = (right == bool(k & 1)) & (upper == bool(k & 2))
            self._split(x[at], y[at], x0 + w * (k & 1), y0 + h * (k >> 1), w, h, level + 1, code * 4 + k, capacity, least)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.starts, np.int64), np.array(self.boxes, np.float64).reshape(-1, 4)


def split_leaves(starts: np.ndarray, boxes: np.ndarray, crowded: set[int], least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The leaves with each crowded one cut into four, as long as its children are not smaller than least; and how many were cut."""
    new_starts, new_boxes, cut = [], [], 0
    ends = np.append(starts[1:], 1 << 2 * DEPTH)
    for k in range(len(starts)):
        x0, y0, x1, y1 = boxes[k]
        size = int(ends[k] - starts[k])
        if k not in crowded or min(x1 - x0, y1 - y0) / 2 < least or size < 4:
            new_starts.append(int(starts[k]))
            new_boxes.append(boxes[k])
            continue
        cut += 1
        w, h = (x1 - x0) / 2, (y1 - y0) / 2
        for c in range(4):
            a, b = x0 + w * (c & 1), y0 + h * (c >> 1)
            new_starts.append(int(starts[k]) + c * (size // 4))
            new_boxes.append((a, b, a + w, b + h))
    return np.array(new_starts, np.int64), np.array(new_boxes, np.float64).reshape(-1, 4), cut


def _morton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    side = 1 << DEPTH
    cx = np.clip(((x + 180.0) / 360.0 * side).astype(np.int64), 0, side - 1)
    cy = np.clip(((y + 90.0) / 180.0 * side).astype(np.int64), 0, side - 1)
    out = np.zeros(len(x), np.int64)
    for b in range(DEPTH):
        out |= ((cx >> b) & 1) << (2 * b) | ((cy >> b) & 1) << (2 * b + 1)
    return out


def _leaf_of(starts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, _morton(x, y), side="right") - 1


def reach_boxes(lat: np.ndarray, lon: np.ndarray, miles: float, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Half height and half width in degrees of a box that holds all points within miles (180 where it holds a pole)."""
    slack = 1 + 1e-9
    angle = miles / radius * slack
    up = np.degrees(angle) + 1e-9
    c = np.cos(np.radians(lat))
    polar = np.abs(lat) + up >= 90
    with np.errstate(divide="ignore", invalid="ignore"):
        wide = np.degrees(np.arcsin(np.minimum(1.0, np.sin(min(angle, np.pi / 2)) / np.where(polar, 1.0, c)))) + 1e-9
    return np.full(len(lat), up), np.where(polar, 180.0, wide)


def _boxes(lat, lon, miles, radius):
    """Boxes of reach and, where they pass the antimeridian, their copies a turn away: index of the point, box."""
    up, wide = reach_boxes(lat, lon, miles, radius)
    at = np.arange(len(lat))
    all_round = wide >= 180
    x0, x1 = np.where(all_round, -180.0, lon - wide), np.where(all_round, 180.0, lon + wide)
    out = [(at, x0, x1)]
    for side, shift in ((x1 >= 180, -360.0), (x0 <= -180, 360.0)):
        k = at[side & ~all_round]
        out.append((k, x0[k] + shift, x1[k] + shift))
    at = np.concatenate([o[0] for o in out])
    return at, np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out]), lat[at] - up[at], lat[at] + up[at]


class RTree:
    """Sort-tile-recursive R-tree over boxes; probe gives the (point, box) pairs in which the point lies in the box."""

    def __init__(self, x0, x1, y0, y1):
        n = len(x0)
        slices = max(1, int(np.ceil(np.sqrt(np.ceil(n / FANOUT)))))
        by_x = np.argsort((x0 + x1) / 2, kind="stable")
        strip = np.empty(n, np.int64)
        strip[by_x] = np.arange(n) * slices // max(n, 1)
        self.order = np.lexsort(((y0 + y1) / 2, strip))
        level = np.column_stack((x0, x1, y0, y1))[self.order]
        self.levels = [level]
        while len(level) > 1:
            at = np.arange(0, len(level), FANOUT)
            level = np.column_stack((np.minimum.reduceat(level[:, 0], at), np.maximum.reduceat(level[:, 1], at), np.minimum.reduceat(level[:, 2], at), np.maximum.reduceat(level[:, 3], at)))
            self.levels.append(level)

    def probe(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        stack = [(len(self.levels) - 1, k, np.arange(len(x))) for k in range(len(self.levels[-1]))]
        while stack:
            depth, node, who = stack.pop()
            b = self.levels[depth][node]
            who = who[(x[who] >= b[0]) & (x[who] <= b[1]) & (y[who] >= b[2]) & (y[who] <= b[3])]
            if not len(who):
                continue
            if depth == 0:
                yield who, np.full(len(who), self.order[node])
                continue
            below = range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[depth - 1])))
            if depth > 1:
                stack.extend((depth - 1, k, who) for k in below)
                continue
            lo, hi = below.start, below.stop
            e = self.levels[0][lo:hi]
            for part in np.array_split(who, max(1, len(who) // 20_000)):
                px, py = x[part, None], y[part, None]
                i, j = np.nonzero((px >= e[:, 0]) & (px <= e[:, 1]) & (py >= e[:, 2]) & (py <= e[:, 3]))
                yield part[i], self.order[lo + j]


    def overlaps(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query box, own box) pairs that touch."""
        stack = [(len(self.levels) - 1, k, np.arange(len(x0))) for k in range(len(self.levels[-1]))]
        while stack:
            depth, node, who = stack.pop()
            b = self.levels[depth][node]
            who = who[(x1[who] >= b[0]) & (x0[who] <= b[1]) & (y1[who] >= b[2]) & (y0[who] <= b[3])]
            if not len(who):
                continue
            if depth == 0:
                yield who, np.full(len(who), self.order[node])
            else:
                stack.extend((depth - 1, k, who) for k in range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[depth - 1]))))


def _counter(starts: np.ndarray):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        for b in batches:
            for k, n in zip(*np.unique(_leaf_of(starts, b["lon"].to_numpy(), b["lat"].to_numpy()), return_counts=True)):
                seen[int(k)] = seen.get(int(k), 0) + int(n)
        yield pd.DataFrame({"leaf": list(seen), "n": list(seen.values())}, dtype="int64")

    return count


def _assigner(starts: np.ndarray, boxes: np.ndarray, miles: float, radius: float):
    tree_x0, tree_y0, tree_x1, tree_y1 = boxes.T

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves = RTree(tree_x0, tree_x1, tree_y0, tree_y1)
        for b in batches:
            if not len(b):
                continue
            lat, lon = b["lat"].to_numpy(), b["lon"].to_numpy()
            home = _leaf_of(starts, lon, lat)
            own = b.assign(leaf=home, native=True, x0=0.0, x1=0.0, y0=0.0, y1=0.0)
            at, x0, x1, y0, y1 = _boxes(lat, lon, miles, radius)
            # corners first: nearly all boxes lie in one leaf
            cx0, cx1, cy0, cy1 = np.clip(x0, -180, 180), np.clip(x1, -180, 180), np.clip(y0, -90, 90), np.clip(y1, -90, 90)
            corner = [_leaf_of(starts, p, q) for p, q in ((cx0, cy0), (cx0, cy1), (cx1, cy0), (cx1, cy1))]
            one = (corner[0] == corner[1]) & (corner[0] == corner[2]) & (corner[0] == corner[3])
            k, leaf = [np.flatnonzero(one)], [corner[0][one]]
            rest = np.flatnonzero(~one)
            for i, j in leaves.overlaps(x0[rest], x1[rest], y0[rest], y1[rest]):
                k.append(rest[i])
                leaf.append(j)
            k, leaf = np.concatenate(k), np.concatenate(leaf)
            reach = b.iloc[at[k]].assign(leaf=leaf, native=False, x0=x0[k], x1=x1[k], y0=y0[k], y1=y1[k])
            yield pd.concat((own, reach))

    return assign


def cell_of(lat: np.ndarray, lon: np.ndarray, miles: float, radius: float) -> np.ndarray:
    """Numbers of cells so small that all positions of one are less than miles apart: bands of latitude, cut by longitude as wide as at the band's side to the equator."""
    side = np.degrees(min(miles / radius, 1.0) * 0.9 / np.sqrt(2))  # a tenth is left for the bend of the arc and for rounding
    if side <= 1e-7:
        raise ValueError("miles is too small for cells")
    band = np.floor((lat + 90.0) / side).astype(np.int64)
    low, high = band * side - 90.0, (band + 1) * side - 90.0
    widest = np.where((low <= 0) & (high >= 0), 1.0, np.cos(np.radians(np.minimum(np.abs(low), np.abs(high)))))
    return (band << 32) + np.floor((lon + 180.0) / np.minimum(side / np.maximum(widest, 1e-12), 360.0)).astype(np.int64)


def _tile_cells(miles: float, radius: float):
    """The pairs of cells that have positions at most miles apart."""

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        probe, target = pdf[pdf["native"]], pdf[~pdf["native"]]
        plat, plon = probe["lat"].to_numpy(), probe["lon"].to_numpy()
        tlat, tlon = target["lat"].to_numpy(), target["lon"].to_numpy()
        a, b = cell_of(plat, plon, miles, radius), cell_of(tlat, tlon, miles, radius)
        found: list[np.ndarray] = []
        if len(a) and len(b):
            tree = RTree(*(target[c].to_numpy() for c in ("x0", "x1", "y0", "y1")))
            for i, j in tree.probe(plon, plat):
                apart = a[i] < b[j]
                i, j = i[apart], j[apart]
                near = haversine_miles_np(plat[i], plon[i], tlat[j], tlon[j], radius) <= miles
                if near.any():
                    found.append(np.unique(np.column_stack((a[i[near]], b[j[near]])), axis=0))
        both = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"rep_a": both[:, 0], "rep_b": both[:, 1]}).drop_duplicates()

    return tile


def _tile_pairs(miles: float, radius: float):
    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        probe, target = pdf[pdf["native"]], pdf[~pdf["native"]]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(probe) and len(target):
            plat, plon, pid = probe["lat"].to_numpy(), probe["lon"].to_numpy(), probe["rep"].to_numpy()
            tlat, tlon, tid = target["lat"].to_numpy(), target["lon"].to_numpy(), target["rep"].to_numpy()
            tree = RTree(*(target[c].to_numpy() for c in ("x0", "x1", "y0", "y1")))
            for i, j in tree.probe(plon, plat):
                near = (haversine_miles_np(plat[i], plon[i], tlat[j], tlon[j], radius) <= miles) & (pid[i] < tid[j])
                if near.any():
                    found.append((pid[i[near]], tid[j[near]]))
        a = np.concatenate([f[0] for f in found]) if found else np.array([], object)
        b = np.concatenate([f[1] for f in found]) if found else np.array([], object)
        return pd.DataFrame({"rep_a": a, "rep_b": b}).drop_duplicates()

    return tile


def near_classes(
    df: DataFrame, id_col: str, lat: str, lon: str, miles: float, radius: float = EARTH_RADIUS_MILES, leaf_rows: int = 2_000, tile_rows: int = 8_000, sample_rows: int = SAMPLE, cells: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Members (_site, rep, n) and links (rep_a, rep_b): ids that share a position are a class named by its smallest id, with n
    members; links are between classes at most miles apart on the great circle, each once, rep_a < rep_b in byte order.

    Rows with a null id, a null or NaN coordinate, |latitude| > 90 or |longitude| > 180 are left out. A repeated row counts once. Pairs over the antimeridian and around the poles are found.
    Empty input: no rows. Other columns are ignored.

    Equal positions are one point of the join. A quadtree over a sample of at most SAMPLE
    positions (deterministic: smallest hashes) sets the leaves; each position goes to its own leaf as a probe and to every
    leaf that its box of reach touches as a target. A pair is found only in the leaf that owns the position of its smaller
    id, so nothing is found twice. Leaves are counted exactly, and crowded ones are cut in four again and again, down to a
    few times the reach; there are at most some hundred thousand leaves, as leaf_rows rises with the data beyond that. A leaf
    that still has more than tile_rows rows is cut into tiles of probes and targets, so no task holds a crowded leaf.

    With cells, a class is all positions of a cell of cell_of instead, rep is its number and members have no n: the same
    components hang together, but links grow with the cells that are taken, not with the pairs of a crowd.
    """
    ok = F.col("_lat").between(-90.0, 90.0) & F.col("_lon").between(-180.0, 180.0)
    sites = df.select(F.col(id_col).cast("string").alias("_site"), (F.col(lat).cast("double") + 0.0).alias("_lat"), (F.col(lon).cast("double") + 0.0).alias("_lon"))
    sites = written(sites.where(F.col("_site").isNotNull() & ok).distinct(), "sites")
    points = written(sites.groupBy("_lat", "_lon").agg(F.min("_site").alias("rep"), F.count(F.lit(1)).alias("n")).select("rep", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "n"), "points")
    total = points.count()
    sample = points.select("lat", "lon").orderBy(F.xxhash64("lat", "lon"), "lat", "lon").limit(sample_rows).toPandas()
    share = len(sample) / max(total, 1)
    least = 4 * np.degrees(miles / radius)
    tree = Quadtree(sample["lon"].to_numpy(), sample["lat"].to_numpy(), max(8, int(leaf_rows * share)), least)
    starts, boxes = tree.arrays()
    full = max(2 * leaf_rows, total // LEAVES)
    while len(sample) < total:
        crowded = points.select("lat", "lon").mapInPandas(_counter(starts), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") > full).select("leaf").collect()
        starts, boxes, cut = split_leaves(starts, boxes, {r["leaf"] for r in crowded}, least)
        if not cut:
            break

    placed = points.select("rep", "lat", "lon").mapInPandas(
        _assigner(starts, boxes, miles, radius),
        "rep string, lat double, lon double, leaf bigint, native boolean, x0 double, x1 double, y0 double, y1 double",
    )
    placed = written(placed, "placed")
    # at most as many rows as the tree has leaves, which the sample bounds
    sizes = F.broadcast(placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("_k")))
    mine = F.pmod(F.xxhash64("rep"), F.col("_k")).cast("int")
    all_tiles = F.sequence(F.lit(0), F.col("_k") - 1)
    tiled = placed.join(sizes, "leaf").withColumn("_mine", mine).withColumn("_other", F.explode(all_tiles))
    tile = F.when(F.col("native"), F.col("_mine") * F.col("_k") + F.col("_other")).otherwise(F.col("_other") * F.col("_k") + F.col("_mine"))
    pairs = (
        tiled.withColumn("tile", tile)
        .select("leaf", "tile", "native", "rep", "lat", "lon", "x0", "x1", "y0", "y1")
        .groupBy("leaf", "tile")
        .applyInPandas(*((_tile_cells(miles, radius), "rep_a bigint, rep_b bigint") if cells else (_tile_pairs(miles, radius), "rep_a string, rep_b string")))
    )
    pairs = written(pairs.distinct(), "pairs")  # a target and its copy a turn away may meet a probe in two tiles
    if cells:

        def member(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"_site": b["_site"], "rep": cell_of(b["_lat"].to_numpy(), b["_lon"].to_numpy(), miles, radius)})

        return sites.mapInPandas(member, "_site string, rep bigint").distinct(), pairs
    members = sites.join(points.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "rep", "n"), ["_lat", "_lon"]).select("_site", "rep", "n")
    return members, pairs


def near_counts(df: DataFrame, id_col: str, lat: str, lon: str, miles: float, **limits) -> DataFrame:
    """site, class_id, links of each id with a position: the smallest id at the same position, and how many other ids lie at most miles away. Grows with the ids, not with the pairs."""
    members, links = near_classes(df, id_col, lat, lon, miles, **limits)
    size = members.select("rep", "n").distinct()
    both = links.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")).unionByName(links.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other")))
    far = both.join(size.select(F.col("rep").alias("other"), F.col("n").alias("m")), "other").groupBy("rep").agg(F.sum("m").alias("far"))
    return members.join(far, "rep", "left").select(F.col("_site").alias("site"), F.col("rep").alias("class_id"), (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("links"))


def near_pairs(df: DataFrame, id_col: str, lat: str, lon: str, miles: float, radius: float = EARTH_RADIUS_MILES, **limits) -> DataFrame:
    """id_a, id_b (strings, id_a < id_b in byte order) of all pairs at most miles apart on the great circle.

    The links of near_classes, with the members of each class put in their place; ids with the same position pair at
    distance 0. A large class is met in slices, so it never multiplies in one task. near_counts tells as much without pairs.
    """
    members, pairs = near_classes(df, id_col, lat, lon, miles, radius, **limits)
    crowd = members.where("n > 1").select("rep", "n").distinct()
    # salts split a crowd: every member of a position is met by one slice of the other side at a time
    salted = members.where("n > 1").select("rep", "_site", F.pmod(F.xxhash64("_site"), F.ceil(F.col("n") / 1024)).alias("_salt"))
    salts = crowd.select("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / 1024) - 1)).alias("_salt"))
    same = salts.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"))
    links = pairs.unionByName(same.distinct())
    left = links.join(salts.withColumnRenamed("rep", "rep_a"), "rep_a", "left")
    left = left.join(salted.select(F.col("rep").alias("rep_a"), "_salt", F.col("_site").alias("_a")), ["rep_a", "_salt"], "left")
    left = left.select("rep_b", F.coalesce("_a", "rep_a").alias("_a"), (F.col("rep_a") == F.col("rep_b")).alias("_same"))
    right = left.join(salts.select(F.col("rep").alias("rep_b"), F.col("_salt")), "rep_b", "left")
    right = right.join(salted.select(F.col("rep").alias("rep_b"), "_salt", F.col("_site").alias("_b")), ["rep_b", "_salt"], "left")
    both = right.select("_a", F.coalesce("_b", "rep_b").alias("_b"), "_same")
    both = both.where(F.col("_a") != F.col("_b")).where(~F.col("_same") | (F.col("_a") < F.col("_b")))
    return both.select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"))
