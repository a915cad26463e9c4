"""Implausible measurements: physical bounds, frozen runs and spikes against rolling medians (a Hampel filter)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from combline.operators.quantiles import quantiles
from combline.session import written

#: A block is as long as that; with a halo of silence_s at each end it holds at most one standing row a second.
BLOCK_S = 16 * 86_400
NEIGHBOURS = 5
_OUT = pa.schema([
    ("kind", pa.int8()), ("field", pa.int8()), ("k0", pa.string()), ("k1", pa.string()), ("block", pa.int64()),
    ("ids", pa.list_(pa.int64())), ("x", pa.list_(pa.float64())), ("n", pa.list_(pa.int64())), ("open_left", pa.bool_()), ("open_right", pa.bool_()),
])
_OUT_DDL = "kind tinyint, field tinyint, k0 string, k1 string, block bigint, ids array<bigint>, x array<double>, n array<bigint>, open_left boolean, open_right boolean"
BOUND, RUN, SPIKE, STEPS = range(4)


def group_chunks(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 150_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in which each group's rows lie together; about rows rows or one group each."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        new = group_starts(t, keys)
        if len(new) > 1:
            yield t.slice(0, new[-1])
            t = t.slice(new[-1]).combine_chunks()
        held, n = t.to_batches(), t.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    if t.num_rows == 0:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        c = t.column(k)
        if t.num_rows > 1:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _median_of_rows(m: np.ndarray) -> np.ndarray:
    """Median of each row, NaN left out; NaN where nothing is left."""
    m.sort(axis=1)
    c = np.isfinite(m).sum(axis=1)
    at = np.arange(len(m))
    mid = (m[at, np.maximum(c - 1, 0) // 2] + m[at, np.minimum(c // 2, m.shape[1] - 1)]) / 2
    return np.where(c > 0, mid, np.nan)


def _neighbours(v: np.ndarray, t: np.ndarray, g: np.ndarray, near_s: int) -> tuple[np.ndarray, np.ndarray]:
    """The up to NEIGHBOURS readings before and after each one, at most near_s away, in its group; NaN where there is none."""
    n = len(v)
    before, after = np.full((n, NEIGHBOURS), np.nan), np.full((n, NEIGHBOURS), np.nan)
    for k in range(1, min(NEIGHBOURS, n - 1) + 1):
        ok = (g[k:] == g[:-k]) & (t[k:] - t[:-k] <= near_s)
        before[k:, k - 1] = np.where(ok, v[:-k], np.nan)
        after[:-k, k - 1] = np.where(ok, v[k:], np.nan)
    return before, after


def hampel(v: np.ndarray, before: np.ndarray, after: np.ndarray, times: float) -> np.ndarray:
    """Whether each value lies more than times the scaled median absolute deviation from the median of its window.

    The window is the value with its neighbours before and after. With no deviation at all any other value stands out.
    """
    window = np.column_stack((before, v, after))
    middle = _median_of_rows(window.copy())
    spread = _median_of_rows(np.abs(window - middle[:, None]))
    with np.errstate(invalid="ignore"):
        return np.abs(v - middle) > times * 1.4826 * spread


#: A value is a candidate if it lies more than so many scaled median absolute deviations from its window's median. Three
#: readings off make up a part of a window of eleven, so its deviation stays that of the others. 1 is low on purpose: at sf0.01
#: and sf0.1 it keeps all that the exact test accepts (the SQL beside the query has no such sieve), and so do the tests.
HAMPEL = 1.0


def spike_starts(v: np.ndarray, t: np.ndarray, g: np.ndarray, near_s: int = 6 * 3600, longest: int = 3, times: float = HAMPEL) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: starts of the runs of readings that stand off from the level on both sides, and how far.

    Candidates come from a Hampel filter; an exact test follows: all readings of a run lie to one side of both levels; the levels agree to half the distance, and so do the readings
    next to the run, so that neither a part of a longer stay nor a lasting change of level is found.
    """
    around = _neighbours(v, t, g, near_s)
    odd = hampel(v, *around, times)
    out, n = [], len(v)
    # only rows from which a run of candidates could start are looked at any further
    reach = odd.copy()
    for k in range(1, longest):
        reach[:-k] |= odd[k:]
        reach[k:] |= odd[:-k]
    before, after = (np.full(n, np.nan) for _ in range(2))
    at = np.flatnonzero(reach)
    before[at], after[at] = _median_of_rows(around[0][at]), _median_of_rows(around[1][at])
    for size in range(1, longest + 1):
        m = n - size + 1
        if m < 3:
            break
        low, high = v[:m].copy(), v[:m].copy()
        all_odd = odd[:m].copy()
        for k in range(1, size):
            np.minimum(low, v[k : m + k], out=low)
            np.maximum(high, v[k : m + k], out=high)
            all_odd &= odd[k : m + k]
        b, a = before[:m], after[size - 1 :]
        with np.errstate(invalid="ignore"):
            off = np.maximum(low - np.maximum(a, b), np.minimum(a, b) - high)
            ok = all_odd & (off > 0) & (g[:m] == g[size - 1 :]) & (t[size - 1 :] - t[:m] <= near_s) & (np.abs(a - b) <= off / 2)
            left = np.full(m, np.nan)
            left[1:] = v[: m - 1]
            right = np.full(m, np.nan)
            right[:-1] = v[size:]
            ok &= (np.abs(left - b) <= off / 2) & (np.abs(right - a) <= off / 2)
        at = np.flatnonzero(ok)
        out.append((size, at, off[at]))
    return out


def _rows(kind: int, field: int, t: pa.Table, at: np.ndarray, ids=None, x=None, n=None, left=None, right=None) -> pa.RecordBatch:
    def some(v, kind_of):
        return pa.array([None] * len(at), kind_of) if v is None else v if isinstance(v, pa.Array) else pa.array(v, kind_of)

    few = t.select(["_k0", "_k1", "_block"]).take(pa.array(at))
    cols = [
        pa.array(np.full(len(at), kind, np.int8)), pa.array(np.full(len(at), field, np.int8)),
        *(few.column(c).combine_chunks() for c in ("_k0", "_k1", "_block")),
        some(ids, pa.list_(pa.int64())), some(x, pa.list_(pa.float64())), some(n, pa.list_(pa.int64())), some(left, pa.bool_()), some(right, pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, _OUT)], schema=_OUT)


def _list(values: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def _scan(fields: list[tuple[str, float, float]], min_run: int, silence_s: int, near_s: int, loose: float):
    """Per block: impossible values, runs of equal values with whether they go on beyond the block, spike candidates, and
    the counted absolute changes. Spikes are kept if they stand off by more than loose times the block's median change."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in group_chunks(batches, ["_k0", "_k1", "_block"]):
            starts = group_starts(t, ["_k0", "_k1", "_block"])
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
            when, core_all, id_all = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("_t", "_core", "_id"))
            for f, (name, lo, hi) in enumerate(fields):
                col = t.column(name).combine_chunks()
                there = np.flatnonzero(pc.is_valid(col).to_numpy(zero_copy_only=False))
                v = col.to_numpy(zero_copy_only=False)[there]
                there, v = there[~np.isnan(v)], v[~np.isnan(v)]
                if not len(v):
                    continue
                s, g, core, ids = when[there], group[there], core_all[there], id_all[there]
                bad = np.flatnonzero(core & ((v < lo) | (v > hi)))
                if len(bad):
                    yield _rows(BOUND, f, t, there[bad], ids=_list(ids[bad], np.ones(len(bad), int), pa.int64()))

                near = np.zeros(len(v), bool)  # goes on from the reading before, however far equal
                near[1:] = (g[1:] == g[:-1]) & (s[1:] - s[:-1] <= silence_s)
                same = near.copy()
                same[1:] &= v[1:] == v[:-1]
                # fragments: equal stretches cut at the borders of the block's own part
                cut = ~same
                cut[1:] |= core[1:] != core[:-1]
                first = np.flatnonzero(cut)
                size = np.diff(np.append(first, len(v)))
                last = first + size - 1
                from_left = same[first]
                to_right = np.append(same[first[1:]], False)
                keep = core[first] & ((size >= min_run) | from_left | to_right)
                first, size, last, from_left, to_right = (x[keep] for x in (first, size, last, from_left, to_right))
                if len(first):
                    own = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    yield _rows(RUN, f, t, there[first], ids=_list(ids[own], size, pa.int64()), n=_list(size, np.ones(len(size), int), pa.int64()), left=from_left, right=to_right)

                step = np.flatnonzero(near & core)
                change = np.round(np.abs(v[step] - v[step - 1]), 6)
                order = np.lexsort((change, g[step]))
                change, cg = change[order], g[step][order]
                middle = np.full(len(starts), np.nan)
                if len(change):
                    head = np.flatnonzero(np.concatenate(([True], cg[1:] != cg[:-1])))
                    long = np.diff(np.append(head, len(cg)))
                    middle[cg[head]] = (change[head + (long - 1) // 2] + change[head + long // 2]) / 2
                    new = np.flatnonzero(np.concatenate(([True], (cg[1:] != cg[:-1]) | (change[1:] != change[:-1]))))
                    many = np.diff(np.append(new, len(cg)))
                    per = np.unique(cg[new], return_counts=True)
                    yield _rows(STEPS, f, t, starts[per[0]], x=_list(change[new], per[1], pa.float64()), n=_list(many, per[1], pa.int64()))
                for size_, at, off in spike_starts(v, s, g, near_s):
                    limit = middle[g[at]]
                    with np.errstate(invalid="ignore"):
                        ok = core[at] & ~(off <= loose * limit)
                    at, off, limit = at[ok], off[ok], limit[ok]
                    if len(at):
                        own = (at[:, None] + np.arange(size_)).ravel()
                        yield _rows(SPIKE, f, t, there[at], ids=_list(ids[own], np.full(len(at), size_), pa.int64()), x=_list(off, np.ones(len(at), int), pa.float64()))

    return scan


def implausible(
    df: DataFrame,
    keys: tuple[str, str],
    epoch: str,
    row_id: str,
    fields: dict[str, tuple[float, float]],
    min_run: int = 8,
    silence_s: int = 48 * 3600,
    near_s: int = 6 * 3600,
    times: float = 10.0,
) -> DataFrame:
    """row_id, field_name and reason (impossible, frozen, spike) of each implausible value; a value may have several.

    df has one row per source (the two keys, as strings) and second. impossible: outside the field's bounds. frozen: in a
    run of at least min_run equal values, nulls skipped, that no silence of more than silence_s cuts. spike: of the values
    that a Hampel filter (rolling median and median absolute deviation) lets stand out, one to three in a row off the
    rolling medians of the readings before and after (up to five, at most near_s away), to one side, by more than times the
    median absolute change between successive readings of that source and field.

    Null keys, ids and epochs are left out; null and NaN values are no readings of that field. Empty input: no rows.
    Other columns are ignored. Blocks of 16 days with a halo of silence_s are scanned apart, so a source of any size is
    spread; runs across blocks are put together from one fragment per block end.
    """
    names = list(fields)
    specs = [(f"_v{i}", *map(float, fields[n])) for i, n in enumerate(names)]
    t = F.col(epoch).cast("bigint")
    rows = df.select(
        F.col(keys[0]).cast("string").alias("_k0"), F.col(keys[1]).cast("string").alias("_k1"), t.alias("_t"), F.col(row_id).cast("bigint").alias("_id"),
        *(F.col(n).cast("double").alias(f"_v{i}") for i, n in enumerate(names)),
    )
    for c in ("_k0", "_k1", "_t", "_id"):
        rows = rows.where(F.col(c).isNotNull())
    home = F.floor(F.col("_t") / BLOCK_S)
    spread = rows.withColumn("_home", home).withColumn(
        "_block", F.explode(F.sequence(F.floor((F.col("_t") - silence_s) / BLOCK_S), F.floor((F.col("_t") + silence_s) / BLOCK_S)))
    )
    placed = spread.withColumn("_core", F.col("_block") == F.col("_home")).drop("_home")

    def scanned(part: DataFrame, loose: float, label: str) -> DataFrame:
        # twice the session's partitions: the scan is the work, and a lump of blocks then weighs half
        tasks = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = part.repartition(tasks, "_k0", "_k1", "_block").sortWithinPartitions("_k0", "_k1", "_block", "_t", "_id")
        return written(blocks.mapInArrow(_scan(specs, min_run, silence_s, near_s, loose), _OUT_DDL), label)

    # candidates are kept by the block's own median change; the source's median decides
    loose = 2.0
    found = scanned(placed, loose, "scan")
    source = ["_k0", "_k1", "field"]
    found = found.withColumnsRenamed({"k0": "_k0", "k1": "_k1"})
    changes = found.where(F.col("kind") == STEPS).select(*source, F.inline(F.arrays_zip("x", "n"))).groupBy(*source, "x").agg(F.sum("n").alias("n"))
    # an exact median without ordering a source's changes in one task
    typical = written(quantiles(changes, source, "x", "n", (0.5,)).select(*source, F.col("value").alias("typical")), "typical")

    spikes = found.where(F.col("kind") == SPIKE)
    # blocks far livelier than their source may have dropped a true candidate: those are scanned again without that sieve
    exploded = found.where(F.col("kind") == STEPS).select(*source, "block", F.inline(F.arrays_zip("x", "n")))
    in_block = Window.partitionBy(*source, "block").orderBy("x")
    of_block = (
        exploded.withColumn("_to", F.sum("n").over(in_block))
        .withColumn("_all", F.sum("n").over(Window.partitionBy(*source, "block")))
        .groupBy(*source, "block")
        .agg(F.min(F.when(F.col("_to") >= F.expr("_all div 2 + 1"), F.col("x"))).alias("lively"))
    )
    again = written(of_block.join(typical, source).where(F.col("lively") * loose > F.col("typical") * times).select("_k0", "_k1", "block").distinct(), "again")
    if not again.isEmpty():
        part = placed.join(again.withColumnRenamed("block", "_block"), ["_k0", "_k1", "_block"], "left_semi")
        more = scanned(part, 0.0, "rescan").withColumnsRenamed({"k0": "_k0", "k1": "_k1"}).where(F.col("kind") == SPIKE)
        spikes = spikes.unionByName(more)
    spiked = spikes.join(typical, source).where(F.col("x")[0] > times * F.col("typical")).select("field", F.explode("ids").alias("_id"), F.lit("spike").alias("reason"))

    # runs: a fragment open to the left continues the one before it
    runs = found.where(F.col("kind") == RUN).withColumn("size", F.col("n")[0])
    inside = runs.where(F.col("size") >= min_run).select("field", F.explode("ids").alias("_id"), F.lit("frozen").alias("reason"))
    ends = runs.where(F.col("open_left") | F.col("open_right")).select(
        *source, "block", "size", "open_left", F.when(F.col("size") < min_run, F.col("ids")).alias("ids")
    )
    in_time = Window.partitionBy(*source).orderBy("block", F.col("open_left").desc())
    chained = ends.withColumn("_run", F.sum(F.when(F.col("open_left"), 0).otherwise(1)).over(in_time))
    long = chained.groupBy(*source, "_run").agg(F.sum("size").alias("_total"), F.flatten(F.collect_list("ids")).alias("ids"))
    across = long.where(F.col("_total") >= min_run).select("field", F.explode("ids").alias("_id"), F.lit("frozen").alias("reason"))
    bounds = found.where(F.col("kind") == BOUND).select("field", F.explode("ids").alias("_id"), F.lit("impossible").alias("reason"))
    label = F.element_at(F.array(*map(F.lit, names)), F.col("field") + 1)
    return bounds.unionByName(inside).unionByName(across).unionByName(spiked).select(F.col("_id").alias(row_id), label.alias("field_name"), "reason").distinct()
