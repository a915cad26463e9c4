"""Sensor faults: impossible values, sudden jumps against the last reading that was kept, and runs that are let back in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from combline.config import Thresholds
from combline.operators.outliers import group_chunks, group_starts
from combline.operators.steps import HOUR, STEP_SUMS, halo
from combline.session import written

SLOT_H = 2


def _outside(named: list[tuple[str, str, str, str]], cfg: Thresholds) -> Column:
    """Names of the measures outside their bounds (limits allowed); a null measure is not outside."""
    return F.array_compact(F.array(*(F.when(~F.col(c).between(cfg[f"quality.bounds.{lo}"], cfg[f"quality.bounds.{hi}"]), name) for name, c, lo, hi in named)))


_INSIDE = [("weight", "w", "min_weight_kg", "max_weight_kg"), ("temperature", "t", "min_internal_temp_f", "max_internal_temp_f"), ("humidity", "h", "min_humidity_pct", "max_humidity_pct")]


def impossible_reasons(cfg: Thresholds) -> Column:
    return _outside(_INSIDE, cfg)


def possible(cfg: Thresholds) -> Column:
    """Whether impossible_reasons names none, by comparisons alone."""
    ok = F.lit(True)
    for _, c, lo, hi in _INSIDE:
        ok = ok & F.coalesce(F.col(c).between(cfg[f"quality.bounds.{lo}"], cfg[f"quality.bounds.{hi}"]), F.lit(True))
    return ok


_OUTSIDE = [("external temperature", "et", "min_external_temp_f", "max_external_temp_f"), ("external humidity", "eh", "min_humidity_pct", "max_humidity_pct")]


def external_reasons(cfg: Thresholds) -> Column:
    """What is wrong with the sensors outside; such readings are noted and kept."""
    return _outside(_OUTSIDE, cfg)


def jump_reasons(before: dict[str, Column], now: dict[str, Column], cfg: Thresholds) -> Column:
    """Measures w, t, h that moved too far from before to now; none if the two are not 0 to the limit of hours apart."""
    j = "quality.jumps."
    elapsed = (now["wall"] - before["wall"]) / 3600.0
    near = (elapsed > 0) & (elapsed <= cfg[j + "max_jump_interval_hours"])
    dw = F.abs(now["w"] - before["w"])
    share = F.when(before["w"] != 0, dw / before["w"] * 100).otherwise(0.0)
    tests = [
        ("weight", (dw > cfg[j + "max_weight_jump_kg"]) & (share > cfg[j + "max_weight_jump_pct"])),
        ("temperature", F.abs(now["t"] - before["t"]) > cfg[j + "max_temp_jump_f"]),
        ("humidity", F.abs(now["h"] - before["h"]) > cfg[j + "max_humidity_jump_pct"]),
    ]
    return F.array_compact(F.array(*(F.when(near & test, name) for name, test in tests)))


def settling(readings: DataFrame, events: DataFrame, cfg: Thresholds) -> DataFrame:
    """readings with settling: at most the settle time after an event of the colony, both ends included."""
    span = int(cfg["quality.jumps.event_settle_window_hours"] * HOUR)
    bucket = lambda c: F.floor(c / span)
    # events of a colony keep apart by more than the confirmation time, so a bucket holds few distinct instants
    near = events.select("colony_id", F.col("wall").alias("e"), F.explode(F.array(bucket(F.col("wall")), bucket(F.col("wall")) + 1)).alias("_b"))
    near = near.groupBy("colony_id", "_b").agg(F.collect_set("e").alias("_es"))
    out = readings.withColumn("_b", bucket(F.col("wall"))).join(near.hint("shuffle_hash"), ["colony_id", "_b"], "left")
    hit = F.exists("_es", lambda e: (F.col("wall") >= e) & (F.col("wall") <= e + span))
    return out.withColumn("settling", F.coalesce(hit, F.lit(False))).drop("_b", "_es")


_ORDERED = """colony_id string, hive_id string, colony_side string, ord bigint, ts bigint, wall bigint, day date, w double, t double, h double, et double, eh double,
seq bigint, since bigint, sure boolean, after boolean, head boolean, tail boolean, p_w double, p_wall bigint, p_t double, p_h double, a_ord bigint, a_wall bigint, a_w double, a_t double, a_h double"""
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "date": pa.date32(), "double": pa.float64(), "boolean": pa.bool_()}
#: Of a row of sums, seq, wall and w are those of its first reading.
_SUMMED = "n bigint, seq1 bigint, wall1 bigint, w1 double, lo bigint, hi bigint, sx double, sw double, sxx double, sxw double"
_DIGESTED = f"{_ORDERED.replace('hive_id string, colony_side string', '_hive int')}, {_SUMMED}"


def _in_order(cfg: Thresholds, digest: bool = False):
    """Tells of each reading of a block, all of which lie together and in order, what prepared says of it; or the few of these and sums, as digested has them."""
    j = "quality.jumps."
    kg, pct, temp, hum = (float(cfg[j + k]) for k in ("max_weight_jump_kg", "max_weight_jump_pct", "max_temp_jump_f", "max_humidity_jump_pct"))
    pct *= 1 - 1e-9  # the share is rounded; rather one suspect more
    back, slot_s = _slots_back(cfg), SLOT_H * HOUR
    bounds = [(c, float(cfg[f"quality.bounds.{lo}"]), float(cfg[f"quality.bounds.{hi}"])) for _, c, lo, hi in _INSIDE]
    e = "events."
    limit, gain, floor_pct, floor_kg = (float(cfg[e + k]) for k in ("max_event_interval_hours", "addition_floor_kg", "harvest_floor_pct", "harvest_floor_kg"))
    span = int(cfg[e + "confirmation_window_hours"] * HOUR)
    up = lambda x: np.concatenate((x[:1], x[:-1]))
    outside = [(c, float(cfg[f"quality.bounds.{lo}"]), float(cfg[f"quality.bounds.{hi}"])) for _, c, lo, hi in _OUTSIDE]
    given = ("colony_id", *(("_hive",) if digest else ("hive_id", "colony_side")), "ord", "ts", "wall", "day", "w", "t", "h", "et", "eh")

    shape = pa.schema([(c, _ARROW[k]) for c, k in (x.split() for x in _DIGESTED.split(","))])

    def summed(b: pa.Table, at: np.ndarray, group: np.ndarray, day: np.ndarray, seq: np.ndarray, since: np.ndarray, wall: np.ndarray, w: np.ndarray) -> dict[str, pa.Array]:
        """Sums over the readings at, one row for each stretch of a day between steps."""
        g, d, k, wall, w = group[at], day[at], since[at], wall[at], w[at]
        cut = np.ones(len(at), bool)
        cut[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(at)) - 1
        x = wall / 86_400.0 - 19_000.0
        add = lambda v: np.add.reduceat(v, first)
        own = {"colony_id": b.column("colony_id").take(pa.array(at[first])), "_hive": b.column("_hive").take(pa.array(at[first])), "wall": wall[first], "day": b.column("day").take(pa.array(at[first])), "w": w[first], "seq": seq[at[first]], "since": k[first]}
        own |= {"n": last - first + 1, "seq1": seq[at[last]], "wall1": wall[last], "w1": w[last], "lo": np.minimum.reduceat(wall, first), "hi": np.maximum.reduceat(wall, first), "sx": add(x), "sw": add(w), "sxx": add(x * x), "sxw": add(x * w)}
        return {c: v if isinstance(v, pa.ChunkedArray | pa.Array) else pa.array(v) for c, v in own.items()}

    def as_digest(own: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        flat = lambda v: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        return pa.RecordBatch.from_arrays([flat(own[f.name]).cast(f.type) if f.name in own else pa.nulls(n, f.type) for f in shape], schema=shape)

    def reach(x, slot_of, starts, group, slot):
        """Least and greatest of x, NaN left out, in the slot of each reading and the back ones before."""
        out = []
        for f in (np.fmin, np.fmax):
            own = f.reduceat(x, starts)
            wide = own.copy()
            for k in range(1, min(back, len(own) - 1) + 1):
                near = (group[k:] == group[:-k]) & (slot[k:] - slot[:-k] <= back)
                wide[k:] = f(wide[k:], np.where(near, own[:-k], np.nan))
            out.append(wide[slot_of])
        return out

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in group_chunks(batches, ["colony_id", "_block"]):
            col = {c: b.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("ord", "ts", "wall", "w", "t", "h", "_block", "_core")}
            n, at, core, wall = b.num_rows, np.arange(b.num_rows), col["_core"], col["wall"]
            starts = group_starts(b, ["colony_id", "_block"])
            new = np.zeros(n, bool)
            new[starts] = True
            start = np.repeat(starts, np.diff(np.append(starts, n)))
            group = np.cumsum(new)
            with np.errstate(all="ignore"):
                # steps; as in SQL, NaN is above all numbers
                before = {c: up(col[c]) for c in ("w", "wall", "t", "h")}
                w, pw = col["w"], before["w"]
                elapsed, delta = (wall - before["wall"]) / 3600.0, w - pw
                drop = (delta < 0) & (np.abs(delta / pw * 100) >= floor_pct) & (np.abs(delta) >= floor_kg)
                step = ~new & (elapsed > 0) & (elapsed <= limit) & ~(pw <= 0) & ~(w <= 0) & (~(delta < gain) | drop)
                # the latest clock of the steps so far and the earliest of those to come, group after group
                clock = wall - wall.min() + 1
                most = clock.max() + 1
                lift = (group - 1) * most
                latest = np.maximum.accumulate(np.where(step, clock, 0) + lift) - lift
                soonest = np.minimum.accumulate((np.where(step, clock, most) + lift)[::-1])[::-1]
                soonest = np.append(soonest[1:], lift[-1] + most) - lift
                after = (latest > 0) & (clock - latest <= span)
                seq = (col["_block"] << 32) + (at - start + 1)
                mark = np.maximum.accumulate(np.where(step & core, at, -1))
                since = np.where(mark >= start, seq[mark], col["_block"] << 32)
                since = np.where((clock < latest) | (clock >= soonest), ~seq, since)  # where the clock ran back, on their own
                # sure ones
                ok = np.ones(n, bool)
                for c, lo, hi in bounds:
                    ok &= (col[c] >= lo) & (col[c] <= hi)
                slot = col["ts"] // slot_s
                fresh = new.copy()
                fresh[1:] |= slot[1:] != slot[:-1]
                first = np.flatnonzero(fresh)
                slots = (np.cumsum(fresh) - 1, first, group[first], slot[first])
                far = np.zeros(n, bool)
                for c, most in (("w", kg), ("t", temp), ("h", hum)):
                    x = np.where(ok, col[c], np.nan)
                    lo, hi = reach(x, *slots)
                    fall, rise = hi - x > most, x - lo > most
                    if c == "w":  # the share, too, is largest against the least and the greatest weight
                        fall &= (hi - x) / hi * 100 > pct
                        rise &= (lo <= 0) | ((x - lo) / lo * 100 > pct)
                    far |= fall | rise
            sure = ok & ~far
            known = core & sure  # what a halo row says of itself is not sure, as its own hours before are not all here
            anchor = np.maximum.accumulate(np.where(known, at, -1))
            none = sure | (anchor < start)
            last = np.maximum.reduceat(np.where(known, at, -1), starts)
            tail = np.zeros(n, bool)
            tail[last[last >= 0]] = True
            head = core & (new | ~up(core))
            more = {"seq": seq, "since": since, "sure": sure, "after": after, "head": head, "tail": tail}
            out = {c: b.column(c).combine_chunks() for c in given} | {c: pa.array(v) for c, v in more.items()}
            out |= {f"p_{c}": pa.array(before[c], mask=~step) for c in ("w", "wall", "t", "h")}
            out |= {f"a_{c}": pa.array(col[c][anchor], mask=none) for c in ("ord", "wall", "w", "t", "h")}
            rows = pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
            if not digest:
                yield rows if core.all() else rows.filter(pa.array(core))
                continue
            odd = np.zeros(n, bool)
            for c, lo, hi in outside:
                v = b.column(c).combine_chunks()
                x = v.to_numpy(zero_copy_only=False)
                odd |= v.is_valid().to_numpy(zero_copy_only=False) & ~((x >= lo) & (x <= hi))
            rows = rows.filter(pa.array(core & (~sure | after | head | tail | odd)))
            yield as_digest({c: rows.column(c) for c in rows.schema.names}, rows.num_rows)
            if len(at := np.flatnonzero(known)):
                day = b.column("day").combine_chunks().cast(pa.int32()).to_numpy(zero_copy_only=False)
                own = summed(b, at, group, day, seq, since, wall, w)
                yield as_digest(own, len(own["n"]))

    return tell


def _slots_back(cfg: Thresholds) -> int:
    return -(-(int(cfg["quality.jumps.max_jump_interval_hours"]) + 2) // SLOT_H)


def prepared(readings: DataFrame, cfg: Thresholds) -> DataFrame:
    """readings with what one pass in order tells of them; seq becomes a long that orders the readings of a colony as before.

    p_<col> are the measures of the reading before, if it steps from that one, else null. after: at most the confirmation
    time after a step. since: the same for readings with the same steps of the block before and after them, by order and by clock. bad names impossible measures.
    sure: possible, and no possible reading that could still be the anchor is a jump away, so this one is kept in any case;
    a_<col> are those of the last sure reading of the block. head and tail: the block's first reading and its last sure one.

    The hours before are looked at as frames of whole SLOT_H hours, so least and greatest values are found once a slot
    however dense the readings are. A frame may hold a little more than it must; then sure is false and the fold decides.
    A block is held at once: 1.4 million readings at one a second.
    """
    return _blocks(readings, ["hive_id", "colony_side"], cfg).mapInArrow(_in_order(cfg), _ORDERED).withColumn("bad", _bad(cfg))


def _blocks(readings: DataFrame, more: list, cfg: Thresholds) -> DataFrame:
    # a step in the halo that confirms must see the reading before it
    back = max((_slots_back(cfg) + 1) * SLOT_H, cfg["events.confirmation_window_hours"] + 2 + cfg["events.max_event_interval_hours"] + 2)
    near = halo(readings.drop("seq"), "ts", before_s=int(back * HOUR))
    cols = ["colony_id", *more, "ord", "ts", "wall", "day", *(F.col(c).cast("double").alias(c) for c in ("w", "t", "h", "et", "eh")), "_block", "_core"]
    return near.select(*cols).repartition("colony_id", "_block").sortWithinPartitions("colony_id", "_block", "ts", "ord")


def _bad(cfg: Thresholds) -> Column:
    return F.when(possible(cfg), "").otherwise(F.array_join(impossible_reasons(cfg), ", "))  # names are made for the few


def digested(readings: DataFrame, cfg: Thresholds) -> DataFrame:
    """What the stages up to the features need of prepared readings, from one pass that writes no more than that: rows of the
    few (n is null) with all that prepared says, and sums over the sure readings of each stretch of a day between steps.

    few_of and sums_of tell them apart. Every reading is in one of the two, the sure ones of the few in both. colony_id is hive_id:colony_side, as readings_of makes it."""
    return _blocks(readings, [F.length("hive_id").alias("_hive")], cfg).mapInArrow(_in_order(cfg, digest=True), _DIGESTED)


def _named(digest: DataFrame) -> dict[str, Column]:
    return {"hive_id": F.substring("colony_id", F.lit(1), F.col("_hive")), "colony_side": F.substring("colony_id", F.col("_hive") + 2, F.length("colony_id"))}


def few_of(digest: DataFrame, cfg: Thresholds) -> DataFrame:
    """few of the readings, and those with odd values outside."""
    return digest.where("n is null").withColumns(_named(digest) | {"bad": _bad(cfg)}).drop("_hive", *(c.split()[0] for c in _SUMMED.split(", ")))


def sums_of(digest: DataFrame) -> DataFrame:
    """steps.step_sums of the sure readings; a stretch may come in several rows."""
    named = digest.where("n is not null").withColumns(_named(digest)).withColumnsRenamed({"seq": "seq0", "w": "w0", "wall": "wall0"})
    return named.select(*STEP_SUMS)


def last_seen(digest: DataFrame) -> DataFrame:
    """colony_id and a wall, among which are the last ones of all readings."""
    return digest.select("colony_id", F.coalesce("hi", "wall").alias("wall"))


_SAID = [("kept", "boolean"), ("reasons", "string"), ("note_kg", "double"), ("note_n", "int")]
_KEPT = (True, None, None, None)


def _fold(cfg: Thresholds, own: list[str]):
    """Reads the suspects of each island in order, one batch after another, and gives their own columns with what is decided on
    them; only the anchor, the pending run and the batches that this run lies in are held."""
    j = "quality.jumps."
    limit_h, kg, pct, temp, hum = (float(cfg[j + k]) for k in ("max_jump_interval_hours", "max_weight_jump_kg", "max_weight_jump_pct", "max_temp_jump_f", "max_humidity_jump_pct"))
    run = int(cfg[j + "consistent_run_to_accept"])
    kinds = [_ARROW[k] for _, k in _SAID]

    def jumps(a: tuple, b: tuple) -> str:
        hours = (b[0] - a[0]) / 3600.0
        if not 0 < hours <= limit_h:
            return ""
        dw = abs(b[1] - a[1])
        found = [n for n, hit in (("weight", dw > kg and (dw / a[1] * 100 if a[1] else 0.0) > pct), ("temperature", abs(b[2] - a[2]) > temp), ("humidity", abs(b[3] - a[3]) > hum)) if hit]
        return ", ".join(found)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, anchor, pending = None, None, []
        held: list[tuple[pa.RecordBatch, list]] = []

        def flush() -> None:
            for said, i, _, why in pending:
                said[i] = (False, why, None, None)
            pending.clear()

        def settled() -> Iterator[pa.RecordBatch]:
            while held and not (pending and pending[0][0] is held[0][1]):
                b, said = held.pop(0)
                more = [pa.array(v, k) for v, k in zip(zip(*said), kinds)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *more], names=[*own, *(c for c, _ in _SAID)])

        for b in batches:
            if not b.num_rows:
                continue
            said: list = [None] * b.num_rows
            held.append((b, said))
            key = lambda i: (b.column("colony_id")[i].as_py(), b.column("island")[i].as_py())  # noqa: B023, E731
            new = np.zeros(b.num_rows, bool)
            new[group_starts(pa.Table.from_batches([b]), ["colony_id", "island"])] = True
            new[0] = key(0) != island
            island = key(b.num_rows - 1)
            bad = b.column("bad").to_pylist()
            cols = [b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("wall", "w", "t", "h", "settling", "a_wall", "a_w", "a_t", "a_h")]
            for i, (fresh, faulty, wall, w, t, h, settles, aw, a1, a2, a3) in enumerate(zip(new.tolist(), bad, *cols)):
                if fresh:
                    flush()
                    anchor = None if aw is None or aw != aw else (aw, a1, a2, a3)
                now = (wall, w, t, h)
                if faulty:
                    flush()
                    said[i] = (False, faulty, None, None)
                    continue
                why = jumps(anchor, now) if anchor and not settles else ""
                if not why:
                    flush()
                    said[i] = _KEPT
                    anchor = now
                    continue
                if pending and jumps(pending[-1][2], now):
                    flush()
                pending.append((said, i, now, why))
                if len(pending) >= run:
                    shift = abs(pending[-1][2][1] - anchor[1])
                    for k, (those, at, _, _) in enumerate(pending):
                        those[at] = _KEPT if k else (True, None, shift, len(pending))
                    anchor = now
                    pending.clear()
            yield from settled()
        flush()
        yield from settled()

    return fold


def few(ordered: DataFrame) -> DataFrame:
    """Of prepared readings those that steps, their confirmation and the fold look at."""
    return ordered.where(~F.col("sure") | F.col("after") | F.col("head") | F.col("tail"))


def judged(readings: DataFrame, events: DataFrame, cfg: Thresholds, some: DataFrame | None = None) -> DataFrame:
    """readings with kept, reasons (why not, null if kept), and note_kg and note_n on the first reading of a run let back in.

    A reading is judged against the last one that was kept: impossible values never are; a jump is held back, and let in
    again once the given number of held-back readings in a row agree with each other; readings just after an event are
    kept. Null weights, temperatures and humidities are no readings. Empty input: no rows. Equal ids of a colony are taken
    to be one reading.

    What depends on earlier decisions is folded, but most readings do not: one that is no jump away from any reading of
    the hours before is kept whatever came before, and from there the state is known. Only the stretches between such
    readings go through the fold, each on its own and as a stream, so a colony's length is no matter. readings may be
    prepared ones; the result's seq is theirs. some: few of them, if that has been written.
    """
    r = readings if "sure" in readings.columns else written(prepared(readings, cfg), "prepared")
    return undoubted(r).unionByName(decided(few(r) if some is None else some, events, cfg))


_ANCHORS = ("ord", "wall", "w", "t", "h")


def _bare(df: DataFrame) -> DataFrame:
    return df.drop("sure", "bad", "after", "head", "tail", *(f"a_{c}" for c in _ANCHORS), *(f"p_{c}" for c in ("w", "wall", "t", "h")))


def undoubted(readings: DataFrame) -> DataFrame:
    """The sure ones of prepared readings in the shape of judged."""
    return _bare(readings.where("sure")).withColumns({"kept": F.lit(True), "reasons": F.lit(None).cast("string"), "note_kg": F.lit(None).cast("double"), "note_n": F.lit(None).cast("int")})


def decided(some: DataFrame, events: DataFrame, cfg: Thresholds) -> DataFrame:
    """The others, as the fold decides on them. some: the few of prepared readings."""
    block = F.shiftright("seq", 32).alias("_blk")
    anchors = _ANCHORS
    # the last sure reading before each suspect: within the block, else the last one of an earlier block
    at = F.when(F.col("tail"), F.col("seq"))
    ends = some.where(F.col("head") | F.col("tail")).groupBy("colony_id", block).agg(*(F.max_by(c, at).alias(f"e_{c}") for c in anchors))
    earlier = Window.partitionBy("colony_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("colony_id", "_blk", *(F.last(f"e_{c}", ignorenulls=True).over(earlier).alias(f"c_{c}") for c in anchors))
    suspects = settling(some.where(~F.col("sure")), events, cfg)
    first = suspects.withColumn("_blk", block).join(carry.hint("shuffle_hash"), ["colony_id", "_blk"], "left").drop("_blk")
    inside = F.col("a_ord").isNotNull()
    first = first.withColumns({"island": F.coalesce("a_ord", "c_ord")} | {f"a_{c}": F.when(inside, F.col(f"a_{c}")).otherwise(F.col(f"c_{c}")) for c in anchors[1:]})
    first = first.withColumn("island", F.coalesce(F.col("island").cast("string"), F.lit("")))
    own = _bare(some).columns
    ordered = first.select(*own, "island", "bad", "settling", *(f"a_{c}" for c in anchors[1:])).repartition("colony_id", "island").sortWithinPartitions("colony_id", "island", "seq")
    said = T.StructType([*(some.schema[c] for c in own), *T.StructType.fromDDL(", ".join(map(" ".join, _SAID)))])
    # rows go through the fold with all their columns, so that nothing is joined to what was decided
    return written(ordered.mapInArrow(_fold(cfg, own), said), "decided")


def quality_flags(judged_readings: DataFrame, cfg: Thresholds) -> DataFrame:
    """colony_id, ord, day, flag (excluded, missed event, external) and what: one row per flag raised."""
    flag = lambda name, what: F.struct(F.lit(name).alias("flag"), what.alias("what"))
    outside = F.when(possible(cfg), F.transform(external_reasons(cfg), lambda x: flag("external", x)))
    raised = F.array_compact(F.array(F.when(~F.col("kept"), flag("excluded", F.col("reasons"))), F.when(F.col("note_n").isNotNull(), flag("missed event", F.col("note_n").cast("string")))))
    every = F.concat(raised, F.coalesce(outside, F.array().cast("array<struct<flag:string,what:string>>")))
    # most readings raise nothing: plain comparisons leave them out before any array is made
    odd = lambda c, lo, hi: F.coalesce(~F.col(c).between(cfg[f"quality.bounds.{lo}"], cfg[f"quality.bounds.{hi}"]), F.lit(False))
    some = ~F.col("kept") | F.col("note_n").isNotNull() | odd("et", "min_external_temp_f", "max_external_temp_f") | odd("eh", "min_humidity_pct", "max_humidity_pct")
    return judged_readings.where(some).withColumn("_f", every).where(F.size("_f") > 0).select("colony_id", "ord", "seq", "day", F.inline("_f"))


def quality_counts(flags: DataFrame) -> DataFrame:
    """Per colony: flags, excluded readings, and distinct days with a flag."""
    return flags.groupBy("colony_id").agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("flag") == "excluded").alias("excluded"), F.count_distinct("day").alias("issue_days"))
