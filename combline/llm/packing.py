"""Filling containers of fixed capacity: a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import base64
import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from combline.session import written

#: Items that one island packs. Hashing spreads them, so an island's size is bounded whatever the data hold.
ISLAND_ITEMS = 1_500
#: The public tokenizer whose tokens are counted (byte-level BPE with 50,256 ranks), and the most bytes its file may have.
TOKENIZER, VOCABULARY_BYTES = "byte_bpe_50k", 16 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def token_counts(df: DataFrame, id_col: str, text: str, path: str | None = None) -> DataFrame:
    """id_col and n_tokens of each row by the byte-level BPE whose ranks lie at path on the driver. A null text has 0 tokens.

    The vocabulary goes with the tasks, so executors need no file of their own; its size is checked.
    """
    ranks_file = Path(path or tokenizer_path()).read_bytes()
    if len(ranks_file) > VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of {len(ranks_file)} bytes is too large to go with every task")
    sent = df.sparkSession.sparkContext.broadcast(ranks_file)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in sent.value.splitlines() if line.strip())}
        enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "n_tokens": [len(t) for t in enc.encode_ordinary_batch(b["_text"].fillna("").tolist(), num_threads=1)]})

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    return rows.mapInPandas(count, "_id bigint, n_tokens bigint").withColumnRenamed("_id", id_col)


class Packing:
    """Bins of item numbers with their fill; sizes and capacity are shared by all packings of an island."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]

    def fitness(self) -> float:
        """Mean square of the fill: of packings with equally many bins the one with fuller and emptier bins is better."""
        return sum(f * f for f in self.fill) / (self.capacity**2 * max(1, len(self.bins)))

    def labels(self) -> list[int]:
        out = [0] * len(self.sizes)
        for k, b in enumerate(self.bins):
            for i in b:
                out[i] = k
        return out

    def best_fit(self, items: list[int]) -> None:
        """Puts items, in the given order, each where the least room stays; opens bins as needed."""
        room = sorted((self.capacity - f, k) for k, f in enumerate(self.fill))
        for i in items:
            s = self.sizes[i]
            at = bisect_left(room, (s, -1))
            if at < len(room):
                left, k = room.pop(at)
            else:
                k, left = len(self.bins), self.capacity
                self.bins.append([])
                self.fill.append(0)
            self.bins[k].append(i)
            self.fill[k] += s
            insort(room, (left - s, k))

    def exchange(self, loose: list[int]) -> list[int]:
        """Swaps one or two items of a bin for one or two loose ones that fill it better; gives what is loose then.

        Large items find their place this way and small ones come loose, which fit in anywhere.
        """
        sizes, cap = self.sizes, self.capacity
        free = sorted(loose, key=lambda i: sizes[i])
        for k in range(len(self.bins)):
            room = cap - self.fill[k]
            if not room or not free:
                continue
            weights = [sizes[i] for i in free]
            inside = self.bins[k]
            outs = [((i,), sizes[i]) for i in inside] + [((i, j), sizes[i] + sizes[j]) for n, i in enumerate(inside) for j in inside[n + 1 :]]
            best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
            for out, w in outs:
                at = bisect_right(weights, w + room) - 1
                if at >= 0 and weights[at] - w > best[0]:
                    best = (weights[at] - w, out, (at,))
                if len(out) == 2 and best[0] < room:
                    # two loose ones: from both ends towards each other
                    lo, hi = 0, len(weights) - 1
                    while lo < hi:
                        s = weights[lo] + weights[hi]
                        if s > w + room:
                            hi -= 1
                        else:
                            if s - w > best[0]:
                                best = (s - w, out, (lo, hi))
                            lo += 1
                if best[0] == room:
                    break
            gain, out, into = best
            if gain:
                taken = [free[a] for a in into]
                self.bins[k] = [i for i in inside if i not in out] + taken
                self.fill[k] += gain
                for a in sorted(into, reverse=True):
                    free.pop(a)
                for i in out:
                    insort(free, i, key=lambda x: sizes[x])
        return free[::-1]


def first_packings(sizes: list[int], capacity: int, count: int, rng: random.Random) -> list[Packing]:
    """Items in random order, each where it fits best: packings that differ and that crossover has to improve on."""
    out = []
    for _ in range(count):
        order = list(range(len(sizes)))
        rng.shuffle(order)
        p = Packing([], sizes, capacity)
        p.best_fit(order)
        out.append(p)
    return out


#: Loose items up to which bins are improved by exchanges as well; more are only best-fitted.
EXCHANGED = 160


def crossover(into: Packing, giver: Packing, rng: random.Random) -> Packing:
    """Whole well-filled bins of the giver go in; bins that share items with them are dissolved and their other items placed anew."""
    order = sorted(range(len(giver.bins)), key=lambda k: (-giver.fill[k], rng.random()))
    good = [k for k in order if giver.fill[k] >= 0.98 * giver.capacity] or order[:1]
    given = [giver.bins[k] for k in good[: max(1, rng.randint(len(good) // 4, max(1, len(good) // 2)))]]
    where = into.labels()
    hit = {where[i] for b in given for i in b}
    held = {i for b in given for i in b}
    loose = [i for k in hit for i in into.bins[k] if i not in held]
    kept = sorted((k for k in range(len(into.bins)) if k not in hit), key=lambda k: into.fill[k])
    # the emptiest bins are dissolved too, so that their items can close gaps elsewhere
    cut = max(1, len(kept) // 20)
    loose += [i for k in kept[:cut] for i in into.bins[k]]
    child = Packing([into.bins[k] for k in kept[cut:]] + [list(b) for b in given], into.sizes, into.capacity)
    child.bins = [list(b) for b in child.bins]
    if len(loose) <= EXCHANGED:
        loose = child.exchange(loose)
    else:
        loose.sort(key=lambda i: -into.sizes[i])
    child.best_fit(loose)
    return child


@dataclass
class Evolution:
    """The best packing, the bins of the best start, the volume bound, and how many generations of crossover ran."""

    best: Packing
    start_bins: int
    bound: int
    generations: int


def evolve(sizes: list[int], capacity: int, seeds: list[list[list[int]]], population: int, generations: int, least: int, seed: int) -> Evolution:
    """Evolves packings from the seeds and random ones.

    Crossover runs for generations rounds; it ends sooner only after least rounds, and only with as few bins as the volume
    allows. With a single item there is nothing to cross.
    """
    rng = random.Random(seed)
    pool = [Packing([list(b) for b in s], sizes, capacity) for s in seeds]
    pool += first_packings(sizes, capacity, max(1, population - len(pool)), rng)
    key = lambda x: (len(x[2].bins), -x[0], x[1])
    ranked = sorted(((p.fitness(), k, p) for k, p in enumerate(pool)), key=key)
    bound = max(1, -(-sum(sizes) // capacity))
    start, serial, ran = len(ranked[0][2].bins), len(ranked), 0
    for g in range(generations if len(sizes) > 1 and len(ranked) > 1 else 0):
        if g >= least and len(ranked[0][2].bins) <= bound:
            break
        a, b = rng.sample(ranked[: max(2, (len(ranked) + 1) // 2)], 2)
        for into, giver in ((a[2], b[2]), (b[2], a[2])):
            child = crossover(into, giver, rng)
            ranked.append((child.fitness(), serial, child))
            serial += 1
        ranked = sorted(ranked, key=key)[:population]
        ran += 1
    return Evolution(ranked[0][2], start, bound, ran)


def _bins(label: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(label):
        out.setdefault(k, []).append(i)
    return list(out.values())


_ISLAND = "shard bigint, island int, label array<int>, bins int, fitness double, generations int"


def _epoch(capacity: int, population: int, generations: int, least: int, epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                seeds = [_bins(list(x)) for x in (getattr(r, "label", None), getattr(r, "migrant", None)) if x is not None]
                e = evolve([int(s) for s in r.sizes], capacity, seeds, population, generations, least, hash((int(r.shard), int(r.island), epoch)))
                rows.append((r.shard, r.island, e.best.labels(), len(e.best.bins), e.best.fitness(), e.generations))
            yield pd.DataFrame(rows, columns=["shard", "island", "label", "bins", "fitness", "generations"])

    return run


@dataclass(frozen=True)
class Search:
    """How much is searched: islands per shard, epochs between migrations, packings per island, rounds of crossover per epoch and the least of them."""

    islands: int = 2
    epochs: int = 2
    population: int = 6
    generations: int = 24
    least: int = 4


def _round(items: DataFrame, count: int, capacity: int, search: Search, salt: int) -> DataFrame:
    """shard, bin, id, size of a packing of items (id, size)."""
    spark = items.sparkSession
    shards = max(1, -(-count // ISLAND_ITEMS))
    sea = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(shards)))
    held = sea.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("id", "size"))).alias("h"))
    held = written(held.select("shard", F.col("h.id").alias("ids"), F.col("h.size").alias("sizes")), f"shards-{salt}")
    # a task runs many islands; their number follows the session, not the data
    tasks = min(shards * search.islands, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    state = held.select("shard", F.explode(F.sequence(F.lit(0), F.lit(search.islands - 1))).alias("island"))
    for k in range(search.epochs):
        if k:
            # the best of each island goes on to the next one of the same shard
            elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(search.islands)).alias("island"), F.col("label").alias("migrant"))
            state = state.select("shard", "island", "label").join(elite, ["shard", "island"])
        work = state.join(held.select("shard", "sizes"), "shard").repartition(tasks, "shard", "island")
        state = written(work.mapInPandas(_epoch(capacity, search.population, search.generations, search.least, k), _ISLAND), f"islands-{salt}-{k}")
    # fewest bins, then the fuller ones; of equal ones the first island
    best = state.groupBy("shard").agg(F.min(F.struct("bins", (-F.col("fitness")).alias("f"), "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
    flat = state.join(best, ["shard", "island"]).select("shard", "label").join(held, "shard").select("shard", F.inline(F.arrays_zip("ids", "sizes", "label")))
    return flat.select("shard", F.col("label").alias("bin"), F.col("ids").alias("id"), F.col("sizes").alias("size"))


def pack(counts: DataFrame, id_col: str, size: str, capacity: int = 2048, search: Search = Search(), settled: float = 0.995) -> DataFrame:
    """id_col, piece, container, piece_size, size: in which container(s) each item lies.

    No container holds more than capacity. An item stays whole (piece 0) unless it is larger than capacity: then its
    first pieces fill containers of their own and the rest is packed like an item. An item of size 0 lies in a container
    too. An id that occurs several times counts once, with its largest size; null ids and sizes are left out. Empty
    input: no rows. Ties are broken by id and fixed seeds: the same input gives the same containers.

    Items are dealt to shards of about ISLAND_ITEMS by hash. Each shard is packed on several islands, each a grouping
    genetic algorithm of its own that starts from random packings; between epochs the best packing of each island migrates
    to the next. All containers come from it. Those filled to settled are kept; the items of all others are dealt anew and packed once more, so that what is left over
    in one shard meets what is left over in others.
    """
    rows = counts.where(F.col(id_col).isNotNull() & F.col(size).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(size).cast("bigint").alias("total"))
    rows = written(rows, "sizes")
    spill = F.when(F.col("total") > capacity, F.floor(F.col("total") / capacity)).otherwise(0).cast("int")
    rest = F.col("total") - spill * capacity
    full = rows.where(F.col("total") > capacity).select("id", F.explode(F.sequence(F.lit(0), spill - 1)).alias("piece"), F.lit(capacity).cast("bigint").alias("piece_size"))
    full = full.select("id", "piece", F.concat_ws("-", F.lit("f"), "id", "piece").alias("container"), "piece_size")
    loose = rows.select("id", rest.alias("size"), spill.alias("piece")).where((F.col("size") > 0) | (F.col("piece") == 0))

    first = _round(loose.select("id", "size"), loose.count(), capacity, search, 1)
    fill = written(first.groupBy("shard", "bin").agg(F.sum("size").alias("fill"), F.collect_list(F.struct("id", "size")).alias("held")), "first")
    kept = fill.where(F.col("fill") >= settled * capacity).select(F.concat_ws("-", F.lit("a"), "shard", "bin").alias("container"), F.inline("held"))
    again = fill.where(F.col("fill") < settled * capacity).select(F.inline("held"))
    second = _round(again, again.count(), capacity, search, 2)
    second = second.select(F.concat_ws("-", F.lit("b"), "shard", "bin").alias("container"), "id", "size")
    placed = kept.unionByName(second).join(loose.select("id", "piece"), "id")
    placed = placed.select("id", "piece", "container", F.col("size").alias("piece_size")).unionByName(full)
    return placed.join(rows, "id").select(F.col("id").alias(id_col), "piece", "container", "piece_size", F.col("total").alias(size))


def packing_faults(packed: DataFrame, counts: DataFrame, id_col: str, size: str, capacity: int, slack: float = 1.01) -> DataFrame:
    """One row: items, overfull containers, items split without need, items lost or placed more than once, and whether there are at most slack times the volume bound (and one more) containers."""
    wanted = counts.where(F.col(id_col).isNotNull() & F.col(size).isNotNull()).groupBy(id_col).agg(F.max(size).alias("_w"))
    per = packed.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), F.sum("piece_size").alias("_s"))
    items = wanted.join(per, id_col, "left").agg(
        F.count(F.lit(1)).alias("items"), F.count_if((F.col("_w") <= capacity) & (F.col("_n") > 1)).alias("split"), F.count_if(F.col("_s").isNull() | (F.col("_s") != F.col("_w"))).alias("lost"), F.coalesce(F.sum("_w"), F.lit(0)).alias("_v")
    )
    bins = packed.groupBy("container").agg(F.sum("piece_size").alias("_f")).agg(F.count_if(F.col("_f") > capacity).alias("overfull"), F.count(F.lit(1)).alias("_c"))
    near = F.col("_c") <= F.ceil(F.col("_v") / capacity) * slack + 1
    return items.join(bins).select("items", "overfull", "split", "lost", near.alias("near_bound"))
