import random
from collections import Counter

import pytest

from combline.llm.packing import Packing, Search, evolve, pack, packing_faults, token_counts


def best_fit_falling(sizes, capacity):
    p = Packing([], sizes, capacity)
    p.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]))
    return len(p.bins)


def triplets(n, rng, capacity=1000):
    """Three by three items that fill a container exactly."""
    out = []
    for _ in range(n):
        a = rng.randint(380, 490)
        b = rng.randint(250, max(250, (capacity - a) // 2))
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crossover_runs_and_beats_best_fit(seed):
    sizes = triplets(30, random.Random(seed))
    e = evolve(sizes, 1000, [], 6, 40, 4, seed)
    assert e.generations >= 4
    assert len(e.best.bins) < e.start_bins
    assert len(e.best.bins) < best_fit_falling(sizes, 1000)
    assert Counter(i for b in e.best.bins for i in b) == Counter(range(90)) and max(e.best.fill) <= 1000


def test_halves_and_thirds():
    rng = random.Random(9)
    sizes = [rng.choice([rng.randint(620, 700), rng.randint(900, 1040), rng.randint(300, 420)]) for _ in range(300)]
    assert len(evolve(sizes, 2048, [], 6, 24, 4, 1).best.bins) < best_fit_falling(sizes, 2048)


def test_crossover_runs_even_where_the_bound_is_met_at_once():
    e = evolve([1] * 10, 100, [], 4, 20, 3, 1)
    assert e.generations == 3 and len(e.best.bins) == 1
    assert evolve([5], 10, [], 4, 20, 3, 1).generations == 0


def rows(df):
    return [(r.id, r.piece, r.container, r.piece_size, r.n) for r in df.collect()]


def test_pack(spark):
    rng = random.Random(4)
    counts = [(i, rng.randint(1, 700)) for i in range(400)] + [(1000, 0), (1001, 5000), (1002, 2048), (1002, 10), (None, 5), (1003, None)]
    df = spark.createDataFrame(counts, "id long, n long").selectExpr("id", "n", "'x' as container", "1 as label")
    search = Search(islands=2, epochs=2, population=4, generations=6, least=2)
    got = pack(df, "id", "n", 2048, search)
    f = packing_faults(got, df, "id", "n", 2048).first()
    assert (f.items, f.overfull, f.split, f.lost, f.near_bound) == (403, 0, 0, 0, True)
    pieces = sorted((p, s) for i, p, _, s, _ in rows(got) if i == 1001)
    assert pieces == [(0, 2048), (1, 2048), (2, 904)]
    assert sorted(rows(got)) == sorted(rows(pack(df, "id", "n", 2048, search)))
    assert pack(df.limit(0), "id", "n").collect() == []


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "honey and wax"), (2, ""), (3, None), (4, "<|endoftext|>"), (None, "x"), (5, "wax " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, "doc_id", "text").collect()}
    assert got[2] == got[3] == 0 and got[1] == 4 and got[4] > 1 and got[5] >= 20_000 and len(got) == 5
