import random

from combline.llm import leakage
from combline.llm.leakage import ItemIndex, leaked_items, words_of


def brute(docs, items, m):
    grams = {i: {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} for i, t in items for w in [words_of(t or "")]}
    out = set()
    for d, t in docs:
        w = words_of(t or "")
        have = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}
        out |= {(d, i) for i, g in grams.items() if g & have}
    return out


def tables(seed=3, docs=200, items=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(80)]
    its = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(items)]
    out = []
    for d in range(docs):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.6:
            source = its[rng.randrange(items)][1].split()
            n = rng.randint(8, 20)
            a = rng.randrange(max(1, len(source) - n))
            at = rng.randrange(len(words) + 1)
            words[at:at] = source[a : a + n]
        out.append((d, rng.choice([" ", "\n", ", "]).join(words)))
    return out, its


def test_index_loses_nothing_against_brute_force():
    docs, items = tables()
    index = ItemIndex(items, 12)
    got = {(d, i) for d, t in docs for i in index.leaks(t)}
    assert got == brute(docs, items, 12) and got


def test_long_texts_in_stripes():
    docs, items = tables(5, docs=3)
    source = next(t for _, t in items if len(t.split()) > 20)
    text = " ".join(["w1 w2 w3 w4 w5"] * 3_000) + " " + source + " " + " ".join(["w9 w8"] * 3_000)
    index = ItemIndex(items, 12)
    assert index.leaks(text) == {i for _, i in brute([(0, text)], items, 12)}


def test_operator(spark, monkeypatch):
    docs, items = tables(7)
    docs += [(900, None), (901, ""), (902, items[0][1] + " x"), (902, items[0][1] + " x"), (None, items[0][1])]
    items += [(None, "a b c"), (500, None), (501, "short one")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as i")
    i = spark.createDataFrame(items, "item_id long, item_text string").selectExpr("*", "3 as doc_id", "4 as t")
    want = brute([x for x in docs if x[0] is not None], [x for x in items if x[0] is not None], 12)
    run = lambda: sorted((r.doc_id, r.item_id) for r in leaked_items(d, i, "doc_id", "text", "item_id", "item_text", 12).collect())
    assert run() == sorted(want)
    monkeypatch.setattr(leakage, "INDEX_ITEMS", 20)  # several parts give the same
    assert run() == sorted(want)
    assert leaked_items(d.limit(0), i, "doc_id", "text", "item_id", "item_text").collect() == []
    assert leaked_items(d, i.limit(0), "doc_id", "text", "item_id", "item_text").collect() == []


def test_words():
    assert words_of("Ab­c, d​e_F 1.5") == ["abc", "de", "f", "1", "5"]
