"""Test items leaking into training text: BM25 over the items, block-max WAND per passage, exact verification."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: BM25's usual parameters.
K1, B = 1.2, 0.75
#: Items that one index holds; more are searched in several blocks of items.
INDEX_ITEMS = 20_000
#: At most so many blocks of items have maxima of their own; a hair under 1, so that rounding loses nothing.
BLOCKS, SAFE = 128, 1 - 1e-6
#: Most characters of item texts in one index, which goes with the tasks; and stretches looked at in one go.
INDEX_CHARS, STRIPE = 32 << 20, 4_096
_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case; soft hyphens and zero-width characters are taken out first."""
    return _WORD.findall(text.translate(_INVISIBLE).lower())


class ItemIndex:
    """Inverted index of the items. Weights are BM25 weights over the least score of an item, so that 1 is the threshold.

    The least score of an item is the smallest sum of its weights over the distinct words of any of its stretches of
    min_words words: whatever passage holds such a stretch scores 1 or more, so the search loses nothing.
    """

    def __init__(self, items: list[tuple[int, str]], min_words: int = 12, block: int = 4):
        self.min_words = min_words
        # like items side by side make the block maxima tight
        texts = sorted(((i, w) for i, t in items if (w := words_of(t or "")) and len(w) >= min_words), key=lambda x: x[1])
        self.ids = [i for i, _ in texts]
        df = Counter(w for _, ws in texts for w in set(ws))
        self.term = {w: k for k, w in enumerate(sorted(df))}
        average = sum(len(w) for _, w in texts) / max(1, len(texts))
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.stretches: list[set[tuple[str, ...]]] = []
        for n, (_, ws) in enumerate(texts):
            length = K1 * (1 - B + B * len(ws) / average)
            weight = {w: math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + length) for w, c in Counter(ws).items()}
            stretches = [tuple(ws[k : k + min_words]) for k in range(len(ws) - min_words + 1)]
            least = min(sum(weight[w] for w in set(s)) for s in stretches) * (1 - 1e-9)
            for w, x in weight.items():
                postings[self.term[w]].append((n, x / least))
            self.stretches.append(set(stretches))
        self.docs = [[n for n, _ in postings[k]] for k in range(len(self.term))]
        self.weights = [[x for _, x in postings[k]] for k in range(len(self.term))]
        # the last row stands for words that no item has
        self.most = np.array([max(x) for x in self.weights] + [0.0])
        self.block = max(block, math.ceil(len(texts) / BLOCKS))
        self.block_most = np.zeros((len(self.term) + 1, math.ceil(len(texts) / self.block)))
        for k, (docs, weights) in enumerate(zip(self.docs, self.weights)):
            np.maximum.at(self.block_most[k], np.array(docs) // self.block, weights)

    def search(self, terms: list[int], b: int) -> Iterator[int]:
        """All items of block b that score 1 or more for the distinct terms, by WAND under the block's own maxima.

        Cursors move over the postings; the pivot is the first item at which the maxima of the terms up to it reach 1.
        """
        end = (b + 1) * self.block
        lists = []
        for t in terms:
            if (most := self.block_most[t, b]) > 0:
                docs = self.docs[t]
                at = bisect_left(docs, end - self.block)
                lists.append([docs[at], at, t, most])
        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(lists):
                total += c[3]
                if total >= SAFE:
                    pivot = k
                    break
            if pivot < 0:
                return
            item = lists[pivot][0]
            if lists[0][0] == item:
                here = [c for c in lists if c[0] == item]
                if sum(self.weights[t][at] for _, at, t, _ in here) >= SAFE:
                    yield item
                self._advance(here, item + 1, end)
            else:
                self._advance(lists[:pivot], item, end)
            lists = [c for c in lists if c[0] < end]

    def _advance(self, lists: list[list], item: int, end: int) -> None:
        """Moves cursors to their first posting at or after item."""
        for c in lists:
            docs = self.docs[c[2]]
            c[1] = at = bisect_left(docs, item, c[1])
            c[0] = docs[at] if at < len(docs) else end

    def leaks(self, text: str, passage: int = 48) -> set[int]:
        """Ids of the items of which the text holds a stretch of min_words words."""
        m = self.min_words
        words = words_of(text)
        if len(words) < m or not self.ids:
            return set()
        get = self.term.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        # only where the words of a stretch can add up to 1 is there a pivot
        sums = np.concatenate(([0.0], np.cumsum(self.most[ids])))
        live = np.flatnonzero(sums[m:] - sums[:-m] >= SAFE)
        found: set[int] = set()
        if not len(live):
            return found
        for part in np.split(live, np.flatnonzero(np.diff(live) > STRIPE) + 1):
            for lo in range(int(part[0]), int(part[-1]) + 1, STRIPE):
                found |= self._stripe(words, ids, lo, min(lo + STRIPE - 1, int(part[-1])), passage)
        return found

    def _stripe(self, words: list[str], ids: np.ndarray, lo: int, hi: int, passage: int) -> set[int]:
        """Leaks in the stretches that begin at lo to hi. Block by block: stretches whose words cannot reach 1 under the block's maxima are skipped; touching ones make up a passage, which is one query."""
        m = self.min_words
        sums = np.cumsum(np.vstack((np.zeros(self.block_most.shape[1]), self.block_most[ids[lo : hi + m]])), axis=0)
        starts, blocks = np.nonzero((sums[m:] - sums[:-m] >= SAFE).T)[::-1]
        found: set[int] = set()
        k = 0
        while k < len(starts):
            e = k + 1
            while e < len(starts) and blocks[e] == blocks[k] and starts[e] == starts[e - 1] + 1 and starts[e] - starts[k] <= passage - m:
                e += 1
            a, z = lo + int(starts[k]), lo + int(starts[e - 1])
            seen = None
            for n in self.search(sorted({int(t) for t in ids[a : z + m] if t >= 0}), int(blocks[k])):
                if seen is None:
                    seen = {tuple(words[j : j + m]) for j in range(a, z + 1)}
                if not seen.isdisjoint(self.stretches[n]):
                    found.add(self.ids[n])
            k = e
        return found


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, min_words: int = 12) -> DataFrame:
    """doc_id, item_id of each document that holds at least min_words successive words of the item's text.

    Words are runs of letters and digits; letter case, punctuation, white space, line breaks and invisible characters do
    not count. Null and empty texts hold nothing; items of fewer words than min_words cannot leak. Repeated rows count
    once. Empty inputs: no rows. Other columns are ignored.

    Items and their characters are counted; up to INDEX_ITEMS and INDEX_CHARS go with the tasks as one index, more in parts
    of that size, one after another. Every passage of every document is a query, and everything at or above the threshold is verified.
    """
    known = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c"), F.coalesce(F.max(F.length("t")), F.lit(0)).alias("longest")).first()
    if size["longest"] > INDEX_CHARS:
        raise ValueError(f"an item of {size['longest']} characters is too long to go with every task")
    blocks = max(1, math.ceil(size["n"] / INDEX_ITEMS), math.ceil(2 * size["c"] / INDEX_CHARS) if size["c"] > INDEX_CHARS else 1)
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for k in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(sorted((r["i"], r["t"]) for r in part.collect()), min_words))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for b in batches:
                pairs = [(d, i) for d, t in zip(b["doc_id"], b["text"]) for i in index.value.leaks(t)]
                yield pd.DataFrame(pairs, columns=["doc_id", "item_id"])

        found = rows.mapInPandas(search, "doc_id bigint, item_id bigint")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
