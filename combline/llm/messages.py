"""A small classifier of short messages: hashed words, word pairs, letter groups and shape, with a softmax on top."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np

from combline.llm.phrases import LATIN, examples, slot_examples

BUCKETS = 1 << 16
#: How many labelled messages the classifiers are fitted on. The bound holds whatever the corpus: none of its rows is used.
EXAMPLES, SLOT_EXAMPLES = 10_000, 2_400
SLOT, MARK, FILL, NUMBER, ANY = "<S>", "<M>", "<F>", "<N>", "<*>"
_TOKEN = re.compile(r"<[SMFN*]>|[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[^\w\s]")
_PERSON = {"i", "i'm", "i've", "my", "we", "our", "us", "she", "he", "her", "his", "me", "ich", "wir", "mein", "unser", "yo", "mi", "nosotros", "je", "j'ai", "nous", "mon", "notre"}


def _cell(x: str) -> int:
    return zlib.crc32(x.encode()) % BUCKETS


def features(text: str) -> np.ndarray:
    """Distinct feature numbers of a message."""
    shape = []
    for k, v in (("quote", '"“”„«»`'), ("brace", "{}"), ("angle", "<>"), ("pipe", "|·»")):
        n = sum(text.count(c) for c in v) - (2 * len(re.findall(r"<[SMFN*]>", text)) if k == "angle" else 0)
        if n:
            shape.append(f"{k}:{min(n, 3)}")
    # slots and marks alike are what a sentence is about
    low = text.replace(MARK, SLOT).lower().replace("<s>", SLOT).replace("<n>", NUMBER).replace("<f>", FILL).replace("’", "'")
    words = _TOKEN.findall(low)
    alpha = [w for w in words if w[0].isalpha()]
    shape += [f"len:{min(len(alpha), 12) // 2}", f"end:{text.rstrip()[-1:] if text.rstrip()[-1:] in '.?!:…' else '-'}", f"first:{words[0] if words else ''}", f"last:{alpha[-1] if alpha else ''}"]
    if any(w in _PERSON for w in alpha):
        shape.append("person")
    grams = {f"g:{p[i : i + 4]}" for w in alpha for p in (f"^{w}$",) for i in range(max(1, len(p) - 3))}
    pairs = {f"p:{a} {b}" for a, b in zip(words, words[1:])}
    return np.unique(np.array([_cell(x) for x in (*shape, *(f"w:{w}" for w in words), *pairs, *grams)], np.int64))


class Softmax:
    """Weights per class over hashed features; each message has length 1."""

    def __init__(self, rows: list[np.ndarray], labels: list[str], rounds: int = 120, rate: float = 5.0, decay: float = 2e-5):
        self.classes = sorted(set(labels))
        y = np.array([self.classes.index(x) for x in labels])
        at = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        value = np.repeat([1 / np.sqrt(max(1, len(r))) for r in rows], [len(r) for r in rows])
        k = len(self.classes)
        self.w, self.b = np.zeros((BUCKETS, k)), np.zeros(k)
        hit = np.eye(k)[y] / np.maximum(1, np.bincount(y, minlength=k))[y][:, None] / k  # classes weigh alike
        weight = hit.sum(1)[:, None]
        speed = np.zeros_like(self.w)
        for _ in range(rounds):
            z = np.column_stack([np.bincount(row, self.w[at, c] * value, len(rows)) for c in range(k)]) + self.b
            p = np.exp(z - z.max(1, keepdims=True))
            p = p / p.sum(1, keepdims=True) * weight - hit
            grad = np.column_stack([np.bincount(at, p[row, c] * value, BUCKETS) for c in range(k)])
            speed = 0.9 * speed - rate * (grad + decay * self.w)
            self.w += speed
            self.b -= rate * p.sum(0)

    def scores(self, at: np.ndarray) -> dict[str, float]:
        z = self.w[at].sum(0) / np.sqrt(max(1, len(at))) + self.b
        p = np.exp(z - z.max())
        return dict(zip(self.classes, p / p.sum()))


def _word(w: str) -> np.ndarray:
    p = f"^{w}$"
    return np.unique(np.array([_cell(f"{n}{p[i : i + n]}") for n in (2, 3, 4) for i in range(max(1, len(p) - n + 1))] + [_cell("w:" + w)], np.int64))


class Judge:
    """The three fitted classifiers: of messages, of sentences with slots, and of words as pseudo-Latin."""

    def __init__(self):
        said, slots = examples(EXAMPLES), slot_examples(SLOT_EXAMPLES)
        self._kinds = Softmax([features(t) for t, _ in said], [c for _, c in said])
        self._about = Softmax([features(t) for t, _ in slots], ["about" if a else "use" for _, a in slots])
        plain = {w for t, _ in said for w in re.findall(r"[^\W\d_]{2,}", t.lower())}
        plain, latin = sorted(plain - set(LATIN)), sorted(set(LATIN))
        copies = max(1, len(plain) // len(latin))
        self._words = Softmax([_word(w) for w in plain + latin * copies], ["plain"] * len(plain) + ["latin"] * len(latin) * copies, rounds=80)
        self._odds: dict[str, float] = {}

    def kind(self, message: str) -> dict[str, float]:
        return self._kinds.scores(features(message))

    def speaks_about(self, message: str) -> bool:
        """Whether a sentence with a slot speaks about it instead of lacking a value."""
        return self._about.scores(features(message))["about"] > 0.5

    def latin(self, word: str) -> float:
        """How far a word looks like pseudo-Latin, -1 to 1."""
        if word not in self._odds:
            if len(self._odds) > 100_000:
                self._odds.clear()
            self._odds[word] = float(2 * self._words.scores(_word(word))["latin"] - 1)
        return self._odds[word]

    def filler(self, words: list[str], least: int = 4) -> list[tuple[int, int]]:
        """Stretches of at least so many words that are pseudo-Latin, typed at random, or one word over and over."""
        out: list[tuple[int, int]] = []
        n = len(words)
        odds = [self.latin(w) if len(w) > 1 else 0.0 for w in words]
        # living languages have function words every few words, and letters that Latin has not
        latin = [w.isascii() and w not in _LIVING and (o > 0.0 or (len(w) < 4 and o > -0.6)) for o, w in zip(odds, words)]
        junk = [typed(w) or w in _TRIES for w in words]
        again = [(k > 0 and words[k] == words[k - 1]) or (k + 1 < n and words[k] == words[k + 1]) for k in range(n)]
        for good, sure in ((latin, False), (junk, True), (again, True)):
            k = 0
            while k < n:
                if not good[k]:
                    k += 1
                    continue
                e = k
                while e < n and good[e]:
                    e += 1
                long = [o for o, w in zip(odds[k:e], words[k:e]) if len(w) >= 4]
                if e - k >= least and (sure or (len(long) >= 3 and sum(long) / len(long) > 0.5)):
                    out.append((k, e))
                k = e
        return sorted(out)


@lru_cache(maxsize=1)
def judge() -> Judge:
    """Fitted once per process; tasks get the driver's."""
    return Judge()


#: Frequent function words of English, Spanish, French and German that Latin has not.
_LIVING = set(
    """the of and to is was it for on with as are at be this that had by or from not have has were which they you all their but there been one would so what if when
    after before he she we his her my our an no up down el la los las y que del un una unos por con se su para al lo como más pero sus le ya o fue este ha sí porque esta entre cuando muy sin
    sobre también me hasta hay donde desde todo toda nos durante ni ese eso ante ellos e esto antes otra otro fueron mantuvo le les des du au aux une dans pour sur pas ne plus par ce cette ces son
    sa ses mais ou où avec sont a été il elle ils nous vous je qui car puis pendant der die das den dem des ein eine einen und ist von zu mit sich auf für im nicht auch es an werden aus er hat
    dass sie nach wird bei noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde""".split()
) - set(LATIN)
_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop")
_NEXT = {a + b for k in _KEYS for a, b in zip(k, k[1:])} | {b + a for k in _KEYS for a, b in zip(k, k[1:])}


def typed(word: str) -> bool:
    """Whether a word is keys struck at random: one letter again and again, or neighbouring keys in a row."""
    if len(word) < 3:
        return False
    if len(set(word)) == 1:
        return True
    near = sum(word[i : i + 2] in _NEXT or word[i] == word[i + 1] for i in range(len(word) - 1))
    vowels = sum(c in "aeiouyäöüáéíóúàèêâô" for c in word)
    return near == len(word) - 1 and (vowels == 0 or near >= 4 or (near >= 3 and vowels == 1))


#: Words that are typed to try something out.
_TRIES = {"test", "testing", "blah", "bla", "foo", "bar", "baz", "qux", "dummy", "xxx", "yada"}
