"""Template residue and error pages: mined message templates, classified once, and unresolved slots in ordinary records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from combline.llm.messages import ANY, FILL, MARK, NUMBER, SLOT, Judge, judge
from combline.llm.phrases import HOLLOW, NOTICE
from combline.operators.heavy import dictionary_join
from combline.session import spread, written

#: From here on a message is taken for a notice or a hollow text at all; and a document of notices for an error page.
SURE, MOSTLY = 0.66, 0.6
_MIRROR = str.maketrans("{[(<«", "}])>»")
_OPEN = re.compile(r"[{\[(<$#%@*|_!~]*[{\[(<%$#@|_«]+[{\[(<$#%@*|_!~]*")
_NAME = re.compile(r"\$?[^\W\d_][\w.\-:]*\Z")
_CAPS = re.compile(r"[A-Z][A-Z0-9]*(?:[ _.\-][A-Z0-9]+)*\Z")
_PHRASE = re.compile(r"[\w][\w .,'’:|\-/]*\Z")
#: Words by which a bracket asks for something to be put in.
_ASK = re.compile(r"(?i)(?:please )?(?:insert|enter|your|add|type|put|fill|write|replace|choose|select|todo|tbd|placeholder|inserte?|su|escriba|nombre|einfügen|ihr|ihre|hier|bitte|insérez|insérer|votre|saisir|nom)\b|.* here\Z")
#: How programs and people write that a value is missing.
_MARKS = re.compile(r"\[object \w+\]|#(?:N/A|REF!|VALUE!|NAME\?|DIV/0!|NULL!|NUM!)|(?<![\w'’])(?:NaN|undefined|null|NULL|\(null\)|<null>|TBD|TBA|TODO\w*|FIXME\w*|XXX+)(?![\w'’])")
#: Shapes that may be a slot: taken for one only where other messages of the template have values in their place, or after a label.
_MAYBE = re.compile(r"(?:None|nil|N/A|n/a|[A-Z]+(?:_[A-Z0-9]+)+|\[\w+\]|<(?!N>)\w+>|«\w+»|\?{3,})[.,;:!?]*\Z")
_TAGS = re.compile(r"/?(?:a|b|i|p|br|hr|em|ul|ol|li|td|tr|th|h\d|div|img|pre|code|span|html|head|body|title|table|strong|center|script|style|link|meta|form|input|label|button|font)\b.*", re.I)


def _is_slot(opener: str, inside: str) -> bool:
    text = inside.strip()
    if not any(c.isalnum() for c in text):
        return False
    if opener[0] in "{[(<«" and len(opener) > 1 or opener[-1] in "{[(<" and len(opener) > 1:
        if opener in ("<!", "((", "[[") or opener[-1] == "(":
            return bool(_NAME.match(text) or _CAPS.match(text) or _ASK.match(text) or (opener == "[[" and _PHRASE.match(text)))
        return "://" not in text
    if len(opener) > 1:  # the same marks on both sides, as @@X@@ or *|X|*
        return bool(_NAME.match(text)) and text == inside and (opener != "__" or text.isupper() or "_" in text or opener[0] != "_")
    if opener == "{":
        return bool(_NAME.match(text) or text.isdigit()) and '"' not in text
    if opener == "%":
        return bool(_CAPS.match(text)) and len(text) > 1 and text == inside
    if opener == "[":
        return bool((_CAPS.match(text) and len(text) > 2 and not text.isdigit()) or _ASK.match(text) or ("_" in text and _NAME.match(text)))
    if opener == "<":
        return bool(not _TAGS.match(text) and ((_CAPS.match(text) and len(text) > 2) or _ASK.match(text) or ("_" in text and _NAME.match(text))))
    if opener == "«":
        return bool(_PHRASE.match(inside)) and inside == text
    return False


def slots(text: str) -> list[tuple[int, int]]:
    """Spans of what was to be filled in, by form: a name or a request between an opening mark and its mirror image, however long."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := _OPEN.search(text, at):
        at = m.end()
        run = m.group()
        for k in range(len(run)):  # the longest opener first
            opener = run[k:]
            closer = opener.translate(_MIRROR)[::-1]
            if opener[-1] in "{(" and len(opener) > 1 and opener[0] in "$#@%":
                closer = opener[-1].translate(_MIRROR)
            end = text.find(closer, m.end())
            if end <= m.end() or not _is_slot(opener, text[m.end() : end]):
                continue
            stop = end + len(closer)
            if opener == "%(":
                stop += 1 if re.match(r"[sdifr]", text[stop : stop + 1] or " ") else 0
                if stop == end + len(closer):
                    continue
            out.append((m.start() + k, stop))
            at = stop
            break
    return out


def _mended(text: str) -> str:
    """Text that was read in the wrong encoding, read again."""
    for wrong in ("cp1252", "latin-1"):
        try:
            return text.encode(wrong).decode("utf-8")
        except UnicodeError:
            continue
    return text


_WORDS = re.compile(r"[^\W\d_]+")


def masked(message: str, by: Judge) -> tuple[str, bool, bool]:
    """The message with slots, marks and filler masked, whether there are slots or marks, and whether there is filler."""
    text = _mended(message)
    found = slots(text)
    for a, b in reversed(found):
        text = f"{text[:a]}{SLOT}{text[b:]}"
    text, marks = _MARKS.subn(MARK, text)
    words = list(_WORDS.finditer(re.sub(r"<[SMN]>", "   ", text)))
    spans = by.filler([w.group().lower() for w in words])
    for a, b in reversed(spans):
        text = f"{text[: words[a].start()]}{FILL}{text[words[b - 1].end() :]}"
    return text, bool(found or marks), bool(spans)


def segments(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and message of each line or sentence, empty ones included; numbers are masked, outer marks of lists and quotes taken off."""
    cut = r"[\r\n]+|(?<=[.!?;])[ \t ]+(?=[\p{Lu}\[{<«$#%@_*])"
    rows = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.explode(F.split(F.col(text), cut)).alias("s"))
    # each step is a column of its own, and blank messages are left to the reader: a filter here would compute all of it twice
    bare: Column = F.regexp_replace(F.translate("s", "­​‌‍⁠﻿ \t", "\u0000\u0000\u0000\u0000\u0000\u0000  "), r"\u0000+|^(?:[>\-•* ]|\[\d{1,2}:\d{2}\])+(?![|*])|(?<= ) +", "")
    lines = rows.withColumn("bare", F.trim(bare))
    number = F.regexp_replace("bare", r"(?<![\w{])(?=\w*\d)\w+(?:[.,:]\w*\d\w*)*(?![\w}])", NUMBER)
    return lines.select("doc_id", F.when(F.col("bare").rlike("[0-9]"), number).otherwise(F.col("bare")).alias("message"))


class PrefixTree:
    """Templates under one leaf of the fixed-depth tree: messages join the most similar template or open one."""

    def __init__(self, similar: float, width: int):
        self.similar, self.codes, self.words = similar, {}, []
        self.table = np.zeros((8, width), np.int64)
        self.n = 0

    def _code(self, w: str) -> int:
        if w not in self.codes:
            self.codes[w] = len(self.codes)
            self.words.append(w)
        return self.codes[w]

    def add(self, tokens: list[str]) -> int:
        row = np.array([self._code(w) for w in tokens])
        if self.n:
            same = (self.table[: self.n] == row).mean(axis=1)
            at = int(same.argmax())
            if same[at] >= self.similar:
                self.table[at][self.table[at] != row] = self._code(ANY)
                return at
        if self.n == len(self.table):
            self.table = np.vstack((self.table, np.zeros_like(self.table)))
        self.table[self.n] = row
        self.n += 1
        return self.n - 1

    def template(self, k: int) -> str:
        return " ".join(self.words[c] for c in self.table[k])


def _mine(keys: list[str], column: str, out: str, similar: float):
    """Adds to each row the template of its text within the group of its keys. Rows come sorted by keys and text, so it does not matter how they arrived; a group's texts are held until it ends."""

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, tree, texts, at = None, None, [], []
        done: list[tuple] = []

        def close() -> None:
            names = {k: tree.template(k) for k in set(at)} if texts else {}
            done.extend((*group, t, names[k]) for t, k in zip(texts, at))
            texts.clear()
            at.clear()

        for b in batches:
            for *key, text in zip(*(b[c] for c in (*keys, column))):
                if key != group:
                    close()
                    group, tree = key, PrefixTree(similar, text.count(" ") + 1)
                texts.append(text)
                at.append(tree.add(text.split(" ")))
            yield pd.DataFrame(done, columns=[*keys, column, out])
            done.clear()
        close()
        yield pd.DataFrame(done, columns=[*keys, column, out])

    return mine


def mine_templates(messages: DataFrame, depth: int = 3, similar: float = 0.7, part_rows: int = 4_000) -> DataFrame:
    """message and template of each distinct message.

    The tree has a fixed depth: the number of tokens, then the first depth tokens (those with brackets and the like, and
    numbers, count as one). A leaf with many messages is mined in parts first; the parts' templates, few as they are, then
    meet per leaf and are mined once more, so the cut leaves no trace where they are alike.
    """
    tokens = F.split("message", " ")
    plain = F.transform(F.slice(tokens, 1, depth), lambda w: F.when(w.rlike(r"[{}\[\]<>%$@#|_«»]|^[A-Z]{2,}"), F.lit(ANY)).otherwise(w))
    placed = messages.select("message", F.concat_ws(" ", F.size(tokens).cast("string"), plain).alias("leaf"))
    parts = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("parts"))
    placed = placed.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("message"), F.col("parts"))).select("leaf", "part", "message")
    ordered = spread(placed, "leaf", "part").sortWithinPartitions("leaf", "part", "message")
    local = written(ordered.mapInPandas(_mine(["leaf", "part"], "message", "local", similar), "leaf string, part bigint, message string, local string"), "local-templates")
    again = spread(local.select("leaf", "local").distinct(), "leaf").sortWithinPartitions("leaf", "local")
    merged = again.mapInPandas(_mine(["leaf"], "local", "template", similar), "leaf string, local string, template string")
    return local.join(merged, ["leaf", "local"]).select("message", "template")


def _judged(sent):
    """notice, hollow, other: odds of a template's class; other is that it is no content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = sent.value
        for b in batches:
            odds = [by.kind(_mended(t)) for t in b["template"]]
            yield pd.DataFrame({"template": b["template"], "notice": [float(o[NOTICE]) for o in odds], "hollow": [float(o[HOLLOW]) for o in odds], "other": [1 - float(o["content"]) for o in odds]})

    return run


def _unfilled(sent):
    """empty: a slot, mark or filler stands where a value should, and the message does not speak about it; maybe: the places of shapes that may be slots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = sent.value
        for b in batches:
            rows = []
            for m in b["message"]:
                text, hit, filler = masked(m, by)
                tokens = m.split(" ")
                maybe = [k for k, w in enumerate(tokens) if _MAYBE.match(w)]
                label = [k for k in maybe if k and tokens[k - 1].endswith(":") and k == len(tokens) - 1]
                guess = " ".join(SLOT if k in maybe else w for k, w in enumerate(tokens))
                if filler:
                    rows.append((True, []))
                elif _QUOTED.search(text) or _QUOTED.search(guess):
                    rows.append((False, []))
                else:
                    sure = (hit or bool(label)) and not by.speaks_about(text if hit else guess)
                    # other values in its place say more than the sentence does
                    rows.append((sure, [] if hit else maybe))
            yield pd.DataFrame({"message": b["message"], "empty": [r[0] for r in rows], "maybe": [r[1] for r in rows]})

    return run


_QUOTED = re.compile(r"[`\"“„][^`\"“”]*<[SMF]>[^`\"“”]*[`\"”“]|(?<!\w)['‘]<[SMF]>['’]")


def residue(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and reason (residue or error) of each document with template residue or with an error page as its text.

    residue: a slot or the mark of a missing value stands where a value should, or filler or a hollow text ("your text
    here") where text should, anywhere. error: there is a notice, and the document's words are mostly not content, weighed
    by the odds of their messages; one-word lines count like others. Sentences that speak about such things or quote
    them are content. Null and empty texts are no case; a doc_id that occurs several times is judged over all its rows.
    Empty input: no rows. Other columns are ignored.

    Distinct messages are mined for templates; a classifier fitted on EXAMPLES labelled messages, none of them from the
    documents, judges each template once, and its verdict goes back to all messages and documents. Slots are looked for by
    form in the distinct messages; what may be a slot counts where the template has other values in its place.
    """
    sent = df.sparkSession.sparkContext.broadcast(judge())
    parts = written(segments(df, doc_id, text), "segments").where("message <> ''")
    known = written(parts.groupBy("message").agg(F.count(F.lit(1)).alias("n")), "messages")
    mined = written(mine_templates(known), "templates")
    verdicts = spread(mined.select("template").distinct(), "template").mapInPandas(_judged(sent), "template string, notice double, hollow double, other double")
    gaps = spread(known.select("message"), "message").mapInPandas(_unfilled(sent), "message string, empty boolean, maybe array<int>")
    each = mined.join(verdicts, "template").join(gaps.where(F.col("empty") | (F.size("maybe") > 0)), "message", "left")
    varies = F.exists("maybe", lambda k: F.element_at(F.split("template", " "), k + 1) == ANY)
    bare = F.coalesce(F.col("empty"), F.lit(False)) | F.coalesce(varies, F.lit(False)) | (F.col("hollow") >= SURE)
    each = each.select("message", bare.alias("bare"), "notice", F.when(bare, 1.0).otherwise(F.col("other")).alias("other")).where(F.col("bare") | (F.col("other") >= 0.1))
    odd = written(each.join(known, "message"), "odd")

    # messages that are surely content never go back to the documents; hot ones are split
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = F.greatest(F.lit(1), F.size(F.split("message", " ")))
    hits = dictionary_join(parts, odd, ["message"], "n", total)
    bad = hits.groupBy("doc_id").agg(F.max("bare").alias("residue"), F.max("notice").alias("notice"), F.sum(words * F.col("other")).alias("other"))
    bad = bad.where(F.col("residue") | (F.col("notice") >= SURE))
    size = parts.groupBy("doc_id").agg(F.sum(words).alias("words"))
    judged = bad.join(size, "doc_id")
    page = (F.col("notice") >= SURE) & (F.col("other") >= F.col("words") * MOSTLY)
    return judged.where(F.col("residue") | page).select("doc_id", F.when(F.col("residue"), "residue").otherwise("error").alias("reason"))
