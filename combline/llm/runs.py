"""Runs of consecutive events that say the same, each collapsed into one event with its count and duration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from combline.session import written

#: Words that name the part of the day, and shorthand for two words.
DAYPARTS = ["morning", "afternoon", "evening", "night", "day", "midday", "noon", "midnight", "dawn", "dusk", "overnight", "today", "tonight", "daytime", "nighttime"]
SHORTHAND = {"&": "and", "+": "and", "n": "and", "w": "with"}
#: Parts of the day so long that a word one letter away is one of them, mistyped; a short one may be another word ("dry", "light").
_LONG = [d for d in DAYPARTS if len(d) >= 7]
#: One slip leaves the first three letters or the last three as they are.
_LIKE_LONG = rf"(?<!\p{{L}})(?:(?:{'|'.join(sorted({d[:3] for d in _LONG}))})\p{{L}}{{3,7}}|\p{{L}}{{3,7}}(?:{'|'.join(sorted({d[-3:] for d in _LONG}))}))(?!\p{{L}})"
SAME, DIFFERENT, CHECK = "same", "different", "check"


def with_said(df: DataFrame, text: str, name: str = "says") -> DataFrame:
    """df with what a text says: its letters and digits in lower case without the part of the day, shorthand written out.

    A mistyped part of the day is left out like a right one, and a ! at the end says that the text's one mistyped letter was
    there. Null for null, and for texts without a letter or digit. Each step is a column of its own, so it is computed once.
    """
    alone = r"(?<![\p{L}\p{N}&+])%s(?![\p{L}\p{N}&+])"
    low = df.withColumn("_low", F.lower(text))
    long_w = F.regexp_replace("_low", rf"\bw/|{alone % 'w'}", " with ")
    spelt = low.withColumn("_spelt", F.when(F.col("_low").rlike(rf"[&+]|\bw/|{alone % '[nw]'}"), F.regexp_replace(long_w, rf"[&+]|{alone % 'n'}", " and ")).otherwise(F.col("_low")))
    bare = spelt.withColumn("_bare", F.regexp_replace("_spelt", rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(DAYPARTS)})(?![\p{{L}}\p{{N}}])", " "))
    # few texts have a word that looks like a mistyped part of the day; only those are taken apart
    long = F.array(*map(F.lit, _LONG))
    words = F.split("_bare", r"[^\p{L}\p{N}]+")
    typo = lambda w: (F.length(w) >= 6) & F.exists(long, lambda d: _one_off(w, d))
    spent = F.when(F.exists(words, typo), "!").otherwise("")
    apart = F.concat(F.array_join(F.filter(words, lambda w: ~typo(w)), ""), spent)
    says = F.when(F.col("_bare").rlike(_LIKE_LONG), apart).otherwise(F.regexp_replace("_bare", r"[^\p{L}\p{N}]+", ""))
    return bare.withColumn(name, F.when(F.col("_low").rlike(r"[\p{L}\p{N}]|[&+]"), says)).drop("_low", "_spelt", "_bare")


def _one_off(a: Column, b: Column) -> Column:
    """One letter left out, put in or replaced, or two neighbours swapped."""
    d = F.levenshtein(a, b, 2)
    return (d == 1) | ((d == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))))


def related(a: Column, b: Column) -> Column:
    """same, different, or check for two results of with_said.

    One letter apart is the same, unless both texts have spent theirs: figures are no letters, so the digits must agree. What
    is further apart may still be one right text with a mistyped letter in each; that takes a look at the texts there are.
    """
    bare = lambda c: F.regexp_replace(c, "!$", "")
    figures = lambda c: F.regexp_replace(c, "[^0-9]", "")
    x, y = bare(a), bare(b)
    left = F.lit(2) - F.endswith(a, F.lit("!")).cast("int") - F.endswith(b, F.lit("!")).cast("int")
    d = F.levenshtein(x, y, 4)
    near = (d >= 0) & (figures(x) == figures(y))
    return F.when(a.isNull() | b.isNull(), DIFFERENT).when(x == y, SAME).when(~near | (left == 0), DIFFERENT).when(d == 1, SAME).otherwise(CHECK)


def one_letter(a: str, b: str) -> bool:
    """Whether a becomes b by leaving out, putting in or replacing one letter or swapping two neighbours, or they are equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a == b or a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and len(a) == len(b) and a[k + 2 :] == b[k + 2 :])


def between(a: str, b: str) -> set[str]:
    """All texts other than a and b that are one letter away from both, if a and b are more than that apart.

    What is put into a, or takes a letter's place, must then be a letter that b has thereabouts.
    """
    made = set()
    for i in range(len(a) + 1):
        letters = set(b[max(0, i - 2) : i + 3])
        made.update(a[:i] + c + a[i:] for c in letters)
        if i < len(a):
            made.add(a[:i] + a[i + 1 :])
            made.update(a[:i] + c + a[i + 1 :] for c in letters)
            made.add(a[:i] + a[i + 1 : i + 2] + a[i] + a[i + 2 :])
    return {t for t in made if t not in (a, b) and one_letter(t, b)}


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for e, a, b in zip(batch["_e"], batch["_pl"], batch["_l"]):
            x, y = a.removesuffix("!"), b.removesuffix("!")
            if one_letter(x, y):
                rows.append((e, a, b, None))
            elif not a.endswith("!") and not b.endswith("!"):
                rows += [(e, a, b, t) for t in between(x, y)]
        yield pd.DataFrame(rows, columns=["_e", "_pl", "_l", "_said"])


def truly_different(checks: DataFrame, events: DataFrame) -> DataFrame:
    """Those checks (_e, _pl, _l) whose texts are not the same: no swap of neighbours apart, and no text of the entity is one letter away from both.

    Only distinct pairs are looked at; the texts between two are made from them and looked up, so no texts are compared pairwise.
    """
    pairs = checks.select("_e", "_pl", "_l").distinct()
    made = written(pairs.mapInPandas(_candidates, "_e string, _pl string, _l string, _said string"), "between")
    texts = events.where("_l is not null").select("_e", F.regexp_replace("_l", "!$", "").alias("_said")).distinct()
    fine = made.where("_said is null").select("_e", "_pl", "_l").unionByName(made.where("_said is not null").join(texts, ["_e", "_said"]).select("_e", "_pl", "_l")).distinct()
    return checks.join(fine, ["_e", "_pl", "_l"], "left_anti")


def collapse_runs(
    df: DataFrame, entity: str, epoch: str, row_id: str, label: str, max_gap_s: int | None, block_s: int = 64 * 86_400,
    compare: Callable[[Column, Column], Column] | None = None, settle: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per maximal run of consecutive events of an entity with the same label.

    Result: entity, label (of the first event), first_id, last_id, first_epoch, last_epoch, n, duration_s. Events are ordered
    by epoch, then id. Between neighbours of a run lie at most max_gap_s seconds (no limit if None). An event with a null
    label ends a run and is in none; null entities, ids and epochs are left out before. Repeated rows count each. Empty
    input: no rows. Other columns are ignored. compare says of two neighbouring labels whether they are the same, different
    or to be checked (by default equal ones are the same); settle gives those checked rows that are different.

    Only boundary rows are kept: an event that differs from its predecessor starts a run; the lead over the starts gives
    the position at which it ends and, as the predecessor of the next start, its last event. Orderings are within blocks
    of block_s seconds; over a whole entity only one row per block is ordered.
    """
    e = df.select(F.col(entity).cast("string").alias("_e"), F.col(epoch).cast("bigint").alias("_t"), F.col(row_id).cast("bigint").alias("_id"), F.col(label).alias("_l"))
    for c in ("_e", "_t", "_id"):
        e = e.where(F.col(c).isNotNull())
    e = e.withColumn("_b", F.floor(F.col("_t") / block_s))
    w = Window.partitionBy("_e", "_b").orderBy("_t", "_id")
    e = written(e.withColumns({"_pos": F.row_number().over(w), "_pt": F.lag("_t").over(w), "_pid": F.lag("_id").over(w), "_pl": F.lag("_l").over(w)}), "events")

    tail = F.struct("_pos", "_t", "_id", "_l")
    ends = e.groupBy("_e", "_b").agg(F.max(tail).alias("z"))
    v = Window.partitionBy("_e").orderBy("_b")
    prior = ends.select(
        "_e", "_b", (F.sum("z._pos").over(v) - F.col("z._pos")).alias("_before"), F.lag("z._t").over(v).alias("_bt"), F.lag("z._id").over(v).alias("_bid"), F.lag("z._l").over(v).alias("_bl"),
        F.col("z._pos").alias("_size"), F.col("z._t").alias("_tn"), F.col("z._id").alias("_idn"),
    )
    prior = written(prior, "run-blocks")
    inner = e.where("_pos > 1")
    heads = e.where("_pos = 1").drop("_pt", "_pid", "_pl").join(prior.select("_e", "_b", F.col("_bt").alias("_pt"), F.col("_bid").alias("_pid"), F.col("_bl").alias("_pl")), ["_e", "_b"])
    rows = inner.unionByName(heads)
    apart = F.col("_pt").isNull() | F.col("_l").isNull() | F.col("_pl").isNull()
    if max_gap_s is not None:
        apart = apart | (F.col("_t") - F.col("_pt") > max_gap_s)
    how = compare(F.col("_pl"), F.col("_l")) if compare else F.when(F.col("_l") == F.col("_pl"), SAME).otherwise(DIFFERENT)
    rows = rows.withColumn("_how", F.when(F.coalesce(apart, F.lit(True)), DIFFERENT).otherwise(how))
    starts = rows.where(F.col("_how") == DIFFERENT)
    if settle:
        starts = starts.unionByName(settle(rows.where(F.col("_how") == CHECK), e))
    starts = starts.join(prior.select("_e", "_b", "_before"), ["_e", "_b"]).select("_e", "_b", (F.col("_before") + F.col("_pos")).alias("_at"), "_t", "_id", "_l", "_pt", "_pid")
    starts = written(starts, "run-starts")

    nxt = Window.partitionBy("_e", "_b").orderBy("_at")
    led = starts.withColumns({"_to": F.lead("_at").over(nxt), "_lt": F.lead("_pt").over(nxt), "_lid": F.lead("_pid").over(nxt)})
    # the last start of a block runs on to the first start of a later block, or to the entity's last event
    firsts = starts.groupBy("_e", "_b").agg(F.min("_at").alias("_f_at"), F.min_by("_pt", "_at").alias("_f_pt"), F.min_by("_pid", "_at").alias("_f_pid"))
    later = v.rowsBetween(1, Window.unboundedFollowing)
    to_end = Window.partitionBy("_e").orderBy("_b").rowsBetween(0, Window.unboundedFollowing)
    open_ends = prior.join(firsts, ["_e", "_b"], "left").select(
        "_e", "_b",
        F.first("_f_at", ignorenulls=True).over(later).alias("_o_at"), F.first("_f_pt", ignorenulls=True).over(later).alias("_o_pt"), F.first("_f_pid", ignorenulls=True).over(later).alias("_o_pid"),
        F.last(F.col("_before") + F.col("_size")).over(to_end).alias("_all"), F.last("_tn").over(to_end).alias("_z_t"), F.last("_idn").over(to_end).alias("_z_id"),
    )
    out = led.join(open_ends, ["_e", "_b"]).where(F.col("_l").isNotNull())
    last_t = F.coalesce("_lt", "_o_pt", "_z_t")
    return out.select(
        F.col("_e").alias(entity),
        F.col("_l").alias(label),
        F.col("_id").alias("first_id"),
        F.coalesce("_lid", "_o_pid", "_z_id").alias("last_id"),
        F.col("_t").alias("first_epoch"),
        last_t.alias("last_epoch"),
        (F.coalesce("_to", "_o_at", F.col("_all") + 1) - F.col("_at")).alias("n"),
        (last_t - F.col("_t")).alias("duration_s"),
    )
