"""Near-duplicate candidates within a unit: the first one of each stays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..sources.scratch import put_aside

#: So many candidates of a unit and signature are compared pair by pair, in parts of so many; more are joined by runs of characters first.
PAIRWISE, PART = 2048, 64


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity without junk heuristics; 0 for an empty side. It is not symmetric."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0


def reaches(a: str, b: str, threshold: float) -> bool:
    """Whether the ratio is the threshold or more; cheap upper bounds settle most pairs."""
    from difflib import SequenceMatcher

    if not a or not b:
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold


@lru_cache(4096)
def _letters(text: str) -> np.ndarray:
    """How often characters come up, in 64 cells."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) & 63, minlength=64)


@lru_cache(4096)
def _places(text: str) -> dict[str, int]:
    """Where each character stands, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence; matching blocks make up one, so they are no longer."""
    places, whole = _places(a), (1 << len(a)) - 1
    left = whole
    for c in b:
        hit = left & places.get(c, 0)
        left = ((left + hit) | (left - hit)) & whole
    return len(a) - left.bit_count()


def close(claim: str, question: str, old_claim: str, old_question: str, threshold: float) -> bool:
    """Whether the claims, or the claims with their questions, reach the ratio. What bounds it from above settles nearly all pairs that don't."""
    sides = [(a, b) for a, b in ((claim, old_claim), (f"{claim} {question}", f"{old_claim} {old_question}")) if a and b]
    left = [(a, b) for a, b in sides if 2.0 * np.minimum(_letters(a), _letters(b)).sum() / (len(a) + len(b)) >= threshold]
    if not left:
        return False
    most = longest_common(*left[-1])  # the claims begin the longer texts, so this bounds theirs, too
    return any(2.0 * most / (len(a) + len(b)) >= threshold and reaches(a, b, threshold) for a, b in left)


def similar(new: tuple[str, str, str], kept: tuple[str, str, str], threshold: float) -> bool:
    """Of (claim, question, signature): equal texts are similar whatever their label; else the labels and sources must agree."""
    if new[:2] == kept[:2]:
        return True
    if new[2] != kept[2]:
        return False
    return reaches(new[0], kept[0], threshold) or reaches(f"{new[0]} {new[1]}", f"{kept[0]} {kept[1]}", threshold)


def _numbered(rows: DataFrame, unit: str, ordinal: str, claim: str, question: str, signature: Column) -> DataFrame:
    """row (all columns), n (a number of its own), at (order in the unit), and what candidates are compared by. Written, so that n is fixed."""
    if "kept" in rows.columns:
        raise ValueError("the verdict is a column named kept, so rows can't have one")
    text = lambda c: normalized(F.coalesce(F.col(c), F.lit("")))
    made = rows.select(
        F.struct(*rows.columns).alias("row"), F.monotonically_increasing_id().alias("n"), F.struct(F.col(ordinal).isNull().alias("last"), F.col(ordinal).alias("ordinal")).alias("at"),
        F.struct(F.col(unit).alias("unit")).alias("unit"), text(claim).alias("claim"), text(question).alias("question"), F.coalesce(signature, F.lit("")).alias("signature"),
    )
    return put_aside(made, "candidates")


def _with_verdict(numbered: DataFrame, dropped: DataFrame) -> DataFrame:
    gone = dropped.select("n", F.lit(True).alias("gone"))
    return numbered.select("row", "n").join(gone, "n", "left").select("row.*", F.col("gone").isNull().alias("kept"))


def _first_of(rows: DataFrame, *key: str) -> DataFrame:
    """The key and ``first``: (at, n) of its first row. A partial aggregate finds it, whatever the number of copies."""
    return rows.groupBy(*key).agg(F.min(F.struct("at", "n")).alias("first"))


def _runs(text: Column, size: int) -> Column:
    """All runs of ``size`` characters; none in a shorter text."""
    n = F.char_length(text)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _fits(a: Column, b: Column, threshold: float) -> Column:
    """Whether texts of these lengths may reach the ratio."""
    return 2 * F.least(a, b) >= (a + b) * threshold - 1e-9


def _pairs_by_runs(reps: DataFrame, threshold: float) -> DataFrame:
    """new, old: numbers of candidates of one unit and signature whose claims, or claims with questions, may reach the ratio; none that do is left out.

    A ratio of t or more leaves at most (1 - t) (a + b) characters of both
    texts outside the matches, and each takes ``size`` runs of characters away
    at most. So a prefix filter over runs, from rare to common, finds all pairs:
    for runs of two characters from 0.88 on, of one above two thirds. Below
    that it bounds nothing, and lengths alone rule pairs out.
    """
    size = 2 if threshold >= 0.88 else 1
    texts = F.array(F.struct(F.lit(0).alias("kind"), F.col("claim").alias("text")), F.struct(F.lit(1).alias("kind"), F.concat_ws(" ", "claim", "question").alias("text")))
    rows = reps.select("unit", "signature", "n", "at", F.explode(texts).alias("x")).select("unit", "signature", "n", "at", "x.*").where("text <> ''").withColumn("size", F.char_length("text"))
    own = ["unit", "signature", "kind", "n", "at", "size"]
    if threshold > 2 / 3:
        runs = rows.select(*own, F.explode(_runs(F.col("text"), size)).alias("run")).groupBy(*own, "run").agg(F.count("*").alias("times"))
        runs = put_aside(runs.select(*own, F.explode(F.transform(F.sequence(F.lit(1), F.col("times")), lambda k: F.concat_ws(" ", "run", k.cast("string")))).alias("run")), "runs")
        often = runs.groupBy("run").agg(F.count("*").alias("df"))
        ranked = runs.join(often, "run").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("df", "run"))).alias("runs"))
        # the longer of a pair has (2 - t) / t of the shorter's characters at most, so this bounds what is outside the matches
        outside = F.floor(F.col("size") * (2 * (1 - threshold) / threshold) + 1e-6)
        heads = ranked.select(*own, F.explode(F.slice("runs", F.lit(1), (outside * size + 1).cast("int"))).alias("head")).withColumn("head", F.col("head.run"))
        heads = heads.unionByName(rows.where(F.col("size") < size).select(*own, F.lit(None).cast("string").alias("head")))
    else:
        heads = rows.select(*own, F.lit(None).cast("string").alias("head"))
    key = ["unit", "signature", "kind", "head"]
    old, new = (heads.select(*[F.col(c).alias(f"{c}_{s}") for c in heads.columns]) for s in "on")
    same = F.lit(True)
    for c in key:
        same &= F.col(f"{c}_o").eqNullSafe(F.col(f"{c}_n"))
    fits = (F.struct("at_o", "n_o") < F.struct("at_n", "n_n")) & _fits(F.col("size_o"), F.col("size_n"), threshold)
    return old.join(new, same).where(fits).select(F.col("n_n").alias("new"), F.col("n_o").alias("old")).distinct()


def _close_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """new, old, c_new, q_new, c_old, q_old: candidates of one unit and signature that may reach the ratio; none that do is left out.

    Up to ``PAIRWISE`` candidates are joined with one another by their unit, the
    later ones in parts of some ``PART``, so that a row has a bounded number of
    pairs and no unit is one task's. Others go through a prefix filter.
    """
    group = ["unit", "signature"]
    crowds = put_aside(reps.groupBy(*group).agg(F.count("*").alias("members")).where(F.col("members") > PART), "crowds")
    rows = reps.join(crowds, group, "left").where(F.coalesce("members", F.lit(0)) <= PAIRWISE)
    rows = rows.withColumns({"parts": F.ceil(F.coalesce("members", F.lit(1)) / PART), "c_size": F.char_length("claim"), "size": F.char_length(F.concat_ws(" ", "claim", "question"))})
    dealt = {"o": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)), "n": F.pmod(F.xxhash64("n"), F.col("parts"))}
    old, new = (rows.select(*[F.col(c).alias(f"{c}_{s}") for c in ("unit", "signature", "n", "at", "claim", "question", "c_size", "size")], at.alias(f"part_{s}")) for s, at in dealt.items())
    same = (F.col("unit_o").eqNullSafe(F.col("unit_n"))) & (F.col("signature_o") == F.col("signature_n")) & (F.col("part_o") == F.col("part_n"))
    fits = (F.struct("at_o", "n_o") < F.struct("at_n", "n_n")) & (_fits(F.col("c_size_o"), F.col("c_size_n"), threshold) | _fits(F.col("size_o"), F.col("size_n"), threshold))
    names = {"n_n": "new", "n_o": "old", "claim_n": "c_new", "question_n": "q_new", "claim_o": "c_old", "question_o": "q_old"}
    pairs = old.join(new, same & fits).select(*[F.col(c).alias(x) for c, x in names.items()])
    large = crowds.where(F.col("members") > PAIRWISE).select(*group)
    if large.isEmpty():
        return pairs
    found = _pairs_by_runs(reps.join(large, group, "left_semi"), threshold)
    for side in ("new", "old"):
        found = found.join(reps.select(F.col("n").alias(side), F.col("claim").alias(f"c_{side}"), F.col("question").alias(f"q_{side}")), side)
    return pairs.unionByName(found)


def keep_distinct(rows: DataFrame, unit: str, ordinal: str, claim: str, question: str, signature: Column, threshold: float = 0.9) -> DataFrame:
    """rows with ``kept``: false for one similar to an earlier kept one of its unit. Rows that have a column ``kept`` are an error.

    Every row comes back once. Rows of a null unit are a unit; null texts count
    as empty; a null ordinal comes last, and ties are settled by a number that
    the rows are given. Rows alike in text and signature are compared as one.
    Pairs that may be similar come from a join by unit and signature, or, where
    there are many, over rare runs of characters, and are compared in tasks that
    Spark deals out; the verdicts are then settled in rounds that equal a walk
    through the unit in order. So a unit may hold any share of the rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    numbered = _numbered(rows, unit, ordinal, claim, question, signature)
    key = ["unit", "claim", "question", "signature"]
    firsts = put_aside(_first_of(numbered, *key).select(*key, "first.at", "first.n"), "firsts")
    reps = firsts.select("n", "at", *key)
    # equal texts under other signatures are similar, too: each to the ones before it
    spelled = reps.groupBy("unit", "claim", "question").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("same")).where(F.size("same") > 1)
    equal = spelled.select(F.posexplode("same").alias("i", "x"), "same").select(F.col("x.n").alias("new"), F.explode(F.slice("same", F.lit(1), F.col("i"))).alias("y")).select("new", F.col("y.n").alias("old"))

    @F.pandas_udf("boolean")
    def alike(c: pd.Series, q: pd.Series, d: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([close(*texts, threshold) for texts in zip(c, q, d, r)], dtype=bool)

    linked = _close_pairs(reps, threshold).where(alike("c_new", "q_new", "c_old", "q_old")).select("new", "old")
    links = put_aside(linked.unionByName(equal).distinct(), "links")
    dropped = _settled(links)
    # a row that is not the first of its kind goes, whatever becomes of the first: what drops that one drops it, too
    later = numbered.join(firsts.select(F.col("n").alias("n")), "n", "left_anti").select("n")
    return _with_verdict(numbered, later.unionByName(dropped))


def _settled(links: DataFrame) -> DataFrame:
    """n of the rows that go. links: new, old. In order, a row goes if it is linked to an earlier one that stays.

    Rounds: a row without open links to earlier ones stays, and what is linked
    to it goes. Each round settles the first open row of every chain.
    """
    open_, gone = links, []
    while not open_.isEmpty():
        stays = open_.select(F.col("old").alias("n")).distinct().join(open_.select(F.col("new").alias("n")), "n", "left_anti")
        out = put_aside(open_.join(stays.select(F.col("n").alias("old")), "old", "left_semi").select(F.col("new").alias("n")).distinct(), "gone")
        gone.append(out)
        left = open_.join(out.select(F.col("n").alias("new")), "new", "left_anti").join(out.select(F.col("n").alias("old")), "old", "left_anti")
        open_ = put_aside(left.select("new", "old"), "open")
    if not gone:
        return links.select(F.col("new").alias("n"))
    whole = gone[0]
    for g in gone[1:]:
        whole = whole.unionByName(g)
    return whole


def keep_distinct_exact(rows: DataFrame, unit: str, ordinal: str, claim: str, question: str) -> DataFrame:
    """The same for a threshold that only equal texts reach, without Python."""
    numbered = _numbered(rows, unit, ordinal, claim, question, F.lit(""))
    firsts = _first_of(numbered, "unit", "claim", "question").select("first.n")
    return _with_verdict(numbered, numbered.join(firsts, "n", "left_anti").select("n"))
