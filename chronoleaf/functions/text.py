"""Text comparison for question answering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARTICLES = ("a", "an", "the")
#: Verdict words and their scores, tested as whole words; the first that is found counts.
VERDICTS = (("incorrect", 0.0), ("correct", 1.0), ("partial", 0.5), ("wrong", 0.0))
SUMMARY_VERDICTS = (("unfaithful", 0.0), ("faithful", 1.0), ("minor", 0.5))


def tokens(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.filter(F.split(bare, r"\s+"), lambda x: (x != "") & ~x.isin(*ARTICLES))


def normalize(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def exact_match(pred: Column, gold: Column) -> Column:
    return (normalize(pred) == normalize(gold)).cast("double")


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of the token multisets; both empty: 1, one empty: 0."""
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))

    def score(z: Column) -> Column:
        p, g = z["p"], z["g"]
        same = F.aggregate(F.array_distinct(p), F.lit(0), lambda m, t: m + F.least(count(p, t), count(g, t)))
        return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when(same == 0, 0.0).otherwise(2.0 * same / (F.size(p) + F.size(g)))

    # the one-element array computes both token lists once
    return F.get(F.transform(F.array(F.struct(tokens(pred).alias("p"), tokens(gold).alias("g"))), score), F.lit(0))


def verdict(text: Column, words: tuple[tuple[str, float], ...] = VERDICTS, default: str = "wrong") -> Column:
    """The first verdict of ``words`` that the text has as a whole word."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for w, _ in words:
        hit = F.rlike(low, F.lit(rf"(^|[^a-z]){w}([^a-z]|$)"))
        out = F.when(hit, w) if out is None else out.when(hit, w)
    return out.otherwise(default)


def verdict_score(text: Column, words: tuple[tuple[str, float], ...] = VERDICTS, default: str = "wrong") -> Column:
    v = verdict(text, words, default)
    out = None
    for w, s in words:
        out = F.when(v == w, s) if out is None else out.when(v == w, s)
    return out.otherwise(0.0)


def mentions(text: Column, names: Column) -> Column:
    """(pos, name, rank) of each name the text mentions, in order of first mention; rank: last place in ``names``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = F.size(names)
    rank = lambda x: n - F.array_position(F.reverse(names), x)
    rows = F.transform(names, lambda x: F.struct(F.call_function("instr", low, F.lower(x)).alias("pos"), x.alias("name"), rank(x).cast("int").alias("rank")))
    return F.array_sort(F.filter(rows, lambda r: r["pos"] > 0))
