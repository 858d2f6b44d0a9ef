"""Quality rules with risk-controlled thresholds.

Rule values are computed per text with built-in functions. Labelled good documents are the holdout: per
stratum and rule, cutoffs are tested from the most lenient to the strictest, and the strictest one is taken
up to which every exact binomial test rejects "this cutoff drops more than alpha of the good documents".
Testing a chain in a fixed order needs no correction within it; between chains (strata x rules) the level
is divided by their number (Bonferroni), and alpha by the number of rules, so that with probability
1 - DELTA, per stratum, all rules together drop at most ALPHA of the good documents. ``judge``, whose results its
SQL gives, does that unless given another function that finds cutoffs. ``joint_thresholds`` tests all rules together in one chain
per stratum, which certifies with about 150 labelled good documents instead of 1,280, with the same guarantee, but with one cutoff
for rules of six scales. ``scaled_thresholds``, which ``keep_good`` takes, gives each rule a scale of its own: an eighth of the good
documents, drawn by hash, says what value of a rule is unusual in the stratum; a step of the chain is a multiple of that for all
rules; the others test the chain. Scales do not depend on the documents that certify, so the tests stay exact. It needs about 175
labelled good documents. A stratum with too few labels certifies nothing and only the base conditions hold there.

Defined cases: a null or empty text has no words and fails the base conditions; a null or unlisted lang is
in the stratum "other"; a doc_id that is labelled more than once counts as good only if all its labels are;
a null doc_id has no label; repeated rows get repeated results; an empty table gives an empty table; extra
columns are ignored. Texts are handled whole; the longest one bounds a row's memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoleaf.llm.common import WHITE, WORD, written

SYMBOLS = "#*$%&|<>"
STRATA = ("en", "de", "fr", "es")
ALPHA, DELTA = 0.03, 0.05
#: Rules: a value above the cutoff is worse. Cutoffs are tested in this order.
RULES = ("symbol_rate", "upper_rate", "bang_rate", "dup_line_rate", "repeat_rate", "digit_rate")
CUTOFFS = (3.0, 2.0, 1.4, 1.0, 0.8, 0.6, 0.45, 0.35, 0.25, 0.18, 0.12, 0.08)
#: A rule's scale is the least of these that at most one in RARE of the tuning documents exceeds; steps are multiples of the scale.
GRID = tuple(round(3 / 2 ** (i / 2), 6) for i in range(18))
RARE, STEPS = 50, tuple(round(64 / 2 ** (i / 4), 6) for i in range(29))
#: Good documents whose hash starts with a digit below this one set the scales: an eighth, as a scale needs
#: fewer documents than a small stratum's first exact test.
TUNING = "2"
#: Terms of a binomial sum, in standard deviations: what is left out is under exp(-9**2 / 2) of it, less than rounding.
DEVIATIONS = 9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in windows of 5 words that the text holds at least twice."""
    size = F.size(words)
    index = F.sequence(F.lit(0), size - 5)
    quick = F.transform(index, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        steps = F.sequence(F.lit(0), n - 2)
        inner = F.when(n > 1, F.aggregate(steps, F.lit(0), lambda a, j: a + F.least(F.lit(5), F.get(starts, j + 1) - F.get(starts, j)))).otherwise(0)
        return F.when(n > 0, inner + 5).otherwise(0)

    def exact(w: Column) -> Column:
        ranked = F.array_sort(F.transform(index, lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, 5)).alias("s"), i.alias("i"))))

        def twice(r: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(r, a)["s"] == F.get(r, b)["s"], F.lit(False))
            at = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
            return F.array_sort(F.transform(at, lambda j: F.get(r, j)["i"]))

        return let(let(ranked, twice), covered)

    distinct = let(quick, lambda q: F.size(F.array_distinct(q)) == F.size(q))
    return F.when(size < 6, 0).when(distinct, 0).otherwise(exact(words)).cast("long")


def text_values(text: Column) -> Column:
    """A struct of the counts and rule values of a text."""
    text = F.coalesce(text, F.lit(""))
    without = lambda t, chars: F.length(F.translate(t, chars, ""))

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, WHITE, "") != "")

        def of_words(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                without(t, WHITE).cast("long").alias("word_chars"),
                (F.length(t) - without(t, SYMBOLS)).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"))).alias("lines"),
                repeated_words(w).alias("n_repeat_words"),
                F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
                (F.length(t) - without(t, "!")).cast("long").alias("n_bangs"),
                (F.length(t) - without(t, "0123456789")).cast("long").alias("n_digits"),
            )

        return let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), of_words)

    return let(text, of_text)


def features(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, stratum, ``keep`` and all counts and rule values of each row."""
    x = docs.select("doc_id", F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise("other").alias("stratum"), *keep, text_values(F.col("text")).alias("v"))
    v = lambda name: F.col(f"v.{name}")
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    kept = [c for c in x.columns if c not in ("v",)]
    return x.select(
        *kept,
        v("n_words").alias("n_words"),
        v("word_chars").alias("word_chars"),
        v("n_symbols").alias("n_symbols"),
        v("lines.dup").alias("n_dup_lines"),
        v("n_repeat_words").alias("n_repeat_words"),
        ((v("n_words") < 10) | (100 * v("n_repeat_words") > 20 * v("n_words"))).alias("base_failed"),
        rate(v("n_symbols"), v("n_words")).alias("symbol_rate"),
        rate(v("n_upper"), v("word_chars")).alias("upper_rate"),
        rate(v("n_bangs"), v("n_words")).alias("bang_rate"),
        rate(v("lines.dup"), v("lines.n")).alias("dup_line_rate"),
        rate(v("n_repeat_words"), v("n_words")).alias("repeat_rate"),
        rate(v("n_digits"), v("word_chars")).alias("digit_rate"),
    )


def log_gamma(x: Column) -> Column:
    """Of x >= 1, by Stirling's series at x + 8; relative error under 1e-12."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return series - F.log(product)


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials of probability p, exact to rounding at every n; 1 where k >= n p.

    Terms below k <= n p shrink at least as fast as those below the mode, so the sum ends DEVIATIONS below k.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)
    terms = F.least(k, F.ceil(DEVIATIONS * F.sqrt(n * p)) + 64).cast("int")

    def add(a: Column, j: Column) -> Column:
        term = a["term"] * ratio(k - j)
        return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))
    summed = F.when((terms > 0) & (k < n * p), F.aggregate(F.sequence(F.lit(0), terms - 1), start, add)).otherwise(start)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), first * summed["sum"]))


def good_documents(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``feats`` all of whose labels are good."""
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    return feats.join(good, "doc_id")


def thresholds(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with the certified cutoff of each rule, null where none is. At most len(STRATA) + 1 rows."""
    held = good_documents(feats, labels)
    counts = [F.count_if(~F.col("base_failed") & (F.col(r) > c)).alias(f"k_{i}_{j}") for i, r in enumerate(RULES) for j, c in enumerate(CUTOFFS)]
    per = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    cells = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(j).alias("level"), F.lit(c).alias("cutoff"), F.col(f"k_{i}_{j}").alias("k")) for i in range(len(RULES)) for j, c in enumerate(CUTOFFS)])
    tests = per.select("stratum", "n", F.explode(cells).alias("t")).select("stratum", "n", "t.*")
    tests = tests.withColumn("p", binomial_at_most(F.col("k"), F.col("n"), alpha / len(RULES)))
    chain = Window.partitionBy("stratum", "rule").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = delta / ((len(STRATA) + 1) * len(RULES))
    passed = tests.withColumn("worst", F.max("p").over(chain)).filter(F.col("worst") <= level)
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == i, F.col("cutoff"))).alias(f"cut_{r}") for i, r in enumerate(RULES)])


def joint_thresholds(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """As ``thresholds``, by one chain per stratum: a step lowers the cutoffs of all rules, and its exact test counts the
    good documents that any rule drops, so that neither alpha nor the level is divided by the number of rules.
    """
    held = good_documents(feats, labels)
    worst = F.greatest(*[F.col(r) for r in RULES])
    per = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~F.col("base_failed") & (worst > c)).alias(f"k_{j}") for j, c in enumerate(CUTOFFS)])
    steps = F.array(*[F.struct(F.lit(j).alias("level"), F.lit(c).alias("cutoff"), F.col(f"k_{j}").alias("k")) for j, c in enumerate(CUTOFFS)])
    tests = per.select("stratum", "n", F.explode(steps).alias("t")).select("stratum", "n", "t.*")
    tests = tests.withColumn("p", binomial_at_most(F.col("k"), F.col("n"), alpha))
    chain = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = tests.withColumn("worst", F.max("p").over(chain)).filter(F.col("worst") <= delta / (len(STRATA) + 1))
    return passed.groupBy("stratum").agg(*[F.min("cutoff").alias(f"cut_{r}") for r in RULES])


def scales(tuning: DataFrame) -> DataFrame:
    """One row per stratum with the scale of each rule, from counts over GRID; base failures say nothing about scales."""
    above = [F.count_if(F.col(r) > c).alias(f"k_{i}_{j}") for i, r in enumerate(RULES) for j, c in enumerate(GRID)]
    per = tuning.filter(~F.col("base_failed")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *above)

    def scale(i: int) -> Column:
        cells = F.array(*[F.when(RARE * F.col(f"k_{i}_{j}") <= F.col("n"), F.lit(c)) for j, c in enumerate(GRID)])
        return F.coalesce(F.array_min(cells), F.lit(GRID[0]))

    return per.select("stratum", *[scale(i).alias(f"scale_{r}") for i, r in enumerate(RULES)])


def scaled_thresholds(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """As ``joint_thresholds``, but a step of a chain is a multiple of each rule's own scale in the stratum.

    Scales come from an eighth of the good documents and tests from the others, so neither knows the other's.
    """
    held = good_documents(feats, labels).withColumn("tuning", F.substring(F.md5(F.concat(F.lit("tune:"), F.col("doc_id").cast("string")).cast("binary")), 1, 1) < TUNING)
    units = scales(held.filter("tuning"))
    x = held.filter("not tuning").join(F.broadcast(units), "stratum")

    def over(step: float) -> Column:
        out = F.lit(False)
        for r in RULES:
            out = out | (F.col(r) > F.lit(step) * F.col(f"scale_{r}"))
        return out

    names = [f"scale_{r}" for r in RULES]
    per = x.groupBy("stratum", *names).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~F.col("base_failed") & over(s)).alias(f"k_{j}") for j, s in enumerate(STEPS)])
    steps = F.array(*[F.struct(F.lit(j).alias("level"), F.lit(s).alias("step"), F.col(f"k_{j}").alias("k")) for j, s in enumerate(STEPS)])
    tests = per.select("stratum", *names, "n", F.explode(steps).alias("t")).select("stratum", *names, "n", "t.*")
    tests = tests.withColumn("p", binomial_at_most(F.col("k"), F.col("n"), alpha))
    chain = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = tests.withColumn("worst", F.max("p").over(chain)).filter(F.col("worst") <= delta / (len(STRATA) + 1))
    return passed.groupBy("stratum").agg(*[F.min(F.col("step") * F.col(f"scale_{r}")).alias(f"cut_{r}") for r in RULES])


def verdict(feats: DataFrame, cuts: DataFrame) -> DataFrame:
    """``feats`` with kept. ``cuts`` has a row per stratum at most, so it is broadcast."""
    x = feats.join(F.broadcast(cuts), "stratum", "left")
    dropped = F.lit(False)
    for r in RULES:
        dropped = dropped | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return x.withColumn("kept", ~F.col("base_failed") & ~dropped)


def judge(docs: DataFrame, labels: DataFrame, find: Callable[[DataFrame, DataFrame], DataFrame] = thresholds) -> DataFrame:
    """All values and verdicts; texts are read once, their values are written and used for both passes.

    find: how cutoffs are found, ``thresholds``, ``joint_thresholds`` or ``scaled_thresholds``.
    """
    feats = written(features(docs), "quality-values")
    return verdict(feats, find(feats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept by ``scaled_thresholds``, with all their columns."""
    rows = written(features(docs.select(F.struct("*").alias("row"), "doc_id", "lang", "text"), F.col("row")), "quality-rows")
    cuts = written(scaled_thresholds(rows.drop("row"), labels), "quality-cutoffs")
    return verdict(rows, cuts).filter("kept").select("row.*")
