"""Scores of generated texts against a reference text: consensus of weighted n-grams, and word alignment.

Words are what white space separates, as they stand. Records without a text count as empty.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text whose n-grams a Python worker holds at a time, unless one text is longer.
PIECE = 1 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def odd_factors(most: int) -> np.ndarray:
    """An odd 64-bit factor for each of two sums, length of run, and place in the run."""
    digest = lambda *at: hashlib.md5(repr(at).encode()).digest()[:8]
    return np.frombuffer(b"".join(digest(s, n, j) for s in range(2) for n in range(most) for j in range(most)), "<u8").reshape(2, most, most) | np.uint64(1)


def shared_grams(a: pa.Array, b: pa.Array | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each n-gram in both a[i] and b[i]: i in rising order, its name, min(its count in a[i], in b[i]) * its count in b[i].

    Texts are words with a space between; no n-gram goes over the word "\\n". Without b, a[i] meets itself. A name
    is two sums of the halves of the words' md5, each word times a factor of its place: 64 bits of one, 32 of the other and n.
    """
    lists = pc.split_pattern(a if b is None else pa.concat_arrays([a, b]), " ")
    coded = lists.flatten().dictionary_encode()
    code, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    digest = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in known), "<u8").reshape(-1, 2)
    side_text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    stop = np.array([w in ("", "\n") for w in known], dtype=bool)[code]
    side, text = side_text >= len(a), side_text % len(a)
    if b is not None:  # only runs of words that both have can be in both
        word, at = text * len(known) + code, np.searchsorted(side, True)
        stop |= ~np.concatenate([np.isin(word[:at], word[at:]), np.isin(word[at:], word[:at])])
    stops, factors = np.cumsum(stop), odd_factors(most)
    for n in range(1, most + 1):
        end = np.arange(n - 1, len(code))
        i = np.flatnonzero((stops[end] == stops[end - n + 1]) & ~stop[end - n + 1] & (side_text[end] == side_text[end - n + 1]))
        h, g = (sum((digest[code[i + j], s] * factors[s, n - 1, j] for j in range(n)), np.zeros(len(i), np.uint64)) for s in range(2))
        order = np.argsort(h)
        order = order[np.argsort(text[i][order].astype(np.uint16), kind="stable")]
        i, h, g = i[order], h[order], g[order] << np.uint64(32) >> np.uint64(24) | np.uint64(n)
        t, later = text[i], side[i]
        if not len(t):
            continue
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
        count = np.diff(np.append(first, len(t)))
        of_b = count if b is None else np.add.reduceat(later.astype(np.int64), first)
        value = count * count if b is None else np.minimum(count - of_b, of_b) * of_b
        first, value = first[value > 0], value[value > 0]
        if len(first):
            yield t[first], np.stack([h[first], g[first]]).view(np.int64), value


def counted(most: int, met: bool):
    """For mapInArrow: batches (u, y, m, a), or (u, y, m, a, b) if met, become a row for each shared n-gram of a unit u, y.

    The first row of a unit's n-grams holds the sum of their values as well. Texts go in pieces of about PIECE bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = sum(pc.binary_length(c).to_numpy().astype(np.int64) for c in whole.columns[3:]) + 64
            piece = (np.cumsum(size) - size) // PIECE
            starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(whole) else []
            for start, end in zip(starts, [*starts[1:], len(whole)], strict=True):
                x = whole.slice(start, end - start)
                for at, names, value in shared_grams(x.column(3), x.column(4) if met else None, most):
                    total, first = np.zeros(len(at), np.int64), np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    total[first] = np.add.reduceat(value, first)
                    unit = x.select([0, 1, 2]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*unit.columns, *map(pa.array, names), pa.array(value), pa.array(total)], names=["u", "y", "m", "h", "g", "v", "total"])

    return run


def cider(records: DataFrame, key: str, pred: str = "pred", ref: str = "ref", most: int = 4, sigma: float = 6.0) -> DataFrame:
    """key, cider of each record: ten times the mean over n of the clipped TF-IDF cosine of n-grams, less for other lengths.

    The weight of an n-gram is log(records / records whose reference has it), as learnt from all references, at least one
    such taken. Predicted counts are clipped at the reference's, and exp(-d**2 / 2 sigma**2) discounts a difference
    of d two-word runs in length. Records that share a key count as one, with the texts of all; without a key they score 0.

    Each cosine is of three sums of value * weight**2: over the n-grams of the prediction, of the reference, and of those in
    both. Each different text, and each different pair of texts, is counted once, in a row for each of its n-grams. A text
    or pair goes by 128 bits of hash, an n-gram by 96. The rows meet by n-gram, and only n-grams of two or more references
    go on to the sums: the others all have the greatest weight, for which the sum of their values does. Nothing but the
    number of records is broadcast.
    """
    x = records.select(F.col(key).alias("_k"), words(F.col(pred)).alias("_p"), words(F.col(ref)).alias("_r"))
    text = lambda c: F.array_join(c, " ")
    texts = lambda c: F.array_join(F.sort_array(F.collect_list(text(c))), " \n ")
    runs = lambda c: F.size(F.split(c, " ")) - 2 * F.size(F.split(c, "\n"))  # noqa: E731  two-word runs, less one
    keyed = x.filter("_k IS NOT NULL").groupBy("_k").agg(texts("_p").alias("p"), texts("_r").alias("r"))
    unit = lambda *c: F.struct(F.xxhash64(*c).alias("u"), F.xxhash64(F.lit(most), *c).alias("y"))
    keyed = keyed.withColumns({"pp": unit("p"), "rr": unit("r")}).withColumn("pr", unit("pp", "rr"))
    side = lambda unit, m, a: F.struct(f"{unit}.u", f"{unit}.y", F.lit(m).cast("long").alias("m"), F.col(a).alias("a"))
    own = keyed.select(F.inline(F.array(side("pp", 0, "p"), side("rr", 1, "r")))).groupBy("u", "y").agg(F.sum("m").alias("m"), F.first("a").alias("a"))
    none = lambda name: F.lit(None).cast("long").alias(name)
    lost = x.filter("_k IS NULL").select(none("u"), none("y"), none("m"), text("_r").alias("a"))
    pairs = keyed.groupBy("pr.u", "pr.y").agg(F.lit(0).cast("long").alias("m"), F.first("p").alias("a"), F.first("r").alias("b"))
    kinds = "u long, y long, m long, h long, g long, v long, total long"
    rows = own.union(lost).mapInArrow(counted(most, False), kinds).union(pairs.mapInArrow(counted(most, True), kinds))
    gram = Window.partitionBy("h", "g")
    df = F.sum(F.coalesce("m", F.lit(0))).over(gram) + F.max(F.col("m").isNull().cast("int")).over(gram)
    total = x.agg(F.log(F.count(F.lit(1)).cast("double")).alias("_all"))  # one row
    seen = rows.withColumn("df", df).filter("u IS NOT NULL AND (df > 1 OR total > 0)").join(F.broadcast(total))
    w, known = F.col("_all") - F.log(F.greatest(F.col("df"), F.lit(1)).cast("double")), F.col("df") > 1
    is_n = lambda n: F.col("g").bitwiseAND(255) == n
    rest = lambda n: F.sum(F.when(is_n(n), F.col("total") - F.when(known, F.col("v")).otherwise(0)).otherwise(0))
    weighed = lambda n: F.sum(F.when(is_n(n) & known, F.col("v") * w * w).otherwise(0.0))
    sums = seen.groupBy("u", "y").agg(F.array(*[F.max("_all") * F.max("_all") * rest(n) + weighed(n) for n in range(1, most + 1)]).alias("sums"))
    links = keyed.select("_k", (runs(F.col("p")) - runs(F.col("r"))).cast("long").alias("_d"), F.inline(F.array(*[F.struct(F.lit(s).alias("s"), f"{s}.u", f"{s}.y") for s in ("pp", "rr", "pr")])))
    found = lambda s: F.max(F.when(F.col("s") == s, F.col("sums"))).alias(s)
    by = links.join(sums.hint("merge"), ["u", "y"], "left").groupBy("_k").agg(F.max("_d").alias("_d"), found("pp"), found("rr"), found("pr"))
    cosine = lambda i: F.coalesce(F.try_divide(F.col("pr")[i], F.sqrt(F.col("pp")[i]) * F.sqrt(F.col("rr")[i])), F.lit(0.0))
    score = 10.0 * sum((cosine(i) for i in range(1, most)), cosine(0)) / most * F.exp(-(F.col("_d") * F.col("_d")) / (2 * sigma * sigma))
    scores = by.select(F.col("_k").alias("_b"), score.alias("cider"))
    return x.select("_k").join(scores.hint("merge"), F.col("_k") == F.col("_b"), "left").select(F.col("_k").alias(key), F.coalesce("cider", F.lit(0.0)).alias("cider"))


def fewest_chunks(pred: Sequence[str], ref: Sequence[str], beam: int = 16) -> tuple[int, int]:
    """(matches, chunks) of an alignment of equal words with the most matches and, of these, the fewest runs.

    A run is adjacent in both texts. Words are placed from the left; a state is (places used, place before, words still to
    be left out), and the ``beam`` states with the fewest runs go on. With at most that many states the result is exact.
    """
    cp, cr = Counter(pred), Counter(ref)
    both = {w: min(cp[w], cr[w]) for w in cp if w in cr}
    m = sum(both.values())
    if not m:
        return 0, 0
    places: dict[str, list[int]] = {}
    for j, w in enumerate(ref):
        if w in both:
            places.setdefault(w, []).append(j)
    spare = {w: cp[w] - both[w] for w in both}
    # (used places as bits, place of the word before or -2, words left out so far) -> runs
    states: dict[tuple, int] = {(0, -2, ()): 0}
    for w in pred:
        if w not in both:
            after: dict[tuple, int] = {}
            for (used, _, out), runs in states.items():
                k = (used, -2, out)
                after[k] = min(runs, after.get(k, runs))
            states = after
            continue
        after = {}
        for (used, before, out), runs in states.items():
            if spare[w]:
                gone = dict(out)
                if gone.get(w, 0) < spare[w]:
                    gone[w] = gone.get(w, 0) + 1
                    k = (used, -2, tuple(sorted(gone.items())))
                    after[k] = min(runs, after.get(k, runs))
            for j in places[w]:
                if not used >> j & 1:
                    k, v = (used | 1 << j, j, out), runs + (j != before + 1)
                    if v < after.get(k, v + 1):
                        after[k] = v
        if len(after) > beam:
            after = dict(sorted(after.items(), key=lambda s: (s[1], s[0][1], s[0][0]))[:beam])
        states = after
    return m, min(states.values())


def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, matches, chunks and the numbers of words of batches (k, p, r). Words become Python objects for one record at a time."""
    for b in batches:
        found = [fewest_chunks(p.as_py(), r.as_py()) for p, r in zip(b.column(1), b.column(2), strict=True)]
        sizes = [pc.list_value_length(b.column(i)).cast(pa.int64()) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), *sizes], names=["k", "matches", "chunks", "np", "nr"])


def meteor(records: DataFrame, key: str, pred: str = "pred", ref: str = "ref", alpha: float = 0.85, beta: float = 0.2, gamma: float = 0.6) -> DataFrame:
    """key, matches, chunks, meteor of each record, by equal words in lower case.

    Precision and recall of the aligned words give F = P R / (alpha P + (1 - alpha) R), and 1 - gamma (chunks / matches)**beta
    punishes broken order. Stems, synonyms and paraphrases need tables that no public function of Spark has; they are not matched.
    """
    kind = dict(records.dtypes)[key]
    lower = lambda c: words(F.lower(c))
    x = records.select(F.col(key).alias("k"), lower(F.col(pred)).alias("p"), lower(F.col(ref)).alias("r")).mapInArrow(align, f"k {kind}, matches long, chunks long, np long, nr long")
    p, r, m = F.col("matches") / F.col("np"), F.col("matches") / F.col("nr"), F.col("matches")
    score = p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * F.pow(F.col("chunks") / m, F.lit(beta)))
    return x.select(F.col("k").alias(key), "matches", "chunks", F.when(m > 0, score).otherwise(0.0).alias("meteor"))
