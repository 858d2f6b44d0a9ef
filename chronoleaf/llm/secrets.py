"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger holds which (blob, rule version)
pairs were scanned and what was found; a scan reads only blobs with a pair that is not in it, appends to it,
and joins findings back to all paths that hold a blob. Matches get their places from the lengths of the pieces
between them, summed by a window per blob and rule, so nothing but built-in functions runs.

Hashes are compared with the ledger before any text moves. Without unseen blobs no text is read again; a table of
unseen blobs of at most SMALL bytes is broadcast to the texts; beyond that texts pass a sieve (a bitmap of SIEVE
bits, so of a fixed size) of the unseen blobs before the rest is shuffled. Findings are read for the blobs at hand.

The ledger is two folders of Parquet files, findings and scanned. Findings are written first; a run that ends
between the two, its first one included, repeats its scan. So findings that a folder already held are read as a set.

Defined cases: a null text is empty; a null path stays a path; copies share one scan and all get its findings;
repeated rows get repeated results; matches that touch or overlap between kinds are all kept; an empty table
gives an empty table and an empty ledger; other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoleaf.llm.common import fresh_path, written


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters. ``hint``: a text without it has none."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order of the listed kinds.
BASE = (
    Rule("assign", 1, r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
#: What this scan adds: formats that name themselves.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, "eyJ"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, "xox"),
    Rule("hosting", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "_"),
)
RULES = BASE + ADDED
#: What redaction adds, so that the whole key goes and not its first line alone.
WHOLE_KEY = Rule("pem_block", 1, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----")

#: Most bytes of a table that is broadcast, and bits of a sieve.
SMALL, SIEVE = 16 << 20, 1 << 27

FINDINGS = "blob binary, kind string, version int, start long, end long"
SCANNED = "blob binary, rules array<string>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def matches(text: Column, rule: Rule) -> Column:
    """An array of (gap, len, cap): characters before each match since the one before, its own, its group's."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    found = lambda g: lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)))
    gaps = F.slice(lengths(F.split(text, rule.pattern, -1)), 1, F.size(found(0)))
    all_ = F.arrays_zip(gaps.alias("gap"), found(0).alias("len"), found(rule.group).alias("cap"))
    there = F.contains(text, F.lit(rule.hint)) & F.rlike(text, F.lit(rule.pattern)) if rule.hint else F.rlike(text, F.lit(rule.pattern))
    return F.when(there, all_)


def find(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blobs (blob, text, todo: keys of rules) -> FINDINGS."""
    each = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), F.when(F.array_contains("todo", r.key), matches(F.col("text"), r)).alias("m")) for r in rules])
    rows = blobs.select("blob", F.explode(each).alias("r")).filter(F.col("r.m").isNotNull())
    rows = rows.select("blob", "r.kind", "r.version", "r.least", F.posexplode("r.m").alias("i", "m")).select("blob", "kind", "version", "least", "i", "m.*").distinct()
    upto = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("stop", F.sum(F.col("gap").cast("long") + F.col("len")).over(upto)).filter("cap >= least")
    return placed.select("blob", "kind", F.col("version").cast("int").alias("version"), (F.col("stop") - F.col("len")).alias("start"), F.col("stop").alias("end"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def if_small(table: DataFrame, bytes_of: Column) -> tuple[DataFrame, bool]:
    """``table``, to be broadcast if its rows have at most SMALL bytes; and whether it is."""
    small = table.agg(F.coalesce(F.sum(bytes_of), F.lit(0))).first()[0] <= SMALL
    return (F.broadcast(table) if small else table), small


def bit_of(blob: Column) -> Column:
    return F.pmod(F.xxhash64(blob), F.lit(SIEVE))


def sieved(rows: DataFrame, blobs: DataFrame, b: str) -> DataFrame:
    """``rows`` with ``met``: false only if the blob in column ``b`` is not in ``blobs``. Bitmaps have SIEVE bits at most."""
    bits = blobs.select(bit_of(F.col("blob")).alias("bit"))
    maps = bits.groupBy(F.bitmap_bucket_number("bit").alias("sieve")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    place = F.bitmap_bit_position(bit_of(F.col(b))).cast("int")
    byte = F.conv(F.hex(F.call_function("substring", F.col("bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")) % 2 == 1, F.lit(False))
    return rows.join(F.broadcast(maps), F.bitmap_bucket_number(bit_of(F.col(b))) == F.col("sieve"), "left").withColumn("met", met).drop("sieve", "bits")


def texts_of(versions: DataFrame, reps: DataFrame, all_new: bool = False) -> DataFrame:
    """blob, text, todo of the representatives of unseen blobs; ``reps`` (blob, path, todo) is a written table.

    all_new: there is nothing to keep back; the texts are shuffled by blob.
    """
    texts = versions.select(F.col("path").alias("p"), blob_of(F.col("text")).alias("b"), F.coalesce("text", F.lit("")).alias("text"))
    side = reps.hint("merge")
    if not all_new:
        side, small = if_small(reps, F.lit(200))
        if not small:
            texts = sieved(texts, reps, "b").filter("met")
    return texts.join(side, (F.col("b") == F.col("blob")) & F.col("p").eqNullSafe(F.col("path"))).select("blob", "text", "todo")


def scan(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """versions (path, text) -> (paths: path, blob of every row; findings of their blobs by these rules).

    ``ledger`` is a folder of an earlier scan or a new one; without it, a new one in the shared folder.
    """
    spark = versions.sparkSession
    ledger = ledger or fresh_path(spark, "ledger")
    paths = written(versions.select("path", blob_of(F.col("text")).alias("blob")), "paths")
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    old, stale = exists(spark, f"{ledger}/scanned"), exists(spark, f"{ledger}/findings")
    if old:
        blobs = written(blobs, "blobs")
        at_hand = blobs.select(F.col("blob").alias("k"))
        seen = spark.read.schema(SCANNED).parquet(f"{ledger}/scanned").join(at_hand, F.col("blob") == F.col("k"), "left_semi")
        seen = seen.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
        reps = blobs.join(seen, "blob", "left").select("blob", "path", todo.alias("todo")).filter(F.size("todo") > 0)
    else:
        reps = blobs.withColumn("todo", keys)
    reps = written(reps, "unseen", True)
    if not old or reps.limit(1).count():
        find(texts_of(versions, reps, not old), rules).write.mode("append").parquet(f"{ledger}/findings")
        reps.select("blob", F.col("todo").alias("rules")).write.mode("append").parquet(f"{ledger}/scanned")
    known = F.concat_ws("@", "kind", "version").isin([r.key for r in rules])
    findings = spark.read.schema(FINDINGS).parquet(f"{ledger}/findings").filter(known)
    if old:
        findings = findings.join(at_hand, F.col("blob") == F.col("k"), "left_semi")
    return paths, findings.distinct() if stale else findings


def spans_by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with findings: counts of the base kinds, the base and all spans as text."""
    order = F.array(*[F.lit(r.kind) for r in rules])
    rows = findings.select("blob", F.struct("start", F.array_position(order, F.col("kind")).alias("o"), "kind", "end").alias("s"))
    base = [r.kind for r in BASE]
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    listed = rows.groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("s"))
    of_kind = lambda k: F.filter("s", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return listed.select("blob", *counts, text(F.filter("s", lambda s: s["kind"].isin(base))).alias("base"), text(F.col("s")).alias("spans"))


def scan_table(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of ``docs``."""
    paths, findings = scan(docs.select(F.col("doc_id").alias("path"), "text"), ledger, rules)
    found = written(spans_by_blob(findings).withColumnRenamed("blob", "b"), "spans", True)
    found, _ = if_small(found, F.octet_length("base") + F.octet_length("spans") + 100)
    x = paths.join(found, F.col("blob") == F.col("b"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return x.select(F.col("path").alias("doc_id"), zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


#: A later version of the first rule, for longer values only, with the others as they are.
NEWER = (Rule("assign", 2, BASE[0].pattern, 2, 16), *RULES[1:])


def rescan(docs: DataFrame, first: Column, rules: tuple[Rule, ...] = NEWER) -> DataFrame:
    """The rows of ``scan_table`` by newer rules, after a scan of the rows where ``first`` holds by RULES.

    pairs: how many (blob, rule version) pairs the second scan had to look at for the row's blob.
    """
    spark, ledger = docs.sparkSession, fresh_path(docs.sparkSession, "ledger")
    scan(docs.filter(first).select(F.col("doc_id").alias("path"), "text"), ledger)
    x = scan_table(docs.select("doc_id", "text"), ledger, rules)
    late = spark.read.schema(SCANNED).parquet(f"{ledger}/scanned").filter(F.array_contains("rules", rules[0].key))
    late = late.groupBy("blob").agg(F.max(F.size("rules")).cast("long").alias("pairs"))
    pairs = docs.select(F.col("doc_id").alias("d"), blob_of(F.col("text")).alias("blob")).distinct().join(late, "blob")
    return x.join(pairs, F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "n_assign", "spans", "pairs")


def redact(docs: DataFrame, ledger: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of touching or overlapping findings in text replaced; n_chars follows if it is there."""
    _, findings = scan(docs.select(F.col("doc_id").alias("path"), "text"), ledger, (*RULES, WHOLE_KEY))
    before = Window.partitionBy("blob").orderBy("start", "end")
    runs = findings.withColumn("past", F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum(F.when(F.col("past") >= F.col("start"), 0).otherwise(1)).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("blob", "run").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    runs = written(runs.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs")), "runs", True)
    side, small = if_small(runs, 100 + 16 * F.size("runs"))
    side = side.withColumnRenamed("blob", "found")
    rows = docs.select(F.struct("*").alias("row"), blob_of(F.col("text")).alias("blob"))
    if small:
        rows = rows.join(side, F.col("blob") == F.col("found"), "left")
    else:
        # rows that the sieve proves clean stay where they are
        rows = sieved(rows, runs, "blob")
        clean = rows.filter("not met").select("row", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
        rows = rows.filter("met").join(side, F.col("blob") == F.col("found"), "left").select("row", "runs").union(clean)
    text, r = F.col("row.text"), F.col("runs")

    def piece(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(r, i - 1)["b"])
        stop = F.when(i == F.size(r), F.length(text)).otherwise(F.get(r, i)["a"])
        return F.substring(text, (start + 1).cast("int"), (stop - start).cast("int"))

    clean = F.when(r.isNull(), text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.size(r)), piece), mark))
    out = rows.select("row", clean.alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*[(F.when(F.col("row.text").isNull(), F.col("row.n_chars")).otherwise(changed[c]) if c == "n_chars" else changed[c]).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
