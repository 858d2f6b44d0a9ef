"""Repair of conversation structure by Dijkstra's search on the edit lattice.

A conversation's rows, in order of turn, are to give role initials that match ``(s?(ua)+)?``. A lattice node is (rows
consumed, grammar state), with the states nothing yet, system, user, assistant. Edges keep a row (0), rerole it to what the
grammar expects next (1), delete it (2), or insert that role with an empty text (5); a truncated row that stays costs 5
more. Nodes are popped by (cost, audit), where audit has the initial of each edit, and the search stops at the first
popped end node that the grammar accepts. That order is exact: edges never lower a key, and of two audits that reach a
node at one cost none begins the other, as inserts alone lead back to a node only at a cost.

Rows are ranked within their conversation by ranges, and searched in parts of PART rows. Conversations of up to PART rows,
thus nearly all, are one search. Of a longer one, each part is searched from every state it can be entered in to every
state it can be left in, and the parts' tables are joined pairwise in the same order of (cost, audit), MERGE parts at a
time, until one is left; so no task holds a long conversation's rows. Texts move once: sorted by conversation and turn
they stream past the audit into a running SHA-256, which is the one thing that takes a conversation's texts in sequence.

Defined cases: nulls in role or text, and in the key that decides the damage, count as one space; rows with a null conv_id
are one conversation; null turns come first; rows of one turn are in order of the md5 of role and text. A role whose
first character is not s, u or a (an empty one included) fits no state, so its row is reroled or deleted. An id without
rows after damage has zeros, an empty audit and the hash of the empty string. An empty table gives no rows; other columns
are ignored. Rows that repeat a row in all columns are duplicates like any others.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoleaf.llm.common import WHITE, bound_batches, discard, written
from chronoleaf.operators.ranks import ranked

PART, MERGE = 256, 32
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
#: What each state expects next, and the state that a role's initial leads to.
EXPECTED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: A row as one letter: its initial (x for any other), upper case if truncated; MUST where it has to go.
MUST = "-"

PATHS = "array<struct<entry: int, exit: int, cost: long, audit: string>>"
SPAN = f"struct<paths: {PATHS}, illegal: long, head: string, tail: string>"


def edges(tag: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, edit, next state) of what can be done with a row."""
    out = [(DELETE, "D", state)]
    if tag != MUST:
        extra = TRUNCATED * tag.isupper()
        if (state, tag.lower()) in KEPT:
            out.append((extra, "K", KEPT[state, tag.lower()]))
        out.append((REROLE + extra, "R", EXPECTED[state][1]))
    return out


def search(tags: str, entry: int, exits: tuple[int, ...], every: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of the cheapest way to the first popped end node in ``exits``, or to each of them."""
    found, done, heap = [], set(), [(0, "", 0, entry)]
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(tags) and state in exits:
            found.append((entry, state, cost, audit))
            if not every or len(found) == len(exits):
                break
        if at < len(tags):
            for more, edit, to in edges(tags[at], state):
                if (at + 1, to) not in done:
                    heapq.heappush(heap, (cost + more, audit + edit, at + 1, to))
        to = EXPECTED[state][1]
        if (at, to) not in done:
            heapq.heappush(heap, (cost + INSERT, audit + "I", at, to))
    return found


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def part(tags: str, initials: list[str], first: bool, last: bool) -> tuple:
    """The table of one part of a conversation."""
    entries = (START,) if first else (START, SYSTEM, USER, ASSISTANT)
    exits = ACCEPTED if last else (START, SYSTEM, USER, ASSISTANT)
    paths = [p for e in entries for p in search(tags, e, exits, not last)]
    bad = sum(not legal(a, b) for a, b in zip(initials, initials[1:]))
    return paths, bad, initials[0], initials[-1]


def joined(parts: list) -> tuple:
    """The table of adjacent parts taken together."""
    paths, illegal, head, tail = parts[0]
    best = {(p[0], p[1]): (p[2], p[3]) for p in paths}
    for more, bad, h, t in parts[1:]:
        out: dict = {}
        by_entry: dict = {}
        for entry, leave, cost, audit in more:
            by_entry.setdefault(entry, []).append((leave, cost, audit))
        for (entry, mid), (cost, audit) in best.items():
            for leave, c, a in by_entry.get(mid, ()):
                key, was = (entry, leave), out.get((entry, leave))
                if was is None or (cost + c, audit + a) < was:
                    out[key] = (cost + c, audit + a)
        best, illegal, tail = out, illegal + bad + (not legal(tail, h)), t
    return [(e, x, c, a) for (e, x), (c, a) in best.items()], illegal, head, tail


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, gone of every row after its damage; rows that are dropped stay with gone true."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    x = conversations.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return x.select("conv", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_d") == 0).alias("gone"), F.explode(times).alias("_time")).drop("_time")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds digest, initial and the fault that shows in the row alone: blank or truncated."""
    last = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    return rows.select("*", F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))).alias("digest"), F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), F.monotonically_increasing_id().alias("row"))


ORDER = ("turn", "digest", "row")


def order(*before: str) -> list[Column | str]:
    return [*before, F.col("turn").asc_nulls_first(), "digest", "row"]


def with_duplicates(light: DataFrame) -> DataFrame:
    """place (from 1) of each row in its conversation; fault duplicate where an earlier row has its role and text."""
    x = written(ranked(light, order(), by=["conv"], rank="place"), "turn-places")
    seen = x.groupBy("conv", "digest").agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    seen = seen.select(F.col("conv").alias("_conv"), F.col("digest").alias("_digest"), "_first")
    x = x.join(seen, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    again = F.coalesce(F.col("place") > F.col("_first"), F.lit(False))
    return x.withColumn("fault", F.when(F.col("fault") == "blank", "blank").when(again, "duplicate").otherwise(F.col("fault"))).drop("_conv", "_digest", "_first")


def audits(tagged: DataFrame) -> DataFrame:
    """conv, cost, audit, illegal of every conversation that has rows."""
    at = F.floor((F.col("place") - 1) / PART)
    tag = F.when(F.col("fault").isin("blank", "duplicate"), MUST).otherwise(F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("x")))
    tag = F.when(F.col("fault") == "truncated", F.upper(tag)).otherwise(tag)
    lasts = tagged.groupBy("conv").agg(F.floor((F.max("place") - 1) / PART).alias("_last"))
    x = tagged.groupBy("conv", at.alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", tag.alias("t"), "initial"))).alias("r"))
    x = x.join(lasts.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")))
    one = F.udf(part, T._parse_datatype_string(SPAN), useArrow=True)
    x = written(x.select("conv", "part", one(F.array_join("r.t", ""), F.col("r.initial"), F.col("part") == 0, F.col("part") == F.col("_last")).alias("s")), "parts", True)
    while x.agg(F.max("part")).first()[0]:
        many = F.udf(joined, T._parse_datatype_string(SPAN), useArrow=True)
        y = x.groupBy("conv", F.floor(F.col("part") / MERGE).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "s"))), lambda p: p["s"]).alias("s"))
        y = written(y.select("conv", "part", many("s").alias("s")), "parts", True)
        discard(x)
        x = y
    best = F.array_min(F.transform("s.paths", lambda p: F.struct(p["cost"].alias("cost"), p["audit"].alias("audit"))))
    return x.select("conv", best.alias("b"), F.col("s.illegal").alias("illegal")).select("conv", F.col("b.cost").alias("cost"), F.col("b.audit").alias("audit"), "illegal")


def figures(tagged: DataFrame, rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated of every id of the table, those without rows left included."""
    every = tagged.select("conv", "turn", "fault").union(rows.filter("gone").select("conv", F.lit(None).cast("long"), F.lit(None).cast("string")))
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn")
    return every.groupBy("conv").agg(F.coalesce(gaps.try_cast("long"), F.lit(0).cast("long")).alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def hashed(heads: DataFrame, rows: DataFrame, key: str, kind: str) -> DataFrame:
    """heads (conv and FIGURES) with the hash of the repaired conversation: each head is followed by its rows in order."""
    text = lambda c: F.lit(None).cast("string").alias(c)
    x = heads.select("conv", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("row"), text("role"), text("text"), *FIGURES)
    blank = [F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in FIGURES]
    x = x.union(rows.filter("NOT gone").select("conv", F.lit(1), "turn", "digest", "row", "role", "text", *blank))
    x = x.repartition("conv").sortWithinPartitions("conv", "_kind", *order()).select("conv", "_kind", "role", "text", *FIGURES)

    class Repaired:
        """Follows an audit row by row; holds a hash and a place, never texts."""

        def __init__(self, head: list):
            self.head, self.audit, self.at, self.state, self.hash, self.any = head, head[-1], 0, START, hashlib.sha256(), False

        def add(self, role: str, text: str) -> None:
            self.hash.update(f"{chr(10) * self.any}{role}:{text}".encode())
            self.any = True

        def inserts(self) -> None:
            while self.audit[self.at : self.at + 1] == "I":
                role, self.state = EXPECTED[self.state]
                self.add(role, "")
                self.at += 1

        def row(self, role: str, text: str) -> None:
            self.inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = KEPT[self.state, role[:1]]
                self.add(role, text)
            elif edit == "R":
                role, self.state = EXPECTED[self.state]
                self.add(role, text)

        def end(self) -> list:
            self.inserts()
            return [*self.head, self.hash.hexdigest()]

    names = ["conv", *FIGURES, "sha"]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            out = []
            conv, kinds, roles, texts, *rest = (c.to_pylist() for c in b.columns)
            for k, head in enumerate(kinds):
                if head == 0:
                    if now:
                        out.append(now.end())
                    now = Repaired([conv[k], *(c[k] for c in rest)])
                else:
                    now.row(roles[k], texts[k])
            yield batch(out)
        yield batch([now.end()] if now else [])

    conv_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    types = [conv_type, *(pa.string() if c == "audit" else pa.int64() for c in FIGURES), pa.string()]

    def batch(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names=names)

    done = x.mapInArrow(follow, ", ".join([f"conv {kind}", *(f"{c} {'string' if c == 'audit' else 'long'}" for c in FIGURES), "sha string"]))
    return done.select(F.col("conv").alias(key), *FIGURES, F.col("sha").alias("repaired_sha256"))


def repair(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """rows (conv, turn, role, text, gone) -> one row for each conversation: its faults, cheapest edits and their result's hash."""
    spark = rows.sparkSession
    bound_batches(spark)
    kind = dict(rows.dtypes)["conv"]
    rows = written(with_faults(rows), "turns")
    light = rows.filter("NOT gone").select("conv", "turn", "digest", "row", "initial", "fault")
    tagged = written(with_duplicates(light), "turn-tags", True)
    heads = figures(tagged, rows).join(audits(tagged).withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")), "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("illegal", "cost")}
    heads = heads.withColumns({**zero, "audit": F.coalesce("audit", F.lit(""))})
    return hashed(heads, rows, key, kind)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """The repair of a table of conversations after its damage."""
    return repair(damaged(conversations))
