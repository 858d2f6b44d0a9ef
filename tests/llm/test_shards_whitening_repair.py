"""Sharding, whitening and conversation repair against plain versions, with nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoleaf.llm import oracles, repair, sharding, whitening

WHITE = " \t\n\x0b\x0c\r"


# conversations


def plain_repair(rows):
    """rows of (conv, turn, role, text) -> {conv: figures} by a table of all states, each with all its least ways."""
    out = {}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        by[conv] += [] if d == 0 else [(turn, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)] * (2 if d == 3 else 1)
    for conv, rs in by.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        turns = [r[0] for r in rs if r[0] is not None]
        seen, faults = set(), []
        for _, role, text in rs:
            t = text.rstrip(WHITE)
            faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
            seen.add((role, text))
        n, c = Counter(faults), [r[1][:1] for r in rs]
        best = {"": (0, "", ())}

        def better(table, key, value):
            if key not in table or value[:2] < table[key][:2]:
                table[key] = value

        follow = {"": "us", "s": "u", "u": "a", "a": "u"}
        full = {"u": "user", "a": "assistant"}

        def inserts(table):
            for _ in range(4):
                for key, (cost, audit, text) in list(table.items()):
                    for f in follow[key]:
                        if f in full:
                            better(table, f, (cost + 5, audit + "I", (*text, full[f] + ":")))
            return table

        for (_, role, text), fault in zip(rs, faults, strict=True):
            now = {}
            for key, (cost, audit, kept) in inserts(best).items():
                better(now, key, (cost + 2, audit + "D", kept))
                if fault in ("blank", "duplicate"):
                    continue
                more = 5 * (fault == "truncated")
                for f in follow[key]:
                    if role[:1] == f:
                        better(now, f, (cost + more, audit + "K", (*kept, f"{role}:{text}")))
                    if f in full:
                        better(now, f, (cost + 1 + more, audit + "R", (*kept, f"{full[f]}:{text}")))
            best = now
        cost, audit, kept = min(v for k, v in inserts(best).items() if k in ("", "a"))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(c)), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string"


def conversations(seed=0, n=60, long=0):
    rnd = random.Random(seed)
    text = lambda: rnd.choice(["One. ", "two", "three!", "", " \t", None, "ünï?", "w " * rnd.randint(1, 9) + "."]) if rnd.random() < 0.7 else f"text {rnd.random()}."
    role = lambda: rnd.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "unit"])
    rows = [(rnd.choice([c, c, c, None]) if c % 9 == 0 else c, rnd.choice([t, t, t, t, None, t + 3]), role(), text()) for c in range(n) for t in range(rnd.randint(1, 9))]
    rows += [(10_000, t, "user" if t % 2 == 0 else "assistant", f"turn {t}{'.' if t % 7 else ''}") for t in range(long)]
    rows += [(10_001, t, role(), text()) for t in range(long)]
    return rows + rows[:5] + [(500, 7, "user", "Whole text."), (501, None, None, None)]


def check_repair(spark, rows, **extra):
    df = spark.createDataFrame(rows, CONV)
    df = df.withColumns({k: F.lit(v) for k, v in extra.items()})
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(df).select("conv_id", *repair.FIGURES, "repaired_sha256").collect()}
    assert got == plain_repair(rows)


def test_repair_equals_plain_version(spark):
    rows = conversations()
    check_repair(spark, rows, conv=1, audit="x", fault="y", place=3, row=4, gone=True)
    with duckdb.connect() as c:
        c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        got = c.execute(oracles.conversation_repair()).fetchall()
    assert {r[0]: tuple(r[1:]) for r in got} == plain_repair(rows)
    assert repair.repair_conversations(spark.createDataFrame([], CONV)).count() == 0


def test_repair_of_long_conversations_joins_parts(spark, monkeypatch):
    monkeypatch.setattr(repair, "PART", 7)
    monkeypatch.setattr(repair, "MERGE", 3)
    check_repair(spark, conversations(3, 10, long=300))


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_every_edit_list(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        tags = "".join(rnd.choice("suaxSUAX-") for _ in range(rnd.randint(0, 4)))
        found = repair.search(tags, repair.START, repair.ACCEPTED, False)
        ways = []

        def walk(at, state, cost, audit, tags=tags, ways=ways):
            if audit.endswith("III") or cost > 40:
                return
            if at == len(tags) and state in repair.ACCEPTED:
                ways.append((cost, audit))
            if at < len(tags):
                for c, e, to in repair.edges(tags[at], state):
                    walk(at + 1, to, cost + c, audit + e)
            walk(at, repair.EXPECTED[state][1], cost + 5, audit + "I")

        walk(0, repair.START, 0, "")
        assert found[0][2:] == min(ways)


# embeddings


def plain_whitening(rows, k=16):
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = Counter(len(v) for v in {tuple(v) for _, v in good})
    d = max(lengths, key=lambda x: (lengths[x], x))
    good = [(i, v) for i, v in good if len(v) == d]
    fit = sorted({tuple(v) for _, v in good})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = lambda v: np.array([(n * x - t) / n for x, t in zip(v, s, strict=True)])
    z = np.array([centre(v) for v in fit])
    cov = sum(np.outer(v, v) for v in z) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    take = [j for j in range(min(k, d)) if values[j] > 1e-12 * np.trace(cov)]
    return n, s, good, {(i, j): None for i, _ in good for j in take}, values, vectors, float(np.trace(cov)), centre


VECTORS = "vec_id long, embedding array<double>"


def vectors(seed=1, n=200, d=20):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n, d)) * np.linspace(1, 3, d) + rnd.normal(size=(n, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    hot = [(1000 + i, base[0].tolist()) for i in range(n // 2)]
    bad = [(2000, None), (2001, []), (2002, [None] * d), (2003, [float("nan")] + [0.0] * (d - 1)), (2004, [float("inf")] + [0.0] * (d - 1)), (2005, [1.0] * (d + 1)), (None, base[1].tolist()), (3, base[3].tolist())]
    return rows + hot + bad


def test_whitening_equals_plain_version(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS n", "2 AS component", "'a' AS x", "3 AS _key")
    got = whitening.whiten(df).collect()
    n, s, good, _, values, axes, trace, centre = plain_whitening(rows)
    assert Counter(r.vec_id for r in got) == Counter({i: 16 * c for i, c in Counter(i for i, _ in good).items()})
    z = {}
    for i, v in good:
        z[i] = (sum((n * x - t) ** 2 for x, t in zip(v, s, strict=True)), centre(v))
    signs = {}
    for r in got:
        j = r.component - 1
        dev, c = z[r.vec_id]
        assert (r.n, r.deviation) == (n, dev)
        assert r.explained == pytest.approx(values[j] / trace, rel=1e-9)
        want = c @ axes[:, j] / math.sqrt(values[j])
        sign = signs.setdefault(j, 1 if want * r.whitened > 0 else -1)
        assert r.whitened == pytest.approx(sign * want, abs=1e-8)
        assert r.identity_error < 1e-9
    fit = {tuple(v): centre(v) for _, v in good}
    white = np.array([[sign * (c @ axes[:, j]) / math.sqrt(values[j]) for j, sign in sorted(signs.items())] for c in fit.values()])
    assert np.abs(white.T @ white / n - np.eye(16)).max() < 1e-9


def test_whitening_of_few_and_large_vectors(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, VECTORS))
    assert make([]).count() == 0
    assert make([(1, [1.0, 2.0])]).count() == 0
    assert make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0
    line = make([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [2.0, 4.0])]).orderBy("vec_id").collect()
    assert [(r.component, r.n, r.deviation) for r in line] == [(1, 2, 64**2 + 128**2)] * 3
    assert sorted(abs(r.whitened) for r in line) == pytest.approx([1, 1, 1])
    large = make([(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [5e11, 2.0])]).collect()
    assert {r.deviation for r in large} == {None} and len(large) == 3 * len({r.component for r in large})


# shards


def even(sizes, largest):
    return max(sizes) - min(sizes) <= max(0.002 * sum(sizes), 2 * largest)


def test_shards_hold_groups_and_are_even(spark, make_docs, hard):
    rnd = random.Random(2)
    text = lambda: " ".join(f"w{rnd.randint(0, 900)}" for _ in range(rnd.randint(5, 200)))
    texts = [text() for _ in range(1500)]
    copies = [t for k in range(150) for t in [text()] * rnd.randint(2, 9)]
    rows = hard + list(enumerate(texts + copies, 100))
    df = make_docs(rows, extra=True)
    got = sharding.shard_documents(df.withColumns({"node": F.lit(1), "near": F.lit(2), "hub": F.lit(3), "shard": F.lit(9)})).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    load, at, by = Counter(), defaultdict(list), defaultdict(set)
    n = Counter((t or "") for _, t in rows)
    crc = {zlib.crc32(t.encode()): c for t, c in n.items()}
    for r in got:
        load[r.shard] += r.size
        at[r.shard].append(r.slot)
        by[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and r.near == crc[r.text_crc32] - 1
    assert set(load) == set(range(8)) and even(load.values(), 1300)
    assert all(sorted(s) == list(range(len(s))) for s in at.values())
    assert all(len(s) == 1 for s in by.values())


def test_shards_of_a_group_larger_than_a_shard(spark, make_docs):
    rows = [(i, "the same text again") for i in range(2000)] + [(5000 + i, f"another text {i // 2} of two") for i in range(2000)] + [(9000 + i, f"text number {i}") for i in range(1500)]
    got = sharding.shard_documents(make_docs(rows)).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert even(load.values(), 40)
    pairs = defaultdict(set)
    for r in got:
        if 5000 <= r.doc_id < 9000:
            pairs[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in pairs.values()) <= 0.03 * len(pairs)
    spread = Counter(r.shard for r in got if r.doc_id < 5000)
    assert sum(c for _, c in spread.most_common(4)) > 0.8 * 2000  # 36 % of all bytes need three shards of an eighth


def test_shards_of_few_documents(spark, make_docs):
    assert sharding.shard_documents(make_docs([])).count() == 0
    one = sharding.shard_documents(make_docs([(None, None)])).collect()
    assert [(r.size, r.text_crc32, r.slot) for r in one] == [(1, 0, 0)]


def test_shards_follow_links_over_several_hubs(spark):
    nodes = spark.range(800).select(F.col("id").alias("node"), F.lit(10).cast("long").alias("size"))
    links = nodes.select("node", F.floor(F.col("node") / 10).alias("hub")).union(nodes.filter("node % 10 = 0").select("node", F.floor(F.col("node") / 100) + 10_000))
    got = sharding.assign(nodes, links).collect()
    load, hubs = Counter(r.shard for r in got), defaultdict(Counter)
    for r in got:
        hubs[r.node // 10][r.shard] += 1
    assert max(load.values()) <= 110 and sum(c.most_common(1)[0][1] for c in hubs.values()) >= 0.8 * 800


def test_flows_stay_within_capacity():
    rnd = np.random.default_rng(4)
    for _ in range(50):
        load = rnd.uniform(50, 100, 8)
        want = rnd.uniform(0, 30, (8, 8)) * (1 - np.eye(8))
        x = sharding.flows(load, want, 90)
        assert (x <= want + 1e-9).all() and (x >= 0).all()
        assert (load + x.sum(0) - x.sum(1) <= np.maximum(load, 90) + 1.01).all()
