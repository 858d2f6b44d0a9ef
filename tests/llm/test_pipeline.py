"""The pipeline stage by stage on the smallest tables, against plain versions of each stage."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import numpy as np
from test_operators import near_by_hand, quality_values
from tokenizers import Tokenizer

from chronoleaf.llm import queries
from chronoleaf.llm.common import written
from chronoleaf.llm.tokenize import tokenizer_path


SECRETS = (
    (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 12),
    (re.compile("AKIA[A-Z0-9]+"), 0, 18),
    (re.compile("[0-9a-f]+"), 0, 16),
    (re.compile("-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(.*?-----END [A-Z0-9 ]*PRIVATE KEY-----)?", re.S), 0, 1),
    (re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), 0, 1),
    (re.compile("xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 1),
    (re.compile("gh[pousr]_[A-Za-z0-9]{36,}"), 0, 1),
)


def redacted(text):
    runs = []
    for a, b in sorted((m.start(), m.end()) for p, group, least in SECRETS for m in p.finditer(text) if len(m[group]) >= least):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    for a, b in reversed(runs):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def copies(docs):
    """doc_id -> (source, text) to doc_id -> how often the mix takes it."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, (_, t) in docs.items()}
    total = Counter()
    for i, (s, _) in docs.items():
        total[s] += size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, capped = {s: 1 + k % 3 for k, s in enumerate(names)}, set()
    while True:
        rest, w = sum(total.values()) - sum(3 * total[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * total[s] if s in capped else rest * weight[s] / w for s in names}
        more = {s for s in names if target[s] > 3 * total[s] and s not in capped}
        if not more:
            break
        capped |= more
    out = {}
    for i, (s, _) in docs.items():
        rate = target[s] / total[s] if total[s] else 0.0
        draw = int(hashlib.md5(f"mix:7:{i}".encode()).hexdigest()[:13], 16) / 2**52
        out[i] = int(rate) + (draw < rate - int(rate))
    return out


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, out = [n for n, _ in corpus_pipeline.STAGES], {}
    assert 4 <= len(names) <= 5
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = written(stage(spark, docs, sf), "test-stage")
    first = spark.read.parquet(f"{sf}/documents.parquet")
    assert all(out[n].columns == first.columns for n in names[:-1])
    kept = {r.doc_id: r.text for r in out["quality rules"].collect()}
    good = {r.doc_id: r.text for r in first.collect() if not quality_values(r.text)[-1]}
    assert kept == good  # too few labels here to certify a cutoff
    groups = near_by_hand(list(good.items()), 5, 80)
    one = {r.doc_id for r in out["near-duplicates"].collect()}
    assert one == {root for _, root in groups.values()}
    clean = {r.doc_id: r.text for r in out["secret scan"].collect()}
    assert clean == {i: redacted(good[i]) for i in one} and any("[SECRET]" in t for t in clean.values())
    of = {r.doc_id: r.source for r in first.collect()}
    mixed = Counter((r.doc_id, r.text) for r in out["mixing"].collect())
    assert mixed == Counter({(i, clean[i]): n for i, n in copies({i: (of[i], t) for i, t in clean.items()}).items() if n})
    pieces = out["packing"].collect()
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for (i, t), n in mixed.items():
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for a in range(0, len(ids), 2048):
            want[(i, a // 2048, a, ids[a : a + 2048].tobytes())] += n
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in pieces) == want
    filled = Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 1


def test_queries_cover_all_operators():
    assert {int(m[1]) for n in queries.queries() if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
