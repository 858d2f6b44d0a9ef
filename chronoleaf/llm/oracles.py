"""DuckDB SQL of the operators that SQL can express: secret scans, quality rules and mixing."""

from __future__ import annotations

from chronoleaf.llm import mixing, quality_rules, secrets

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scan(rules: tuple[secrets.Rule, ...] = secrets.RULES) -> str:
    """Every rule's matches with places from the lengths of the pieces between them."""
    parts = []
    for k, r in enumerate(rules):
        p = quoted(r.pattern)
        parts.append(
            f"SELECT doc_id, {k} AS o, '{r.kind}' AS kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n "
            f"FROM (SELECT doc_id, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS c FROM d WHERE regexp_matches(t, {p})), generate_series(1, len(m)) AS s(i) WHERE length(c[i]) >= {r.least}"
        )
    base = len(secrets.BASE)
    text = "string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, o)"
    counts = ", ".join(f"coalesce(count_if(kind = '{r.kind}'), 0) AS n_{r.kind}" for r in secrets.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)}),
s AS (SELECT doc_id, {counts}, {text} FILTER (WHERE o < {base}) AS base, {text} AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}' for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)"""


def values() -> str:
    """CTEs v (counts and rule values of each document) and good (doc_id)."""
    q = quality_rules
    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM d, generate_series(1, len(w) - 4) AS g(i) WHERE len(w) >= 6),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM x), z AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM y, generate_series(0, 4) AS g(j) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
n AS (SELECT d.doc_id, CASE WHEN lang IN ({', '.join(map(quoted, q.STRATA))}) THEN lang ELSE 'other' END AS stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
 len(lines) AS n_lines, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits FROM d JOIN l USING (doc_id) LEFT JOIN z USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS symbol_rate, coalesce(n_upper::DOUBLE / nullif(word_chars, 0), 0) AS upper_rate, coalesce(n_bangs::DOUBLE / nullif(n_words, 0), 0) AS bang_rate, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_rate, coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS repeat_rate, coalesce(n_digits::DOUBLE / nullif(word_chars, 0), 0) AS digit_rate FROM n),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1)"""


def binomial(p: float) -> str:
    """P(at most k of n), of columns k and n."""
    return f"CASE WHEN k >= n * {p!r}::DOUBLE THEN 1e0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}::DOUBLE) + (n - j) * ln(1 - {p!r}::DOUBLE))) FROM generate_series(0, k::BIGINT) AS g(j)) END"


def quality(joint: bool = False) -> str:
    """joint: one chain per stratum, whose steps lower all cutoffs and count the good documents that any rule drops."""
    q = quality_rules
    cuts = "(VALUES " + ", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(q.CUTOFFS)) + ") AS c(level, cutoff)"
    melted = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, {i} AS rule, {r} AS v FROM v" for i, r in enumerate(q.RULES))
    p = q.ALPHA if joint else q.ALPHA / len(q.RULES)
    level = q.DELTA / ((len(q.STRATA) + 1) * (1 if joint else len(q.RULES)))
    if joint:
        melted = f"SELECT doc_id, stratum, base_failed, 0 AS rule, greatest({', '.join(q.RULES)}) AS v FROM v"
    return f"""{values()}, m AS ({melted}),
k AS (SELECT stratum, rule, level, cutoff, count(*) AS n, count_if(NOT base_failed AND v > cutoff) AS k FROM m JOIN good USING (doc_id), {cuts} GROUP BY ALL),
p AS (SELECT stratum, rule, level, cutoff, {binomial(p)} AS p FROM k),
t AS (SELECT *, max(p) OVER (PARTITION BY stratum, rule ORDER BY level ROWS UNBOUNDED PRECEDING) AS worst FROM p), c AS (SELECT stratum, rule, min(cutoff) AS cut FROM t WHERE worst <= {level!r}::DOUBLE GROUP BY ALL),
dropped AS (SELECT DISTINCT doc_id FROM m JOIN c USING (stratum, rule) WHERE v > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM dropped) AS kept FROM v"""


def quality_scaled() -> str:
    """Scales from an eighth of the good documents, chains of multiples of them tested on the others."""
    q = quality_rules
    melted = " UNION ALL ".join(f"SELECT stratum, {i} AS rule, {r} AS x FROM h WHERE tuning AND NOT base_failed" for i, r in enumerate(q.RULES))
    grid = ", ".join(f"({c}::DOUBLE)" for c in q.GRID)
    steps = ", ".join(f"({j}, {m}::DOUBLE)" for j, m in enumerate(q.STEPS))
    over = "(" + " OR ".join(f"{r} > step * u{i}" for i, r in enumerate(q.RULES)) + ")"
    level = q.DELTA / (len(q.STRATA) + 1)
    return f"""{values()}, h AS (SELECT v.*, left(md5('tune:' || doc_id), 1) < '{q.TUNING}' AS tuning FROM v JOIN good USING (doc_id)), m AS ({melted}),
a AS (SELECT stratum, rule, c, count(*) AS n, count_if(x > c) AS k FROM m, (VALUES {grid}) AS g(c) GROUP BY ALL), u AS (SELECT stratum, rule, coalesce(min(c) FILTER (WHERE {q.RARE} * k <= n), {q.GRID[0]}::DOUBLE) AS unit FROM a GROUP BY ALL),
w AS (SELECT stratum, {', '.join(f'max(unit) FILTER (WHERE rule = {i}) AS u{i}' for i in range(len(q.RULES)))} FROM u GROUP BY 1),
k AS (SELECT stratum, level, step, count(*) AS n, count_if(NOT base_failed AND {over}) AS k FROM h JOIN w USING (stratum), (VALUES {steps}) AS s(level, step) WHERE NOT tuning GROUP BY ALL),
t AS (SELECT *, max(p) OVER (PARTITION BY stratum ORDER BY level ROWS UNBOUNDED PRECEDING) AS worst FROM (SELECT stratum, level, step, {binomial(q.ALPHA)} AS p FROM k)),
c AS (SELECT stratum, min(step) AS step FROM t WHERE worst <= {level!r}::DOUBLE GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({over}, false) AS kept FROM v LEFT JOIN (SELECT * FROM c JOIN w USING (stratum)) AS cw USING (stratum)"""


def mix() -> str:
    before = "OVER (ORDER BY source_size::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cap = mixing.MAX_RATE
    return f"""WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum({cap} * source_size) {before}, 0) AS left_size, sum(w) OVER () - coalesce(sum(w) {before}, 0) AS left_w FROM r),
c AS (SELECT *, ({cap} * source_size)::DOUBLE * left_w <= left_size::DOUBLE * w AS capped FROM o),
t AS (SELECT *, CASE WHEN capped THEN ({cap} * source_size)::DOUBLE ELSE (sum(source_size) OVER () - sum(CASE WHEN capped THEN {cap} * source_size ELSE 0 END) OVER ())::DOUBLE * w / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target FROM c),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0e0 WHEN capped THEN {cap}e0 ELSE target / source_size END AS rate FROM t)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (('0x' || left(md5('mix:{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 13))::BIGINT / 4503599627370496e0 < rate - floor(rate))::INT))::BIGINT AS taken FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source"""


def secret_rescan() -> str:
    """By the newer rules, with the pairs that a first scan of the even documents leaves to do."""
    return f"""WITH now AS ({secret_scan(secrets.NEWER)}), before AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, n_assign, spans, CASE WHEN b.t IS NULL THEN {len(secrets.NEWER)} ELSE 1 END::BIGINT AS pairs FROM now JOIN documents USING (doc_id) LEFT JOIN before AS b ON coalesce(text, '') = b.t"""


def conversation_repair() -> str:
    """The edit lattice row by row: a list of the four states, each the least (cost, audit, repaired text) that reaches it."""
    crc = "xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda a, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda b, i: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384::BIGINT) ELSE b >> 1 END, xor(a, x)), 4294967295::BIGINT), 4294967295::BIGINT) % 20"
    never = "{'c': 1000000000000::BIGINT, 'a': '', 'r': ''}"

    def go(state: str, cost: str, edit: str, line: str | None = None) -> str:
        after = f"{state}.r" if line is None else f"CASE WHEN {state}.r = '' THEN '' ELSE {state}.r || chr(10) END || {line}"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {after}}}"

    def inserted(s: str) -> str:
        user = f"list_min([{s}[3], {', '.join(go(f'{s}[{k}]', '5', 'I', chr(39) + 'user:' + chr(39)) for k in (1, 2, 4))}])"
        return f"list_transform([{user}], lambda u: [{s}[1], {s}[2], u, list_min([{s}[4], {go('u', '5', 'I', chr(39) + 'assistant:' + chr(39))}])])[1]"

    def to(origins: tuple[int, ...], initial: str, role: str) -> str:
        keep = [f"CASE WHEN x.i = '{initial}' THEN {go(f'v[{k}]', 'x.t', 'K', 'x.role || chr(58) || x.text')} ELSE {never} END" for k in origins]
        turn = [go(f"v[{k}]", "1 + x.t", "R", f"'{role}:' || x.text") for k in origins] if role else []
        return ", ".join(keep + turn)

    drop = [go(f"v[{k}]", "2", "D") for k in (1, 2, 3, 4)]
    kept = f"[{drop[0]}, list_min([{drop[1]}, {to((1,), 's', '')}]), list_min([{drop[2]}, {to((1, 2, 4), 'u', 'user')}]), list_min([{drop[3]}, {to((3,), 'a', 'assistant')}])]"
    step = f"list_transform([{inserted('st')}], lambda v: CASE WHEN x.m THEN [{', '.join(drop)}] ELSE {kept} END)[1]"
    return rf"""WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
d AS (SELECT conv_id, turn, role, text, {crc} AS d FROM k),
m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM d, (VALUES (0), (3)) AS t(t) WHERE d <> 0 AND (t = 0 OR d = 3)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text)) AS place FROM m),
f AS (SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS l, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS j FROM p),
g AS (SELECT *, l = '' AS blank, l <> '' AND again AS duplicate, l <> '' AND NOT again AND l NOT IN ('.', '!', '?') AS truncated FROM f),
s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(place > 1 AND j || i NOT IN ('su', 'ua', 'au')) AS illegal,
list({{'i': i, 'm': blank OR duplicate, 't': CASE WHEN truncated THEN 5 ELSE 0 END, 'role': role, 'text': text}} ORDER BY place) AS turns FROM g GROUP BY conv_id),
e AS (SELECT * EXCLUDE (turns), list_reduce(turns, lambda st, x: {step}, [{{'c': 0::BIGINT, 'a': '', 'r': ''}}, {never}, {never}, {never}]) AS st FROM s),
b AS (SELECT * EXCLUDE (st), list_transform([{inserted('st')}], lambda v: list_min([v[1], v[4]]))[1] AS b FROM e)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.b.c, 0)::BIGINT AS cost, coalesce(b.b.a, '') AS audit, sha256(coalesce(b.b.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS i LEFT JOIN b ON i.conv_id IS NOT DISTINCT FROM b.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secret_scan(), "secret_rescan": secret_rescan(), "op4_quality_rules": quality(), "quality_rules_joint": quality(True), "quality_rules_scaled": quality_scaled(), "op7_source_mixing": mix(), "op13_conversation_repair": conversation_repair()}
