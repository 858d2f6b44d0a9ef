"""The engine's functions in SQL: ``register`` makes them temporary functions of a session, so that queries need no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from chronoleaf.functions.answers import ANSWER, PAIR
from chronoleaf.functions.intervals import LENGTH_EDGES, TOOL_WORDS


def quoted(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def bucket_cases() -> str:
    names = [f"<{LENGTH_EDGES[0]}min", *(f"{a}-{b}min" for a, b in zip(LENGTH_EDGES, LENGTH_EDGES[1:]))]
    return " ".join(f"WHEN duration_s / 60 < {e} THEN '{n}'" for e, n in zip(LENGTH_EDGES, names, strict=True)) + f" ELSE '>{LENGTH_EDGES[-1]}min'"


def seconds(said: str) -> str:
    """As text, for SQL functions can't be called inside lambdas."""
    return f"aggregate(transform(split(trim(regexp_replace(trim({said}), 's+$', '')), ':'), x -> try_cast(trim(x) AS DOUBLE)), 0D, (v, part) -> v * 60 + part)"


SPAN = "STRUCT<t0: DOUBLE, t1: DOUBLE>"
#: name and parameters -> what it returns and how.
FUNCTIONS = {
    "overlap_s(a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE)": ("DOUBLE", "least(a1, b1) - greatest(a0, b0)"),
    "tiou(a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE)": ("DOUBLE", "coalesce(try_divide(greatest(0D, overlap_s(a0, a1, b0, b1)), nullif(greatest(0D, (a1 - a0) + (b1 - b0) - greatest(0D, overlap_s(a0, a1, b0, b1))), 0D)), 0D)"),
    "hull_iou(a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE)": ("DOUBLE", "coalesce(try_divide(greatest(0D, overlap_s(a0, a1, b0, b1)), nullif(greatest(0D, greatest(a1, b1) - least(a0, b0)), 0D)), 0D)"),
    "length_bucket(duration_s DOUBLE)": ("STRING", f"CASE {bucket_cases()} END"),
    "regime(duration_s DOUBLE, query STRING)": ("STRING", f"CASE WHEN duration_s < 2700 THEN 'short' WHEN duration_s >= 7200 OR exists(array({', '.join(repr(w) for w in TOOL_WORDS)}), w -> contains(lower(coalesce(query, '')), w)) THEN 'retrieve' ELSE 'hier' END"),
    "parse_seconds(said STRING)": ("DOUBLE", seconds("said")),
    "answer_payload(said STRING)": ("STRING", f"CASE WHEN coalesce(said, '') RLIKE {quoted(ANSWER)} THEN regexp_extract(said, {quoted(ANSWER)}, 1) ELSE regexp_replace(coalesce(said, ''), r'^\\s+|\\s+$', '') END"),
    "answer_numbers(inner STRING)": ("ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>", f"zip_with(regexp_extract_all(inner, {quoted(PAIR)}, 1), regexp_extract_all(inner, {quoted(PAIR)}, 2), (a, b) -> named_struct('x', {seconds('a')}, 'y', {seconds('b')}))"),
    "answer_kind(inner STRING)": ("STRING", "CASE WHEN inner RLIKE r'(?i)\\bABSTAIN\\b' THEN 'abstain' WHEN size(answer_numbers(inner)) = 0 OR exists(answer_numbers(inner), p -> p.x IS NULL OR p.y IS NULL) THEN 'bad' WHEN size(answer_numbers(inner)) = 1 THEN 'span' ELSE 'multi' END"),
    "parse_answer(said STRING)": (f"STRUCT<kind: STRING, spans: ARRAY<{SPAN}>, raw: STRING>", "named_struct('kind', answer_kind(answer_payload(said)), 'spans', CASE WHEN answer_kind(answer_payload(said)) IN ('span', 'multi') THEN transform(answer_numbers(answer_payload(said)), p -> named_struct('t0', least(p.x, p.y), 't1', greatest(p.x, p.y))) ELSE array() END, 'raw', answer_payload(said))"),
}


def register(spark: SparkSession) -> None:
    """Makes FUNCTIONS temporary functions of the session; again, they replace themselves."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
