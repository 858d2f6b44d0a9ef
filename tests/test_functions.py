"""Hand-worked values of the column functions."""

import pytest
from pyspark.sql import functions as F

from chronoleaf.functions import answers as an
from chronoleaf.functions import intervals as iv
from chronoleaf.functions import text as tx
from chronoleaf.operators import metrics as m

SPANS = "array<struct<t0:double,t1:double>>"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def spans(*pairs):
    return F.array(*[F.struct(F.lit(float(a)).alias("t0"), F.lit(float(b)).alias("t1")) for a, b in pairs]).cast(SPANS)


@pytest.mark.parametrize("a, b, want", [((0, 10), (5, 15), 5 / 15), ((0, 10), (0, 10), 1.0), ((0, 10), (10, 20), 0.0)])
def test_tiou(spark, a, b, want):
    assert value(spark, iv.tiou(*[F.lit(float(x)) for x in (*a, *b)])) == pytest.approx(want)


def test_greedy_matching(spark):
    assert value(spark, iv.mean_best_iou(spans((0, 10), (20, 30)), spans((0, 10), (20, 30)))) == 1.0
    assert value(spark, iv.mean_best_iou(spans(), spans((0, 10)))) == 0.0
    assert value(spark, iv.mean_best_iou(spans((0, 10)), spans())) == 0.0
    # the first true span takes the only prediction, even without overlap
    assert value(spark, iv.mean_best_iou(spans((5, 15)), spans((50, 60), (5, 15)))) == 0.0
    assert value(spark, iv.mean_best_iou(spans((0, 10), (5, 15)), spans((5, 15), (0, 10)))) == 1.0


@pytest.mark.parametrize("minutes, want", [(29.9, "<30min"), (30, "30-60min"), (60, "60-120min"), (120, ">120min")])
def test_length_bucket(spark, minutes, want):
    assert value(spark, iv.length_bucket(F.lit(minutes * 60.0))) == want


@pytest.mark.parametrize("minutes, q, want", [(20, "x", "short"), (80, "general", "hier"), (80, "Stapler use", "retrieve"), (150, "x", "retrieve")])
def test_regime(spark, minutes, q, want):
    assert value(spark, iv.regime(F.lit(minutes * 60.0), F.lit(q))) == want


def test_grids(spark):
    assert value(spark, F.size(iv.probe_times(F.lit(1980.0)))) == 6
    assert value(spark, F.size(iv.probe_times(F.lit(1800.0)))) == 5
    assert value(spark, iv.probe_times(F.lit(200.0))) == []
    assert value(spark, iv.sample_times(F.lit(0.0), F.lit(10.0), 3)) == [0.0, 5.0, 10.0]
    assert value(spark, iv.sample_times(F.lit(4.0), F.lit(4.0), 3)) == [4.0]
    assert [tuple(x) for x in value(spark, iv.micro_batches(F.lit(20), 8))] == [(0, 8), (8, 16), (16, 20)]
    assert value(spark, iv.micro_batches(F.lit(0), 8)) == []
    assert value(spark, iv.vision_tokens(F.lit(64), 256, 2, 2)) == 2048
    assert value(spark, iv.vision_tokens(F.lit(3600), 256, 4, 2)) == 57600


def test_timestamps(spark):
    assert value(spark, an.format_ts(F.lit(412.0))) == "412.0"
    assert value(spark, an.format_ts(F.lit(412.0), "mmss")) == "06:52"
    for text in ("06:52", "412.0s", " 412 "):
        assert value(spark, an.parse_ts(F.lit(text))) == 412
    assert value(spark, an.parse_ts(F.lit("1:06:52"))) == 4012
    assert value(spark, an.parse_ts(F.lit("soon"))) is None


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("<think>x</think><answer>[5.0, 10.0]</answer>", "span", [(5, 10)]),
        ("<answer>[10, 5]</answer>", "span", [(5, 10)]),
        ("<ANSWER>[[1, 2], [3, 4]]</ANSWER>", "multi", [(1, 2), (3, 4)]),
        ("<answer>abstain</answer>", "abstain", []),
        ("nothing", "bad", []),
        ("<answer>[a, b]</answer>", "bad", []),
        ("[7.0, 9.0]", "span", [(7, 9)]),
        (None, "bad", []),
    ],
)
def test_parse_answer(spark, text, kind, want):
    got = value(spark, an.parse_answer(F.lit(text).cast("string")))
    assert (got.kind, [tuple(s) for s in got.spans]) == (kind, want)


def test_round_trips(spark):
    text = value(spark, an.answer_spans(spans((1, 2), (3, 4)), confidence=F.lit(80)))
    assert text == "<answer>[[1.0, 2.0], [3.0, 4.0]]</answer> confidence: 80%"
    assert value(spark, an.parse_confidence(F.lit(text))) == 0.8
    segs = F.array(F.struct(F.lit("P1").alias("label"), F.lit(0.0).alias("t0"), F.lit(9.0).alias("t1")))
    assert [tuple(x) for x in value(spark, an.parse_segments(an.answer_segments(segs)))] == [("P1", 0.0, 9.0)]
    assert value(spark, an.parse_minutes(an.answer_minutes(F.lit(42.0)))) == 42.0
    assert value(spark, an.parse_minutes(F.lit("17 minutes"))) == 17.0
    assert value(spark, an.parse_minutes(F.lit("none"))) is None
    assert value(spark, an.parse_labels(F.lit("<answer>none</answer>"))) == []
    assert value(spark, an.parse_labels(F.lit("clip; cut,"))) == ["clip", "cut"]
    assert value(spark, an.parse_confidence(F.lit("no"))) is None


def test_text(spark):
    assert value(spark, tx.normalize(F.lit("The Gallbladder."))) == "gallbladder"
    assert value(spark, tx.token_f1(F.lit("the clipper and grasper"), F.lit("grasper"))) == pytest.approx(0.5)
    assert value(spark, tx.token_f1(F.lit(""), F.lit(""))) == 1
    assert value(spark, tx.token_f1(F.lit("x"), F.lit(""))) == 0
    assert [value(spark, tx.verdict_score(F.lit(v))) for v in ("Correct.", "partial credit", "This is WRONG", "incorrect")] == [1, 0.5, 0, 0]
    assert value(spark, tx.verdict_score(F.lit("unfaithful"), tx.SUMMARY_VERDICTS, "unfaithful")) == 0


def test_whole_numbers_round_halves_to_even(spark):
    assert [value(spark, an.whole(F.lit(x))) for x in (0.5, 1.5, 2.5, 12.4, 12.6, 86400.5, 0.0)] == ["0", "2", "2", "12", "13", "86400", "0"]
    assert value(spark, an.frame_header(F.array(F.lit(1.0)), F.lit(2.5))) == "Frames sampled at t = [1.0] s of a 2 s procedure."


def test_shares_of_verdicts(spark):
    x = spark.createDataFrame([("a", "faithful"), ("a", "minor point"), ("a", None), ("a", "Unfaithful!"), ("b", "faithful")], "k string, verdict string")
    got = {(r.k, r.verdict): (r.n, r.share, r.judge) for r in m.verdict_shares(x, ["k"], tx.SUMMARY_VERDICTS, "unfaithful").collect()}
    assert got == {("a", "faithful"): (1, 0.25, 0.375), ("a", "minor"): (1, 0.25, 0.375), ("a", "unfaithful"): (2, 0.5, 0.375), ("b", "faithful"): (1, 1.0, 1.0)}


def test_media_and_chat(spark):
    assert value(spark, an.expand_media(F.lit("a <video> b <video>"), 3)) == "a <image><image><image> b <video>"
    msgs = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("system", "s"), ("user", "q?"), ("assistant", "yes"))])
    chat, at = value(spark, an.plain_chat(msgs)), value(spark, an.assistant_span(msgs))
    assert chat[at.start : at.stop] == "yes"
    assert value(spark, an.user_question(an.with_user_question(msgs, F.lit("new")))) == "new"
    assert tuple(value(spark, an.assistant_span(F.slice(msgs, 1, 2)))) == (0, 0)


def reward(spark, text, gts, abstain=False, duration=3600.0, control=False):
    return value(spark, m.reward(an.parse_answer(F.lit(text)), gts, F.lit(abstain), F.lit(duration), control=control))


def test_reward(spark):
    gt = spans((100, 200))
    assert reward(spark, "<answer>[100, 200]</answer>", gt).reward > 1.9
    assert -0.5 <= reward(spark, "<answer>[2000, 2100]</answer>", gt).r_tiou < 0
    assert reward(spark, "<answer>ABSTAIN</answer>", spans(), True).r_abstain == 1
    assert reward(spark, "<answer>[1, 2]</answer>", spans(), True).r_tiou == -1
    assert reward(spark, "<answer>ABSTAIN</answer>", gt).r_tiou == pytest.approx(-0.2)
    r = reward(spark, "<answer>ABSTAIN</answer>", spans(), True, control=True)
    assert (r.r_tiou, r.r_abstain) == (0, 0)
    assert reward(spark, "dunno", gt).r_format == 0


def test_nearest_searches_all_rows(spark):
    import numpy as np

    from chronoleaf.operators import selection as sel

    v = np.random.default_rng(4).normal(size=(90, 8)).round(3)
    v[7], v[80], v[11] = v[3], v[3], 0
    e = spark.createDataFrame([(i, v[i].tolist(), i % 5 if i % 4 else None) for i in range(90)] + [(90, None, 1)], "vec_id long, embedding array<float>, label int")
    got = {(r.query, r["rank"]): r["item"] for r in sel.nearest(e.filter("vec_id % 3 = 0"), e, "vec_id", "vec_id", "embedding", 5, (7, 16)).collect()}
    w = v.astype(np.float32).astype(float)
    cos = lambda a, b: round(float(w[a] @ w[b] / np.sqrt((w[a] @ w[a]) * (w[b] @ w[b]))), 9)
    want = {(q, k + 1): i for q in range(0, 90, 3) for k, i in enumerate(sorted((i for i in range(90) if i not in (q, 11)), key=lambda i: (-cos(q, i), i))[:5])}
    assert got == want
