"""The answer grammar: timestamps, prompts and answers as text, and their lenient parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoleaf.functions.intervals import tenths

# The grammar's patterns.
ANSWER = r"(?is)<answer>\s*(.*?)\s*</answer>"
PAIR = r"\[\s*([^\[\],]+?)\s*,\s*([^\[\],]+?)\s*\]"
SEGMENT = r"\[\s*\"?([A-Za-z0-9_+\- ]+?)\"?\s*,\s*([\d.:]+)\s*,\s*([\d.:]+)\s*\]"
CONFIDENCE = r"(?i)confidence\s*[:=]?\s*(\d+(?:\.\d+)?)\s*%?"
NUMBER = r"-?\d+(?:\.\d+)?"
SPANS = "array<struct<t0:double,t1:double>>"
# Media placeholder of each backend.
MEDIA = {"internvl3_2b": "<image>", "internvl3_8b": "<image>", "llava_video_7b": "<image>", "qwen25vl_7b": "<|vision_start|><|image_pad|><|vision_end|>"}


# The sentences of prompts and judge prompts below are part of the format that models are trained on.


def format_ts(seconds: Column, fmt: str = "seconds") -> Column:
    s = F.greatest(F.lit(0.0), seconds.cast("double"))
    if fmt == "mmss":
        whole = F.bround(s, 0).cast("long")
        return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)
    n = tenths(s)
    return F.when(s < 1e15, F.concat(F.floor(n / 10).cast("string"), F.lit("."), F.pmod(n, F.lit(10)).cast("string"))).otherwise(F.format_string("%.1f", s))


def whole(x: Column) -> Column:
    """A number as text without decimals, halves to the even neighbour."""
    return F.bround(x.cast("double"), 0).cast("long").cast("string")


def parse_ts(text: Column) -> Column:
    """Seconds of "12.5", "12.5s", "06:52" or "1:06:52"; null if it is none of them."""
    bare = F.trim(F.regexp_replace(F.trim(text), "s+$", ""))
    parts = F.transform(F.split(bare, ":"), lambda x: F.trim(x).try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)


def frame_header(times: Column, duration_s: Column) -> Column:
    shown = F.array_join(F.transform(times, lambda t: format_ts(t)), ", ")
    return F.concat(F.lit("Frames sampled at t = ["), shown, F.lit("] s of a "), whole(duration_s), F.lit(" s procedure."))


def user_prompt(times: Column, duration_s: Column, request: Column) -> Column:
    return F.concat(frame_header(times, duration_s), F.lit("\n<video>\n"), request)


def user_grounding(times: Column, duration_s: Column, query: Column) -> Column:
    return user_prompt(times, duration_s, query)


user_qa = user_grounding


def user_segmentation(times: Column, duration_s: Column, unit: str = "phases") -> Column:
    return user_prompt(times, duration_s, F.lit(f"Segment this operation into {unit}."))


def user_rsd(times: Column, elapsed_s: Column) -> Column:
    shown = F.array_join(F.transform(times, lambda t: format_ts(t)), ", ")
    return F.concat(F.lit("Frames sampled at t = ["), shown, F.lit("] s; "), format_ts(elapsed_s), F.lit(" s elapsed so far.\n<video>\nHow many minutes of surgery remain?"))


def user_detection(times: Column, duration_s: Column, t0: Column, t1: Column, kind: str = "steps") -> Column:
    return user_prompt(times, duration_s, F.concat(F.lit(f"List the active {kind} in "), format_ts(t0), F.lit("-"), format_ts(t1), F.lit(" s.")))


def user_summary(times: Column, duration_s: Column, t0: Column, t1: Column) -> Column:
    return user_prompt(times, duration_s, F.concat(F.lit("Summarize "), format_ts(t0), F.lit("-"), format_ts(t1), F.lit(" s of this operation.")))


def _body(inner: Column, think: Column | None) -> Column:
    answer = F.concat(F.lit("<answer>"), inner, F.lit("</answer>"))
    return answer if think is None else F.concat(F.lit("<think>"), think, F.lit("</think>"), answer)


def answer_spans(spans: Column, abstain: Column | bool = False, think: Column | None = None, confidence: Column | None = None) -> Column:
    """One span as [a, b], several as [[a, b], [c, d]], or ABSTAIN; a confidence in per cent may follow."""
    one = lambda s: F.concat(F.lit("["), format_ts(s["t0"]), F.lit(", "), format_ts(s["t1"]), F.lit("]"))
    joined = F.array_join(F.transform(spans, one), ", ")
    inner = F.when(F.size(spans) == 1, joined).otherwise(F.concat(F.lit("["), joined, F.lit("]")))
    stop = abstain if isinstance(abstain, Column) else F.lit(abstain)
    out = _body(F.when(stop, "ABSTAIN").otherwise(inner), think)
    return out if confidence is None else F.concat(out, F.coalesce(F.format_string(" confidence: %d%%", confidence.cast("int")), F.lit("")))


def answer_segments(segments: Column, think: Column | None = None) -> Column:
    one = lambda s: F.concat(F.lit('["'), s["label"], F.lit('", '), format_ts(s["t0"]), F.lit(", "), format_ts(s["t1"]), F.lit("]"))
    return _body(F.concat(F.lit("["), F.array_join(F.transform(segments, one), ", "), F.lit("]")), think)


def answer_minutes(minutes: Column, think: Column | None = None) -> Column:
    return _body(F.format_string("%.1f", F.round(minutes, 1)), think)


def answer_labels(labels: Column, think: Column | None = None) -> Column:
    return _body(F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise("none"), think)


def answer_text(text: Column, think: Column | None = None) -> Column:
    return _body(F.trim(text), think)


def payload(text: Column) -> Column:
    """What the first answer block holds, or the whole text, trimmed."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.rlike(t, F.lit(ANSWER)), F.regexp_extract(t, ANSWER, 1)).otherwise(F.regexp_replace(t, r"^\s+|\s+$", ""))


def parse_answer(text: Column) -> Column:
    """(kind: span, multi, abstain or bad; spans; raw). A number that cannot be read makes the answer bad."""
    inner = payload(text)
    pairs = F.arrays_zip(F.regexp_extract_all(inner, F.lit(PAIR), F.lit(1)).alias("a"), F.regexp_extract_all(inner, F.lit(PAIR), F.lit(2)).alias("b"))
    read = F.transform(pairs, lambda p: F.struct(parse_ts(p["a"]).alias("x"), parse_ts(p["b"]).alias("y")))
    spans = F.transform(read, lambda p: F.struct(F.least(p["x"], p["y"]).alias("t0"), F.greatest(p["x"], p["y"]).alias("t1")))
    broken = F.exists(read, lambda p: p["x"].isNull() | p["y"].isNull())
    abstain = F.rlike(inner, F.lit(r"(?i)\bABSTAIN\b"))
    none = F.array().cast(SPANS)
    kind = F.when(abstain, "abstain").when((F.size(read) == 0) | broken, "bad").when(F.size(read) == 1, "span").otherwise("multi")
    return F.struct(kind.alias("kind"), F.when(abstain | broken, none).otherwise(spans.cast(SPANS)).alias("spans"), inner.alias("raw"))


def parse_span(text: Column) -> Column:
    """The first span, or null."""
    return F.get(parse_answer(text)["spans"], F.lit(0))


def parse_segments(text: Column) -> Column:
    """(label, t0, t1) of each segment whose numbers can be read; reversed ones are turned."""
    inner = payload(text)
    part = lambda g: F.regexp_extract_all(inner, F.lit(SEGMENT), F.lit(g))
    rows = F.arrays_zip(part(1).alias("l"), part(2).alias("a"), part(3).alias("b"))
    read = F.transform(rows, lambda r: F.struct(F.trim(r["l"]).alias("l"), parse_ts(r["a"]).alias("x"), parse_ts(r["b"]).alias("y")))
    good = F.filter(read, lambda r: r["x"].isNotNull() & r["y"].isNotNull())
    return F.transform(good, lambda r: F.struct(r["l"].alias("label"), F.least(r["x"], r["y"]).alias("t0"), F.greatest(r["x"], r["y"]).alias("t1")))


def parse_minutes(text: Column) -> Column:
    bare = F.regexp_replace(payload(text), r"(?i)\b(minutes?|mins?)\b", "")
    return F.regexp_extract(bare, NUMBER, 0).try_cast("double")


def parse_labels(text: Column) -> Column:
    """Labels between commas or semicolons; none for an answer that says so."""
    inner = payload(text)
    none = (inner == "") | F.rlike(inner, F.lit(r"(?i)^(none|n/?a|-)$"))
    parts = F.filter(F.transform(F.split(inner, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(none, F.array().cast("array<string>")).otherwise(parts)


def parse_confidence(text: Column) -> Column:
    """0 to 1; values over 1 are per cent."""
    v = F.regexp_extract(F.coalesce(text, F.lit("")), CONFIDENCE, 1).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / 100.0).otherwise(v))) * F.when(v.isNotNull(), 1.0)


def expand_media(text: Column, n: Column | int, token: str = MEDIA["internvl3_2b"]) -> Column:
    """Replaces the first <video>, else the first <image>, by n media tokens."""
    n = n if isinstance(n, Column) else F.lit(n)
    out = text
    tokens = F.repeat(F.lit(token), n)

    def put(mark: str) -> Column:
        at = F.instr(text, mark)
        return F.concat(F.substring(text, F.lit(1), at - 1), tokens, F.substring(text, at + len(mark), F.length(text)))

    return F.when(F.instr(text, "<video>") > 0, put("<video>")).when(F.instr(text, "<image>") > 0, put("<image>")).otherwise(out)


def plain_chat(messages: Column, generation: bool = False) -> Column:
    """Messages (role, content) as role-tagged text; generation opens the assistant's next turn."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"]))
    return F.array_join(F.array_append(parts, F.lit("<|assistant|>\n")) if generation else parts, "\n")


def assistant_span(messages: Column) -> Column:
    """Character offsets (start, stop) of the first assistant content in ``plain_chat``; (0, 0) if there is none."""
    said = F.get(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(0))["content"]
    start = F.call_function("locate", said, plain_chat(messages))
    found = said.isNotNull() & (start > 0)
    return F.struct(F.when(found, start - 1).otherwise(0).alias("start"), F.when(found, start - 1 + F.length(said)).otherwise(0).alias("stop"))


def user_question(messages: Column) -> Column:
    return F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]


def with_user_question(messages: Column, question: Column) -> Column:
    """Replaces the content of the first user message."""
    first = F.array_position(F.transform(messages, lambda m: m["role"]), F.lit("user")) - 1
    return F.transform(messages, lambda m, i: F.when(i == first, F.struct(m["role"].alias("role"), question.alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def cache_key(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by the unit separator."""
    return F.substring(F.sha1(F.concat_ws(chr(31), *parts).cast("binary")), 1, 16)


def judge_prompt(rubric: str, question: Column, gold: Column, pred: Column) -> Column:
    return F.concat(F.lit(f"{rubric}\n\nQUESTION: "), question, F.lit("\nREFERENCE: "), gold, F.lit("\nANSWER: "), F.trim(pred), F.lit("\n\nVERDICT:"))


def summary_prompt(rubric: str, timeline: Column, pred: Column) -> Column:
    one = lambda s: F.concat(s["label"], F.lit(" ["), whole(s["t0"]), F.lit("-"), whole(s["t1"]), F.lit("s]"))
    return F.concat(F.lit(f"{rubric}\n\nTIMELINE: "), F.array_join(F.transform(timeline, one), "; "), F.lit("\nSUMMARY: "), F.trim(pred), F.lit("\n\nVERDICT:"))
