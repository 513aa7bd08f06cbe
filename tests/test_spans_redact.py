"""Span algebra and redaction against plain Python, on random spans too."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.operators import edits, redact, spans
from lacuna.operators.detect import MATCH, resolve_overlaps
from lacuna.operators.edits import edited


def match(text, s, e, kind="CUSTOM", idx=0, seq=0):
    return (kind, text[s:e], s, e, 1.0, "", idx, seq)


def frame(spark, rows):
    return spark.createDataFrame(rows, f"doc_id int, text string, matches {MATCH}")


def merged(ms):
    out = []
    for m in sorted(ms, key=lambda m: (m[2], m[6], m[7])):
        if out and m[2] < out[-1][3]:
            if m[3] - m[2] > out[-1][3] - out[-1][2]:
                out[-1] = m
        else:
            out.append(m)
    return out


def walked(text, ms):
    out, mapping, p, at = "", [], 0, 0
    for i, m in enumerate(sorted(ms, key=lambda m: m[2])):
        if m[2] < p or m[3] < m[2]:
            continue
        token = "_" * min(len(m[1]), 8) + "​" * (i + 1)
        out += text[p : m[2]] + token
        mapping.append((i, m[1], token, len(out) - len(token), len(out)))
        p = m[3]
    return out + text[p:], mapping


def test_random_spans_merge_redact_and_restore(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abc é中😀\n") for _ in range(rng.randint(0, 40)))
        ms = [match(text, s, min(len(text), s + rng.randint(1, 9)), idx=rng.randint(0, 3), seq=k) for k, s in enumerate(rng.randint(0, len(text) - 1) for _ in range(rng.randint(0, 8)) if text)]
        rows.append((i, text, ms))
    df = frame(spark, rows)
    got = {r["doc_id"]: r for r in redact.restore(redact.redact(df.withColumn("merged", resolve_overlaps(F.col("matches"))))).collect()}
    for i, text, ms in rows:
        r = got[i]
        assert [tuple(m) for m in r["merged"]] == merged(ms)
        expected, mapping = walked(text, ms)
        assert r["redacted_text"] == expected and r["restored_text"] == text
        assert [(m["idx"], m["originalValue"], m["maskedToken"], m["start"], m["end"]) for m in r["mapping"]] == mapping
    assert redact.verify_round_trip(redact.redact(df)).count() == 0


def test_restore_skips_bad_places(spark):
    kind = "array<struct<originalValue:string,start:double,end:double>>"
    df = spark.createDataFrame([("abcdef", [("X", -1.0, 2.0), ("Y", 3.0, 99.0), ("Z", 4.0, 2.0), ("W", float("nan"), 2.0), ("OK", 1.0, 2.0)])], f"redacted_text string, mapping {kind}")
    assert redact.restore(df).first()["restored_text"] == "aOKcdef"


def test_masks_and_tokens(spark):
    cases = [("PHONE", "13800001234", "138****1234"), ("EMAIL", "buyer@x.com", "bu***@x.com"), ("ID_CARD", "110101199003078888", "110101********8888"), ("BANK_CARD", "6222600266661234", "6222 **** **** 1234"),
             ("IP", "10.1.2.3", "10.1.2.*.*"), ("AMOUNT", "¥5", "¥****"), ("NAME", "张三", "[姓名]"), ("URL", "x.cn", "[网址]"), ("OTHER", "x", "[敏感信息]")]
    df = spark.createDataFrame(cases, "type string, value string, mask string")
    assert df.where(redact.partial_mask(F.col("type"), F.col("value")) != F.col("mask")).count() == 0
    row = spark.range(1).select(redact.type_token(F.lit("PHONE"), F.lit(7)).alias("a"), redact.type_token(F.lit("PHONE"), F.lit(12345)).alias("b"), redact.display_token(F.lit("中文中文中文中文中文"), F.lit(1)).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == ("[PHONE_0007]", "[PHONE_12345]", "________​​")


def test_override_protect_and_manual(spark):
    text = "banana banana"
    df = frame(spark, [(1, text, [match(text, 0, 6), match(text, 7, 13)])]).withColumn("phrase", F.lit("ana"))
    row = spans.manual_matches(df, "phrase").first()
    assert [m["start"] for m in row["manual"]] == [1, 3, 8, 10] and row["found"]
    given_places = spans.manual_matches(df.withColumn("at", F.array(F.lit(-1), F.lit(3), F.lit(12))), "phrase", "at").first()
    assert [m["start"] for m in given_places["manual"]] == [3]
    new = frame(spark, [(1, text, [match(text, 6, 9)])]).select("doc_id", F.col("matches").alias("new"))
    both = df.join(new, "doc_id").select(spans.override_matches(F.col("matches"), F.col("new")).alias("o"), spans.filter_hits(F.col("new"), F.slice("matches", 1, 1)).alias("f")).first()
    assert [m["start"] for m in both["o"]] == [0, 6] and [m["start"] for m in both["f"]] == [6]


def test_intervals_parts_and_segments(spark):
    rows = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (1, 8, 8), (2, 1, 2)], "doc_id int, start int, end int")
    assert sorted(map(tuple, spans.merge_intervals(rows).collect())) == [(1, 0, 5), (1, 7, 9), (2, 1, 2)]
    text = "hello world"
    df = frame(spark, [(1, text, [match(text, 0, 5), match(text, 3, 8), match(text, 6, 11)])])
    parts = df.select(spans.highlight_parts(F.col("text"), F.col("matches")).alias("p")).first()["p"]
    assert "".join(p["text"] for p in parts) == text and [p["kind"] for p in parts] == ["match", "text", "match"]
    masked = df.select(spans.highlight_parts(F.col("text"), F.col("matches"), original=False).alias("p")).first()["p"]
    assert masked[0]["text"] == " " * 5
    cut = df.select(spans.segment_text(F.col("text"), F.col("matches"), F.array(*map(F.lit, (6.0, 99.0, -1.0, 6.5)))).alias("s")).first()["s"]
    assert [(s["text"], [(m["start"], m["end"]) for m in s["matches"]]) for s in cut] == [("hello ", [(0, 5), (3, 6)]), ("world", [(0, 5)])]


def test_runs(spark):
    runs = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cd"), (1, 2, "abab")], "doc_id int, idx int, text string")
    assert sorted((r["start"], r["run_idx"]) for r in spans.locate_token(runs, "ab").collect()) == [(0, 0), (4, 2), (6, 2)]
    assert [(r["start"], r["run_idx"]) for r in spans.locate_token(runs, "bc").collect()] == [(1, None)]
    placed = spans.runs_with_offsets(runs)
    todo = spark.createDataFrame([(1, 1, 3, "XY"), (1, 4, 8, "Q")], "doc_id int, start int, end int, value string")
    assert sorted((r["idx"], r["text"]) for r in edits.spread_over_runs(placed, todo).collect()) == [(0, "aX"), (1, "Yd"), (2, "Q")]


def test_edits_pair_by_occurrence():
    assert edited("a __ b __ c", [("__", "1"), ("__", "2")]) == "a1b2c"
    assert edited("__ __", [("__", "x")]) == "x"
    assert edited("____ __", [("__", "s"), ("____", "long")]) == "longs"
    assert edited("a\n__\nb", [("__", "x"), ("", "y")]) == "a\nx\nb"


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab_ \n", max_size=30))
def test_edits_without_tokens_change_nothing(text):
    assert edited(text, [("#", "x")]) == text


def test_interval_joins_against_all_pairs(spark):
    rng = random.Random(8)
    span = lambda: (rng.randint(0, 3), s := rng.randint(0, 20_000), s + rng.choice([0, 1, 3, 5000]))
    hits, held = [span() for _ in range(300)] + [(None, 1, 2)], [span() for _ in range(12)]
    frame_of = lambda rows: spark.createDataFrame(rows, "doc_id int, start int, end int")
    expected = [h for h in hits if not any(h[0] == e[0] and h[1] < e[2] and h[2] > e[1] for e in held)]
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    assert key(spans.protect_rows(frame_of(hits), frame_of(held)).collect()) == key(expected)
    assert key(spans.override_rows(frame_of(hits), frame_of(held)).collect()) == key(expected + held)
