"""Texts with very many spans: the same results as few, in time with the text; and rows that lack parts."""

import itertools
import random
import time

from pyspark.sql import functions as F

from lacuna.functions.rules import BUILTIN, custom_rule
from lacuna.functions.spans import group_spans, overlapping_starts, spans_of
from lacuna.operators import redact, spans
from lacuna.operators.detect import MATCH, detect, exploded
from lacuna.operators.search import search_and_add

EMAIL = next(r for r in BUILTIN if r.type == "EMAIL")
PHONE = next(r for r in BUILTIN if r.type == "PHONE")


def test_very_many_spans_in_time(spark):
    n = 100_000
    text = " ".join(f"u{i}@x.co 138{i:08d}" for i in range(n // 2))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.time()
    found = detect(df, rules=[EMAIL, PHONE])
    found.write.format("noop").mode("overwrite").save()
    took = time.time() - began
    df = redact.restore(redact.redact_typed(found)).select(F.size("matches").alias("n"), (F.col("restored_text") == F.col("text")).alias("same"), F.element_at("matches", -1).alias("last"))
    began = time.time()
    row = df.first()
    both = time.time() - began
    assert (row["n"], row["same"]) == (n, True)
    assert text[row["last"]["start"] :] == row["last"]["value"] and row["last"]["context"] == f"...{text[-11 - 30:-11]}{text[-11:]}..."
    assert took < 30 and both < 60  # a few seconds each; quadratic work would take many minutes


def test_spans_that_fill_several_chunks(spark):
    text = "é😀ab1 " * 700
    one = spark.createDataFrame([(text,), (text.replace("é", "\ufdd0"),), (None,), ("",)], "t string")
    rows = one.select(spans_of(F.col("t"), "b([0-9])").alias("a"), group_spans(F.col("t"), "b([0-9])").alias("g"), overlapping_starts(F.col("t"), F.lit("b1")).alias("o")).collect()
    places = [6 * i + 3 for i in range(700)]
    for r in rows[:2]:
        assert [tuple(x) for x in r["a"]] == [(p, p + 2, "b1") for p in places]
        assert [tuple(x) for x in r["g"]] == [(p + 1, p + 2, "1") for p in places]
        assert r["o"] == places
    assert all(r["a"] == r["g"] == r["o"] == [] for r in rows[2:] if r["o"] is not None)


def test_rows_without_matches_or_mappings_are_kept(spark):
    kind = f"doc_id int, text string, matches {MATCH}"
    match = ("CUSTOM", "b", 1, 2, 1.0, "", 0, 0)
    rows = spark.createDataFrame([(1, "abc", None), (2, "abc", [None, match]), (3, None, [])], kind)
    got = {r["doc_id"]: r for r in redact.restore(redact.redact(rows)).collect()}
    assert got[1]["redacted_text"] == got[1]["restored_text"] == "abc" and got[1]["mapping"] == []
    assert got[2]["restored_text"] == "abc" and got[2]["redacted_text"] != "abc" and got[3]["redacted_text"] == ""
    held = spark.createDataFrame([("abc", None), ("abc", [("x", None, 1), (None, 0, 1), ("B", 1, 2)])], "redacted_text string, mapping array<struct<originalValue:string,start:int,end:int>>")
    assert [r["restored_text"] for r in redact.restore(held).collect()] == ["abc", "aBc"]


def test_restore_of_apart_and_of_clashing_entries(spark):
    kind = "redacted_text string, mapping array<struct<originalValue:string,start:double,end:double>>"

    def slow(text, entries):
        for v, s, e in sorted(entries, key=lambda x: (-x[1], x[1], x[2], x[0])):
            if 0 <= s <= e <= len(text):
                text = text[: int(s)] + v + text[int(e) :]
        return text

    cases = [("abcdef", [("X", 0.0, 1.0), ("YY", 1.0, 3.0), ("", 6.0, 6.0)]), ("abcdef", [("X", 0.0, 4.0), ("Y", 2.0, 3.0)]), ("abcdef", [("X", 2.0, 2.0), ("Y", 2.0, 2.0)]), ("abcdef", [("X", 6.0, 6.4), ("Y", 1.5, 2.7)]), ("", [("X", 0.0, 0.0)])]
    rows = redact.restore(spark.createDataFrame(cases, kind)).collect()
    assert [r["restored_text"] for r in rows] == [slow(t, m) for t, m in cases]


def test_many_keywords_find_what_few_do(spark):
    words = ["ab", "b\\Ec", "aa"] + [f"none{i}" for i in range(60)]
    df = spark.createDataFrame([(1, "aaa ab b\\Ec aaaa 😀ab"), (2, None)], "doc_id int, text string")
    few, many = (exploded(detect(df, rules=[], keywords=k)).collect() for k in (words[:3], words))
    assert sorted(map(tuple, few)) == sorted(map(tuple, many)) and len(many) == 6


def test_input_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "a@b.co", "keep", "too", "it")], "doc_id int, text string, __text string, __walk string, __r0 string")
    row = redact.redact(detect(df, rules=[EMAIL, custom_rule("zz+")])).first()
    assert (row["__text"], row["__walk"], row["__r0"]) == ("keep", "too", "it") and row["redacted_text"].startswith("______")


def test_sweeps_over_two_arrays_by_brute_force(spark):
    rng = random.Random(5)
    made = lambda k: [(f"t{j}", "v", a, a + rng.randrange(5)) for j, a in enumerate(rng.randrange(40) for _ in range(rng.randrange(k)))]
    rows = [(i, "x" * rng.randrange(45), made(8), made(6), [float(rng.randrange(-2, 50)) if rng.random() < 0.9 else None for _ in range(rng.randrange(5))]) for i in range(200)]
    rows += [(900, "abc", [], None, []), (901, "", [("t", "v", 0, 0)], [], [float("nan"), 1.0])]
    kind = "array<struct<type:string,value:string,start:int,end:int>>"
    df = spark.createDataFrame(rows, f"id int, text string, a {kind}, b {kind}, cuts array<double>")
    got = df.select("id", spans.filter_hits(F.col("a"), F.col("b")).alias("f"), spans.override_matches(F.col("a"), F.coalesce("b", F.array().cast(kind))).alias("o"), spans.segment_text(F.col("text"), F.col("a"), F.col("cuts")).alias("s"))
    by_id = {r["id"]: r for r in got.collect()}
    for i, text, a, b, cuts in rows:
        apart = [x for x in a if not any(x[2] < y[3] and x[3] > y[2] for y in b or [])]
        assert [tuple(x) for x in by_id[i]["f"]] == apart
        assert [tuple(x) for x in by_id[i]["o"]] == sorted(apart + (b or []), key=lambda x: x[2])
        bounds = [0, *sorted({int(c) for c in cuts if c is not None and 0 < c < len(text)} - {0}), len(text)]
        want = [(x, y, text[x:y], [(m[0], m[1], m[2] - x, min(m[3], y) - x) for m in a if x <= m[2] < y]) for x, y in itertools.pairwise(bounds)]
        assert [(x["start"], x["end"], x["text"], [tuple(m) for m in x["matches"]]) for x in by_id[i]["s"]] == want


def test_sweeps_straight_after_detection_in_time(spark):
    """What makes the arrays is not run again for each of their elements."""
    found = detect(spark.createDataFrame([(1, " ".join(f"u{i}@x.co" for i in range(20_000)))], "doc_id int, text string"), rules=[EMAIL])
    m, third = F.col("matches"), F.filter("matches", lambda x: x["start"] % 3 == 0)
    cuts = F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: i * 90)
    for df in (found.select(spans.filter_hits(m, third)), found.select(spans.override_matches(m, third)), found.select(spans.segment_text(F.col("text"), m, cuts)), search_and_add(found, "x.c")):
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        assert time.time() - began < 15  # one to three seconds each; a product of the arrays would take hours
