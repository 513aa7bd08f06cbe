"""Large dictionaries in layers, terms left on lines, and long lists of edits: what the plain ways give, in time with the text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lacuna.operators import dictionary, edits, gate, keywords


def word(rng, low, high, letters):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))


def one_by_one(text, pairs):
    for a, b in sorted(pairs, key=lambda p: -len(p[0])):
        text = text.replace(a, b)
    return text


@pytest.mark.parametrize("block", [4_000_000, 3])
def test_layers_give_what_one_after_the_other_gives(spark, monkeypatch, block):
    monkeypatch.setattr(dictionary, "BLOCK", block)
    rng = random.Random(1)
    n_layers = 0
    for k in range(1500):
        letters = "ab" if k % 2 else "abc"
        pairs = sorted(((word(rng, 1, 5, letters), word(rng, 0, 4, letters + "XY")) for _ in range(rng.randrange(1, 7))), key=lambda p: -len(p[0]))
        text = want = word(rng, 0, 30, letters)
        for part in dictionary.blocks(pairs):
            made = dictionary.layers(part)
            n_layers += len(made)
            for layer in made:
                text = dictionary.replaced(dictionary.automaton_of(layer), text)
        assert text == one_by_one(want, pairs)
    assert n_layers > 1500


def test_dictionaries_from_lists_and_tables(spark, monkeypatch):
    rng = random.Random(2)
    pairs = sorted({word(rng, 1, 6, "ab é"): word(rng, 0, 3, "abX") for _ in range(80)}.items(), key=lambda p: (-len(p[0]), p[0]))
    texts = [(i, word(rng, 0, 50, "ab é😀\n")) for i in range(100)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    table = spark.createDataFrame([*pairs, (None, "x"), ("", "y")], "from string, to string").repartition(3)
    want = {i: None if t is None else one_by_one(t, pairs) for i, t in texts}
    for block in (4_000_000, 20):
        monkeypatch.setattr(dictionary, "BLOCK", block)
        for given in (pairs, table):
            assert {r["doc_id"]: r["scrubbed"] for r in gate.apply_dictionary(df, given).collect()} == want
    assert gate.apply_dictionary(df, table.limit(0)).where("scrubbed <=> text").count() == len(texts)


def test_a_hundred_thousand_pairs_are_one_pass():
    pairs = sorted(((f"name{i} of company{i}", f"[ORG{i % 100}]") for i in range(100_000)), key=lambda p: -len(p[0]))
    began = time.time()
    (layer,) = dictionary.layers(pairs)
    text = " ".join(f"name{i} of company{i} and" for i in range(0, 100_000, 7))
    assert dictionary.replaced(dictionary.automaton_of(layer), text) == " ".join(f"[ORG{i % 100}] and" for i in range(0, 100_000, 7))
    assert time.time() - began < 30


def test_only_terms_that_a_text_holds_become_rows(spark):
    rng = random.Random(3)
    texts = [(i, "\n".join(word(rng, 0, 12, "ab ") for _ in range(rng.randrange(6)))) for i in range(80)]
    terms = {word(rng, 1, 4, "ab ") for _ in range(40)} | {"a\nb", "not there"}
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = {r["term"]: r["n_lines"] for r in gate.residual_counts(df, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {t: sum(t in line for _, text in texts for line in text.split("\n")) for t in terms}
    many = spark.createDataFrame([(f"none{i}", 0) for i in range(5000)] + [("ab", 0)], "keyword string, idx int")
    (column,) = keywords.lines_with(spark, F.col("text"), many)
    assert df.select(F.explode(column)).count() == sum("ab" in t for _, t in texts)  # a row for each hit, not for each trigram


def slowly(text, todo):
    """The edits one by one on a copy of the text each."""
    for token in sorted({t for t, _ in todo}, key=lambda t: -len(t)):
        values = [v for t, v in todo if t == token]
        found = list(re.finditer(re.escape(token), text))
        whole = text
        for m, value in reversed([(m, values[0]) for m in found] if len(values) == 1 else list(zip(found, values, strict=False))):
            start, end = edits.padded(whole if len(values) == 1 else text, m.start(), m.end())
            text = text[:start] + value + text[end:]
    return text


def test_edits_by_brute_force_and_in_time():
    rng = random.Random(4)
    for _ in range(5000):
        text, tokens = word(rng, 0, 25, "_ ab\n#"), rng.sample(["_", "__#", "a", "_ a "], rng.randrange(1, 4))  # of one length each
        todo = [(t, word(rng, 0, 3, "xy #")) for t in tokens for _ in range(rng.randrange(1, 4))]
        if len({len(t) for t in tokens}) == len(tokens):
            assert edits.edited(text, todo) == slowly(text, todo)
    began = time.time()
    assert edits.edited("_ abc " * 200_000, [("_", "v")] * 200_000) == "vabc" * 200_000 + " "
    assert time.time() - began < 15
