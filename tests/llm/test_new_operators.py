"""Operators 11 to 13 on small tables: edge cases of each, and brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import conversations, decontaminate, hard_negatives, toxicity
from lacuna.llm.queries import damaged

# 11


@pytest.fixture(scope="module")
def taught(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    bad = ["wretched", "blockhead", "nitwit"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic = i % 3 == 0
        for _ in range(2 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", "s", "clash"))
        labels.append((i, int(toxic)))
    rows += [(2000, None, None, None, "c"), (2001, "", "en", "s", "c"), (None, "no id", "en", "s", "c"), (2002, "123 ### 4", "en", "s", "c"), (2003, " ".join(rng.choice(plain) for _ in range(30_000)) + " blockhead wretched nitwit", "en", "s", "c"), (2004, "x" * 60_000, "en", "s", "c"), (5, rows[5][1], "en", "s", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    return docs, spark.createDataFrame([*labels, (None, 1), (7, None), (7777, 1)], "doc_id long, toxic int"), plain, bad


def test_toxicity(taught):
    docs, labels, plain, bad = taught
    model = toxicity.fit(docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 != 1), labels)
    rows = toxicity.predict(docs, model).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 900 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) > 0.95
    assert by_id[2000]["score"] == by_id[2001]["score"] == by_id[2002]["score"] and not by_id[2004]["predicted"]
    assert by_id[2003]["predicted"] == 1  # three insults at the end of 30,000 words
    scores = toxicity.scores_of(model.margins(), model.offset(), pa.array([" ".join([*plain[:40], w, *plain[40:80]]) for w in ("wretchedd", "blokhead", "blockheads", "nitwitt")]))
    assert (scores >= 0.5).all()  # misspellings that training never saw
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_scores_by_brute_force(taught):
    docs, labels, _, _ = taught
    model = toxicity.train([(i % 2, t) for i, t in enumerate(["foul foul word", "plain word here"] * 40)], 0.5, least=1, rounds=4)
    margins = model.margins()

    def of(text):
        words = [w.strip("#.").lower() for w in text.split() if re.search("[a-zé]", w)]
        each = []
        for w in words:
            b, _ = toxicity.subwords(pa.array([w], pa.large_string()))
            assert len(b) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in toxicity.SIZES)
            known = margins[b][~np.isnan(margins[b])]
            each.append(known.mean() if len(known) else 0.0)
        n = -(-len(each) // toxicity.WINDOW)
        cut = [[each[j] for j in range(len(each)) if j * n // len(each) == i] for i in range(n)]
        return 1 / (1 + np.exp(-(max((np.mean(c) for c in cut), default=0.0) + model.offset())))

    texts = ["foul", "plain foul ### word. éfoul here and there", "", "Plain", "a b c d e f g foul foul"]
    assert np.allclose(toxicity.scores_of(margins, model.offset(), pa.array(texts)), [of(t) for t in texts], atol=1e-5)


def test_toxicity_without_labels(taught):
    docs, labels, _, _ = taught
    assert all(r["score"] < 1e-9 for r in toxicity.judge(docs, labels.limit(0)).collect())
    assert all(abs(r["score"] - 1) < 1e-9 for r in toxicity.judge(docs, labels.where("toxic = 1")).collect())
    assert toxicity.judge(docs.limit(0), labels).count() == 0


# 12


def cheapest(roles, stay, cut):
    """All edits of a few turns: the least (cost, audit)."""
    found = []

    def walk(i, out, cost, audit, inserted):
        if i == len(roles) and re.fullmatch("(s?(ua)+)?", out):
            found.append((cost, audit))
        if inserted < 2:
            for x in "ua":
                walk(i, out + x, cost + 5, audit + "I", inserted + 1)
        if i < len(roles):
            walk(i + 1, out, cost + 2, audit + "D", 0)
            if stay[i]:
                if roles[i] in "sua":
                    walk(i + 1, out + roles[i], cost + 5 * cut[i], audit + "K", 0)
                for x in "ua":
                    walk(i + 1, out + x, cost + 1 + 5 * cut[i], audit + "R", 0)

    walk(0, "", 0, "", 0)
    return min(found)


def test_alignment_by_brute_force(monkeypatch):
    rng = random.Random(8)
    cases = []
    for _ in range(120):
        n = rng.randrange(5)
        stay = np.array([rng.random() < 0.8 for _ in range(n)], bool)
        cases.append((np.array([rng.choice("suaua-") for _ in range(n)], "U1"), stay, np.array([rng.random() < 0.3 for _ in range(n)], bool) & stay))
    for roles, stay, cut in cases:
        want = cheapest(roles.tolist(), stay.tolist(), cut.tolist())
        assert conversations.aligned(roles, stay, cut) == want == conversations.by_phase(roles, stay, cut)
    for n in (60, 300):
        for _ in range(5):
            roles = np.array(["ua"[i % 2] if rng.random() < 0.8 else rng.choice("sua-") for i in range(n)], "U1")
            stay = np.array([rng.random() < 0.85 for _ in range(n)], bool)
            cut = np.array([rng.random() < 0.15 for _ in range(n)], bool) & stay
            assert conversations.aligned(roles, stay, cut) == conversations.by_phase(roles, stay, cut)
    monkeypatch.setattr(conversations, "CELLS", 0)
    assert all(conversations.aligned(*c) == conversations.by_phase(*c) for c in cases)


def repaired_by_hand(turns):
    """What one conversation's damaged rows give, by the statement of the task."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    seen, kinds = set(), []
    for _, role, text in turns:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] if r[:1] in ("s", "u", "a") else "-" for _, r, _ in turns]
    cost, audit = cheapest(initials, [k not in ("blank", "duplicate") for k in kinds], [k == "truncated" for k in kinds])
    lines, i, want = [], 0, None
    for letter in audit:
        turn = turns[i] if letter != "I" else (None, "", "")
        i += letter != "I"
        if letter == "D":
            continue
        if want is None and letter == "K" and turn[1][:1] == "s":
            want, role = "user", turn[1]
        else:
            own = want or "user"
            role, want = turn[1] if letter == "K" else own, "assistant" if own == "user" else "user"
        lines.append(f"{role}:{turn[2]}")
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_conversations(spark):
    rng = random.Random(12)
    rows = []
    for conv in [*range(60), None]:
        for turn in rng.sample(range(8), rng.randrange(1, 5)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), rng.choice(["Fine.", "So it is!  \n", "cut off", "", " \t", None, "Größe？", "Fine."]), "clash", "clash", "clash"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, place string, code string")
    own = lambda x: " " if x is None else str(x)
    want = {}
    for conv, turn, role, text, *_ in rows:
        fault = zlib.crc32(f"{own(conv)}:{own(turn)}".encode()) % 20
        turns = want.setdefault(conv, [])
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", own(text)) if fault == 2 else own(text)
            turns += [(turn, "user" if fault == 4 else own(role), text)] * (2 if fault == 3 else 1)
    from lacuna.llm import queries

    got = {r["conv_id"]: tuple(r)[1:] for r in run_op12(spark, queries, df).collect()}
    assert got == {k: repaired_by_hand(v) for k, v in want.items()}
    assert damaged(df.limit(0)).count() == 0 and run_op12(spark, queries, df.limit(0)).count() == 0


def run_op12(spark, queries, df):
    """The query's own function over a given table."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(queries, "table", lambda *_: df)
        return queries.op12_conversation_repair(spark, "")


def test_a_long_conversation_is_repaired(spark):
    n = 3000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    plan, repaired = conversations.repair(df.where("turn % 100 <> 7"))
    row = plan.collect()[0]
    assert row["n_turns"] == n - 30 and row["gaps"] == 30 and row["n_illegal"] == 30 and row["cost"] <= 60
    roles = [r["role"] for r in repaired.orderBy("place").collect()]
    assert roles == ["user", "assistant"] * (len(roles) // 2)


# 13


def mined(rows):
    """All pairs by the statement of the task."""
    taken = [(i, y, [int(np.floor(256 * float(x))) for x in v]) for i, v, y in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, ya, va in taken:
        if a is None or a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(va, vb, strict=False)), b is None, b or 0, yb) for b, yb, vb in taken if b != a)
        for s, none, p, _ in [x for x in scored if x[3] == ya][:5]:
            fits = [x for x in scored if x[3] != ya and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(a, None if none else p, k + 1, None if x[1] else x[2], -s, -x[0]) for k, x in enumerate(fits[:10])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("spread", "block", "cluster"), [(0.2, 8192, 64), (1.0, 2, 1), (0.05, 3, 2)])
def test_hard_negatives(spark, spread, block, cluster):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8))
    rows = [(int(i), [float(x) for x in centres[i % 4] + spread * rng.normal(size=8)], int(i % 5)) for i in range(0, 1200, 3)]
    rows += [(2000 + i, [0.5] * 8, 1) for i in range(20)]  # ties
    rows += [(3001, [1.0] * 8, None), (3002, None, 1), (3003, [1.0, None] * 4, 1), (3004, [float("nan")] * 8, 1), (3005, [float("inf")] * 8, 2), (3100, [], 2), (3107, [1.0, 2.0], 3), (None, [0.9] * 8, 1), (3200, [0.0] * 8, 0)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<double>, label int, v string, anchor string").repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, block=block, cluster=cluster)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows)


def test_hard_negatives_of_odd_tables(spark):
    df = spark.createDataFrame([(100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (7, [1.0, 0.4], 1), (7, [1.0, 0.4], 1), (8, [0.6, 0.3], 2)], "vec_id long, embedding array<float>, label long")
    rows = [tuple(r)[:4] for r in hard_negatives.hard_negatives(df, F.col("vec_id") == 100).collect()]
    assert sorted(rows) == [(100, 7, 1, 8), (100, 7, 1, 8)]  # equal anchors count once, each of two equal positives takes a place
    assert hard_negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


# 10: classes of templates


def test_template_classes_by_all_pairs(spark):
    """Coverage and slot consistency of every text with every item, by their windows alone."""
    rng = random.Random(17)
    said = "the a of market river buys sells gives apples pears boats old red".split()
    slot = lambda: rng.choice(["5", "7", "12", "Anna", "Tom", "McKay"])
    shapes = [[rng.choice(said) if rng.random() < 0.7 else None for _ in range(rng.randrange(7, 16))] for _ in range(6)]
    filled = lambda shape: "and " + " ".join(w or slot() for w in shape)
    items = [(i, filled(rng.choice(shapes))) for i in range(40)]
    docs = [(i, " ".join(filled(rng.choice(shapes)) if rng.random() < 0.7 else " ".join(rng.choice(said) for _ in range(9)) for _ in range(rng.randrange(1, 3)))) for i in range(80)]
    windows = lambda text: [(int(p), int(k), v, bool(c)) for _, p, k, v, _, c in zip(*decontaminate.window_rows(pa.array([text]), 5), strict=True)]
    read = {i: windows(t) for i, t in items}
    read = {i: [w for w in ws if w[3] or not any(x[3] for x in ws)] for i, ws in read.items()}

    def covered(doc, item):
        places = {p for p, k, v, _ in item if not v for q, l, u, _ in doc if not u and k == l}
        ways = {}
        for p, k, v, _ in item:
            for q, l, u, _ in doc:
                if v and u and k == l:
                    ways.setdefault(q - p, []).append((p, set(zip(v, u, strict=True))))
        for own in ways.values():
            pairs = set().union(*(x for _, x in own))
            if len(pairs) == len({a for a, _ in pairs}):
                places |= {p for p, _ in own}
        return len(places) / len({p for p, *_ in item})

    class_of = {r["item_id"]: r["class_id"] for r in decontaminate.item_classes(spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(class_of) == {i for i, ws in read.items() if ws} and len(set(class_of.values())) < len(items)
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text in docs:
        doc = windows(text)
        want = {class_of[j] for j, item in read.items() if item and covered(doc, item) >= 0.8}
        assert want <= set(got[i]["item_ids"])  # a class may take windows as they stand from several members
        assert len(set(got[i]["item_ids"]) - want) <= 1 and got[i]["n_items"] == len(got[i]["item_ids"])


def test_a_template_meets_a_text_once(spark):
    item = lambda a, b, c: f"Well, {a} has {b} apples and gives {c} apples to {a} before the market by the old river opens again today."
    items = spark.createDataFrame([(i, item(["Anna", "Tom", "Mia"][i % 3], 1000 + i, 3000 + i)) for i in range(400)] + [(500, item("Anna", 9, 9))], "item_id long, text string")
    docs = spark.createDataFrame([(i, "Solve this: " + item("Peter", i, i + 1)) for i in range(300)], "doc_id long, text string")
    windows = decontaminate.item_windows(items, "item_id", "text", 5)
    assert windows.where(F.size("slots") > 0).count() == 2 * windows.where(F.size("slots") > 0).select("key", "pos").distinct().count()  # two classes: 9 and 9 are equal
    rows = decontaminate.decontaminate(docs, items).collect()
    assert all(r["contaminated"] and r["item_ids"] == [0] for r in rows)
    members = decontaminate.item_classes(items).groupBy("class_id").count().collect()
    assert {(r["class_id"], r["count"]) for r in members} == {(0, 400), (500, 1)}


def test_candidates_are_sorted_a_few_times_only(monkeypatch):
    """A task with many queries doesn't sort all of its results for each step of each list."""
    h, rng = hard_negatives, np.random.default_rng(5)
    rows, labels, ids = rng.integers(-40, 40, (6000, 6)).astype(float), rng.integers(0, 3, 6000), np.arange(6000)
    anchors, calls, lexsort = np.arange(0, 6000, 30), [], np.lexsort
    owner = np.repeat(np.arange(len(anchors)), rng.integers(0, 4, len(anchors)))
    low, high = rng.integers(-2000, 500, len(owner)).astype(float), rng.integers(600, 4000, len(owner)).astype(float)
    asked = h.Asked(anchors, labels[anchors], rows[anchors], h.clustered(rows[anchors], 16), owner, low, high, 4, False)
    monkeypatch.setattr(np, "lexsort", lambda keys: calls.append(1) or lexsort(keys))
    w = h.Walk(asked)
    for at in range(0, 6000, 1000):
        w.batch(ids[at : at + 1000], labels[at : at + 1000], rows[at : at + 1000])
    w.keep(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))
    getattr(w, "merge", lambda: None)()
    got, want = sorted(zip(w.query.tolist(), (-w.score).tolist(), w.id.tolist())), []
    for q, a in enumerate(owner):
        score = (rows @ rows[anchors[a]]).astype(int)
        fits = (labels != labels[anchors[a]]) & (score >= low[q]) & (score <= high[q])
        want += [(q, -s, i) for s, i in sorted(zip((-score[fits]).tolist(), ids[fits].tolist()))[:4] for s in [-s]]
    assert got == sorted(want) and len(calls) <= 5
