"""The pipeline's stages on a small table with planted cases."""

import random

import corpus_pipeline
from lacuna.llm import simhash
from lacuna.llm.common import written


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = {"en": [f"th{a}{b}" for a in "aeiou" for b in ("n", "ng", "st", "re")], "de": [f"sch{a}{b}" for a in "aeiou" for b in ("t", "ber", "zu", "en")]}
    text = lambda k, n: " ".join(rng.choice(vocabulary[k]) + rng.choice(["", "x", "er", "ly"]) for _ in range(n))
    item = text("en", 20)
    rows = [(i, text("en" if i % 2 else "de", 80), "en" if i % 2 else "de") for i in range(80)]
    rows += [(100, rows[3][1], "en"), (101, rows[3][1].upper(), "en"), (102, f"{text('en', 30)} {item} {text('en', 30)}", "en"), (103, "1234 !!", None), (104, None, "en"), (105, text("en", 50) + " write to bob@mail.example.com now", "en"), (105, text("en", 50), "en")]
    spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        df = written(stage(spark, df, str(tmp_path)), name)
        kept[name] = df
        if name != "sampled_pieces":
            assert df.columns == list(corpus_pipeline.COLUMNS)
    ids = {k: sorted(r["doc_id"] for r in v.select("doc_id").collect()) for k, v in kept.items()}
    clean = [*range(80), 105, 105]  # rows are judged by their own texts
    assert ids["language"] == sorted([*range(80), 100, 101, 102, 105, 105])
    assert ids["near_duplicates"] == [*range(80), 102, 105, 105]
    assert ids["decontamination"] == ids["personal_data"] == ids["sampled_pieces"] == clean
    last = {r["doc_id"]: r for r in kept["personal_data"].collect()}
    assert all("bob@" not in r["text"] and r["n_chars"] == len(r["text"]) for r in last.values())
    assert all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in df.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(clean)


def test_near_copies_go_and_tables_of_any_shape_pass(spark, tmp_path):
    rng = random.Random(10)
    words = lambda n: " ".join(rng.choice("bcdfghjklmnprstvw") + rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(n))
    rows = []
    for i in range(60):
        text = words(150).split()
        rows.append((i, " ".join(text)))
        text[rng.randrange(150)] = "altered"
        rows.append((1000 + i, " ".join(text)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "clash", "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id string")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(60))
    spark.createDataFrame([(1, words(20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        if name != "language":
            assert stage(spark, docs, str(tmp_path)).count() > 0, name


def test_rows_without_or_with_repeated_ids_are_judged_by_their_texts(spark, tmp_path):
    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice("bcdfghjklmnprstvw") + rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(n))
    item, first, second, third = words(20), words(90), words(90), words(90)
    rows = [(None, first), (5, first), (None, second), (None, second), (6, third), (6, f"{words(40)} {item} {words(40)}"), (None, f"{words(30)} {item} {words(30)}"), (7, first + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect())) == sorted([(5, first), (0, second), (6, third), (6, rows[5][1]), (0, rows[6][1])])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = corpus_pipeline.decontamination(spark, kept, str(tmp_path))
    assert clean.columns == list(corpus_pipeline.COLUMNS) and sorted(((r["doc_id"] or 0, r["text"]) for r in clean.collect())) == sorted([(5, first), (0, second), (6, third)])


def test_families_of_near_copies_and_texts_that_only_look_alike(spark):
    """One of each family stays, also where its members are alike through a third one; texts below the overlap stay."""
    rng = random.Random(13)
    words = lambda n: [rng.choice("bcdfghjklmnprstvw") + rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(n)]
    rows, families = [], []
    for f in range(12):
        source, own = words(120), []
        for k in range(25):
            copy = list(source)
            if k:
                copy[rng.randrange(120)] = "altered"
            own.append(f * 100 + k)
            rows.append((f * 100 + k, " ".join(copy)))
        families.append(own)
    half = words(60)
    rows += [(5000 + i, " ".join(half + words(60))) for i in range(20)]  # a passage in common, no near copies
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (64, 2):  # crowds linked by leaders and classes
        kept = {r["doc_id"] for r in simhash.representatives(docs, hot=hot).collect()}
        assert all(min(own) in kept and len(kept & set(own)) == 1 for own in families)
        assert {5000 + i for i in range(20)} <= kept


def test_sketches_give_the_overlap(spark):
    rng = random.Random(14)
    cases = []
    for _ in range(40):
        base = [f"w{rng.randrange(9)}" for _ in range(rng.randrange(60))]
        cases.append((" ".join(base), " ".join(w if rng.random() < 0.97 else "x" for w in base)))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()
    df = spark.createDataFrame([(simhash.shingle_sketch(a), simhash.shingle_sketch(b)) for a, b in cases], "a array<int>, b array<int>")
    got = [r[0] for r in df.select(simhash.overlap_of(df["a"], df["b"])).collect()]
    assert all(abs(x - (len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) if shingles(a) | shingles(b) else 1)) < 1e-9 for x, (a, b) in zip(got, cases, strict=True))


def test_links_of_a_family_below_the_crowds_are_not_all_made(spark, monkeypatch):
    """300 fingerprints within nine bits of each other, in keys that count as no crowd: one class, from few links."""
    rng = random.Random(16)
    centre, made, written_as = rng.getrandbits(63), [], simhash.written

    def counted(df, what):
        out = written_as(df, what)
        made.append(out.count() if what == "links" else 0)
        return out

    monkeypatch.setattr(simhash, "written", counted)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4))) for _ in range(300)})
    rows = simhash.classes(spark.createDataFrame([(f,) for f in fps], "fp long"), 9, hot=1000).collect()
    assert len(rows) == len(fps) and {r["root"] for r in rows} == {fps[0]}
    assert sum(made) < len(fps) * (len(fps) - 1) / 8


def test_families_are_those_of_all_pairs_alike(spark):
    """Crowds of texts about the line between alike and not: the families of all pairs of a crowd, long texts and short ones, as from brute force."""
    rng = random.Random(15)
    words = lambda n: [rng.choice("bcdfghjklmnprstvw") + rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(n)]
    texts = ["", " ", "\n"]
    for n, edits in ((90, 2), (300, 6), (60, 1), (124, 2)):
        base = words(n)
        for _ in range(70):
            copy = list(base)
            for _ in range(rng.randint(1, edits)):
                copy[rng.randrange(n)] = words(1)[0] * 2
            texts.append(" ".join(copy[rng.randrange(3) :]))
    rows = list(enumerate(dict.fromkeys(texts)))
    fps = [simhash.fingerprint_of(t, 2) & (2**64 - 1) for _, t in rows]
    sketches = [set(simhash.shingle_sketch(t)) for _, t in rows]

    def families(pairs):
        root = list(range(len(rows)))
        for a, b in pairs:
            a, b = sorted((root[a], root[b]))
            root = [a if x == b else x for x in root] if a != b else root
        return root

    pairs = [(i, j) for j in range(len(rows)) for i in range(j)]
    group = families([(i, j) for i, j in pairs if (fps[i] ^ fps[j]).bit_count() <= 9])

    def alike(a, b):
        least = set(sorted(a | b)[:128])
        return not least or len(a & b & least) / len(least) >= 0.8

    expected = sorted(set(families([(i, j) for i, j in pairs if group[i] == group[j] and alike(sketches[i], sketches[j])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.representatives(docs).collect()) == expected
