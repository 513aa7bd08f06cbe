"""Search, gate, dictionary, encryption, records, sources, streams."""

import pytest
from pyspark.sql import functions as F

from lacuna.operators import crypto, gate, records, redact, search
from lacuna.operators.detect import detect
from lacuna.sources import documents as sources
from lacuna.streaming.jobs import redact_stream, write_stream


def test_search_overlaps_and_contexts(spark):
    text = "x" * 40 + "AnaNa" + "y" * 40
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    hits = search.search(df, "ana").where("doc_id = 1").first()["hits"]
    assert [(h["index"], h["start"], h["value"]) for h in hits] == [(0, 40, "Ana"), (1, 42, "aNa")]
    assert hits[0]["contextBefore"] == "…" + "x" * 29 and hits[0]["contextAfter"] == "Na" + "y" * 27 + "…"
    assert all(r["hits"] == [] for r in search.search(df, "a").collect())
    added = search.search_and_add(detect(df.withColumn("text", F.lit("a@anan.co anan")), rules=__import__("lacuna.functions.rules", fromlist=["BUILTIN"]).BUILTIN[2:3]), "anan").first()
    assert (added["n_added"], added["n_skipped"]) == (1, 1)


@pytest.mark.parametrize(("line", "pattern"), [("13812345678", "PHONE"), ("x13812345678", None), ("110101199003078888", "ID_CARD"), ("a@b.co", "EMAIL"), ("1.2.3.4", "IP"), ("AB-12-34", "CONTRACT_NO"), ("某某有限公司", "COMPANY"), ("姓名：张三", "NAME"), ("plain", None)])
def test_gate_patterns(spark, line, pattern):
    rows = gate.gate_lines(spark.createDataFrame([("f", f"ok\n{line}\n")], "doc_id string, text string")).collect()
    assert [(r["line_no"], r["pattern"]) for r in rows] == ([(2, pattern)] if pattern else [])


def test_gate_targets_diff_and_verdict(spark):
    files = spark.createDataFrame([("src/a.ts", "x"), ("scripts/b.sh", "x"), ("c.bin", "a\0b"), ("d", "")], "path string, text string")
    assert [r["path"] for r in gate.gate_targets(files).collect()] == ["src/a.ts"]
    diff = ["+++ b/f", "@@ -1,0 +5,2 @@", "+one", "+two", "@@ -9 +20 @@", "-old", "+three"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(diff)], "file string, idx int, line string")
    assert sorted((r["line_no"], r["line"]) for r in gate.added_lines(lines).collect()) == [(5, "one"), (6, "two"), (20, "three")]
    df = spark.createDataFrame([("f", "a@b.co"), ("g", "x")], "doc_id string, text string")
    assert {(r["doc_id"], r["verdict"]) for r in gate.gate_verdict(df, gate.gate_lines(df)).collect()} == {("f", "fail"), ("g", "pass")}
    assert gate.quiet(gate.gate_lines(df)).first()["match"] == "[REDACTED]"


def test_dictionary(spark):
    df = spark.createDataFrame([(1, "foobar foo\nfoo")], "doc_id int, text string")
    assert gate.apply_dictionary(df, [("foo", "a"), ("foobar", "foo!")]).first()["scrubbed"] == "a! a\na"
    many = [(f"w{i}", "z") for i in range(60)] + [("foo", "a")]
    assert gate.apply_dictionary(df, many).first()["scrubbed"] == "abar a\na"
    terms = spark.createDataFrame([("foo",), ("none",)], "term string")
    assert {(r["term"], r["n_lines"]) for r in gate.residual_counts(df, terms).collect()} == {("foo", 2), ("none", 0)}
    texts = spark.createDataFrame([(1, "aab ab\nb\n\nxaabx aab"), (1, "ab"), (2, None)], "doc_id int, text string")
    terms = spark.createDataFrame([("ab",), ("aab",), ("b",), ("aab ab",), ("ab",), ("",), (None,), ("zz",)], "term string")
    assert sorted(map(tuple, gate.residual_counts(texts, terms).collect())) == [("aab", 2), ("aab ab", 1), ("ab", 3), ("b", 4), ("zz", 0)]
    assert gate.residual_counts(texts, terms.limit(0)).count() == 0


def test_encryption(spark):
    df = redact.redact(detect(spark.createDataFrame([(1, "mail a@b.co now")], "doc_id int, text string")))
    sealed = crypto.encrypt_mapping(df, "secret1", salt=F.lit(b"0" * 16), iv=F.lit(b"1" * 12))
    opened = crypto.decrypt_mapping(sealed.drop("mapping"), "secret1").first()
    assert opened["mapping"][0]["originalValue"] == "a@b.co" and len(opened["iv"]) == 12
    assert crypto.decrypt_mapping(sealed.drop("mapping"), "secret2").first()["mapping"] is None
    bad = sealed.drop("mapping").withColumn("data", F.concat(F.lit(b"\x00"), F.expr("substring(data, 2)")))
    assert crypto.decrypt_mapping(bad, "secret1").first()["mapping"] is None
    fresh = crypto.encrypt_text(spark.range(2).withColumn("t", F.lit("x")), "t", "secret1")
    assert all(len(r["salt"]) == 16 for r in fresh.collect())
    with pytest.raises(ValueError):
        crypto.check_password("12345", "12345")
    m = spark.range(1).select(crypto.parse_meta(crypto.meta_envelope(F.lit("a<b"), F.lit(b"s"), F.lit(b"i"), F.lit(b"d"))).alias("p"), crypto.parse_meta(F.lit("none")).alias("q")).first()
    assert bytes(m["p"]["data"]) == b"d" and m["q"]["salt"] is None


def test_records(spark):
    rows = spark.createDataFrame([("1", "abc.docx", "active", 1), ("2", "abcd_脱敏.docx", "active", 2), ("3", "zz.pdf", "deleted", 3)], "id string, file_name string, status string, created_at int")
    files = spark.createDataFrame([("abcd.txt",), ("qqq.txt",)], "file_name string")
    for names, listed in ((files, rows), (files.unionByName(files), rows.unionByName(rows))):
        got = sorted((r["file_name"], str(r["id"]), r["n_matches"]) for r in records.match_records(names, listed).collect())
        assert got == [("abcd.txt", "1", 2), ("abcd.txt", "2", 2), ("qqq.txt", "None", 0)]
    assert records.record_stats(rows).first().asDict() == {"total": 3, "restored": 0, "active": 2}
    assert {r["id"]: r["status"] for r in records.delete_records(rows, rows.where("id = '1'")).collect()}["1"] == "deleted"
    assert [r["id"] for r in records.list_records(rows).collect()] == ["3", "2", "1"]
    kv = spark.createDataFrame([("a", "1", 1)], "key string, value string, ts int")
    new = spark.createDataFrame([("a", "2", 2), ("b", "3", 1)], "key string, value string, ts int")
    assert {(r["key"], r["value"]) for r in records.upsert_settings(kv, new).collect()} == {("a", "2"), ("b", "3")}
    assert {(r["key"], r["value"]) for r in records.read_settings(kv, {"a": "0", "z": "9"}).collect()} == {("a", "1"), ("z", "9")}


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>x</p>\ny")
    assert sources.read_text_documents(spark, str(tmp_path / "in")).first()["raw_text"] == "<p>x</p>\ny"
    names = spark.createDataFrame([("application/pdf", "x"), ("", "a.XLSM"), ("", "a.md"), ("text/plain", "a.md")], "mime_type string, file_name string")
    good, bad = sources.with_format(names)
    assert [r["format"] for r in good.collect()] == ["pdf", "xlsx", "txt"] and bad.count() == 1
    assert spark.range(1).select(sources.is_legacy_binary(F.lit(bytes.fromhex("D0CF11E0A1")))).first()[0]
    cells = spark.createDataFrame([("d", 1, 0, 0, "z"), ("d", 0, 1, 0, "b"), ("d", 0, 0, 1, "a"), ("d", 0, 0, 0, None)], "doc_id string, sheet_idx int, row int, col int, value string")
    assert sources.cells_to_text(cells).first()["raw_text"] == "a b\nz"
    blocks = spark.createDataFrame([("d", 0, "p", "one", None), ("d", 1, "table", None, ["x", "", None, "0", "y"])], "doc_id string, path int, type string, text string, cells array<string>")
    assert sources.blocks_to_text(blocks).first()["raw_text"] == "one\nx\ny"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.co"), (2, None)], "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    stream = redact_stream(spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "in")))
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r["redacted_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"______​", ""}


def test_name_matches_against_brute_force(spark):
    import random

    rng = random.Random(5)
    name = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))
    files, rows = sorted({name() for _ in range(25)}), [(i, name()) for i in range(40)]
    got = records.match_records(spark.createDataFrame([(f"{f}.txt",) for f in files] + [(None,)], "file_name string"), spark.createDataFrame([(i, f"{r}.docx", "active") for i, r in rows] + [(99, None, "active")], "id int, file_name string, status string"))
    expected = {f: [i for i, r in rows if r in f or f in r] for f in files}
    found = {f: [] for f in files}
    for r in got.where("file_name is not null").collect():
        found[r["file_name"][:-4]] += [] if r["id"] is None else [r["id"]]
        assert r["n_matches"] == len(expected[r["file_name"][:-4]])
    assert {f: sorted(v) for f, v in found.items()} == expected


def test_updates_keep_one_row_each(spark):
    rows = spark.createDataFrame([("1", "active", "x"), ("2", "active", "y"), (None, "active", "z")], "id string, status string, __new string")
    updates = spark.createDataFrame([("1", "restored"), ("1", "deleted"), ("1", "restored"), ("2", None), ("9", "deleted"), (None, "deleted")], "id string, status string")
    assert sorted(map(str, records.update_status(rows, updates).collect())) == sorted(map(str, spark.createDataFrame([("1", "deleted", "x"), ("2", "active", "y"), (None, "active", "z")], rows.schema).collect()))


def test_rows_without_a_path_are_scanned_and_all_of_a_text_is_searched(spark):
    files = spark.createDataFrame([(None, "x"), ("scripts/x", "x")], "path string, text string")
    assert [r["path"] for r in gate.gate_targets(files).collect()] == [None]
    long = spark.createDataFrame([("x" * 600_000 + "needle",)], "text string")
    assert [len(search.search(long, "needle", limit=n).first()["hits"]) for n in (500_000, None)] == [0, 1]
    null = spark.createDataFrame([(1, "an anan", None)], "doc_id int, text string, matches array<struct<type:string,value:string,start:int,end:int,confidence:double,context:string,rule_idx:int,seq:int>>")
    row = search.search_and_add(null, "an").first()
    assert (row["n_added"], row["n_skipped"], len(row["matches"])) == (3, 0, 3)


def test_rejects_of_decryption(spark):
    sealed = crypto.encrypt_text(spark.createDataFrame([(1, "abc"), (2, "def")], "id int, t string"), "t", "secret1", salt=F.lit(b"0" * 16))
    spoilt = sealed.withColumn("data", F.when(F.col("id") == 2, F.concat("data", F.lit(b"x"))).otherwise(F.col("data"))).drop("t")
    good, bad = crypto.decrypted(spoilt, "secret1")
    assert [(r["id"], r["text"]) for r in good.collect()] == [(1, "abc")] and [(r["id"], r["reason"]) for r in bad.collect()] == [(2, "wrong password or altered data")]
