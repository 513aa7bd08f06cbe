"""Names that all look alike, and stores that a repeated job leaves as they are."""

import os
import random

from pyspark.sql import functions as F

from lacuna.operators import records


def test_names_meet_within_each_other_by_brute_force(spark):
    rng = random.Random(6)
    name = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
    files, kept = [f"{name()}.txt" for _ in range(60)], [(f"r{i}", f"{name()}_脱敏.txt", "active") for i in range(60)]
    f, r = spark.createDataFrame([(x,) for x in files], "file_name string"), spark.createDataFrame(kept, "id string, file_name string, status string")
    bare = lambda x: x.removesuffix(".txt").removesuffix("_脱敏")
    want = {(x, i) for x in files for i, y, _ in kept if bare(x) in bare(y) or bare(y) in bare(x)}
    for many in (1000, 5, 0):  # names that meet by their grams, and names that are sought whole
        got = records.match_records(f, r, many=many).where("id is not null").collect()
        assert {(x["file_name"], x["id"]) for x in got} == want and len(got) == len(want)


def test_a_common_stem_makes_no_product(spark):
    n = 20_000
    f = spark.range(n).select(F.format_string("contract-of-the-year-%07d.txt", "id").alias("file_name"))
    r = spark.range(n).select(F.col("id").cast("string").alias("id"), F.format_string("contract-of-the-year-%07d_脱敏.txt", "id").alias("file_name"), F.lit("active").alias("status"))
    got = records.match_records(f, r).agg(F.count("id").alias("n"), F.max("n_matches").alias("most")).first()
    assert (got["n"], got["most"]) == (n, 1)


def test_no_parts_of_names_are_broadcast(spark):
    f = spark.range(300).select(F.format_string("contract %d.txt", "id").alias("file_name"))
    r = spark.range(3000).select(F.col("id"), F.format_string("contract %d_脱敏.txt", F.col("id") % 1500).alias("file_name"), F.lit("active").alias("status"))
    plan = records.match_records(f, r)._jdf.queryExecution()
    n, shown = plan.toRdd().count(), plan.executedPlan().toString()
    starts = lambda a, b: a.startswith(b) or b.startswith(a)
    want = sum(starts(str(k), str(i % 1500)) for k in range(300) for i in range(3000))
    assert n == want and "Join" in shown and "Broadcast" not in shown


def test_repeated_jobs_change_nothing_and_updates_touch_their_buckets(spark, tmp_path):
    path = str(tmp_path / "records")
    df = spark.createDataFrame([(i, f"text {i}", f"f{i}.txt", "txt", b"d", b"s", b"v", "red") for i in range(400)], "doc_id long, text string, file_name string, format string, data binary, salt binary, iv binary, redacted_text string")
    first = records.build_records(df.where("doc_id < 300"), run="monday")
    for _ in range(2):
        records.append_new(first, path)
    records.append_new(records.build_records(df, run="monday").unionByName(first), path)  # a part is new
    stored = spark.read.parquet(path)
    assert stored.count() == 400 == stored.select("id").distinct().count()
    parts = lambda: {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}
    before = parts()
    updates = stored.where("file_id in (1, 2, 3)").select("id", F.lit("deleted").alias("status")).unionByName(spark.createDataFrame([("unknown", "deleted"), (None, "deleted")], "id string, status string"))
    chosen = [tuple(r) for r in updates.collect()]
    updates = spark.createDataFrame(chosen, "id string, status string")
    for _ in range(2):
        touched = records.update_stored(updates, path, stored.schema)
        now = spark.read.parquet(path)
        assert now.count() == 400 and {r["file_id"] for r in now.where("status = 'deleted'").collect()} == {1, 2, 3}
    after = parts()
    assert 1 <= len(touched) <= 4 and all(after[d] == before[d] for d in before if int(d.split("=")[1]) not in touched)
    assert records.update_stored(updates.limit(0), path, stored.schema) == [] == records.update_stored(updates, str(tmp_path / "none"), stored.schema)
    audit = str(tmp_path / "audit")
    stored = spark.read.parquet(path)
    for _ in range(2):
        records.append_new(records.build_audit(stored.withColumn("n_matches", F.lit(1)), "redact", run="monday"), audit)
    assert spark.read.parquet(audit).count() == 400
