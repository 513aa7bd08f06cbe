"""Records of redactions, the audit log, statistics and settings, as append-only tables and views over them.

Defined cases: of several updates of one record the last state in the order active, restored, deleted counts; updates
without a state, or of unknown records, change nothing; records that repeat stay apart; a file name or record listed
several times is matched once; null names match nothing; empty tables give no rows; other columns stay, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lacuna.functions.spans import free

STATES = ("active", "restored", "deleted")
#: The end of a redacted file's name.
MARK = r"(_脱敏)?\.[^.]+$"


def _new_id(run: str | None, *parts: str) -> Column:
    """A random id, or with a run's name one that is the same whenever the run is repeated."""
    return F.expr("uuid()") if run is None else F.sha2(F.concat_ws("\x1f", F.lit(run), *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in parts)), 256)


def build_records(df: DataFrame, id_col: str = "doc_id", name_col: str = "file_name", format_col: str = "format", run: str | None = None) -> DataFrame:
    """One active record per redacted document. Without a ``run`` ids are new each time, so write the result once; with one a repeated run makes the same ids, for ``append_new``."""
    return df.select(
        _new_id(run, id_col, name_col, "text").alias("id"), F.col(id_col).alias("file_id"), F.sha2(F.col("text"), 256).alias("file_hash"), F.col(name_col).alias("file_name"), F.col(format_col).alias("file_type"),
        F.current_timestamp().alias("created_at"), F.col("data").alias("mapping_table"), F.col("salt").alias("key_salt"), F.col("iv"), F.sha2(F.col("redacted_text"), 256).alias("redacted_hash"), F.lit("active").alias("status"),
    )


def append(df: DataFrame, path: str, by: str | None = "status") -> None:
    """Appends to a Parquet table, by status where given."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def in_buckets(df: DataFrame, key: str, n_buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int"))


def _stored(spark: SparkSession, path: str, schema: StructType, buckets: list[int]) -> DataFrame | None:
    """The given buckets of a table, or None if there is no table yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(buckets))


def append_new(df: DataFrame, path: str, key: str = "id", n_buckets: int = 64) -> None:
    """Appends the rows whose key the table doesn't have, one for each key, to the buckets of their keys: a job that is run again adds nothing.

    Only the keys of the buckets that get rows are read.
    """
    own = in_buckets(df.dropDuplicates([key]), key, n_buckets)
    touched = [r[0] for r in own.select("bucket").distinct().collect()]  # n_buckets at most
    there = _stored(df.sparkSession, path, own.schema, touched)
    if there is not None:
        own = own.join(there.select(key), key, "left_anti").select(*own.columns)
    own.write.mode("append").partitionBy("bucket").parquet(path)


def update_stored(updates: DataFrame, path: str, schema: StructType, n_buckets: int = 64) -> list[int]:
    """New states by ``updates(id, status)`` in a table of ``append_new``: the buckets of their ids alone are read and written again. Run again, it changes nothing. Returns these buckets."""
    spark = updates.sparkSession
    touched = sorted(r[0] for r in in_buckets(updates.where("id is not null and status is not null"), "id", n_buckets).select("bucket").distinct().collect())
    whole = StructType([*(f for f in schema if f.name != "bucket"), StructField("bucket", IntegerType())])
    there = _stored(spark, path, whole, touched) if touched else None
    if there is None:
        return []
    # a bucket's files are replaced only when all of its new ones are written
    update_status(there, updates).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def list_records(records: DataFrame, status: str | None = None) -> DataFrame:
    """All records, the newest first; with a status that status alone, in no order."""
    return records.orderBy(F.desc("created_at")) if status is None else records.where(F.col("status") == status)


def get_record(records: DataFrame, id_: str) -> DataFrame:
    return records.where(F.col("id") == id_)


def update_status(records: DataFrame, updates: DataFrame) -> DataFrame:
    """New states by ``updates(id, status)``; other rows stay. Each record keeps its one row, however often it is updated."""
    name = free(records, "__new")
    place = F.coalesce(*(F.when(F.col("status") == s, i) for i, s in enumerate(STATES)), F.lit(-1))
    new = updates.where("id is not null and status is not null").groupBy("id").agg(F.max_by("status", F.struct(place, "status")).alias(name))
    return records.join(new, "id", "left").withColumn("status", F.coalesce(name, "status")).drop(name).select(*records.columns)


def delete_records(records: DataFrame, ids: DataFrame, hard: bool = False) -> DataFrame:
    """Marks records as deleted, or takes them out."""
    if hard:
        return records.join(ids.select("id"), "id", "left_anti")
    return update_status(records, ids.select("id").distinct().withColumn("status", F.lit("deleted")))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, MARK, "")


def _parts(name: Column, sizes: list[int]) -> Column:
    """The distinct substrings of a name of the given lengths."""
    of = lambda n: F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substring(name, i, F.lit(n))) if n else F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *(of(n) for n in sorted(sizes))))


def _met(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that broadcasts neither side: parts of names are like each other, so they are far larger than their files and shuffles tell."""
    return a.join(b.hint("merge"), on, how)


def _sizes(names: DataFrame, length: Column) -> list[int]:
    """The lengths that occur, not more than a name is long."""
    return [r[0] for r in names.select(length).distinct().collect()]


def _within(short: DataFrame, a: str, wide: DataFrame, b: str) -> DataFrame:
    """Pairs of which the name ``a`` stands within the name ``b``, by equality: each ``b`` gives its substrings of the lengths that names ``a`` have. Only true pairs are ever made."""
    return _met(wide.withColumn(a, F.explode(_parts(F.col(b), _sizes(short, F.length(a))))), short, a)


def _held(short: DataFrame, a: str, wide: DataFrame, b: str, size: int, many: int) -> DataFrame:
    """``a, b``: pairs of distinct names of which ``a`` stands within ``b``: they meet by that substring of ``a`` of up to
    ``size`` characters that the fewest names ``b`` have. Names of which even that stands in more than ``many`` names, so that
    they would meet as a product, are sought whole."""
    n = F.least(F.length(a), F.lit(size))
    held = wide.withColumn("g", F.explode(_parts(F.col(b), _sizes(short, n))))
    counts = held.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    own = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a) - n + 1, F.lit(1))), lambda i: F.substring(F.col(a), i, n))
    each = short.select(a, F.explode(F.array_distinct(own)).alias("g"))
    rarest = _met(each, counts, "g", "left").groupBy(a).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("x")).select(a, "x.g", "x.n")
    few = _met(held, rarest.where(F.col("n").between(1, many)).drop("n"), "g").where(F.contains(b, a))
    return few.select(a, b).unionByName(_within(rarest.where(F.col("n") > many).select(a), a, wide, b).select(a, b))


def match_records(files: DataFrame, records: DataFrame, size: int = 3, many: int = 1000) -> DataFrame:
    """``file_name, id, record_name, n_matches`` for every file: active records whose bare name holds the file's, or is held by it.

    Distinct bare names are matched, then their files and records join the pairs.
    """
    f = files.select("file_name", stem(F.col("file_name")).alias("f")).where("f is not null").distinct()
    r = records.where(F.col("status") == "active").select("id", F.col("file_name").alias("record_name"), stem(F.col("file_name")).alias("r")).where("r is not null").distinct()
    of_files, of_records = f.select("f").distinct(), r.select("r").distinct()
    pairs = _held(of_records, "r", of_files, "f", size, many).unionByName(_held(of_files, "f", of_records, "r", size, many)).distinct()
    rows = _met(_met(pairs, f, "f"), r, "r").select("file_name", "id", "record_name")
    n = F.count("id").over(Window.partitionBy("file_name"))
    return _met(files.select("file_name").distinct(), rows, "file_name", "left").withColumn("n_matches", n)


def build_audit(df: DataFrame, action: str, id_col: str = "file_id", hash_col: str = "file_hash", n_col: str = "n_matches", run: str | None = None) -> DataFrame:
    """One audit row per document: ``id, timestamp, action, file_id, file_hash, details``; ids as in ``build_records``."""
    details = F.create_map(F.lit("matchCount"), F.col(n_col).cast("string"))
    return df.select(_new_id(None if run is None else f"{run}\x1f{action}", id_col, hash_col).alias("id"), F.current_timestamp().alias("timestamp"), F.lit(action).alias("action"), F.col(id_col).alias("file_id"), F.col(hash_col).alias("file_hash"), details.alias("details"))


def query_audit(log: DataFrame, file_id: object = None, action: str | None = None, limit: int = 100, tie: str = "id") -> DataFrame:
    """Newest first: of a file, else of an action, else all; at most limit rows."""
    if file_id is not None:
        log = log.where(F.col("file_id") == file_id)
    elif action is not None:
        log = log.where(F.col("action") == action)
    return log.orderBy(F.desc("timestamp"), tie).limit(limit)


def record_stats(records: DataFrame) -> DataFrame:
    """``total`` (deleted ones too), ``restored``, ``active``."""
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "restored").alias("restored"), F.count_if(F.col("status") == "active").alias("active"))


def upsert_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """``key, value, ts``: the latest value of each key."""
    order, n = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("value")), free(settings, "__n")
    return settings.unionByName(changes).withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(n)


def read_settings(settings: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """``key, value`` of every default's key, as set or by default."""
    spark = settings.sparkSession
    own = spark.createDataFrame(list(defaults.items()), "key string, default string")
    return own.join(settings.select("key", "value"), "key", "left").select("key", F.coalesce("value", "default").alias("value"))
