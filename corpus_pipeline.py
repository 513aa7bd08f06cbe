"""From raw documents to sampled pieces: five stages, each a job of its own that keeps whole texts.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as the next one's
``docs``. All but the last return the columns of ``documents``: ``doc_id, text, lang, source, n_chars``.

Defined cases: null and empty texts have no language and go in the first stage; rows are judged by their own texts, so those that
share an id, or have none, stay or go each for itself; of equal rows one stays; empty tables give no rows; other columns
are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import decontaminate, language_crf, pieces, pii, simhash
from lacuna.llm.common import clear, crc_of, mark, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The public vocabulary's file.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Below this share of a text's words its best language is no decision.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a clear language; ``lang`` becomes the predicted one."""
    model = language_crf.fit(docs.where(crc_of(F.col("doc_id")) % 5 != 0))
    out = language_crf.predict(docs, model, keep=("text", "source", "n_chars"))
    out = out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return out.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that with the least id; a row without an id only where none has one."""
    stay = simhash.representatives(docs).select(F.col("doc_id").alias("id"), F.col("h").alias("own"))
    rows = docs.select(*COLUMNS).withColumn("h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = rows.join(stay, (F.col("h") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "h"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that hold an item of the benchmark; a text is judged by itself, whatever its id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(*COLUMNS).withColumn("h", key)
    bad = decontaminate.decontaminate(rows, items, id_col="h").where("contaminated").select(F.col("doc_id").alias("h")).distinct()
    return rows.join(bad, "h", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows."""
    out = pii.redact_documents(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, ids, n_pieces``: the sampled segmentation of each text, and whether decoding gives the text back."""
    both = pieces.encode(docs, VOCABULARY, keep=("lang", "source"), decoded=True)
    return both.select(F.col("key").alias("doc_id"), "lang", "source", "ids", F.size("ids").cast("long").alias("n_pieces"), (F.col("decoded") == F.col("text")).alias("lossless"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sampled_pieces", sampled_pieces),
]

#: SQL can't express these stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    df, begin = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES:
        df = written(stage(spark, df, sf_dir), name)
        clear(spark, begin)  # all that the stages wrote, but for the result
    return df
