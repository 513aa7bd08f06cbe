"""Texts from files and from extracted tables (cells, page items, blocks), and names and sinks of results.

Defined cases: null cells, items and blocks hold nothing; a document without any of them has no row, or an empty text
where blank parts are listed; parts of equal place are ordered by their text; null names and types have no format; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats by MIME type, then by extension.
BY_MIME = {
    "application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx", "text/plain": "txt", "text/csv": "csv", "text/html": "html",
    "image/jpeg": "image", "image/png": "image", "image/gif": "image", "image/webp": "image", "image/bmp": "image",
}
BY_EXTENSION = {
    "pdf": "pdf", "docx": "docx", "doc": "doc", "xlsx": "xlsx", "xlsm": "xlsx", "xls": "xls", "pptx": "pptx", "txt": "txt", "csv": "csv", "html": "html",
    "htm": "html", "jpg": "image", "jpeg": "image", "png": "image", "gif": "image", "webp": "image", "bmp": "image",
}


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's name under spark.checkpoint.dir; where that is unset a temporary folder serves a local master (tests) alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` (the path), ``file_name, raw_text``: whole files, as they are; HTML keeps its tags."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("raw_text"))
    return df.withColumn("file_name", F.element_at(F.split("doc_id", "/"), -1))


def csv_display_text(raw: Column) -> Column:
    """Cells of each line parted by bars; quotes mean nothing."""
    return F.replace(raw, F.lit(","), F.lit(" | "))


def _chosen(key: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in table.items()))


def file_format(mime: Column, name: Column) -> Column:
    """The format by MIME type, else by extension; null if neither is known."""
    extension = F.element_at(F.split(F.lower(name), r"\."), -1)
    return F.coalesce(_chosen(F.lower(mime), BY_MIME), _chosen(extension, BY_EXTENSION))


def with_format(files: DataFrame, mime_col: str = "mime_type", name_col: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """Files with their format, and the rejects."""
    df = files.withColumn("format", file_format(F.col(mime_col), F.col(name_col)))
    return df.where("format is not null"), df.where("format is null").withColumn("reason", F.lit("unsupported format"))


def is_legacy_binary(content: Column) -> Column:
    """Whether bytes begin as an old compound document does."""
    return (F.length(content) >= 4) & (F.hex(F.substring(content, 1, 4)) == "D0CF11E0")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def cells_to_text(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, raw_text`` of ``sheet_idx, row, col, value``: a sheet's cells in row order by spaces, a line for each sheet."""
    own = cells.where("value is not null").groupBy(key, "sheet_idx").agg(F.array_sort(F.collect_list(F.struct("row", "col", "value"))).alias("c"))
    lines = own.select(key, "sheet_idx", F.array_join(F.transform("c", lambda x: x["value"]), " ").alias("line"))
    whole = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sheet_idx", "line"))).alias("s"))
    return whole.select(key, trimmed(F.array_join(F.transform("s", lambda x: x["line"]), "\n")).alias("raw_text"))


def items_to_text(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, raw_text`` of ``page, idx, text``: items that aren't blank, in order, by spaces."""
    own = items.where(F.length(trimmed(F.col("text"))) > 0).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "idx", "text"))).alias("i"))
    return own.select(key, trimmed(F.array_join(F.transform("i", lambda x: x["text"]), " ")).alias("raw_text"))


def blocks_to_text(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, raw_text`` of ``path, type, text, cells``: text blocks and the cells of tables that hold something, by line ends."""
    empty = lambda c: c.isNull() | (c == "") | (c == "0")
    lines = F.when(F.col("type") == "table", F.filter("cells", lambda c: ~empty(c))).when(F.col("text").isNotNull(), F.array("text")).otherwise(F.array().cast("array<string>"))
    own = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", lines.alias("lines")))).alias("b"))
    return own.select(key, F.array_join(F.flatten(F.transform("b", lambda x: x["lines"])), "\n").alias("raw_text"))


def redacted_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("_脱敏.txt"))


def restored_name(name: Column) -> Column:
    bare = F.regexp_replace(name, "_脱敏$", "")
    low = F.lower(bare)
    return (
        F.when(low.endswith(".docx"), F.regexp_replace(bare, r"(?i)\.docx$", "_restored.docx"))
        .when(low.endswith(".pdf"), F.regexp_replace(bare, r"(?i)\.pdf$", "_restored.txt"))
        .when(low.endswith(".txt") | low.endswith(".md"), bare)
        .otherwise(F.concat(bare, F.lit(".txt")))
    )


def write_documents(df: DataFrame, path: str, name_col: str = "file_name", text_col: str = "text", mode: str = "errorifexists") -> None:
    """A row for each document, as Parquet."""
    df.select(F.col(name_col).alias("file_name"), F.col(text_col).alias("text")).write.mode(mode).parquet(path)
