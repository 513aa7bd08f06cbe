"""Occurrences of keyword lists of any length: an automaton reads each text once for all of them.

A keyword's occurrences don't overlap each other and go from left to right; those of different keywords may overlap.
Lists come from Python or from a table. One automaton holds at most ``BLOCK`` code points of keywords; that block alone
is collected and broadcast. A longer list makes several, each with its own pass, so no broadcast grows with the list.

Defined cases: null and empty texts, and empty lists, have no hits; null and blank keywords are left out, a keyword given
twice counts at its first place; texts are read whole; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.spans import free

HIT = "array<struct<s:int,e:int,v:string,i:int,q:int>>"
FIELDS = [pa.field("s", pa.int32()), pa.field("e", pa.int32()), pa.field("v", pa.string()), pa.field("i", pa.int32()), pa.field("q", pa.int32())]
LINES = [pa.field("term", pa.string()), pa.field("n", pa.int32())]
#: Code points of keywords in one automaton, some 50 bytes of memory each at most.
BLOCK = 4_000_000

_given: dict[str, Broadcast] = {}


@lru_cache(maxsize=2)  # a worker builds each once and keeps the last ones
def automaton(key: str) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for index, word in _given[key].value:
        out.add_word(word, (index, word))
    out.make_automaton()
    return out


def occurrences(words: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str, int, int]]:
    """``(start, end, keyword, its index, number among its own)`` by end; of a keyword's overlapping ones the left stays."""
    out, last = [], {}
    for at, (index, word) in words.iter(text):
        start, (end, n) = at + 1 - len(word), last.get(word, (0, 0))
        if start >= end:
            out.append((start, at + 1, word, index, n))
            last[word] = (at + 1, n + 1)
    return out


def lines_of(words: ahocorasick.Automaton, text: str) -> list[tuple[str, int]]:
    """Each keyword of the text, and on how many of its lines it stands."""
    ends = [m.start() for m in re.finditer("\n", text)]
    lines: dict[str, set[int]] = {}
    for at, (_, word) in words.iter(text):
        if "\n" not in word:
            lines.setdefault(word, set()).add(bisect_left(ends, at))
    return [(w, len(n)) for w, n in lines.items()]


def blocks(spark: SparkSession, keywords: Sequence[str] | DataFrame, blank: bool = False) -> list[list[tuple[int, str]]]:
    """(index, keyword) lists of at most some BLOCK code points. A table has the columns ``keyword`` and ``idx``, their order (several may share one); only a block at a time is made of it; its blank keywords count if ``blank``."""
    if not isinstance(keywords, DataFrame):
        out, size = [[]], 0
        for i, k in enumerate(dict.fromkeys(k for k in keywords if k and k.strip())):
            if size > BLOCK:
                out, size = [*out, []], 0
            out[-1].append((i, k))
            size += len(k)
        return [x for x in out if x]
    word = F.col("keyword").cast("string")
    own = keywords.where(F.length(word if blank else F.trim(word)) > 0).groupBy(word.alias("keyword")).agg(F.min(F.col("idx").cast("int")).alias("idx"))
    n = -(-(own.agg(F.sum(F.length("keyword"))).first()[0] or 0) // BLOCK)
    parts = (own.where(F.pmod(F.xxhash64("keyword"), F.lit(n)) == k) for k in range(n))
    return [x for x in ([(r["idx"], r["keyword"]) for r in p.collect()] for p in parts) if x]


def hits(spark: SparkSession, text: Column, keywords: Sequence[str] | DataFrame) -> list[Column]:
    """For each block of the keywords a column of type HIT."""
    return [_hits(spark.sparkContext.broadcast(b), uuid.uuid4().hex)(text) for b in blocks(spark, keywords)]


def lines_with(spark: SparkSession, text: Column, keywords: DataFrame) -> list[Column]:
    """For each block of the keywords ``array<struct<term, n>>``: those that a text holds, and on how many of its lines. Keywords over several lines are on none."""
    return [_lines(spark.sparkContext.broadcast(b), uuid.uuid4().hex)(text) for b in blocks(spark, keywords, blank=True)]


def counted(texts: pa.Array, shared: Broadcast, key: str) -> pa.Array:
    _given.setdefault(key, shared)
    words, ends, rows = automaton(key), [0], []
    for text in texts:
        rows += lines_of(words, text.as_py() or "")
        ends.append(len(rows))
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 2, LINES, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=LINES))


def _lines(shared: Broadcast, key: str):
    def of(texts):
        return counted(texts, shared, key)

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "array<struct<term:string,n:int>>")


def found(texts: pa.Array, shared: Broadcast, key: str) -> pa.Array:
    """The hits of a batch of texts."""
    _given.setdefault(key, shared)
    words, ends, rows = automaton(key), [0], []
    for text in texts:
        rows += occurrences(words, text.as_py() or "")
        ends.append(len(rows))
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, FIELDS, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=FIELDS))


def _hits(shared: Broadcast, key: str):
    def of(texts):
        return found(texts, shared, key)

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, HIT)


def keyword_matches(df: DataFrame, keywords: Sequence[str] | DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keyword, idx, start, end``: a row for each occurrence, before overlaps of different keywords are resolved."""
    columns = hits(df.sparkSession, F.col(text_col).cast("string"), keywords)
    if not columns:
        return df.select(id_col, F.lit("").alias("keyword"), F.lit(0).alias("idx"), F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    name = free(df, "__hits")
    out = None
    for c in columns:
        one = df.select(id_col, c.alias(name)).select(id_col, F.explode_outer(name).alias("x")).where("x is not null").select(id_col, F.col("x.v").alias("keyword"), F.col("x.i").alias("idx"), F.col("x.s").alias("start"), F.col("x.e").alias("end"))
        out = one if out is None else out.unionByName(one)
    return out
