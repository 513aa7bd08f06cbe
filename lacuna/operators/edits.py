"""Edits of tokens in texts, paired with values by occurrence, and their spread over runs of text.

Defined cases: a null text stays null; null edits change nothing; an edit of an empty token is left out; a null value
counts as empty; tokens that don't occur change nothing, nor do values beyond a token's last occurrence; repeated rows
stay apart; other columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.redact import restored
from lacuna.operators.spans import meeting

#: White space of any script but the line end.
PADDING = "\t\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def padded(text: str, start: int, end: int) -> tuple[int, int]:
    """The place grown over the white space beside it."""
    while start and text[start - 1] in PADDING:
        start -= 1
    while end < len(text) and text[end] in PADDING:
        end += 1
    return start, end


def replaced(text: str, todo: list[tuple[int, int, str]], same: bool) -> str:
    """The text with each place (start, end, value; in order, apart) and the white space beside it replaced, the last first.

    ``same``: how far a place reaches to the right was settled before any replacement, so it may take from what the place
    behind it left. What lies behind the current place is kept in pieces, so each character is moved once.
    """
    right: list[str] = []  # the first piece last
    begin = len(text)  # where they begin in the source

    for start, end, value in reversed(todo):
        start = padded(text, start, start)[0]
        stop = len(text) if same else begin
        while end < stop and text[end] in PADDING:
            end += 1
        eaten = max(0, end - begin)
        while right and (eaten or not same and end >= begin):
            piece = right.pop()
            rest = piece[eaten:] if eaten else piece.lstrip(PADDING)
            eaten = max(0, eaten - len(piece))
            if rest:
                right.append(rest)
                break
        right += [text[end:begin], value]
        begin = start
    return text[:begin] + "".join(reversed(right))


def edited(text: str | None, edits: list[tuple[str, str]]) -> str | None:
    """Neighbouring edits of a token form a group; longer tokens go first. A group of one value replaces every occurrence,
    one of several gives the n-th occurrence the n-th value, the last first. White space beside a token goes with it, line
    ends stay. Groups of one token that other tokens of its length part are not joined."""
    if text is None:
        return None
    groups = [(t, [v or "" for _, v in g]) for t, g in groupby((e for e in edits if e[0]), key=lambda e: e[0])]
    groups.sort(key=lambda g: -len(g[0]))
    for token, parts in groupby(groups, key=lambda g: g[0]):
        values = [v for _, vs in parts for v in vs]
        found = list(re.finditer(re.escape(token), text))
        todo = [(m.start(), m.end(), v) for m, v in (((m, values[0]) for m in found) if len(values) == 1 else zip(found, values, strict=False))]
        if token.strip(PADDING) == token:
            text = replaced(text, todo, len(values) == 1)
            continue
        whole = text  # a token that ends in white space may reach into its neighbour
        for at, to, value in reversed(todo):
            start, end = padded(whole if len(values) == 1 else text, at, to)
            text = text[:start] + value + text[end:]
    return text


def apply_edits(df: DataFrame, text_col: str = "text", edits_col: str = "edits", out: str = "edited") -> DataFrame:
    """The input and ``out``; ``edits`` is ``array<struct<token, value>>``."""

    def of(texts: pd.Series, edits: pd.Series) -> pd.Series:
        return pd.Series([edited(t, [(e["token"], e["value"]) for e in (es if es is not None else ())]) for t, es in zip(texts, edits, strict=True)])

    return df.withColumn(out, F.pandas_udf(of, "string")(text_col, edits_col))


def shares(start: Column, end: Column, run_start: Column, run_end: Column, value: Column) -> Column:
    """The slice of a value that a run gets of the range [start, end)."""
    a, b = F.greatest(start, run_start) - start, F.least(end, run_end) - start
    ratio = F.length(value) / F.greatest(end - start, F.lit(1))
    s, e = F.floor(a * ratio), F.floor(b * ratio)
    e = F.when((e <= s) & (b > a), s + 1).otherwise(e)
    return F.substring(value, (s + 1).cast("int"), F.greatest(e - s, F.lit(0)).cast("int"))


def spread_over_runs(runs: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, idx, text``: runs (``idx, text, start, end``) after replacing ranges (``start, end, value``) by their values, each run taking its share of the value; the last range first."""
    cut = F.struct((-F.greatest("e.start", "start")).alias("k"), (F.greatest("e.start", "start") - F.col("start")).alias("a"), (F.least("e.end", "end") - F.col("start")).alias("b"), shares(F.col("e.start"), F.col("e.end"), F.col("start"), F.col("end"), F.col("e.value")).alias("v"))
    cuts = meeting(runs.select(key, "idx", "start", "end").distinct(), edits, key, "e").groupBy(key, "idx").agg(F.array_sort(F.collect_list(cut)).alias("cuts"))
    one = runs.select(key, "idx", "text").join(cuts, [key, "idx"], "left").withColumn("cuts", F.coalesce("cuts", F.array()))
    entries = F.transform("cuts", lambda c: F.struct(c["a"].alias("start"), c["b"].alias("end"), F.coalesce(c["v"], F.lit("")).alias("originalValue")))
    return one.select(key, "idx", restored(F.col("text"), entries).alias("text"))
