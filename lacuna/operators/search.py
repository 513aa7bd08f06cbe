"""Search for a keyword: case aside, overlapping hits, with their surroundings; and adding hits as manual spans.

Defined cases: null and empty texts, and keywords of one character, have no hits; null matches protect nothing; repeated
rows stay apart; other columns stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.spans import cut, free, let, overlapping_starts, with_blocks
from lacuna.operators.spans import _manual, filter_hits, override_matches

LIMIT = 500_000


def truncate_text(text: Column, limit: int = LIMIT) -> Column:
    """The first code points, up to the limit."""
    return F.substring(text, F.lit(1), F.lit(limit))


def is_truncated(text: Column, limit: int = LIMIT) -> Column:
    return F.length(text) > limit


def _side(part: Column, left: bool) -> Column:
    """30 code points of context; a full one is cut to 29 and an ellipsis."""
    cut = F.concat(F.lit("…"), F.substring(part, F.lit(2), F.lit(29))) if left else F.concat(F.substring(part, F.lit(1), F.lit(29)), F.lit("…"))
    return F.when(F.length(part) >= 30, cut).otherwise(part)


def hits(text: Column, keyword: str, limit: int | None = LIMIT) -> Column:
    """``array<struct<index, start, end, value, contextBefore, contextAfter>>`` within the first ``limit`` code points, or in the whole text; keywords of one character find nothing."""
    whole, k = F.coalesce(text, F.lit("")), len(keyword)
    t = whole if limit is None else truncate_text(whole, limit)
    low, word = F.lower(t), F.lit(keyword.lower())
    places = overlapping_starts(low, word)

    def one(b: Column, i: Column, n: Column) -> Column:
        begin = F.greatest(i - 30, F.lit(0))
        before, after = cut(b, begin, i - begin), cut(b, i + k, 30)
        return F.struct(n.alias("index"), i.alias("start"), (i + k).alias("end"), cut(b, i, k).alias("value"), _side(before, True).alias("contextBefore"), _side(after, False).alias("contextAfter"))

    none = F.array().cast("array<struct<index:int,start:int,end:int,value:string,contextBefore:string,contextAfter:string>>")
    return let(places, lambda ps: with_blocks(t, F.size(ps) > 0, lambda b: F.transform(ps, lambda i, n: one(b, i, n)))) if k >= 2 else none


def search(df: DataFrame, keyword: str, text_col: str = "text", out: str = "hits", limit: int | None = LIMIT) -> DataFrame:
    """The input and ``out``."""
    return df.withColumn(out, hits(F.col(text_col), keyword, limit))


def search_and_add(df: DataFrame, keyword: str, text_col: str = "text", matches: str = "matches") -> DataFrame:
    """Hits that no span protects become manual spans; ``n_added`` and ``n_skipped`` count them."""
    found, left = free(df, "__hits"), free(df, "__free")
    old = F.coalesce(F.col(matches), F.array().cast(df.schema[matches].dataType))
    df = search(df, keyword, text_col, found).withColumn(left, filter_hits(F.col(found), old))
    new = _manual(F.coalesce(F.col(text_col), F.lit("")), F.transform(left, lambda h: h["start"]), F.lit(len(keyword)))
    df = df.withColumns({"n_added": F.size(left).cast("long"), "n_skipped": (F.size(found) - F.size(left)).cast("long")})
    return df.withColumn(matches, override_matches(old, new)).drop(found, left)
