"""Redaction, masks and restore. Folds over a row's sorted spans, in time with the text and its result; no shuffle.

Defined cases: a null text counts as empty; null matches, and matches without a place, replace nothing; a null mapping
restores nothing, and a null redacted text stays null; repeated rows stay apart; other columns stay, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.rules import LABELS
from lacuna.functions.spans import cut, free, let, scan, with_blocks

ENTRY = "array<struct<idx:int,type:string,originalValue:string,maskedToken:string,start:int,end:int>>"
END = 2147483647

#: Masks without a part of the value.
FIXED = {"ADDRESS": "[地址]", "COMPANY": "[公司名称]", "NAME": "[姓名]", "CONTRACT_NO": "[合同号]", "PROJECT_NAME": "[项目名称]", "TAX_ID": "[税号]"}


def display_token(value: Column, idx: Column) -> Column:
    """Underscores for at most eight code points, then idx + 1 zero-width spaces."""
    return F.concat(F.repeat(F.lit("_"), F.least(F.length(value), F.lit(8))), F.repeat(F.lit("\u200b"), idx + 1))


def type_token(type_: Column, idx: Column) -> Column:
    """[TYPE_0001]; numbers of more than four digits keep all of them."""
    digits = idx.cast("string")
    return F.concat(F.lit("["), type_, F.lit("_"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits), F.lit("]"))


def partial_mask(type_: Column, value: Column) -> Column:
    """The mask of a value by its type."""
    left, right = lambda n: F.substring(value, 1, n), lambda n: F.substring(value, F.greatest(F.length(value) - n, F.lit(0)) + 1, F.lit(n))
    out = F.when(type_ == "PHONE", F.concat(left(3), F.lit("****"), right(4)))
    out = out.when(type_ == "EMAIL", F.concat(F.substring(F.substring_index(value, "@", 1), 1, 2), F.lit("***@"), F.element_at(F.concat(F.split(value, "@"), F.array(F.lit("")), F.array(F.lit(""))), 2)))
    out = out.when(type_ == "ID_CARD", F.concat(left(6), F.lit("********"), right(4))).when(type_ == "BANK_CARD", F.concat(left(4), F.lit(" **** **** "), right(4)))
    out = out.when(type_ == "IP", F.concat(F.regexp_replace(value, r"\.[^.]*$", ""), F.lit(".*.*"))).when(type_.isin("AMOUNT", "AMOUNT_UPPER"), F.lit("¥****"))
    for kind, label in LABELS.items():
        out = out.when(type_ == kind, F.lit(FIXED.get(kind, f"[{label}]")))
    return out.otherwise("[敏感信息]")


def _fold(text: Column, matches: Column, token) -> Column:
    """``struct<c<p, r>, o>`` of the cursor walk: the end of the last replaced span here and in the result, and of each one the text before it, its token and its entry; skipped spans count in idx."""
    ordered = F.transform(F.array_sort(F.transform(matches, lambda m, i: F.struct(m["start"].alias("k"), i.alias("i"), m.alias("m")))), lambda x, i: F.struct(x["m"].alias("m"), i.alias("i")))
    kind = f"array<struct<gap:string,token:string,entry:{ENTRY[6:-1]}>>"

    def step(b: Column, at: Column, x: Column) -> tuple[Column, Column]:
        m, skip = x["m"], (x["m"]["start"] < at["p"]) | (x["m"]["end"] < x["m"]["start"]) | x["m"]["start"].isNull() | x["m"]["end"].isNull()
        size = F.length(token(m, x["i"]))
        begin = at["r"] + m["start"] - at["p"]
        made = let(token(m, x["i"]), lambda new: F.struct(cut(b, at["p"], m["start"] - at["p"]).alias("gap"), new.alias("token"), F.struct(x["i"].alias("idx"), m["type"].alias("type"), m["value"].alias("originalValue"), new.alias("maskedToken"), begin.alias("start"), (begin + F.length(new)).alias("end")).alias("entry")))
        moved = F.struct(m["end"].alias("p"), (begin + size).alias("r"))
        return F.when(skip, at).otherwise(moved), F.when(skip, F.array().cast(kind)).otherwise(F.array(made))

    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("r"))
    return let(ordered, lambda ms: with_blocks(text, F.size(ms) > 0, lambda b: scan(ms, start, lambda at, x: step(b, at, x), kind)))


def redact(df: DataFrame, text_col: str = "text", matches: str = "matches", token=None) -> DataFrame:
    """The input, ``redacted_text`` and ``mapping`` (places in the redacted text). ``token(match, idx)`` gives the
    replacement; that of its own accord grows with idx, so texts with very many spans want another (``redact_typed``)."""
    own = token or (lambda m, i: display_token(m["value"], i))
    full = lambda m, i: F.coalesce(own(m, i), F.lit(""))
    t, walk = F.coalesce(F.col(text_col), F.lit("")), free(df, "__walk")
    # rows without matches, null arrays too, keep their text
    listed = F.filter(F.coalesce(F.col(matches), F.array()), lambda m: m.isNotNull())
    df = df.withColumn(walk, _fold(t, listed, full))
    head = F.array_join(F.transform(F.col(f"{walk}.o"), lambda x: F.concat(x["gap"], x["token"])), "")
    rest = F.substring(t, F.col(f"{walk}.c.p") + 1, F.lit(END))
    return df.withColumns({"redacted_text": F.concat(head, rest), "mapping": F.transform(F.col(f"{walk}.o"), lambda x: x["entry"])}).drop(walk)


def redact_typed(df: DataFrame, **options: str) -> DataFrame:
    """Redaction by [TYPE_0001] tokens."""
    return redact(df, token=lambda m, i: type_token(m["type"], i + 1), **options)


def redact_masked(df: DataFrame, **options: str) -> DataFrame:
    """Redaction by partial masks."""
    return redact(df, token=lambda m, i: partial_mask(m["type"], m["value"]), **options)


def redact_same_length(df: DataFrame, **options: str) -> DataFrame:
    """Underscores of each value's own length, so places stay as they are."""
    return redact(df, token=lambda m, i: F.repeat(F.lit("_"), F.length(m["value"])), **options)


def restored(text: Column, mapping: Column) -> Column:
    """The original text: entries by start descending put back by place alone; bad places, and entries without a place or
    a value, are skipped. A null mapping restores nothing.

    Entries that lie apart, as redaction makes them, are put back in one walk; others one by one, each on the text that
    the ones before left.
    """

    def key(x: Column) -> Column:
        return F.struct((-x["start"].cast("double")).alias("k"), x["start"].cast("double").alias("s"), x["end"].cast("double").alias("e"), x["originalValue"].alias("v"))

    def step(acc: Column, x: Column) -> Column:
        bad = F.isnan(x["s"]) | F.isnan(x["e"]) | (x["s"] < 0) | (x["e"] > F.length(acc)) | (x["s"] > x["e"])
        whole = F.concat(F.substring(acc, F.lit(1), x["s"].cast("int")), x["v"], F.substring(acc, x["e"].cast("int") + 1, F.lit(END)))
        return F.when(bad, acc).otherwise(whole)

    def good(n: Column, acc: Column, x: Column) -> Column:
        """The start of the last entry if all so far lie apart, else null."""
        fine = ~F.isnan(x["s"]) & ~F.isnan(x["e"]) & (x["s"] >= 0) & (x["s"] <= x["e"]) & (x["e"] <= F.least(acc, n)) & (F.floor(x["s"]) < acc)
        return F.when(fine, F.floor(x["s"]).cast("double"))

    def put(b: Column, p: Column, x: Column) -> tuple[Column, Column]:
        s = x["s"].cast("int")
        return x["e"].cast("int"), F.array(cut(b, p, s - p), x["v"])

    def walked(b: Column, xs: Column) -> Column:
        whole = scan(F.reverse(xs), F.lit(0), lambda p, x: put(b, p, x), "array<string>")
        return let(whole, lambda w: F.concat(F.array_join(w["o"], ""), F.substring(text, w["c"] + 1, F.lit(END))))

    def of(xs: Column) -> Column:
        # the last entry may end where the text does, even if it is empty
        apart = let(F.length(text).cast("double"), lambda n: F.aggregate(xs, n + 0.5, lambda acc, x: good(n, acc, x))).isNotNull()
        return F.when(apart, with_blocks(text, F.size(xs) > 0, lambda b: walked(b, xs))).otherwise(F.aggregate(xs, text, step))

    listed = F.filter(F.coalesce(mapping, F.array()), lambda x: x["start"].isNotNull() & x["end"].isNotNull() & x["originalValue"].isNotNull())
    return let(F.array_sort(F.transform(listed, key)), of)


def restore(df: DataFrame, text_col: str = "redacted_text", mapping: str = "mapping", out: str = "restored_text") -> DataFrame:
    return df.withColumn(out, restored(F.col(text_col), F.col(mapping)))


def round_trip(df: DataFrame, text_col: str = "text", out: str = "round_trip_ok") -> DataFrame:
    """The input and ``out``: whether the restored text is the source, and no original stands at its place in the redacted text."""
    red, entries = F.col("redacted_text"), F.coalesce(F.col("mapping"), F.array())
    kept = with_blocks(red, F.size(entries) > 0, lambda b: F.exists(entries, lambda x: F.coalesce(cut(b, x["start"], x["end"] - x["start"]) == x["originalValue"], F.lit(False))))
    same = restored(red, F.col("mapping")) == F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn(out, same & ~kept)


def verify_round_trip(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows that fail the round trip."""
    ok = free(df, "__ok")
    return round_trip(df, text_col, ok).where(~F.col(ok)).drop(ok)


def replace_range(text: Column, start: Column, end: Column, replacement: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), replacement, F.substring(text, end + 1, F.lit(END)))


def replace_all(text: Column, search: Column, replacement: Column) -> Column:
    return F.when(search == "", text).otherwise(F.replace(text, search, replacement))


def content_hash(column: Column) -> Column:
    """SHA-256 in hexadecimal."""
    return F.sha2(column, 256)
