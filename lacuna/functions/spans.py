"""Spans of regex matches as array columns, from Spark functions alone.

A span is ``struct<s:int, e:int, v:string>``; ``s`` and ``e`` are 0-based, half-open code point offsets, so
``substring(text, s + 1, e - s) = v`` always holds.

Work and memory grow with the text, however many matches it has: one pass of the regex marks all matches, folds over
them go by chunks of ``CHUNK`` elements, and parts of a text are cut from its blocks, not from
its start.

Defined cases: null and empty texts have no spans; texts that hold the marks themselves give the same spans by a slower
way; a pattern that matches the empty string is not supported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,v:string>>"

#: Noncharacters: the end of a match, and what parts the text before it, the match and its group.
CUT, PART = "\ufdd0", "\ufdd1"
CHUNK = 64
#: Code points of a block.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """``struct<c, o>`` of a fold that emits: ``step(carry, item)`` gives the next carry and the emitted elements, an array of the type ``kind``.

    A fold copies what it carries at every step, so none carries more than a chunk's elements: one fold finds the carry
    at the start of each chunk, then each chunk emits its own.
    """

    def emit(acc: Column, x: Column) -> Column:
        c, more = step(acc["c"], x)
        return F.struct(c.alias("c"), F.concat(acc["o"], more).alias("o"))

    def whole(xs: Column) -> Column:
        n = F.size(xs)
        own = lambda at: between(xs, at, F.least(at + CHUNK, n) - 1)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        begun = F.when(n > CHUNK, F.sequence(F.lit(0), n - 1 - CHUNK, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        after = lambda acc, at: F.aggregate(own(at), F.element_at(acc, -1)["c"], lambda c, x: step(c, x)[0])
        carries = F.aggregate(begun, F.array(F.struct(carry.alias("c"))), lambda acc, at: F.concat(acc, F.array(F.struct(after(acc, at).alias("c")))))
        parts = F.zip_with(starts, carries, lambda at, c: F.aggregate(own(at), F.struct(c["c"].alias("c"), F.array().cast(kind).alias("o")), emit))
        end = lambda ps: F.when(F.size(ps) > 0, F.get(ps, F.size(ps) - 1)["c"]).otherwise(carry)
        done = lambda ps: F.struct(end(ps).alias("c"), F.flatten(F.transform(ps, lambda p: p["o"])).alias("o"))
        return F.when(n > 0, let(parts, done)).otherwise(F.struct(carry.alias("c"), F.array().cast(kind).alias("o")))

    return let(items, whole)


def between(items: Column, first: Column, last: Column) -> Column:
    """The elements first to last, 0-based; a slice would copy the whole array each time. ``items`` is a let's value."""
    return F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.get(items, i))


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, n: Column | int) -> Column:
    """``substring(text, start + 1, n)`` for a 0-based start, from the text's blocks (a let's value): costs the part and two blocks."""
    n = F.lit(n) if isinstance(n, int) else n
    first = (F.greatest(start, F.lit(0)) / BLOCK).cast("int")
    last = (F.greatest(start + n - 1, F.lit(0)) / BLOCK).cast("int")
    return F.substring(F.array_join(between(blocks, first, last), ""), start - first * BLOCK + 1, F.greatest(n, F.lit(0)))


def with_blocks(text: Column, wanted: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the text's blocks, made once; of none where not wanted."""
    return let(F.when(wanted, blocks_of(text)).otherwise(F.array().cast("array<string>")), body)


def no_spans() -> Column:
    return F.array().cast(SPAN)


def marked(text: Column, pattern: str, group: int | None = None) -> Column:
    """``array<array<string>>``: for each match the text before it, the match and its group; last, the text behind all.

    A split by a regex compiles it for every row; a replacement compiles it once, and splits at one character need none.
    """
    own = "" if group is None else f"{PART}${group}"
    pieces = F.transform(F.split(F.regexp_replace(text, pattern, f"{PART}$0{own}{CUT}"), CUT, -1), lambda x: F.split(x, PART, -1))
    full = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = full if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    slow = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("g"), full.alias("v"), groups.alias("w")), lambda z: F.when(z["v"].isNull(), F.array(z["g"])).otherwise(F.array(z["g"], z["v"], z["w"])))
    return F.when(F.contains(text, F.lit(CUT)) | F.contains(text, F.lit(PART)), slow).otherwise(pieces)


def spans_of(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """All leftmost, non-overlapping matches of a Java regex; empty for a null text.

    The pieces between the matches and the matches themselves give the offsets: a fold adds their lengths up. ``guard``
    is a cheap condition without which the regex isn't tried at all. Patterns must not match the empty string.
    """

    def step(p: Column, x: Column) -> tuple[Column, Column]:
        s, v = p + F.length(x[0]), F.get(x, F.lit(1))
        end = s + F.length(v)
        return F.coalesce(end, p), F.when(v.isNull(), no_spans()).otherwise(F.array(F.struct(s.alias("s"), end.alias("e"), v.alias("v"))))

    return _guarded(text, marked(text, pattern), step, guard)


def group_spans(text: Column, pattern: str, group: int = 1, guard: Column | None = None, ahead: bool = False) -> Column:
    """As spans_of, but the span of a group where it took part: the first place in the match where its value stands, or
    with ``ahead`` the place behind the match, for a group within a final look-ahead."""

    def step(p: Column, x: Column) -> tuple[Column, Column]:
        s, v, w = p + F.length(x[0]), F.get(x, F.lit(1)), F.get(x, F.lit(2))
        took = F.length(w) > 0
        at = s + (F.length(v) if ahead else F.when(took, F.instr(v, w) - 1).otherwise(0))
        value = F.when(took, w).otherwise(v)
        own = F.struct(at.alias("s"), (at + F.length(value)).alias("e"), value.alias("v"))
        return F.coalesce(s + F.length(v), p), F.when(v.isNull(), no_spans()).otherwise(F.array(own))

    return _guarded(text, marked(text, pattern, group), step, guard)


def _guarded(text: Column, pieces: Column, step: Callable[[Column, Column], tuple[Column, Column]], guard: Column | None) -> Column:
    # a single match, which most rows have, needs no fold
    found = let(pieces, lambda x: F.when(F.size(x) == 2, step(F.lit(0), F.get(x, F.lit(0)))[1]).when(F.size(x) > 2, scan(x, F.lit(0), step, SPAN)["o"]).otherwise(no_spans()))
    return F.coalesce(found if guard is None else F.when(guard, found), no_spans())


def overlapping_starts(text: Column, phrase: Column) -> Column:
    """0-based places of all occurrences of a literal phrase, overlapping ones too: cuts before each, added up."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    kind = "array<int>"

    def step(p: Column, piece: Column) -> tuple[Column, Column]:
        at = p + F.length(piece)
        return at, F.array(at)

    # a cut at the very start leaves no piece before it
    more = let(F.split(text, quoted, -1), lambda x: scan(F.slice(x, F.lit(1), F.size(x) - 1), F.lit(0), step, kind)["o"])
    first = F.when(F.startswith(text, phrase), F.array(F.lit(0))).otherwise(F.array().cast(kind))
    return F.when((F.length(phrase) > 0) & F.contains(text, phrase), F.concat(first, more)).otherwise(F.array().cast(kind))


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
