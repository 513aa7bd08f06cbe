"""Algebra of spans: selections, manual spans, override and protection, unions, parts, segments, slices, runs.

Joins of intervals go by document and by stretches of ``BIN`` code points, so that a document with very many spans is
dealt out too, and no more pairs are compared than stand near each other.

Defined cases: spans of a null document meet no others; empty spans overlap what they lie within; equal spans are kept
as often as they occur, but a protected or overridden one goes wholly; null texts count as empty; other columns of the
spans stay; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.rules import NOT_S
from lacuna.functions.spans import between, cut, free, let, overlapping_starts, scan, spans_of, with_blocks
from lacuna.operators.detect import context, literal
from lacuna.operators.stretches import running

PAD = f"[{NOT_S}&&[^\\n]]"


def select_matches(exploded: DataFrame, chosen: DataFrame, keys: tuple[str, ...] = ("doc_id", "start", "end"), invert: bool = False) -> DataFrame:
    """Rows of spans that are chosen, or that are not."""
    return exploded.join(chosen.select(*keys).distinct(), list(keys), "left_anti" if invert else "left_semi")


def remove_matches(exploded: DataFrame, removed: DataFrame, keys: tuple[str, ...] = ("doc_id", "start", "end")) -> DataFrame:
    return select_matches(exploded, removed, keys, invert=True)


def of_types(matches: Column, *types: str) -> Column:
    return F.filter(matches, lambda m: m["type"].isin(*types))


def _manual(text: Column, places: Column, size: Column) -> Column:
    def one(i: Column, n: Column) -> Column:
        return F.struct(F.lit("CUSTOM").alias("type"), F.substring(text, i + 1, size).alias("value"), i.alias("start"), (i + size).alias("end"), F.lit(1.0).alias("confidence"), context(text, i, 30).alias("context"), F.lit(0).alias("rule_idx"), n.alias("seq"))

    return F.transform(places, one)


def manual_matches(df: DataFrame, phrase_col: str, positions_col: str | None = None, text_col: str = "text") -> DataFrame:
    """The input, ``manual`` (spans of type CUSTOM) and ``found``: at given places, or at all occurrences of the phrase."""
    t, p = F.coalesce(F.col(text_col), F.lit("")), F.col(phrase_col)
    if positions_col:
        places = F.filter(positions_col, lambda i: (i >= 0) & (i + F.length(p) <= F.length(t)))
    else:
        places = overlapping_starts(t, p)
    return df.withColumn("manual", _manual(t, places, F.length(p))).withColumn("found", F.size("manual") > 0)


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, in their order; null others are none.

    One sweep over both: others by their starts, spans by their ends, and the furthest end of the others that start
    before a span's end is carried along. Both arrays are made once, however the caller makes them.
    """

    def swept(xs: Column, ys: Column) -> Column:
        event = lambda at, kind, i, edge: F.struct(at.alias("at"), F.lit(kind).alias("kind"), i.alias("i"), edge.alias("edge"))
        ends = F.transform(xs, lambda x, i: event(x["end"], 0, i, x["start"]))  # before an other that starts there: touching is no overlap
        starts = F.transform(F.filter(ys, lambda y: y["start"].isNotNull() & y["end"].isNotNull()), lambda y: event(y["start"], 1, F.lit(0), y["end"]))

        def step(reach: Column, e: Column) -> tuple[Column, Column]:
            free = (e["kind"] == 0) & F.coalesce(e["edge"] >= reach, F.lit(True))
            return F.when(e["kind"] == 1, F.greatest(reach, e["edge"])).otherwise(reach), F.when(free, F.array(e["i"])).otherwise(F.array().cast("array<int>"))

        kept = let(F.array_sort(F.concat(ends, starts)), lambda es: scan(es, F.lit(None).cast("int"), step, "array<int>")["o"])
        return let(F.array_sort(kept), lambda own: F.transform(own, lambda i: F.get(xs, i)))

    return let(spans, lambda xs: let(others, lambda ys: F.when(F.coalesce(F.size(ys), F.lit(0)) <= 0, xs).otherwise(swept(xs, ys))))


def override_matches(old: Column, new: Column) -> Column:
    """New spans win: old ones that overlap any go, new ones are added; by start."""

    def of(added: Column) -> Column:
        keyed = F.transform(F.concat(clear_of(old, added), added), lambda m, i: F.struct(m["start"].alias("k"), i.alias("i"), m.alias("m")))
        return F.transform(F.array_sort(keyed), lambda x: x["m"])

    return let(new, of)


def filter_hits(hits: Column, existing: Column) -> Column:
    """Hits that overlap no existing span; touching is no overlap."""
    return clear_of(hits, existing)


#: Code points of a stretch of a document, by which intervals meet.
BIN = 4096


def in_bins(spans: DataFrame, name: str, start: str = "start", end: str = "end") -> DataFrame:
    """Each span in every stretch that it touches."""
    return spans.withColumn(name, F.explode(F.sequence(F.expr(f"`{start}` div {BIN}"), F.expr(f"greatest(`{start}`, `{end}` - 1) div {BIN}"))))


def meeting(a: DataFrame, b: DataFrame, key: str, other: str) -> DataFrame:
    """The columns of ``a`` and, as a struct ``other``, those of ``b``: each pair of spans of a document that overlap, once."""
    one = in_bins(a, "__bin")
    two = in_bins(b.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.struct(*b.columns).alias(other)), "__part", "__s", "__e")
    both = (F.col(key) == F.col("__k")) & (F.col("__bin") == F.col("__part")) & (F.col("start") < F.col("__e")) & (F.col("end") > F.col("__s"))
    first = F.col("__bin") == F.expr(f"greatest(start, __s) div {BIN}")  # of the stretches that both touch
    return one.join(two, both & first).drop("__bin", "__part", "__k", "__s", "__e")


def _clear_of(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The spans of ``a`` that overlap none of ``b``: an interval anti join."""
    part = free(a, "__bin")
    other = in_bins(b.select(F.col(key).alias("k"), "start", "end"), "bin").select("k", "bin", F.col("start").alias("s"), F.col("end").alias("e"))
    hit = in_bins(a.select(key, "start", "end").distinct(), part).join(other, (F.col(key) == F.col("k")) & (F.col(part) == F.col("bin")) & (F.col("start") < F.col("e")) & (F.col("end") > F.col("s")), "left_semi")
    taken = hit.select(key, "start", "end").distinct()
    return a.join(taken, [key, "start", "end"], "left_anti").select(*a.columns)


def override_rows(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Row form of override: old spans that overlap no new one, and the new ones."""
    return _clear_of(old, new, key).unionByName(new)


def protect_rows(hits: DataFrame, existing: DataFrame, key: str = "doc_id") -> DataFrame:
    """Row form of protection."""
    return _clear_of(hits, existing, key)


def group_hits(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, value, positions, n``: hits by their value as it stands."""
    return hits.groupBy(key, "value").agg(F.sort_array(F.collect_list("start")).alias("positions"), F.count(F.lit(1)).alias("n"))


def merge_intervals(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, end``: touching or overlapping spans become one."""
    reach, first, later, island = (free(spans, c) for c in ("__reach", "__first", "__later", "__island"))
    own = running(spans.select(key, "start", "end"), key, ["start", "end"], {reach: ("max", F.col("end"))})
    begun = own.withColumn(first, F.when(F.col(reach).isNull() | (F.col("start") > F.col(reach)), F.col("start")))
    # of equal spans the one that begins a union goes first, however they come here
    numbered = running(begun.withColumn(later, F.col(first).isNull()), key, ["start", "end", later], {island: ("max", F.col(first))}, inclusive=True)
    return numbered.groupBy(key, island).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop(island)


def check_integrity(df: DataFrame, text_col: str = "text", matches: str = "matches", id_col: str = "doc_id") -> DataFrame:
    """Spans whose slice of the text is not their value."""
    one = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.explode_outer(matches).alias("m")).where("m is not null")
    bad = (F.substring("t", F.col("m.start") + 1, F.length("m.value")) != F.col("m.value")) | (F.col("m.end") - F.col("m.start") != F.length("m.value"))
    return one.where(bad).select(id_col, "m.*")


PART = "array<struct<kind:string,text:string,type:string,start:int,end:int>>"


def highlight_parts(text: Column, matches: Column, selected: Column | None = None, original: bool = True) -> Column:
    """Ordered parts of text and matches that make up the text; ``selected(match)`` tells which matches show, the others are text. Masked, a match is no-break spaces of its length."""

    part = lambda kind, value, type_, s, e: F.struct(F.lit(kind).alias("kind"), value.alias("text"), type_.alias("type"), s.alias("start"), e.alias("end"))
    none, nothing = F.array().cast(PART), F.lit(None).cast("string")

    def step(b: Column, p: Column, m: Column) -> tuple[Column, Column]:
        plain = cut(b, m["start"], m["end"] - m["start"])
        shown = plain if original else F.repeat(F.lit("\u00a0"), m["end"] - m["start"])
        before = F.when(m["start"] > p, F.array(part("text", cut(b, p, m["start"] - p), nothing, p, m["start"]))).otherwise(none)
        on = selected(m) if selected is not None else F.lit(True)
        own = F.when(on, part("match", shown, m["type"], m["start"], m["end"])).otherwise(part("text", plain, nothing, m["start"], m["end"]))
        skip = m["start"] < p
        return F.when(skip, p).otherwise(m["end"]), F.when(skip, none).otherwise(F.concat(before, F.array(own)))

    def last(w: Column) -> Column:
        rest = F.substring(text, w["c"] + 1, F.lit(2147483647))
        return F.when(F.length(rest) > 0, F.concat(w["o"], F.array(part("text", rest, nothing, w["c"], F.length(text))))).otherwise(w["o"])

    ordered = F.transform(F.array_sort(F.transform(matches, lambda m, i: F.struct(m["start"].alias("k"), i.alias("i"), m.alias("m")))), lambda x: x["m"])
    return let(ordered, lambda ms: with_blocks(text, F.size(ms) > 0, lambda b: let(scan(ms, F.lit(0), lambda p, m: step(b, p, m), PART), last)))


def segment_text(text: Column, matches: Column, cuts: Column) -> Column:
    """``array<struct<start, end, text, matches>>``: the text cut at valid places; spans go by their start, with places of the segment, ends clipped.

    One walk over cuts and starts in order gives each span its segment; then each segment takes its own spans, in the
    order they had. Both arrays are made once.
    """
    number = "struct<k:int,i:int>"

    def dealt(n: Column, ms: Column, bounds: Column) -> Column:
        """By segment: its mark (i = -1), then the numbers of its spans."""
        event = lambda at, kind, i: F.struct(at.cast("int").alias("at"), F.lit(kind).alias("kind"), i.cast("int").alias("i"))
        inside = F.filter(F.transform(ms, lambda m, i: event(m["start"], 1, i)), lambda e: (e["at"] >= 0) & (e["at"] < n))
        marks = F.transform(bounds, lambda c: event(c, 0, F.lit(-1)))

        def step(k: Column, e: Column) -> tuple[Column, Column]:
            now = F.when(e["kind"] == 0, k + 1).otherwise(k)
            return now, F.array(F.struct(now.alias("k"), e["i"].alias("i")))

        return F.array_sort(let(F.array_sort(F.concat(marks, inside)), lambda es: scan(es, F.lit(-1), step, f"array<{number}>")["o"]))

    def cut_up(b: Column, n: Column, ms: Column, bounds: Column, order: Column) -> Column:
        at = F.filter(F.transform(order, lambda x, j: F.when(x["i"] < 0, j)), lambda j: j.isNotNull())

        def one(k: Column, at: Column) -> Column:
            start, end = F.get(bounds, k), F.coalesce(F.get(bounds, k + 1), n)
            first, last = F.get(at, k) + 1, F.coalesce(F.get(at, k + 1), F.size(order)) - 1

            def moved(x: Column) -> Column:
                return let(F.get(ms, x["i"]), lambda m: F.struct(m["type"].alias("type"), m["value"].alias("value"), (m["start"] - start).alias("start"), (F.least(m["end"], end) - start).alias("end")))

            own = F.transform(F.when(first <= last, between(order, first, last)).otherwise(F.array().cast(f"array<{number}>")), moved)
            return F.struct(start.alias("start"), end.alias("end"), cut(b, start, end - start).alias("text"), own.alias("matches"))

        return let(at, lambda places: F.transform(F.sequence(F.lit(0), F.size(bounds) - 1), lambda k: one(k, places)))

    def of(t: Column, ms: Column) -> Column:
        n = F.length(t)
        good = F.filter(cuts, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (c.cast("double") > 0) & (c.cast("double") < n))
        inner = F.array_sort(F.array_distinct(F.transform(good, lambda c: F.floor(c.cast("double")).cast("int"))))
        bounds = F.concat(F.array(F.lit(0)), F.filter(inner, lambda c: (c > 0) & (c < n)))
        return let(bounds, lambda bs: let(dealt(n, ms, bs), lambda order: with_blocks(t, F.lit(True), lambda b: cut_up(b, n, ms, bs, order))))

    return let(text, lambda t: let(matches, lambda ms: of(t, ms)))


def slice_parts(parts: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, part_idx, hit, start, end``: parts cut by the hits that overlap them; a hit over several parts gives a slice in each; what no hit covers keeps hit null."""
    own = [key, "part_idx", "start", "end"]
    parts = parts.select(*own)
    cuts = meeting(parts.distinct(), hits, key, "h").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct(F.greatest("h.start", "start").alias("s"), F.least("h.end", "end").alias("e"), F.col("h.index").alias("h")))).alias("hits"))
    one = parts.join(cuts, own, "left").withColumn("hits", F.coalesce("hits", F.array()))

    kind = "array<struct<h:int,s:int,e:int>>"
    piece = lambda h, s, e: F.array(F.struct(h.cast("int").alias("h"), s.cast("int").alias("s"), e.cast("int").alias("e")))
    none, null = F.array().cast(kind), F.lit(None)

    def step(p: Column, h: Column) -> tuple[Column, Column]:
        s = F.greatest(h["s"].cast("int"), p)
        gap = F.when(s > p, piece(null, p, s)).otherwise(none)
        return F.greatest(h["e"].cast("int"), p), F.when(h["e"] <= s, none).otherwise(F.concat(gap, piece(h["h"], s, h["e"])))

    walked = scan(F.col("hits"), F.col("start").cast("int"), step, kind)
    whole = let(walked, lambda w: F.when(w["c"] < F.col("end"), F.concat(w["o"], piece(null, w["c"], F.col("end")))).otherwise(w["o"]))
    return one.select(key, "part_idx", F.explode(whole).alias("x")).select(key, "part_idx", F.col("x.h").alias("hit"), F.col("x.s").alias("start"), F.col("x.e").alias("end"))


def runs_with_offsets(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each run's place in the document's text; ``idx`` is a whole number."""
    before = free(runs, "__before")
    own = running(runs, key, ["idx"], {before: ("sum", F.length("text").cast("long"))})
    own = own.withColumn("start", F.coalesce(before, F.lit(0)).cast("int")).drop(before)
    return own.withColumn("end", F.col("start") + F.length("text"))


def locate_token(runs: DataFrame, token: str, key: str = "doc_id") -> DataFrame:
    """``key, start, run_idx``: occurrences of a token in the runs' text, and the run that covers each; null if it takes several."""
    placed = runs_with_offsets(runs, key)
    whole = placed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "").alias("t"))
    found = whole.select(key, F.explode_outer(spans_of(F.col("t"), literal(token), F.col("t").contains(token))).alias("x")).where("x is not null").select(key, F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    hit = meeting(found.select(key, F.col("s").alias("start"), F.col("e").alias("end")), placed, key, "r")
    return hit.groupBy(key, "start").agg(F.when(F.count(F.lit(1)) == 1, F.min("r.idx")).alias("run_idx"))


def expand_over_padding(text: Column, start: Column, end: Column) -> Column:
    """``struct<start, end>`` grown over neighbouring white space of any kind except line ends."""
    left = F.length(F.regexp_extract(F.substring(text, F.lit(1), start), f"({PAD}*)$", 1))
    right = F.length(F.regexp_extract(F.substring(text, end + 1, F.lit(2147483647)), f"^({PAD}*)", 1))
    return F.struct((start - left).alias("start"), (end + right).alias("end"))


