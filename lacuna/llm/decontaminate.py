"""Benchmark decontamination by template canonicalisation.

Words lose their case and outer punctuation. Numbers, quantities, units and names (capitalised words inside a sentence)
become typed placeholders: the template. Every window of ``width`` words of a benchmark item has a 64-bit key of its words and,
where it holds a placeholder, one of its template; where a capitalised word opens a sentence, one more with it as a name. Texts are scanned for these keys, the hits hash-joined to the
items' windows, and each alignment of a text with an item checked for slot consistency: equal values of the item must
stand against equal values of the text, else the windows of its template go, and those of equal words stay. A text is contaminated by an item if the rest covers at
least ``coverage`` of the item's windows; so re-parameterised questions are caught, and loose likeness is not.

The keys of the benchmark are broadcast in blocks of at most ``block_keys``, each a pass over the texts (which are then
written first, so that all passes see the same rows); one block holds a benchmark of millions of words. Items of one form
(the same words and placeholders, and equal values in the same places) are one class, known by its least id
(``item_classes`` lists the members): a text meets a template once, however many items are made from it. Windows as they
stand in any member count for the class. Hits, which are few, are written to the shared folder; a text's repeats of a window count once, and meet each
window's items as one list.

Defined cases: null texts have no words and null items never match; an item of fewer than ``width`` words matches where
all its words follow each other, one of a single word where a text has no other; windows with fewer than two plain words
count only for an item that has no others, and match as they stand; ids may be of any type that has an order; items that
share an id count apart and give it once; repeated rows and ids of texts stay apart; empty tables give no rows or clean
texts; other columns are ignored; null item ids are left out of the lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import keyed, pieces, written

#: Fixed values.
UNITS = ("mm", "cm", "m", "km", "g", "kg", "mg", "l", "ml", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "miles", "feet", "inches", "pounds", "ounces", "meters", "metres", "kilometers", "kilograms", "grams", "liters", "litres", "dollars", "cents", "euros", "percent", "degrees", "usd", "eur", "mph")
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million")
SPELLED = rf"^(?:{'|'.join(NUMBERS)})(?:-(?:and-)?(?:{'|'.join(NUMBERS)}))*$"
OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"
NUM, QTY, UNIT, NAME = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
STEP = np.uint64(0x9E3779B97F4A7C15)


def canonical(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Of all words in order: the text's row, the plain word's hash, the template's hash, whether it is a slot, whether it may be a name that opens a sentence; and the words (lower case, bare)."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
    coded = flat.dictionary_encode()
    raw, place = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    bare = pc.utf8_trim(raw, OUTER)
    low = pc.utf8_lower(bare)
    plain = pd.util.hash_array(low.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(low) else np.zeros(0, np.uint64)
    flag = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    template, slot = plain.copy(), np.zeros(len(plain), bool)
    number = flag(pc.or_(pc.match_substring_regex(bare, r"^\d[\d.,/:]*$"), pc.match_substring_regex(low, SPELLED)))
    quantity = flag(pc.match_substring_regex(bare, r"^\d[\d.,]*[A-Za-z]{1,3}$"))
    for mark, rows in ((NUM, number), (QTY, quantity), (UNIT, flag(pc.is_in(low, pa.array(UNITS, low.type))))):
        template[rows], slot = mark, slot | rows
    capital = flag(pc.match_substring_regex(bare, r"^(?:\p{L}{1,2}['’])?\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)*(?:-\p{Lu}\p{Ll}+)*(?:['’]\p{Ll}*)?$")) & ~slot
    upper = flag(pc.match_substring_regex(bare, r"^\p{Lu}[\p{Lu}'’-]*\p{Lu}(?:['’]s)?$")) & ~slot
    ends = flag(pc.match_substring_regex(raw, r"""[.!?:]["')\]]*$"""))
    first = np.ones(len(place), bool)
    if len(place):
        first[1:] = (owner[1:] != owner[:-1]) | ends[place[:-1]]
    loud = upper[place]  # a word in capitals is a name where its neighbours aren't in capitals
    beside = np.zeros(len(place), bool)
    if len(place):
        same = (owner[1:] == owner[:-1]) & loud[1:] & loud[:-1]
        beside[1:] |= same
        beside[:-1] |= same
    maybe = capital[place] | (loud & ~beside)
    named, opens = maybe & ~first, maybe & first
    keep = flag(pc.greater(pc.binary_length(bare), 0))[place] if len(place) else np.zeros(0, bool)
    place, named, opens = place[keep], named[keep], opens[keep]
    return owner[keep], plain[place], np.where(named, NAME, template[place]), slot[place] | named, opens, pa.DictionaryArray.from_arrays(pa.array(place), low)


def windows(owner: np.ndarray, tokens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and key of each window of width tokens of one text."""
    n = max(0, len(tokens) - width + 1)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = key * STEP + (tokens[k : k + n] ^ (tokens[k : k + n] >> np.uint64(31)))
    start = np.nonzero(owner[:n] == owner[width - 1 : width - 1 + n])[0]
    return start, key[start] ^ (key[start] >> np.uint64(29))


class Wanted(NamedTuple):
    """Sorted keys of the benchmark: of windows, with a sieve before them, and of whole short items by their number of words."""

    keys: np.ndarray
    sieve: np.ndarray
    short: dict[int, np.ndarray]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def window_rows(texts: pa.Array, width: int, wanted: Wanted | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, np.ndarray, np.ndarray]:
    """Row, position, key, slot values, number of words, and whether it counts, of windows: all of items, by each kind of key, or those of texts with a wanted key."""
    owner, plain, template, slot, opens, words = canonical(texts)
    begin, sizes = np.searchsorted(owner, np.arange(len(texts))), np.bincount(owner, minlength=len(texts))
    starts, keys = windows(owner, plain, width)
    held = lambda x: np.convolve(x.astype(np.int32), np.ones(width, np.int32), "valid")[starts] if len(starts) else np.zeros(0, np.int32)
    slots, opening, wide = held(slot), held(opens), slot | opens
    other = windows(owner, template, width)[1] ^ np.uint64(1)
    opened = windows(owner, np.where(opens, NAME, template), width)[1] ^ np.uint64(2)
    usable = slots <= width - 2
    kinds = ((keys, np.ones(len(keys), bool), None), (other, usable & (slots > 0), slot), (opened, (slots + opening <= width - 2) & (opening > 0), wide))
    found = []  # arrays of start, key, kind, words, whether it counts
    for kind, (values, ok, _) in enumerate(kinds):
        at = np.nonzero(ok if wanted is None else ok & wanted.sieve[(values >> np.uint64(42)).astype(np.int64)])[0]
        at = at if wanted is None else at[among(values[at], wanted.keys)]
        found.append((starts[at], values[at], np.full(len(at), kind), np.full(len(at), width), usable[at]))
    for n in range(1, width) if wanted is None else wanted.short:
        own, values = windows(owner, plain, n)
        whole = sizes[owner[own]] == n
        ok = whole if wanted is None else among(values, wanted.short[n]) & (whole | (n > 1))
        at = np.nonzero(ok)[0]
        found.append((own[at], values[at], np.zeros(len(at), np.int64), np.full(len(at), n), np.ones(len(at), bool)))
    start, key, kind, n, counts = (np.concatenate([f[i] for f in found]) for i in range(5))
    names, indices = words.dictionary, words.indices.to_numpy()
    lists = {int(i): [names[int(indices[s + k])].as_py() for k in range(width) if kinds[kind[i]][2][s + k]] for i, s in ((i, int(start[i])) for i in np.nonzero(kind)[0])}
    values = [lists.get(i, []) for i in range(len(start))]
    row = owner[start]
    return row, start - begin[row], key.view(np.int64), values, n, counts


def forms(row: np.ndarray, pos: np.ndarray, key: np.ndarray, values: list, counts: np.ndarray, n: int) -> tuple[np.ndarray, list]:
    """The form of each of n items, and all windows' slot values as numbers: of items with one form the same words and
    placeholders stand in the same places, and equal values where the others' are equal."""
    form, numbers, names = hashlib.blake2b, [[] for _ in values], [{} for _ in range(n)]
    read: list[dict] = [{} for _ in range(n)]
    for i in sorted(range(len(values)), key=lambda i: (row[i], pos[i], -len(values[i]))):  # of a place the window with most slots first
        own = names[row[i]]
        numbers[i] = [str(own.setdefault(v, len(own))) for v in values[i]]
        read[row[i]].setdefault(bool(counts[i]), {}).setdefault(int(pos[i]), (int(key[i]), numbers[i]))
    chosen = [sorted((x.get(True) or x.get(False) or {}).items()) for x in read]
    return np.array([int.from_bytes(form(repr(x).encode(), digest_size=8).digest(), "little", signed=True) for x in chosen], np.int64), numbers


def item_windows(items: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """``class, item, key, pos, slots, words, total``: items of one form are one class, known by its least id; ``slots`` are numbers of values."""
    kind = dict(items.dtypes)[item_col]
    slots = pa.list_(pa.string())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in pieces(whole, "text", 2_000_000)):
            row, pos, key, values, n, counts = window_rows(b["text"], width)
            form, numbers = forms(row, pos, key, values, counts, b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(form[row]), b["item"].take(pa.array(row)), pa.array(pos, pa.int64()), pa.array(key), pa.array(numbers, slots), pa.array(n), pa.array(counts)], names=["class", "item", "pos", "key", "slots", "words", "counts"])

    own = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("item is not null")
    own = own.groupBy("text").agg(F.min("item").alias("item")).select("item", "text")
    rows = written(own.mapInArrow(of, f"class long, item {kind}, pos long, key long, slots array<string>, words long, counts boolean"), "item_windows")
    best = rows.groupBy("class").agg(F.max("counts").alias("any"), F.min("item").alias("item"))
    rows = rows.drop("item").join(best, "class").where(F.col("counts") | ~F.col("any")).drop("counts", "any").distinct()
    return rows.join(rows.groupBy("class").agg(F.count_distinct("pos").alias("total")), "class")


def item_classes(items: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``item_id, class_id``: the class of each item that has words, known by its least id: what ``item_ids`` of a result stand for."""
    kind = dict(items.dtypes)[item_col]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in pieces(whole, "text", 2_000_000)):
            row, pos, key, values, _, counts = window_rows(b["text"], width)
            form, _ = forms(row, pos, key, values, counts, b.num_rows)
            some = np.unique(row)
            yield pa.RecordBatch.from_arrays([b["item"].take(pa.array(some)), pa.array(form[some])], names=["item_id", "class"])

    own = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("item is not null")
    formed = own.mapInArrow(of, f"item_id {kind}, class long")
    return formed.join(formed.groupBy("class").agg(F.min("item_id").alias("class_id")), "class").select("item_id", "class_id").distinct()


def hits(docs: DataFrame, keys: np.ndarray, short: dict[int, np.ndarray], width: int) -> DataFrame:
    """``uid, doc_id, pos, key, slots`` of each window with a wanted key; one row without a key for a text with none. ``docs``: uid, doc_id, text."""
    sieve = np.zeros(1 << 22, bool)
    sieve[(keys >> np.uint64(42)).astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast((keys, np.packbits(sieve), short))  # at most block_keys numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits, whole = shared.value
        wanted = Wanted(known, np.unpackbits(bits).astype(bool), whole)
        for b in (part for whole in batches for part in pieces(whole, "text", 2_000_000)):
            row, pos, key, slots, *_ = window_rows(b["text"], width, wanted)
            none = np.setdiff1d(np.arange(b.num_rows), row)
            rows = pa.array(np.concatenate([row, none]).astype(np.int64))
            pad = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(len(none), kind)])
            yield pa.RecordBatch.from_arrays([b["uid"].take(rows), b["doc_id"].take(rows), pad(pos, pa.int64()), pad(key, pa.int64()), pad(slots, pa.list_(pa.string()))], names=["uid", "doc_id", "pos", "key", "slots"])

    return docs.mapInArrow(scan, f"uid long, doc_id {dict(docs.dtypes)['doc_id']}, pos long, key long, slots array<string>")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, coverage: float = 0.8, block_keys: int = 2_000_000) -> DataFrame:
    """One row for each input row: ``doc_id, contaminated, n_items, item_ids`` (of classes, sorted), ``covered`` (the largest share of an item)."""
    wanted = written(item_windows(items, item_col, item_text_col, width), "windows")
    texts = keyed(docs, id_col, text_col).select("uid", "doc_id", "text")
    distinct = wanted.select("key", "words").distinct()
    n_blocks = max(1, -(-distinct.count() // block_keys))
    texts = written(texts, "texts") if n_blocks > 1 else texts
    found = None
    for i in range(n_blocks):
        block = distinct.where(F.pmod(F.hash("key"), F.lit(n_blocks)) == i).collect()
        of = lambda n: np.sort(np.array([r["key"] for r in block if r["words"] == n], np.int64).view(np.uint64))  # noqa: B023, E731
        part = hits(texts, of(width), {n: of(n) for n in sorted({r["words"] for r in block} - {width})}, width)
        found = part if found is None else found.unionByName(part)
    found = written(found, "hits")
    seen = found.where("key is not null")
    # windows of equal words: each once for a text, against the list of its places in items
    lists = wanted.where(F.size("slots") == 0).groupBy("key").agg(F.collect_list(F.struct("class", "item", "total", F.col("pos").alias("at"))).alias("own"))
    exact = seen.where(F.size("slots") == 0).select("uid", "key").distinct().join(lists, "key").select("uid", F.explode("own").alias("own")).select("uid", "own.*")
    # windows of equal templates: a text's way along an item must put equal values against equal values
    typed = seen.where(F.size("slots") > 0).join(wanted.select("class", "item", "key", "total", F.col("pos").alias("at"), F.col("slots").alias("own")), "key").withColumn("way", F.col("pos") - F.col("at"))
    pairs = typed.select("uid", "class", "way", F.explode(F.arrays_zip(F.col("own").alias("a"), F.col("slots").alias("b"))).alias("pair"))
    ways = pairs.groupBy("uid", "class", "way").agg(F.count_distinct("pair").alias("pairs"), F.count_distinct("pair.a").alias("values"))
    typed = typed.join(ways.where("pairs = values").select("uid", "class", "way"), ["uid", "class", "way"], "left_semi")
    kept = exact.unionByName(typed.select(*exact.columns))
    shares = kept.groupBy("uid", "class").agg((F.count_distinct("at") / F.first("total")).alias("share"), F.first("item").alias("item"))
    bad = shares.groupBy("uid").agg(F.array_sort(F.collect_set(F.when(F.col("share") >= coverage, F.col("item")))).alias("item_ids"), F.max("share").alias("covered"))
    rows = found.groupBy("uid").agg(F.first("doc_id").alias("doc_id")).join(bad, "uid", "left")
    items_of = F.coalesce("item_ids", F.array().cast(f"array<{dict(items.dtypes)[item_col]}>"))
    return rows.select("doc_id", (F.size(items_of) > 0).alias("contaminated"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("item_ids"), F.coalesce("covered", F.lit(0.0)).alias("covered"))
