"""Replacement by large dictionaries: the same result as one replacement after the other, longest terms first.

Pairs are put into layers. Within a layer no term can touch what an earlier pair of it made: it neither holds nor lies in
that pair's replacement, nor do their ends fit together; behind an empty replacement only terms of one character may
follow. So a layer is one pass: an automaton finds all its terms, and in the order of the pairs each occurrence is taken
that touches none taken before. Terms never grow shorter than those after them, so a look at an occurrence's two ends tells.
A dictionary of names and placeholders is one layer.

A table is read in order, a part at a time, and broadcast in blocks of at most ``BLOCK`` code points; each block is a pass.

Defined cases: null texts stay null; null and empty terms are left out; a null replacement is empty; a term given twice
is sought again, in what the pairs between made.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points of terms and replacements in one block.
BLOCK = 4_000_000
Pair = tuple[str, str]
_given: dict[str, Broadcast] = {}


def in_order(dictionary: DataFrame | Sequence[Pair]) -> Iterable[Pair]:
    """The pairs, longest first; a table's are fetched partition by partition."""
    if not isinstance(dictionary, DataFrame):
        return sorted((p for p in dictionary if p[0]), key=lambda p: -len(p[0]))
    own = dictionary.select(F.col("from").cast("string").alias("a"), F.coalesce(F.col("to").cast("string"), F.lit("")).alias("b")).where("length(a) > 0")
    return ((r["a"], r["b"]) for r in own.orderBy(F.desc(F.length("a")), "a", "b").toLocalIterator())


def blocks(pairs: Iterable[Pair]) -> Iterator[list[Pair]]:
    own, size = [], 0
    for a, b in pairs:
        if size > BLOCK:
            yield own
            own, size = [], 0
        own.append((a, b))
        size += len(a) + len(b)
    if own:
        yield own


def layers(pairs: list[Pair]) -> list[list[Pair]]:
    """The pairs in runs that may be replaced at once."""
    # where terms stand in replacements: of each term the places in the order of the pairs whose replacement holds it
    made: dict[str, list[int]] = {}
    for i, (_, b) in enumerate(pairs):
        made.setdefault(b, []).append(i)
    terms = ahocorasick.Automaton()
    for a, _ in pairs:
        terms.add_word(a, a)
    terms.make_automaton()
    held: dict[str, list[str]] = {}
    for b in made:
        for a in {a for _, a in terms.iter(b)}:
            held.setdefault(a, []).append(b)
    out: list[list[Pair]] = []
    begin, mine, whole, starts, ends, sizes, empty = 0, set(), set(), set(), set(), set(), False

    def touched(j: int, a: str) -> bool:
        if empty and len(a) > 1:
            return True
        for b in held.get(a, ()):
            k = bisect_left(made[b], j)
            if k and made[b][k - 1] >= begin:
                return True
        if any(a[:k] in ends or a[-k:] in starts for k in range(1, len(a) + 1)):
            return True
        return any(a[k : k + n] in whole for n in sizes if n <= len(a) for k in range(len(a) - n + 1))

    for j, (a, b) in enumerate(pairs):
        if not out or touched(j, a):
            out.append([])
            begin, mine, whole, starts, ends, sizes, empty = j, set(), set(), set(), set(), set(), False
        if a in mine:
            continue  # it finds nothing that the first one left
        mine.add(a)
        out[-1].append((a, b))
        if not b:
            empty = True
        elif b not in whole:
            whole.add(b)
            sizes.add(len(b))
            starts.update(b[:k] for k in range(1, len(b) + 1))
            ends.update(b[-k:] for k in range(1, len(b) + 1))
    return out


def automaton_of(layer: list[Pair]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, (a, b) in enumerate(layer):
        out.add_word(a, (i, len(a), b))
    out.make_automaton()
    return out


@lru_cache(maxsize=2)  # a worker builds each once and keeps the last ones
def automata(key: str) -> list[ahocorasick.Automaton]:
    return [automaton_of(layer) for layer in _given[key].value]


def replaced(layer: ahocorasick.Automaton, text: str) -> str:
    found = sorted((i, at + 1 - n, at + 1, b) for at, (i, n, b) in layer.iter(text))
    if not found:
        return text
    taken, kept = bytearray(len(text)), []
    for _, start, end, b in found:
        if not (taken[start] or taken[end - 1]):
            taken[start:end] = b"\1" * (end - start)
            kept.append((start, end, b))
    kept.sort()
    out, last = [], 0
    for start, end, b in kept:
        out += [text[last:start], b]
        last = end
    return "".join([*out, text[last:]])


def scrubbed(spark: SparkSession, text: Column, dictionary: DataFrame | Sequence[Pair]) -> Column:
    """The text after all replacements."""
    for block in blocks(in_order(dictionary)):
        text = _scrub(spark.sparkContext.broadcast(layers(block)), uuid.uuid4().hex)(text)
    return text


def scrub(texts: pa.Array, shared: Broadcast, key: str) -> pa.Array:
    _given.setdefault(key, shared)
    out = []
    for x in texts:
        text = x.as_py()
        for layer in automata(key) if text else ():
            text = replaced(layer, text)
        out.append(text)
    return pa.array(out, pa.string())


def _scrub(shared: Broadcast, key: str):
    def of(texts):
        return scrub(texts, shared, key)

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "string")
