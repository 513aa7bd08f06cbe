"""Encoding by sampled segmentations: forward filtering, backward sampling over the piece lattice.

Pieces come from a SentencePiece vocabulary; a piece's probability follows its rank (``-exponent * log(rank)``). Every
byte can also stand alone as its byte piece, so any text has a segmentation. Forward filtering sums the weights of all
segmentations up to each place; backward sampling draws a segmentation from its exact distribution. The draw at a place
hangs on the row's key, the seed and the place alone, so it is the same on any machine, in any batch and on any retry.
Decoding gives back the text, byte for byte.

The lattice never crosses the start of a run of spaces (no piece does), so it falls into units. Forward sums are made
once for each distinct unit of a batch. Within a unit no segmentation passes by a place that no piece crosses, so units
fall into stretches, and all stretches of a batch are walked in step in numpy, whatever their length. A leading space is added before encoding and taken off after decoding, as the vocabulary
expects.

Defined cases: a null text counts as empty and has no pieces; a null key is that of the empty text; rows that repeat
key and text get equal pieces; the sign that stands for a space in pieces, met in a text, is spelled in byte pieces;
unknown and control ids decode to nothing; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import give_back
from lacuna.llm.common import pieces as slices

SLICE = 500_000  # bytes of text segmented at once; some 150 bytes of memory each
BLOCK = 250_000  # bytes of distinct units whose arcs are summed at once; some 250 bytes of memory each
SCALE = 1000.0  # per byte: keeps sums of weights within range between two scalings
RESCALE = 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(NamedTuple):
    keys: list  # for each length: sorted hashes of the pieces of that many bytes, and their ids
    sieve: np.ndarray
    logs: np.ndarray  # of each id
    bytes_: np.ndarray  # the id of each single byte
    blob: np.ndarray  # all pieces' bytes; where each id's begin, and how many
    starts: np.ndarray
    sizes: np.ndarray
    table: dict  # bytes to id


def grown(codes: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (codes ^ more) * MULTIPLIER + (codes >> np.uint64(29))


@lru_cache(maxsize=2)
def load(path: str, exponent: float = 1.0) -> Vocabulary:
    """Reads the vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    parts, logs, table, single = [], np.full(n, -30.0), {}, np.zeros(256, np.int64)
    for i in range(n):
        if model.is_control(i) or model.is_unknown(i):
            parts.append(b"")
        elif model.is_byte(i):
            value = int(model.id_to_piece(i)[3:5], 16)
            parts.append(bytes([value]))
            single[value], logs[i] = i, -exponent * math.log(n) - 4.0
        else:
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            parts.append(piece)
            rank = min(max(-model.get_score(i), 0.0), float(n)) + 1.0
            logs[i] = -exponent * math.log(rank + 1.0)
            table[piece] = i
    for piece, i in table.items():
        if len(piece) == 1:
            single[piece[0]] = i
    sizes = np.array([len(p) for p in parts], np.int64)
    longest = max(map(len, table), default=1)
    keys, sieve = [], np.zeros(1 << 20, bool)
    for k in range(1, longest + 1):
        own = [(p, i) for p, i in table.items() if len(p) == k]
        data = np.array([list(p) for p, _ in own], np.uint64).reshape(len(own), k)
        codes = np.zeros(len(own), np.uint64)
        for j in range(k):
            codes = grown(codes, data[:, j] + np.uint64(1))
        order = np.argsort(codes)
        keys.append((codes[order], np.array([i for _, i in own], np.int64)[order]))
        sieve[(codes >> np.uint64(44)).astype(np.int64)] = True
    return Vocabulary(keys, sieve, logs, single, np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes, table)


def uniform(seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each key and place."""
    x = seeds + places.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


class Lattice(NamedTuple):
    """The arcs of distinct units by the byte behind them, and the cuts: places that no arc crosses."""

    cuts: np.ndarray
    first: np.ndarray  # of each place: the first arc that ends there
    ids: np.ndarray
    size: np.ndarray
    upto: np.ndarray  # cumulated share of the arcs of a place


def lattice(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> Lattice:
    """Forward sums over units laid end to end. Between two cuts the sums depend on nothing outside, so all stretches are
    walked in step, and long ones are scaled anew on the way; a unit costs its length, however long it is."""
    n = len(data)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    codes, active = np.zeros(n, np.uint64), np.arange(n)
    begin, size, ids = [np.arange(n, dtype=np.int32)], [np.ones(n, np.int32)], [v.bytes_[data].astype(np.int32)]
    crossed = np.zeros(n + 1, np.int32)
    for k, (known, of) in enumerate(v.keys, 1):
        active = active[left[active] >= k]
        if not len(active):
            break
        codes[active] = grown(codes[active], data[active + (k - 1)].astype(np.uint64) + np.uint64(1))
        if k == 1 or not len(known):
            continue  # single bytes are all there already
        own = codes[active]
        hit = active[v.sieve[(own >> np.uint64(44)).astype(np.int64)]]
        at = np.minimum(np.searchsorted(known, codes[hit]), len(known) - 1)
        ok = known[at] == codes[hit]
        hit = hit[ok]
        begin.append(hit.astype(np.int32))
        size.append(np.full(len(hit), k, np.int32))
        ids.append(of[at[ok]].astype(np.int32))
        np.add.at(crossed, hit + 1, 1)
        np.add.at(crossed, hit + k, -1)
    begin, size, ids = np.concatenate(begin), np.concatenate(size), np.concatenate(ids)
    end = begin + size
    order = np.argsort(end, kind="stable")
    begin, end, size, ids = begin[order], end[order], size[order], ids[order]
    cuts = np.nonzero(np.cumsum(crossed[:n]) == 0)[0]
    home = np.repeat(cuts, np.diff(np.append(cuts, n)))  # of each byte: its stretch's start
    weight = np.exp(v.logs[ids]) * SCALE**size
    reached = end - home[begin]
    step = np.argsort(reached, kind="stable")
    turns = np.searchsorted(reached[step], np.arange(1, int(reached.max(initial=0)) + 2))
    sums = np.zeros(n + 1)  # of the ways from the stretch's start to a place within it
    sums[cuts] = 1.0
    inner = np.append(np.arange(n), -1) != np.append(home, -1)  # places within a stretch
    lengths = np.diff(np.append(cuts, n))
    long = np.argsort(-lengths, kind="stable")[: int((lengths > RESCALE).sum())]
    share = np.empty(len(ids))
    for t, (a, b) in enumerate(zip(turns[:-1], turns[1:], strict=True), 1):
        arcs = step[a:b]
        own = sums[begin[arcs]] * weight[arcs]
        ends, back = np.unique(end[arcs], return_inverse=True)
        total = np.bincount(back, weights=own, minlength=len(ends))
        share[arcs] = own / total[back]
        within = inner[ends]
        sums[ends[within]] = total[within]
        if t % RESCALE == 0:
            long = long[lengths[long] > t]
            at = cuts[long] + t
            near = np.maximum(at[:, None] - np.arange(len(v.keys) + 1), cuts[long][:, None])
            scale = sums[at]
            near, owner = np.unique(near.ravel(), return_index=True)
            sums[near] /= np.repeat(scale, len(v.keys) + 1)[owner]
    total = np.cumsum(share)
    first = np.searchsorted(end, np.arange(n + 2))
    return Lattice(cuts, first, ids, size, total - np.append(0.0, total)[first[end]])


def lattice_by_blocks(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> Lattice:
    """The same lattice, made from blocks of whole units: what the sums take on the way is bounded, however long the texts are."""
    parts, cuts, first, a, arcs = [], [], [np.zeros(1, np.int64)], 0, 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, side="right")) - 1)
        part = lattice(v, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        cuts.append(part.cuts + offsets[a])
        first.append(part.first[1:-1] + arcs)
        parts.append(part)
        a, arcs = b, arcs + len(part.ids)
    first.append(np.array([arcs]))
    return Lattice(np.concatenate(cuts), np.concatenate(first), *(np.concatenate([x[i] for x in parts]) for i in (2, 3, 4)))


def segment(v: Vocabulary, texts: pa.Array, seeds: np.ndarray) -> pa.ListArray:
    """The sampled pieces' ids of each text."""
    spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, "")).cast(pa.large_binary())
    spaced = spaced.combine_chunks() if isinstance(spaced, pa.ChunkedArray) else spaced
    bounds = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if spaced.buffers()[2] is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    ids = np.zeros(len(data), np.int32)  # at each piece's last byte: its id, plus one
    if len(data):
        new = np.zeros(len(data), bool)
        space, line = data == 32, data == 10
        new[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        new[bounds[:-1][np.diff(bounds) > 0]] = True
        begin = np.nonzero(new)[0]
        end = np.append(begin[1:], len(data))
        doc = np.searchsorted(bounds, begin, side="right") - 1
        doc_seed, doc_start = seeds[doc], bounds[doc]
        buffers = [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        units = pa.Array.from_buffers(pa.large_binary(), len(begin), buffers).dictionary_encode()
        distinct = units.dictionary
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        own = np.frombuffer(distinct.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        net = lattice_by_blocks(v, own, offsets)
        # every unit's stretches between cuts are walked back from their ends, all in step
        kind = units.indices.to_numpy().astype(np.int64)
        first = np.searchsorted(net.cuts, offsets)
        counts = np.diff(first)[kind]
        unit = np.repeat(np.arange(len(kind)), counts)
        stretch = first[kind][unit] + np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = np.append(net.cuts[1:], len(own))[stretch]
        left = place - net.cuts[stretch]
        shift = (begin - offsets[kind])[unit]  # from places in the distinct units to places in the texts
        base, seed = shift - doc_start[unit], doc_seed[unit]
        live = np.arange(len(place))
        while len(live):
            at = place[live]
            u = uniform(seed[live], base[live] + at)
            arc, last = net.first[at], net.first[at + 1] - 1
            go = np.nonzero((u >= net.upto[arc]) & (arc < last))[0]
            while len(go):
                arc[go] += 1
                go = go[(u[go] >= net.upto[arc[go]]) & (arc[go] < last[go])]
            ids[shift[live] + at - 1] = net.ids[arc] + 1
            place[live] -= net.size[arc]
            left[live] -= net.size[arc]
            live = live[left[live] > 0]
    drawn = np.nonzero(ids)[0]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(drawn, bounds).astype(np.int32)), pa.array(ids[drawn] - 1, pa.int32()))


def joined(v: Vocabulary, lists: pa.ListArray) -> pa.Array:
    """The texts of lists of ids."""
    ids = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = np.where((ids >= 0) & (ids < len(v.sizes)), ids, 0)
    size = v.sizes[ids]
    ends = np.cumsum(size)
    data = v.blob[np.repeat(v.starts[ids] - (ends - size), size) + np.arange(int(size.sum()))]
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))]
    spaced = np.zeros(len(counts), np.int64)
    some = np.nonzero(np.diff(bounds) > 0)[0]
    spaced[some] = data[bounds[some]] == 32
    raw = data.tobytes()
    starts = bounds[:-1] + spaced
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), bounds[1:].tolist(), strict=True)], pa.string())


def encoded_rows(v: Vocabulary, batches: Iterator[pa.RecordBatch], decoded: bool) -> Iterator[pa.RecordBatch]:
    """The batches' columns but ``__seed``, with ``__ids`` and, if asked for, ``__decoded``, by slices of the rows."""
    give_back()  # what other stages left in this worker
    for whole in batches:
        for b in slices(whole, "__text", SLICE):
            ids = segment(v, b["__text"], b["__seed"].to_numpy().view(np.uint64))
            more = {"__ids": ids} | ({"__decoded": joined(v, ids)} if decoded else {})
            names = [c for c in b.schema.names if c != "__seed"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *more.values()], names=[*names, *more])
        give_back()


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, exponent: float = 1.0, keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """``key, text, ids``, with ``decoded`` the text made of the ids again, and the columns ``keep``: one row for each input row. ``vocabulary`` is a file that every worker has. Narrow."""
    kinds = dict(docs.dtypes)
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    own = docs.select(F.col(id_col).alias("__key"), key.alias("__seed"), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded_rows(load(vocabulary, exponent), batches, decoded)

    schema = ", ".join([f"__key {kinds[id_col]}", *(f"`{c}` {kinds[c]}" for c in keep), "__text string", "__ids array<int>", *(["__decoded string"] if decoded else [])])
    return own.mapInArrow(run, schema).select(F.col("__key").alias("key"), F.col("__text").alias("text"), F.col("__ids").alias("ids"), *([F.col("__decoded").alias("decoded")] if decoded else []), *(c for c in keep if c not in ("key", "text", "ids")))


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", exponent: float = 1.0) -> DataFrame:
    """The input's columns and ``decoded``. Narrow."""
    kinds = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(vocabulary, exponent)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([*b.columns, joined(v, b[ids_col])], names=[*b.schema.names, "decoded"])

    kept = [c for c in encoded.columns if c != "decoded"]
    return encoded.select(*kept).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "decoded string"]))
