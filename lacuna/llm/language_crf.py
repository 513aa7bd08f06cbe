"""Language identification by a linear-chain conditional random field over words.

A word's emission scores come from its affixes and inner character sequences (hashed sequences of 2 to 4 bytes of the
word between two end marks) and from lexicons of words typical of each language; transitions between the labels of
neighbouring words are learned with them, on sequences in which stretches of different languages follow each other.
Forward-backward gives each word its label probabilities; a text's language is the one with most probability over its
words with letters, the score its share.

Training runs on the driver on a bounded sample: windows of ``window`` code points of distinct texts, at most
``per_language`` for each language, and about ``most`` in all, but ``least`` for a language with so many texts however
many languages there are; none is left out. It works on slices of ``CELLS`` numbers, so its memory grows with the words
and labels, not with their product with the sample. Labelling covers every word of every text: emissions are computed
once for each distinct word of a batch. With few labels the chains run in blocks of ``STEP`` words that are joined
exactly by their transfer matrices, so a long text costs what as many words of short ones do; with more, where such
matrices would cost more than they save, all chains of a batch are walked in step. The results are the same.

Defined cases: null texts and texts without a letter get ``und`` and score 0, as does every text if nothing could be
learned; the crc32 of a null id is that of the empty text; repeated rows and ids stay apart; ties go to the lesser name;
other columns are ignored; an empty table gives no rows. Neither language nor source nor id is read in labelling.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import crc_of, pieces, written

STEP = 32
BITS = 14
CELLS = 4_000_000
#: Up to so many labels chains are joined by transfer matrices.
FEW_LABELS = 12
OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # (3 << BITS, labels): of hashed byte sequences
    lexicon: np.ndarray  # sorted hashes of typical words
    members: np.ndarray  # (words, labels): in which lexicons
    lexical: np.ndarray  # (labels, labels)
    transitions: np.ndarray  # (labels, labels), logs


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's text, its place in the distinct words, and these, bare and in lower case; words without letters are left out."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    low = pc.utf8_lower(pc.utf8_trim(coded.dictionary, OUTER))
    real = pc.match_substring_regex(low, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
    place = coded.indices.to_numpy().astype(np.int64)
    keep = real[place] if len(place) else np.zeros(0, bool)
    return pc.list_parent_indices(split).to_numpy()[keep], place[keep], low


def features_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words in order (three for each byte of a word with its marks; unused ones are -1), and where each word begins."""
    marked = pc.binary_join_element_wise(pa.scalar("\x02", pa.large_string()), words.cast(pa.large_string()), pa.scalar("\x03", pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint32)
    offsets = offsets - offsets[0]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes to the word's end
    out = np.full((len(data), 3), -1, np.int32)
    code = data.copy()
    for k, n in enumerate((2, 3, 4)):
        code[: len(data) - n + 1] = code[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :]
        hashed = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32) + (k << BITS)
        out[:, k] = np.where(left >= n, hashed, -1)
    return out, offsets[:-1]


def hashes_of(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def in_lexicon(model: Model, words: pa.Array) -> np.ndarray:
    h = hashes_of(words)
    if not len(model.lexicon) or not len(h):
        return np.zeros((len(h), len(model.labels)), np.float32)
    at = np.minimum(np.searchsorted(model.lexicon, h), len(model.lexicon) - 1)
    return model.members[at] * (model.lexicon[at] == h)[:, None]


def word_slices(starts: np.ndarray, n_bytes: int, n_labels: int) -> Iterator[tuple[int, int, int, int]]:
    """Words first to last, and their bytes, of slices with about CELLS numbers for all labels; one word at least."""
    ends = np.append(starts[1:], n_bytes)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + max(1, CELLS // max(1, n_labels)))))
        yield at, to, int(starts[at]), int(ends[to - 1])
        at = to


def emissions(model: Model, words: pa.Array) -> np.ndarray:
    out = in_lexicon(model, words) @ model.lexical
    if not len(words):
        return out
    found, starts = features_of(words)
    padded = np.vstack([model.weights, np.zeros((1, len(model.labels)), np.float32)])
    for i, j, a, b in word_slices(starts, len(found), len(model.labels)):
        own = found[a:b]
        out[i:j] += np.add.reduceat(padded[own[:, 0]] + padded[own[:, 1]] + padded[own[:, 2]], starts[i:j] - a, axis=0)
    return out


def scaled(e: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(e - e.max(axis=-1, keepdims=True), -30)).astype(np.float32)


def marginals(emitted: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of each word of chains of the given sizes (at least 1 each), laid end to end."""
    a = np.exp(transitions - transitions.max()).astype(np.float32)
    return by_blocks(emitted, sizes, a) if len(a) <= FEW_LABELS else by_steps(emitted, sizes, a)


def norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def by_steps(e: np.ndarray, sizes: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Forward-backward, all chains in step, the longest first."""
    order = np.argsort(-sizes, kind="stable")
    begin, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    forward, out = np.empty_like(e), np.empty_like(e)
    live = [int(n) for n in np.searchsorted(-size, -np.arange(size.max(initial=0)), side="left")]  # of each step: how many chains have it
    state = np.full((len(size), len(a)), 1 / len(a), np.float32)
    for t, n in enumerate(live):
        at = begin[:n] + t
        forward[at] = state[:n] = norm((state[:n] @ a) * e[at] + 1e-30)
    state[:] = 1 / len(a)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        out[at] = norm(forward[at] * state[:n] + 1e-30)
        state[:n] = norm((e[at] * state[:n]) @ a.T + 1e-30)
    return out


def by_blocks(emitted: np.ndarray, sizes: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Forward-backward, all blocks of STEP words in step."""
    n_labels = a.shape[0]
    blocks = -(-sizes // STEP)
    first = np.cumsum(blocks) - blocks
    n = int(blocks.sum())
    own = np.arange(len(emitted)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = (np.repeat(first, sizes) + own // STEP) * STEP + own % STEP
    e = np.ones((n * STEP, n_labels), np.float32)
    e[at] = emitted
    e = e.reshape(n, STEP, n_labels)
    used = np.full(n, STEP)
    used[first + blocks - 1] = sizes - (blocks - 1) * STEP

    passed = np.broadcast_to(np.eye(n_labels, dtype=np.float32), (n, n_labels, n_labels)).copy()
    for t in range(STEP):
        live = np.nonzero(used > t)[0]
        x = (passed[live].reshape(-1, n_labels) @ a).reshape(-1, n_labels, n_labels) * e[live, t][:, None, :]
        passed[live] = x / x.sum(axis=(1, 2), keepdims=True)
    before, after = np.full((n, n_labels), 1 / n_labels, np.float32), np.full((n, n_labels), 1 / n_labels, np.float32)
    for k in range(1, int(blocks.max(initial=0))):
        i = first[blocks > k] + k
        before[i] = norm(np.einsum("ni,nij->nj", before[i - 1], passed[i - 1]) + 1e-30)
        j = (first + blocks - 1 - k)[blocks > k]
        after[j] = norm(np.einsum("nij,nj->ni", passed[j + 1], after[j + 1]) + 1e-30)
    forward = np.empty_like(e)
    state = before
    for t in range(STEP):
        state = norm((state @ a) * e[:, t] + 1e-30)
        forward[:, t] = state
    out = np.empty_like(e)
    state = after
    for t in range(STEP - 1, -1, -1):
        inside = (used > t)[:, None]
        out[:, t] = norm(forward[:, t] * state + 1e-30)
        state = np.where(inside, norm((e[:, t] * state) @ a.T + 1e-30), state)
    return out.reshape(-1, n_labels)[at]


def spliced(docs: list[tuple[int, np.ndarray]], length: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of ``length`` words with their labels: half of one text, half of stretches of several."""
    words, labels, mixed = [], [], []
    for y, w in docs:
        half = len(w) // 2 // length * length
        words.append(w[:half])
        labels.append(np.full(half, y))
        rest = w[half:]
        while len(rest):
            k = int(rng.integers(4, 25))
            mixed.append((y, rest[:k]))
            rest = rest[k:]
    for i in rng.permutation(len(mixed)):
        words.append(mixed[i][1])
        labels.append(np.full(len(mixed[i][1]), mixed[i][0]))
    w, y = np.concatenate(words), np.concatenate(labels)
    n = len(w) // length
    return w[: n * length].reshape(n, length), y[: n * length].reshape(n, length)


def expected(e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences of one length: label probabilities, and the expected counts of label pairs."""
    forward, marginal, pair = np.empty_like(e), np.empty_like(e), np.zeros_like(a, dtype=np.float64)
    state = np.full((len(e), e.shape[2]), 1 / e.shape[2], np.float32)
    for t in range(e.shape[1]):
        forward[:, t] = state = norm((state @ a) * e[:, t] + 1e-30)
    state = np.ones_like(state)
    for t in range(e.shape[1] - 1, -1, -1):
        marginal[:, t] = norm(forward[:, t] * state + 1e-30)
        into = e[:, t] * state
        if t:
            before = forward[:, t - 1]
            whole = ((before @ a) * into).sum(axis=1, keepdims=True)
            pair += a * (before.T @ (into / np.maximum(whole, 1e-30)))  # sums over all sequences, without a table for each
        state = norm(into @ a.T + 1e-30)
    return marginal, pair


def train(sample: list[tuple[str, str]], rounds: int = 20, rate: float = 0.35, length: int = STEP, seed: int = 7) -> Model:
    """Fits the field by its likelihood's gradient (Adagrad, with weights shrunk) on ``(language, text)`` pairs."""
    labels = sorted({y for y, _ in sample})
    n_labels = len(labels)
    owner, place, words = words_in(pa.array([t for _, t in sample], pa.string())) if sample else (np.zeros(0, int), np.zeros(0, int), pa.array([], pa.large_string()))
    of_doc = np.array([labels.index(y) for y, _ in sample], np.int64)
    counts = np.zeros((len(words), max(n_labels, 1)))
    if len(place):
        np.add.at(counts, (place, of_doc[owner]), 1)
    typical = (counts >= 3) & (counts >= 0.8 * counts.sum(axis=1, keepdims=True))
    listed = np.nonzero(typical.any(axis=1))[0]
    h = hashes_of(words)
    listed = listed[np.argsort(h[listed])]
    model = Model(labels, np.zeros((3 << BITS, n_labels), np.float32), h[listed], typical[listed].astype(np.float32)[:, :n_labels], np.zeros((n_labels, n_labels), np.float32), np.zeros((n_labels, n_labels), np.float32))
    docs = [(int(of_doc[i]), p) for i, p in enumerate(np.split(place, np.searchsorted(owner, np.arange(1, len(sample))))) if len(p)]
    if n_labels < 1 or not docs or sum(len(d[1]) for d in docs) < 2 * length:
        return model
    w, y = spliced(docs, length, np.random.default_rng(seed))
    found, starts = features_of(words)
    sizes = np.diff(np.append(starts, len(found)))
    lex = in_lexicon(model, words)
    plans = []  # of each slice of words and kind of feature: which bytes have it, in the features' order
    for i, j, a, b in word_slices(starts, len(found), n_labels):
        for k in range(3):
            own = found[a:b, k]
            order = np.argsort(own, kind="stable")[int((own < 0).sum()) :]
            names, first = np.unique(own[order], return_index=True)
            plans.append((i, j, order, names, first))
    seen = np.bincount((y[:, :-1] * n_labels + y[:, 1:]).ravel(), minlength=n_labels**2).reshape(n_labels, n_labels)
    step = max(1, CELLS // (n_labels * length))
    grads = [np.full(x.shape, 1e-3, np.float32) for x in (model.weights, model.lexical, model.transitions)]
    for _ in range(rounds):
        e, moves = scaled(emissions(model, words)), np.exp(model.transitions - model.transitions.max())
        per_word, pair = np.zeros((len(words), n_labels), np.float32), np.zeros((n_labels, n_labels))
        for at in range(0, len(w), step):
            marginal, more = expected(e[w[at : at + step]], moves)
            pair += more
            own = y[at : at + step]
            np.negative(marginal, out=marginal)
            np.put_along_axis(marginal, own[..., None], np.take_along_axis(marginal, own[..., None], 2) + 1, 2)
            order = np.argsort(w[at : at + step].ravel(), kind="stable")
            names, first = np.unique(w[at : at + step].ravel()[order], return_index=True)
            per_word[names] += np.add.reduceat(marginal.reshape(-1, n_labels)[order], first, axis=0)
        total = np.zeros(model.weights.shape, np.float32)
        for i, j, order, names, first in plans:
            if len(order):
                wide = np.repeat(per_word[i:j], sizes[i:j], axis=0)
                total[names] += np.add.reduceat(wide[order], first, axis=0)
        for i, (x, g) in enumerate(((model.weights, total), (model.lexical, lex.T @ per_word), (model.transitions, seen - pair))):
            g = g / len(w) - 1e-5 * x
            grads[i] += g * g
            x += (rate * g / np.sqrt(grads[i])).astype(np.float32)
    return model


def sampled(docs: DataFrame, text_col: str, lang_col: str, per_language: int, window: int, most: int, least: int) -> list[tuple[str, str]]:
    """Windows of distinct texts of each language: of those with the least hashes, each at a place its hash chooses.

    The hashes of a language fall into buckets, of which the least one each is kept: so texts that repeat count once, and
    a task sends no more than its buckets, whatever a language's share of the rows.
    """
    lang, text = F.col(lang_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = docs.where(F.length(F.trim(lang)) > 0).select(lang.alias("lang"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    firsts = written(known.groupBy("lang", F.pmod("h", F.lit(16 * per_language)).alias("bucket")).agg(F.min("h").alias("h")), "hashes")
    n = firsts.select("lang").distinct().count()
    if not n:
        return []
    own = min(per_language, max(least, most // n))
    ranked = firsts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= own).select("lang", "h")
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - window, F.lit(1))).cast("int") + 1
    chosen = known.join(F.broadcast(ranked), ["lang", "h"], "left_semi")  # at most most rows, or least for each language
    return sorted((r["lang"], r["text"]) for r in chosen.select("lang", F.substring("text", start, F.lit(window)).alias("text")).distinct().collect())


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 200, window: int = 2000, most: int = 8000, least: int = 8) -> Model:
    return train(sampled(docs, text_col, lang_col, per_language, window, most, least))


def shares_of(model: Model, texts: pa.Array) -> np.ndarray:
    """For each text the shares of the labels over its words; zeros for texts without letters."""
    owner, place, words = words_in(texts)
    out = np.zeros((len(texts), len(model.labels)))
    if not len(owner) or not model.labels:
        return out
    e = scaled(emissions(model, words))
    sizes = np.bincount(owner, minlength=len(texts))
    p = marginals(e[place], sizes[sizes > 0], model.transitions)
    for k in range(len(model.labels)):
        out[:, k] = np.bincount(owner, weights=p[:, k], minlength=len(texts))
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-30)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` and the columns ``keep``: one row for each input row. Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size for each label

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for b in pieces(whole, "__text", 6 * CELLS // max(4, len(own.labels))):
                p = shares_of(own, pc.fill_null(b["__text"], ""))
                best = p.argmax(axis=1) if own.labels else np.zeros(b.num_rows, int)
                score = p[np.arange(b.num_rows), best] if own.labels else np.zeros(b.num_rows)
                names = [own.labels[k] if s > 0 else "und" for k, s in zip(best, score, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names if c != "__text"), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0))], names=[*(c for c in b.schema.names if c != "__text"), "__lang", "__score"])

    kinds = dict(docs.dtypes)
    own = docs.select(F.col(id_col).alias("__id"), (crc_of(F.col(id_col)) % 5 == 0).alias("__held"), *keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join([f"__id {kinds[id_col]}", "__held boolean", *(f"`{c}` {kinds[c]}" for c in keep), "__lang string", "__score double"])
    return own.mapInArrow(label, schema).select(F.col("__id").alias("doc_id"), F.col("__held").alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), *(c for c in keep if c not in ("doc_id", "held_out", "lang_pred", "score")))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sample: int) -> DataFrame:
    """Learns from the labelled rows whose id's crc32 mod 5 isn't 0; labels all rows."""
    return predict(docs, fit(docs.where(crc_of(F.col(id_col)) % 5 != 0), text_col, lang_col, **sample), id_col, text_col)
