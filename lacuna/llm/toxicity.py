"""Toxicity by bags of subwords: averaged embeddings into a linear softmax, trained jointly.

A word is the mean of the vectors of its character sequences (3 to 5 code points between two end marks) and of itself,
hashed into ``1 << BITS`` buckets, of those that training saw often enough; so a misspelling that training never saw
shares most of its vectors with the word. A window of some ``WINDOW`` words is the mean of its words, and the softmax over
the two classes reads that. A text is as toxic as its most toxic window: an insult in a long text is not averaged away,
and the text is scored whole.

Embeddings, softmax weights and bias are fitted together in numpy by Adagrad on the driver: first on the means of whole
texts, then on each text's most toxic window. The sample is bounded: ``window`` code points of at most ``per_label``
distinct texts of each label, chosen by hash. Its loss is weighted to the labels' shares among all labelled rows, so scores
are probabilities at those shares. What is broadcast is one number for each bucket, since all that follows the embeddings
is linear. Scoring is narrow.

Defined cases: null texts are empty; a text without a word with a letter gets the score of the bias alone; the crc32 of a
null id is that of the empty text; labels that are null count for nothing, others as toxic above 0; an id with several
labels has the greatest; without labels of both kinds every score is the share of label 1 (within 1e-200); repeated
rows and ids stay apart; an empty table gives no rows; other columns are ignored. Labels, languages, sources and ids are
never read in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import crc_of, pieces, written
from lacuna.llm.language_crf import hashes_of, words_in

BITS = 20
SIZES = (3, 4, 5)
WINDOW = 3


class Model(NamedTuple):
    vectors: np.ndarray  # (1 << BITS, dimensions)
    known: np.ndarray  # (1 << BITS): buckets seen often enough
    weights: np.ndarray  # (dimensions, 2)
    bias: np.ndarray  # (2)

    def margins(self) -> np.ndarray:
        """What each bucket adds to the odds of the toxic class; NaN where it is not known."""
        return np.where(self.known, self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), np.nan).astype(np.float32)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words' subwords, a word's together; and where each word's begin. Words aren't empty."""
    text = "".join(f"\x02{w}\x03" for w in words.to_pylist())
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    ends = np.cumsum(sizes)
    place = np.arange(len(code))
    left = np.repeat(ends, sizes) - place  # code points to the word's end
    buckets, keys = [(hashes_of(words) >> np.uint64(64 - BITS)).astype(np.int32)], [ends - sizes]
    rolled = code.copy()
    for n in range(2, min(max(SIZES), len(code)) + 1):
        rolled[: len(code) - n + 1] = rolled[: len(code) - n + 1] * np.uint64(1_000_003) + code[n - 1 :]
        if n in SIZES:
            own = np.nonzero(left >= n)[0]
            mixed = (rolled[own] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
            keys.append(own)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return np.concatenate(buckets)[order], np.searchsorted(key[order], ends - sizes)


def word_margins(margins: np.ndarray, words: pa.Array) -> np.ndarray:
    """Each word's mean over its known subwords."""
    if not len(words):
        return np.zeros(0, np.float32)
    buckets, starts = subwords(words)
    own = margins[buckets]
    known = ~np.isnan(own)
    return np.add.reduceat(np.where(known, own, 0), starts) / np.maximum(np.add.reduceat(known, starts, dtype=np.int64), 1)


def windows_of(owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the window it is in, and of each window its text; a text's windows are of nearly one size."""
    n = np.bincount(owner, minlength=n_texts)
    k = -(-n // WINDOW)
    own = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.cumsum(k) - k, n) + own * np.repeat(k, n) // np.repeat(n, n), np.repeat(np.arange(n_texts), k)


def largest(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The index of each text's largest window; texts without words have none and are left out."""
    order = np.lexsort((-values, text))
    return order[np.unique(text[order], return_index=True)[1]]


def scores_of(margins: np.ndarray, offset: float, texts: pa.Array) -> np.ndarray:
    owner, place, words = words_in(texts)
    used, place = np.unique(place, return_inverse=True)
    own = word_margins(margins, words.take(pa.array(used)))
    window, text = windows_of(owner, len(texts))
    best = np.zeros(len(texts))
    if len(owner):
        mean = np.bincount(window, weights=own[place]) / np.bincount(window)
        top = largest(mean, text)
        best[text[top]] = mean[top]
    return 1 / (1 + np.exp(-np.clip(best + offset, -500, 500)))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all given ranges, end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each run of rows, which may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def train(sample: list[tuple[int, str]], share: float, dimensions: int = 8, whole: int = 2, rounds: int = 12, batch: int = 64, rate: float = 0.5, shrink: float = 1e-6, drop: float = 0.5, least: int = 20, seed: int = 5) -> Model:
    """Fits vectors and softmax to (label, text) pairs; share: how many of all labelled rows have label 1.

    ``whole`` of the ``rounds`` go over the means of whole texts. In each step a word is the mean of a random part of its
    subwords (all but ``drop``), so none of them carries it alone; buckets that fewer than ``least`` words of texts have are left out.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (1 << BITS, dimensions)).astype(np.float32) / dimensions
    weights = rng.uniform(-1, 1, (dimensions, 2)).astype(np.float32)
    bias = np.array([0, np.log(max(share, 1e-9)) - np.log(max(1 - share, 1e-9))], np.float32)
    y = np.array([label for label, _ in sample], np.int64)
    if not 0 < share < 1 or len(set(y.tolist())) < 2:
        bias = np.array([0, np.log(max(share, 1e-300)) - np.log(max(1 - share, 1e-300))])
        return Model(np.zeros_like(vectors), np.zeros(len(vectors), bool), weights, bias)
    owner, place, words = words_in(pa.array([t for _, t in sample], pa.string()))
    used, place = np.unique(place, return_inverse=True)
    buckets, starts = subwords(words.take(pa.array(used))) if len(used) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    sizes = np.diff(np.append(starts, len(buckets)))
    pairs = np.unique(place * len(y) + owner) // max(1, len(y))  # each word once for each of its texts
    common = np.bincount(buckets, weights=np.repeat(np.bincount(pairs, minlength=len(sizes)), sizes), minlength=1 << BITS) >= least
    vectors[~common] = 0
    some = common[buckets]
    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes))
    buckets, starts = buckets[some], np.cumsum(sizes) - sizes
    n_words = np.bincount(owner, minlength=len(y))
    first = np.cumsum(n_words) - n_words
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    seen = [np.full(len(vectors), 1e-4), np.full(weights.shape, 1e-4), np.full(2, 1e-4)]
    full = np.nonzero(n_words)[0]
    for turn in range(rounds):
        for some in np.array_split(rng.permutation(full), -(-len(full) // batch)):
            names, inverse = np.unique(place[ranges(first[some], n_words[some])], return_inverse=True)
            if turn < whole:
                word, token, length = names, inverse, n_words[some]
            else:
                flat = buckets[ranges(starts[names], sizes[names])]
                margin = sums(vectors[flat] @ (weights[:, 1] - weights[:, 0]), sizes[names]) / np.maximum(sizes[names], 1)
                window, text = windows_of(np.repeat(np.arange(len(some)), n_words[some]), len(some))
                length = np.bincount(window)
                top = largest(np.bincount(window, weights=margin[inverse]) / length, text)
                word, token = np.unique(inverse[ranges((np.cumsum(length) - length)[top], length[top])], return_inverse=True)
                word, length = names[word], length[top]
            # each word with a part of its subwords
            flat, of = buckets[ranges(starts[word], sizes[word])], np.repeat(np.arange(len(word)), sizes[word])
            kept = rng.random(len(flat)) >= drop
            flat, of = flat[kept], of[kept]
            n = np.bincount(of, minlength=len(word))
            means = sums(vectors[flat], n) / np.maximum(n, 1)[:, None]
            hidden = np.add.reduceat(means[token], np.cumsum(length) - length, axis=0) / length[:, None]
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            slope = (p - np.eye(2)[y[some]]) * weight[some, None] / len(some)
            back = slope @ weights.T
            per_token = np.repeat(back / length[:, None], length, axis=0)
            per_word = np.zeros((len(word), dimensions))
            np.add.at(per_word, token, per_token)
            order = np.argsort(flat, kind="stable")
            hit, at = np.unique(flat[order], return_index=True)
            g = np.add.reduceat((per_word / np.maximum(n, 1)[:, None])[of[order]], at, axis=0) + shrink * vectors[hit]
            seen[0][hit] += (g * g).mean(axis=1)
            vectors[hit] -= (rate * g / np.sqrt(seen[0][hit])[:, None]).astype(np.float32)
            for i, x, g in ((1, weights, hidden.T @ slope + shrink * weights), (2, bias, slope.sum(axis=0))):
                seen[i] += g * g
                x -= (rate * g / np.sqrt(seen[i])).astype(np.float32)
    return Model(vectors, common, weights, bias)


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, label_id: str, per_label: int, window: int) -> tuple[list[tuple[int, str]], float]:
    """(label, text) pairs of a bounded sample, and the share of label 1 among all labelled rows.

    Only ids, labels and hashes are joined. Of each label's hashes the least of each of many buckets is kept, so a task sends no more than its buckets.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))
    firsts = hashed.join(own, "id").groupBy("label", F.pmod("h", F.lit(16 * per_label)).alias("bucket")).agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n"))
    firsts = written(firsts, "hashes")
    n = {r["label"]: r["n"] for r in firsts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if not n:
        return [], 0.0
    ranked = firsts.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("r") <= per_label).select("label", "h")
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - window, F.lit(1))).cast("int") + 1
    chosen = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(ranked), "h")  # per_label rows for each label at most
    sample = sorted((r["label"], r["text"]) for r in chosen.select("label", F.substring("text", start, F.lit(window)).alias("text")).distinct().collect())
    return sample, n.get(1, 0) / sum(n.values())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id", per_label: int = 1500, window: int = 20_000) -> Model:
    return train(*sampled(docs, labels, id_col, text_col, label_col, label_id, per_label, window))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row for each input row. Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast((model.margins(), model.offset()))  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins, offset = shared.value
        for whole in batches:
            for b in pieces(whole, "__text"):
                yield pa.RecordBatch.from_arrays([b["__id"], b["__held"], pa.array(scores_of(margins, offset, pc.fill_null(b["__text"], "")))], names=["doc_id", "held_out", "score"])

    own = docs.select(F.col(id_col).alias("__id"), (crc_of(F.col(id_col)) % 3 == 1).alias("__held"), F.col(text_col).cast("string").alias("__text"))
    out = own.mapInArrow(score, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Learns from the labelled rows whose id's crc32 mod 3 isn't 1; scores all rows."""
    return predict(docs, fit(docs.where(crc_of(F.col(id_col)) % 3 != 1), labels, id_col, text_col, **options), id_col, text_col)
