"""Language-model scoring by deleted interpolation of word n-grams, up to words of ``order`` (2 unless told).

P1(w) = l * c(w) / N + (1 - l) / (V + 1), and with a history h of k - 1 words Pk(w | h) = l * c(h, w) / c(h) + (1 - l) *
Pk-1(w | shorter h); each order's l depends on the bucket of the context's count (its size in bits). They are learned,
lower orders first, by expectation-maximisation on held-out counts: those of a tenth of the learning texts, from which
the token itself is deleted (its counts less one).

Counts cover the whole corpus and never meet in one place. Rows are written once with a block each, of some megabytes. A
block counts its n-grams (64-bit hashes) in numpy, and sends each range of hashes, sorted, differenced and packed, to
that range's counter, which adds up the blocks and returns to each the totals of its own n-grams, in the block's order.
Counters take at most ``fan`` blocks and ranges, which some 48 GB of text need: of a larger corpus, ``fan`` blocks at a
time are merged, range by range, into one of the next level, whose ranges are finer, until one is left; totals go the same
way back. So an n-gram crosses the network once for each block that has it, and level, however often it occurs; a frequent n-gram
costs no more than a rare one, and no block or range grows with the corpus. Each block sends a row for each range: within
one level their number grows with the square of the corpus (some 8 million small rows at 30 GB), from one level on as it does.

Defined cases: a null text counts as empty (one end token); the crc32 of a null id is that of the empty text; repeated
rows count as often as they occur, and fall into different blocks; other columns are ignored; an empty table gives no
rows; with nothing to learn from, every probability is 1 / (V + 1) = 1.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import crc_of, keyed, written

END = np.uint64(0x9E3779B97F4A7C15)  # the end token's number
BUCKETS = 40
BLOCK_BYTES = 12_000_000
FAN = 4096
RANGE_BYTES = 18_000_000  # of text for each range of hashes
ROWS = "node int, ngram int, part long, grams binary, counts binary"
TOTALS = "node int, ngram int, part long, totals binary, n long, v long"


class Tokens(NamedTuple):
    """A block's tokens: sizes of the texts; for each order its n-grams' sorted hashes, each token's place among them, and a token of each n-gram."""

    sizes: np.ndarray
    names: list[np.ndarray]
    places: list[np.ndarray]
    sample: list[np.ndarray]
    first: np.ndarray  # whether a token is the first of its text
    end: int  # the end token's place among the words


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0xBF58476D1CE4E5B9)) ^ (b + np.uint64(0x94D049BB133111EB))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def tokens_of(texts: pa.Array, order: int) -> Tokens:
    """Each text is its words, A-Z in lower case, then an end token; before its first token there are end tokens."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    owner = pc.list_parent_indices(split).to_numpy()[real.to_numpy(zero_copy_only=False)]
    coded = flat.filter(real).dictionary_encode()
    counts = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    words, place = np.unique(np.append(hashes, END), return_inverse=True)
    end = int(np.searchsorted(words, END))
    ends = np.cumsum(counts + 1) - 1
    word = np.full(int(counts.sum()) + len(counts), end, np.int32)
    inner = np.ones(len(word), bool)
    inner[ends] = False
    word[inner] = place[coded.indices.to_numpy()]
    first = np.zeros(len(word), bool)
    first[ends - counts] = True
    names, places, sample = [words], [word], [np.zeros(0, np.int64)]
    before, start = words[word], np.array([END])
    for _ in range(order - 1):
        before = mixed(np.where(first, start, np.roll(before, 1)), words[word])
        start = mixed(start, np.array([END]))
        own, at, where = np.unique(before, return_index=True, return_inverse=True)
        names.append(own)
        places.append(where.astype(np.int32))
        sample.append(at)
    return Tokens(counts + 1, names, places, sample, first, end)


def packed(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: high bytes of small numbers vanish."""
    values = np.ascontiguousarray(values, np.uint64)
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def ranges_of(hashes: np.ndarray, first: int, n: int, of: int) -> list[tuple[int, int]]:
    """Where sorted hashes of the ranges first to first + n - 1 of ``of`` equal ones begin and end."""
    cuts = np.searchsorted(hashes, np.array([(i << 64) // of for i in range(first, first + n)], np.uint64))
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(hashes)], strict=True))


def blocked(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int, int]:
    """``block, held, dev, doc_id, text``, the texts' bytes and the number of blocks. Held-out texts, and the tenth that teaches the weights, are in blocks of their own."""
    # written, so that every pass sees the same row numbers
    df = written(keyed(docs, id_col, text_col), "texts")
    crc = crc_of(F.col("doc_id"))
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    df = df.withColumns({"held": crc % 10 == 0, "dev": (F.floor(crc / 10) % 10 == 0) & (crc % 10 != 0)})
    spread = F.xxhash64("doc_id", "uid")
    few = max(8, -(-n // 10))
    number = F.when(F.col("held"), F.pmod(spread, F.lit(few))).when(F.col("dev"), F.pmod(spread, F.lit(few)) + few).otherwise(F.pmod(spread, F.lit(n)) + 2 * few)
    return df.select(number.cast("int").alias("block"), "held", "dev", "doc_id", "text"), size, n + 2 * few


def united(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of several nodes' n-grams of a range: all of them, their counts, each one's place among them, and each node's own."""
    grams = [np.cumsum(unpacked(x.as_py()), dtype=np.uint64) for x in table["grams"]]
    names, places = np.unique(np.concatenate(grams), return_inverse=True)
    counts = np.concatenate([unpacked(x.as_py()) for x in table["counts"]])
    return names, np.bincount(places, weights=counts, minlength=len(names)).astype(np.uint64), places, grams  # below 2**53


def shared_out(table: pa.Table, sums: np.ndarray, places: np.ndarray, grams: list[np.ndarray], top: bool) -> pa.Table:
    """Each node's totals, in the order of its own n-grams; the sums of the range stand with the first."""
    ends = np.cumsum([len(g) for g in grams])
    totals = [packed(sums[places[e - len(g) : e]]) for e, g in zip(ends, grams, strict=True)]
    once = lambda x: [int(x) if top and i == 0 else 0 for i in range(len(grams))]
    return pa.table({"node": table["node"], "ngram": table["ngram"], "part": table["part"], "totals": pa.array(totals, pa.binary()), "n": pa.array(once(sums.sum()), pa.int64()), "v": pa.array(once((sums > 0).sum()), pa.int64())})


def rows_of(node: int, ngram: int, names: np.ndarray, counts: np.ndarray, first: int, n: int, of: int) -> list[tuple]:
    return [(node, ngram, first + i, packed(np.diff(names[a:b], prepend=np.uint64(0))), packed(counts[a:b])) for i, (a, b) in enumerate(ranges_of(names, first, n, of))]


def table_of(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(("node", "ngram", "part", "grams", "counts"), kinds, strict=True))})


def widths_of(n_blocks: int, size: int, fan: int, range_bytes: int) -> list[int]:
    """How many parts each level splits a range into: one level for up to fan blocks; the last makes ranges of range_bytes of text."""
    depth = next(d for d in range(1, 64) if fan**d >= n_blocks)
    wanted = max(1, -(-size // range_bytes))
    return [*([fan] * (depth - 1)), max(1, min(fan, -(-wanted // fan ** (depth - 1))))]


def counted(blocks: DataFrame, n_blocks: int, size: int, order: int, fan: int, range_bytes: int) -> tuple[DataFrame, int, int]:
    """``block, ngram, part, totals``: for each block, order and range of hashes the packed totals of the block's n-grams; and N and V."""
    widths = widths_of(n_blocks, size, fan, range_bytes)
    ranges = np.cumprod(widths).tolist()

    def send(table: pa.Table) -> pa.Table:
        t, node = tokens_of(table["text"].combine_chunks(), order), table["block"][0].as_py()
        learns = not table["held"][0].as_py()
        rows = []
        for k, (names, places) in enumerate(zip(t.names, t.places, strict=True), 1):
            rows += rows_of(node, k, names, np.bincount(places, minlength=len(names)) if learns else np.zeros(len(names), np.int64), 0, widths[0], widths[0])
        return table_of(rows)

    def merge(level: int):
        def of(table: pa.Table) -> pa.Table:
            names, sums, _, _ = united(table)
            return table_of(rows_of(table["node"][0].as_py() // fan, table["ngram"][0].as_py(), names, sums, table["part"][0].as_py() * widths[level], widths[level], ranges[level]))

        return of

    def add(table: pa.Table) -> pa.Table:
        _, sums, places, grams = united(table)
        return shared_out(table, sums, places, grams, True)

    def back(nodes: pa.Table, above: pa.Table) -> pa.Table:
        _, _, places, grams = united(nodes)
        finer = sorted(zip(above["part"].to_pylist(), above["totals"].to_pylist(), strict=True))
        return shared_out(nodes, np.concatenate([unpacked(t) for _, t in finer]), places, grams, False)

    levels = [blocks.groupBy("block").applyInArrow(send, ROWS)]
    for level in range(1, len(widths)):
        levels[-1] = written(levels[-1], "grams").withColumn("parent", F.expr(f"node div {fan}"))
        levels.append(levels[-1].groupBy("parent", "ngram", "part").applyInArrow(merge(level), ROWS))
    top = totals = written(levels[-1].groupBy("ngram", "part").applyInArrow(add, TOTALS), "totals")
    for own, width in zip(reversed(levels[:-1]), reversed(widths), strict=False):
        above = totals.select(F.col("node").cast("long").alias("parent"), "ngram", F.expr(f"part div {width}").alias("within"), "part", "totals")
        totals = own.groupBy("parent", "ngram", "part").cogroup(above.groupBy("parent", "ngram", "within")).applyInArrow(back, TOTALS)
        totals = written(totals, "totals")
    sums = top.where("ngram = 1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return totals.select(F.col("node").alias("block"), "ngram", "part", "totals"), sums["n"] or 0, sums["v"] or 0


def with_totals(texts: pa.Table, totals: pa.Table, order: int) -> tuple[Tokens, list[np.ndarray]]:
    """A block's tokens, and the corpus totals of its n-grams of each order."""
    t = tokens_of(texts["text"].combine_chunks(), order)
    rows = sorted(zip(totals["ngram"].to_pylist(), totals["part"].to_pylist(), totals["totals"].to_pylist(), strict=True), key=lambda x: x[:2])
    whole = [np.concatenate([unpacked(x[2]) for x in rows if x[0] == k]).astype(np.float64) for k in range(1, order + 1)]
    if [len(x) for x in whole] != [len(x) for x in t.names]:
        raise ValueError("a block's texts and totals differ")
    return t, whole


class Terms(NamedTuple):
    """Of each n-gram of an order: its context's bucket, its own estimate, and the interpolated one of the order below."""

    bucket: np.ndarray
    own: np.ndarray
    below: np.ndarray


def terms_of(t: Tokens, totals: list[np.ndarray], n: int, v: int, less: int, weights: list[np.ndarray]) -> Terms:
    """Those of the order after the given weights' last; ``less`` 1 deletes the token itself."""
    terms = Terms(np.ones(len(totals[0]), np.int64), np.maximum(totals[0] - less, 0) / max(n - less, 1), np.full(len(totals[0]), 1 / (v + 1)))
    for k, w in enumerate(weights, 1):
        lower = interpolated(terms, w)
        at = t.sample[k] if k < len(t.names) else None
        if at is None:
            break
        context = np.where(t.first[at], totals[0][t.end], totals[k - 1][t.places[k - 1][at - 1]])
        own = np.where(context > less, np.maximum(totals[k] - less, 0) / np.maximum(context - less, 1), 0.0)
        terms = Terms(np.minimum(np.frexp(context)[1].astype(np.int64), BUCKETS - 1), own, lower[t.places[k - 1][at]])
    return terms


def interpolated(terms: Terms, weights: np.ndarray) -> np.ndarray:
    w = weights[terms.bucket]
    return w * terms.own + (1 - w) * terms.below


def bins_of(p: np.ndarray) -> np.ndarray:
    """Log-scaled bins, sixteen for each power of ten, 0 for zero: what falls in one counts with its mean."""
    return np.where(p > 0, np.clip(np.round(16 * (np.log10(np.maximum(p, 1e-300)) + 18)), 1, 300), 0).astype(np.int64)


def learned(stats: list[tuple[int, float, float, int]], rounds: int = 30) -> np.ndarray:
    """The weight of the own estimate in each bucket by expectation-maximisation on ``(bucket, own estimate, that of the order below, tokens)``; buckets without tokens take the weight of all, contexts never seen have none."""
    weights = np.full(BUCKETS, 0.5)
    if stats:
        buckets, own, below, n = (np.array(x) for x in zip(*sorted(stats), strict=True))

        def fit(rows: np.ndarray) -> float:
            w = 0.5
            for _ in range(rounds):
                share = w * own[rows] / np.maximum(w * own[rows] + (1 - w) * below[rows], 1e-300)
                w = float((share * n[rows]).sum() / (n[rows].sum() + 0.1))  # some is always left to the order below
            return w

        weights[:] = fit(np.arange(len(n)))
        for b in np.unique(buckets):
            weights[b] = fit(np.nonzero(buckets == b)[0])
    weights[0] = 0.0
    return weights


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, block_bytes: int = BLOCK_BYTES, fan: int = FAN, range_bytes: int = RANGE_BYTES, weights: list[np.ndarray] | None = None) -> DataFrame:
    """One row for each input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. ``weights`` of each order are learned unless given."""
    blocks, size, n_blocks = blocked(docs, id_col, text_col, block_bytes)
    totals, n, v = counted(blocks, n_blocks, size, order, fan, range_bytes)
    weights = weights or learn_weights(blocks, totals, n, v, order)

    def score(texts: pa.Table, own: pa.Table) -> pa.Table:
        t, c = with_totals(texts, own, order)
        logs = np.log10(interpolated(terms_of(t, c, n, v, 0, weights[:-1]), weights[-1]))[t.places[-1]]
        base = np.log10((c[0] + 0.1) / (n + 0.1 * (v + 1)))[t.places[0]]
        starts = np.cumsum(t.sizes) - t.sizes
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table({"doc_id": texts["doc_id"], "held_out": texts["held"], "n_tokens": t.sizes, "n_known": add((c[0] > 0)[t.places[0]].astype(np.int64)), "train_tokens": np.full(len(starts), n, np.int64), "base_score": add(base), "score": add(logs)})

    kind = dict(docs.dtypes)[id_col]
    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def learn_weights(blocks: DataFrame, totals: DataFrame, n: int, v: int, order: int) -> list[np.ndarray]:
    """The weights of each order, lower ones first."""
    dev = blocks.where("dev")
    own = written(totals.join(dev.select("block").distinct(), "block", "left_semi"), "dev_totals")
    weights: list[np.ndarray] = []

    def collector(lower: list[np.ndarray]):
        def collect(texts: pa.Table, totals: pa.Table) -> pa.Table:
            t, c = with_totals(texts, totals, order)
            terms = terms_of(t, c, n, v, 1, lower)
            keys, at = np.unique((terms.bucket * 512 + bins_of(terms.own)) * 512 + bins_of(terms.below), return_inverse=True)
            tokens = np.bincount(t.places[len(lower)], minlength=len(terms.own))
            add = lambda x: np.bincount(at, weights=x, minlength=len(keys))
            return pa.table({"key": keys, "n": add(tokens).astype(np.int64), "own": add(tokens * terms.own), "below": add(tokens * terms.below)})

        return collect

    for _ in range(order):
        stats = dev.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(collector(list(weights)), "key long, n long, own double, below double")
        sums = stats.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "own", "below"))).collect()  # at most buckets x bins x bins rows
        weights.append(learned([(r["key"] >> 18, r["own"] / r["n"], r["below"] / r["n"], r["n"]) for r in sums if r["n"]]))
    return weights


def perplexity(scored: DataFrame) -> DataFrame:
    """``held_out, tokens, perplexity``: how well the model predicts the texts it learned from, and the others."""
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
