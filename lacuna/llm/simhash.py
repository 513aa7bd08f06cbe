"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most ``max_bits`` bits are linked. The 64 bits are cut into parts, correlated bits
together; part i gets a threshold t_i with sum(t_i + 1) = max_bits + 1, so any two fingerprints to be linked differ in
at most t_i bits within at least one part. Thresholds are dealt by dynamic programming over the estimated cost of each
part and threshold: probes, and candidates as seen in the pairs of a bounded sample. Each fingerprint stands in an
index once for each part and probes all keys within t_i; candidates are verified on all 64 bits. Only the plan is made
from the sample: the links are exact.

Equal texts meet as one fingerprint first, so a group of copies costs one row; of crowds of different fingerprints that
lie close together only links between classes are made (``classes``). Components come from rounds of
large-star and small-star joins, each written to the shared folder.

Defined cases: null and empty texts have fingerprint zero; repeated rows give equal rows; a null id is never the
smallest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import clear, mark, written


def fingerprint_of(text: str | None, width: int = 4) -> int:
    """The SimHash of the word shingles, repeats included, as a signed 64-bit number."""
    words = (text or "").encode().lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [h(joined, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        hashes = [h(joined[a:b], 42) for a, b in zip((ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``doc_id, fp``: one row for each input row. Narrow."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, width) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col).cast("string")).alias("fp"))


def parts_of(sample: np.ndarray, n_parts: int) -> list[list[int]]:
    """The 64 bits in n_parts groups of nearly equal size; each starts from the most balanced free bit and takes the bits most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    tied = np.abs(centred.T @ centred) / np.outer(spread, spread)
    free, parts = set(range(64)), []
    for k in range(n_parts):
        size = (64 * (k + 1)) // n_parts - (64 * k) // n_parts
        seed = max(free, key=lambda b: (spread[b], -b))
        chosen = sorted(free, key=lambda b: (b != seed, -tied[seed][b], b))[:size]
        parts.append(sorted(chosen))
        free -= set(chosen)
    return parts


def plan(sample: np.ndarray, n: int, max_bits: int) -> list[tuple[int, int]]:
    """``(mask, threshold)`` of each part used: the cheapest over numbers of parts and dealings of thresholds."""
    sample = np.sort(sample)[:: max(1, len(sample) // 1024)].copy() if len(sample) else np.zeros(1, np.int64)
    best: tuple[float, list] = (float("inf"), [])
    for n_parts in range(2, max_bits + 2):
        costs = []
        masks = [sum(1 << b for b in part) for part in parts_of(sample, n_parts)]
        for mask in masks:
            own = sample.view(np.uint64) & np.uint64(mask)
            near = np.bincount(np.bitwise_count(own[:, None] ^ own[None, :]).ravel(), minlength=65)
            near[0] -= len(sample)
            wide, pairs = mask.bit_count(), max(1, len(sample) * (len(sample) - 1))
            costs.append([n * sum(comb(wide, i) for i in range(t + 1)) + 0.05 * n * n * max(near[: t + 1].sum() / pairs, sum(comb(wide, i) for i in range(t + 1)) / 2**wide) for t in range(min(3, wide))])
        table: dict[int, tuple[float, list]] = {0: (0.0, [])}
        for mask, by_threshold in zip(masks, costs, strict=True):
            more = dict(table)  # a part may go unused
            for used, (cost, chosen) in table.items():
                for t, c in enumerate(by_threshold):
                    if used + t + 1 <= max_bits + 1 and cost + c < more.get(used + t + 1, (float("inf"),))[0]:
                        more[used + t + 1] = (cost + c, [*chosen, (mask, t)])
            table = more
        best = min(best, table.get(max_bits + 1, (float("inf"), [])), key=lambda x: x[0])
    return best[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def planned(distinct: DataFrame, max_bits: int, sample_size: int) -> tuple[int, list[tuple[int, int]]]:
    """The number of fingerprints and the plan for them."""
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample_size).collect()  # bounded by sample_size
    n = distinct.count()
    return n, plan(np.array([r["fp"] for r in sample], np.int64), n, max_bits)


def sides(distinct: DataFrame, chosen: list[tuple[int, int]], *more: str) -> tuple[DataFrame, DataFrame]:
    """``a, part, key``: the keys that each fingerprint probes; and ``b, part, key``: where each stands. More columns go with both, as ``a_...`` and ``b_...``."""
    fp = F.col("fp")
    index, probes = [], []
    for i, (mask, t) in enumerate(chosen):
        own = fp.bitwiseAND(F.lit(signed(mask)))
        bits = [b for b in range(64) if mask >> b & 1]
        flips = [signed(sum(1 << b for b in chosen)) for k in range(t + 1) for chosen in combinations(bits, k)]
        index.append(F.struct(F.lit(i).alias("part"), own.alias("key")))
        probes.append(F.transform(F.array(*map(F.lit, flips)), probe(i, own)))

    def side(c: str, keys: Column) -> DataFrame:
        names = [c, *(f"{c}_{m}" for m in more)]
        return distinct.select(fp.alias(c), *(F.col(m).alias(f"{c}_{m}") for m in more), F.explode(keys).alias("p")).select(*names, "p.part", "p.key")

    return side("a", F.concat(*probes)), side("b", F.array(*index))


def apart() -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b")))


def links(distinct: DataFrame, max_bits: int = 4, sample_size: int = 4096) -> DataFrame:
    """``a, b``: all pairs of distinct fingerprints (column ``fp``) that differ in at most max_bits bits, each once."""
    left, right = sides(distinct, planned(distinct, max_bits, sample_size)[1])
    return left.join(right, ["part", "key"]).where((F.col("a") < F.col("b")) & (apart() <= max_bits)).select("a", "b").distinct()


def classes(distinct: DataFrame, max_bits: int = 4, sample_size: int = 4096, hot: int = 256, n_leaders: int = 8) -> DataFrame:
    """``node, root``: the fingerprints that have links, and the least one of their component.

    Fingerprints that stand close together share keys, and the links between them are not all made. Links to a few leaders of
    each key (those with the least hashes, the same ones in each key where they stand) join most of any such group first, and
    no row of a key meets more than ``n_leaders`` others. What can still be linked are pairs of different classes: these are made, and no others.
    Where more than ``hot`` (and sixteen times what chance gives) share a key, links of one bit, which take 64 probes each, join
    them too, and of the pairs left one at least is not of its key's most frequent class: so that class meets only the
    others, not itself, by a second pigeonhole over the other bits. No key's fingerprints go unasked.
    """
    n, chosen = planned(distinct, max_bits, sample_size)
    right = sides(distinct, chosen)[1]
    least = F.get(F.array(*(F.lit(hot + 16.0 * n / 2 ** mask.bit_count()) for mask, _ in chosen)), F.col("part"))
    leaders = F.array_distinct(F.array(*(F.min_by("b", F.xxhash64("b", F.lit(i))) for i in range(n_leaders))))
    shared = right.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), leaders.alias("leaders")).where("n > 1")
    shared = written(shared.select("part", "key", (F.col("n") > least).alias("large"), "leaders"), "shared_keys")
    close = F.filter("leaders", lambda x: (x != F.col("b")) & (F.bit_count(x.bitwiseXOR(F.col("b"))) <= max_bits))
    stars = right.join(shared, ["part", "key"]).select("b", F.explode(close).alias("a"))
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    large = shared.where("large").select("part", "key")
    crowded = large.limit(1).count() > 0
    if crowded:
        flips = F.array(*(F.lit(signed(1 << b)) for b in range(64)))
        beside = right.join(large, ["part", "key"], "left_semi").select("b").distinct()
        beside = beside.select(F.col("b").alias("a"), F.explode(F.transform(flips, lambda f: F.col("b").bitwiseXOR(f))).alias("b")).where("a < b")
        stars = stars.unionByName(beside.join(distinct.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b"))
    first = written(components(stars.distinct()), "first_classes")
    rooted = distinct.select("fp").join(first.select(F.col("node").alias("fp"), "root"), "fp", "left")
    left, right = sides(written(rooted.withColumn("root", F.coalesce("root", "fp")), "rooted"), chosen, "root")
    other = (apart() <= max_bits) & (F.col("a_root") != F.col("b_root"))
    between = left.join(right.join(large, ["part", "key"], "left_anti") if crowded else right, ["part", "key"]).where((F.col("a") < F.col("b")) & other)
    if crowded:
        between = between.select("a_root", "b_root").unionByName(between_crowds(left, right.join(large, ["part", "key"], "left_semi"), chosen, max_bits).where(other).select("a_root", "b_root"))
    linked = between.select(F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b")).distinct()
    return components(first.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(linked))


def between_crowds(left: DataFrame, crowd: DataFrame, chosen: list[tuple[int, int]], max_bits: int) -> DataFrame:
    """Of the crowded keys the pairs ``a, b`` with their roots that may be linked: alike in a part of the bits outside the key's, and not both of its most frequent class."""
    crowd = written(crowd, "crowd")
    spread = crowd.groupBy("part", "key", "b_root").agg(F.count(F.lit(1)).alias("n")).groupBy("part", "key")
    spread = written(spread.agg(F.min("b_root").alias("low"), F.max("b_root").alias("high"), F.max_by("b_root", F.struct("n", "b_root")).alias("most")), "spread")
    asking = left.join(spread, ["part", "key"]).where((F.col("low") < F.col("high")) | (F.col("low") != F.col("a_root"))).withColumn("rest", F.col("a_root") == F.col("most")).drop("low", "high", "most")
    # asked of the most frequent class: only by others; by it: only the rest
    held = crowd.join(spread.select("part", "key", "most"), ["part", "key"])
    held = held.withColumn("rest", F.explode(F.when(F.col("b_root") == F.col("most"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))).drop("most")

    def finer(df: DataFrame, c: str) -> DataFrame:
        out = None
        for i, (mask, _) in enumerate(chosen):
            rest = [b for b in range(64) if not mask >> b & 1]
            cuts = [sum(1 << b for b in rest[k :: max_bits + 1]) for k in range(max_bits + 1)]
            own = F.array(*(F.struct(F.lit(k).alias("sub"), F.col(c).bitwiseAND(F.lit(signed(m))).alias("sub_key")) for k, m in enumerate(cuts)))
            out = F.when(F.col("part") == i, own) if out is None else out.when(F.col("part") == i, own)
        return df.withColumn("s", F.explode(out)).select("*", "s.sub", "s.sub_key").drop("s")

    return finer(asking, "a").join(finer(held, "b"), ["part", "key", "rest", "sub", "sub_key"])


def probe(part: int, own: Column):
    return lambda flip: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(flip).alias("key"))


def components(pairs: DataFrame) -> DataFrame:
    """``node, root``: every node of the links (columns ``a``, ``b``) with the least node of its component.

    Large-star links each node's larger neighbours to its least neighbour, small-star the others; both keep the
    components. It ends when all that is left are stars around the least nodes.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u")
        out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")) if large else out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    spark, at = pairs.sparkSession, mark()
    edges = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    state = None
    while True:
        # a state of a few numbers: the edges' count and sums of their hashes
        edges = written(star(star(edges, True), False), "stars")
        clear(spark, at)  # the rounds before are no longer read
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4, width: int = 4, hot: int = 256) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row for each input row."""
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = classes(distinct.select("fp"), max_bits, hot=hot)
    roots = found.join(distinct.withColumnRenamed("fp", "node"), "node")
    roots = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("node").alias("fp"), "component_id")
    # written, so that the last join has an exchange on either side and Spark can split a fingerprint with very many rows
    members = written(distinct.join(roots, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return fps.join(members, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sketch(text: str | None, width: int = 5, size: int = 128) -> list[int]:
    """The least hashes of the different word shingles, ascending: of two such lists follows the shingles' overlap."""
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    hashes = np.unique(np.fromiter((xxhash.xxh32_intdigest(b" ".join(words[i : i + width]), 7) for i in range(n)), np.uint32, n).view(np.int32))
    return hashes[:size].tolist()


def overlap_of(a: Column, b: Column, size: int = 128) -> Column:
    """The estimated Jaccard similarity of two sketches, exact where both hold all shingles; 1 for two empty ones."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), least)) / F.size(least))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 9, width: int = 2, hot: int = 64, overlap: float = 0.8, n_keys: int = 5) -> DataFrame:
    """``doc_id, h``: of each group of near copies the row that stays, by its id and the ``xxhash64`` of its text.

    Fingerprints of word pairs within ``max_bits`` give the candidates' groups; within them texts are linked only if their
    five-word shingles overlap (estimated from sketches, which for short texts are whole). First they meet by ``n_keys``
    least hashes of their sketches, and of those that share one each is compared with the one of the least id; that joins
    most of each family, whatever its size. Then every pair of different families that can be alike is compared
    (``between_families``), so no link between them is lost. Of each family the row with the least id stays.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    @F.pandas_udf("fp long, sketch array<int>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"fp": [fingerprint_of(t, width) for t in texts], "sketch": [shingle_sketch(t) for t in texts]})

    # equal texts are one from here on
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), of(text).alias("x")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.any_value("x").alias("x"))
    own = written(own.select("h", "doc_id", "x.fp", "x.sketch"), "texts")
    found = classes(own.select("fp").distinct(), max_bits, hot=hot)
    close = own.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = close.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    close = written(close.join(groups, "root").select("h", "doc_id", "root", "sketch"), "close")
    # of each key the least of the sketch's hashes as mixed with its number; all of a group share key 0
    keys = F.array(*(F.struct(F.lit(i).alias("i"), (F.array_min(F.transform("sketch", lambda x: F.xxhash64(x, F.lit(i)))) if i else F.lit(0).cast("long")).alias("key")) for i in range(n_keys + 1)))  # noqa: B023
    each = close.select("h", "doc_id", "root", F.explode(keys).alias("k")).select("h", "doc_id", "root", "k.i", "k.key")
    least = lambda v: F.min_by(v, F.struct(F.col("doc_id").isNull(), "doc_id", "h"))
    first = written(each.groupBy("root", "i", "key").agg(least("h").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "leaders")
    pairs = written(each.join(first, ["root", "i", "key"]).where(F.col("h") != F.col("first")).select("h", "first").distinct(), "compared")

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(close.select("h", "sketch"), "h").join(close.select(F.col("h").alias("first"), F.col("sketch").alias("other")), "first")
        return both.where(overlap_of(F.col("sketch"), F.col("other")) >= overlap).select(F.col("h").alias("a"), F.col("first").alias("b"))

    found = written(components(alike(pairs)), "found")
    family = close.join(found.select(F.col("node").alias("h"), F.col("root").alias("family")), "h", "left").withColumn("family", F.coalesce("family", "h"))
    more = alike(written(between_families(written(family, "family"), overlap), "between"))
    families = written(components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "families")
    named = own.select("h", "doc_id").join(families.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    return named.groupBy("root").agg(least(F.struct("doc_id", "h")).alias("x")).select("x.doc_id", "x.h")


def between_families(rows: DataFrame, overlap: float, size: int = 128) -> DataFrame:
    """``h, first``: all pairs of rows (``h, root, family, sketch``) of one root and different families whose sketches may overlap so far.

    Two sketches with that overlap share so many hashes that those of each which come first, in any one order of all, have
    one in common (prefix filter; the smaller sketch needs fewer). The order begins with a root's rarest ones, so what all of a
    group have in common brings no pairs; a pair meets at the first hash it shares. Pairs that meet are held against
    parities of their hashes, which differ in no more bits than there are hashes in one sketch alone. All of a pair's least hashes
    up to ``size`` count for the overlap, so up to a sketch's ``sure`` one no more than ``size - sure`` may be in one sketch alone; that
    is asked up to the ``bound`` of the root, of sketches that reach it. Every pair passes that has the overlap.
    """
    sure = math.ceil(size * overlap - 1e-6)
    top = F.coalesce(F.try_element_at("sketch", F.lit(sure)), F.lit(2**31 - 1))
    several = rows.groupBy("root").agg(F.min("family").alias("low"), F.max("family").alias("high"), F.percentile_approx(top, 0.03, 1000).alias("bound")).where("low < high").select("root", "bound")
    # an empty sketch has one hash of its own, which no other has
    hashes = F.when(F.size("sketch") == 0, F.array(F.lit(1 << 32))).otherwise(F.col("sketch").cast("array<bigint>"))
    each = rows.join(several, "root").select("h", "root", "family", "bound", (top >= F.col("bound")).alias("reaches"), F.size(hashes).alias("size"), F.explode(hashes).alias("x"))
    each = written(each, "hashes")
    counts = each.groupBy("root", "x").agg(F.count(F.lit(1)).alias("n"), (F.min("family") < F.max("family")).alias("several"))
    parity = lambda k, c: F.expr(f"bit_xor(if({c} and pmod(x, 8) = {k}, shiftleft(1L, cast(pmod(x div 8, 64) as int)), 0L))")
    parities = [parity(k, c).alias(f"{name}{k}") for name, c in (("p", "true"), ("s", "x <= bound")) for k in range(8)]
    ranked = each.join(counts, ["root", "x"]).groupBy("h", "root", "family", "size", "reaches").agg(F.array_sort(F.collect_list(F.struct("n", "x", "several"))).alias("order"), *parities)
    n = F.col("size")
    # shared hashes that a pair must have: of the larger sketch by itself, and of the smaller one with a partner of its size at least
    large, small = n * overlap, F.least(n * (2 * overlap / (1 + overlap)), F.lit(size * overlap))
    first = F.filter(F.slice("order", 1, (n - F.ceil(large - 1e-6) + 1).cast("int")), lambda k: k["several"])
    own = ("h", "family", "size", "reaches", "prefix", *(f"{c}{k}" for c in "ps" for k in range(8)))
    keys = ranked.withColumn("prefix", F.transform(first, lambda k: k["x"])).withColumn("few", F.transform(F.filter(F.slice("order", 1, (n - F.ceil(small - 1e-6) + 1).cast("int")), lambda k: k["several"]), lambda k: k["x"]))
    keys = written(keys.select("root", "few", *own), "prefixes")
    other = keys.select("root", F.explode("few").alias("x"), *(F.col(c).alias(f"other_{c}") for c in own))
    both = n + F.col("other_size")
    need = F.greatest(n * overlap, F.least(both * (overlap / (1 + overlap)), F.lit(size * overlap))) - 1e-6
    differ = lambda c: sum(F.bit_count(F.col(f"{c}{k}").bitwiseXOR(F.col(f"other_{c}{k}"))) for k in range(8))
    may = (F.col("family") != F.col("other_family")) & ((n > F.col("other_size")) | (n == F.col("other_size")) & (F.col("h") > F.col("other_h")))
    may &= (F.col("other_size") >= need) & (differ("p") <= both - 2 * need) & (~F.col("reaches") | ~F.col("other_reaches") | (differ("s") <= size - sure))
    may &= F.get(F.array_intersect("prefix", "other_prefix"), F.lit(0)) == F.col("x")
    return keys.withColumn("x", F.explode("prefix")).join(other, ["root", "x"]).where(may).select("h", F.col("other_h").alias("first")).distinct()
