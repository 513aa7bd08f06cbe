"""Hard negatives by anchor-clustered shared lists.

Anchors are taken in blocks of bounded size. A block's anchors are clustered by direction; for each cluster the rows of a
batch are sorted once by an angular upper bound on their inner product with any member: norm * cos(angle to the
centroid - the cluster's radius). Every member walks that one list from the top, in steps, and stops at the first step
whose bound, times its own norm, is below the least score that could still enter its result. So the results are exact,
and how much of a list is walked depends on how tight the clusters are.

A block takes two searches over all rows: for the positives, then for the negatives of each (anchor, positive), whose
scores must lie within a window that depends on the positive's. Each search first runs over a sixteenth of the rows;
the scores found there are floors for the whole search, so a task sends only what can still matter, not its own best rows.
What a task holds is one batch and the results so far of one block; what reaches the driver is one block and its positives.

Scores are integer inner products of ``floor(scale * x)``, exact while they stay below 2**53; higher scores first, ties by
lesser id, null ids last.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; a vector shorter
than the longest counts as filled up with zeros; a null id is never an anchor, but may be a positive or a negative;
rows with an anchor's own id are not its positives; anchors equal in id, label and vector count as one; other repeated
rows each take a place; an anchor without positives, and a positive without negatives, give no rows; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import written
from lacuna.sources.documents import shared_folder

#: Stands for a null id: after all others.
LAST = np.iinfo(np.int64).max
STEP = 512
#: So many candidates at least are merged into a task's results at once.
MERGE = 200_000
#: A search over this share of the rows gives the floors.
SHARE = 16
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "query int, id long, score long"


class Asked(NamedTuple):
    """A block's anchors with their clusters, and what is asked of each: up to n rows with scores from low to high."""

    ids: np.ndarray  # (anchors)
    labels: np.ndarray
    vectors: np.ndarray  # (anchors, width)
    cluster: np.ndarray
    owner: np.ndarray  # (queries), ascending: the anchor asking
    low: np.ndarray  # no lesser score can enter the result
    high: np.ndarray
    n: int
    same: bool  # rows of the anchor's own label but another id, or rows of other labels


def quantised(rows: DataFrame, anchors: Column, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``id, label, v, anchor``: the rows that take part, their components as whole numbers, and whether they are anchors."""
    anchor = F.coalesce(anchors, F.lit(False)) & F.col(id_col).isNotNull()
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), anchor.alias("anchor"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where(F.col("label").isNotNull() & F.col("v").isNotNull() & whole).withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    if len(flat) == out.size:
        return flat.reshape(out.shape).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (zero for zero vectors) and lengths."""
    length = np.sqrt((x * x).sum(axis=1))
    return x / np.maximum(length, 1e-300)[:, None], length


def clustered(vectors: np.ndarray, size: int, rounds: int = 5) -> np.ndarray:
    """Spherical k-means with some ``size`` members a cluster: each row's cluster. Any clustering gives right results."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    own, _ = unit(vectors)
    k = -(-len(own) // size)
    centres = own[np.linspace(0, len(own) - 1, k).astype(int)]
    for _ in range(rounds):
        cluster = (own @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cluster, own)
        centres = np.where((np.bincount(cluster, minlength=k) > 0)[:, None], unit(sums)[0], centres)
    return (own @ centres.T).argmax(axis=1)


class Walk:
    """The search of one task: a block's queries and their best rows so far."""

    def __init__(self, asked: Asked):
        self.asked = asked
        self.query, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = asked.low.copy()  # of each query: what a row must reach to enter
        own, self.length = unit(asked.vectors)
        self.buffer, self.held = [], 0  # candidates not yet merged, and their number
        asking, first, n = np.unique(asked.owner, return_index=True, return_counts=True)
        self.least = np.append(self.least, np.inf)  # of no query
        self.high = np.append(asked.high, -np.inf)
        k = np.arange(n.max(initial=0))
        queries = np.where(k < n[:, None], first[:, None] + k, len(asked.owner))
        self.clusters = []
        of = asked.cluster[asking]
        for c in np.unique(of):
            members = asking[of == c]
            centre = unit(own[members].sum(axis=0, keepdims=True))[0][0]
            radius = np.arccos(np.clip(own[members] @ centre, -1, 1)).max()
            self.clusters.append((members, centre, radius, queries[of == c]))

    def keep(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Takes candidates in; they are merged when they are as many as the results, so that each is sorted a few times only."""
        self.buffer.append((query, ids, score))
        self.held += len(query)
        if self.held >= max(MERGE, len(self.query)):
            self.merge()

    def merge(self) -> None:
        """Each query keeps its n best."""
        query, ids, score = (np.concatenate(x) for x in zip((self.query, self.id, self.score), *self.buffer))
        self.buffer, self.held = [], 0
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        full = query[rank == self.asked.n - 1]
        self.least[full] = np.maximum(self.least[full], score[rank == self.asked.n - 1])
        self.query, self.id, self.score = (x[rank < self.asked.n] for x in (query, ids, score))

    def batch(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        own, length = unit(vectors)
        for members, centre, radius, queries in self.clusters:
            angle = np.arccos(np.clip(own @ centre, -1, 1))
            bound = length * np.cos(np.maximum(angle - radius, 0)) * (1 + 1e-9) + 1e-6
            order = np.argsort(-bound, kind="stable")  # the list that all members share
            for at in range(0, len(order), STEP):
                live = self.length[members] * bound[order[at]] + 1e-6 >= self.least[queries].min(axis=1)
                if not live.any():
                    break  # certified: nothing below can matter to any member
                rows = order[at : at + STEP]
                self.step(members[live], queries[live], ids[rows], labels[rows], vectors[rows])

    def step(self, live: np.ndarray, queries: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        a, n = self.asked, self.asked.n
        score = np.rint(a.vectors[live] @ vectors.T)
        equal = a.labels[live][:, None] == labels
        fits = equal & (a.ids[live][:, None] != ids) if a.same else ~equal
        # what matters to any of an anchor's queries, few places once there are floors
        fits &= (score >= self.least[queries].min(axis=1)[:, None]) & (score <= self.high[queries].max(axis=1)[:, None])
        i, j = np.nonzero(fits)
        s = score[i, j]
        for k in range(queries.shape[1]):  # the anchors' k-th queries
            q = queries[i, k]
            good = (s >= self.least[q]) & (s <= self.high[q])
            u, v, w = i[good], j[good], s[good]
            many = np.bincount(u, minlength=len(live)) >= n
            if many.any():  # their n best places alone, and those equal to the last
                own = np.full(score.shape, -np.inf)
                own[u, v] = w
                floor = np.partition(own[many], len(ids) - n, axis=1)[:, len(ids) - n]
                mine = queries[many, k]
                self.least[mine] = np.maximum(self.least[mine], floor)
                good = w >= self.least[queries[u, k]]
                u, v, w = u[good], v[good], w[good]
            if len(u):
                self.keep(queries[u, k], ids[v], w.astype(np.int64))


def search(rows: DataFrame, asked: Broadcast, width: int) -> DataFrame:
    """``query, id, score``: each query's best rows of every task."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Walk(asked.value)
        for b in batches:
            ids = pc.fill_null(b["id"], int(LAST)).to_numpy()
            w.batch(ids, b["label"].to_numpy(), matrix(b["v"], width))
        w.merge()
        yield pa.RecordBatch.from_arrays([pa.array(w.query, pa.int32()), pa.array(w.id, pa.int64()), pa.array(w.score, pa.int64())], names=["query", "id", "score"])

    return rows.mapInArrow(walk, FOUND)


def best(found: DataFrame, n: int) -> DataFrame:
    """The n best rows of each query, with their ranks."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def answered(rows: DataFrame, asked: Asked, width: int) -> DataFrame:
    """``query, id, score, rank``. A part of the rows gives floors for the search over all."""
    context = rows.sparkSession.sparkContext
    some = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(SHARE)) == 0)
    floors = best(search(some, context.broadcast(asked), width), asked.n).where(F.col("rank") == asked.n).select("query", "score").toPandas()  # one row for each query of a block at most
    low = asked.low.copy()
    low[floors["query"]] = np.maximum(low[floors["query"]], floors["score"])
    return best(search(rows, context.broadcast(asked._replace(low=low)), width), asked.n)


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block: int = 8192, cluster: int = 64,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For each row where ``anchors`` holds: the best rows of its label are its positives; for each of them the best rows of
    other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score`` are the negatives.
    ``block`` is the number of anchors searched for at once, ``cluster`` that of a cluster's members.
    """
    spark = rows.sparkSession
    table = written(quantised(rows, anchors, id_col, vector_col, label_col, scale), "vectors")
    own = written(table.where("anchor").select("id", "label", "v").distinct().withColumn("h", F.xxhash64("id", "label", "v")), "anchors")
    n, width = own.count(), table.agg(F.max(F.size("v"))).first()[0] or 0
    out, n_blocks = shared_folder(spark, "negatives"), -(-n // block)
    spark.createDataFrame([], RESULT).write.parquet(out)
    nullable = lambda c: F.when(F.col(c) != LAST, F.col(c))
    for k in range(n_blocks):  # blocks of anchors against all rows
        some = own.where(F.pmod("h", F.lit(n_blocks)) == k).toArrow()  # some ``block`` distinct rows
        if not some.num_rows:
            continue
        some = some.combine_chunks().to_batches()[0]
        vectors, size = matrix(some["v"], width), some.num_rows
        asked = Asked(some["id"].to_numpy(), some["label"].to_numpy(), vectors, clustered(vectors, cluster), np.arange(size), np.full(size, -np.inf), np.full(size, np.inf), n_positives, True)
        positives = answered(table, asked, width).toPandas().sort_values(["query", "rank"])  # n_positives for each anchor at most
        positives = positives[positives["score"] >= 0]  # below, no score fits the window
        score = positives["score"].to_numpy()
        asked = asked._replace(owner=positives["query"].to_numpy().astype(np.int64), low=-(-low * score // 100).astype(float), high=(high * score // 100).astype(float), n=n_negatives, same=False)
        if not len(score):
            continue
        pairs = pa.table({"query": pa.array(np.arange(len(score)), pa.int32()), "anchor_id": asked.ids[asked.owner], "positive_id": positives["id"].to_numpy(), "positive_score": score})
        found = answered(table, asked, width).join(F.broadcast(spark.createDataFrame(pairs)), "query")
        found.select("anchor_id", nullable("positive_id").alias("positive_id"), "rank", nullable("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
    return spark.read.schema(RESULT).parquet(out)
