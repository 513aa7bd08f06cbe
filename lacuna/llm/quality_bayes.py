"""Quality classifier by hierarchical empirical Bayes.

Each text falls in a cell of a few binned features (symbols, bars, repeated words, word length, size). Labels of a
training share give each cell's evidence, shrunk to the global rate. Every text's quality, its label where it is in the
training share and its cell's posterior elsewhere, is summed by host and by path within the host; a path's posterior is
shrunk to its host's, a host's to the global one, by prior strengths estimated from the spread between sites (method of
moments). The score of a text joins its cell's evidence with its path's posterior, from which the text itself is left
out. All sums are grouped aggregations with partial sums before the shuffle, so a host with a third of all rows costs
one row from each task; the site table is joined by its keys, where Spark splits a hot host.

Defined cases: null texts are texts without words; null hosts and paths are sites of their own (the empty name);
repeated labels of a document are averaged; labels without a document are ignored; documents repeated with one id each
give a row; without labels all evidence is neutral; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import crc_of, keyed, words_of, written

#: Upper bounds of the bins of each feature.
BINS = {
    "symbols": (0.005, 0.02, 0.05, 0.12),  # share of #*$%&|<>~^_=@ in the text
    "repeats": (0.05, 0.3, 0.55, 0.75),  # share of words that stood before
    "line_words": (3.0, 8.0, 400.0),  # words in a line
    "word_size": (2.5, 4.0, 7.0, 10.0),  # code points in a word
    "n_words": (20.0, 60.0, 200.0),
}
CELLS = math.prod(len(b) + 1 for b in BINS.values())


def binned(value: Column, bounds: tuple[float, ...]) -> Column:
    return sum((value > b).cast("int") for b in bounds)


def cells(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str | None) -> DataFrame:
    """``uid, doc_id, host, path, cell, trains``. Narrow, on the JVM."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    df = keyed(docs, id_col, text_col, name(host_col).alias("host"), (name(path_col) if path_col else F.lit("")).alias("path"))
    t = F.col("text")
    df = df.withColumns({"words": words_of(t), "chars": F.length(t), "plain": F.length(F.regexp_replace(t, r"[#*$%&|<>~^_=@]+", "")), "lines": F.greatest(F.size(F.split(F.btrim(t), r"\n+")), F.lit(1))})
    n = F.size("words")
    one = F.greatest(n, F.lit(1))
    values = {
        "symbols": (F.col("chars") - F.col("plain")) / F.greatest("chars", F.lit(1)), "repeats": 1 - F.size(F.array_distinct("words")) / one,
        "line_words": n / F.col("lines"), "word_size": F.length(F.array_join("words", "")) / one, "n_words": n,
    }
    code = F.lit(0)
    for k, bounds in BINS.items():
        code = code * (len(bounds) + 1) + binned(values[k], bounds)
    return df.select("uid", "doc_id", "host", "path", code.alias("cell"), (crc_of(F.col("doc_id")) % 5 != 0).alias("trains"))


def strength(sites: DataFrame, sums: str, counts: str, mean: Column | float) -> float:
    """The prior's weight in texts: the spread between sites beyond chance, by the method of moments; 1 to 1000."""
    p, n = F.col(sums) / F.col(counts), F.col(counts)
    m = mean if isinstance(mean, Column) else F.lit(mean)
    row = sites.where(n >= 2).agg(F.sum(n * (p - m) ** 2).alias("between"), F.sum(m * (1 - m)).alias("chance"), F.sum(n).alias("n"), F.sum(m * (1 - m) * n).alias("all")).first()
    if not row or not row["n"] or not row["all"]:
        return 10.0
    beyond = max(row["between"] - row["chance"], 0.0) / row["n"]  # variance of the sites' own rates
    within = row["all"] / row["n"]
    return min(max(within / beyond - 1, 1.0), 1000.0) if beyond > 0 else 1000.0


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str | None = "lang", label_col: str = "quality", label_id: str = "doc_id", cell_weight: float = 20.0, threshold: float = 0.5) -> DataFrame:
    """One row for each input row: ``doc_id, host, path, p_document, p_host, p_path, score`` (0 to 1) and ``kept``."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("doc_id")).agg(F.avg((F.col(label_col) > 0).cast("double")).alias("label"))
    df = written(cells(docs, id_col, text_col, host_col, path_col).join(own, "doc_id", "left"), "cells")
    df = df.withColumn("taught", F.when(F.col("trains"), F.col("label")))
    rows = df.where(F.col("taught").isNotNull()).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("taught").alias("y")).collect()  # at most CELLS
    total, good = sum(r["n"] for r in rows), sum(r["y"] for r in rows)
    rate = (good + 1) / (total + 2)
    p_cell = {r["cell"]: (r["y"] + cell_weight * rate) / (r["n"] + cell_weight) for r in rows}
    df = df.withColumn("p_document", F.get(F.array(*(F.lit(p_cell.get(c, rate)) for c in range(CELLS))), F.col("cell")))
    df = df.withColumn("evidence", F.coalesce("taught", "p_document"))
    paths = df.groupBy("host", "path").agg(F.sum("evidence").alias("path_sum"), F.count(F.lit(1)).alias("path_n"))
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    sites = written(paths.join(hosts, "host"), "sites")
    whole = sites.agg(F.sum("path_sum").alias("s"), F.sum("path_n").alias("n")).first()
    mean = min(max((whole["s"] or 0.0) / whole["n"], 1e-3), 1 - 1e-3) if whole and whole["n"] else rate
    of_host = strength(sites.select("host", "host_sum", "host_n").distinct(), "host_sum", "host_n", mean)
    of_path = strength(sites, "path_sum", "path_n", F.greatest(F.least(F.col("host_sum") / F.col("host_n"), F.lit(0.999)), F.lit(0.001)))
    df = df.join(sites, ["host", "path"])
    e = F.col("evidence")
    df = df.withColumn("p_host", (F.col("host_sum") - e + of_host * mean) / (F.col("host_n") - 1 + of_host))
    df = df.withColumn("p_path", (F.col("path_sum") - e + of_path * F.col("p_host")) / (F.col("path_n") - 1 + of_path))
    near = lambda c: F.greatest(F.least(F.col(c), F.lit(0.999)), F.lit(0.001))
    score = 1 / (1 + F.exp(-(logit(near("p_document")) - math.log(rate / (1 - rate)) + logit(near("p_path")))))
    return df.select("doc_id", "host", "path", "p_document", "p_host", "p_path", score.alias("score"), (score >= threshold).alias("kept"))
