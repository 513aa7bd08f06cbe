"""Quality rules: distribution divergence, with Spark functions alone.

Two histograms of each text, of character classes and of its language's common words (all others in one bin), are
compared with the language's own by Jensen-Shannon distance (base 2, so 0 to 1). Short texts scatter, so the distances
count only from ``min_words`` words on. References come from all rows by one grouped count each; they are the size of
the list of languages, and joined to the texts by language. Everything else is narrow.

Defined cases: a null text has no words and fails the base rules; a null language is a language of its own; repeated
rows and ids stay apart; an empty table gives no rows; other columns are ignored; words of equal count are ranked by
their text. Repeated windows are told by a 64-bit hash of their eight words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import WHITE, WHITE_RE, keyed, words_of, written

CLASSES = ("letters", "digits", "white", "points", "symbols", "others")
#: Of the hashes of common words; few buckets hold more than two of 48 words.
BUCKETS = 128


def repeated_words(words: Column) -> Column:
    """Of an array of hashes of all 8-word windows: how many words stand in windows that occur twice or more."""
    ranked = F.sort_array(F.transform(words, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.arrays_zip(ranked.alias("a"), F.slice(ranked, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))
    equal = F.filter(pairs, lambda z: z["a"]["h"] == z["b"]["h"])
    starts = F.sort_array(F.array_distinct(F.flatten(F.transform(equal, lambda z: F.array(z["a"]["i"], z["b"]["i"])))))
    steps = F.arrays_zip(starts.alias("a"), F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))).alias("b"))
    return F.aggregate(steps, F.lit(0), lambda n, z: n + F.least(F.lit(8), F.coalesce(z["b"] - z["a"], F.lit(8))))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``uid, doc_id, lang, words``, the base counts, and the counts of CLASSES. Narrow."""
    t, n = F.col("text"), F.col("n_words")
    df = keyed(docs, id_col, text_col, F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    df = df.withColumns({"words": words_of(t), "rest": F.regexp_replace(t, r"\p{L}+", ""), "lines": F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0), "n_chars": F.length(t)})
    df = df.withColumn("n_words", F.size("words"))
    # hashes of 2, 4, then 8 words in a row: each from the one before and itself moved on; what runs over the end is cut off
    moved = lambda c, k: F.zip_with(c, F.slice(c, k + 1, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("twos", moved("words", 1)).withColumn("fours", moved("twos", 2))
    # a window found twice starts with four words found twice; most texts have none, and no hashes of eight words are made
    df = df.withColumn("eights", F.when((n >= 9) & (F.size(F.array_distinct("fours")) < n), moved("fours", 4)))
    df = df.withColumn("windows", F.when(F.col("eights").isNotNull(), F.slice("eights", F.lit(1), n - 7)).otherwise(F.array().cast("array<bigint>")))
    left = lambda pattern: F.length(F.regexp_replace("rest", pattern, ""))
    df = df.withColumns({"n_rest": F.length("rest"), "no_white": left(WHITE_RE), "digits": F.length("rest") - left("[0-9]+"), "points": F.length("rest") - left(r"[.,;:!?'\"()-]+"), "n_symbols": F.length("rest") - left(r"[#*$%&|<>]+"), "repeats": F.size(F.array_distinct("windows")) < F.size("windows")})
    df = df.withColumns({"letters": F.col("n_chars") - F.col("n_rest"), "white": F.col("n_rest") - F.col("no_white"), "symbols": F.col("n_symbols")})
    df = df.withColumn("others", F.col("n_rest") - F.col("white") - F.col("digits") - F.col("points") - F.col("symbols"))
    return df.select(
        "uid", "doc_id", "lang", "words", n.cast("long").alias("n_words"), (F.col("n_chars") - F.col("white")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), repeated_words(F.col("windows"))).otherwise(0).cast("long").alias("n_repeat_words"), *CLASSES,
    )


def word_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", n_common: int = 48) -> DataFrame:
    """``lang, ref_words, ref_shares, ref_other``: the commonest words of each language, and their shares of all its words.

    Counts are summed before their shuffle, so a language that holds most rows costs one row for each word and task.
    """
    df = keyed(docs, lang_col, text_col, F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang")).select("lang", words_of(F.col("text")).alias("words"))
    each = df.select("lang", F.explode_outer("words").alias("word")).where("word is not null")
    counted = each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    sums = counted.groupBy("lang").agg(F.sum("n").alias("total"))  # a language without words has no reference, and no text to compare
    # ranked by slices of the words first: no language meets whole in one task
    sliced = Window.partitionBy("lang", F.pmod(F.hash("word"), F.lit(64))).orderBy(F.desc("n"), "word")
    best = counted.withColumn("rank", F.row_number().over(sliced)).where(F.col("rank") <= n_common)
    best = best.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))), 1, n_common).alias("top"))
    words = sums.join(best, "lang", "left").select("lang", "total", F.coalesce("top", F.array().cast("array<struct<m:bigint,word:string>>")).alias("top"))
    words = words.select("lang", F.transform("top", lambda x: x["word"]).alias("ref_words"), F.transform("top", lambda x: -x["m"] / F.col("total")).alias("ref_shares"))
    return words.withColumn("ref_other", F.lit(1.0) - F.aggregate("ref_shares", F.lit(0.0), lambda a, x: a + x))


def bucket_of(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def bucketed(refs: DataFrame) -> DataFrame:
    """refs and ``ref_buckets``: the words of each bucket, so that a word meets one bucket and not the whole list."""
    return refs.withColumn("ref_buckets", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.filter("ref_words", lambda w: bucket_of(w) == k)))


def class_references(counts: DataFrame) -> DataFrame:
    """``lang, ref_classes``: each language's shares of CLASSES."""
    sums = counts.groupBy("lang").agg(*(F.sum(c).cast("double").alias(c) for c in CLASSES))
    total = sum(F.col(c) for c in CLASSES)
    return sums.select("lang", F.array(*(F.when(total > 0, F.col(c) / total).otherwise(0.0) for c in CLASSES)).alias("ref_classes"))


def joined(df: DataFrame, refs: DataFrame, max_rows: int = 4096) -> DataFrame:
    """df with its language's references: broadcast where they are few rows (each of fixed size), else a plain join."""
    return df.join(F.broadcast(refs) if refs.count() <= max_rows else refs, "lang", "left")


def distance(pairs: Column) -> Column:
    """Jensen-Shannon distance of an array of ``struct<p, q>`` of shares, base 2."""

    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    both = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + half(x["p"], (x["p"] + x["q"]) / 2) + half(x["q"], (x["p"] + x["q"]) / 2))
    return F.sqrt(F.greatest(both / 2, F.lit(0.0)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n_common: int = 48, min_words: int = 50, max_chars: float = 0.2, max_words: float = 0.42) -> DataFrame:
    """One row for each input row: the base counts, ``base_failed``, ``kept``, ``char_distance`` and ``word_distance`` (null below ``min_words``)."""
    n = F.col("n_words")
    df = joined(features(docs, id_col, text_col, lang_col), written(bucketed(word_references(docs, text_col, lang_col, n_common)), "references"))
    df = df.withColumn("common", F.when(n >= min_words, F.filter("words", lambda w: F.array_contains(F.col("ref_buckets")[bucket_of(w)], w))))
    seen = F.transform("ref_words", lambda w: (F.size("common") - F.size(F.array_remove("common", w))) / n)
    shares = F.zip_with(seen, "ref_shares", lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    rest = F.array(F.struct((F.lit(1.0) - F.size("common") / n).alias("p"), F.greatest("ref_other", F.lit(0.0)).alias("q")))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    df = written(df.select("doc_id", "lang", *base, *CLASSES, F.when(n >= min_words, distance(F.concat(shares, rest))).alias("word_distance")), "counts")
    df = joined(df, class_references(df))
    total = sum(F.col(c) for c in CLASSES)
    chars = F.zip_with(F.array(*(F.col(c) / total for c in CLASSES)), "ref_classes", lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    df = df.withColumn("char_distance", F.when(n >= min_words, distance(chars)))
    failed = (n < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * n)
    near = F.coalesce(F.col("char_distance") <= max_chars, F.lit(True)) & F.coalesce(F.col("word_distance") <= max_words, F.lit(True))
    return df.select("doc_id", *base, failed.alias("base_failed"), (~failed & near).alias("kept"), "char_distance", "word_distance")
