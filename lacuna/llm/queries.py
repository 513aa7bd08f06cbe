"""The registered queries of this package: each applies one operator to its whole table and derives digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def span_digest(found: DataFrame, base: tuple[str, ...], counted: tuple[str, ...]) -> DataFrame:
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in counted),
        F.sha2(joined_spans(of(*base)), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.llm.secret_scan import scan_secrets

    kinds = ("assign", "access", "hex")
    return span_digest(scan_secrets(table(spark, sf_dir, "documents")), kinds, kinds)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_secret_scan": op2_secret_scan}
ORACLE_SQL: dict[str, str] = {}


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.llm.quality_rules import judge

    rows = judge(table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


QUERIES["op3_quality_rules"] = op3_quality_rules
ORACLE_SQL["op3_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, regexp_replace(t, '\p{L}+', '', 'g') AS rest FROM d),
f AS (SELECT uid, doc_id, lang, words, len(words) AS n, length(t) - length(rest) AS letters,
  length(rest) - length(regexp_replace(rest, '[0-9]+', '', 'g')) AS digits, length(rest) - length(regexp_replace(rest, '[\x20\x09-\x0D]+', '', 'g')) AS white,
  length(rest) - length(regexp_replace(rest, '[.,;:!?''"()-]+', '', 'g')) AS points, length(rest) - length(regexp_replace(rest, '[#*$%&|<>]+', '', 'g')) AS symbols,
  length(rest) AS n_rest, length(t) AS n_chars, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
win AS (SELECT uid, i, words[i:i + 7] AS g FROM (SELECT uid, words, unnest(range(1, n - 6)) AS i FROM f WHERE n >= 8)),
dup AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT uid, count(DISTINCT i + k) AS n_repeat FROM dup, range(0, 8) r(k) GROUP BY uid),
tok AS (SELECT uid, lang, unnest(words) AS word FROM f),
tot AS (SELECT lang, count(*) AS total FROM tok GROUP BY lang),
ref AS (SELECT lang, word, c / total AS q FROM (SELECT lang, word, count(*) AS c, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM tok GROUP BY lang, word) JOIN tot USING (lang) WHERE r <= 48),
own AS (SELECT uid, word, count(*) AS c FROM tok GROUP BY uid, word),
pq AS (SELECT f.uid, coalesce(own.c, 0) / f.n AS p, ref.q FROM f JOIN ref ON ref.lang = f.lang LEFT JOIN own ON own.uid = f.uid AND own.word = ref.word WHERE f.n >= 50),
whole AS (SELECT uid, p, q FROM pq UNION ALL SELECT uid, 1 - sum(p), greatest(1 - sum(q), 0) FROM pq GROUP BY uid),
cls AS (SELECT lang, sum(letters) AS a, sum(digits) AS b, sum(white) AS c, sum(points) AS d, sum(symbols) AS e, sum(n_rest - digits - white - points - symbols) AS g FROM f GROUP BY lang),
chr6 AS (SELECT f.uid, unnest([letters, digits, white, points, symbols, n_rest - digits - white - points - symbols]) / n_chars AS p, unnest([a, b, c, d, e, g]) / (a + b + c + d + e + g) AS q FROM f JOIN cls USING (lang) WHERE n >= 50),
jsd AS (SELECT kind, uid, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS v FROM (SELECT 'c' AS kind, * FROM chr6 UNION ALL SELECT 'w', * FROM whole) GROUP BY kind, uid),
j AS (SELECT f.*, coalesce(n_repeat, 0) AS n_repeat, c.v AS cv, w.v AS wv, n < 20 OR 100 * coalesce(n_repeat, 0) > 30 * n AS failed FROM f LEFT JOIN rep USING (uid) LEFT JOIN jsd c ON c.kind = 'c' AND c.uid = f.uid LEFT JOIN jsd w ON w.kind = 'w' AND w.uid = f.uid)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_chars - white AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words,
  failed AS base_failed, NOT failed AND coalesce(cv <= 0.2, true) AND coalesce(wv <= 0.42, true) AS kept, round(cv, 6) AS char_distance, round(wv, 6) AS word_distance FROM j
"""


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.llm.pii import BASE, find_pii

    return span_digest(find_pii(table(spark, sf_dir, "documents")), BASE, BASE)


QUERIES["op6_pii"] = op6_pii


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op5_simhash"] = op5_simhash


def op4_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.llm.interpolation import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


QUERIES["op4_interpolation"] = op4_interpolation


def op1_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.llm.quality_bayes import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op1_quality_bayes"] = op1_quality_bayes


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op10_decontaminate"] = op10_decontaminate


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


QUERIES["op9_html_extract"] = op9_html_extract


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.llm.language_crf import identify

    return identify(table(spark, sf_dir, "documents"))


QUERIES["op8_language_crf"] = op8_language_crf

#: Where the public vocabulary lies; a parameter of the operators.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.llm.pieces import encode

    both = encode(table(spark, sf_dir, "documents"), VOCABULARY, decoded=True)
    return both.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == F.col("text")).alias("lossless"))


QUERIES["op7_pieces"] = op7_pieces


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.llm.toxicity import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op11_toxicity"] = op11_toxicity


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with faults: by the crc32 of ``conv_id:turn`` mod 20 dropped, emptied, cut, repeated or given to the user."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", own("conv_id"), own("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(own("text"), "[.!?]", "")).otherwise(own("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(own("role"))
    rows = turns.withColumn("fault", fault).where(F.col("fault") != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), "fault")
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.llm.conversations import repair, repaired_hash

    turns = table(spark, sf_dir, "conversations")
    plan, repaired = repair(damaged(turns))
    rows = plan.join(repaired_hash(repaired), "key", "left")
    out = turns.select("conv_id").distinct().join(rows, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = {"gaps": "gaps", "blank": "n_blank", "duplicate": "n_duplicate", "truncated": "n_truncated", "illegal": "n_illegal", "cost": "cost"}
    return out.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in counts.items()),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES["op12_conversation_repair"] = op12_conversation_repair
ORACLE_SQL["op12_conversation_repair"] = r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::UBIGINT)), lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), list_transform(range(8), lambda z: z::UBIGINT)), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)), 4294967295::UBIGINT) % 20 AS f FROM src),
dam AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc WHERE f <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS r, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM dam),
nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM num),
cls AS (SELECT *, NOT blank AND nth > 1 AS dup, NOT blank AND nth = 1 AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM nth),
agg AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (before IS NOT NULL AND concat(before, r) NOT IN ('su', 'ua', 'au')) AS illegal FROM cls GROUP BY conv_id),
dp AS (SELECT conv_id, n, 0::BIGINT AS i, [{'c': 0::BIGINT, 'a': '', 't': ''}, {'c': 5::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}, {'c': 1000000000::BIGINT, 'a': '', 't': ''}, {'c': 1000000000::BIGINT, 'a': '', 't': ''}] AS s FROM agg
  UNION ALL SELECT conv_id, n, i, [p[1], list_min([p[2], {'c': p[1].c + 5, 'a': p[1].a || 'I', 't': p[1].t || chr(10) || 'user:'}, {'c': p[3].c + 5, 'a': p[3].a || 'I', 't': p[3].t || chr(10) || 'user:'}, {'c': p[4].c + 5, 'a': p[4].a || 'I', 't': p[4].t || chr(10) || 'user:'}]), list_min([p[3], {'c': p[2].c + 5, 'a': p[2].a || 'I', 't': p[2].t || chr(10) || 'assistant:'}]), p[4]] FROM (
    SELECT d.conv_id, d.n, d.i + 1 AS i, [
      {'c': s[1].c + 2, 'a': s[1].a || 'D', 't': s[1].t},
      list_min([{'c': s[2].c + 2, 'a': s[2].a || 'D', 't': s[2].t}] || list_transform([s[1], s[3], s[4]], lambda x: {'c': x.c + CASE WHEN blank OR dup THEN 1000000000 ELSE (r <> 'u')::BIGINT + 5 * cut::BIGINT END, 'a': x.a || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END, 't': x.t || chr(10) || CASE WHEN r = 'u' THEN role ELSE 'user' END || ':' || text})),
      list_min([{'c': s[3].c + 2, 'a': s[3].a || 'D', 't': s[3].t}, {'c': s[2].c + CASE WHEN blank OR dup THEN 1000000000 ELSE (r <> 'a')::BIGINT + 5 * cut::BIGINT END, 'a': s[2].a || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END, 't': s[2].t || chr(10) || CASE WHEN r = 'a' THEN role ELSE 'assistant' END || ':' || text}]),
      list_min([{'c': s[4].c + 2, 'a': s[4].a || 'D', 't': s[4].t}, {'c': s[1].c + CASE WHEN blank OR dup OR r <> 's' THEN 1000000000 ELSE 5 * cut::BIGINT END, 'a': s[1].a || 'K', 't': s[1].t || chr(10) || role || ':' || text}])] AS p
    FROM dp d JOIN cls x ON x.conv_id IS NOT DISTINCT FROM d.conv_id AND x.i = d.i + 1)),
fin AS (SELECT conv_id, list_min([s[1], s[3]]) AS b FROM dp WHERE i = n),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(substr(coalesce(b.t, ''), 2)) AS repaired_sha256
FROM ids LEFT JOIN agg ON agg.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES["op13_hard_negatives"] = op13_hard_negatives
ORACLE_SQL["op13_hard_negatives"] = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT pos.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
