"""The registered queries of the core library, each with DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.rules import BUILTIN, LABELS, ORDER, custom_rule, rules_from
from lacuna.operators import crypto, edits, gate, records, redact, search, spans, stretches
from lacuna.operators.company import company_spans
from lacuna.operators.detect import count_by_type, detect, exploded, type_report
from lacuna.operators.keywords import keyword_matches
from lacuna.plans.contracts import CONTRACTS, contracts, truth_sql
from lacuna.sources import documents as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RULES = {r.type: r for r in BUILTIN}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def spans_sql(pattern: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """All matches of a pattern with their places, from the texts between them."""
    p = pattern.replace("'", "''")
    return f"""SELECT {key}, text, v[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start
      FROM (SELECT {key}, text, v, g, unnest(range(1, len(v) + 1)) AS i FROM (SELECT {key}, {text} AS text, regexp_extract_all({text}, '{p}') AS v, string_split_regex({text}, '{p}') AS g FROM {table}))"""


EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
IP = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
PHONE = r"(?:\+?86[-.\s]?)?(?:1[3-9]\d{9}|0\d{2,4}[-.\s]?\d{7,8})"
CARD = r"[0-9]\d{4}\s?\d{4}\s?\d{4}\s?\d{3,8}"
C = f"(WITH c AS ({CONTRACTS}) SELECT * FROM c)"
TRUTH = truth_sql()
ROWS = 'doc_id, value, start, CAST(start + length(value) AS INTEGER) AS "end"'


def single(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return exploded(detect(docs(spark, sf_dir), rules=[RULES[kind]])).select("doc_id", "value", "start", "end")


# Detection


@query(f"SELECT 'EMAIL' AS type, count(*) AS n FROM ({spans_sql(EMAIL)}) UNION ALL SELECT 'IP', count(*) FROM ({spans_sql(IP)})")
def detect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_type(detect(docs(spark, sf_dir), rules=[RULES["EMAIL"], RULES["IP"]]))


@query(f"SELECT {ROWS} FROM ({spans_sql(EMAIL)})")
def detect_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir, "EMAIL")


@query(f"SELECT {ROWS} FROM ({spans_sql(IP)})")
def detect_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir, "IP")


@query(f"SELECT {ROWS} FROM ({spans_sql(PHONE)}) WHERE NOT (start > 0 AND regexp_matches(substring(text, start, 1), '\\d')) AND NOT regexp_matches(substring(text, start + length(value) + 1, 1), '\\d') AND NOT regexp_matches(value, '^\\+?86[-.\\s]?(1[3-9]\\d{{9}}|0\\d{{2,4}}[-.\\s]?\\d{{7,8}})$')")
def detect_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir, "PHONE")


@query(rf"""SELECT {ROWS} FROM ({spans_sql(CARD)}) WHERE NOT (length(value) >= 17 AND regexp_matches(value, '^[1-9]\d{{5}}(?:18|19|20)\d{{2}}')) AND NOT (length(value) BETWEEN 17 AND 19 AND regexp_matches(value, '^9[123]\d+$'))
  AND NOT regexp_matches(substring(text, greatest(start - 30, 0) + 1, start - greatest(start - 30, 0)), '\.com/|\.cn/|/article/|\.html|\.asp|\.aspx|https?:|\.org/|\.net/')
  AND NOT (length(value) = 16 AND (value LIKE '0%' OR regexp_matches(substring(text, start + length(value) + 1, 1), '[\dXx]')))""")
def detect_bank_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(spark, sf_dir, "BANK_CARD")


@query(TRUTH)
def detect_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules, filters and the merge on contracts, held against the parts that the contracts were made of."""
    return exploded(detect(contracts(spark, sf_dir).select("doc_id", "text"))).select("doc_id", "type", "value", "start", "end")


@query()
def detect_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "html")
    return exploded(detect(pages, "html", rules=[RULES["URL"]]), "page_id").select("page_id", "value", "start", "end")


@query(f"SELECT {ROWS} FROM ({spans_sql('token')})")
def detect_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(detect(docs(spark, sf_dir), rules=[], keywords=["token", ""])).select("doc_id", "value", "start", "end")


@query(f"SELECT {ROWS} FROM ({spans_sql('(?i)token = .[0-9a-f]+')})")
def detect_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(detect(docs(spark, sf_dir), rules=[custom_rule("token = .[0-9a-f]+")])).select("doc_id", "value", "start", "end")


@query(f"SELECT doc_id, start, concat('...', substring(text, greatest(start - 30, 0) + 1, start + 30 - greatest(start - 30, 0)), '...') AS context FROM ({spans_sql(EMAIL)})")
def detect_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(detect(docs(spark, sf_dir), rules=[RULES["EMAIL"]])).select("doc_id", "start", "context")


@query(f"SELECT doc_id, type, count(*) AS n FROM ({TRUTH}) WHERE type IN ('ID_CARD', 'EMAIL', 'NAME') GROUP BY ALL")
def count_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_type(detect(contracts(spark, sf_dir).select("doc_id", "text"), rules=[RULES[k] for k in ("ID_CARD", "EMAIL", "NAME")]), "doc_id")


_PLACE = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(ORDER))
_LABEL = " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in LABELS.items())


@query(f"SELECT type, CASE type {_LABEL} END AS label, count(*) AS n, CAST(CASE type {_PLACE} ELSE 999 END AS INTEGER) AS rank FROM ({TRUTH}) WHERE type IN ('EMAIL', 'BANK_LABEL', 'TAX_ID') GROUP BY type")
def report_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_report(detect(contracts(spark, sf_dir).select("doc_id", "text"), rules=[RULES[k] for k in ("EMAIL", "BANK_LABEL", "TAX_ID")]))


# Spans


@query(f"SELECT {ROWS} FROM ({spans_sql(EMAIL)}) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def span_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.select_matches(single(spark, sf_dir, "EMAIL"), read(spark, sf_dir, "labels").where("quality = 1"), ("doc_id",))


@query(f"SELECT {ROWS} FROM ({spans_sql(EMAIL)}) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def span_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_matches(single(spark, sf_dir, "EMAIL"), read(spark, sf_dir, "labels").where("quality = 1"), ("doc_id",))


def overlapping_sql(word: str) -> str:
    return f"SELECT doc_id, text, CAST(i AS INTEGER) AS start FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - {len(word) - 1}, 0))) AS i FROM documents WHERE contains(text, '{word}')) WHERE substring(text, i + 1, {len(word)}) = '{word}'"


@query(f"SELECT doc_id, 'anan' AS value, start, CAST(start + 4 AS INTEGER) AS \"end\" FROM ({overlapping_sql('anan')})")
def span_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spans.manual_matches(docs(spark, sf_dir).withColumn("phrase", F.lit("anan")), "phrase")
    return exploded(df, matches="manual").select("doc_id", "value", "start", "end")


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return single(spark, sf_dir, "EMAIL"), exploded(detect(docs(spark, sf_dir), rules=[], keywords=["mail"])).select("doc_id", "value", "start", "end")


_E, _M = f"(SELECT {ROWS} FROM ({spans_sql(EMAIL)}))", f"(SELECT {ROWS} FROM ({spans_sql('mail')}))"
_CLASH = 'e.doc_id = m.doc_id AND e.start < m."end" AND e."end" > m.start'


@query(f"SELECT * FROM {_E} e WHERE NOT EXISTS (SELECT 1 FROM {_M} m WHERE {_CLASH}) UNION ALL SELECT * FROM {_M}")
def span_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _hits(spark, sf_dir)
    return spans.override_rows(old, new)


@query(f"SELECT * FROM {_M} m WHERE NOT EXISTS (SELECT 1 FROM {_E} e WHERE {_CLASH})")
def span_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, hits = _hits(spark, sf_dir)
    return spans.protect_rows(hits, old)


@query(f"SELECT doc_id, value, array_to_string(list_sort(list(start)), ',') AS positions, count(*) AS n FROM {_E} GROUP BY ALL")
def span_group_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.group_hits(single(spark, sf_dir, "EMAIL")).withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


_I = "SELECT l_orderkey AS doc_id, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS s, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INTEGER) AS INTEGER) AS e FROM lineitem"


@query(f"WITH i AS ({_I}), f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM f) SELECT doc_id, min(s) AS start, max(e) AS \"end\" FROM g GROUP BY doc_id, n")
def span_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), day.alias("start"), (day + F.col("l_quantity").cast("int")).alias("end"))
    return spans.merge_intervals(rows)


@query(f"SELECT count(*) AS n_spans, CAST(0 AS BIGINT) AS n_bad FROM ({spans_sql(EMAIL)})")
def span_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detect(docs(spark, sf_dir), rules=[RULES["EMAIL"]])
    ok = F.forall("matches", lambda m: F.substring(F.col("text"), m["start"] + 1, m["end"] - m["start"]) == m["value"])
    return df.agg(F.sum(F.size("matches")).cast("long").alias("n_spans"), F.count_if(~ok).alias("n_bad"))


@query(f"WITH m AS (SELECT doc_id, start, start + length(value) AS e FROM ({spans_sql(EMAIL)})), p AS (SELECT doc_id, 'match' AS kind, start AS s, e FROM m UNION ALL SELECT doc_id, 'text', coalesce(lag(e) OVER w, 0), start FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY start) UNION ALL SELECT d.doc_id, 'text', coalesce((SELECT max(e) FROM m WHERE m.doc_id = d.doc_id), 0), length(text) FROM documents d) SELECT doc_id, kind, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\" FROM p WHERE e > s")
def span_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detect(docs(spark, sf_dir), rules=[RULES["EMAIL"]])
    return df.select("doc_id", F.explode_outer(spans.highlight_parts(F.col("text"), F.col("matches"))).alias("p")).where("p is not null").select("doc_id", "p.kind", "p.start", "p.end")


@query("WITH b AS (SELECT doc_id, text, unnest([0, 500, 1500]) AS a FROM documents), c AS (SELECT doc_id, text, a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), length(text)) AS e FROM b WHERE a = 0 OR a < length(text)) SELECT doc_id, CAST(a AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", md5(substring(text, a + 1, e - a)) AS digest FROM c")
def span_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detect(docs(spark, sf_dir), rules=[RULES["EMAIL"]])
    cuts = F.array(*(F.lit(float(x)) for x in (1500.5, 500.0, -3.0, 500.9, 1e12)))
    one = df.select("doc_id", F.explode_outer(spans.segment_text(F.col("text"), F.col("matches"), cuts)).alias("x")).where("x is not null")
    return one.select("doc_id", "x.start", "x.end", F.md5(F.col("x.text").cast("binary")).alias("digest"))


_RUNS = "SELECT conv_id AS doc_id, turn AS idx, text, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM conversations"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text")


@query(f"SELECT doc_id, idx, start, CAST(start + length(text) AS INTEGER) AS \"end\" FROM ({_RUNS})")
def runs_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.runs_with_offsets(runs(spark, sf_dir)).select("doc_id", "idx", "start", "end")


@query(f"WITH r AS ({_RUNS}), w AS (SELECT doc_id, string_agg(text, '' ORDER BY idx) AS text FROM r GROUP BY doc_id), f AS ({spans_sql('tion', 'w')}) SELECT f.doc_id, f.start, CASE WHEN count(*) = 1 THEN min(r.idx) END AS run_idx FROM f JOIN r ON f.doc_id = r.doc_id AND r.start < f.start + 4 AND r.start + length(r.text) > f.start GROUP BY f.doc_id, f.start")
def runs_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.locate_token(runs(spark, sf_dir), "tion")


@query(f"WITH p AS (SELECT * FROM ({_RUNS})), h AS (SELECT doc_id, CAST(start + 3 AS INTEGER) AS s, CAST(start + length(text) + 2 AS INTEGER) AS e, idx FROM p WHERE idx % 2 = 0) SELECT p.doc_id, p.idx AS part_idx, count(*) AS n, CAST(sum(least(h.e, p.start + length(p.text)) - greatest(h.s, p.start)) AS BIGINT) AS covered FROM p JOIN h ON h.doc_id = p.doc_id AND h.s < p.start + length(p.text) AND h.e > p.start WHERE length(p.text) > 5 AND h.e > h.s GROUP BY ALL")
def span_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = spans.runs_with_offsets(runs(spark, sf_dir))
    parts = placed.where(F.length("text") > 5).select("doc_id", F.col("idx").alias("part_idx"), "start", "end")
    found = placed.where(F.col("idx") % 2 == 0).select("doc_id", F.col("idx").cast("int").alias("index"), (F.col("start") + 3).alias("start"), (F.col("end") + 2).alias("end")).where("end > start")
    cut = spans.slice_parts(parts, found).where("hit is not null")
    return cut.groupBy("doc_id", "part_idx").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("covered"))


@query(f"SELECT doc_id, CAST(start - length(regexp_extract(substring(text, 1, start), '([ \\t]*)$', 1)) AS INTEGER) AS start, CAST(start + length(value) + length(regexp_extract(substring(text, start + length(value) + 1), '^([ \\t]*)', 1)) AS INTEGER) AS \"end\" FROM ({spans_sql(EMAIL)})")
def span_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detect(docs(spark, sf_dir), rules=[RULES["EMAIL"]]).select("doc_id", "text", F.explode_outer("matches").alias("m")).where("m is not null")
    return df.select("doc_id", spans.expand_over_padding(F.col("text"), F.col("m.start"), F.col("m.end")).alias("x")).select("doc_id", "x.start", "x.end")


# Search


@query("SELECT doc_id, CAST(i AS INTEGER) AS start, substring(text, i + 1, 4) AS value, CASE WHEN i >= 30 THEN '…' || substring(text, i - 28, 29) ELSE substring(text, 1, i) END AS before FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 3, 0))) AS i FROM documents WHERE contains(lower(text), 'anan')) WHERE lower(substring(text, i + 1, 4)) = 'anan'")
def search_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = search.search(docs(spark, sf_dir), "AnAn").select("doc_id", F.explode_outer("hits").alias("h")).where("h is not null")
    return df.select("doc_id", "h.start", "h.value", F.col("h.contextBefore").alias("before"))


@query(f"WITH h AS (SELECT doc_id, CAST(i AS INTEGER) AS s FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 3, 0))) AS i FROM documents WHERE contains(lower(text), 'mail')) WHERE lower(substring(text, i + 1, 4)) = 'mail'), k AS (SELECT h.*, EXISTS (SELECT 1 FROM {_E} e WHERE e.doc_id = h.doc_id AND e.start < h.s + 4 AND e.\"end\" > h.s) AS held FROM h) SELECT d.doc_id, count(s) FILTER (NOT held) AS n_added, count(s) FILTER (held) AS n_skipped FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id")
def search_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_and_add(detect(docs(spark, sf_dir), rules=[RULES["EMAIL"]]), "mail").select("doc_id", "n_added", "n_skipped")


# Redaction and restore

SOME = ("EMAIL", "ID_CARD", "TAX_ID")


def some(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(contracts(spark, sf_dir).select("doc_id", "text"), rules=[RULES[k] for k in SOME])


def _replaced(email: str, card: str, tax: str) -> str:
    return f"replace(replace(replace(text, '邮箱：' || email, '邮箱：' || {email}), '身份证：' || id_card, '身份证：' || {card}), '代码：' || tax_id, '代码：' || {tax})"


_TOKENS = [f"repeat('_', 8) || repeat(chr(8203), {i + 1})" for i in range(3)]


@query(f"SELECT doc_id, {_replaced(*_TOKENS)} AS redacted_text FROM {C}")
def redact_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redact(some(spark, sf_dir)).select("doc_id", "redacted_text")


@query(f"WITH r AS (SELECT *, {_replaced(*_TOKENS)} AS t FROM {C}), m AS (SELECT doc_id, 0 AS idx, 'EMAIL' AS type, email AS original, instr(t, '邮箱：') + 2 AS s, 9 AS n FROM r UNION ALL SELECT doc_id, 1, 'ID_CARD', id_card, instr(t, '身份证：') + 3, 10 FROM r UNION ALL SELECT doc_id, 2, 'TAX_ID', tax_id, instr(t, '代码：') + 2, 11 FROM r) SELECT doc_id, idx, type, original, CAST(s AS INTEGER) AS start, CAST(s + n AS INTEGER) AS \"end\" FROM m")
def redact_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = redact.redact(some(spark, sf_dir)).select("doc_id", F.explode_outer("mapping").alias("m")).where("m is not null")
    return df.select("doc_id", "m.idx", "m.type", F.col("m.originalValue").alias("original"), "m.start", "m.end")


@query(ORACLE_SQL["redact_mapping"])
def redact_mapping_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretches.redact_long(some(spark, sf_dir)).select("doc_id", "idx", "type", F.col("originalValue").alias("original"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query(f"SELECT doc_id, {_replaced(*(repr(f'[{k}_000{i + 1}]') for i, k in enumerate(SOME)))} AS redacted_text FROM {C}")
def redact_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redact_typed(some(spark, sf_dir)).select("doc_id", "redacted_text")


def _by_stretches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Contracts in stretches of 64 code points, redacted; and the entries."""
    path = sources.shared_folder(spark, "found")
    bare = F.transform("matches", lambda m: m.dropFields("context"))  # not used again
    some(spark, sf_dir).select("doc_id", "text", bare.alias("matches")).write.parquet(path)
    found = spark.read.parquet(path)
    entries = stretches.array_entries(found, token=lambda m, i: redact.type_token(m["type"], i + 1))
    return stretches.redacted_by(stretches.text_stretches(found, size=64), entries)


@query(ORACLE_SQL["redact_types"])
def redact_by_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretches.assembled(_by_stretches(spark, sf_dir)[0]).select(F.col("id").alias("doc_id"), F.col("text").alias("redacted_text"))


@query(f"SELECT doc_id, text FROM {C}")
def restore_by_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretches.assembled(stretches.restore_stretches(*_by_stretches(spark, sf_dir))).select(F.col("id").alias("doc_id"), "text")


@query(f"SELECT doc_id, {_replaced(*(f'repeat(chr(95), length({c}))' for c in ('email', 'id_card', 'tax_id')))} AS redacted_text FROM {C}")
def redact_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redact_same_length(some(spark, sf_dir)).select("doc_id", "redacted_text")


_MASKS = ("left(email, 2) || '***@example.com'", "left(id_card, 6) || '********' || right(id_card, 4)", "'[税号]'")


@query(f"SELECT doc_id, {_replaced(*_MASKS)} AS redacted_text FROM {C}")
def redact_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redact_masked(some(spark, sf_dir)).select("doc_id", "redacted_text")


@query(f"SELECT type, count(*) AS n, min(mask) AS lowest, max(mask) AS highest FROM (SELECT type, CASE type WHEN 'PHONE' THEN left(value, 3) || '****' || right(value, 4) WHEN 'EMAIL' THEN left(value, 2) || '***@example.com' WHEN 'ID_CARD' THEN left(value, 6) || '********' || right(value, 4) WHEN 'BANK_CARD' THEN left(value, 4) || ' **** **** ' || right(value, 4) WHEN 'IP' THEN regexp_replace(value, '\\.[^.]*$', '') || '.*.*' WHEN 'AMOUNT' THEN '¥****' WHEN 'AMOUNT_UPPER' THEN '¥****' WHEN 'ADDRESS' THEN '[地址]' WHEN 'COMPANY' THEN '[公司名称]' WHEN 'NAME' THEN '[姓名]' WHEN 'CONTRACT_NO' THEN '[合同号]' WHEN 'PROJECT_NAME' THEN '[项目名称]' WHEN 'TAX_ID' THEN '[税号]' WHEN 'URL' THEN '[网址]' WHEN 'BANK_LABEL' THEN '[开户银行]' END AS mask FROM ({TRUTH})) GROUP BY type")
def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts(spark, sf_dir).createOrReplaceTempView("c")
    arms = truth_sql().split(") o) o\n) ", 1)[1]
    values = spark.sql(arms.replace('"end"', "`end`").replace("length(", "char_length("))
    masked = values.select("type", redact.partial_mask(F.col("type"), F.col("value")).alias("mask"))
    return masked.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("mask").alias("lowest"), F.max("mask").alias("highest"))


@query(f"SELECT doc_id, sha256(text) AS source_hash, sha256({_replaced(*_TOKENS)}) AS redacted_hash FROM {C}")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = redact.redact(some(spark, sf_dir))
    return df.select("doc_id", redact.content_hash(F.col("text")).alias("source_hash"), redact.content_hash(F.col("redacted_text")).alias("redacted_hash"))


@query(f"SELECT doc_id, text AS restored_text FROM {C}")
def restore_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.restore(redact.redact(some(spark, sf_dir))).select("doc_id", "restored_text")


@query("SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS n_bad FROM documents")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules on all documents, redacted and restored; no row may differ."""
    df = redact.round_trip(redact.redact(detect(docs(spark, sf_dir))))
    return df.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(~F.col("round_trip_ok")).alias("n_bad"))


@query("SELECT doc_id, concat(substring(text, 1, 5), '[cut]', substring(text, 11)) AS cut, replace(text, 'the', '***') AS replaced FROM documents")
def replace_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", redact.replace_range(t, F.lit(5), F.lit(10), F.lit("[cut]")).alias("cut"), redact.replace_all(t, F.lit("the"), F.lit("***")).alias("replaced"))


# Edits


@query(f"SELECT doc_id, replace(replace(text, '电话：' || phone, '电话：<tel>'), '邮箱：' || email, '邮箱：<mail>') AS edited FROM {C}")
def edit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = contracts(spark, sf_dir)
    pairs = F.array(F.struct(F.col("phone").alias("token"), F.lit("<tel>").alias("value")), F.struct(F.col("email").alias("token"), F.lit("<mail>").alias("value")))
    return edits.apply_edits(df.select("doc_id", "text", pairs.alias("edits"))).select("doc_id", "edited")


@query(f"WITH r AS ({_RUNS}) SELECT doc_id, idx, CASE WHEN length(text) > 4 THEN '<' || idx || '>' || substring(text, 5) ELSE text END AS text FROM r")
def edit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = spans.runs_with_offsets(runs(spark, sf_dir))
    some_edits = placed.where(F.length("text") > 4).select("doc_id", "start", (F.col("start") + 4).alias("end"), F.concat(F.lit("<"), F.col("idx").cast("string"), F.lit(">")).alias("value"))
    return edits.spread_over_runs(placed, some_edits)


# Encryption


@query()
def encrypt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings sealed with one salt and IV of each row's own, opened with the right and with a wrong password."""
    df = redact.redact(some(spark, sf_dir)).select("doc_id", "mapping")
    iv = F.unhex(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 24))
    sealed = crypto.encrypt_mapping(df, "correct horse", salt=F.lit(b"0123456789abcdef"), iv=iv)
    opened = crypto.decrypt_mapping(sealed, "correct horse", "opened")
    wrong = crypto.decrypt_mapping(opened, "wrong horse", "wrong")
    return wrong.select("doc_id", (F.col("opened") == F.col("mapping")).alias("round_trip_ok"), F.col("wrong").isNull().alias("wrong_fails"), F.size("mapping").cast("long").alias("n_entries"))


@query(f"SELECT doc_id, hex(text) AS data, '<meta>' AS opening FROM {C}")
def meta_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = contracts(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("data"))
    made = df.select("doc_id", crypto.meta_envelope(F.lit('a<b>:"c".docx'), F.lit(b"salt"), F.lit(b"iv"), F.col("data")).alias("m"))
    return made.select("doc_id", F.hex(crypto.parse_meta(F.col("m"))["data"]).alias("data"), F.substring("m", 1, 6).alias("opening"))


# Records, audit, settings

_STATE = "CASE o_orderstatus WHEN 'F' THEN 'restored' WHEN 'O' THEN 'active' ELSE 'deleted' END"


def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("contract "), F.col("o_custkey").cast("string"), F.lit("_脱敏.docx")).alias("file_name"), F.expr(_STATE).alias("status"))


@query(f"SELECT count(*) AS total, count(*) FILTER (s = 'restored') AS restored, count(*) FILTER (s = 'active') AS active FROM (SELECT {_STATE} AS s FROM orders)")
def record_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_stats(record_rows(spark, sf_dir))


@query(f"SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE {_STATE} = 'active'")
def record_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.list_records(record_rows(spark, sf_dir), "active").select("id", "created_at")


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'restored' ELSE {_STATE} END AS status FROM orders")
def record_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record_rows(spark, sf_dir)
    return records.update_status(rows, rows.where("id % 7 = 0").select("id", F.lit("restored").alias("status"))).select("id", "status")


@query(f"SELECT o_orderkey AS id, {_STATE} AS status FROM orders WHERE o_custkey % 3 <> 0")
def record_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record_rows(spark, sf_dir)
    gone = read(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    return records.delete_records(rows, gone, hard=True).select("id", "status")


@query(f"WITH f AS (SELECT 'contract ' || s_suppkey || '.pdf' AS file_name, 'contract ' || s_suppkey AS f FROM supplier), r AS (SELECT o_orderkey AS id, 'contract ' || o_custkey AS r FROM orders WHERE {_STATE} = 'active'), p AS (SELECT f.file_name, r.id FROM f LEFT JOIN r ON contains(f.f, r.r) OR contains(r.r, f.f)) SELECT file_name, id, count(id) OVER (PARTITION BY file_name) AS n_matches FROM p")
def record_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "supplier").select(F.concat(F.lit("contract "), F.col("s_suppkey").cast("string"), F.lit(".pdf")).alias("file_name"))
    return records.match_records(files, record_rows(spark, sf_dir)).select("file_name", "id", "n_matches")


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("action"), F.col("user_id").alias("file_id"))


@query("SELECT event_id AS id, ts AS timestamp, user_id AS file_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id LIMIT 100")
def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit_rows(spark, sf_dir)
    return records.query_audit(rows, action=rows.agg(F.min("action")).first()[0]).select("id", "timestamp", "file_id")


@query("SELECT event_type AS key, CAST(user_id AS VARCHAR) AS value, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, CAST(user_id AS VARCHAR) DESC) AS n FROM events) WHERE n = 1")
def settings_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("value"), "ts", "event_id")
    return records.upsert_settings(rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1").drop("event_id"))


# Gate and dictionary

_GATE = "CASE " + " ".join("WHEN regexp_matches(line, '{}') THEN '{}'".format(p.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b"), n) for n, p in gate.PATTERNS) + " END"
_LINES = "SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM {})"


@query(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, pattern, substring(line, 1, 80) AS match FROM (SELECT *, {_GATE} AS pattern FROM ({_LINES.format('documents')})) WHERE pattern IS NOT NULL")
def gate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate_lines(docs(spark, sf_dir))


@query(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, pattern, substring(line, 1, 80) AS match FROM (SELECT *, {_GATE} AS pattern FROM ({_LINES.format(C)})) WHERE pattern IS NOT NULL")
def gate_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate_lines(contracts(spark, sf_dir).select("doc_id", "text"))


@query(f"WITH h AS (SELECT doc_id, count(*) AS n FROM (SELECT *, {_GATE} AS pattern FROM ({_LINES.format('documents')})) WHERE pattern IS NOT NULL GROUP BY doc_id) SELECT d.doc_id, coalesce(n, 0) AS hits, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM documents d LEFT JOIN h USING (doc_id)")
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate_verdict(docs(spark, sf_dir), gate.gate_lines(docs(spark, sf_dir)))


@query("WITH m AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line FROM conversations) SELECT conv_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, 'tion')) AS n_hits FROM m GROUP BY conv_id")
def gate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate on messages, with a pattern of the user's own."""
    messages = read(spark, sf_dir, "conversations")
    lines = gate.lines_of(messages, "conv_id", "text")
    hits = gate.gate_lines(messages, "conv_id", "text", extra=["tion"]).groupBy("conv_id").agg(F.count_if(F.col("pattern") == "tion").alias("n_hits"))
    return lines.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_lines")).join(hits, "conv_id", "left").select("conv_id", "n_lines", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"))


_DIFF = "SELECT conv_id AS file, turn AS idx, CASE WHEN turn % 3 = 0 THEN '@@ -1,2 +' || (turn * 10) || ',2 @@ x' ELSE '+' || role END AS line FROM conversations"


@query("SELECT conv_id AS file, CAST((turn - turn % 3) * 10 + turn % 3 - 1 AS INTEGER) AS line_no, role AS line FROM conversations c WHERE turn % 3 > 0 AND EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - c.turn % 3)")
def gate_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return gate.added_lines(spark.sql(_DIFF))


PAIRS = (("the", "THE"), ("token", "[T]"), ("theheanth", "[long]"), ("THEan", "[seen later]"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(text, 'theheanth', '[long]'), 'token', '[T]'), 'THEan', '[seen later]'), 'the', 'THE')) AS digest FROM documents")
def dictionary_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.apply_dictionary(docs(spark, sf_dir), PAIRS).select("doc_id", F.md5(F.col("scrubbed").cast("binary")).alias("digest"))


@query("""WITH k AS (SELECT list(w ORDER BY length(w) DESC, w) AS ws FROM (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 10))
SELECT doc_id, md5(CASE WHEN text IS NOT NULL THEN list_reduce(list_prepend(text, ws), lambda acc, w: replace(acc, w, '[' || left(w, 2) || ']')) END) AS digest FROM documents, k""")
def dictionary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary made from the benchmark's long words, in one pass over all documents."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("from")).where(F.length("from") >= 10).distinct()
    pairs = words.select("from", F.concat(F.lit("["), F.substring("from", 1, 2), F.lit("]")).alias("to"))
    return gate.apply_dictionary(docs(spark, sf_dir), pairs).select("doc_id", F.md5(F.col("scrubbed").cast("binary")).alias("digest"))


@query(f"WITH t AS (SELECT DISTINCT list_aggregate(string_split(text, ' ')[2:3], 'string_agg', ' ') AS term FROM benchmark) SELECT term, count(line) AS n_lines FROM t LEFT JOIN ({_LINES.format('documents')}) ON contains(line, term) WHERE length(term) > 0 GROUP BY term")
def dictionary_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = read(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 2, 2), " ").alias("term"))
    return gate.residual_counts(docs(spark, sf_dir), terms)


# Sources

_NAME = "concat('File.', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.md' ELSE '_脱敏' END)"


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' END AS format, regexp_replace({_NAME}, '\\.[^.]+$', '') || '_脱敏.txt' AS redacted_name, CASE doc_id % 4 WHEN 0 THEN 'File.' || doc_id || '_restored.txt' WHEN 1 THEN 'File.' || doc_id || '_restored.docx' WHEN 2 THEN {_NAME} ELSE 'File.' || doc_id || '.txt' END AS restored_name FROM documents")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = docs(spark, sf_dir).select("doc_id", F.expr(_NAME).alias("n"))
    n = F.col("n")
    return df.select("doc_id", sources.file_format(F.lit("x/unknown"), n).alias("format"), sources.redacted_name(n).alias("redacted_name"), sources.restored_name(n).alias("restored_name"))


@query("SELECT doc_id, md5(replace(text, ',', ' | ')) AS csv, md5(substring(text, 1, 1000)) AS cut, length(text) > 1000 AS truncated FROM documents")
def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(sources.csv_display_text(t).cast("binary")).alias("csv"), F.md5(search.truncate_text(t, 1000).cast("binary")).alias("cut"), search.is_truncated(t, 1000).alias("truncated"))


@query("WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS sheet, string_agg(v, ' ' ORDER BY l_linenumber, c, v) AS line FROM (SELECT l_orderkey, l_linenumber, 1 AS c, CAST(l_partkey AS VARCHAR) AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 2, CAST(l_suppkey AS VARCHAR) FROM lineitem) GROUP BY ALL) SELECT doc_id, string_agg(line, chr(10) ORDER BY sheet) AS raw_text FROM s GROUP BY doc_id")
def source_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    cell = lambda c, v: F.struct(F.lit(c).alias("col"), v.alias("value"))
    one = rows.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("sheet_idx"), F.col("l_linenumber").alias("row"), F.explode(F.array(cell(1, F.col("l_partkey").cast("string")), cell(2, F.col("l_suppkey").cast("string")), cell(3, F.lit(None).cast("string")))).alias("x"))
    return sources.cells_to_text(one.select("doc_id", "sheet_idx", "row", "x.*"))


@query("SELECT conv_id AS doc_id, trim(string_agg(text, ' ' ORDER BY turn), ' ' || chr(9) || chr(10) || chr(13)) AS raw_text FROM conversations WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 0 GROUP BY conv_id")
def source_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.items_to_text(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.lit(0).alias("idx"), "text"))


@query("SELECT conv_id AS doc_id, string_agg(CASE WHEN turn % 2 = 0 THEN role || chr(10) || text ELSE text END, chr(10) ORDER BY turn) AS raw_text FROM conversations GROUP BY conv_id")
def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = F.col("turn") % 2 == 0
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("path"), F.when(table, "table").otherwise("text").alias("type"), "text", F.array("role", F.lit(""), "text", F.lit("0")).alias("cells"))
    return sources.blocks_to_text(rows)


# Rows that put each operator to work: what a query above leaves empty or constant


@query(f"SELECT {ROWS} FROM ({spans_sql(PHONE, C)}) WHERE NOT (start > 0 AND regexp_matches(substring(text, start, 1), '\\d')) AND NOT regexp_matches(substring(text, start + length(value) + 1, 1), '\\d') AND NOT regexp_matches(value, '^\\+?86[-.\\s]?(1[3-9]\\d{{9}}|0\\d{{2,4}}[-.\\s]?\\d{{7,8}})$')")
def detect_phone_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(detect(contracts(spark, sf_dir).select("doc_id", "text"), rules=[RULES["PHONE"]])).select("doc_id", "value", "start", "end")


_LINKS = "concat('入口 https://h', CAST(c_custkey AS VARCHAR(20)), '.example.org/a/', CAST(c_custkey AS VARCHAR(20)), '，另见 www.site-', CAST(c_custkey AS VARCHAR(20)), '.com.cn/x；或 shop', CAST(c_custkey AS VARCHAR(20)), '.io。邮箱 me@corp', CAST(c_custkey AS VARCHAR(20)), '.com，版本 1.2')"
_URLS = ("'https://h' || k || '.example.org/a/' || k", "'www.site-' || k || '.com.cn/x'", "'shop' || k || '.io'")


@query("SELECT doc_id, value, CAST(instr(text, value) - 1 AS INTEGER) AS start FROM (" + " UNION ALL ".join(f"SELECT doc_id, text, {u} AS value FROM (SELECT c_custkey AS doc_id, CAST(c_custkey AS VARCHAR) AS k, {_LINKS} AS text FROM customer)" for u in _URLS) + ")")
def detect_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with and without a scheme, ended by Chinese punctuation; an address's domain is none."""
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_LINKS).alias("text"))
    return exploded(detect(df, rules=[RULES["URL"]])).select("doc_id", "value", "start")


#: Texts and the company names that they hold, step by step of the filter.
COMPANIES = (
    ("甲方为星河公司有限公司", ("星河公司有限公司",)), ("前后公司公司", ()), ("策划师及其所属公司", ()), ("本公司与关联公司往来", ()), ("甲方公司负责交付", ()),
    ("同时配合集团完成方案", ()), ("星河科技有限公司", ()), ("星河湾区集团是行业巨头", ("星河湾区集团",)), ("这家公司提供咨询服务", ()), ("广州星河数字技术有限公司委托深圳晨光网络科技有限公司承办", ("广州星河数字技术有限公司", "深圳晨光网络科技有限公司")),
    ("经晨光移动通信有限公司同意", ("晨光移动通信有限公司",)), ("应当履行有限公司", ()),
)
_CASE = "CASE c_custkey % " + str(len(COMPANIES)) + " " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _) in enumerate(COMPANIES)) + " END"


@query("SELECT c_custkey AS doc_id, value, start FROM customer JOIN (VALUES " + ", ".join(f"({i}, '{v}', {t.index(v)})" for i, (t, names) in enumerate(COMPANIES) for v in names) + f") x(kind, value, start) ON c_custkey % {len(COMPANIES)} = kind")
def detect_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that the company filter drops, shortens and parts."""
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_CASE).alias("text"))
    return exploded(detect(df, rules=[r for r in BUILTIN if r.type == "COMPANY"])).select("doc_id", "value", "start")


#: Candidates made of parts by the digits of the order's key: what stands before the name, what goes with it, its form.
_BEFORE = ("", "甲方为", "乙方", "经", "因", "同时", "但还", "为", "向", "关联公司", "中国", "（北方")
_WITH = ("", "（中国）", "（", "省新华路", "及其", "所属", "应当", "履行", "连续", "十佳", "并", "数字")
_FORMS = ("有限公司", "公司公司", "集团", "科技有限公司")
_pick = lambda parts, key: f"CASE {key} % {len(parts)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(parts)) + " END"
_CANDIDATES = f"""SELECT o_orderkey AS doc_id, concat(pre, name, own, form) AS value, pre, concat(name, own) AS rest, CASE form WHEN '公司公司' THEN '公司' ELSE form END AS form FROM (
  SELECT o_orderkey, {_pick(_BEFORE, 'o_custkey')} AS pre, {_pick(_WITH, 'CAST(floor(o_orderkey / 4) AS INT)')} AS own, {_pick(_FORMS, 'o_orderkey')} AS form,
    concat(substring('金木水火土日月星', CAST(o_orderkey % 8 AS INT) + 1, 1), substring('海山川江河湖', CAST(o_custkey % 6 AS INT) + 1, 1), substring('东西南北中远宏达', CAST(o_custkey % 8 AS INT) + 1, 1)) AS name
  FROM orders)"""


@query(f"""WITH c AS (SELECT *, CASE WHEN pre IN ('甲方为', '乙方', '经', '因') THEN length(pre) ELSE 0 END AS n_pre, concat(pre, rest) AS body FROM ({_CANDIDATES})),
j AS (SELECT *, substr(body, n_pre + 1) AS kept FROM c),
v AS (SELECT doc_id, n_pre, kept || form AS company, CASE
  WHEN value LIKE '%关联公司%' THEN 'related'
  WHEN length(replace(kept, '（', '')) <> length(replace(kept, '）', '')) THEN 'brackets'
  WHEN regexp_matches(kept, '(省|市|区|县)[一-龥]{{1,10}}(路|街|道|巷|弄)') THEN 'street'
  WHEN regexp_matches(kept, '及其|所属') THEN 'linked'
  WHEN regexp_matches(kept, '^(同时|但还)') THEN 'adverb'
  WHEN regexp_matches(kept, '应当|履行') THEN 'action'
  WHEN regexp_matches(kept, '连续|十佳') THEN 'praise'
  WHEN left(kept, 1) IN ('向', '并', '因', '经') OR right(kept, 1) IN ('并', '向') THEN 'narrative'
  WHEN regexp_matches(kept || form, '^为[一-龥]{{0,4}}(集团|公司)$') THEN 'short'
  WHEN regexp_matches(kept, '为[一-龥]{{0,4}}(集团|公司)$') THEN 'as'
  WHEN regexp_matches(kept || form, '^为[一-龥]{{8,}}(公司|集团)') THEN 'as' END AS why FROM j)
SELECT doc_id, company, CAST(n_pre AS INTEGER) AS start FROM v WHERE why IS NULL""")
def company_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from all orders through the filter: each drop step against its own predicate."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    df = spark.sql(_CANDIDATES).withColumn("x", F.explode_outer(company_spans(F.array("value"))[0])).where("x is not null")
    return df.select("doc_id", F.substring("value", F.col("x.o") + 1, F.col("x.n")).alias("company"), F.col("x.o").alias("start"))


@query(f"SELECT doc_id, 'MAIL' AS type, value, start FROM ({spans_sql('(?i)' + EMAIL)})")
def detect_table_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read from a table; one is switched off, one below the threshold."""
    table = spark.createDataFrame([("MAIL", EMAIL, 0.9, True), ("OFF", "the", 0.9, False), ("WEAK", "and", 0.1, None)], "type string, pattern string, weight double, enabled boolean")
    return exploded(detect(docs(spark, sf_dir), rules=rules_from(table), min_confidence=0.5)).select("doc_id", "type", "value", "start")


@query(" UNION ALL ".join(f"SELECT doc_id, '{w}' AS value, count(*) AS n FROM ({spans_sql(w)}) GROUP BY doc_id" for w in ("token", "mail", "the")))
def detect_many_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long list of keywords, of which some occur."""
    words = ["token", "mail", "the", *(f"no such word {i}" for i in range(60))]
    found = exploded(detect(docs(spark, sf_dir), rules=[], keywords=words))
    return found.groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH k AS (SELECT DISTINCT w AS keyword FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 6)
SELECT doc_id, keyword, CAST((length(text) - length(replace(text, keyword, ''))) / length(keyword) AS BIGINT) AS n, CAST(instr(text, keyword) - 1 AS INTEGER) AS first, CAST(length(text) - length(string_split(text, keyword)[-1]) - length(keyword) AS INTEGER) AS last
FROM documents JOIN k ON contains(text, keyword)""")
def detect_keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of six letters or more of the benchmark, sought in all documents by one automaton."""
    word = F.explode(F.split("text", "[^A-Za-z]+")).alias("keyword")
    words = read(spark, sf_dir, "benchmark").select("item_id", word).where(F.length("keyword") >= 6).groupBy("keyword").agg(F.min("item_id").alias("idx"))
    return keyword_matches(docs(spark, sf_dir), words).groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("start").alias("last"))


_XE, _XM = f"(SELECT {ROWS} FROM ({spans_sql(EMAIL, C)}))", f"(SELECT {ROWS} FROM ({spans_sql('example', C)}))"


def _contract_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = contracts(spark, sf_dir).select("doc_id", "text")
    rows = lambda df: exploded(df).select("doc_id", "value", "start", "end")
    return rows(detect(texts, rules=[RULES["EMAIL"]])), rows(detect(texts, rules=[], keywords=["example"]))


@query(f"SELECT * FROM {_XM} m WHERE NOT EXISTS (SELECT 1 FROM {_XE} e WHERE {_CLASH})")
def span_protect_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two hits in each contract, the one within an address goes and the one within a link stays."""
    old, hits = _contract_hits(spark, sf_dir)
    return spans.protect_rows(hits, old)


@query(f"SELECT doc_id, value, CAST(start + 1 AS INTEGER) AS start FROM ({spans_sql(EMAIL, C)}) WHERE doc_id % 7 = 0")
def span_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans moved by one place in every seventh contract: the audit must list these and no other."""
    df = detect(contracts(spark, sf_dir).select("doc_id", "text"), rules=[RULES["EMAIL"]])
    moved = F.transform("matches", lambda m: m.withField("start", m["start"] + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).withField("end", m["end"] + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)))
    return spans.check_integrity(df.withColumn("matches", moved)).select("doc_id", "value", "start")


@query(f"SELECT doc_id, true AS round_trip_ok, count(*) AS n_spans FROM ({TRUTH}) GROUP BY doc_id")
def round_trip_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seventeen spans of every contract, redacted and restored."""
    df = redact.round_trip(redact.redact(detect(contracts(spark, sf_dir).select("doc_id", "text"))))
    return df.select("doc_id", "round_trip_ok", F.size("mapping").cast("long").alias("n_spans"))


# Encryption

ORACLE_SQL["encrypt_round_trip"] = f"SELECT doc_id, true AS round_trip_ok, true AS wrong_fails, CAST({len(SOME)} AS BIGINT) AS n_entries FROM {C}"
_KEYS = [hashlib.pbkdf2_hmac("sha256", b"correct horse", f"salt of sixteen{i}".encode(), 100_000, 32).hex().upper() for i in range(2)]


@query(f"SELECT o_orderkey AS doc_id, CASE o_orderkey % 2 WHEN 0 THEN '{_KEYS[0]}' ELSE '{_KEYS[1]}' END AS key FROM orders")
def key_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    salt = F.concat(F.lit("salt of sixteen"), (F.col("o_orderkey") % 2).cast("string")).cast("binary")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.hex(crypto.derive_key(salt, "correct horse")).alias("key"))


@query("SELECT doc_id, octet_length(encode(text)) + 16 AS n_bytes, md5(text) AS digest, true AS wrong_fails FROM documents")
def text_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts sealed and opened; a changed byte opens nothing."""
    sealed = crypto.encrypt_text(docs(spark, sf_dir), "text", "correct horse", salt=F.lit(b"0123456789abcdef"))
    opened = crypto.decrypt_text(sealed, "correct horse", "opened")
    spoilt = crypto.decrypt_text(opened.withColumn("data", F.concat(F.col("data"), F.lit(b"x"))), "correct horse", "wrong")
    return spoilt.select("doc_id", (F.octet_length("data") - 1).cast("long").alias("n_bytes"), F.md5(F.col("opened").cast("binary")).alias("digest"), F.col("wrong").isNull().alias("wrong_fails"))


@query("SELECT c_custkey AS id, length(p) >= 6 AND c_custkey % 3 > 0 AS valid FROM (SELECT c_custkey, 'pw' || c_custkey AS p FROM customer)")
def password_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat(F.lit("pw"), F.col("c_custkey").cast("string"))
    again = F.when(F.col("c_custkey") % 3 > 0, p).otherwise(F.concat(p, F.lit("x")))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), crypto.valid_password(p, again).alias("valid"))


# Records and audit


@query(f"SELECT doc_id AS file_id, sha256(text) AS file_hash, 'contract ' || doc_id || '.docx' AS file_name, 'docx' AS file_type, sha256({_replaced(*_TOKENS)}) AS redacted_hash, 'active' AS status, CAST(16 AS INTEGER) AS n_salt, true AS dated FROM {C}")
def record_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = redact.redact(some(spark, sf_dir)).withColumns({"file_name": F.concat(F.lit("contract "), F.col("doc_id").cast("string"), F.lit(".docx")), "format": F.lit("docx")})
    made = records.build_records(crypto.encrypt_mapping(df, "correct horse", salt=F.lit(b"0123456789abcdef")))
    return made.select("file_id", "file_hash", "file_name", "file_type", "redacted_hash", "status", F.octet_length("key_salt").alias("n_salt"), (F.col("created_at").isNotNull() & F.col("id").isNotNull()).alias("dated"))


@query(f"SELECT o_orderkey AS id, {_STATE} AS status FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def record_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record_rows(spark, sf_dir)
    return records.get_record(rows, rows.agg(F.max("id")).first()[0]).select("id", "status")


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'deleted' WHEN o_orderkey % 5 = 0 THEN 'restored' ELSE {_STATE} END AS status FROM orders")
def record_updates_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several updates of one record, some twice: it keeps its one row."""
    rows = record_rows(spark, sf_dir)
    new = [rows.where(f"id % {k} = 0").select("id", F.lit(s).alias("status")) for k, s in ((7, "deleted"), (5, "restored"), (7, "deleted"), (35, "active"))]
    return records.update_status(rows, new[0].unionByName(new[1]).unionByName(new[2]).unionByName(new[3])).select("id", "status")


@query("WITH f AS (SELECT DISTINCT 'part ' || (s_suppkey % 50) AS f FROM supplier), r AS (SELECT DISTINCT c_custkey AS id, 'part ' || c_custkey AS r FROM customer), p AS (SELECT f.f, r.id FROM f LEFT JOIN r ON contains(f.f, r.r) OR contains(r.r, f.f)) SELECT f || '.pdf' AS file_name, id, count(id) OVER (PARTITION BY f) AS n_matches FROM p")
def record_match_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and records listed several times are matched once."""
    files = read(spark, sf_dir, "supplier").select(F.concat(F.lit("part "), (F.col("s_suppkey") % 50).cast("string"), F.lit(".pdf")).alias("file_name"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("part "), F.col("c_custkey").cast("string"), F.lit(".docx")).alias("file_name"), F.lit("active").alias("status"))
    return records.match_records(files, rows.unionByName(rows)).select("file_name", "id", "n_matches")


@query(f"SELECT doc_id AS file_id, 'desensitize' AS action, sha256(text) AS file_hash, '{len(SOME)}' AS match_count, true AS dated FROM {C}")
def audit_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = some(spark, sf_dir).select(F.col("doc_id").alias("file_id"), redact.content_hash(F.col("text")).alias("file_hash"), F.size("matches").alias("n_matches"))
    made = records.build_audit(df, "desensitize")
    return made.select("file_id", "action", "file_hash", F.col("details")["matchCount"].alias("match_count"), (F.col("timestamp").isNotNull() & F.col("id").isNotNull()).alias("dated"))


# Gate

_PATH = "CASE doc_id % 6 WHEN 0 THEN concat('src/a', CAST(doc_id AS VARCHAR(20)), '.ts') WHEN 1 THEN 'scripts/b.sh' WHEN 2 THEN 'lib/dist/c.js' WHEN 3 THEN 'distance/d.md' WHEN 4 THEN 'node_modules/x' END"


@query(f"SELECT doc_id, {_PATH} AS path FROM documents WHERE (doc_id % 6 IN (0, 3) OR doc_id % 6 = 5) AND doc_id % 4 > 0 AND length(text) > 0")
def gate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files outside the excluded folders, those without a path too; binary ones go."""
    df = docs(spark, sf_dir).select("doc_id", F.expr(_PATH).alias("path"), F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\0"))).otherwise(F.col("text")).alias("text"))
    return gate.gate_targets(df).select("doc_id", "path")


@query(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, '[REDACTED]' AS pattern, '[REDACTED]' AS match FROM (SELECT *, {_GATE} AS pattern FROM ({_LINES.format('documents')})) WHERE pattern IS NOT NULL")
def gate_quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.quiet(gate.gate_lines(docs(spark, sf_dir)))


# Sources


@query("SELECT item_id AS doc_id, md5(text || chr(10)) AS digest, true AS named FROM benchmark")
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as a file each and read as whole files."""
    path = sources.shared_folder(spark, "files")
    read(spark, sf_dir, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    df = sources.read_text_documents(spark, path)
    return df.select(F.regexp_extract("doc_id", r"item_id=(\d+)", 1).cast("long").alias("doc_id"), F.md5(F.col("raw_text").cast("binary")).alias("digest"), F.col("file_name").endswith(".txt").alias("named"))


@query("SELECT doc_id, doc_id % 3 = 0 AS legacy FROM documents")
def source_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that begin as old office files, that are cut short of it, and plain texts."""
    mark, text = F.lit(bytes.fromhex("D0CF11E0")), F.col("text").cast("binary")
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(mark, text)).when(F.col("doc_id") % 3 == 1, F.lit(bytes.fromhex("D0CF11"))).otherwise(text)
    return docs(spark, sf_dir).select("doc_id", sources.is_legacy_binary(content).alias("legacy"))


_MIME = "CASE doc_id % 5 WHEN 0 THEN 'application/PDF' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'text/csv' END"


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' WHEN 2 THEN 'image' WHEN 3 THEN 'csv' END AS format FROM documents WHERE doc_id % 5 < 4")
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by MIME type, whatever the name; rows without either go to the rejects."""
    df = docs(spark, sf_dir).select("doc_id", F.expr(_MIME).alias("mime_type"), F.lit("note.md").alias("file_name"))
    return sources.with_format(df)[0].select("doc_id", "format")
