"""Line gate: which lines of texts hold personal data, by ordered patterns; and dictionary scrubbing with its audit.

Defined cases: null and empty texts are one empty line; a file without a path is scanned; repeated rows and ids stay
apart; null and empty terms are left out; a diff line before any hunk has no number; an empty table gives no rows; other
columns stay where rows are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.spans import free
from lacuna.operators import dictionary, keywords
from lacuna.operators.stretches import running

#: The gate's patterns in their order, looser than the detection rules.
PATTERNS = (
    ("PHONE", r"(?<![A-Za-z0-9_])1[3-9][0-9]{9}(?![A-Za-z0-9_])"),
    ("ID_CARD", r"(?<![A-Za-z0-9_])[0-9]{17}[0-9Xx](?![A-Za-z0-9_])"),
    ("BANK_CARD", r"(?<![A-Za-z0-9_])[0-9]{16,19}(?![A-Za-z0-9_])"),
    ("EMAIL", r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("IP", r"(?<![A-Za-z0-9_])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9_])"),
    ("CONTRACT_NO", r"(?<![A-Za-z0-9_])[A-Z]{1,5}-[A-Z0-9-]{2,}-[A-Z0-9-]{2,}(?![A-Za-z0-9_])"),
    ("AMOUNT_UPPER", "[零壹贰叁肆伍陆柒捌玖拾佰仟万亿元圆角分]{4,}"),
    ("COMPANY", "[一-龥](?:有限公司|集团|股份|科技|投资|实业|商贸|分公司)"),
    ("NAME", r"(?:姓名|联系人|甲方|乙方|丙方|经办人|法人|代表)[\s:：]+[一-龥]{2,4}"),
    ("ADDRESS", r"(?:地址|住址|住所|联系地址)[\s:：]+[一-龥0-9]+"),
    ("PROJECT_NAME", r"(?:项目名称|工程名称|项目|工程)[\s:：]+[一-龥0-9A-Za-z]+"),
    ("TAX_ID", r"(?:纳税人识别号|税号|统一社会信用代码)[\s:：]+[A-Z0-9]{15,20}"),
)
EXCLUDED = r"(^|/)(node_modules|dist|coverage|\.vite|test-fixtures|scripts)(/|$)"


#: What a line must hold for any of the patterns to match: a digit, an address, a number with capitals, Chinese text.
HINT = "[0-9@一-龥]|[A-Z]-"


def first_pattern(line: Column, extra: Sequence[str] = ()) -> Column:
    """The name of the first pattern in the list that a line holds; the users' own come last."""
    chosen = lambda pairs: F.coalesce(*(F.when(F.rlike(line, F.lit(p)), n) for n, p in pairs))
    own = F.when(F.rlike(line, F.lit(HINT)), chosen(PATTERNS))
    more = [(p, p) for p in extra if p]
    return F.coalesce(own, chosen(more)) if more else own


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, line``; line numbers begin with 1. An empty last line is no line."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\n\z", "")
    return df.select(id_col, F.posexplode_outer(F.split(text, "\n", -1)).alias("n", "line")).select(id_col, (F.col("n") + 1).alias("line_no"), "line")


def gate_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: Sequence[str] = ()) -> DataFrame:
    """``id, line_no, pattern, match`` (at most 80 code points) of each line that holds personal data. No shuffle."""
    found = lines_of(df, id_col, text_col).withColumn("pattern", first_pattern(F.col("line"), extra)).where("pattern is not null")
    return found.select(id_col, "line_no", "pattern", F.substring("line", 1, 80).alias("match"))


def gate_targets(df: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Files to scan: not excluded, not binary, not empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.where(~F.coalesce(F.rlike(path_col, F.lit(EXCLUDED)), F.lit(False)) & (F.length(text) > 0) & ~F.contains(text, F.lit("\0")))


def added_lines(diff: DataFrame, file_col: str = "file", order_col: str = "idx", line_col: str = "line") -> DataFrame:
    """``file, line_no, line`` of the added lines of a unified diff, one row per diff line."""
    line = F.col(line_col)
    begin = F.when(line.startswith("@@ "), F.regexp_extract(line, r"^@@ -\S+ \+(\d+)", 1).try_cast("int"))
    added = line.startswith("+") & ~line.startswith("+++")
    before, hunk, is_added = (free(diff, c) for c in ("__before", "__hunk", "__added"))
    df = running(diff.withColumn(is_added, added), file_col, [order_col], {before: ("sum", F.col(is_added).cast("long"))})
    df = df.withColumn(before, F.coalesce(before, F.lit(0)))
    # of the last hunk: where it begins, and how many lines had been added by then
    last = F.when(begin.isNotNull(), F.struct(F.col(order_col).alias("at"), begin.alias("line"), F.col(before).alias("added")))
    df = running(df, file_col, [order_col], {hunk: ("max", last)}, inclusive=True)
    number = F.col(f"{hunk}.line") + F.col(before) - F.col(f"{hunk}.added")
    return df.withColumn("line_no", number.cast("int")).where(is_added).select(file_col, "line_no", F.substring(line, F.lit(2), F.lit(2147483647)).alias("line"))


def gate_verdict(targets: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, hits, verdict`` of each target."""
    counts = found.groupBy(id_col).agg(F.count(F.lit(1)).alias("hits"))
    out = targets.select(id_col).join(counts, id_col, "left").select(id_col, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
    return out.withColumn("verdict", F.when(F.col("hits") > 0, "fail").otherwise("pass"))


def quiet(found: DataFrame) -> DataFrame:
    """Hits without what was found."""
    return found.withColumns({"pattern": F.lit("[REDACTED]"), "match": F.lit("[REDACTED]")})


def apply_dictionary(df: DataFrame, pairs: Sequence[tuple[str, str]] | DataFrame, text_col: str = "text", out: str = "scrubbed") -> DataFrame:
    """Replaces literal terms, longest first, one after the other: later pairs see what earlier ones made.

    A dictionary may be a table (``from, to``; those of equal length in the order of their terms) of any size: see ``dictionary``.
    """
    ordered = None if isinstance(pairs, DataFrame) else sorted((p for p in pairs if p[0]), key=lambda p: -len(p[0]))
    if ordered is not None and len(ordered) <= 50:
        text = F.col(text_col)
        for a, b in ordered:
            text = F.replace(text, F.lit(a), F.lit(b))
        return df.withColumn(out, text)
    return df.withColumn(out, dictionary.scrubbed(df.sparkSession, F.col(text_col).cast("string"), pairs if ordered is None else ordered))


def residual_counts(df: DataFrame, terms: DataFrame, text_col: str = "text", term_col: str = "term") -> DataFrame:
    """``term, n_lines``: how many lines still hold each term. One pass of automata over the texts; only terms that a text holds become rows."""
    own = terms.select(F.col(term_col).cast("string").alias("term")).where("length(term) > 0").distinct()
    counts = keywords.lines_with(df.sparkSession, F.col(text_col).cast("string"), own.select(F.col("term").alias("keyword"), F.lit(0).alias("idx")))
    found = None
    for c in counts:
        one = df.select(F.explode_outer(c).alias("x")).where("x is not null").groupBy("x.term").agg(F.sum("x.n").alias("n_lines"))
        found = one if found is None else found.unionByName(one)  # a term is in one automaton
    if found is None:
        return own.withColumn("n_lines", F.lit(0).cast("long"))
    return own.join(found, "term", "left").select("term", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))
