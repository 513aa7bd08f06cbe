"""Detection: rules, their filters, keywords, and the resolution of overlaps. One row per document, no shuffle.

Matches are ``array<struct<type, value, start, end, confidence, context, rule_idx, seq>>``; offsets are 0-based code
points, so ``substring(text, start + 1, length(value)) = value``.

Defined cases: null and empty texts have no matches; repeated rows and ids stay apart, each with its own matches; other
columns stay, whatever their names, but one named like ``out`` is replaced; of equal spans the first in rule order
stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.rules import AHEAD, LABELS, NOT_S, ORDER, Rule, RuleSet
from lacuna.functions.spans import SPAN, cut, free, group_spans, let, no_spans, scan, spans_of, with_blocks
from lacuna.operators.company import company_spans
from lacuna.operators.keywords import hits

MATCH = "array<struct<type:string,value:string,start:int,end:int,confidence:double,context:string,rule_idx:int,seq:int>>"

#: Fixed values of the filters.
URL_BEFORE = r"\.com/|\.cn/|/article/|\.html|\.asp|\.aspx|https?:|\.org/|\.net/"
ACCOUNT_BEFORE = "账号|账户|卡号|开户|帐号|银行账"
UNITS = "元|¥|￥|\\$|€|£|万|千|亿|英镑|港币|日圆"
STORY = "^[名称]?(?:仅供参考|仅供|以实际|以实|另行|另议|详见|参见|见附件|见下|待定|暂定|待确定|双方协商|由.{0,6}确定|如实际)"
NOT_NAMES = ("电话", "手机", "邮箱", "地址", "邮编", "传真", "网址", "微信", "QQ", "联系人", "姓名", "名字", "客户姓名", "联系电话", "手机号码", "电子邮箱", "联系地址", "电子信箱", "联系方式", "电子邮件", "通讯地址", "联系人员", "移动电话", "办公电话")
BAD_NAME = "^本|^(?:电话|手机|邮箱|邮件|地址|邮编|传真|网址|微信|QQ|联系人|联系|通讯|办公|电子|负责|委托|代理|代表|协助|处理|管理|跟进|承担)|[0-9a-zA-Z()（）]"


def context(text: Column, start: Column, radius: int = 20) -> Column:
    """The surroundings of a place: radius code points to either side, between dots."""
    begin = F.greatest(start - radius, F.lit(0))
    return F.concat(F.lit("..."), F.substring(text, begin + 1, start + radius - begin), F.lit("..."))


def with_contexts(text: Column, matches: Column, radius: int = 30) -> Column:
    """The matches with their contexts, cut from the text's blocks."""

    def one(b: Column, m: Column) -> Column:
        begin = F.greatest(m["start"] - radius, F.lit(0))
        return m.withField("context", F.concat(F.lit("..."), cut(b, begin, m["start"] + radius - begin), F.lit("...")))

    return let(matches, lambda ms: with_blocks(text, F.size(ms) > 0, lambda b: F.transform(ms, lambda m: one(b, m))))


def _before(blocks: Column, start: Column, n: int) -> Column:
    begin = F.greatest(start - n, F.lit(0))
    return cut(blocks, begin, start - begin)


def _matches(value: Column, pattern: str) -> Column:
    return F.rlike(value, F.lit(pattern))


def _phone(blocks: Column, x: Column) -> Column:
    return ~_matches(_before(blocks, x["s"], 1), r"\d") & ~_matches(cut(blocks, x["e"], 1), r"\d")


def _bank_card(blocks: Column, x: Column) -> Column:
    v, n = x["v"], F.length(x["v"])
    right = cut(blocks, x["e"], 1)
    wrapped = (right == "）") & (_before(blocks, x["s"], 1) == "（")
    wider = cut(blocks, F.greatest(x["s"] - 15, F.lit(0)), F.least(F.greatest(x["s"] - 1, F.lit(0)), F.lit(14)))
    bad = (n >= 17) & _matches(v, r"^[1-9]\d{5}(?:18|19|20)\d{2}")
    bad = bad | (n.between(17, 19) & _matches(v, r"^9[123]\d+$"))
    bad = bad | _matches(_before(blocks, x["s"], 30), URL_BEFORE)
    bad = bad | (wrapped & ~_matches(wider, ACCOUNT_BEFORE))
    return ~(bad | ((n == 16) & (v.startswith("0") | _matches(right, r"[\dXx]"))))


def _amount(blocks: Column, x: Column) -> Column:
    number = F.regexp_extract(x["v"], r"(\d+(?:\.\d+)?)", 1)
    return _matches(x["v"], UNITS) | (~_matches(x["v"], "合计|小计") & (F.coalesce(number.try_cast("double"), F.lit(0.0)) > 100))


def _amount_upper(blocks: Column, x: Column) -> Column:
    return ~_matches(x["v"], "^(?:人民币)?[万亿]") & (~x["v"].contains("】") | _before(blocks, x["s"], 5).contains("【"))


def _project(blocks: Column, x: Column) -> Column:
    return ~_matches(x["v"], STORY)


FILTERS = {"PHONE": _phone, "BANK_CARD": _bank_card, "AMOUNT": _amount, "AMOUNT_UPPER": _amount_upper, "PROJECT_NAME": _project}
#: Those that read the text around a value.
LOOK_AROUND = ("PHONE", "BANK_CARD", "AMOUNT_UPPER")


def _filtered(found: Column, type_: str, text: Column) -> Column:
    keep = FILTERS[type_]
    if type_ not in LOOK_AROUND:
        return F.filter(found, lambda x: keep(None, x))
    return let(found, lambda xs: with_blocks(text, F.size(xs) > 0, lambda b: F.filter(xs, lambda x: keep(b, x))))


def _names(spans: Column) -> Column:
    """Names in a row are parted; the first bad one ends the row."""

    def parted(x: Column) -> Column:
        def step(stop: Column, y: Column) -> tuple[Column, Column]:
            bad = stop | _matches(y["v"], BAD_NAME)
            one = F.struct((x["s"] + y["s"]).alias("s"), (x["s"] + y["e"]).alias("e"), y["v"].alias("v"))
            return bad, F.when(bad, no_spans()).otherwise(F.array(one))

        several = let(spans_of(x["v"], f"[^{NOT_S}、，；]+"), lambda parts: scan(parts, F.lit(False), step, SPAN)["o"])
        alone = F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))
        return F.when(_matches(x["v"], "[、，；]"), several).when(x["v"].isin(*NOT_NAMES), no_spans()).otherwise(alone)

    return F.flatten(F.transform(spans, parted))


def _companies(spans: Column, parts: Column) -> Column:
    """Spans of the parts that the company filter kept of each candidate."""

    def of(x: Column, own: Column) -> Column:
        return F.transform(own, lambda y: F.struct((x["s"] + y["o"]).alias("s"), (x["s"] + y["o"] + y["n"]).alias("e"), F.substring(x["v"], y["o"] + 1, y["n"]).alias("v")))

    return F.flatten(F.zip_with(spans, parts, of))


def _emitted(spans: Column, type_: str, weight: float, idx: Column | int) -> Column:
    """Matches without contexts."""

    def one(x: Column, i: Column) -> Column:
        rule = F.lit(idx) if isinstance(idx, int) else idx
        return F.struct(F.lit(type_).alias("type"), x["v"].alias("value"), x["s"].alias("start"), x["e"].alias("end"), F.lit(weight).alias("confidence"), F.lit(None).cast("string").alias("context"), rule.alias("rule_idx"), i.alias("seq"))

    return F.transform(spans, one)


def resolve_overlaps(matches: Column) -> Column:
    """By start, then emit order; of two that overlap the last kept one, the longer stays, the earlier on a tie."""
    ordered = F.transform(matches, lambda m: F.struct(m["start"].alias("k"), m["rule_idx"].alias("r"), m["seq"].alias("q"), m.alias("m")))
    ordered = F.transform(F.array_sort(ordered), lambda x: x["m"])
    none = F.array().cast(MATCH)

    def step(last: Column, m: Column) -> tuple[Column, Column]:
        apart = last.isNull() | (m["start"] >= last["end"])
        longer = (m["end"] - m["start"]) > (last["end"] - last["start"])
        return F.when(apart | longer, m).otherwise(last), F.when(apart & last.isNotNull(), F.array(last)).otherwise(none)

    walked = let(ordered, lambda ms: scan(ms, F.lit(None).cast(MATCH[6:-1]), step, MATCH))
    return let(walked, lambda w: F.when(w["c"].isNull(), w["o"]).otherwise(F.concat(w["o"], F.array(w["c"]))))


def literal(keyword: str) -> str:
    """A Java regex for the text itself."""
    return "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"


#: Up to so many keywords each have an expression of their own.
FEW_KEYWORDS = 32


def _keyword_spans(spark: SparkSession, text: Column, given: Sequence[str] | DataFrame, first: int) -> list[Column]:
    """Matches of keywords: an expression for each of a few, an automaton for many or for a table's."""
    words = given if isinstance(given, DataFrame) else [k for k in dict.fromkeys(given) if k and k.strip()]
    if not isinstance(words, DataFrame) and len(words) <= FEW_KEYWORDS:
        return [_emitted(spans_of(text, literal(k), text.contains(k)), "CUSTOM", 0.95, first + i) for i, k in enumerate(words)]

    def one(x: Column) -> Column:
        return F.struct(F.lit("CUSTOM").alias("type"), x["v"].alias("value"), x["s"].alias("start"), x["e"].alias("end"), F.lit(0.95).alias("confidence"), F.lit(None).cast("string").alias("context"), (x["i"] + first).alias("rule_idx"), x["q"].alias("seq"))

    return [F.transform(h, one) for h in hits(spark, text, words)]


def detect(df: DataFrame, text_col: str = "text", rules: RuleSet | Sequence[Rule] = RuleSet(), keywords: Sequence[str] | DataFrame = (), min_confidence: float = 0.0, include_disabled: bool = False, out: str = "matches") -> DataFrame:
    """The input and ``out``: all spans of the rules and keywords, filtered, overlaps resolved.

    Keywords count as they stand, in their order, blanks left out; they come after all rules and know no confidence
    threshold. They may be a table with the columns ``keyword`` and ``idx``.
    """
    active = (rules if isinstance(rules, RuleSet) else RuleSet(tuple(rules))).active(min_confidence, include_disabled)
    own = {k: free(df, f"__{k}") for k in ("text", *(f"{c}{i}" for c in "rc" for i in range(len(active))))}
    t = F.col(own["text"])
    df = df.withColumn(own["text"], F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    raw = {}
    for i, r in enumerate(active):
        trigger = _matches(t, r.trigger) if r.trigger else None
        found = group_spans(t, r.pattern, 1, trigger, r.group == AHEAD) if r.group else spans_of(t, r.pattern, trigger)
        found = F.filter(found, lambda x: x["e"] > x["s"])
        found = _filtered(found, r.type, t) if r.type in FILTERS else found
        raw[own[f"r{i}"]] = _names(found) if r.type == "NAME" else found
    df = df.withColumns(raw) if raw else df
    companies = [i for i, r in enumerate(active) if r.type == "COMPANY"]
    if companies:
        df = df.withColumns({own[f"c{i}"]: company_spans(F.transform(own[f"r{i}"], lambda x: x["v"])) for i in companies})
    parts = [_emitted(_companies(F.col(own[f"r{i}"]), F.col(own[f"c{i}"])) if i in companies else F.col(own[f"r{i}"]), r.type, r.weight, i) for i, r in enumerate(active)]
    for i, found in enumerate(_keyword_spans(df.sparkSession, t, keywords, len(active))):
        name = free(df, f"__k{i}")
        own[name], df = name, df.withColumn(name, found)
        parts.append(F.col(name))
    whole = F.concat(*parts) if parts else F.array().cast(MATCH)
    kept = let(whole, lambda ms: F.when(F.size(ms) > 1, resolve_overlaps(ms)).otherwise(ms))
    return df.withColumn(out, with_contexts(t, kept)).drop(*own.values())


def exploded(df: DataFrame, id_col: str = "doc_id", matches: str = "matches") -> DataFrame:
    """One row per span."""
    return df.select(id_col, F.explode_outer(matches).alias("m")).where("m is not null").select(id_col, "m.type", "m.value", "m.start", "m.end", "m.confidence", "m.context")


def count_by_type(df: DataFrame, id_col: str | None = None, matches: str = "matches") -> DataFrame:
    """Totals by type, or by document and type."""
    keys = [id_col] if id_col else []
    one = df.select(*keys, F.explode_outer(F.transform(matches, lambda m: m["type"])).alias("type")).where("type is not null")
    return one.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n"))


def type_report(df: DataFrame, matches: str = "matches") -> DataFrame:
    """``type, label, n, rank`` in display order; types without a place come last."""
    place = F.coalesce(*(F.when(F.col("type") == t, i) for i, t in enumerate(ORDER)), F.lit(999))
    label = F.coalesce(*(F.when(F.col("type") == t, F.lit(v)) for t, v in LABELS.items()), F.col("type"))
    return count_by_type(df, matches=matches).select("type", label.alias("label"), "n", place.cast("int").alias("rank")).orderBy("rank", "type")
