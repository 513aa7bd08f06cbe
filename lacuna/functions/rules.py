"""Detection rules: type, Java regex, weight; and the immutable set of them that a job runs with.

Defined cases: a table's rows without a pattern are left out, its null types are CUSTOM, null weights 0.9, null switches on;
rules that repeat each take part, the first of equal spans stays; an empty table gives no rules; a pattern that can't be
compiled, or matches the empty string, is refused.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of any script, of which Java's own class knows a part.
NOT_S = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
S = f"[{NOT_S}]"
HAN = r"一-龥"


#: Stands for a value in group 1 that follows the match, which itself is a label alone.
AHEAD = -1


@dataclass(frozen=True)
class Rule:
    """``trigger`` is a cheap regex without which the pattern cannot match; ``group`` 1 makes that group the value, AHEAD what group 1 sees behind the match."""

    type: str
    pattern: str
    weight: float
    group: int = 0
    trigger: str | None = None
    enabled: bool = True


#: Numerals of formal amounts, listed function characters before a company, legal forms, trade words.
CAPITALS = "零壹贰叁肆伍陆柒捌玖"
NUMERALS = CAPITALS + "拾佰仟万亿"
BEFORE_COMPANY = "(?<![这那每该各某自己诸何之与和及或其的了在为于而则])(?<!委托)(?<!代理)(?<!代表)"
FORMS = "集团有限公司|股份有限公司|科技有限公司|投资有限公司|实业有限公司|商贸有限公司|有限公司|分公司|公司"
TRADES = "科技|投资|实业|商贸|文化|传媒|网络|信息|电子|建筑|工程|咨询|管理|服务|贸易|发展|控股|融媒体"
PATH = rf"""(?:/[^{NOT_S}<>"'）】」』，。；、]*)?"""
TLD = "com|cn|org|net|io|gov|edu|co|ai|app|me|info|xyz|biz|com\\.cn|org\\.cn|net\\.cn|gov\\.cn|edu\\.cn"
OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"

#: The built-in rules in their order, which decides ties between equal spans.
BUILTIN = (
    Rule("PHONE", rf"(\+?86(?:[-.]|{S})?)?(?:1[3-9]\d{{9}}|0\d{{2,4}}(?:[-.]|{S})?\d{{7,8}})", 0.95, 1, r"\d{7}"),
    Rule("ID_CARD", r"[1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]", 0.98, 0, r"\d{17}"),
    Rule("EMAIL", r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0.95, 0, "@"),
    Rule("TAX_ID", rf"(?i)(?:纳税人识别号|纳税识别号|税号|税务登记号|统一社会信用代码|统一社会信用代码编号|TIN){S}*[:：]?{S}*[（(【]?{S}*([A-Z0-9]{{15,20}}){S}*[)）】]?", 0.92, 1, "(?i)号|代码|编号|TIN"),
    Rule("BANK_CARD", rf"[0-9]\d{{4}}{S}?\d{{4}}{S}?\d{{4}}{S}?\d{{3,8}}", 0.90, 0, r"\d{5}"),
    Rule("BANK_ACCOUNT_LABEL", rf"(?:银行账号|银行帐号|账号|帐号|账户|收款账号|付款账号|收款账户|付款账户){S}*[:：]?{S}*([0-9]{{12,21}})", 0.92, 1, "[账帐][号户]"),
    Rule("IP", rf"(?<![A-Za-z0-9_])(?:{OCTET}\.){{3}}{OCTET}(?![A-Za-z0-9_])", 0.85, 0, r"\d\.\d"),
    Rule("AMOUNT", rf"(?i)(?:(?:价格|金额|总计|合计|付款|收款|工资|月薪|年薪|费用|报价|人民币)(?:[：:]|{S})*)(?<![A-Za-z0-9_])\d+(?:[,，]\d{{3}})*(?:\.\d{{1,2}})?(?:{S}*元)?|(?:¥|￥|\$|€|£|USD|CNY|RMB|HKD|JPY){S}*\d+(?:[,，]\d{{3}})*(?:\.\d{{1,2}})?(?:{S}*(?:元|万|千|美元|欧元|英镑|港币|日圆))?", 0.80, 0, r"(?i)[价金总合付收工月年费报民¥￥$€£]|USD|CNY|RMB|HKD|JPY"),
    Rule("AMOUNT_UPPER", rf"(?:人民币)?(?:(?<!\d)\d+(?:,\d{{3}})*(?:\.\d+)?[万亿]元?(?:[{CAPITALS}][角分])*整?|(?:\G|(?<![{NUMERALS}]))[{NUMERALS}]+】?元(?:[{NUMERALS}]*[角分])*整?|(?:[{CAPITALS}][角分])+)", 0.92, 0, "[万亿元角分]"),
    Rule("ADDRESS", rf"(?:(?:北京|上海|天津|重庆|香港|澳门)[市省区]?|[{HAN}]{{2,6}}省)[{HAN}]{{2,10}}(?:市|区|县|镇|乡|街道)(?:[{HAN}\d-]|{S}){{6,80}}(?:路|街|道|巷|弄|号|楼|室|单元|栋|层|座|大厦|花园|小区|公寓|广场|中心|城|馆|酒店|宾馆|医院|学校|银行)", 0.75, 0, "[市区县镇乡道]"),
    Rule("CONTRACT_NO", rf"(?i)(?:合同书?号|Contract{S}*(?:No\.?|Number)?){S}*[:：]?{S}*([A-Z0-9]{{6,24}})", 0.90, 1, "(?i)合同|Contract"),
    Rule("PROJECT_NAME", rf"(?i)(?:项目[名称书]|Project{S}*Name){S}*[:：]?{S}*([{HAN}A-Za-z0-9]{{4,30}})", 0.80, 1, "(?i)项目|Project"),
    Rule("COMPANY", rf"(?=[{HAN}（）()]*公司){BEFORE_COMPANY}(?:[{HAN}]{{2,8}}(?:省|市|自治区))?[{HAN}（）()]{{2,30}}(?:[{HAN}]{{0,10}}(?:{TRADES}))?(?:{FORMS})", 0.88, 0, "公司"),
    Rule("COMPANY", rf"(?=[{HAN}]*集团){BEFORE_COMPANY}[{HAN}]{{2,8}}集团", 0.88, 0, "集团"),
    Rule("BANK_LABEL", rf"(?:开户银行|开户行|收款银行){S}*[:：]?{S}*([{HAN}0-9]{{4,30}}(?:支行|分行|营业部|总行)?)", 0.85, 1, "开户|收款银行"),
    Rule("NAME", rf"(?:姓名|名字|客户姓名|联系人|项目负责人){S}*[:：是为]{S}*(?=([{HAN}]{{2,4}}(?:[、，；]{S}*[{HAN}]{{2,4}})*))", 0.85, AHEAD, "姓名|名字|联系人|负责人"),
    Rule("URL", rf"(?i)(?:https?://[\w-]+(?:\.[\w-]+)+{PATH}|www\.[\w-]+(?:\.[\w-]+)+{PATH}|(?<![\w@.])(?:[\w-]+\.)+(?:{TLD}){PATH})", 0.85, 0, r"(?i)\w\.\w"),
)

#: The display order of types, and their labels.
ORDER = ("NAME", "PHONE", "EMAIL", "ID_CARD", "BANK_CARD", "TAX_ID", "ADDRESS", "COMPANY", "PROJECT_NAME", "CONTRACT_NO", "AMOUNT", "AMOUNT_UPPER", "IP", "CUSTOM")
LABELS = {
    "PHONE": "手机号", "ID_CARD": "身份证", "EMAIL": "邮箱", "BANK_CARD": "银行卡", "BANK_LABEL": "开户银行", "BANK_ACCOUNT_LABEL": "银行账号",
    "IP": "IP地址", "AMOUNT": "小写金额", "AMOUNT_UPPER": "大写金额", "ADDRESS": "地址", "CONTRACT_NO": "合同号", "PROJECT_NAME": "项目名称",
    "COMPANY": "公司名称", "NAME": "姓名", "TAX_ID": "纳税人识别号", "URL": "网址", "CUSTOM": "自定义",
}


@dataclass(frozen=True)
class RuleSet:
    """An immutable list of rules; every change gives a new one."""

    rules: tuple[Rule, ...] = BUILTIN

    def with_rule(self, rule: Rule) -> RuleSet:
        return RuleSet((*self.rules, rule))

    def without(self, type_: str) -> RuleSet:
        return RuleSet(tuple(r for r in self.rules if r.type != type_))

    def switched(self, type_: str, enabled: bool) -> RuleSet:
        return RuleSet(tuple(replace(r, enabled=enabled) if r.type == type_ else r for r in self.rules))

    def updated(self, type_: str, **changes: object) -> RuleSet:
        return RuleSet(tuple(replace(r, **changes) if r.type == type_ else r for r in self.rules))

    def active(self, min_confidence: float = 0.0, include_disabled: bool = False) -> list[Rule]:
        return [r for r in self.rules if (r.enabled or include_disabled) and r.weight >= min_confidence]


def custom_rule(pattern: str, weight: float = 0.9, type_: str = "CUSTOM", enabled: bool = True) -> Rule:
    """A user's rule, ignoring case: a Java regex. One that Spark can't compile, or that matches the empty string, is refused."""
    spark, own = SparkSession.getActiveSession(), f"(?i){pattern}"
    if spark is None:
        raise ValueError("needs an active session, whose engine checks the pattern")

    def works(column) -> bool | None:
        try:
            return spark.range(1).select(column).first()[0]
        except Exception:  # the engine's errors differ by version and way of connecting
            return None

    empty = works(F.rlike(F.lit(""), F.lit(own)))
    if empty is None:
        raise ValueError(f"not a regular expression: {pattern}")
    if empty:
        raise ValueError(f"matches the empty string: {pattern}")
    grouped = works(F.regexp_extract(F.lit(""), f"{own}|", 1)) is not None  # matches, so the group's number is looked at
    return Rule(type_, own, weight, 1 if grouped else 0, enabled=enabled)


def rules_from(table: DataFrame, limit: int = 1000) -> RuleSet:
    """The rules of a table ``type, pattern, weight, enabled`` in the order of type and pattern; a longer table is refused. Null weights are 0.9, null switches on."""
    rows = table.where("pattern is not null").orderBy("type", "pattern").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rules")
    return RuleSet(tuple(custom_rule(r["pattern"], 0.9 if r["weight"] is None else float(r["weight"]), r["type"] or "CUSTOM", r["enabled"] is not False) for r in rows))
