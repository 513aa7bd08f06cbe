"""Inline texts with the spans that must and must not be found."""

import random
import time

import pytest

from lacuna.functions.rules import BUILTIN, Rule, RuleSet, custom_rule, rules_from
from lacuna.operators import detect as detection
from lacuna.operators import keywords
from lacuna.operators.company import company_parts
from lacuna.operators.detect import count_by_type, detect, exploded, type_report

SMOKE = """甲方：北京示例科技有限公司
乙方：上海甲乙集团股份有限公司
联系人：张三、李四
电话：13800000000 / 010-00000000
邮箱：li@test-corp.com / wang@example-corp.com
身份证：110101199003078888
银行卡：6222600266661234567
税号：91110000123456789X
合同号：SAMPLE-CT-2024-001 兹有...
地址：示例省示例市示例区示例路1号
金额：人民币 100,000.00 元整（大写：壹拾万元整）
开户行：中国工商银行北京分行 0200025609200013713"""

#: text, type, values that must be found, values that must not.
CASES = [
    ("合作方为某设计公司", "COMPANY", [], ["设计公司"]),
    ("设计师及其所属公司", "COMPANY", [], ["设计师及其所属公司"]),
    ("甲方为示例公司有限公司", "COMPANY", ["示例公司有限公司"], []),
    ("示例公司（北京）融媒体科技文化有限公司", "COMPANY", ["示例公司（北京）融媒体科技文化有限公司"], []),
    ("阿里巴巴集团是行业巨头", "COMPANY", ["阿里巴巴集团"], []),
    ("上海某网络科技公司", "COMPANY", ["上海某网络科技公司"], []),
    ("华为投资控股有限公司", "COMPANY", ["华为投资控股有限公司"], []),
    ("这家公司提供咨询服务", "COMPANY", [], ["这家公司"]),
    ("A和B公司共同承办", "COMPANY", [], ["A和B公司"]),
    ("甲方公司负责交付", "COMPANY", [], ["甲方公司"]),
    ("本公司与关联公司有业务往来", "COMPANY", [], ["关联公司"]),
    ("委托其合作公司开展总控工作。经维沃移动通信有限公司同意，", "COMPANY", ["维沃移动通信有限公司"], ["经维沃移动通信有限公司"]),
    ("北京示例数字技术有限公司委托北京甲集团网络科技有限公司承办", "COMPANY", ["北京示例数字技术有限公司", "北京甲集团网络科技有限公司"], []),
    ("智能代理有限公司提供财务咨询服务", "COMPANY", ["智能代理有限公司"], []),
    ("同时配合集团完成商务方案", "COMPANY", [], ["同时配合集团"]),
    ("示例科技有限公司", "COMPANY", [], ["示例科技有限公司"]),
    ("（大写：人民币【壹拾伍万陆仟肆佰肆拾】元整）", "AMOUNT_UPPER", ["壹拾伍万陆仟肆佰肆拾】元整"], ["壹拾伍万陆"]),
    ("柒仟捌佰贰拾贰元整", "AMOUNT_UPPER", ["柒仟捌佰贰拾贰元整"], []),
    ("贰元叁角伍分", "AMOUNT_UPPER", ["贰元叁角伍分"], []),
    ("管理费人民币伍万壹仟玖佰】元整", "AMOUNT_UPPER", [], ["伍万壹仟玖佰】元整"]),
    ("总价180万元整", "AMOUNT_UPPER", ["180万元整"], []),
    ("预算1.5万元", "AMOUNT_UPPER", ["1.5万元"], ["万元"]),
    ("账  号：【0413090103000048204】", "BANK_CARD", ["0413090103000048204"], []),
    ("账户号: 44057601040010545", "BANK_CARD", ["44057601040010545"], []),
    ("员工编号 110101199003078811", "BANK_CARD", [], ["110101199003078811"]),
    ("电话：+8613800000000", "PHONE", [], ["13800000000", "+86"]),
    ("编号2138000000001", "PHONE", [], ["13800000000"]),
    ("纳税识别号：【91110000123456789X】", "TAX_ID", ["91110000123456789X"], []),
    ("金额 100,000", "AMOUNT", [], ["金额 100,000"]),
    ("金额30%违约金", "AMOUNT", [], ["金额30"]),
    ("报价 2000元", "AMOUNT", ["报价 2000元"], []),
    ("项目名称：星辰计划", "PROJECT_NAME", [], ["星辰计划"]),
    ("项目名：星辰计划", "PROJECT_NAME", ["星辰计划"], []),
    ("项目名称仅供参考", "PROJECT_NAME", [], ["称仅供参考"]),
    ("联系人：张三、李四", "NAME", ["张三", "李四"], []),
    ("联系人：\n联系电话", "NAME", [], ["联系电话"]),
    ("项目负责人为张三", "NAME", ["张三"], []),
    ("IP地址10.0.0.1端口", "IP", ["10.0.0.1"], []),
    ("网址（https://example.com/a）", "URL", ["https://example.com/a"], []),
    ("开户银行：招商银行广州体育东路支行", "BANK_LABEL", ["招商银行广州体育东路支行"], []),
    ("银行账号：123456789012345", "BANK_ACCOUNT_LABEL", ["123456789012345"], []),
]


def found(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return exploded(detect(df, **options)).collect()


def test_cases(spark):
    rows = found(spark, [c[0] for c in CASES])
    for i, (text, kind, present, absent) in enumerate(CASES):
        values = [r["value"] for r in rows if r["doc_id"] == i and r["type"] == kind]
        assert all(v in values for v in present), (text, kind, values)
        assert not any(v in values for v in absent), (text, kind, values)


def test_smoke_counts_and_integrity(spark):
    rows = found(spark, [SMOKE])
    least = {"PHONE": 2, "EMAIL": 2, "ID_CARD": 1, "BANK_CARD": 2, "TAX_ID": 1, "CONTRACT_NO": 1, "COMPANY": 2, "ADDRESS": 1, "AMOUNT": 1, "AMOUNT_UPPER": 1, "NAME": 2}
    for kind, n in least.items():
        assert sum(r["type"] == kind for r in rows) >= n, (kind, [(r["type"], r["value"]) for r in rows])
    for r in rows:
        assert SMOKE[r["start"] : r["end"]] == r["value"]
    ordered = sorted(rows, key=lambda r: r["start"])
    assert all(a["end"] <= b["start"] for a, b in zip(ordered, ordered[1:]))


def test_null_empty_and_astral_texts(spark):
    assert found(spark, [None, "", "😀 a@b.co"])[0]["start"] == 2


def test_keywords_come_last_and_blank_ones_are_left_out(spark):
    rows = found(spark, ["aXbX 13800000000"], rules=[BUILTIN[0]], keywords=["X", "", " ", "13800000000"])
    assert [(r["type"], r["value"], r["start"]) for r in rows] == [("CUSTOM", "X", 1), ("CUSTOM", "X", 3), ("PHONE", "13800000000", 5)]


def test_longer_span_wins_and_ties_keep_rule_order(spark):
    rules = [Rule("A", "ab", 0.5), Rule("B", "abc", 0.5), Rule("C", "abc", 0.5)]
    assert [(r["type"], r["value"]) for r in found(spark, ["xabcx"], rules=rules)] == [("B", "abc")]


def test_rule_sets(spark):
    s = RuleSet().switched("EMAIL", False)
    assert "EMAIL" not in [r.type for r in s.active()] and "EMAIL" in [r.type for r in s.active(include_disabled=True)]
    assert all(r.weight >= 0.9 for r in RuleSet().active(0.9)) and len(RuleSet().without("COMPANY").rules) == len(BUILTIN) - 2
    assert RuleSet().with_rule(custom_rule("a+")).rules[-1].type == "CUSTOM"
    for bad in ("a*", "("):
        with pytest.raises(ValueError):
            custom_rule(bad)
    assert custom_rule("x(\\d)").group == 1 and custom_rule("\\p{IsHan}++x").group == 0  # a Java regex
    table = spark.createDataFrame([("B", "b+", None, None), ("A", "a+", 0.5, False), ("N", None, 0.5, True)], "type string, pattern string, weight double, enabled boolean")
    assert [(r.type, r.weight, r.enabled) for r in rules_from(table).rules] == [("A", 0.5, False), ("B", 0.9, True)]
    with pytest.raises(ValueError):
        rules_from(table, limit=1)


def test_counts_and_report(spark):
    df = detect(spark.createDataFrame([(1, "a@b.co c@d.co 10.0.0.1")], "doc_id int, text string"))
    assert {(r["type"], r["n"]) for r in count_by_type(df).collect()} == {("EMAIL", 2), ("IP", 1)}
    assert [r["type"] for r in type_report(df).collect()] == ["EMAIL", "IP"]


def test_company_parts_stay_inside_the_candidate():
    for value in ("甲方为占位集团", "X有限公司公司", "", "公司", "委托北京甲集团公司代理示例公司（北京）融媒体科技文化有限公司"):
        assert all(0 <= o and o + n <= len(value) for o, n in company_parts(value))


def test_keyword_automata_find_what_expressions_do(spark, monkeypatch):
    """Long lists, lists over several automata and tables give what a few expressions give, overlaps resolved."""
    rng = random.Random(2)
    word = lambda low, high: "".join(rng.choice("ab é😀") for _ in range(rng.randrange(low, high)))
    df = spark.createDataFrame([*((i, word(0, 60)) for i in range(200)), (1000, None), (1001, "")], "doc_id int, text string")
    words = [word(1, 5) for _ in range(30)]
    hits = lambda keywords: sorted(map(tuple, exploded(detect(df, rules=[BUILTIN[0]], keywords=keywords)).collect()))
    few = hits(words)
    table = spark.createDataFrame([*((w, i) for i, w in enumerate(words)), (None, 1), (" ", 2), (words[0], 99)], "keyword string, idx int")
    monkeypatch.setattr(detection, "FEW_KEYWORDS", 0)
    assert few and hits(words) == few == hits(table)
    monkeypatch.setattr(keywords, "BLOCK", 10)
    assert hits(words) == few == hits(table)
    alike = spark.createDataFrame([(w, 0) for w in words], "keyword string, idx int")  # an order may be shared
    places = lambda t: sorted(tuple(r)[:2] + tuple(r)[3:] for r in keywords.keyword_matches(df, t).collect())
    assert places(alike) == places(table)
    assert keywords.keyword_matches(df, table.limit(0)).count() == 0 == keywords.keyword_matches(df.limit(0), table).count()


def test_keyword_lists_cost_a_pass(spark):
    text = "th1 word " * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")

    def took(n):
        began = time.time()
        assert keywords.keyword_matches(df, [f"th{i}" for i in range(n)]).count() == 100_000
        return time.time() - began

    took(50)
    assert took(50_000) < 2 * took(50) + 1
