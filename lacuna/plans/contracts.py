"""A view of contract texts made from ``orders`` in plain SQL: the same text in any engine, its parts known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTRACTS = """
SELECT o_orderkey AS doc_id, o_custkey, phone, id_card, name1, name2, s_tag, c_tag, seller, buyer, email, tax_id, account, contract_no, address, url, amount, ip,
  concat('甲方：', seller, chr(10), '乙方：', buyer, chr(10), '联系人：', name1, '、', name2, chr(10), '电话：', phone, chr(10),
   '邮箱：', email, chr(10), '身份证：', id_card, chr(10), '统一社会信用代码：', tax_id, chr(10), '收款账号：', account, chr(10),
   '合同号：', contract_no, chr(10), '项目名：星辰建设计划', chr(10), '地址：', address, chr(10), '大写：壹拾万元整', chr(10),
   '开户银行：示例银行广州支行', chr(10), '网址：', url, chr(10), '合同', amount, chr(10), '服务器IP：', ip, chr(10)) AS text
FROM (SELECT o.*,
  concat('北京', s_tag, '智能科技有限公司') AS seller, concat('上海', c_tag, '集团') AS buyer,
  concat('buyer', CAST(o_custkey AS VARCHAR(20)), '@example.com') AS email,
  concat('91110108MA', lpad(CAST(o_custkey AS VARCHAR(20)), 7, '0'), 'X') AS tax_id,
  concat('622260', lpad(CAST(o_custkey AS VARCHAR(20)), 13, '0')) AS account,
  concat('HT', lpad(CAST(o_orderkey AS VARCHAR(20)), 10, '0')) AS contract_no,
  concat('广东省广州市天河区体育东路示例', CAST(o_custkey % 90 + 1 AS VARCHAR(20)), '号') AS address,
  concat('https://www.example.com/c/', CAST(o_custkey AS VARCHAR(20))) AS url,
  concat('金额：', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)), '元') AS amount,
  concat('10.', CAST(o_custkey % 250 AS VARCHAR(20)), '.', CAST(o_orderkey % 250 AS VARCHAR(20)), '.7') AS ip
 FROM (SELECT o_orderkey, o_custkey, o_totalprice,
   concat('138', lpad(CAST(o_custkey AS VARCHAR(20)), 8, '0')) AS phone,
   concat('11010119900307', lpad(CAST(o_custkey % 1000 AS VARCHAR(20)), 3, '0'), 'X') AS id_card,
   concat(substring('赵钱孙李周吴郑王', CAST(o_custkey % 8 AS INT) + 1, 1), substring('明华强丽芳军', CAST(o_orderkey % 6 AS INT) + 1, 1)) AS name1,
   concat(substring('冯陈褚卫蒋沈韩杨', CAST(o_orderkey % 8 AS INT) + 1, 1), substring('磊静洋勇艳杰', CAST(o_custkey % 6 AS INT) + 1, 1)) AS name2,
   concat(substring('金木水火土日月星', CAST(o_orderkey % 8 AS INT) + 1, 1), substring('海山川江河湖', CAST(o_orderkey % 6 AS INT) + 1, 1)) AS s_tag,
   concat(substring('东西南北中远宏达', CAST(o_custkey % 8 AS INT) + 1, 1), substring('盛昌隆泰和安', CAST(o_custkey % 6 AS INT) + 1, 1)) AS c_tag
  FROM orders) o) o
"""

#: The spans that detection must find in each contract, as (type, value).
TRUTH = (
    ("COMPANY", "seller"), ("COMPANY", "buyer"), ("NAME", "name1"), ("NAME", "name2"), ("PHONE", "phone"), ("EMAIL", "email"), ("ID_CARD", "id_card"),
    ("TAX_ID", "tax_id"), ("BANK_CARD", "account"), ("CONTRACT_NO", "contract_no"), ("PROJECT_NAME", "'星辰建设计划'"), ("ADDRESS", "address"),
    ("AMOUNT_UPPER", "'壹拾万元整'"), ("BANK_LABEL", "'示例银行广州支行'"), ("URL", "url"), ("AMOUNT", "amount"), ("IP", "ip"),
)



def truth_sql() -> str:
    """``doc_id, type, value, start, end`` of all spans that the contracts hold, from their parts alone."""
    lines = {"seller": "甲方：", "buyer": "乙方：", "name1": "联系人：", "phone": "电话：", "email": "邮箱：", "id_card": "身份证：", "tax_id": "统一社会信用代码：", "account": "收款账号：", "contract_no": "合同号：", "'星辰建设计划'": "项目名：", "address": "地址：", "'壹拾万元整'": "大写：", "'示例银行广州支行'": "开户银行：", "url": "网址：", "amount": "合同", "ip": "服务器IP："}
    arms = []
    for kind, value in TRUTH:
        at = "instr(text, concat(name1, '、', name2)) + length(name1)" if value == "name2" else f"instr(text, concat('{lines[value]}', {value})) - 1 + {len(lines[value])}"
        arms.append(f"SELECT doc_id, '{kind}' AS type, {value} AS value, CAST({at} AS INTEGER) AS start, CAST({at} + length({value}) AS INTEGER) AS \"end\" FROM c")
    return f"WITH c AS ({CONTRACTS}) " + " UNION ALL ".join(arms)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` and the parts of every contract."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    # dealt out, so that a small file's texts keep all cores busy, and made once however often a plan uses them
    return spark.sql(CONTRACTS).repartition(max(spark.sparkContext.defaultParallelism, 2))
