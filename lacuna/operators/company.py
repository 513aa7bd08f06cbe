"""The filter of company candidates: which parts of a matched text are company names.

It depends on the candidate's text alone, so it runs as one vectorized function over arrays of candidates, and rows
without candidates cost nothing. Each step below either drops the candidate, shortens it or emits parts of it.

Defined cases: a null array has no candidates, a null or empty candidate no parts; equal candidates have equal parts; a
candidate of any length is read whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists and patterns of the steps.
FORM = re.compile("^(.+?)(有限公司|分公司|公司|集团|集团有限公司|股份有限公司|科技有限公司|投资有限公司|实业有限公司|商贸有限公司)$", re.S)
PREFIX = re.compile("(?:甲方为?|乙方为?|丙方为?|丁方为?|戊方为?|己方为?|庚方为?|辛方为?|壬方为?|癸方为?|方为?|经|因|委托|代理|代表|合作|承办|服务|负责|投资方为|约定以书面形式向|剧目由|本[一-龥]{1,6}由|）|\\)|子公司)")
BARE = re.compile("^(?:有限责任公司|股份有限公司|集团有限公司|集团股份有限公司|股份公司|有限公司|责任公司|集团公司|分公司|子公司|公司|集团)$")
STREET = re.compile("(?:省|市|区|县)[一-龥（）()]{1,10}(?:路|街|道|巷|弄)")
LINKED = re.compile("(?:及其|所属|与各|和各|和代|和顾|和属|及代|及属|及顾|与代|与属|与顾|自己)")
ADVERB = re.compile("^(?:同时|但还|但是|但又|但仍|但须|但必|但需|但得|也同|也得|也须|也必|也需|也仍|也是|仍旧|仍然|仍须|仍必|仍需|仍得|还是|仍是|即便|即是|或是|同样|又同|又还|又须|又得|还需|还能)")
MONTH = re.compile("^(?:上月|本月|当月|次月|下月|同月)")
NOUN = re.compile("^(?:服务|方案|计划|数据|报告|材料|资料|工作|管理|内容|形式|流程|标准|要求|需求|措施|期限|时间|情况|事项)")
REJECT = re.compile("[与和及其了在出于而之则这那每该各自己诸何属]")
ACTION = re.compile("应当|必须|未经|未发生|不视为|代为|代持|履行|实施|办理|开展|进行|安排|寻求|诱使|拒绝|禁止|导致|违反|泄密|放弃|应付|应收|维持|经营|纳入|影响|承诺|损害|完成|变更|制订|聘任|解聘|转让|许可|授权|擅自|指定|批准|予以|给予|协助|配合|应促使|应确保|据此|按约|按照|应向|计入|属于|实际为|系为|变更为|并应办理|已经完成|使得|届时|附件|对外|兹向|持有|持股|偿还|加工|收购|兼并|审议|表决|改变|提前|提取|保证|设立|调整|分红|约定|分配|聘请|审批|减资|增资|利润|弥补|通过|签订|签署|终止|中止|委派|联系|任命|确认|催促|敦促|保持|持续|制定|避免|尽力|促使|维护|竞争|提供|唆使|采取|保护|披露|滥用|盗用|包含|核查|针对|可能|有权|合理|努力|创始|处理|重大|作用|主管|尽最大|均应|若|涉及|知情|通知|督促|归|均|尽|执行|取消|法规|监事|发现|可以|请求|人民法院|解散|注销|不得|侵占|借贷|他人|或者|申请|将|资金|财产|借款|增加|减少|登记|事项|需要|根据|修改|本次|对象|本公司|贵公司|邀请|申报|分摊|并购|同意|范围|原股东|补助|双方|加盖|包括|上述")
COVERB = re.compile("^(?:由[一-龥]{2,8}向|的[一-龥]{0,5}子|对[一-龥]{0,4}集团|为[一-龥]{0,3}集团)")
PRAISE = re.compile("(?:连续|十佳|直接投资|连续多年)")
FIRST = re.compile("^[且并或向对由经及而再还但若就据如在至从被给把让使致需的]")
LAST = re.compile("[且并或向对由经及而再还但若就据如在至从被给把让使以]$")
SHORT = re.compile("^(?:为|以)[一-龥]{0,4}(?:集团|公司)$")
AS_END = re.compile("为[一-龥]{0,4}(?:集团|公司)$")
AS_START = re.compile("^为[一-龥]{8,}(?:集团有限公司|股份有限公司|科技有限公司|投资有限公司|实业有限公司|商贸有限公司|有限公司|分公司|公司|集团)")
GENERIC = re.compile("^(?:公司|集团|子公司)[一-龥]{3,}")
STORY = re.compile("(?:登记|事项|需要|根据|修改|应|或者|以|且|并)")
AGENT_END = re.compile("(?:的|作为?)(?:委托|代理|代表)$")
AGENT = re.compile("委托|代理|代表")
FORM_END = re.compile("(集团有限公司|股份有限公司|科技有限公司|投资有限公司|实业有限公司|商贸有限公司|有限公司|分公司|公司|集团)$")
HAN = re.compile("[一-龥]")

Parts = tuple[tuple[int, int], ...]


def han(text: str) -> int:
    return len(HAN.findall(text))


def named(body: str, least: int = 3) -> bool:
    """Whether a part can be a name: enough Han, no function characters."""
    return han(body) >= least and not REJECT.search(body)


def cut(body: str) -> tuple[int, int]:
    """How much of the body its template prefixes take, and the last one's length. Two prefixes in a row go together."""
    at = last = 0
    while at < len(body) and (m := PREFIX.match(body, at)):
        last = len(m[0])
        at += last
        if at >= len(body) or not PREFIX.match(body, at):
            break
    return at, last


def by_agents(body: str, form: str, at: int) -> Parts:
    """Parts between verbs of agency: those that end in a form, and what follows the last verb with the whole's form."""
    out, pieces = [], AGENT.split(body)
    for i, piece in enumerate(pieces):
        if i == len(pieces) - 1:
            if named(piece) and (i == 0 or len(piece) >= 3):
                out.append((at, len(piece) + len(form)))
        elif len(piece) >= 3 and (m := FORM_END.search(piece)) and named(piece[: m.start()]):
            out.append((at, len(piece)))
        at += len(piece) + 2  # each verb has two characters
        if i < len(pieces) - 1 and len("".join(pieces[i + 1 :])) + 2 * (len(pieces) - i - 2) < 3:
            break  # too little is left after this verb
    return tuple(out)


@lru_cache(maxsize=65536)
def company_parts(value: str) -> Parts:
    """``(offset, length)`` of the company names within a candidate."""
    if "关联公司" in value or value in ("甲方公司", "乙方公司"):
        return ()
    if value.endswith("公司公司"):
        value = value[:-2]
    whole = FORM.match(value)
    if not whole:
        return ()
    form = whole[2]
    at, last = cut(whole[1])
    body = whole[1][at:]
    n = han(body)
    if n < (1 if at else 3) or len(re.findall("[（(]", body)) != len(re.findall("[）)]", body)):
        return ()
    if at and n < (3 if last == 1 else 2):
        return ()
    if BARE.match(value) or STREET.search(body) or LINKED.search(body) or ADVERB.match(body):
        return ()
    given = body.find("提供")
    if given >= 2:
        right = body[given + 2 :]
        month = MONTH.match(right)
        skip = 2 if month else 0
        right = right[skip:]
        if not NOUN.match(right) and named(right, 4 if month else 3):
            return ((at + given + 2 + skip, len(right) + len(form)),)
    if ACTION.search(body) or COVERB.match(body) or PRAISE.search(body) or FIRST.match(body) or LAST.search(body):
        return ()
    if SHORT.match(value) or AS_END.search(body) or AS_START.match(value) or (GENERIC.match(body) and STORY.search(body)) or AGENT_END.search(body):
        return ()
    by = body.find("以")
    if by >= 2 and named(body[by + 1 :]):
        return ((at + by + 1, len(body) - by - 1 + len(form)),)
    if len(body) > 18 and AGENT.search(body) and (parts := by_agents(body, form, at)):
        return parts
    return ((at, len(body) + len(form)),)


def _of_rows(candidates: pd.Series) -> pd.Series:
    return pd.Series([[[{"o": o, "n": n} for o, n in company_parts(v or "")] for v in (row if row is not None else ())] for row in candidates])


def company_spans(candidates: Column) -> Column:
    """For each candidate of a row's array, ``array<struct<o, n>>`` of the parts that are company names."""
    return F.pandas_udf(_of_rows, "array<array<struct<o:int,n:int>>>")(candidates)
