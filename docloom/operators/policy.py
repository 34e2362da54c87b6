"""Evidence policy: which snippets are weak, which questions are refused."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# The policy's word lists and numbers.
@dataclass(frozen=True)
class Policy:
    weak_meta: tuple[str, ...] = ("文档名称：", "产品名称：", "文档类型：", "生效日期：", "状态：演示样本", "状态：演示")
    clause: tuple[str, ...] = ("等待期", "犹豫期", "责任免除", "免赔", "保险责任", "保险金", "本合同", "投保人", "被保险人", "理赔", "除外")
    clause_number: str = r"第\s*[一二三四五六七八九十百零\d]{1,4}\s*条"
    bonus: tuple[str, ...] = ("等待期", "犹豫期", "责任免除", "免赔额", "免赔", "酒驾", "自杀", "重大疾病", "身故", "理赔")
    on_topic: tuple[str, ...] = ("保险", "条款", "等待期", "免赔", "责任免除", "犹豫期", "理赔", "保额", "身故", "重疾", "投保", "保单", "除外", "酒驾", "自杀")
    advice: tuple[str, ...] = ("一定能获赔", "保证获赔", "该不该买", "应不应该买", "推荐购买", "帮我配置", "今天买", "保证理赔")
    chitchat: tuple[str, ...] = ("天气", "北京", "上海", "你好", "讲个笑话", "股票", "足球")
    topic_characters: str = "等待免赔责任犹豫理赔保"
    threshold: float = 0.32
    citation_floor: float = 0.05


# Canned texts of refused questions.
ADVICE_TEXT = "本系统不能给出是否购买保险、是否一定获赔的建议或承诺。"
REFUSAL_TEXT = "未在已入库条款中找到充分依据，无法就该问题给出有引用支撑的结论。"
BOUNDARY = "本系统不构成保险销售或理赔承诺。"
ADVICE_ANSWER = f"【结论】\n{ADVICE_TEXT}\n\n【条款依据】\n演示语料仅用于说明犹豫期、等待期、责任免除等条款检索；真实核保与理赔取决于正式合同与事故事实。\n\n【不确定/边界】\n{BOUNDARY}"
REFUSAL_ANSWER = f"【结论】\n{REFUSAL_TEXT}\n\n【条款依据】\n当前检索结果为空或相关度不足，请换用条款中的术语（如等待期、免赔额、责任免除）重试。\n\n【不确定/边界】\n{BOUNDARY}"
UNAVAILABLE = {"no_key": "LLM 不可用（未配置 API Key），已返回检索片段摘要，未生成完整条款解释。", "failed": "LLM 调用失败，以下为检索到的条款片段摘要。"}
NO_SNIPPET = "（无片段）"
BUSY = "系统当前繁忙，生成答案超时，请稍后重试。"
FACTS_NAME = "知识图谱事实"


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text contains."""
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def clause_marker(text: Column, p: Policy = Policy()) -> Column:
    t = F.coalesce(text, F.lit(""))
    return any_of(t, p.clause) | t.rlike(p.clause_number)


def weak(text: Column, p: Policy = Policy()) -> Column:
    """Cover and metadata snippets: blank; short without a clause marker; mostly labels."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    clause = clause_marker(t, p)
    clauses, metas = hits(t, p.clause) + clause.cast("int"), hits(t, p.weak_meta)
    n = F.char_length(t)
    return (t == "") | ((n < 40) & ~clause) | ((metas >= 2) & (clauses <= 1) & (n < 280)) | ((metas >= 3) & (clauses == 0))


def relevance_bonus(question: Column, text: Column, p: Policy = Policy()) -> Column:
    q, t = F.coalesce(question, F.lit("")), F.coalesce(text, F.lit(""))
    shared = reduce(lambda a, b: a + b, ((F.contains(q, F.lit(w)) & F.contains(t, F.lit(w))).cast("int") for w in p.bonus))
    return shared * 0.15 + clause_marker(t, p).cast("int") * 0.05 - weak(t, p).cast("int") * 0.5


def advice_question(question: Column, p: Policy = Policy()) -> Column:
    return any_of(F.trim(F.coalesce(question, F.lit(""))), p.advice)


def off_topic(question: Column, hit_count: Column, p: Policy = Policy()) -> Column:
    q = F.trim(F.coalesce(question, F.lit("")))
    known = q.rlike(f"[{p.topic_characters}]")
    return F.when(any_of(q, p.on_topic), False).when(any_of(q, p.chitchat), True).when(F.coalesce(hit_count, F.lit(0)) == 0, True).otherwise((F.char_length(q) < 40) & ~known)


def question_error(question: Column) -> Column:
    """Why a question is rejected; NULL if it is taken."""
    q = F.trim(F.coalesce(question, F.lit("")))
    return F.when(q == "", "blank").when(F.char_length(q) > 1000, "too_long")


def answer_kind(question: Column, hit_count: Column, best: Column, has_narrator: Column | bool = True, p: Policy = Policy()) -> Column:
    """The decision ladder of an answer."""
    narrator = has_narrator if isinstance(has_narrator, Column) else F.lit(has_narrator)
    return (
        F.when(advice_question(question, p), "advice")
        .when(off_topic(question, hit_count, p) | (F.coalesce(hit_count, F.lit(0)) == 0) | (F.coalesce(best, F.lit(0.0)) < p.threshold), "refusal")
        .when(~narrator, "llm_unavailable")
        .otherwise("answer")
    )


def inferred_kind(answer: Column) -> Column:
    """Kind read off an answer's text."""
    t = F.coalesce(answer, F.lit(""))
    return F.when(F.contains(t, F.lit(REFUSAL_TEXT[:14])), "refusal").when(F.contains(t, F.lit(ADVICE_TEXT[3:13])), "advice").otherwise("answer")
