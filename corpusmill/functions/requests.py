"""What a user's message asks for, as Column expressions: intents, slots of an exam, predicates; the agent's steps and a calculator."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import text as T

#: Words by which a message is told, and the scores of intents.
CALCULATE = ("计算", "算", "赔偿", "补偿", "罚款", "税额", "利息", "金额", "数额")
PROFILE_VIEW = ("我的档案", "我的画像", "我的信息", "查看档案", "查看画像", "学习情况", "学习状态", "我的学习")
REPORT = ("报告", "总结", "学习画像", "学习总结", "学习报告", "周报", "复盘")
EXAM = ("法考测试", "模拟测试", "出题", "练习题", "刷题", "来一套", "模拟卷", "测试题", "做套题", "考考我", "测验", "练习练习", "给我几道题", "复习", "薄弱点", "错题")
SUBJECTS = ("民法", "刑法", "行政法", "民诉", "刑诉", "商经", "理论法", "宪法", "国际法", "环境法", "经济法", "知识产权法")
PROFILE_UPDATE = ("记住", "我是", "我叫", "我在备考", "我的薄弱点", "我的强项", "目标分数")
FOLLOWUP = ("回答", "答案是", "选", "我的选择", "我选")
FOLLOWUP_WHOLE = ("是", "否", "对", "错", "有", "没有", "好的", "ok", "yes", "no")
STOP = ("不想做了", "算了", "停止", "取消", "不做了", "退出", "结束", "不想继续了", "放弃", "别问了", "不用了", "就这样吧", "到此为止")
STOP_WHOLE = ("停", "停一下", "等等", "暂停", "休息", "不问了", "不学了")
KEYWORD_SUBJECTS = {
    "合同": "民法", "物权": "民法", "侵权": "民法", "婚姻": "民法", "继承": "民法", "犯罪": "刑法", "刑罚": "刑法", "盗窃": "刑法", "诈骗": "刑法", "行政诉讼": "行政法", "行政处罚": "行政法", "民事诉讼": "民诉", "刑事诉讼": "刑诉", "公司": "商经", "破产": "商经", "票据": "商经",
}
NUMBERS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "两": 2}
EXAM_TYPES = {"薄弱点强化": ("薄弱", "错题", "弱点", "容易错"), "章节练习": ("章节", "第.*章", "专项"), "真题模拟": ("真题", "历年", "往年", "真实考题"), "冲刺练习": ("冲刺", "押题", "预测", "密卷")}
EXAM_TYPE = "综合练习"
REPORT_REQUEST = ("学习报告", "报告", "复盘", "诊断报告")
EXAM_REQUEST = ("模拟测试", "模拟题", "出题", "组卷", "练习题")
SCORES = {"profile_lookup": 0.9, "mock_exam_score": 0.95, "report_generation": 0.85, "mock_exam_generate": 0.9, "profile_update": 0.95, "legal_calculation": 0.8, "followup_answer": 0.7}
TOOL_INTENTS = (("score_exam", "mock_exam_score"), ("generate_exam", "mock_exam_generate"), ("generate_report", "report_generation"), ("rag_search", "legal_qa"), ("retrieve_from_kb", "legal_qa"), ("lookup_statute", "legal_qa"), ("resolve_hierarchy", "legal_qa"), ("profile_upsert", "profile_update"), ("profile_view", "profile_lookup"), ("calculator", "legal_calculation"))

_SHEET = r"(?m)^\s*\d+\s*[\.、:：-]"


def _bare(query: Column) -> Column:
    return F.regexp_replace(F.coalesce(query, F.lit("")), r"(?U)\s+", "")


def is_stop(query: Column) -> Column:
    return T.contains_any(_bare(query), STOP) | _bare(query).isin(*STOP_WHOLE)


def is_sheet(query: Column) -> Column:
    return query.rlike(_SHEET) | T.contains_any(query, ("我的答案", "提交答案"))


def is_followup(query: Column) -> Column:
    bare = _bare(query)
    return (F.length(bare) <= 80) & (T.contains_any(bare, FOLLOWUP) | bare.rlike(_SHEET) | bare.isin(*FOLLOWUP_WHOLE))


def is_calculation(query: Column) -> Column:
    return query.rlike(r"\d") & (query.rlike(r"[+\-*/%()]") | T.contains_any(query, CALCULATE))


def intent(query: Column, active_exam: Column, legal: tuple[str, ...], general: tuple[str, ...]) -> Column:
    """(intent, score): of the intents that fit the one of the highest score, the first in order among equals; else a legal or a general question by the words given."""
    bare = _bare(query)
    update = T.contains_any(bare, PROFILE_UPDATE)
    fits = (
        (T.contains_any(bare, PROFILE_VIEW), "profile_lookup", SCORES["profile_lookup"]),
        (is_sheet(bare) & active_exam, "mock_exam_score", SCORES["mock_exam_score"]),
        (~is_sheet(bare) & is_followup(bare) & active_exam, "mock_exam_score", SCORES["followup_answer"]),
        (T.contains_any(bare, REPORT), "report_generation", SCORES["report_generation"]),
        (T.contains_any(bare, EXAM) & ~update, "mock_exam_generate", SCORES["mock_exam_generate"]),
        (update, "profile_update", SCORES["profile_update"]),
        (is_calculation(bare), "legal_calculation", SCORES["legal_calculation"]),
        (is_followup(bare) & ~active_exam, "followup_answer", SCORES["followup_answer"]),
    )
    of = lambda name, score: F.struct(F.lit(name).alias("intent"), F.lit(score).alias("score"))
    first = lambda found: F.array_max(F.transform(found, lambda x, i: F.struct(x["score"].alias("score"), (-i).alias("order"), x["intent"].alias("intent"))))
    found = F.array_compact(F.array(*(F.when(fit, of(name, score)) for fit, name, score in fits)))
    best = F.when(F.size(found) > 0, F.struct(first(found)["intent"].alias("intent"), first(found)["score"].alias("score")))
    other = F.when(T.contains_any(query, legal), of("legal_qa", 0.6)).when(T.contains_any(query, general), of("general_qa", 0.85)).otherwise(of("general_qa", 0.4))
    return F.when(bare == "", of("legal_qa", 0.0)).when(is_stop(query), of("stop", 0.95)).otherwise(F.coalesce(best, other))


def topic(query: Column, weak: Column) -> Column:
    """A subject named in the message, the subject of a keyword, the user's first weak point, or the general one."""
    named = [F.when(F.contains(query, F.lit(s)), s) for s in SUBJECTS] + [F.when(F.contains(query, F.lit(k)), s) for k, s in KEYWORD_SUBJECTS.items()]
    return F.coalesce(*named, F.get(weak, F.lit(0)), F.lit("综合"))


def question_count(query: Column, default: int = 5) -> Column:
    """How many questions are asked for, 1 to 20."""
    digits = F.nullif(F.regexp_extract(query, r"(\d{1,2})\s*题", 1), F.lit(""))
    word = F.coalesce(*(F.when(F.contains(query, F.lit(w)) & F.contains(query, F.lit("题")), n) for w, n in NUMBERS.items()))
    other = F.nullif(F.regexp_extract(query, r"(\d{1,9})\s*(?:道|个)\s*题", 1), F.lit(""))
    clamp = lambda n: F.greatest(F.lit(1), F.least(F.lit(20), n.cast("int")))
    return F.coalesce(clamp(digits), word, clamp(other), F.lit(default))


def exam_type(query: Column) -> Column:
    return F.coalesce(*(F.when(query.rlike("|".join(words)), name) for name, words in EXAM_TYPES.items()), F.lit(EXAM_TYPE))


def question_types(query: Column) -> Column:
    bare = _bare(query)
    return F.when(T.contains_any(bare, ("简答", "主观", "问答")), "short_answer").when(T.contains_any(bare, ("案例",)), "case_analysis").otherwise("single_choice,short_answer,case_analysis")


def report_type(query: Column) -> Column:
    low = F.lower(query)
    return F.when(T.contains_any(low, ("诊断", "薄弱")), "weakness_diagnosis").when(T.contains_any(low, ("测试", "exam", "mock")), "mock_exam_review").otherwise("study_progress")


def agent_intent(tools: Column, waits: Column) -> Column:
    """What an agent's turn was for, by the tools it used, the first of the list that it did."""
    return F.when(waits, "clarification").otherwise(F.coalesce(*(F.when(F.array_contains(tools, t), i) for t, i in TOOL_INTENTS), F.lit("legal_qa")))


def react_step(text: Column) -> Column:
    """kind (tool, final or invalid), tool, args and answer of a step: an action before the final answer counts."""
    clean = F.regexp_replace(text, r"^[\s`]+|[\s`]+$", "")
    action = F.regexp_extract(clean, r"(?m)^Action:\s*([A-Za-z_][A-Za-z0-9_]*)\((.*)\)\s*$", 0)
    part = lambda k: F.regexp_extract(clean, r"(?m)^Action:\s*([A-Za-z_][A-Za-z0-9_]*)\((.*)\)\s*$", k)
    last = F.regexp_extract(clean, r"(?ms)^Final Answer:\s*(.*)", 0)
    first = (action != "") & ((last == "") | (F.locate("Action:", clean) < F.locate("Final Answer:", clean)))
    kind = F.when(first, "tool").when(last != "", "final").otherwise("invalid")
    return F.struct(kind.alias("kind"), F.when(kind == "tool", part(1)).alias("tool"), F.when(kind == "tool", part(2)).alias("args"), F.when(kind == "final", F.trim(F.regexp_extract(clean, r"(?ms)^Final Answer:\s*(.*)", 1))).alias("answer"))


#: Units of Chinese numbers, how signs are written otherwise, and names of the yuan after a number.
UNITS = {"亿": 10**8, "万": 10**4, "千": 1000, "百": 100}
SIGNS = {"（": "(", "）": ")", "，": ",", "。": ".", "×": "*", "x": "*", "X": "*", "÷": "/", "＋": "+", "－": "-", "^": "**", "倍": ""}
YUAN = ("元", "块钱", "块")
_NUMBER = r"(\d+(?:\.\d+)?)\s*"
_BINARY: dict[type, Callable] = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv, ast.Pow: operator.pow}
_CALLS: dict[str, Callable] = {"round": round, "abs": abs, "min": min, "max": max}
#: A power beyond these could take the worker's memory.
_BASE, _POWER = 1e6, 64


def plain_sum(expression: str) -> str:
    """The expression in plain signs: no commas in thousands, each percentage as a quotient, no yuan, units multiplied out. A % after a number is always a percentage, and every x a multiplication, also that of max."""
    text = expression.strip().translate(str.maketrans(SIGNS))
    text = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text)
    text = re.sub(_NUMBER + "[%％]", r"(\1/100)", text)
    text = re.sub(_NUMBER + f"(?:{'|'.join(YUAN)})", r"\1", text)
    return re.sub(_NUMBER + f"([{''.join(UNITS)}])", lambda m: f"({m[1]}*{UNITS[m[2]]})", text)


#: A number that ast reads as itself wherever it stands, and what may join or cut numbers when signs are translated.
_PLAIN = re.compile(r"(?<![A-WYZa-wyz_.。\d])((?:0|[1-9][0-9]{0,14})(?:\.[0-9]+)?)(?![A-WYZa-wyz_.。\d])")
_JOINS = re.compile(r"\d[,，。]\d|倍[\d,，.。]|[,，.。]倍|[元块钱][\d,，.。]")
_DIGIT = re.compile(r"\d")
#: Stands for the first number of an expression's form; those after it follow.
_FIRST = 10**15


@lru_cache(4096)
def _form(texts: tuple[str, ...]) -> Callable[[list[float]], float] | None:
    """What an expression does with its numbers, given what stands between them; None where it is no arithmetic."""
    text = texts[0] + "".join(f"{_FIRST + i}{t}" for i, t in enumerate(texts[1:]))

    def made(node: ast.AST) -> Callable[[list[float]], float]:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            fixed = float(node.value)
            if fixed < _FIRST:
                return lambda v: fixed
            at = int(node.value) - _FIRST
            if at > len(texts) - 2:
                raise LookupError("numbers have met")
            return lambda v: v[at]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            own, sign = made(node.operand), -1 if isinstance(node.op, ast.USub) else 1
            return lambda v: own(v) * sign
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            a, b, f = made(node.left), made(node.right), _BINARY[type(node.op)]
            return (lambda v: _power(a(v), b(v))) if f is operator.pow else (lambda v: f(a(v), b(v)))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            args, call = [made(x) for x in node.args], _CALLS[node.func.id]
            if call is round and len(args) == 2:
                return lambda v: float(round(args[0](v), int(args[1](v))))
            return lambda v: float(call(*(x(v) for x in args)))
        raise ValueError("not arithmetic")

    try:
        return made(ast.parse(plain_sum(text), mode="eval").body)
    except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
        return None


def _power(a: float, b: float) -> float:
    if abs(a) > _BASE or abs(b) > _POWER:
        raise ValueError("power too large")
    return a**b


def calculated(expression: str | None) -> float | None:
    """``calculate``, for very many expressions of few forms: a form is parsed once, and expressions with other numbers in it are not."""
    parts = _PLAIN.split(expression or "")
    if _JOINS.search(expression or "") or any(_DIGIT.search(t) for t in parts[::2]):
        return _remembered(expression)
    try:
        form = _form(tuple(parts[::2]))
    except LookupError:
        return _remembered(expression)
    if form is None:
        return None
    try:
        found = form([float(x) for x in parts[1::2]])
        return found if isinstance(found, float) and found == found and abs(found) != float("inf") else None
    except (ValueError, ZeroDivisionError, OverflowError, TypeError, RecursionError):
        return None


def calculate(expression: str | None) -> float | None:
    """The value of an arithmetic expression (see ``plain_sum``): numbers, + - * / // % ** and brackets, abs, min, max and round; nothing else is run. None where it is no such thing."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return float(node.value)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return value(node.operand) * (-1 if isinstance(node.op, ast.USub) else 1)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and (abs(a) > _BASE or abs(b) > _POWER):
                raise ValueError("power too large")
            return _BINARY[type(node.op)](a, b)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            own = [value(x) for x in node.args]
            return float(round(own[0], int(own[1]))) if node.func.id == "round" and len(own) == 2 else float(_CALLS[node.func.id](*own))
        raise ValueError("not arithmetic")

    try:
        found = value(ast.parse(plain_sum(expression or ""), mode="eval").body)
        return found if isinstance(found, float) and found == found and abs(found) != float("inf") else None
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError, RecursionError, MemoryError):
        return None


_remembered = lru_cache(65_536)(calculate)


def calculator(expression: Column) -> Column:
    return F.pandas_udf(lambda x: pd.Series([calculated(e) for e in x], dtype="float64"), DoubleType())(expression)
