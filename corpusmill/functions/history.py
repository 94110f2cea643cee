"""What a turn of a dialogue leaves behind: keywords, open questions, digests, and the summary of several turns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Marks of an open question, words that are no keywords, the summaries' wording and lengths.
FOLLOWUP_MARKERS = ("请补充", "需要确认", "请说明", "是否", "要不要", "还需要")
STOPWORDS = ("用户", "助手", "这个", "那个", "一下", "已经", "需要", "问题", "可以", "继续", "当前", "本次", "本轮", "还有", "然后")
REQUEST, TOOLS, RESULT, USED = "用户请求：", "执行工具：", "结果：", "本轮主要依赖工具 {} 完成任务。"
USER, ASSISTANT, PRESSED, AROUND = "用户：", "；助手：", "历史压缩摘要：", "围绕 {} 持续展开。"
OPEN_CHARS, REQUEST_CHARS, RESULT_CHARS, DIGEST_CHARS, ANSWER_CHARS, USER_CHARS, ASSISTANT_CHARS, SUMMARY_CHARS = 120, 96, 140, 220, 160, 56, 72, 360


def _bind(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def top_keywords(tokens: Column, limit: int) -> Column:
    """The most frequent tokens, those seen first before others as frequent; no stop words, no single characters but CJK ones."""
    own = F.filter(tokens, lambda t: ~t.isin(*STOPWORDS) & ((F.length(t) > 1) | t.rlike("^[一-鿿]$")))
    places = F.array_sort(F.transform(own, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    starts = lambda s: F.filter(F.transform(s, lambda x, k: F.when((k == 0) | (x["t"] != F.get(s, k - 1)["t"]), k)), lambda k: k.isNotNull())
    counts = lambda s, r: F.transform(r, lambda p, k: F.struct((p - F.coalesce(F.get(r, k + 1), F.size(s))).alias("n"), F.get(s, p)["i"].alias("i"), F.get(s, p)["t"].alias("t")))
    return _bind(places, lambda s: _bind(starts(s), lambda r: F.transform(F.slice(F.array_sort(counts(s, r)), 1, limit), lambda c: c["t"])))


def open_loop(answer: Column) -> Column:
    """The answer cut short if it leaves a question open, else null."""
    own = F.trim(F.coalesce(answer, F.lit("")))
    return F.when((own != "") & (own.rlike("[?？]$") | T.contains_any(own, FOLLOWUP_MARKERS)), T.truncate_text(own, OPEN_CHARS))


def _listed(tools: Column) -> Column:
    return F.array_join(F.slice(T.dedupe_strings(tools), 1, 4), "、")


def turn_summary(request: Column, tools: Column, answer: Column) -> Column:
    named = F.when(F.size(T.dedupe_strings(tools)) > 0, F.concat(F.lit(TOOLS), _listed(tools)))
    return F.concat_ws("；", F.concat(F.lit(REQUEST), T.truncate_text(F.coalesce(request, F.lit("")), REQUEST_CHARS)), named, F.concat(F.lit(RESULT), T.truncate_text(F.coalesce(answer, F.lit("")), RESULT_CHARS)))


def reasoning_digest(trace: Column, tools: Column, answer: Column) -> Column:
    """The last three lines of the trace but for final answers; without, the tools; without these, the answer cut short."""
    lines = F.filter(F.transform(F.split(F.coalesce(trace, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("Final Answer:"))
    last = F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), 3)
    before, after = USED.split("{}")
    by_tools = F.when(F.size(T.dedupe_strings(tools)) > 0, F.concat(F.lit(before), _listed(tools), F.lit(after)))
    return F.when(F.size(lines) > 0, T.truncate_text(F.array_join(last, "；"), DIGEST_CHARS)).otherwise(F.coalesce(by_tools, T.truncate_text(F.coalesce(answer, F.lit("")), ANSWER_CHARS)))


def compressed_summary(turns: Column) -> Column:
    """(summary, tags, open_loops) of an array of turns (request, answer), in order: keywords of all, and the first two and last two turns, of which three are shown."""
    tokens = F.flatten(F.concat(F.transform(turns, lambda t: T.tokens(t["request"])), F.transform(turns, lambda t: T.tokens(t["answer"]))))
    shown = F.concat(F.slice(turns, 1, 2), F.slice(turns, F.greatest(F.size(turns) - 1, F.lit(1)), 2))
    snippets = F.transform(F.slice(shown, 1, 3), lambda t: F.concat(F.lit(USER), T.truncate_text(t["request"], USER_CHARS), F.lit(ASSISTANT), T.truncate_text(t["answer"], ASSISTANT_CHARS)))
    before, after = AROUND.split("{}")
    around = lambda words: F.when(F.size(words) > 0, F.concat(F.lit(before), F.array_join(F.slice(words, 1, 5), "、"), F.lit(after))).otherwise("")
    loops = F.slice(F.array_distinct(F.array_compact(F.transform(turns, lambda t: open_loop(t["answer"])))), 1, 4)
    made = lambda words: F.struct(T.truncate_text(F.concat(F.lit(PRESSED), around(words), F.lit(" "), F.array_join(snippets, " | ")), SUMMARY_CHARS).alias("summary"), F.slice(words, 1, 6).alias("tags"), loops.alias("open_loops"))
    return _bind(top_keywords(tokens, 8), made)
