"""Rules of question and case banks as Column expressions: topics, types, difficulty, tags, predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Topics in order with their keywords (in a question, in references, strong and weak ones).
TOPICS = ("民法", "刑法", "行政法", "民诉", "刑诉", "商经", "理论法")
GENERAL = "综合"
QUESTION_WORDS = {
    "民法": ("民法", "民法典", "合同", "租赁", "物权", "侵权", "婚姻", "继承", "担保", "押金"),
    "刑法": ("刑法", "诈骗", "盗窃", "抢劫", "故意", "犯罪", "刑罚", "交通肇事", "受贿", "量刑"),
    "行政法": ("行政法", "行政处罚", "行政许可", "行政复议", "行政机关", "听证", "行政赔偿", "强制", "政府"),
    "民诉": ("民事诉讼", "民诉", "管辖", "起诉", "保全", "执行", "证据", "再审", "调解"),
    "刑诉": ("刑事诉讼", "刑诉", "侦查", "起诉", "审判", "辩护", "取保候审", "证据排除", "羁押"),
    "商经": ("公司法", "证券法", "证券投资基金法", "破产法", "保险法", "票据", "税法", "合伙", "商经", "反垄断", "消费者"),
    "理论法": ("宪法", "法理", "立法法", "法律效力", "法律原则", "法治", "法制史", "司法制度", "理论法"),
}
REFERENCE_WORDS = {
    "民法": ("民法典", "合同法", "物权法", "侵权责任", "婚姻", "继承", "担保", "不动产登记"),
    "刑法": ("刑法", "治安管理处罚法", "交通肇事", "诈骗罪", "盗窃罪", "抢劫罪", "受贿罪", "故意杀人罪"),
    "行政法": ("行政处罚法", "行政许可法", "行政复议法", "行政强制法", "国家赔偿法", "政府信息公开", "行政诉讼法"),
    "民诉": ("民事诉讼法", "仲裁法", "劳动争议调解仲裁法", "农村土地承包经营纠纷调解仲裁法", "人民调解法"),
    "刑诉": ("刑事诉讼法", "公安机关办理刑事案件程序规定", "人民检察院刑事诉讼规则", "非法证据排除"),
    "商经": ("公司法", "证券法", "证券投资基金法", "保险法", "票据法", "企业破产法", "合伙企业法", "反垄断法", "消费者权益保护法", "税收征收管理法"),
    "理论法": ("宪法", "立法法", "法官法", "检察官法", "监察法", "法律职业道德"),
}
STRONG_WORDS = {
    "民法": ("押金", "租赁", "买卖合同", "借款", "担保", "侵权", "婚姻", "继承", "物权", "不当得利", "无因管理"),
    "刑法": ("诈骗罪", "盗窃罪", "抢劫罪", "故意伤害", "故意杀人", "交通肇事", "量刑", "刑罚", "缓刑", "自首", "共同犯罪"),
    "行政法": ("行政处罚", "行政许可", "行政复议", "行政强制", "听证", "政府信息公开", "行政机关", "行政赔偿", "行政诉讼"),
    "民诉": ("民事诉讼", "管辖", "起诉", "诉前保全", "财产保全", "证据保全", "执行异议", "再审", "调解书", "小额诉讼", "申请执行"),
    "刑诉": ("刑事诉讼", "侦查", "辩护权", "取保候审", "羁押", "非法证据排除", "强制措施", "公诉", "不起诉", "讯问"),
    "商经": ("公司法", "证券法", "证券投资基金", "票据", "破产", "保险", "合伙", "反垄断", "消费者权益", "税率", "股东会", "董事会"),
    "理论法": ("宪法", "法理", "立法法", "法律效力", "法治", "司法制度", "法律原则", "法制史", "监察"),
}
WEAK_WORDS = {
    "民法": ("赔偿", "违约"),
    "刑法": ("犯罪", "罪名"),
    "行政法": ("处罚", "许可", "复议", "听证"),
    "民诉": ("执行", "调解", "仲裁", "证据"),
    "刑诉": ("羁押", "侦查", "辩护"),
    "商经": ("基金", "公司", "证券", "消费者", "税"),
    "理论法": ("规范", "原则", "效力"),
}
#: Other names of topics and types, types of task families and their labels.
TOPIC_NAMES = {
    "民法": ("民法", "民法典"),
    "刑法": ("刑法",),
    "行政法": ("行政法", "行政诉讼", "行诉"),
    "民诉": ("民诉", "民事诉讼", "民事诉讼法"),
    "刑诉": ("刑诉", "刑事诉讼", "刑事诉讼法"),
    "商经": ("商经", "商经法", "经济法"),
    "理论法": ("理论法", "法理", "宪法", "立法法"),
    "综合": ("综合",),
}
TYPE_OF_FAMILY = {
    "exam": "single_choice",
    "legal_question_answering": "short_answer",
    "jud_read_compre": "case_analysis",
    "judgement_predit": "case_analysis",
    "sent_pred": "short_answer",
    "sim_case_match": "case_analysis",
    "leg_case_cls": "case_analysis",
    "jud_doc_sum": "case_analysis",
}
TYPE_LABELS = {"single_choice": "单选题", "short_answer": "简答题", "case_analysis": "案例分析题"}
HARD_FAMILIES = ("exam", "jud_read_compre", "judgement_predit")
MEDIUM_FAMILIES = ("legal_question_answering", "sent_pred", "sim_case_match")
#: Marks of questions that need a context they lack, of several right answers, and of an answer's end.
CONTEXT = ("根据以上案例", "根据以上背景", "阅读以上背景", "阅读以上材料", "根据上文", "根据前文", "根据下列材料", "以上案例", "以上背景", "以上材料")
SEVERAL = ("多选", "多项", "下列哪些", "哪些说法", "哪些情形", "哪几项", "哪几种")
ANSWER_ENDS = ("解析：", "解析:", "参考解析：", "参考解析:", "理由：", "理由:")
OPTION_LABELS = ("A", "B", "C", "D")


def _lookup(names: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*(F.lit(x) for name, others in names.items() for other in others for x in (other, name)))


def topic_name(topic: Column) -> Column:
    """The canonical name of a topic; unknown ones as they are."""
    return F.coalesce(F.try_element_at(_lookup(TOPIC_NAMES), F.trim(topic)), F.trim(topic))


def key(text: Column) -> Column:
    """For comparisons: the cleaned text without anything but word characters, lower-cased."""
    return F.lower(F.regexp_replace(T.clean_text(text), r"(?U)[^\w]+", ""))


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text holds, as it is or by its key."""
    text, compact = T.clean_text(text), key(text)
    return reduce(lambda a, b: a + b, (F.when(F.contains(text, F.lit(w)) | F.contains(compact, F.lit(w.lower())), 1).otherwise(0) for w in words))


def topic_scores(question: Column, answer: Column, references: Column) -> Column:
    """(score, topic) of each topic: 8 a reference hit, 4 in the question, 2 strong in the answer, 1 weak in either."""
    titles = F.array_join(F.concat(references, T.cross_references(question), T.cross_references(answer)), " ")
    both = F.concat(question, F.lit(" "), answer)
    score = lambda t: hits(titles, REFERENCE_WORDS[t]) * 8 + hits(question, QUESTION_WORDS[t]) * 4 + hits(answer, STRONG_WORDS[t]) * 2 + hits(both, WEAK_WORDS[t])
    return F.array(*(F.struct(score(t).alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("topic")) for i, t in enumerate(TOPICS)))


def topic(scores: Column) -> Column:
    """The best topic; the general one below 3, and below 8 with a lead of less than 2."""
    ordered = F.sort_array(scores, asc=False)
    best, second = ordered[0], ordered[1]
    return F.when((best["score"] < 3) | ((best["score"] < 8) & (best["score"] - second["score"] < 2)), GENERAL).otherwise(best["topic"])


def difficulty(family: Column, question: Column, answer: Column) -> Column:
    hard = family.isin(*HARD_FAMILIES) | (F.length(question) > 70) | (F.length(answer) > 180)
    return F.when(hard, "hard").when(family.isin(*MEDIUM_FAMILIES), "medium").otherwise("easy")


def question_type(family: Column, is_choice: Column, is_case: Column) -> Column:
    of = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in TYPE_OF_FAMILY.items() for x in p)), family), F.lit("short_answer"))
    return F.when(is_choice, "single_choice").when(is_case, "case_analysis").when(of == "single_choice", "short_answer").otherwise(of)


def task_family(sample_id: Column) -> Column:
    """A sample's id without its number, hyphens as underscores."""
    return F.translate(F.regexp_replace(sample_id, r"[-_]\d+$", ""), "-", "_")


def tags(topic_: Column, question: Column, answer: Column, references: Column, type_: Column) -> Column:
    """The topic, two references, the type's label, keywords of the topic that occur; five at most."""
    label = F.try_element_at(F.create_map(*(F.lit(x) for p in TYPE_LABELS.items() for x in p)), type_)
    both = F.concat(question, F.lit(" "), answer)
    words = F.try_element_at(F.create_map(*(x for t, w in QUESTION_WORDS.items() for x in (F.lit(t), F.array(*map(F.lit, w))))), topic_)
    found = F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.contains(both, w))
    return F.slice(F.array_distinct(F.array_compact(F.concat(F.array(topic_), F.slice(references, 1, 2), F.array(label), found))), 1, 5)


def needs_context(text: Column) -> Column:
    """A question that speaks of a text it does not bring along; empty ones too."""
    return (F.trim(F.coalesce(text, F.lit(""))) == "") | T.contains_any(text, CONTEXT)


def options_consistent(options: Column, answer: Column) -> Column:
    """Four options A to D of different normalised texts, of which the answer is one. ``options``: array of the four texts, null where missing."""
    values = F.transform(F.array_compact(options), T.normalize_answer)
    return (F.size(F.array_distinct(F.filter(values, lambda x: x != ""))) == 4) & F.upper(F.trim(answer)).isin(*OPTION_LABELS)


def answer_head(answer: Column) -> Column:
    """The cleaned answer up to where its explanation starts."""
    return F.trim(F.split(T.clean_text(answer), "|".join(ANSWER_ENDS), 2)[0])


def rejected(question: Column, answer: Column) -> Column:
    """Questions of several right answers: by their words, or by more than one option label before the explanation."""
    return T.contains_any(question, SEVERAL) | (F.regexp_count(answer_head(answer), F.lit("[A-D](?:[.．、:：]|$)")) > 1)


def long_enough(question: Column, answer: Column, summary: Column, is_choice: Column) -> Column:
    return (F.length(question) >= 8) & (is_choice | ((F.length(answer) >= 16) & (F.length(summary) >= 12)))


def topic_quality(primary: Column, tags_: Column, wanted: Column) -> Column:
    """2 where the topic is the record's own, 1 where one of its tags names it."""
    wanted = topic_name(wanted)
    return F.when(topic_name(primary) == wanted, 2).when(F.exists(tags_, lambda t: topic_name(t) == wanted), 1).otherwise(0)


def normalize_choice(answer: Column, options: Column) -> Column:
    """An answer as a label: a label, the label of the option with this text, or else its first character."""
    value = F.trim(F.coalesce(answer, F.lit("")))
    compact = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))
    same = F.array_position(F.transform(options, lambda x: compact(F.coalesce(x, F.lit("")))), compact(value))
    return F.when(value == "", "").when(F.upper(value).isin(*OPTION_LABELS), F.upper(value)).when(same > 0, F.get(F.array(*map(F.lit, OPTION_LABELS)), (same - 1).cast("int"))).otherwise(F.substring(F.upper(value), 1, 1))


#: An inline answer, and an answer that starts a line or follows white space.
INLINE_ANSWER = r"(?:第\s*)?(\d+)\s*(?:题)?\s*[\.、:：\-）)]?\s*([A-Da-d])(?=(?:\s|$))"
NUMBERED_ANSWER = r"(?ms)(?:(?<=^)|(?<=[\n\r\t ]))(?:第\s*)?(\d+)\s*(?:题)?\s*[\.、:：\-）)]\s*(.*?)(?=(?:(?<=^)|(?<=[\n\r\t ]))(?:第\s*)?\d+\s*(?:题)?\s*[\.、:：\-）)]|\Z)"


def answer_sheet(text: Column) -> Column:
    """Map of question number to answer: inline choices on a single line, or else numbered blocks, or else inline choices. The last answer of a number holds."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    text = strip(F.coalesce(text, F.lit("")))

    def found(pattern: str, upper: bool) -> Column:
        groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2)]
        pairs = F.transform(F.arrays_zip(groups[0].alias("i"), groups[1].alias("a")), lambda p: F.struct(p["i"].cast("int").cast("string").alias("i"), strip(F.upper(p["a"]) if upper else p["a"]).alias("a")))
        pairs = F.filter(pairs, lambda p: p["a"] != "")
        last = F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, k + 2, F.size(pairs)), lambda q: q["i"] == p["i"]))
        return F.map_from_entries(last)

    inline, blocks = found(INLINE_ANSWER, True), found(NUMBERED_ANSWER, False)
    return F.when((F.size(inline) > 0) & ~F.contains(text, F.lit("\n")), inline).when(F.size(blocks) > 0, blocks).otherwise(inline)


def grade_level(ratio: Column, type_: Column, answer: Column) -> Column:
    """Of an answer's share of the points: mastered from .78 (cases .82), review from .5 (cases .45)."""
    case = type_ == "case_analysis"
    return F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", "unanswered").when(ratio >= F.when(case, 0.82).otherwise(0.78), "mastered").when(ratio >= F.when(case, 0.45).otherwise(0.5), "review").otherwise("incorrect")


def subjective_ratio(answer: Column, reference: Column) -> Column:
    """Share of the points by exact match, token F1 and key points met (F1 of .34; five points of six characters at most)."""
    point = lambda p: F.regexp_replace(p, "^[；;。,.：:]+|[；;。,.：:]+$", "")
    points = F.slice(F.filter(F.transform(F.split(reference, r"[；;。\n]"), point), lambda p: F.length(p) >= 6), 1, 5)
    met = lambda given, points: F.size(F.filter(points, lambda p: (T.token_f1(given, T.tokens(p)) >= 0.34) | (T.exact_match(answer, p) >= 1)))
    share = lambda given: T.bind(points, lambda points: F.when(F.size(points) > 0, met(given, points) / F.size(points)).otherwise(0.0))
    ratio = lambda given, share: F.least(F.lit(1.0), F.greatest(T.exact_match(answer, reference), T.token_f1(given, T.tokens(reference)) * 0.75 + share * 0.25, share))
    return T.bind(T.tokens(answer), lambda given: T.bind(share(given), lambda share: ratio(given, share)))
