"""Bank and exam queries: topics, types, tags, filters, pools, answer sheets, grades, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ._inline import Every, Inline, Spread, strings


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


ITEMS = Spread(
    "id int, sample string, question string, answer string, refs array<string>",
    [
        (1, "exam-12", "租赁合同到期后，房东拒绝退还押金，租客应当如何主张？", "依据《民法典》，出租人应当返还押金，担保目的消灭后不得扣留。", ["民法典"]),
        (2, "legal_question_answering_3", "盗窃与诈骗如何区分？", "盗窃罪以秘密窃取为手段，诈骗罪以欺骗为手段。", []),
        (3, "jud-read-compre-9", "根据以上案例，法院应如何判决？", "应当驳回。", []),
        (4, "sent_pred_100", "下列哪些说法正确？", "A.对 B.错 解析：略", ["行政处罚法"]),
        (5, "other", "证据", "证据", []),
        (6, "sim-case-match-7", "公司法规定股东会与董事会的职权，请说明两者的关系。", "股东会是权力机构，董事会是执行机构；解析：见公司法。", ["公司法", "证券法", "票据法"]),
        (7, "jud_doc_sum_1", "", "无", []),
        (8, "leg-case-cls-2", "侦查阶段可以取保候审吗？ 辩护人何时介入？", "可以。取保候审属于强制措施，侦查期间即可委托辩护人。" * 8, ["刑事诉讼法"]),
    ], texts=("question", "answer"))


def items(spark: SparkSession, d: str) -> DataFrame:
    own = ITEMS.df(spark, d).withColumn("family", R.task_family(F.col("sample"))).withColumn("scores", R.topic_scores(F.col("question"), F.col("answer"), F.col("refs")))
    own = own.withColumn("topic", R.topic(F.col("scores"))).withColumn("difficulty", R.difficulty(F.col("family"), F.col("question"), F.col("answer")))
    return own.withColumn("type", R.question_type(F.col("family"), F.lit(False), F.col("id") == 6))


def topic_inference(spark: SparkSession, d: str) -> DataFrame:
    best = F.sort_array("scores", asc=False)[0]["score"]
    return items(spark, d).select("id", "family", "topic", best.alias("score"))


def bank_rules(spark: SparkSession, d: str) -> DataFrame:
    q, a = F.col("question"), F.col("answer")
    return items(spark, d).select("id", "type", "difficulty", F.array_join(R.tags(F.col("topic"), q, a, F.col("refs"), F.col("type")), "|").alias("tags"), R.needs_context(q).alias("needs_context"), R.rejected(q, a).alias("rejected"), R.long_enough(q, a, R.answer_head(a), F.lit(False)).alias("long_enough"), R.key(q).alias("compare"))


def difficulty_rules(spark: SparkSession, d: str) -> DataFrame:
    """Documents as questions: source and language stand for task families, the text for the answer."""
    families = F.when(F.col("lang") == "en", "legal_question_answering").when(F.col("lang") == "de", "sent_pred").otherwise("jud_doc_sum")
    own = _t(spark, d, "documents").select("doc_id", families.alias("family"), F.coalesce("source", F.lit("")).alias("question"), "text")
    own = own.select("doc_id", "family", R.difficulty(F.col("family"), F.col("question"), F.col("text")).alias("difficulty"), R.question_type(F.col("family"), F.length("text") < 60, F.length("text") > 3000).alias("type"))
    return own


def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    return difficulty_rules(spark, d).groupBy("family", "type", "difficulty").agg(F.count("*").alias("n"))


#: ASCII terms of the invented prose stand for a topic's keywords.
_TERMS = {"alpha": ("tion", "ing"), "beta": ("der", "sch"), "gamma": ("que", "les")}


def topic_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Topics by hits of their terms in the text, 4 each and 2 where the term is in the last 200 characters too; none below 3, or without a lead of 2 below 8."""
    text = F.lower("text")
    score = lambda words: sum(F.when(F.contains(text, F.lit(w)), 4).otherwise(0) + F.when(F.contains(F.right(text, F.lit(200)), F.lit(w)), 2).otherwise(0) for w in words)
    scores = F.sort_array(F.array(*(F.struct(score(w).alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("topic")) for i, (t, w) in enumerate(_TERMS.items()))), asc=False)
    own = _t(spark, d, "documents").filter("text IS NOT NULL").select(scores.alias("s"))
    weak = (F.col("s")[0]["score"] < 3) | ((F.col("s")[0]["score"] < 8) & (F.col("s")[0]["score"] - F.col("s")[1]["score"] < 2))
    return own.select(F.when(weak, "general").otherwise(F.col("s")[0]["topic"]).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


SHEETS = Every(
    "id int, sheet string",
    [(1, "1.A 2.b 3 C"), (2, "第1题：押金应当返还\n第2题：不构成犯罪\n仍需补偿"), (3, "1、B\n2、D"), (4, "没有答案"), (5, ""), (6, "1.A 1.C"), (7, None), (8, "12) d")], ids=('id',))
#: What a sheet reads as, by hand: DuckDB's expressions know no look-behind.
_READ = [(1, "1", "A"), (1, "2", "B"), (1, "3", "C"), (2, "1", "押金应当返还"), (2, "2", "不构成犯罪\n仍需补偿"), (3, "1", "B"), (3, "2", "D"), (6, "1", "C"), (8, "12", "D")]


def answer_sheets(spark: SparkSession, d: str) -> DataFrame:
    return SHEETS.df(spark, d).select("id", F.explode(R.answer_sheet(F.col("sheet"))).alias("number", "answer"))


EXAM = Every(
    "user int, number int, type string, options array<string>, gold string, answer string, tags array<string>, score int",
    [
        (1, 1, "single_choice", ["甲", "乙", "丙", "丁"], "B", "b", ["民法", "押金"], 20),
        (1, 2, "single_choice", ["甲", "乙", "丙", "丁"], "C", "丁", ["刑法"], 20),
        (1, 3, "single_choice", ["x y", "z", "w", "v"], "A", "XY", ["民诉", "民法"], 20),
        (1, 4, "short_answer", None, "应当返还押金并支付利息；承租人可以起诉。", "应当返还押金并支付利息", ["民法"], 20),
        (1, 5, "case_analysis", None, "构成盗窃罪；依法从轻处罚。", "", ["刑法", "量刑"], 30),
        (2, 1, "single_choice", ["甲", "乙", "丙", "丁"], "D", None, ["商经"], 20),
        (2, 2, "short_answer", None, "法不溯及既往原则。", "法不溯及既往原则", ["理论法"], 20),
    ], ids=('user',))


def graded(spark: SparkSession, d: str) -> DataFrame:
    own = EXAM.df(spark, d)
    choice = F.col("type") == "single_choice"
    given = R.normalize_choice(F.col("answer"), F.col("options"))
    ratio = F.when(choice, F.when(given == F.col("gold"), 1.0).otherwise(0.0)).otherwise(F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", 0.0).otherwise(R.subjective_ratio(F.coalesce("answer", F.lit("")), F.col("gold"))))
    own = own.withColumn("ratio", ratio).withColumn("earned", F.round(F.col("score") * F.col("ratio")).cast("int"))
    level = F.when(choice & (given == ""), "unanswered").when(choice, F.when(F.col("ratio") == 1, "mastered").otherwise("incorrect")).otherwise(R.grade_level(F.col("earned") / F.col("score"), F.col("type"), F.col("answer")))
    return own.withColumn("level", level)


def exam_grades(spark: SparkSession, d: str) -> DataFrame:
    return graded(spark, d).select("user", "number", "level", "earned")


def exam_rollup(own: DataFrame, user: str = "user") -> DataFrame:
    """Points, percent, counts by level, and tags: strong ones of mastered questions that are not weak, weak ones of all others; eight each in order of first sight."""
    ordered = lambda kept: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("number", "tags")))), lambda x: x["tags"])))
    mastered = F.col("level") == "mastered"
    rolled = own.groupBy(user).agg(F.sum("earned").alias("earned"), F.sum("score").alias("total"), *(F.count_if(F.col("level") == x).alias(x) for x in ("mastered", "review", "incorrect", "unanswered")), ordered(~mastered).alias("weak"), ordered(mastered).alias("strong"))
    return rolled.withColumn("percent", F.round(F.col("earned") * 100.0 / F.greatest("total", F.lit(1)), 2)).withColumn("strong", F.slice(F.array_except("strong", "weak"), 1, 8)).withColumn("weak", F.slice("weak", 1, 8))


def weak_strong(spark: SparkSession, d: str) -> DataFrame:
    return exam_rollup(graded(spark, d)).withColumn("weak", F.array_join("weak", "|")).withColumn("strong", F.array_join("strong", "|"))


#: The same by hand: user, earned, total, mastered, review, incorrect, unanswered, weak, strong, percent.
_ROLLED = [(1, 54, 110, 2, 1, 1, 1, "刑法|民法|量刑", "押金|民诉", 49.09), (2, 20, 40, 1, 0, 0, 1, "商经", "理论法", 50.0)]


def wrong_questions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's bank of failed kinds: failures since the last success, the time of the last; the ten latest of a user."""
    own = _t(spark, d, "events").select("user_id", "event_type", "ts", "event_id", (F.col("value") < 40).alias("failed"))
    mastered = own.filter("NOT failed").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("ok"))
    left = own.filter("failed").join(mastered, ["user_id", "event_type"], "left").filter("ok IS NULL OR struct(ts, event_id) > ok")
    bank = left.groupBy("user_id", "event_type").agg(F.count("*").alias("fail_count"), F.max("ts").alias("last"))
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last"), "event_type"))
    return bank.withColumn("rn", rn).filter("rn <= 10").select("user_id", "event_type", "fail_count", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


RECORDS = Every(
    "id int, title string, type string, options array<string>, answer string, reference string, primary_topic string, tags array<string>",
    [
        (1, "租赁合同的押金如何处理？", "single_choice", ["甲", "乙", "丙", "丁"], "a", "", "民法典", ["押金"]),
        (2, "租赁合同的押金如何处理？", "single_choice", ["甲", "甲 ", "丙", "丁"], "A", "", "民法", []),
        (3, "根据上文，如何处理？", "short_answer", None, "", "应当返还", "民法", ["刑诉"]),
        (4, "行政诉讼的时效是多久？", "short_answer", None, "", "六个月", "行政诉讼", ["刑法"]),
        (5, "宪法的效力", "short_answer", None, "", "", "宪法", []),
        (6, "盗窃如何量刑？", "case_analysis", None, "", "三年以下", "综合", ["刑法", "法理"]),
        (7, "选一项", "single_choice", ["甲", "乙", "丙", None], "A", "", "刑法", []),
        (8, "选一项？", "single_choice", ["甲", "乙", "丙", "丁"], "E", "", "刑法", []),
    ], ids=('id',))


def usable(own: DataFrame) -> DataFrame:
    right = F.when(F.col("type") == "single_choice", R.options_consistent(F.col("options"), F.col("answer"))).otherwise(F.trim("reference") != "")
    return own.filter(~R.needs_context(F.col("title")) & F.coalesce(right, F.lit(False)))


def exam_pool(spark: SparkSession, d: str) -> DataFrame:
    """Usable questions and how well they match each of two topics: 2 by their own topic, 1 by a tag."""
    own = usable(RECORDS.df(spark, d))
    return own.select("id", "type", R.topic_name(F.col("primary_topic")).alias("topic"), *(R.topic_quality(F.col("primary_topic"), F.col("tags"), F.lit(t)).alias(n) for t, n in (("刑法", "criminal"), ("理论法", "theory"))))


def sampled(pool: DataFrame, n: int, seed: str, id_: str, quality: Column, weight: Column, avoid: Column, group: str) -> DataFrame:
    """n questions of each group: those that match strictly, then loosely, then others; ones to avoid come last; by weighted keys within. Candidates are cut to n a group before the sort."""
    u = (F.conv(F.substring(F.md5(F.concat(F.col(id_).cast("string"), F.lit(":" + seed)).cast("binary")), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    stage = F.when(avoid, 3).otherwise(2 - quality)
    own = pool.withColumn("stage", stage).withColumn("draw", F.round(-F.log(u) / weight, 9))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("stage", "draw", id_))).filter(F.col("rank") <= n)


def exam_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five parts of each brand: sizes below 10 match strictly, below 25 loosely; a weight by price, ids divisible by 7 are to be avoided."""
    own = _t(spark, d, "part")
    quality = F.when(F.col("p_size") < 10, 2).when(F.col("p_size") < 25, 1).otherwise(0)
    return sampled(own, 5, "exam", "p_partkey", quality, F.greatest(F.lit(0.01), F.col("p_retailprice") / 1000.0), F.col("p_partkey") % 7 == 0, "p_brand").select("p_brand", "p_partkey", "stage", "rank")


def split_pool(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of each family: three quarters by a digest's order for training, the rest for evaluation."""
    order = F.md5(F.concat(F.lit("seed:"), F.col("p_partkey").cast("string")).cast("binary"))
    own = _t(spark, d, "part").withColumn("digest", order)
    sizes = own.groupBy("p_brand").agg(F.count("*").alias("n"))
    ranked = own.withColumn("rn", F.row_number().over(Window.partitionBy("p_brand").orderBy("digest"))).join(sizes, "p_brand")
    return ranked.groupBy("p_brand", F.when(F.col("rn") <= F.floor(F.col("n") * 0.75), "train").otherwise("eval").alias("part")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


QUERIES = {
    "topic_inference": topic_inference, "bank_rules": bank_rules, "difficulty_rules": difficulty_rules, "question_type_rules": type_distribution, "topic_distribution": topic_distribution, "answer_sheet_parse": answer_sheets,
    "exam_grades": exam_grades, "weak_strong_tags": weak_strong, "wrong_question_upsert": wrong_questions, "exam_pool": exam_pool, "exam_sample": exam_sample, "seed_split": split_pool,
}


def _hits(text: str, words: tuple[str, ...]) -> str:
    return f"len(list_filter({strings(words)}, lambda w: contains({text}, w)))"


_TITLES = "array_to_string(list_concat(refs, list_concat(regexp_extract_all(question, '《([^》]{2,120})》', 1), regexp_extract_all(answer, '《([^》]{2,120})》', 1))), ' ')"
_ITEM = "WITH i AS (SELECT *, replace(regexp_replace(sample, '[-_][0-9]+$', ''), '-', '_') AS family FROM " + ITEMS.sql + "), s AS (" + " UNION ALL ".join(
    f"SELECT id, '{t}' AS topic, {k} AS o, {_hits(_TITLES, R.REFERENCE_WORDS[t])} * 8 + {_hits('question', R.QUESTION_WORDS[t])} * 4 + {_hits('answer', R.STRONG_WORDS[t])} * 2 + {_hits(chr(40) + 'question || answer' + chr(41), R.WEAK_WORDS[t])} AS score FROM i" for k, t in enumerate(R.TOPICS)
) + "), b AS (SELECT id, topic, score, coalesce(lead(score) OVER (PARTITION BY id ORDER BY score DESC, o), 0) AS second, row_number() OVER (PARTITION BY id ORDER BY score DESC, o) AS rn FROM s), t AS (SELECT i.*, CASE WHEN score < 3 OR (score < 8 AND score - second < 2) THEN '综合' ELSE topic END AS topic, score FROM i JOIN b USING (id) WHERE rn = 1)"
_DIFF = "CASE WHEN family IN ('exam', 'jud_read_compre', 'judgement_predit') OR length({q}) > 70 OR length({a}) > 180 THEN 'hard' WHEN family IN ('legal_question_answering', 'sent_pred', 'sim_case_match') THEN 'medium' ELSE 'easy' END"
_TYPE = "CASE family WHEN 'jud_read_compre' THEN 'case_analysis' WHEN 'judgement_predit' THEN 'case_analysis' WHEN 'sim_case_match' THEN 'case_analysis' WHEN 'leg_case_cls' THEN 'case_analysis' WHEN 'jud_doc_sum' THEN 'case_analysis' ELSE 'short_answer' END"
_HEAD = r"trim(regexp_replace(answer, '(参考解析|解析|理由)[：:](.|\n)*$', ''))"
_FAM = "f AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'legal_question_answering' WHEN lang = 'de' THEN 'sent_pred' ELSE 'jud_doc_sum' END AS family, coalesce(source, '') AS question, text FROM documents), g AS (SELECT doc_id, family, " + _DIFF.format(q="question", a="text") + f" AS difficulty, CASE WHEN length(text) < 60 THEN 'single_choice' WHEN length(text) > 3000 THEN 'case_analysis' ELSE {_TYPE} END AS type FROM f)"
_TAGWORDS = "CASE topic " + " ".join(f"WHEN '{t}' THEN {strings(w)}" for t, w in R.QUESTION_WORDS.items()) + " ELSE [] END"
_SCORE = "SELECT " + ", ".join("(" + " + ".join(f"CASE WHEN contains(x, '{w}') THEN 4 ELSE 0 END + CASE WHEN contains(right(x, 200), '{w}') THEN 2 ELSE 0 END" for w in words) + f") AS {t}" for t, words in _TERMS.items()) + " FROM (SELECT lower(text) AS x FROM documents WHERE text IS NOT NULL)"
SQL = {
    "topic_inference": _ITEM + " SELECT id, family, topic, score::INT AS score FROM t",
    "bank_rules": _ITEM + f", y AS (SELECT *, CASE WHEN id = 6 THEN 'case_analysis' ELSE {_TYPE} END AS type FROM t), c AS (SELECT *, list_filter(list_concat(list_concat([topic], refs[1:2]), list_concat([CASE type WHEN 'case_analysis' THEN '案例分析题' ELSE '简答题' END], list_filter({_TAGWORDS}, lambda w: contains(question || ' ' || answer, w)))), lambda x: x <> '') AS l FROM y) SELECT id, type, {_DIFF.format(q='question', a='answer')} AS difficulty, array_to_string(list_filter(l, lambda x, k: list_position(l, x) = k)[1:5], '|') AS tags, trim(question) = '' OR len(list_filter({strings(R.CONTEXT)}, lambda w: contains(question, w))) > 0 AS needs_context, len(list_filter({strings(R.SEVERAL)}, lambda w: contains(question, w))) > 0 OR len(regexp_extract_all({_HEAD}, '[A-D](?:[.．、:：]|$)')) > 1 AS rejected, length(question) >= 8 AND length(answer) >= 16 AND length({_HEAD}) >= 12 AS long_enough, lower(regexp_replace(question, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS compare FROM c",
    "difficulty_rules": f"WITH {_FAM} SELECT doc_id, family, difficulty, type FROM g",
    "question_type_rules": f"WITH {_FAM} SELECT family, type, difficulty, count(*)::BIGINT AS n FROM g GROUP BY family, type, difficulty",
    "topic_distribution": f"WITH s AS ({_SCORE}), b AS (SELECT greatest(alpha, beta, gamma) AS best, alpha + beta + gamma - greatest(alpha, beta, gamma) - least(alpha, beta, gamma) AS second, CASE WHEN alpha >= beta AND alpha >= gamma THEN 'alpha' WHEN beta >= gamma THEN 'beta' ELSE 'gamma' END AS topic FROM s) SELECT CASE WHEN best < 3 OR (best < 8 AND best - second < 2) THEN 'general' ELSE topic END AS topic, count(*)::BIGINT AS n FROM b GROUP BY 1",
    "answer_sheet_parse": SHEETS.results("id int, number string, answer string", _READ),
    "exam_grades": EXAM.results("user int, number int, level string, earned int", [(1, 1, "mastered", 20), (1, 2, "incorrect", 0), (1, 3, "mastered", 20), (1, 4, "review", 14), (1, 5, "unanswered", 0), (2, 1, "unanswered", 0), (2, 2, "mastered", 20)]),
    "weak_strong_tags": EXAM.results("user int, earned bigint, total bigint, mastered bigint, review bigint, incorrect bigint, unanswered bigint, weak string, strong string, percent double", _ROLLED),
    "wrong_question_upsert": "WITH o AS (SELECT user_id, event_type, max(struct_pack(a := ts, b := event_id)) AS ok FROM events WHERE value >= 40 GROUP BY ALL), l AS (SELECT e.user_id, e.event_type, ts FROM events e LEFT JOIN o USING (user_id, event_type) WHERE value < 40 AND (ok IS NULL OR struct_pack(a := ts, b := event_id) > ok)), b AS (SELECT user_id, event_type, count(*)::BIGINT AS fail_count, max(ts) AS last FROM l GROUP BY ALL) SELECT user_id, event_type, fail_count, strftime(last, '%Y-%m-%d %H:%M:%S') AS last FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY b.last DESC, event_type) <= 10",
    "exam_pool": RECORDS.results("id int, type string, topic string, criminal int, theory int", [(1, "single_choice", "民法", 0, 0), (4, "short_answer", "行政法", 1, 0), (6, "case_analysis", "综合", 1, 1)]),
    "exam_sample": "WITH p AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 3 WHEN p_size < 10 THEN 0 WHEN p_size < 25 THEN 1 ELSE 2 END AS stage, round(-ln((('0x' || substring(md5(p_partkey::VARCHAR || ':exam'), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297e0) / greatest(0.01e0, p_retailprice / 1000e0), 9) AS draw FROM part) SELECT p_brand, p_partkey, stage::INT AS stage, row_number() OVER (PARTITION BY p_brand ORDER BY stage, draw, p_partkey)::INT AS rank FROM p QUALIFY rank <= 5",
    "seed_split": "WITH p AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5('seed:' || p_partkey::VARCHAR)) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, CASE WHEN rn <= floor(n * 0.75e0) THEN 'train' ELSE 'eval' END AS part, count(*)::BIGINT AS n, min(p_partkey) AS first FROM p GROUP BY 1, 2",
}
