"""Study and memory queries: turns, scores, exam rollups, updates, regions, intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def last_turns(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role")))
    return _t(spark, d, "conversations").withColumn("rn", rn).filter("rn <= 3").select("conv_id", "turn", "role", "rn")


def compression_chunks(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "conversations").withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    return own.filter("turn < n - 2").groupBy("conv_id", F.floor(F.col("turn") / 4).alias("chunk")).agg(F.count("*").alias("turns"), F.sum(T.token_count(F.col("text"))).alias("tokens"))


def hot_update(spark: SparkSession, d: str) -> DataFrame:
    latest = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e")
    return _t(spark, d, "events").groupBy("user_id").agg(latest).select("user_id", "e.event_id", "e.event_type", "e.value")


def batch_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The bank takes a batch: events of value below 60, and those from 40 on, which overlap; ids the bank has are left out."""
    events = _t(spark, d, "events").select("event_id", "user_id", "event_type", F.coalesce("value", F.lit(0.0)).alias("value"))
    bank, batch = events.filter("value < 60"), events.filter("value >= 40")
    new = batch.join(bank.select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"])
    return bank.withColumn("origin", F.lit("bank")).unionByName(new.withColumn("origin", F.lit("batch")))


def wrong_bank(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "events").filter("value < 20").groupBy("user_id", "event_type")
    return own.agg(F.count("*").alias("fail_count"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def profile_fold(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("t"), F.count("*").alias("n"))
    return own.select("user_id", F.array_join("t", ",").alias("types"), "n")


def exam_rollup(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)).alias("earned"), F.sum("l_quantity").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("incorrect"))
    return own.join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.round(F.col("earned") / F.col("total") * 100, 2).alias("percent"), "incorrect")


def question_weight(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    weight = F.greatest(F.when(size < 17, 5.0).when(size < 34, 20.0).otherwise(5.0) + F.when(F.col("p_brand") == "Brand#11", 1.4).otherwise(0.0), F.lit(0.01))
    return _t(spark, d, "part").select("p_partkey", F.round(weight, 4).alias("weight")).orderBy(F.desc("weight"), "p_partkey").limit(25)


def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    """Without replacement: smallest keys -ln(u) / weight, u from a digest of the id."""
    u = (F.conv(F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    key = F.round(-F.log(u) / F.col("p_size"), 9)
    return _t(spark, d, "part").select("p_partkey", key.alias("key")).orderBy("key", "p_partkey").limit(40)


def region_paths(spark: SparkSession, d: str) -> DataFrame:
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", F.trim("r_name"), F.trim("n_name")).alias("path"))


def location(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.groupBy("n_regionkey").agg(F.count_distinct("n_nationkey").alias("paths"), F.count_if(F.col("c_acctbal") > 0).alias("local_hits"), (F.count_distinct("n_nationkey") >= 2).alias("ask"))


_INTENTS = [("report", "report"), ("exam", "test"), ("statute", "law"), ("profile", "name")]


def intents(spark: SparkSession, d: str) -> DataFrame:
    out = F.lit("general")
    for name, word in reversed(_INTENTS):
        out = F.when(F.contains(F.lower("text"), F.lit(word)), name).otherwise(out)
    return _t(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", out.alias("intent"))


def memory_score(spark: SparkSession, d: str) -> DataFrame:
    base = F.when(F.col("role") == "system", 0.94).when(F.col("role") == "user", 0.9).otherwise(0.74)
    terms = F.array(*map(F.lit, ("the", "thing", "der", "que")))
    lex = F.size(F.array_intersect(terms, T.word_tokens(F.col("text")))) / 4
    fresh = F.greatest(F.lit(0.1), 1 - F.least(F.lit(0.75), F.col("turn") * 0.025))
    score = 0.34 * lex + 0.18 * base + 0.10 * fresh + 0.08 * base
    rn = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("score"), "conv_id", "turn"))
    return _t(spark, d, "conversations").select("conv_id", "turn", "role", F.round(score, 6).alias("score")).withColumn("rn", rn).filter("rn <= 4")


def hashing_vector(spark: SparkSession, d: str) -> DataFrame:
    tok = _t(spark, d, "conversations").select("conv_id", "turn", F.explode(T.word_tokens(F.col("text"))).alias("t"))
    digest = F.md5(F.col("t").cast("binary"))
    bucket, sign = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int"), F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return tok.groupBy("conv_id", "turn", bucket.alias("bucket")).agg(F.sum(sign).alias("value"))


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = F.window("ts", "1 hour")
    return _t(spark, d, "events").groupBy(w).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    w = F.session_window("ts", "30 minutes")
    return _t(spark, d, "events").groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def domain_switch(spark: SparkSession, d: str) -> DataFrame:
    own = intents(spark, d)
    before = F.lag("intent").over(Window.partitionBy("conv_id").orderBy("turn"))
    return own.withColumn("before", before).filter("before IS NOT NULL AND before <> intent").select("conv_id", "turn", "before", "intent")


_INT = "CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{n}'" for n, w in _INTENTS) + " ELSE 'general' END"
QUERIES = {
    "last_turns": last_turns, "compression_chunks": compression_chunks, "hot_update_latest": hot_update, "batch_upsert_dedupe": batch_upsert, "wrong_question_bank": wrong_bank,
    "profile_fold": profile_fold, "exam_score_rollup": exam_rollup, "question_weight_topk": question_weight, "weighted_sample": weighted_sample, "region_hierarchy_paths": region_paths,
    "location_clarification": location, "intent_classify": intents, "memory_score": memory_score, "hashing_vector": hashing_vector, "ext_tumbling": tumbling, "ext_session": sessions,
    "planner_domain_switch": domain_switch,
}
_MS = "SELECT conv_id, turn, role, round(0.34e0 * (len(list_intersect(['the', 'thing', 'der', 'que'], regexp_extract_all(lower(text), '[0-9a-z_]+'))) / 4e0) + 0.18e0 * b + 0.10e0 * greatest(0.1e0, 1 - least(0.75e0, turn * 0.025e0)) + 0.08e0 * b, 6) AS score FROM (SELECT *, CASE role WHEN 'system' THEN 0.94e0 WHEN 'user' THEN 0.9e0 ELSE 0.74e0 END AS b FROM conversations)"
SQL = {
    "last_turns": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC)::INT AS rn FROM conversations QUALIFY rn <= 3",
    "compression_chunks": "SELECT conv_id, (turn // 4)::BIGINT AS chunk, count(*)::BIGINT AS turns, sum(greatest(1, length(text) // 2))::BIGINT AS tokens FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE turn < n - 2 GROUP BY ALL",
    "hot_update_latest": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "batch_upsert_dedupe": "WITH e AS (SELECT event_id, user_id, event_type, coalesce(value, 0e0) AS value FROM events), b AS (SELECT * FROM e WHERE value < 60) SELECT *, 'bank' AS origin FROM b UNION ALL SELECT *, 'batch' FROM e WHERE value >= 40 AND event_id NOT IN (SELECT event_id FROM b)",
    "wrong_question_bank": "SELECT user_id, event_type, count(*)::BIGINT AS fail_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events WHERE value < 20 GROUP BY user_id, event_type",
    "profile_fold": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(*)::BIGINT AS n FROM events GROUP BY user_id",
    "exam_score_rollup": "SELECT o_orderkey, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0e0 END) / sum(l_quantity) * 100, 2) AS percent, count(*) FILTER (l_returnflag = 'R')::BIGINT AS incorrect FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "question_weight_topk": "SELECT p_partkey, round(greatest(CASE WHEN p_size < 17 THEN 5e0 WHEN p_size < 34 THEN 20e0 ELSE 5e0 END + CASE WHEN p_brand = 'Brand#11' THEN 1.4e0 ELSE 0e0 END, 0.01e0), 4) AS weight FROM part ORDER BY weight DESC, p_partkey LIMIT 25",
    "weighted_sample": "SELECT p_partkey, round(-ln((('0x' || substring(md5(p_partkey::VARCHAR), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297e0) / p_size, 9) AS key FROM part ORDER BY key, p_partkey LIMIT 40",
    "region_hierarchy_paths": "SELECT n_nationkey, trim(r_name) || '/' || trim(n_name) AS path FROM nation JOIN region ON n_regionkey = r_regionkey",
    "location_clarification": "SELECT n_regionkey, count(DISTINCT n_nationkey)::BIGINT AS paths, count(*) FILTER (c_acctbal > 0)::BIGINT AS local_hits, count(DISTINCT n_nationkey) >= 2 AS ask FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey",
    "intent_classify": f"SELECT conv_id, turn, {_INT} AS intent FROM conversations WHERE role = 'user'",
    "memory_score": f"SELECT *, row_number() OVER (PARTITION BY role ORDER BY score DESC, conv_id, turn)::INT AS rn FROM ({_MS}) QUALIFY rn <= 4",
    "hashing_vector": "SELECT conv_id, turn, ('0x' || substring(md5(t), 1, 2))::INT AS bucket, sum(CASE WHEN ('0x' || substring(md5(t), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS value FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[0-9a-z_]+')) AS t FROM conversations) GROUP BY ALL",
    "ext_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "ext_session": "WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k",
    "planner_domain_switch": f"WITH i AS (SELECT conv_id, turn, {_INT} AS intent FROM conversations WHERE role = 'user'), l AS (SELECT *, lag(intent) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM i) SELECT conv_id, turn, before, intent FROM l WHERE before IS NOT NULL AND before <> intent",
}
