"""Session and profile queries: compression, merges of histories, analysis of turns, folds of updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import history as H
from ..functions import text as T
from ..operators import sessions as S


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the conversations; every third answer ends in an open question."""
    own = S.turn_pairs(_t(spark, d, "conversations"), "conv_id")
    asks = F.concat("answer", F.when((F.col("session") + F.col("turn")) % 3 == 0, "\n请说明").otherwise(""))
    return own.withColumn("answer", asks)


def compression(spark: SparkSession, d: str) -> DataFrame:
    """The table's conversations have four turns at most: two stay, two are a chunk."""
    return S.compressed(pairs(spark, d), 3, 2, 1).select("session", "chunk", "from_turn", "to_turn", "n_turns", "summary", F.array_join("tags", ",").alias("tags"), F.array_join("open_loops", "|").alias("loops"))


def cursor(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a user's events by the rule of ten, eight and six."""
    own = _t(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("turn"), F.col("event_type").alias("request"), F.lit("").alias("answer"))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["turn"].cast("string"), F.lit(":"), t["request"])), ",")
    return S.chunks(own).select("session", "chunk", "from_turn", "to_turn", "n_turns", shown.alias("covered"))


def merges(spark: SparkSession, d: str) -> DataFrame:
    """A session's whole history, then a late shorter one of its first two messages, a replay, and its last message written anew."""
    own = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    last = own.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    log = own.withColumn("seq", F.lit(2)).unionByName(own.filter("turn < 2").select("conv_id", "turn", F.lit("older").alias("text"), F.lit(1).alias("seq"))).unionByName(own.withColumn("seq", F.lit(2)))
    log = log.unionByName(last.select("conv_id", "turn", F.lit("newer").alias("text"), F.lit(3).alias("seq")))
    return S.merged_turns(log, "conv_id", "turn").select("conv_id", "turn", "seq", F.md5("text").alias("digest"))


#: Tools that a turn may have called, by the number of its conversation.
TOOLS = (("retrieve_from_kb", "lookup_statute"), (), ("memory_search", " ", "memory_search"), ("calculator",), ())


def analysis(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's summary, reasoning digest, open question, keywords and importance; tools and trace by its numbers."""
    own = pairs(spark, d)
    tools = F.element_at(F.array(*(F.array(*map(F.lit, t)) if t else F.array().cast("array<string>") for t in TOOLS)), (F.col("session") % len(TOOLS) + 1).cast("int"))
    trace = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Thought: "), F.substring("request", 1, 30), F.lit("\n\n Action: x \nFinal Answer: y")))
    used = F.size(T.dedupe_strings(tools)) > 0
    words = H.top_keywords(F.concat(T.tokens(F.col("request")), T.tokens(F.col("answer"))), 8)
    return own.select(
        "session", "turn", H.turn_summary(F.col("request"), tools, F.col("answer")).alias("summary"), H.reasoning_digest(trace, tools, F.col("answer")).alias("digest"), H.open_loop(F.col("answer")).alias("open_loop"),
        F.array_join(words, ",").alias("tags"), F.when(used, 0.82).otherwise(0.68).alias("importance"), F.when(used, 0.75).otherwise(0.64).alias("episode"),
    )


def updates(spark: SparkSession, d: str) -> DataFrame:
    """Events as updates of profiles: the type gives the field, the key in the properties the value."""
    own = _t(spark, d, "events").select("user_id", "event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    field = F.when(F.col("k") % 11 == 0, "name").when(F.col("k") % 7 == 0, "target_score").when(F.col("event_type") == "view", "weak_points").when(F.col("event_type") == "click", "preferences").when(F.col("event_type") == "purchase", "study_goals").otherwise("notes")
    value = F.when(F.col("k") % 13 != 0, F.concat(F.lit(" v"), (F.col("k") % 10).cast("string"), F.lit(" "))).otherwise("")
    return own.select(F.col("user_id").alias("user"), field.alias("field"), F.concat(F.lit("p"), (F.col("k") % 3).cast("string")).alias("key"), value.alias("value"), "ts", "event_id")


def profiles(spark: SparkSession, d: str) -> DataFrame:
    own = S.folded_profiles(updates(spark, d), "ts", "event_id")
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return own.select("user", "name", *(F.array_join(f, ",").alias(f) for f in S.LISTS), shown("preferences").alias("preferences"), shown("attributes").alias("attributes"))


QUERIES = {"session_compression": compression, "compression_cursor": cursor, "turn_merge": merges, "turn_analysis": analysis, "profile_updates_fold": profiles}

_CLEAN = r"trim(regexp_replace(replace({0}, '+', ' '), '[\s\x{{0b}}\p{{Z}}]+', ' ', 'g'))"


def _cut(x: str, n: int) -> str:
    c = _CLEAN.format(x)
    return f"(CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(substring({c}, 1, {n - 1}), '[ ，,；;：:]+$', '') || '…' END)"


def _tokens(x: str) -> str:
    c = _CLEAN.format(x)
    han = f"regexp_extract_all({c}, '[一-鿿]')"
    return f"(regexp_extract_all(lower({c}), '[0-9a-z_]+') || {han} || CASE WHEN len({han}) > 1 THEN list_transform(range(1, len({han})), lambda i: {han}[i] || {han}[i + 1]) ELSE [] END)"


_STOP = ", ".join(f"'{w}'" for w in H.STOPWORDS)
_MARKS = "|".join(H.FOLLOWUP_MARKERS)
_LOOP = f"CASE WHEN regexp_matches(trim(answer), '[?？]$|{_MARKS}') THEN {_cut('trim(answer)', 120)} END"
_PAIRS = """m AS (SELECT conv_id AS session, turn // 2 AS turn, coalesce(max(text) FILTER (role = 'user'), '') AS request, coalesce(max(text) FILTER (role = 'assistant'), '') AS answer FROM conversations GROUP BY ALL),
p AS (SELECT session, turn, request, answer || CASE WHEN (session + turn) % 3 = 0 THEN chr(10) || '请说明' ELSE '' END AS answer FROM m)"""
_TOOLS = "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in t) + "]::VARCHAR[]" for t in TOOLS) + "]"
_KEEP = f"t NOT IN ({_STOP}) AND (length(t) > 1 OR regexp_matches(t, '^[一-鿿]$'))"
_FIELD = "CASE WHEN k % 11 = 0 THEN 'name' WHEN k % 7 = 0 THEN 'target_score' WHEN event_type = 'view' THEN 'weak_points' WHEN event_type = 'click' THEN 'preferences' WHEN event_type = 'purchase' THEN 'study_goals' ELSE 'notes' END"
SQL = {
    "session_compression": f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY session) AS n FROM p),
c AS (SELECT *, pos // 2 AS chunk FROM r WHERE n >= 3 AND (pos // 2 + 1) * 2 + 1 <= n),
k AS (SELECT session, chunk, t, count(*) AS n, min(o) AS o FROM (SELECT session, chunk, u.t, (side * 1000 + pos) * 100000 + u.i AS o FROM (SELECT session, chunk, pos, 0 AS side, {_tokens("request")} AS w FROM c UNION ALL SELECT session, chunk, pos, 1, {_tokens("answer")} FROM c), unnest(list_zip(w, range(len(w)))) x(z), (SELECT z[1] AS t, z[2] AS i) u) WHERE {_KEEP} GROUP BY ALL),
w AS (SELECT session, chunk, list(t ORDER BY n DESC, o)[:8] AS w FROM k GROUP BY ALL),
g AS (SELECT session, chunk, min(pos) AS from_turn, max(pos) AS to_turn, count(*)::BIGINT AS n_turns, list('用户：' || {_cut("request", 56)} || '；助手：' || {_cut("answer", 72)} ORDER BY pos) AS s, coalesce(array_to_string(list({_LOOP} ORDER BY pos) FILTER ({_LOOP} IS NOT NULL), '|'), '') AS loops FROM c GROUP BY ALL),
z AS (SELECT *, '历史压缩摘要：' || CASE WHEN len(w) > 0 THEN '围绕 ' || array_to_string(w[:5], '、') || ' 持续展开。' ELSE '' END || ' ' || array_to_string((s[:2] || s[-2:])[:3], ' | ') AS line FROM g LEFT JOIN w USING (session, chunk))
SELECT session, chunk::INT AS chunk, from_turn::INT AS from_turn, to_turn::INT AS to_turn, n_turns, {_cut("line", 360)} AS summary, coalesce(array_to_string(w[:6], ','), '') AS tags, loops FROM z""",
    "compression_cursor": """WITH r AS (SELECT user_id AS session, event_id, event_type, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT session, (pos // 8)::INT AS chunk, min(pos)::INT AS from_turn, max(pos)::INT AS to_turn, count(*)::BIGINT AS n_turns, string_agg(event_id || ':' || event_type, ',' ORDER BY event_id) AS covered FROM r WHERE n >= 10 AND (pos // 8 + 1) * 8 + 6 <= n GROUP BY session, pos // 8""",
    "turn_merge": "SELECT conv_id, turn, CASE WHEN turn = max(turn) OVER w THEN 3 ELSE 2 END::INT AS seq, md5(CASE WHEN turn = max(turn) OVER w THEN 'newer' ELSE text END) AS digest FROM conversations WINDOW w AS (PARTITION BY conv_id)",
    "turn_analysis": f"""WITH {_PAIRS}, a AS (SELECT *, list_filter(list_transform({_TOOLS}[(session % {len(TOOLS)} + 1)::INT], lambda x: trim(x)), lambda x: x <> '') AS tools FROM p),
b AS (SELECT * EXCLUDE tools, list_filter(tools, lambda x, i: list_position(tools, x) = i) AS tools FROM a),
k AS (SELECT session, turn, list(t ORDER BY n DESC, o)[:8] AS w FROM (SELECT session, turn, t, count(*) AS n, min(i) AS o FROM (SELECT session, turn, z[1] AS t, z[2] AS i FROM (SELECT session, turn, {_tokens("request")} || {_tokens("answer")} AS w FROM b), unnest(list_zip(w, range(len(w)))) x(z)) WHERE {_KEEP} GROUP BY ALL) GROUP BY ALL)
SELECT session, turn::INT AS turn, '用户请求：' || {_cut("request", 96)} || CASE WHEN len(tools) > 0 THEN '；执行工具：' || array_to_string(tools[:4], '、') ELSE '' END || '；结果：' || {_cut("answer", 140)} AS summary,
CASE WHEN turn % 2 = 1 THEN {_cut("array_to_string(list_filter(list_transform(string_split('Thought: ' || substring(request, 1, 30) || chr(10) || ' Action: x ', chr(10)), lambda x: trim(x)), lambda x: x <> '')[-3:], '；')", 220)} WHEN len(tools) > 0 THEN '本轮主要依赖工具 ' || array_to_string(tools[:4], '、') || ' 完成任务。' ELSE {_cut("answer", 160)} END AS digest,
{_LOOP} AS open_loop, coalesce(array_to_string(w, ','), '') AS tags, CASE WHEN len(tools) > 0 THEN 0.82e0 ELSE 0.68e0 END AS importance, CASE WHEN len(tools) > 0 THEN 0.75e0 ELSE 0.64e0 END AS episode FROM b LEFT JOIN k USING (session, turn)""",
    "profile_updates_fold": f"""WITH e AS (SELECT user_id AS u, event_id, ts, event_type, (props::JSON->>'k')::INT AS k FROM events),
f AS (SELECT u, ts, event_id, {_FIELD} AS field, 'p' || (k % 3) AS key, 'v' || (k % 10) AS value FROM e WHERE k % 13 <> 0),
l AS (SELECT u, field, string_agg(value, ',' ORDER BY ts, event_id) AS v FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY u, field, value ORDER BY ts, event_id) = 1) WHERE field IN ('study_goals', 'weak_points', 'strong_points', 'notes') GROUP BY ALL),
m AS (SELECT u, field, CASE WHEN field = 'preferences' THEN key ELSE field END AS key, value FROM f WHERE field IN ('name', 'preferences', 'target_score') QUALIFY row_number() OVER (PARTITION BY u, field, CASE WHEN field = 'preferences' THEN key ELSE field END ORDER BY ts DESC, event_id DESC) = 1)
SELECT u AS user, (SELECT max(value) FROM m WHERE m.u = x.u AND field = 'name') AS name, {", ".join(f"coalesce((SELECT max(v) FROM l WHERE l.u = x.u AND field = '{c}'), '') AS {c}" for c in S.LISTS)},
coalesce((SELECT string_agg(key || '=' || value, ',' ORDER BY key) FROM m WHERE m.u = x.u AND field = 'preferences'), '') AS preferences, coalesce((SELECT string_agg(key || '=' || value, ',' ORDER BY key) FROM m WHERE m.u = x.u AND field = 'target_score'), '') AS attributes
FROM (SELECT DISTINCT u FROM f) x""",
}
