"""Memory queries on conversations: a turn is a memory, its role the layer, ten conversations a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import memory as M
from ..store import materialise
from ._inline import Every, Inline, Spread, strings

TERMS = ("the", "thing", "der", "que", "ing", "und")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def memories(spark: SparkSession, d: str) -> DataFrame:
    """user, id, layer, category, session, refs, tags (ten), keywords (twelve), importance, hits and days since creation and last use."""
    words = T.word_tokens(F.col("text"))
    long_ = lambda n, k: F.slice(F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= n))), 1, k)
    layer = F.when(F.col("role") == "system", "system").when(F.col("role") == "user", "long_term").when(F.col("turn") < 4, "semantic").otherwise("summary")
    made = _t(spark, d, "conversations").select(
        F.floor(F.col("conv_id") / 10).alias("user"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), layer.alias("layer"), F.col("role").alias("category"), F.col("conv_id").alias("session"),
        F.when(F.length("text") % 3 == 0, F.array(F.concat(F.lit("r"), (F.length("text") % 7).cast("string")))).otherwise(F.array().cast("array<string>")).alias("refs"), long_(9, 10).alias("tags"), long_(6, 12).alias("keywords"),
        (0.3 + (F.length("text") % 50) / 100.0).alias("importance"), (F.col("turn") % 4).alias("hits"), (F.col("turn") * 9 + F.col("conv_id") % 10).alias("age"), (F.col("turn") * 5).alias("idle"), words.alias("words"),
    )
    return materialise(made, "memories")


def scored(spark: SparkSession, d: str) -> DataFrame:
    own = memories(spark, d)
    lex = M.lexical(F.array(*map(F.lit, TERMS)), F.col("words"))
    own = own.withColumn("lexical", lex).withColumn("fresh", M.recency(F.col("layer"), F.col("idle"))).withColumn("decayed", M.decayed(F.col("layer"), F.col("importance"), F.col("age"), F.col("idle"), F.col("hits")))
    return own.withColumn("base", F.round(M.score(F.col("lexical"), F.lit(0.0), F.col("decayed"), F.col("fresh"), F.col("layer"), F.col("hits")), 6))


def breakdown(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("id", *(F.round(c, 6).alias(c) for c in ("lexical", "fresh", "decayed")), "base")


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return M.edges(memories(spark, d))


def top8(spark: SparkSession, d: str) -> DataFrame:
    return M.neighbours(graph_edges(spark, d)).select("user", "source", "target", "weight", "rank")


def bonus(spark: SparkSession, d: str) -> DataFrame:
    return M.graph_bonus(scored(spark, d).select("user", "id", "layer", "importance", "base"), graph_edges(spark, d))


def layer_quota(spark: SparkSession, d: str) -> DataFrame:
    """The hits that count, with their bonus, within the quota of each layer of a user."""
    own = scored(spark, d).join(bonus(spark, d), ["user", "id"], "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
    own = own.withColumn("final", F.round(F.col("base") + F.col("bonus"), 6)).filter(M.gated(F.col("layer"), F.col("lexical"), F.lit(0.0), F.col("bonus"), F.col("final")))
    return M.by_quota(own, "user", F.desc("final"), F.desc("importance"), F.asc("id")).select("user", "layer", "id", "final", "rank")


def retrieval_meta(spark: SparkSession, d: str) -> DataFrame:
    return layer_quota(spark, d).groupBy("user", "layer").agg(F.count("*").alias("hits"), F.max("final").alias("best"))


def similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the hashed vectors of each turn and the one after it."""
    turns = _t(spark, d, "conversations").select("conv_id", "turn", F.explode(T.word_tokens(F.col("text"))).alias("t"))
    own = M.hashed(turns, "t", "conv_id", "turn")
    return M.cosines(own, own.withColumn("turn", F.col("turn") - 1), "conv_id", "turn")


DRAFTS = Every(
    "user bigint, id bigint, layer string, category string, session bigint, text string, importance double, at int",
    [
        (1, 1, "long_term", "goal", 1, "pass the law exam", 0.5, 1), (1, 2, "long_term", "goal", 2, "pass  the law exam", 0.8, 2), (1, 3, "long_term", "goal", 2, "pass the law exam now", 0.4, 3), (1, 4, "long_term", "note", 2, "pass the law exam", 0.4, 4),
        (1, 5, "episodic", "turn", 1, "same words", 0.2, 5), (1, 6, "episodic", "turn", 1, "same words", 0.2, 6), (1, 7, "summary", "s", 1, "a b c d e f g", 0.3, 7), (1, 8, "summary", "s", 2, "a b c d e f g", 0.3, 8), (1, 9, "summary", "s", 2, "a b c d e f g h", 0.6, 9),
        (2, 10, "long_term", "goal", 1, "", 0.1, 1), (2, 11, "long_term", "goal", 1, " ", 0.2, 2), (2, 12, "long_term", "goal", 1, "x", 0.3, 3),
    ], ids=('user', 'id'))
#: The same by hand. "pass the law exam now" shares four of five tokens with what is kept: .8, below the limit.
_MERGED = [(1, 1, "long_term", "goal", "pass  the law exam", 0.8, 2), (1, 3, "long_term", "goal", "pass the law exam now", 0.4, 1), (1, 4, "long_term", "note", "pass the law exam", 0.4, 1), (1, 5, "episodic", "turn", "same words", 0.2, 1), (1, 6, "episodic", "turn", "same words", 0.2, 1), (1, 7, "summary", "s", "a b c d e f g", 0.3, 1), (1, 8, "summary", "s", "a b c d e f g h", 0.6, 2), (2, 10, "long_term", "goal", " ", 0.2, 2), (2, 12, "long_term", "goal", "x", 0.3, 1)]


def merged(spark: SparkSession, d: str) -> DataFrame:
    return M.merge_memories(DRAFTS.df(spark, d))


PROFILES = Spread(
    "user bigint, goals array<string>, weak array<string>, strong array<string>, preferences array<string>, notes array<string>",
    [(1, ["法考"], ["民诉", "刑诉"], [], ["style=short"], ["n1", "n2", "n3", "n4"]), (2, [], [], ["民法"], [], ["only"]), (3, [], [], [], [], [])],
    ids=("user",),
)


def profile_rows(spark: SparkSession, d: str) -> DataFrame:
    return M.profile_rows(PROFILES.df(spark, d))


def working_rows(spark: SparkSession, d: str) -> DataFrame:
    """The last three turns of each conversation as working memories, their texts cut to 90 characters."""
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    own = _t(spark, d, "conversations").withColumn("rn", rn).filter("rn <= 3")
    text = F.concat(F.lit("最近对话："), T.truncate_text(F.col("text"), 90))
    return own.select("conv_id", "turn", F.lit("working").alias("layer"), F.lit("recent_turn").alias("category"), F.lit(0.84).alias("importance"), F.length(text).alias("n"), F.substring(F.md5(F.concat_ws(":", F.lit("working"), F.lit("recent_turn"), text).cast("binary")), 1, 12).alias("id"))


def merged_hits(spark: SparkSession, d: str) -> DataFrame:
    """Anchored hits of long-term memories of importance .7 or more, then all by score: thirty, each id once."""
    own = scored(spark, d).withColumn("at", -F.col("base") + F.col("id") * 1e-9)
    return M.merged_hits([own.filter("layer = 'long_term' AND importance >= 0.7"), own], "id", "at", 30).select("id", "list")


def session_order(spark: SparkSession, d: str) -> DataFrame:
    """Each user's sessions, the latest first by their last event's time, then id; five of a user."""
    own = _t(spark, d, "events").groupBy("user_id", F.col("event_type").alias("session")).agg(F.max("ts").alias("updated"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated"), F.desc("session")))
    return own.withColumn("rn", rn).filter("rn <= 5").select("user_id", "session", "last_event", "rn")


def report_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Of each user counts of memories by layer, and the categories of the twelve latest in order of name."""
    own = memories(spark, d)
    last = own.withColumn("rn", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("id")))).filter("rn <= 12").groupBy("user").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("topics"))
    return own.groupBy("user").agg(F.count("*").alias("n"), *(F.count_if(F.col("layer") == x).alias(x) for x in ("system", "long_term", "semantic", "summary"))).join(last, "user")


QUERIES = {
    "memory_breakdown": breakdown, "memory_graph_edges": graph_edges, "graph_neighbors_top8": top8, "graph_bonus": bonus, "memory_layer_quota": layer_quota, "retrieval_meta": retrieval_meta, "hashing_similarity": similarity,
    "memory_merge": merged, "profile_memories": profile_rows, "working_memories": working_rows, "merged_hits": merged_hits, "session_order": session_order, "report_snapshot": report_snapshot,
}

_LONG = "list_sort(list_distinct(list_filter(words, lambda w: length(w) >= {})))[1:{}]"
_MEM = f"""c AS (SELECT *, regexp_extract_all(lower(text), '[0-9a-z_]+') AS words FROM conversations),
m AS (SELECT conv_id // 10 AS "user", conv_id * 1000 + turn AS id, CASE WHEN role = 'system' THEN 'system' WHEN role = 'user' THEN 'long_term' WHEN turn < 4 THEN 'semantic' ELSE 'summary' END AS layer, role AS category, conv_id AS session,
  CASE WHEN length(text) % 3 = 0 THEN ['r' || (length(text) % 7)] ELSE [] END AS refs, {_LONG.format(9, 10)} AS tags, {_LONG.format(6, 12)} AS keywords, 0.3e0 + (length(text) % 50) / 100e0 AS importance, turn % 4 AS hits, turn * 9 + conv_id % 10 AS age, turn * 5 AS idle, words FROM c),
z AS (SELECT *, len(list_intersect({strings(TERMS)}, words)) / {len(TERMS)}e0 AS lexical, CASE WHEN layer = 'system' THEN 1e0 ELSE greatest(0.1e0, 1 - least(0.75e0, idle * 0.025e0)) END AS fresh,
  CASE WHEN layer = 'system' THEN importance ELSE greatest(0.05e0, least(1e0, importance - CASE layer WHEN 'long_term' THEN least(0.22e0, age * 0.0015e0 + idle * 0.004e0) WHEN 'summary' THEN least(0.28e0, age * 0.0025e0 + idle * 0.007e0) ELSE least(0.35e0, age * 0.003e0 + idle * 0.01e0) END + least(0.18e0, ln(1 + hits) * 0.05e0))) END AS decayed FROM m),
s AS (SELECT *, round(0.34e0 * lexical + 0.18e0 * decayed + 0.1e0 * fresh + 0.08e0 * CASE layer WHEN 'system' THEN 0.94e0 WHEN 'long_term' THEN 0.88e0 WHEN 'summary' THEN 0.84e0 ELSE 0.72e0 END + 0.06e0 * least(0.25e0, ln(1 + hits) * 0.08e0), 6) AS base FROM z)"""
_OV = "coalesce(len(list_intersect(a.{c}, b.{c}))::DOUBLE / nullif(len(list_distinct(list_concat(a.{c}, b.{c}))), 0), 0)"
_EDGES = f"""{_MEM},
o AS (SELECT a."user", a.id AS a, b.id AS b, len(list_intersect(a.refs, b.refs)) AS r, {_OV.format(c='tags')} AS t, {_OV.format(c='keywords')} AS k, a.session = b.session AS ss, a.category = b.category AS sc, a.layer = b.layer AND a.layer IN ('long_term', 'summary', 'semantic') AS sl, a.layer = 'system' OR b.layer = 'system' AS anchored
  FROM m a JOIN m b ON a."user" = b."user" AND a.id < b.id),
e AS (SELECT "user", a, b, round(least(0.95e0, CASE WHEN r > 0 THEN least(0.5e0, 0.28e0 + r * 0.08e0) ELSE 0e0 END + CASE WHEN t > 0 THEN least(0.28e0, 0.08e0 + t * 0.22e0) ELSE 0e0 END + CASE WHEN k > 0 THEN least(0.18e0, 0.05e0 + k * 0.16e0) ELSE 0e0 END + CASE WHEN ss THEN 0.06e0 ELSE 0e0 END + CASE WHEN sc THEN 0.04e0 ELSE 0e0 END + CASE WHEN sl THEN 0.04e0 ELSE 0e0 END + CASE WHEN anchored AND (r > 0 OR t > 0 OR k > 0) THEN 0.06e0 ELSE 0e0 END), 6) AS weight FROM o),
g AS (SELECT * FROM e WHERE weight >= 0.18e0),
n AS (SELECT *, row_number() OVER (PARTITION BY "user", source ORDER BY weight DESC, target)::INT AS rank FROM (SELECT "user", a AS source, b AS target, weight FROM g UNION ALL SELECT "user", b, a, weight FROM g) QUALIFY rank <= 8)"""
_BONUS = f"""{_EDGES},
x AS (SELECT "user", id AS source, CASE WHEN layer = 'system' THEN greatest(base, least(importance, 0.72e0)) ELSE base END AS s FROM s WHERE base >= 0.18e0 OR layer = 'system' QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY base DESC, importance DESC, id) <= 10),
h AS (SELECT x."user", x.source, s, target AS id, weight FROM x JOIN n ON n."user" = x."user" AND n.source = x.source WHERE s > 0),
w AS (SELECT "user", id, s * least(0.24e0, 0.05e0 + weight * 0.22e0) AS bonus FROM h UNION ALL SELECT h."user", n.target, least(0.12e0, s * h.weight * n.weight * 0.12e0) FROM h JOIN n ON n."user" = h."user" AND n.source = h.id AND n.rank <= 3 WHERE n.target <> h.source AND n.target <> h.id),
b AS (SELECT "user", id, round(max(bonus), 6) AS bonus FROM w GROUP BY "user", id)"""
_QUOTA = f"""{_BONUS},
f AS (SELECT s."user", layer, s.id, importance, lexical, coalesce(bonus, 0e0) AS bonus, round(base + coalesce(bonus, 0e0), 6) AS final FROM s LEFT JOIN b ON b."user" = s."user" AND b.id = s.id),
q AS (SELECT "user", layer, id, final, row_number() OVER (PARTITION BY "user", layer ORDER BY final DESC, importance DESC, id)::INT AS rank FROM f WHERE layer = 'system' OR ((lexical >= 0.01e0 OR bonus >= 0.05e0) AND final >= 0.18e0) QUALIFY rank <= CASE WHEN layer = 'system' THEN 2 ELSE 4 END)"""
_HASH = "v AS (SELECT conv_id, turn, ('0x' || substring(md5(t), 1, 2))::INT AS bucket, sum(CASE WHEN ('0x' || substring(md5(t), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS value FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[0-9a-z_]+')) AS t FROM conversations) GROUP BY ALL), l AS (SELECT conv_id, turn, sqrt(sum(value * value)) AS n FROM v GROUP BY ALL), d AS (SELECT a.conv_id, a.turn, sum(a.value * b.value) AS dot FROM v a JOIN v b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.bucket = b.bucket GROUP BY ALL)"
_CLEAN = r"trim(regexp_replace(replace(text, '+', ' '), '[\s\x{0b}\p{Z}]+', ' ', 'g'))"
_PROFILE = " UNION ALL ".join(f"SELECT \"user\", '{k}' AS category, '{t}' || unnest({c}) AS text, {i}e0 AS importance FROM p" for k, c, t, i in M.PROFILE)
SQL = {
    "memory_breakdown": f"WITH {_MEM} SELECT id, round(lexical, 6) AS lexical, round(fresh, 6) AS fresh, round(decayed, 6) AS decayed, base FROM s",
    "memory_graph_edges": f"WITH {_EDGES} SELECT * FROM g",
    "graph_neighbors_top8": f'WITH {_EDGES} SELECT "user", source, target, weight, rank FROM n',
    "graph_bonus": f"WITH {_BONUS} SELECT * FROM b",
    "memory_layer_quota": f"WITH {_QUOTA} SELECT * FROM q",
    "retrieval_meta": f'WITH {_QUOTA} SELECT "user", layer, count(*)::BIGINT AS hits, max(final) AS best FROM q GROUP BY "user", layer',
    "hashing_similarity": f"WITH {_HASH} SELECT d.conv_id, d.turn, round(least(1e0, dot / (a.n * b.n)), 6) AS cosine FROM d JOIN l a ON a.conv_id = d.conv_id AND a.turn = d.turn JOIN l b ON b.conv_id = d.conv_id AND b.turn = d.turn + 1 WHERE dot > 0",
    "memory_merge": DRAFTS.results("user bigint, id bigint, layer string, category string, text string, importance double, merged bigint", _MERGED),
    "profile_memories": f"WITH p AS (SELECT * FROM {PROFILES.sql.replace('AS user', 'AS ' + chr(34) + 'user' + chr(34))}), r AS ({_PROFILE} UNION ALL SELECT \"user\", 'preference', '用户偏好 ' || replace(unnest(preferences), '=', '：'), 0.9e0 FROM p UNION ALL SELECT \"user\", 'note', '用户备注：' || unnest(notes[-3:]), 0.8e0 FROM p) SELECT *, substring(md5('profile:' || category || ':' || text), 1, 12) AS id FROM r",
    "working_memories": f"WITH t AS (SELECT conv_id, turn, {_CLEAN} AS t FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3), x AS (SELECT conv_id, turn, '最近对话：' || CASE WHEN length(t) <= 90 THEN t ELSE regexp_replace(substring(t, 1, 89), '[ ，,；;：:]+$', '') || '…' END AS x FROM t) SELECT conv_id, turn, 'working' AS layer, 'recent_turn' AS category, 0.84e0 AS importance, length(x)::INT AS n, substring(md5('working:recent_turn:' || x), 1, 12) AS id FROM x",
    "merged_hits": f"WITH {_MEM}, a AS (SELECT id, 0 AS list, -base + id * 1e-9 AS o FROM s WHERE layer = 'long_term' AND importance >= 0.7e0 ORDER BY o LIMIT 30), b AS (SELECT id, 1 AS list, -base + id * 1e-9 AS o FROM s ORDER BY o LIMIT 30), u AS (SELECT id, list, o FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY id ORDER BY list, o) = 1) SELECT id, list FROM u ORDER BY list, o LIMIT 30",
    "session_order": "WITH s AS (SELECT user_id, event_type AS session, max(ts) AS updated, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS last_event FROM events GROUP BY ALL) SELECT user_id, session, last_event, row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, session DESC)::INT AS rn FROM s QUALIFY rn <= 5",
    "report_snapshot": f"WITH {_MEM}, l AS (SELECT \"user\", category FROM m QUALIFY row_number() OVER (PARTITION BY \"user\" ORDER BY id DESC) <= 12), t AS (SELECT \"user\", string_agg(DISTINCT category, ',' ORDER BY category) AS topics FROM l GROUP BY 1) SELECT m.\"user\", count(*)::BIGINT AS n, count(*) FILTER (layer = 'system')::BIGINT AS system, count(*) FILTER (layer = 'long_term')::BIGINT AS long_term, count(*) FILTER (layer = 'semantic')::BIGINT AS semantic, count(*) FILTER (layer = 'summary')::BIGINT AS summary, any_value(topics) AS topics FROM m JOIN t ON t.\"user\" = m.\"user\" GROUP BY 1",
}
