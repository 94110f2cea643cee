"""Exams drawn from a bank for many requests at once: pools by topic, a share of prioritised questions, fresh ones, and a fallback.

A draw without replacement by weights is the order of -ln(u) / weight with u from a digest of question, seed and
stage, so that it needs no state and is the same on any run. Weights are worked out for classes of requests and kinds of
questions, draws for each pair of a request and a question of its pool; a task draws some thousand pairs at once and
keeps the least draws of each request, so that all else works on few rows a request.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import rules as R
from ..functions.digests import md5_heads
from ..store import materialise

#: Kinds of exams, the topic of all, shares of prioritised questions, and what weighs how much.
WEAK, CHAPTER, PAST, MIXED, ALL = "薄弱点强化", "章节练习", "真题模拟", "综合练习", "综合"
STRICT = (CHAPTER, WEAK, PAST)
SHARE, OTHER_SHARE = {WEAK: 0.7, CHAPTER: 0.45, PAST: 0.25, MIXED: 0.35}, 0.3
LOW, MIDDLE = 0.35, 0.75
MASTERY = ({"easy": 100.0, "medium": 30.0, "hard": 1.0}, {"easy": 5.0, "medium": 20.0, "hard": 5.0}, {"easy": 0.1, "medium": 2.0, "hard": 50.0})
PAST_BONUS, MIXED_BONUS = ({"easy": 0.0, "medium": 0.35, "hard": 0.85}, 0.3), ({"easy": 0.2, "medium": 0.45, "hard": 0.35}, 0.25)
PRIORITY_BONUS, LEAST = 2.4, 0.01
#: What a question's weight depends on, but for the request and its rank in a search.
KIND = ("type", "own_topic", "own_tags", "difficulty", "near")
#: What its weights and its pool depend on of a request.
CLASS = ("topic", "topical", "strict", "exam", "types", "preferred", "strong", "mastery")
#: Questions of a row, and questions and requests of a cell, about; pairs drawn at once, and those of a task, about.
PACK, GROUP, BLOCK, AT_ONCE, PAIRS = 2_048, 1 << 18, 256, 1 << 15, 1 << 24
#: By how much a draw, rounded to nine places and by another logarithm, may come out otherwise.
SLACK = 2e-9


def _by(column: Column, values: dict, default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def weight(quality: Column, preferred: Column, mastered: Column, difficulty: Column, mastery: Column, semantic: Column, topical: Column, exam: Column, priority: Column, avoid: Column) -> Column:
    """How likely a question is drawn. ``quality``: 0 to 2 for the wanted topic; ``preferred`` and ``mastered``: how many of these tags it matches; ``topical``: whether a topic is wanted."""
    w = F.when(mastery < LOW, _by(difficulty, MASTERY[0], 1.0)).when(mastery < MIDDLE, _by(difficulty, MASTERY[1], 1.0)).otherwise(_by(difficulty, MASTERY[2], 1.0))
    w = w * F.when(semantic > 0.5, 1.0 + (semantic - 0.5) * 5.0).otherwise(1.0)
    w = w * F.when(topical & (quality > 0), 1.5).otherwise(1.0)
    w = w + preferred * F.when(exam == WEAK, 1.4).otherwise(0.9)
    w = w + F.when(priority, F.when(exam == WEAK, 2.0).otherwise(1.0)).otherwise(0.0)
    w = w * F.when(mastered > 0, F.greatest(F.lit(0.2), 1 - 0.18 * mastered)).otherwise(1.0)
    w = w * F.when(avoid, F.when(exam == WEAK, 0.55).otherwise(0.22)).otherwise(1.0)
    w = w + F.when(exam == PAST, _by(difficulty, *PAST_BONUS)).when(exam == MIXED, _by(difficulty, *MIXED_BONUS)).otherwise(0.0)
    w = w + F.when(exam.isin(*STRICT) & topical, 1.1 * quality).otherwise(0.0)
    return F.greatest(w, F.lit(LEAST))


def priority_target(exam: Column, n: Column, found: Column) -> Column:
    """How many prioritised questions an exam of n takes, of those found; halves are rounded to even."""
    return F.when((found <= 0) | (n <= 0), 0).otherwise(F.least(found, n, F.greatest(F.lit(1), F.bround(n * _by(exam, SHARE, OTHER_SHARE)).cast("int"))).cast("int"))


def _draw(id_: Column, seed: Column, stage: str, w: Column) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", id_.cast("string"), seed.cast("string"), F.lit(stage)).cast("binary")), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    return F.round(-F.log(u) / w, 9)


def _first(df: DataFrame, key: str, n: int | Column, most: int) -> DataFrame:
    """Of each request the first rows by ``key``: ``n``, and never more than ``most``."""
    rank = F.row_number().over(Window.partitionBy("request").orderBy(key, "id"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= most).filter(F.col("rank") <= n).drop("rank")


def _texts(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of text in bytes, and their bytes."""
    column = column.cast(pa.large_binary())
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    lengths = np.diff(ends)
    rows = [np.flatnonzero(lengths == n) for n in np.unique(lengths)]
    return [(at, raw[ends[at][:, None] + np.arange(lengths[at[0]])]) for at in rows]


def _least(weights: np.ndarray, heads: pa.Array, tails: pa.Array, deep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tail and a head, those of the least draws of each tail: ``deep`` of them, and what may be as good as the last."""
    rows: list[np.ndarray] = [np.zeros(0, np.int64)] * len(tails)
    draws: list[np.ndarray] = [np.zeros(0)] * len(tails)
    bound = np.full(len(tails), np.inf)
    for of, ends in _texts(tails):
        for at, begins in _texts(heads):
            order = np.argsort(-weights[at], kind="stable")  # who is drawn most likely comes first, so that the bound is soon low
            at, begins = at[order], begins[order]
            for start in range(0, len(at), AT_ONCE):
                own, weight = at[start : start + AT_ONCE], weights[at[start : start + AT_ONCE]]
                step = max(1, AT_ONCE // len(own))
                for first in range(0, len(of), step):
                    some = of[first : first + step]
                    numbers = md5_heads(begins[start : start + AT_ONCE], ends[first : first + step])
                    with np.errstate(divide="ignore", invalid="ignore"):
                        floor = np.nan_to_num(np.exp(-bound[some] * weight[0]) * 4294967297.0 - 3)
                        i, j = np.nonzero(numbers >= np.clip(floor, 0, 2**32 - 1).astype(np.uint32)[:, None])
                        k = np.nan_to_num(-np.log((numbers[i, j] + 1.0) / 4294967297.0) / weight[j], nan=np.inf, posinf=np.inf)
                    cuts = np.searchsorted(i, np.arange(len(some) + 1))
                    for r, a, b in zip(some.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                        if a < b:
                            new, best = np.concatenate([rows[r], own[j[a:b]]]), np.concatenate([draws[r], k[a:b]])
                            if len(best) > deep[r]:
                                bound[r] = np.partition(best, deep[r] - 1)[deep[r] - 1] * (1 + 1e-12) + SLACK
                                new, best = new[best <= bound[r]], best[best <= bound[r]]
                            rows[r], draws[r] = new, best
    return np.repeat(np.arange(len(tails)), [len(x) for x in rows]), np.concatenate(rows) if rows else np.zeros(0, np.int64)


def _drawn(schema: pa.Schema) -> Callable:
    """Of a cell's packs of questions and its requests, the rows (request, text, w) of the least draws."""

    def run(packs: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(packs) or not len(asked):
            return schema.empty_table()
        lists = packs["texts"].combine_chunks()
        texts, w = lists.flatten(), packs["w"].combine_chunks().take(pa.array(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())))
        # a null weight is a null draw, which comes first; one that is no number comes last
        weights = np.nan_to_num(w.fill_null(np.inf).to_numpy(zero_copy_only=False), nan=0.0, posinf=np.inf)
        i, j = _least(weights, texts, asked["tail"].combine_chunks(), asked["deep"].to_numpy())
        return pa.Table.from_arrays([asked["request"].combine_chunks().take(pa.array(i)), texts.take(pa.array(j)), w.take(pa.array(j))], schema=schema)

    return run


def _best(met: DataFrame, lacks: DataFrame, questions: DataFrame, draw: Column, most: int, stage: str = "2") -> DataFrame:
    """(request, id, seed, lack, k): of the questions of the kinds that each request of ``lacks`` has met, those with the least draws, at least ``lack`` and ``n_special`` more if there are so many.

    ``met``: kinds by class, or by request, with their weights w (without: 1); ``draw``: a draw of ``stage`` from id, seed and w.
    Draws are of single questions, so all pairs of a request and a question are drawn. Requests of a class are dealt into
    blocks and the questions of its kinds into groups; a cell is a block and a group, and gives few rows for each request.
    """
    spark = met.sparkSession
    if "class" not in met.columns:
        met, lacks = (df.withColumn("class", F.col("request")) for df in (met, lacks))
    met = met if "w" in met.columns else met.withColumn("w", F.lit(1.0))
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    dealt = lambda n, *columns: F.pmod(F.xxhash64(*columns), n).cast("int")
    sizes = questions.groupBy("kind").agg(F.count("*").alias("size"))
    packs = questions.join(sizes, "kind").groupBy("kind", dealt(parts(F.col("size"), PACK), "id").alias("pack")).agg(F.collect_list(F.col("id").cast("string") + F.lit("") if False else F.col("id").cast("string")).alias("texts"))
    pools = met.select("class", "kind").join(sizes, "kind").groupBy("class").agg(F.sum("size").alias("n_questions"))
    asked = lacks.groupBy("class").agg(F.count("*").alias("n_requests"))
    cells = materialise(pools.join(asked, "class").withColumn("groups", parts(F.col("n_questions"), GROUP)).withColumn("blocks", parts(F.col("n_requests"), BLOCK)), "exam-cells")
    n, pairs = cells.agg(F.coalesce(F.sum(F.col("groups") * F.col("blocks")), F.lit(0)), F.coalesce(F.sum(F.col("n_questions") * F.col("n_requests")), F.lit(0))).first()
    tasks = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs // PAIRS)))
    cell = ("class", "group", "block")
    left = met.select("class", "kind", "w").join(cells, "class").join(packs, "kind").select("class", dealt(F.col("groups"), "kind", "pack").alias("group"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "texts", "w")
    right = lacks.join(cells, "class").select("class", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), dealt(F.col("blocks"), "request").alias("block"), "request", F.concat(F.lit(":"), F.concat_ws(":", F.col("seed").cast("string"), F.lit(stage))).alias("tail"), (F.col("lack") + F.col("n_special")).cast("bigint").alias("deep"))
    kind = StructType([lacks.schema["request"]]).add("text", "string").add("w", "double")
    found = left.repartition(tasks, *cell).groupBy(*cell).cogroup(right.repartition(tasks, *cell).groupBy(*cell)).applyInArrow(_drawn(to_arrow_schema(kind)), kind)
    found = found.select("request", F.col("text").cast(questions.schema["id"].dataType).alias("id"), "w")
    return found.join(lacks.select("request", "seed", "lack"), "request").select("request", "id", "seed", "lack", draw.alias("k"))


def sample(requests: DataFrame, bank: DataFrame, hits: DataFrame, most: int = 20) -> DataFrame:
    """(request, id, stage, place): the questions of each request in the order of a seeded shuffle.

    ``requests``: request, topic (null or ALL: any), exam, n (up to ``most``), types (array), preferred, strong (arrays of tags), avoid, prioritised (arrays of ids), mastery, seed.
    ``bank``: usable questions: id, type, topic, tags, difficulty. ``hits``: topic, id and rrf, the fused rank score of a search for the topic.
    Stages: 1 prioritised questions (of the topic, or if it has none, of the types), their share of n; 2 questions of the pool, without those
    to avoid if there are enough of them; 3 what still lacks, of the pool if the topic is strict, else of all of the types. A
    strict topic without questions gives none.
    """
    spark = requests.sparkSession
    topical = F.col("topic").isNotNull() & (F.col("topic") != ALL)
    asked = requests.withColumn("topic", R.topic_name(F.col("topic"))).withColumn("topical", topical).withColumn("strict", topical & F.col("exam").isin(*STRICT))
    flat = lambda name: F.array_distinct(F.coalesce(name, F.array().cast(requests.schema[name].dataType)))
    asked = asked.withColumn("prioritised", flat("prioritised")).withColumn("avoid", flat("avoid")).withColumn("special", F.array_union("prioritised", "avoid"))
    # requests of one class are alike to every question, but for their draws
    alike = lambda a, b, columns: reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns))
    classes = materialise(asked.select(*CLASS).distinct().withColumn("class", F.monotonically_increasing_id()), "exam-classes")
    asked = materialise(asked.alias("a").join(classes.alias("c"), alike("a", "c", CLASS)).select("a.*", "class"), "exam-requests")
    state = asked.select("request", "class", "topic", "topical", "strict", "exam", "n", "mastery", "seed", F.size("special").alias("n_special"))
    semantic = hits.select(R.topic_name(F.col("topic")).alias("topic"), "id", (F.col("rrf") * 30).alias("semantic")).filter("topic IS NOT NULL").groupBy("topic", "id").agg(F.max("semantic").alias("semantic"))
    near = semantic.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("topic", "semantic"))).alias("near"))
    b = bank.select("id", "type", R.topic_name(F.col("topic")).alias("own_topic"), F.transform("tags", lambda t: R.topic_name(t)).alias("own_tags"), "difficulty").join(near, "id", "left")
    # questions of one kind are alike to every request, but for their draws
    kinds = materialise(b.groupBy(*KIND).agg(F.count("*").alias("size")).withColumn("kind", F.monotonically_increasing_id()), "exam-kinds")
    questions = materialise(b.alias("b").join(kinds.alias("k"), alike("b", "k", KIND)).select("b.id", "kind"), "exam-questions")
    matches = lambda tags: F.size(F.filter(tags, lambda t: (R.topic_name(t) == F.col("own_topic")) | F.array_contains("own_tags", R.topic_name(t))))
    quality = F.when(~F.col("topical"), 0).when(F.col("own_topic") == F.col("topic"), 2).when(F.array_contains("own_tags", F.col("topic")), 1).otherwise(0)
    closeness = F.coalesce(F.try_element_at(F.map_from_entries("near"), F.col("topic")), F.lit(0.0))
    # classes may be few, and meet all kinds
    own = classes.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "class").withColumn("type", F.explode(F.array_distinct("types")))
    met = own.join(kinds, "type").select("class", "kind", "size", "difficulty", "topical", "strict", "exam", "mastery", quality.alias("quality"), matches("preferred").alias("preferred"), matches("strong").alias("mastered"), closeness.alias("semantic"))
    loose = met.groupBy("class").agg(F.max(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("loose"))
    in_pool = F.when(~F.col("topical"), True).when(F.col("strict"), F.col("quality") == 2).when(F.col("loose") == 1, F.col("quality") > 0).otherwise(True)
    none = F.lit(False)
    weighed = lambda priority, shun: weight(F.col("quality"), F.col("preferred"), F.col("mastered"), F.col("difficulty"), F.col("mastery"), F.col("semantic"), F.col("topical"), F.col("exam"), priority, shun)
    met = materialise(met.withColumn("w", weighed(none, none)).join(loose, "class").select("class", "kind", "size", "difficulty", "quality", "preferred", "mastered", "semantic", "w", in_pool.alias("pool")), "exam-kinds-met")
    # questions that a request names, a few; all others are neither prioritised nor to be avoided
    named = asked.select("request", "class", "prioritised", "avoid", F.explode("special").alias("id")).select("request", "class", "id", F.array_contains("prioritised", F.col("id")).alias("priority"), F.array_contains("avoid", F.col("id")).alias("avoid"))
    named = materialise(named.join(questions, "id").join(met.drop("size", "w"), ["class", "kind"]).join(state.drop("class"), "request"), "exam-named")
    draw = lambda stage, priority, shun, more=0.0: _draw(F.col("id"), F.col("seed"), stage, weighed(priority, shun) + more)
    drawn = lambda stage: _draw(F.col("id"), F.col("seed"), stage, F.col("w"))
    # a prioritised question fits if its topic does, loosely; without such a one any of the types does
    on_topic = F.col("pool") & F.col("priority") & (~F.col("topical") | (F.col("quality") > 0))
    totals = state.select("request", "class").join(met.groupBy("class").agg(F.sum(F.when(F.col("pool"), F.col("size")).otherwise(0)).alias("n_pool")), "class").drop("class")
    few = named.groupBy("request").agg(F.count_if(on_topic).alias("n_priority"), F.count_if("priority").alias("n_any"), F.count_if(F.col("pool") & F.col("avoid")).alias("n_avoid"))
    totals = materialise(totals.filter("n_pool > 0").join(few, "request", "left").na.fill(0, ["n_priority", "n_any", "n_avoid"]), "exam-totals")
    held = named.join(totals, "request")
    first = F.when(F.col("n_priority") > 0, on_topic).otherwise(F.col("priority"))
    target = priority_target(F.col("exam"), F.col("n"), F.when(F.col("n_priority") > 0, F.col("n_priority")).otherwise(F.col("n_any")))
    lead = held.filter(first).select("*", target.alias("target"), draw("1", F.col("priority"), none, PRIORITY_BONUS).alias("k"))
    one = materialise(_first(lead, "k", F.col("target"), most).select("request", "id", "seed", "pool", "avoid", F.lit(1).alias("stage")), "exam-one")
    taken = one.groupBy("request").agg(F.count("*").alias("taken"), F.count_if(F.col("pool") & ~F.col("avoid")).alias("fresh_taken"))
    lacks = state.join(totals, "request").join(taken, "request", "left").na.fill(0, ["taken", "fresh_taken"]).withColumn("lack", F.least(F.col("n") - F.col("taken"), F.lit(most)))
    enough = F.col("n_pool") - F.col("n_avoid") - F.col("fresh_taken") >= F.col("n") - F.col("taken")
    lacks = materialise(lacks.filter("lack > 0").withColumn("enough", enough), "exam-lacks")
    pooled = _best(met.filter("pool"), lacks, questions, drawn("2"), most, "2").join(named.select("request", "id"), ["request", "id"], "left_anti")
    also = named.join(lacks.select("request", "lack", "enough"), "request").filter(F.col("pool") & (~F.col("enough") | ~F.col("avoid"))).join(one.select("request", "id"), ["request", "id"], "left_anti")
    also = also.select("request", "id", "seed", "lack", draw("2", F.col("priority"), F.col("avoid")).alias("k"))
    two = _first(pooled.unionByName(also), "k", F.col("lack"), most).select("request", "id", "seed", F.lit(2).alias("stage"))
    so_far = materialise(one.select("request", "id", "seed", "stage").unionByName(two), "exam-two")
    filled = so_far.groupBy("request").agg(F.count("*").alias("taken"))
    # a strict topic has given all it has; of the others those lack whose pool was small
    rest = lacks.drop("taken", "lack").filter("NOT strict").join(filled, "request", "left").na.fill(0, ["taken"]).withColumn("lack", F.least(F.col("n") - F.col("taken"), F.lit(most)))
    rest = materialise(rest.filter("lack > 0").withColumn("n_special", F.col("n_special") + F.col("taken")), "exam-rest")
    others = _best(met, rest, questions, drawn("3"), most, "3").join(named.select("request", "id"), ["request", "id"], "left_anti")
    also = named.join(rest.select("request", "lack"), "request").select("request", "id", "seed", "lack", draw("3", F.col("priority"), none).alias("k"))
    far = others.unionByName(also).join(so_far.select("request", "id"), ["request", "id"], "left_anti")
    three = _first(far, "k", F.col("lack"), most).select("request", "id", "seed", F.lit(3).alias("stage"))
    order = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("seed").cast("string"), F.lit("shuffle")).cast("binary"))
    place = F.row_number().over(Window.partitionBy("request").orderBy(order, "id"))
    return so_far.unionByName(three).select("request", "id", "stage", place.alias("place"))


def plan(profiles: DataFrame) -> DataFrame:
    """Requests of users: preferred tags are weak points, then goals; recent questions are avoided, and so are those of the wrong bank, which an exam for weak points prioritises instead.

    Takes request, topic, exam (null: MIXED), n, types, weak, goals, strong, recent, wrong, mastery, seed.
    """
    exam = F.coalesce(F.nullif(F.trim("exam"), F.lit("")), F.lit(MIXED))
    empty = F.array().cast(profiles.schema["wrong"].dataType)
    weak_points = F.col("exam") == WEAK
    own = profiles.withColumn("exam", exam)
    return own.select("request", "topic", "exam", "n", "types", F.array_distinct(F.concat("weak", "goals")).alias("preferred"), "strong", F.when(weak_points, F.col("recent")).otherwise(F.array_union("recent", "wrong")).alias("avoid"), F.when(weak_points, F.col("wrong")).otherwise(empty).alias("prioritised"), "mastery", "seed")
