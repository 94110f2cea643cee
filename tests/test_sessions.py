"""Streams of sessions and profiles give what the batch rules give, and replays change nothing; the log of turns."""

import datetime

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import sessions as S
from corpusmill.streaming import maintenance as M

TURNS = "session string, turn bigint, request string, answer string, at timestamp"
DAY = datetime.datetime(2024, 1, 1)


def _turn(session, turn, day=0):
    return session, turn, f"ask {turn}", f"say {turn}", DAY + datetime.timedelta(days=day, minutes=turn)


def _run(spark, tmp_path, batches, schema, make, name):
    """The rows of a stream over one file for each batch."""
    path = tmp_path / name
    rows = []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(path / "in"))
        out = make(spark.readStream.schema(schema).json(str(path / "in")))
        query = out.writeStream.foreachBatch(lambda df, n: rows.extend((i, r) for r in df.collect())).outputMode("update").option("checkpointLocation", str(path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return rows


def test_compression_stream(spark, tmp_path):
    turns = [_turn("a", t) for t in range(31)] + [_turn("b", t) for t in range(13)] + [_turn("c", t) for t in range(14)]
    first = [t for t in turns if t[1] < 9]
    late = [_turn("a", 12), _turn("a", 10)]  # ahead of others
    batches = [first, late + first[:5], [t for t in turns if 9 <= t[1] < 20], turns, turns[-3:], [_turn("z", 0, day=90)], [_turn("z", 1, day=91)]]
    rows = _run(spark, tmp_path, batches, TURNS, lambda s: M.maintained(s), "s")
    made = [r for _, r in rows if r["event"] == "compressed"]
    want = S.chunks(spark.createDataFrame(turns, TURNS)).collect()
    key = lambda r: (r["session"], r["chunk"], r["from_turn"], r["to_turn"], r["n_turns"], [(t["turn"], t["request"], t["answer"]) for t in r["turns"]])
    assert sorted(map(key, made)) == sorted(map(key, want)) and len(made) == 4  # each chunk once, though turns came again
    gone = {r["session"]: r for _, r in rows if r["event"] == "expired"}
    assert {k: (r["from_turn"], r["to_turn"], r["n_turns"]) for k, r in gone.items()} == {"a": (24, 30, 7), "b": (0, 12, 13), "c": (8, 13, 6)}


def test_chunks_rule(spark):
    """A plain walk with a cursor, turn by turn."""
    for n in (0, 9, 10, 13, 14, 21, 22, 40):
        cursor, want = 0, []
        for count in range(1, n + 1):
            if count >= 10 and count - 6 - cursor >= 8:
                want.append((cursor, cursor + 7))
                cursor += 8
        turns = spark.createDataFrame([_turn("x", t) for t in range(n)], TURNS)
        assert sorted((r["from_turn"], r["to_turn"]) for r in S.chunks(turns).collect()) == want


UPDATES = "user string, field string, key string, value string, at string"
ROWS = [
    ("u", "study_goals", None, "b", "03"), ("u", "study_goals", None, "a", "01"), ("u", "study_goals", None, " a ", "09"), ("u", "name", None, "old", "02"), ("u", "name", None, "new", "05"), ("u", "name", None, "", "08"),
    ("u", "preferences", "k", "1", "01"), ("u", "preferences", "k", "2", "04"), ("u", "preferences", None, "x", "04"), ("u", "target_score", None, "60", "06"), ("v", "notes", None, None, "01"), ("v", "notes", None, "n", "02"), (None, "notes", None, "n", "02"),
]


def _profile(r):
    return r["user"], r["name"], *(tuple(r[f]) for f in S.LISTS), tuple(sorted(r["preferences"].items())), tuple(sorted(r["attributes"].items()))


def test_profile_fold(spark, tmp_path):
    want = {_profile(r) for r in S.folded_profiles(spark.createDataFrame(ROWS, UPDATES), "at").collect()}
    assert want == {("u", "new", ("a", "b"), (), (), (), (("k", "2"),), (("target_score", "60"),)), ("v", None, (), (), (), ("n",), (), ())}
    batches = [ROWS[:5], ROWS[5:], ROWS[2:7], ROWS]  # parts, then replays
    rows = _run(spark, tmp_path, batches, UPDATES, lambda s: M.folded(s, "at"), "p")
    for n in (1, 2, 3):
        last = {r["user"]: _profile(r) for i, r in rows if i <= n}
        assert set(last.values()) == want


def test_turn_log(spark, tmp_path):
    rows = lambda turns, seq, text: spark.createDataFrame([("s", t, seq, text) for t in turns], "session string, turn int, seq int, text string")
    log = S.TurnLog(spark, str(tmp_path / "log"), "session", "turn")
    with pytest.raises(FileNotFoundError):
        log.current()
    now = lambda: sorted((r["turn"], r["text"]) for r in log.current().collect())
    log.append(rows(range(5), 2, "whole"), 0)
    log.append(rows(range(2), 1, "short and late"), 1)
    whole = [(t, "whole") for t in range(5)]
    assert now() == whole
    log.append(rows(range(2), 1, "short and late"), 1)  # the batch runs again
    assert now() == whole
    log.compact()
    assert now() == whole
    log.append(rows([4], 3, "anew"), 2)
    log.append(rows([5], 3, "next"), 3)
    after = whole[:4] + [(4, "anew"), (5, "next")]
    assert now() == after
    version = log.compact()
    assert now() == after and version.seq == 1 and version.facts["batch"] == 3
    assert sorted(r["turn"] for r in S.merged_turns(rows([None, 1], 1, "x").unionByName(rows([1], 1, "y")), "session", "turn").collect()) == [1]


def test_turn_functions(spark):
    from corpusmill.functions import history as H

    df = spark.createDataFrame([("请补充 材料", None), ("a b", "x\n\n y \nFinal Answer: z\nq\nw"), ("what？ ", "Final Answer: no"), (None, "")], "answer string, trace string")
    got = [tuple(r) for r in df.select(H.open_loop(F.col("answer")), H.reasoning_digest(F.col("trace"), F.array(F.lit("t")), F.col("answer"))).collect()]
    assert got == [("请补充 材料", "本轮主要依赖工具 t 完成任务。"), (None, "y；q；w"), ("what？", "本轮主要依赖工具 t 完成任务。"), (None, "本轮主要依赖工具 t 完成任务。")]
    words = F.array(*map(F.lit, ["b", "用户", "法", "aa", "bb", "aa", "cc", "bb"]))
    assert spark.range(1).select(H.top_keywords(words, 3)).first()[0] == ["aa", "bb", "法"]
