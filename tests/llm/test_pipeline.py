"""Stages of the pipeline against brute force and planted rows."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

from corpusmill.llm import byte_bpe, language_id, secret_scan
from corpusmill.llm import pipeline as corpus_pipeline


def _grams(text: str, n: int) -> set:
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def _close(a: set, b: set, percent: int) -> bool:
    common = len(a & b)
    return bool(a and b) and 100 * common >= percent * (len(a) + len(b) - common)


def test_near_copies(spark):
    """Of each group by five words and 80 in 100 the smallest id stays; some of these pairs are apart at four words and 85."""
    rng = random.Random(8)
    words = ["w%d" % i for i in range(500)]
    rows = []
    for edits in [*range(12)] * 2:
        base = [rng.choice(words) for _ in range(200)]
        copy = list(base)
        for k in range(edits):
            copy[8 + 16 * k] = "x%d" % rng.randrange(10**6)
        rows += [" ".join(base), " ".join(copy)]
    rows += ["a b c d", "a b c d", "one", "", " ".join(words)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sets = [_grams(t, 5) for t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in group[:]:
            for b in range(len(rows)):
                if group[a] != group[b] and _close(sets[a], sets[b], 80):
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert got == [i for i, g in enumerate(group) if i == g]
    four = [_grams(t, 4) for t in rows]
    assert any(_close(sets[i], sets[i + 1], 80) and not _close(four[i], four[i + 1], 85) for i in range(0, 48, 2))


FOREIGN = (
    "Вчера вечером мы долго гуляли по старому городу и говорили о книгах, которые прочитали летом.",
    "Χθες το βράδυ περπατήσαμε στην παλιά πόλη και μιλήσαμε για τα βιβλία που διαβάσαμε.",
    "昨日の夜、私たちは古い町を歩きながら、夏に読んだ本について長い間話しました。友人は来月また来ると言いました。",
    "Wczoraj wieczorem długo spacerowaliśmy po starym mieście i rozmawialiśmy o książkach, które przeczytaliśmy latem.",
    "Eilen illalla kävelimme pitkään vanhassa kaupungissa ja puhuimme kirjoista, jotka luimme kesällä.",
    "Dün akşam eski şehirde uzun süre yürüdük ve yazın okuduğumuz kitaplar hakkında konuştuk.",
)


def test_language(spark):
    """Held-out texts with a letter and very short ones stay; foreign sentences and random letters of six scripts go."""
    rng = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = list(FOREIGN)
    for low, high in ((97, 123), (0x430, 0x450), (0x3B1, 0x3CA), (0xAC00, 0xD7A4), (0x4E00, 0x9FA6), (0x627, 0x64B)):
        for words in (20, 50, 200, 2000):
            planted += [" ".join("".join(chr(rng.randrange(low, high)) for _ in range(rng.randint(2, 9))) for _ in range(words)) for _ in range(5)]
    short = ["Avec.", "A.", "Die tz."]
    more = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(planted + short)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(more.select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns))), "").select("doc_id").collect()}
    held = {r["doc_id"] for r in docs.filter(language_id.held_out(F.col("doc_id"))).select("doc_id", "text").collect() if any(c.isalpha() for c in r["text"] or "")}
    assert len(held) > 100 and held <= kept
    assert {i - 10**9 for i in kept if i >= 10**9} == set(range(len(planted), len(planted + short)))


def test_run(spark, tmp_path):
    """The whole pipeline on a table with planted rows, nulls, shared ids and columns named as the operators' own, against plain Python."""
    import public_tokenizers
    import tiktoken

    d = "/root/testdata/sf0.001"
    base = spark.read.parquet(d + "/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(120)
    item = spark.read.parquet(d + "/benchmark.parquet").first()["text"]
    first = base.filter("length(text) > 400").orderBy("doc_id").first()
    words = first["text"].split()
    copy = " ".join(words[:20] + ["other"] + words[21:])
    planted = [(9001, first["text"]), (9002, copy), (9003, "Here is what was asked: " + item + " And so it goes."), (9004, "the key is password=hunter2hunter2 and so on"), (9005, None), (9006, ""), (9007, "123 !!"), (None, "A text of no one at all."), (9008, "One text with this id here."), (9008, "Another text with this id there."), (9008, "One text with this id here.")]
    rows = [tuple(r) for r in base.collect()] + [(i, t, "en", "s", len(t or "")) for i, t in planted]
    docs = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, lang_pred string, component_id string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(d + "/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.language(spark, docs, str(tmp_path)).select("doc_id", "text").collect()]
    assert {9001, 9003, 9004, 9008, None} <= {i for i, _ in kept} and not {9005, 9006, 9007} & {i for i, _ in kept}
    by = collections.defaultdict(set)
    for i, t in kept:
        if i is not None:
            by[i].add(t)
    sets = [(i, _grams(t, 5)) for i, ts in by.items() for t in ts]
    group = {i: i for i in by}
    changed = True
    while changed:
        changed = False
        for n, (a, s) in enumerate(sets):
            for b, t in sets[:n]:
                if group[a] != group[b] and _close(s, t, 80):
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    assert group[9001] == group[9002] == first["doc_id"]
    left = [(i, t) for i in by if group[i] == i for t in by[i]] + [(i, t) for i, t in kept if i is None]
    items = [s for r in spark.read.parquet(d + "/benchmark.parquet").collect() if (s := _grams(r["text"] or "", 5))]
    bad = {i for i, t in left if i is not None and any(100 * len(s & _grams(t, 5)) >= 80 * len(s) for s in items)}
    assert 9003 in bad
    scorer = secret_scan.MarkovScorer(secret_scan.labelled_samples())
    coder = byte_bpe.coder(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    expected = []
    for i, t in left:
        if i not in bad:
            t = secret_scan.redacted(t, scorer, "[SECRET]")
            ids = other.encode_ordinary(t)
            expected.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(i == 9008 for i, *_ in got) == 2


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "/root/testdata/sf0.001")
        assert found.collect() == [] and (name == "byte_bpe" or found.columns == docs.columns)
