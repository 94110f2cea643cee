"""Spelling variants, token counts and collocations against plain forms on small rows, and against the library on whole tables."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from corpusmill.llm import collocations, spelling, token_counts

SCHEMA = "doc_id bigint, text string, lang string, phrase string, word string, piece string, n bigint, h int"


def _rows() -> list[tuple]:
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(6, 11))) for _ in range(40)]
    words = stems + ["Kirchhoff", "kirchhof", "kirchof", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÉCOLESS", "Écoless", "l'avenue", "x9letters"]
    rows = []
    for i in range(400):
        text = [rng.choice(words[:12] if rng.random() < 0.7 else words) for _ in range(rng.choice((0, 1, 5, 40)))]
        for k in range(len(text)):
            w = text[k]
            if rng.random() < 0.1:
                j = rng.randrange(len(w))
                text[k] = rng.choice([w[:j] + w[j + 1 :], w[:j] + "z" + w[j:], w[:j] + "q" + w[j + 1 :]])
            if rng.random() < 0.15:
                text[k] += rng.choice([".", ",", "\n", "\t", ";x", "!?", " ", " ", "\x1c"])
        rows.append((i, " ".join(text), rng.choice(["en", "de", None])))
    rows += [(900, None, "en"), (901, "", None), (902, " \t\n", "xx"), (903, "one", "xx"), (None, "Kirchhoff kirchhoff. kirchhoff", "en"), (904, "same row again", "en"), (904, "same row again", "en"), (904, "other text same id", "en")]
    rows += [(905, "w " * 60_000 + "aaaaaaa " * 3, "en"), (906, "x" * 200_000 + " <|endoftext|> y<|endoftext|>", "en"), (907, "'s 'll don't՘ẞ  \n  x一\U0001f600", "zz")]
    return [r + ("clash", "clash", "clash", 1, 2) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


def _lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def _variants(rows: list[tuple]) -> dict:
    counts = collections.Counter()
    for i, text, *_ in rows:
        for run in re.findall("[a-zÀ-ÿ]+", _lower(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    known = {w: n for w, n in counts.items() if n >= 2}

    def one(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in known if v != w and one(v, w)] for w in known}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best and known[best] >= 10 * known[w] else None
    out = {}
    for w, n in known.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = form[w], root, n, len(near[w]), known.get(form[w])
    return out


def test_variants(docs):
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(docs).collect()}
    want = _variants(_rows())
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20 and max(v[3] for v in want.values()) > 5
    assert spelling.variants(docs.limit(0)).collect() == []


def test_variant_chains(spark):
    """Forms of forms, of eleven letters, each ten times as frequent as the last."""
    words = ["abcdefghijk", "abcdefghijx", "abcdefghyx", "abcdefghyxz"]
    rows = [(k, f"{w} " * 10**i) for i, w in enumerate(words, 1) for k in range(2)]
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {w: (f, r) for w, (f, r, *_) in _variants(rows).items()}


def test_deletion_keys():
    """Equal keys where and only where equal letters are left, and in a group a wrong key joins nothing."""
    words = ["abcabca", "abcabcb", "abcabcab", "aaaaaaa", "aaaaaaaa", "zzzzzzzÿ"]
    which, places, keys = spelling.deletion_keys(words)
    left = [words[w] if p < 0 else words[w][:p] + words[w][p + 1 :] for w, p in zip(which, places)]
    by_key, by_left = collections.defaultdict(set), collections.defaultdict(set)
    for i, (k, x) in enumerate(zip(keys.tolist(), left)):
        by_key[k].add(i)
        by_left[x].add(i)
    assert sorted(map(sorted, by_key.values())) == sorted(map(sorted, by_left.values()))
    clash = pa.RecordBatch.from_pydict({"key": [5, 5, 5, 5], "word": ["abcdefg", "abcdefgh", "zbcdefg", "uvwxyzz"], "n": [1, 2, 3, 4], "place": [-1, 7, 0, 0]})
    found = [r for b in spelling._near(iter([clash.slice(0, 1), clash.slice(1)])) for r in b.to_pylist()]
    assert sorted((r["word"], r["near"], r["best"]) for r in found) == [("abcdefg", 1, "abcdefgh"), ("abcdefgh", 1, "abcdefg")]


def _library(name: str, texts: list) -> list[int]:
    return [len(x.ids) for x in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(docs, name):
    rows = _rows()
    want = sorted(((i, len((t or "").encode()), n, n > 1024) for (i, t, *_), n in zip(rows, _library(name, [r[1] for r in rows]))), key=str)
    assert sorted(map(tuple, token_counts.count_tokens(docs, name).collect()), key=str) == want
    assert token_counts.count_tokens(docs.limit(0), name).collect() == []


def test_token_counts_shuffled(docs, monkeypatch):
    """No pre-token is broadcast."""
    want = sorted(map(tuple, token_counts.count_tokens(docs).collect()), key=str)
    monkeypatch.setattr(token_counts, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, token_counts.count_tokens(docs).collect()), key=str) == want


def test_token_counts_query(spark):
    given = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {r["doc_id"]: n for r, n in zip(given, _library("byte_bpe_50k.json", [r["text"] for r in given]))}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.query(spark, "/root/testdata/sf0.01").collect()} == want


def test_unassigned():
    assert token_counts.may_differ("a͸") and token_counts.may_differ("\U0003fc3f") and not token_counts.may_differ("aé一\U0001f600\n")


def _collocations(rows: list[tuple], least: int, top: int, most: int = 3) -> list[tuple]:
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", _lower(text or "")):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) >= 2 and a >= least}
    around = collections.Counter()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                around[lang, w[i : i + m]] = max(around[lang, w[i : i + m]], a)
    by = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        score, _, l, r = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        if 100 * around[lang, w] < 50 * a:
            by[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in by.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


@pytest.mark.parametrize("most,cells", [(3, 20), (3, 8), (4, 20), (2, 12)])
def test_collocations(docs, most, cells):
    """Also with a sketch so small that most phrases are candidates."""
    got = sorted(map(tuple, collocations.collocations(docs, least=4, most=most, top=50, cells=cells).collect()))
    assert got == _collocations(_rows(), 4, 50, most) and len(got) > 50


def test_collocations_empty(docs):
    assert collocations.collocations(docs.limit(0), cells=10).collect() == []


def test_collocation_shards(docs, monkeypatch):
    """Many small shards and automata give the same rows."""
    monkeypatch.setattr(collocations, "HELD", 2000)
    monkeypatch.setattr(collocations, "PATTERN_BYTES", 100)
    monkeypatch.setattr(collocations, "SLAB", 14)
    assert sorted(map(tuple, collocations.collocations(docs, least=4, top=50, cells=16).collect())) == _collocations(_rows(), 4, 50)
    monkeypatch.setattr(collocations, "SLAB", 15)  # two slabs in eight partitions: each is summed in four parts first
    assert sorted(map(tuple, collocations.collocations(docs, least=4, top=50, cells=16).collect())) == _collocations(_rows(), 4, 50)


def test_matches():
    assert collocations.canonical([b"A b\tB", b"b b b,c"]) == b" a b b \n b b b \n c "
    assert collocations.matches(" b b b \n b ", [" b ", " b b ", " b b b ", " c "]).tolist() == [4, 2, 1, 0]


def test_collocations_cells(docs, monkeypatch):
    """Cells grow with the text, so that they do not fill; a phrase is no candidate where a part of it is rare; sums are made before the driver asks for them."""
    assert [collocations.cells_for(n) for n in (0, 1 << 29, (1 << 30) - 1, 1 << 30, 6 << 30, 1 << 50)] == [27, 27, 27, 28, 30, 30]
    bits = np.frombuffer(np.packbits([1, 1, 0, 1, 1, 1, 1, 1], bitorder="little").tobytes(), dtype=np.uint8)
    phrases = [(1, np.arange(4), np.array([0, 1, 2, 3], np.uint32)), (2, np.array([0, 1, 2]), np.array([4, 5, 6], np.uint32)), (3, np.array([0, 1]), np.array([7, 7], np.uint32))]
    assert [(k, at.tolist()) for k, at in collocations._heavy(iter(phrases), bits, 4)] == [(1, [0, 1, 3]), (2, [0]), (3, [])]
    made, real = [], collocations.materialise
    monkeypatch.setattr(collocations, "materialise", lambda df, tag: made.append(tag) or real(df, tag))
    assert collocations.phrase_counts(docs, least=4, cells=16).count() > 50 and made == ["cells", "phrases"]
