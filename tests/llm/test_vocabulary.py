"""Importance resampling, byte-level BPE and spelling variants against slow models, the tokenizers library and planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomline.llm import bpe, queries, resampling, spelling

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, id long, n long, word string, score string, bucket string, ids string, pos string, tile string, weight string"
EXTRA = (7, 8, "w", "s", "b", "i", "p", "t", "g")


def edge_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, columns whose names clash with the operators' own."""
    long = " ".join(random.Random(1).choice("abcdefg") * 5 + f"x{i % 977}" for i in range(60_000))
    texts = ["one two", "", None, " \n\t ", long, "same words here and there again", "same words here and there again", "y" * 20_000, "é漢字 \U0001f600 mixed", "a"]
    data = [(i, t, "en" if i % 2 else None, *EXTRA) for i, t in enumerate(texts)]
    data += [(5, texts[5], "en", *EXTRA), (None, "no id at all " * 20, None, *([None] * 9)), (None, None, None, *([None] * 9))]
    return spark.createDataFrame(data, SCHEMA)


# --- 11 importance resampling


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def brute_resample(docs, target, n, m, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % m
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, n)[0]))
    for text in target:
        t.update(map(bucket, features(text, n)[0]))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + m) / ((s[b] + 1) * (T + m)))) for b in range(m)}
    rows = {}
    for d, text in docs:
        found, words = features(text, n)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows[d] = [words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    open_ = sorted((d for d in rows if rows[d][0] >= least), key=lambda d: (-rows[d][3], d))
    for i, d in enumerate(open_[: percent * len(open_) // 100]):
        rows[d][4] = i + 1
    return {d: tuple(r) for d, r in rows.items()}


@given(st.text(max_size=60), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_ring_hashes_every_run_once(text, n):
    states, words = resampling.feature_states(text.encode("utf-8", "replace"), n)
    want, count = features(text.encode("utf-8", "replace").decode(), n)
    assert Counter(states) == Counter(zlib.crc32(f.encode()) for f in want) and words == count


@pytest.mark.parametrize("n,m", [(1, 10_000), (3, 512)])
def test_resampling_equals_brute_force(spark, n, m):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {r.doc_id: (r.n_words, r.n_features, r.weight, r.score, r.rank) for r in resampling.importance_resample(docs, target, n=n, buckets=m).collect()}
    assert got == brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], n, m)


def test_resampling_draws_what_the_target_holds(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["red", "green", "blue"] if i % 5 == 0 else ["iron", "zinc", "lead"]) for _ in range(40))) for i in range(200)]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("blue green red green blue",)] * 3, "text string")
    drawn = resampling.resampled_documents(docs, target)
    assert drawn.columns == docs.columns
    ids = [x.doc_id for x in drawn.collect()]
    assert len(ids) == 20 and all(i % 5 == 0 for i in ids)


def test_resampling_edges(spark):
    docs, target = edge_docs(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = resampling.importance_resample(docs, target).collect()
    assert len(got) == docs.count()
    assert all((x.n_features, x.weight, x.rank) == (0, 0, None) for x in got if x.doc_id in (1, 2, 3))
    assert {x.n_features for x in got if x.doc_id == 5} == {6 + 5} and len({(x.weight, x.score) for x in got if x.doc_id == 5}) == 1
    assert resampling.importance_resample(docs.limit(0), target).collect() == []
    none = resampling.importance_resample(docs, target.limit(0)).collect()
    assert len(none) == docs.count()
    tied = spark.createDataFrame([(i // 2, "w " * 30) for i in range(40)], "doc_id long, text string")
    ranks = {(x.doc_id, x.rank) for x in resampling.importance_resample(tied, target, percent=50).collect() if x.rank}
    assert sorted(r for _, r in ranks) == list(range(1, 21)) and len({d for d, _ in ranks}) == 10


# --- 12 BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def test_bpe_of_all_documents_equals_the_library(spark, library):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_bpe(spark, SF).collect()}
    assert got.keys() == rows.keys()
    for d, text in rows.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


HARD = [
    "", " ", "  a", "a  ", "\n\n\t x\r\n", "it's we'll I'd 're", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>c", "<|endoftext|", "x" * 5000, "aaab" * 3000, "漢字かな" * 800,
    "\U0001f600\U0001f601 mixed é é    　 end", "1234567890 3.14 -- !!!???", "\x00\x01 \x7f", "ÿþ\u0085next", "ab" * 9000 + " " + "ba" * 9000, "a\x1cb\x1d c",
]


@pytest.mark.parametrize("text", HARD)
def test_bpe_of_hard_texts(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    codec = bpe.codec(BPE)
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids
    assert codec.decode(codec.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=80))
@settings(max_examples=400, deadline=None)
def test_bpe_of_any_text(text):
    codec, known = bpe.codec(BPE), Tokenizer.from_file(BPE) if not hasattr(test_bpe_of_any_text, "known") else test_bpe_of_any_text.known
    test_bpe_of_any_text.known = known
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == known.encode(text, add_special_tokens=False).ids
    assert codec.decode(codec.encode(text)) == text


def test_decoding_of_any_ids(library):
    r = random.Random(4)
    codec = bpe.codec(BPE)
    for _ in range(300):
        ids = [r.randrange(50_257) for _ in range(r.randint(0, 30))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_remembered_stretches_are_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "MAX_UNITS", 50)
    codec = bpe.Codec(BPE)
    text = " ".join(f"word{i}" for i in range(1000))
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids and len(codec.young) <= 50 >= len(codec.old)


def test_bpe_edges(spark, library):
    docs = edge_docs(spark)
    got = bpe.decode_documents(bpe.encode_documents(docs, BPE), BPE).collect()
    assert Counter((x.id, x.text) for x in got) == Counter((x.doc_id, x.text or "") for x in docs.collect())
    assert all(x.n_tokens == len(library.encode(x.text).ids) == len(x.ids) // 4 for x in got)
    assert bpe.encode_documents(docs.limit(0), BPE).collect() == []


# --- 13 spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words, ratio=10):
    out = {}
    for w, n in words.items():
        close = sorted((-words[x], x) for x in words if near(w, x))
        form = close[0][1] if close and -close[0][0] >= ratio * n else None
        out[w] = [form, None, n, len(close), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


def groups(spark, words, **options):
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_groups(table, **options).collect()}


@pytest.mark.parametrize("hot", [None, 1, 5])
def test_groups_equal_brute_force(spark, hot):
    """Few letters, so that bigrams repeat inside words, and any hot bigram split by what one deletion leaves."""
    r = random.Random(6)
    words = {"".join(r.choice("abé") for _ in range(r.randint(4, 8))): r.choice([2, 3, 20, 45, 460, 7000]) for _ in range(700)}
    words |= {"aaaaaaa": 3, "aaaaaaaa": 40, "aaaaaaaaa": 900, "Àbcdefg": 4, "abcdefghÿ": 2, "abcdefgh": 200}
    assert groups(spark, words, hot=hot) == brute_groups(words)


def test_near_words_share_a_rare_bigram():
    r = random.Random(8)
    for _ in range(3000):
        a = "".join(r.choice("abcd") for _ in range(r.randint(4, 9)))
        i = r.randrange(len(a))
        b = r.choice([a[:i] + r.choice("abcd") + a[i + 1 :], a[:i] + a[i + 1 :], a[:i] + r.choice("abcd") + a[i:]])
        if len(b) < 4 or not near(a, b):
            continue
        order = [x + y for x in "abcd" for y in "abcd"]
        r.shuffle(order)
        ranks = {g: k for k, g in enumerate(order)}
        s, l = sorted((a, b), key=len)
        keys = {(g, p) for g, p in spelling.rarest(s, ranks)}
        moved = (0,) if len(s) == len(l) else (0, 1)
        assert any((g, p - k) in keys for g, p in spelling.rarest(l, ranks) for k in moved), (a, b)


def test_forms_lead_to_the_root(spark):
    words = {"separate": 40_000, "seperate": 3_000, "seperrate": 200, "seperrrate": 3, "definite": 50, "definate": 6, "lonelyword": 9}
    got = groups(spark, words)
    assert got["seperrrate"] == ("seperrate", "separate", 3, 1, 200) and got["separate"][:2] == (None, "separate")
    assert got["definate"][0] is None and got["lonelyword"] == (None, "lonelyword", 9, 0, None)
    tied = groups(spark, {"abcdefgx": 50, "abcdefgy": 50, "abcdefgz": 5})
    assert tied["abcdefgz"][0] == "abcdefgx"


def test_words_of_a_corpus_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = Counter()
    for d, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{d}:{run}".encode())
            at = h % len(run)
            run = run[:at] + run[at + 1 :] if h % 31 == 0 else run
            want[run] += 1
    got = {r.word: r.n for r in spelling.corpus_words(spark.read.parquet(f"{SF}/documents.parquet"), drop_every=31).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}


def test_spelling_edges(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH", 3)
    docs = edge_docs(spark)
    words = spelling.corpus_words(docs, least=4)
    assert {r.word: r.n for r in words.collect()} == Counter(w for r in docs.collect() for w in re.findall("[a-zÀ-ÿ]{4,}", lower(r.text))) - Counter({"mixed": 1, "y" * 20_000: 1})
    assert spelling.spelling_groups(spelling.corpus_words(docs.limit(0))).collect() == []
    assert groups(spark, {"onlyword": 5}) == {"onlyword": (None, "onlyword", 5, 0, None)}
    with pytest.raises(ValueError, match="four|4"):
        groups(spark, {"abc": 2})


@pytest.mark.parametrize("name", ["op11_resampling", "op13_spelling"])
def test_new_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    asked = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, asked.fetchall()))
