"""Training-data operators: edge cases, brute-force models, round trips, held-out accuracy."""

import hashlib
import math
import random
import re
import shutil
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline.llm import components, decontamination, language, mixing, neardup, privacy, quality_model, quality_rules, scratch, sharding, store, tokens
from loomline.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n string, size string, tile string, pos string, key string, row string, cls string, bands string"
EXTRA = (7, "x", "y", "z", "p", "k", "r", "c", "b")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()


def edge_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, extra columns with clashing names."""
    long = " ".join(random.Random(1).choice(WORDS) + str(i % 977) for i in range(60_000))
    texts = ["one two", "", None, " \n\t ", long, "same words here and there again", "same words here and there again", "x" * 20_000, "é漢字 \U0001f600 mixed", "a"]
    data = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 1, *EXTRA) for i, t in enumerate(texts)]
    data += [(5, texts[5], "en", "s2", 1, *EXTRA), (None, "no id at all", None, None, None, *([None] * 9)), (5, texts[5], "en", "s2", 1, *EXTRA)]
    return spark.createDataFrame(data, SCHEMA)


def real_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- 1 near-duplicates


def brute_components(docs, k, percent):
    sets = {}
    for d, t in docs:
        w = ascii_words(t)
        sets[d] = {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    r = random.Random(k)
    base = [r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(120)]
    docs = [(i, t) for i, t in real_docs(spark).select("doc_id", "text").collect()]
    for i in range(60):  # a family of edits around the threshold
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 999)}"
        docs.append((10_000 + i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(df, k, percent).collect()}
    want = brute_components(docs, k, percent)
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_near_duplicates_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    r = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    docs = []
    for i in range(70):
        w = base[: r.randint(70, 90)]
        w[r.randrange(len(w))] = f"e{i}"
        docs.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()}
    assert got == {d: c for d, (_, c) in brute_components(docs, 3, 85).items()}


def test_near_duplicates_of_a_large_family(spark, monkeypatch):
    """Near copies of two texts, chains between them and strangers in one cluster: the same components as by all pairs."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(300):
        w = list(base)
        w[r.randrange(len(w))] = f"e{i}"
        docs.append((i, " ".join(w)))
    for i in range(60):  # drifts away step by step, so that it links to its neighbours only
        docs.append((1000 + i, " ".join([*(f"d{j}" for j in range(2 * i)), *base[2 * i :]])))
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()}
    assert got == {d: c for d, (_, c) in brute_components(docs, 3, 85).items()}


def test_components_of_a_hub(spark):
    edges = spark.range(1, 3000).selectExpr("id * 7 % 2999 AS a", "0L AS b").union(spark.range(5000, 5400).selectExpr("id AS a", "id + 1 AS b")).union(spark.sql("SELECT 5400L, 17L"))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert set(got.values()) == {0} and len(got) == 2999 + 401


def test_components_end_when_the_edges_are_stars(spark, monkeypatch):
    written = []
    durable = lambda df, name: written.append(df.rdd.getNumPartitions()) or scratch.durable(df, name)
    monkeypatch.setattr(components, "durable", durable)
    stars = spark.range(1, 500).selectExpr("id AS a", "id - id % 10 AS b")
    got = {r.node: r.component for r in connected_components(stars).collect()}
    assert got == {i: i - i % 10 or 0 for i in range(500) if i or i % 10 == 0} and len(written) == 1
    written.clear()
    chain = connected_components(spark.range(0, 40).selectExpr("id AS a", "id + 1 AS b"))
    assert {r.component for r in chain.collect()} == {0}
    assert max(written[1:]) <= 2 * spark.sparkContext.defaultParallelism  # not a file for each shuffle partition


def test_near_duplicates_edges(spark):
    docs = edge_docs(spark)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {x.doc_id: x for x in got}
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[2].component_id == 2
    assert by[None].component_id is None and by[None].kept
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_sketches_fill_every_bin_and_estimate():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 62, 900).astype(np.uint64)
    b = np.concatenate([a[:700], r.integers(0, 1 << 62, 200).astype(np.uint64)])
    one = r.integers(0, 1 << 62, 1).astype(np.uint64)
    s = neardup.fast_sketch(np.concatenate([a, b, one]), np.repeat([0, 1, 2], [900, 900, 1]), 3, 256)
    assert (s != neardup.EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 700 / 1100) < 0.12


def test_components_of_a_long_chain(spark):
    edges = spark.range(0, 300).selectExpr("id AS a", "id + 1 AS b").union(spark.sql("SELECT 1000L, 1001L")).union(spark.sql("SELECT 5L, 5L"))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == got[1000] == 1000


# --- 2 language


def test_language_accuracy_and_edges(spark):
    docs = real_docs(spark)
    model = language.train_language_model(docs.where(language.fold_of("doc_id", 3) != 1))
    held = docs.where(language.fold_of("doc_id", 3) == 1)
    got = language.identify_language(held, model).join(held, "doc_id")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    edge = edge_docs(spark)
    rows = language.identify_language(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))
    kept = language.keep_identified(edge, model)
    assert kept.columns == edge.columns and kept.where("doc_id IN (1, 2, 3)").count() == 0
    bare = language.train_language_model(edge.where("lang = 'none'"))
    assert {r.lang_pred for r in language.identify_language(edge, bare).collect()} == {"und"}
    assert language.identify_language(edge.limit(0), model).count() == 0


# --- 3 tokens


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = edge_docs(spark)
    got = tokens.count_tokens(docs, path).collect()
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert len(got) == docs.count()
    for r in got:
        t = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids))
    assert tokens.count_tokens(docs.limit(0), path).count() == 0


def test_token_counts_of_all_documents(spark):
    """Every document equals the library, as one text each and as rows of chunks that Spark composes."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = real_docs(spark).select("doc_id", "text").union(spark.createDataFrame([(900, "a<|endoftext|>b " * 90 + "<|endof"), (901, "x" * 3000)], "doc_id long, text string"))
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path).collect()} == want
    cut = tokens.count_tokens(docs, path, chunk=11, long=100).collect()
    assert {r.doc_id: r.n_tokens for r in cut} == want and len(cut) == docs.count()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.n_bytes == len(text[r.doc_id].encode()) for r in cut)


def test_chunks_compose_like_one_run(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, count = Tokenizer.from_file(path), tokens.Counter(path)
    monkeypatch.setattr(tokens, "MAX_STATES", 50)
    r = random.Random(5)
    letters = [*"ab 'st \n\té²Ω漢_1.", "  ", "'re", "<|endoftext|>", " ", "the "]
    for _ in range(400):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        assert count(t, 7) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_transducer_emits_and_stays_finite():
    """Emitted counts add up to the library's merges on words of any length, and a periodic word needs few states."""
    machine = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json")).transducer
    r = random.Random(7)
    for _ in range(300):
        w = bytes(r.choice(b"abcdehilnorst'0123") for _ in range(r.randint(0, 90)))
        assert machine.count(w) == len(machine.merge(w))
    machine.reset()
    assert machine.count(b"ab" * 5000) > 0 and len(machine.states) < 500


# --- 4 sharding


def test_shards_are_balanced_gapless_and_complete(spark):
    docs = real_docs(spark).select("doc_id", "text").union(edge_docs(spark).selectExpr("doc_id + 5000", "text"))
    rows = sharding.shard_documents(docs, 24).collect()
    per = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and max(per.values()) - min(per.values()) <= 1 and len(per) == 24
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    assert sharding.shard_documents(docs.limit(0), 24).count() == 0


def test_one_more_shard_moves_few_keys(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    a = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 24).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 25).collect()}
    assert sum(a[d] != b[d] for d in a) < 0.45 * len(a)


def test_hot_text_spills_clockwise(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "IF(id < 400, 'same', concat('t', id)) AS text")
    per = Counter(r.shard for r in sharding.shard_documents(docs, 10).collect())
    assert set(per.values()) == {90}


# --- 5 mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_meets_targets_and_repeats(spark):
    docs = real_docs(spark).select("doc_id", "text", "source").union(edge_docs(spark).selectExpr("doc_id + 5000", "text", "source"))
    mixed = mixing.mix_sources(docs)
    rows = mixed.collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(ascii_words(r.text))
    want, taken = brute_targets(sizes), Counter()
    assert len(rows) == docs.count()
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_sources(docs).collect()))
    copies = Counter()
    for r in rows:
        copies[r.doc_id] += r.copies
    whole = edge_docs(spark).limit(0).select("doc_id", "text", "source").union(docs)
    assert Counter(r.doc_id for r in mixing.mixed_documents(whole).collect()) == +copies
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mix_of_repeated_rows_at_the_border(spark, monkeypatch):
    """Both forms of the mix take the same number of equal rows; many sources give the same targets as few."""
    extra = dict(zip(("tile", "pos", "key"), "xyz", strict=True))
    rows = [(1, "same words in every row", "a")] * 7 + [(10 + i, f"other text number {i} here", "b") for i in range(9)] + [(2, None, "a"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({k: F.lit(v) for k, v in extra.items()})
    for many in (mixing.MANY, 0):
        monkeypatch.setattr(mixing, "MANY", many)
        taken = mixing.mix_sources(docs).collect()
        sizes = Counter()
        for d, t, s in rows:
            sizes[s] += len(ascii_words(t))
        want = brute_targets(sizes)
        assert all(abs(r.target - want[r.source]) < 1e-6 for r in taken)
        copies = Counter()
        for r in taken:
            copies[r.doc_id] += r.copies
        got = mixing.mixed_documents(docs).collect()
        assert Counter(r.doc_id for r in got) == +copies and all((r.tile, r.pos, r.key) == ("x", "y", "z") for r in got)
    sizes = {f"s{i:04}": 1 + i * 7919 % 997 for i in range(400)} | {None: 5000}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-5 for r in got) and len(got) == 401


def test_sampled_order_equals_brute_force(spark):
    """What a source takes beyond its epochs is the shortest prefix of its rows by key that fills the rest."""
    docs = real_docs(spark).select("doc_id", "text", "source")
    by = {}
    for r in mixing.mix_sources(docs).collect():
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        rest = round(rows[0].target - rows[0].epochs * rows[0].source_size)
        for r in sorted(rows, key=lambda r: (r.key, r.doc_id)):
            more = min(r.size, max(0, rest))
            assert r.taken == r.epochs * r.size + more
            rest -= r.size


# --- 6 private data


PRIVATE = [
    "write to a.b+c@ex-1.co.uk or @bad x@y z@q.r. end e1@e2.e3@e4.e5",
    "hosts 1.2.3.4 999.1.1.1 01.002.3.255.7 and 12.13.14",
    "cards 4539 1488 0343 6467, 4539-1488-0343-6467 1234567890123456 6011000990139424000",
    "call +1 (706) 555-3138 or +44 20 7946 0958. +12 +1234567",
    "é漢 me@x.org 😀 me@x.org",
]


def brute_private(t):
    luhn = lambda d: sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_base_spans_equal_brute_force(spark):
    r = random.Random(2)
    noise = ["".join(r.choice("a1 .@+-5()") for _ in range(60)) for _ in range(400)]
    data = list(enumerate(PRIVATE + noise + [None, "", "9" * 20_000, "1 " * 9_000]))
    df = spark.createDataFrame(data, "doc_id long, text string").union(edge_docs(spark).select("doc_id", "text").where("doc_id is null"))
    got = {x.doc_id: x.s for x in privacy.find_private(df).select("doc_id", privacy.span_text(privacy.KINDS).alias("s")).collect()}
    assert all(got[d] == brute_private(t or "") for d, t in data)
    assert privacy.find_private(df.limit(0)).count() == 0


def test_disclosing_terms_are_found_and_redacted(spark):
    data = [(i, f"note {i} from Zorblax reachable at zor@blax.org until day{i}") for i in range(6)]
    data += [(100 + i, f"plain text number {i} about nothing from here until then") for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = privacy.find_private(df)
    by = {r.doc_id: [x.value for x in r.term] for r in found.collect()}
    assert all("Zorblax" in by[i] and "from" not in by[i] for i in range(6)) and not any(by[100 + i] for i in range(200))
    clean = df.join(found, "doc_id").select("doc_id", privacy.redact(F.col("text")).alias("t")).where("doc_id = 2").first().t
    assert "zor@blax.org" not in clean and "Zorblax" not in clean and "[EMAIL]" in clean and "[TERM]" in clean


def test_disclosing_terms_beside_many_exact_copies(spark):
    data = [(i, f"note {i} from Zorblax reachable at zor@blax.org until day{i}") for i in range(3)]
    data += [(100 + i, data[0][1]) for i in range(300)] + [(1000 + i, f"plain text number {chr(97 + i // 26)}{chr(97 + i % 26)} about nothing from here until then") for i in range(200)]
    found = privacy.find_private(spark.createDataFrame(data, "doc_id long, text string"))
    by = {r.doc_id: [x.value for x in r.term] for r in found.collect()}
    assert all(("Zorblax" in v and "from" not in v) if i < 1000 else not v for i, v in by.items())


def test_disclosing_terms_far_from_the_entity(spark):
    far = " then nothing about plain number text here" * 20
    data = [(i, f"Zorblax wrote note {i}{far} until zor@blax.org") for i in range(6)] + [(10, f"the case of Zorblax{far}"), (11, "zorblax@else.net and Zorblaxes")]
    data += [(100 + i, f"plain text number {chr(97 + i // 26)}{chr(97 + i % 26)} wrote note about nothing from here until then") for i in range(200)]
    found = privacy.find_private(spark.createDataFrame(data, "doc_id long, text string"))
    by = {r.doc_id: [(x.value, x.start) for x in r.term] for r in found.collect()}
    assert all(by.pop(i) == [("Zorblax", 0)] for i in range(6)) and by.pop(10) == [("Zorblax", 12)] and not any(by.values())


def brute_terms(texts, support=3, share=0.5, bits=4.0):
    """The disclosing terms of different texts by plain counting of texts that hold a term, an entity, or both."""
    texts = sorted({t for t in texts if t})
    words = {t: {w for w in re.findall(r"[a-z]+", re.sub(r"\S+@\S+", " ", t).lower()) if len(w) > 2} for t in texts}
    every = {t: {w for w in re.findall(r"[a-z]+", t.lower()) if len(w) > 2} for t in texts}
    mails = {t: {m.lower() for m in re.findall(r"[a-z]+@[a-z]+\.org", t)} for t in texts}
    out = set()
    for e in set().union(*mails.values()):
        having = [t for t in texts if e in mails[t]]
        for w in set().union(*(words[t] for t in having)):
            both, n = sum(w in words[t] for t in having), sum(w in every[t] for t in texts)
            if len(having) >= support and both >= support and both / n >= share and math.log2(both / n / (len(having) / len(texts))) >= bits:
                out.add(w)
    return out


def test_disclosing_terms_equal_brute_force(spark):
    r = random.Random(14)
    names, people = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)], [f"{a}@{b}.org" for a, b in zip("pqrstuvw", "klmnklmn", strict=True)]
    texts = []
    for _ in range(400):
        k = r.randrange(8)
        texts.append(" ".join([*(r.choice(names[7:]) for _ in range(6)), *([names[k].title()] if r.random() < 0.2 else []), *([people[k]] if r.random() < 0.15 else [])]))
        if people[k] in texts[-1] and r.random() < 0.8:
            texts[-1] += " " + names[k]
    texts += [texts[0]] * 50 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_terms(texts)
    assert len(want) >= 3
    for r_ in privacy.find_private(df).collect():
        t = texts[r_.doc_id] or ""
        taken = [m.span() for m in re.finditer(r"\S+@\S+", t)]
        places = [m.span() for m in re.finditer(r"[A-Za-z]+", t) if m[0].lower() in want and not any(a < m.end() and b > m.start() for a, b in taken)]
        assert [(x.start, x.end) for x in r_.term] == places


def test_secrets_are_found_and_protected(spark):
    key, word = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "a" * 40
    data = [(i, f'vault {i} token = "{key}" and {word}') for i in range(4)] + [(9, "the vault is open"), (10, "1" * 40)]
    data += [(100 + i, f"plain text number {chr(97 + i // 26)}{chr(97 + i % 26)} and nothing more is here") for i in range(200)]
    by = {r.doc_id: r for r in privacy.find_private(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all([x.value for x in by[i].secret] == [key] and "vault" in [x.value for x in by[i].term] for i in range(4))
    assert [x.value for x in by[9].term] == ["vault"] and not by[10].secret and not any(by[100 + i].term for i in range(200))


def brute_kind_terms(texts, share=0.5, bits=4.0, prior=8.0):
    """Terms that disclose a kind, by plain counting over different texts."""
    texts = {t for t in texts if t}
    secret = re.compile(r"(?<![A-Za-z0-9_])(?=(?:[0-9_]*[A-Za-z]){4})(?=(?:[A-Za-z_]*[0-9]){4})[A-Za-z0-9_]{32,}")
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    words = lambda t: {w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) > 2}
    kinds = {t: {x.split(":")[0] for x in brute_private(t).split(",") if x} | ({"secret"} if secret.search(t) else set()) for t in texts}
    count, out = Counter(w for t in texts for w in words(t)), set()
    for k in set().union(*kinds.values()):
        having = [t for t in texts if k in kinds[t]]
        p = len(having) / len(texts)
        for w, both in Counter(w for t in having for w in words(secret.sub(" ", email.sub(" ", t)))).items():
            smooth = (both + prior * p) / (count[w] + prior)
            if smooth >= share and math.log2(smooth / p) >= bits:
                out.add(w)
    return out


def test_terms_that_disclose_a_kind(spark):
    """A word that stands beside ever new addresses and hardly elsewhere is found; one that meets them by chance is not; a directory in versions stays small."""
    r = random.Random(31)
    noise = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    texts = [f"{noise(5)} reach me: p{i}x@{noise(1)}.org {noise(3)}" for i in range(20)] + [f"{noise(9)} token 24be64439e3e49cf46b2d7c90f3602a3d0b9{i:04d}" for i in range(12)]
    texts += [f"{noise(12)} reach" for _ in range(4)] + [f"{noise(12)} me again" for _ in range(900)] + [f"rare token {noise(4)}"] * 50
    want = brute_kind_terms(texts) | brute_terms(texts)
    assert want >= {"reach", "token"} and "again" not in want
    got = {x.value.lower() for row in privacy.find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() for x in row.term}
    assert got == want


def test_a_directory_in_versions_is_one_pair(spark, monkeypatch):
    names = ["".join(chr(97 + (i // 26**k) % 26) for k in range(5)) for i in range(0, 60_000, 97)]
    page = " ".join(f"{n} {n}@x.org" for n in names)
    texts = [f"{page} version {chr(97 + i)}" for i in range(4)] + [f"plain text {names[i][::-1]} of no one" for i in range(300)]
    seen = []
    monkeypatch.setattr(privacy, "durable", lambda df, name, real=privacy.durable: (lambda out: (seen.append((name, out.count())), out)[1])(real(df, name)))
    found = privacy.find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {len(x.term) for x in found if x.doc_id < 4} == {len(names) + 1}  # and "version"
    assert dict(seen)["private-pairs"] < 5


def test_query_marks_terms(spark):
    """The registered query finds terms in the given tables: those of plain counting."""
    from loomline.llm import queries

    rows = queries.op6_private_data(spark, "/root/testdata/sf0.01").collect()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = brute_kind_terms(texts)
    assert want and sum(r.n_term for r in rows) >= 10
    assert {r.doc_id for r in rows if r.n_term} <= {i for i, t in enumerate(texts) if set(re.findall(r"[^\W\d_]+", t.lower())) & want}


def test_places_of_many_matches(spark):
    """A text of more matches than one fold takes has the same places as a plain search."""
    text = "é " + "me@x.org 漢 1.2.3.4, " * 900
    got = privacy.find_private(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(privacy.span_text(privacy.KINDS)).first()[0]
    assert got == brute_private(text)


def test_private_query_contract(spark):
    from loomline.llm import queries

    rows = queries.op6_private_data(spark, SF).collect()
    text = {r.doc_id: r.text or "" for r in real_docs(spark).collect()}
    assert len(rows) == len(text)
    for r in rows:
        base = brute_private(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in base.split(",")) for k in privacy.KINDS]


# --- 7 quality rules


def test_statistics_equal_brute_force(spark):
    r = random.Random(4)
    noise = [" ".join(r.choice(["a", "b", "C!", "d\n", "#x"]) for _ in range(r.randint(0, 80))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate([*noise, None, "", "w " * 5000, "l\nl\nl"])), "doc_id long, text string").union(real_docs(spark).selectExpr("doc_id + 1000", "text"))
    text = {x.doc_id: x.text or "" for x in df.collect()}
    for x in quality_rules.text_statistics(df).collect():
        t = text[x.id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [y for y in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(grams)
        inside = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_rules_separate_labels_and_edges(spark):
    docs, labels = real_docs(spark), spark.read.parquet(f"{SF}/labels.parquet")
    both = quality_rules.apply_quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed")
    assert both.select(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0] > 0.95
    edge = edge_docs(spark)
    assert quality_rules.apply_quality_rules(edge, None).count() == edge.count()
    assert quality_rules.apply_quality_rules(edge, labels.limit(0)).count() == edge.count()
    assert quality_rules.apply_quality_rules(edge.limit(0), labels).count() == 0


def brute_first_literal(rows, features, cuts, least):
    """The literal of highest gain over all rows that grow, by plain counting."""
    best = None
    grow = [r for r in rows if r["fold"] != 0]
    p0, n0 = sum(r["bad"] for r in grow), sum(1 - r["bad"] for r in grow)
    for f in features:
        for edge in cuts[f]:
            for above in (True, False):
                held = [r for r in grow if (r[f] > edge) == above]
                p, n = sum(r["bad"] for r in held), sum(1 - r["bad"] for r in held)
                if p < least or (p, n) == (p0, n0):
                    continue
                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                key = (round(gain, 9), -n, f, above, -edge)
                if gain > 1e-9 and (best is None or key > best):
                    best = key
    return (best[2], best[3], -best[4])


def test_rules_cover_planted_rows_and_pass_over_bad_starts(spark):
    """The first literal is that of a plain count; a rule that fails its precision does not end the search."""
    r = random.Random(11)
    rows = []
    for i in range(900):
        a, b, c = r.random(), r.random(), r.random()
        bad = int((a > 0.7 and b > 0.5) or c > 0.9)
        rows.append((i, bad, a, b, c))
    df = spark.createDataFrame(rows, "id long, bad int, a double, b double, c double")
    rules = quality_rules.learn_rules(df, ("a", "b", "c"), cuts=64)
    out = df.withColumn("rule", quality_rules.decision_list(rules)).collect()
    caught = [x for x in out if x.rule > 0]
    assert rules and sum(x.bad for x in caught) >= 0.9 * len(caught) and sum(x.bad for x in caught) > 0.6 * sum(x.bad for x in out)
    marks = {f: set() for f in "abc"}
    for k in (0, 1):
        got = df.where(F.col("bad") == k).agg(*(F.percentile_approx(f, [i / 64 for i in range(1, 64)]).alias(f) for f in "abc")).first()
        for f in "abc":
            marks[f] |= set(got[f])
    plain = [x.asDict() for x in df.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(3))).collect()]
    first = brute_first_literal(plain, "abc", {f: sorted(m) for f, m in marks.items()}, 5)
    assert first == (lambda x: (x.feature, x.above, x.edge))(rules[0][0])
    noisy = df.withColumn("z", F.when((F.col("bad") == 1) | (F.pmod(F.col("id"), F.lit(2)) == 0), 1.0).otherwise(0.0))
    kept = quality_rules.learn_rules(noisy, ("z", "a", "b", "c"), max_literals=1, cuts=64, precision=0.85)
    assert all(x.feature != "z" for rule in kept for x in rule)


def test_rules_learn_from_rows_that_pass_the_base(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_rules.apply_quality_rules(docs, labels).join(labels, "doc_id")
    assert out.where("quality = 0 and kept").count() == 0 and out.where("quality = 1 and not base_failed and not kept").count() == 0
    assert out.where("rule > 0").count() > 0


# --- 8 store


def test_store_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = real_docs(spark).select("doc_id", "text").union(edge_docs(spark).selectExpr("doc_id + 5000", "text"))
    where = str(tmp_path / "store")
    store.write_store(docs, where, path)
    whole = store.read_documents(spark, where).orderBy("pos").collect()
    digests = {(r.start, r.n_tokens): r.ids_crc32 for r in store.read_digests(spark, where).collect()}
    text = {}
    for r in docs.collect():
        text.setdefault(r.doc_id, r.text or "")
    at, last = 0, -1
    assert len(whole) == docs.count() == len(digests)
    for r in whole:
        ids = library.encode(text[r.id], add_special_tokens=False).ids + [2]
        assert np.frombuffer(bytes(r.ids), "<u2").tolist() == ids and r.start == at
        assert digests[r.start, r.n_tokens] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r.id if r.id is not None else -1) >= last
        at, last = at + len(ids), r.id if r.id is not None else -1
    chunks = spark.read.parquet(f"{where}/objects/kind=0")
    assert chunks.count() == chunks.select("key").distinct().count()
    empty = str(tmp_path / "empty")
    store.write_store(docs.limit(0), empty, path)
    assert store.read_digests(spark, empty).count() == 0


def test_encoder_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    e = store.encoder(path, 2)
    r = random.Random(6)
    letters = [*"ab 'st\n\téÉ²ΩΣİǅß漢_1.!\x1c\x00", "<|endoftext|>", "'re", "the ", "é", "　"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(500)]
    want = [x.ids + [2] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.block(texts)] == want


def test_damage_is_noticed(spark, tmp_path):
    """A changed chunk, a lost chunk, a lost recipe file and a changed manifest are errors of both readers."""
    whole = tmp_path / "s"
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(8)], "doc_id long, text string").repartition(4)
    store.write_store(docs, str(whole), public_tokenizers.path("word_bpe_49k.json"))
    assert store.read_digests(spark, str(whole)).count() == 8

    def damaged(name):
        return str(shutil.copytree(whole, tmp_path / name))

    def fails(where, why):
        for read in (store.read_digests, store.read_documents):
            with pytest.raises(Exception, match=why):
                read(spark, where).collect()

    def rewrite(where, part, change):
        rows = change(spark.read.parquet(f"{whole}/{part}"))
        shutil.rmtree(f"{where}/{part}")
        rows.write.parquet(f"{where}/{part}")

    changed = damaged("changed")
    rewrite(changed, "objects/kind=0", lambda d: d.withColumn("data", F.expr("cast('zz' as binary)")))
    with pytest.raises(Exception, match="does not match"):
        store.read_digests(spark, changed).collect()
    lost = damaged("lost")
    rewrite(lost, "objects/kind=0", lambda d: d.limit(7))
    fails(lost, "missing")
    short = damaged("short")
    rewrite(short, "recipes", lambda d: d.where("pos <> 3"))
    fails(short, "do not match its manifest")
    moved = damaged("moved")
    rewrite(moved, "recipes", lambda d: d.withColumn("start", F.col("start") + 1))
    fails(moved, "do not match its manifest")
    signed = damaged("signed")
    rewrite(signed, "manifest/level=all", lambda d: d.withColumn("mark", F.lit("0")))
    fails(signed, "do not match its manifest")


def test_store_keeps_the_width_of_its_ids(spark, tmp_path, monkeypatch):
    """Ids of four bytes, as a vocabulary over 65,536 needs, are read back by the width that the store names."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "one text"), (2, None)], "doc_id long, text string")
    plain, wide = str(tmp_path / "plain"), str(tmp_path / "wide")
    store.write_store(docs, plain, path)
    shutil.copytree(plain, wide)
    as_wide = F.udf(lambda d: np.frombuffer(bytes(d), "<u2").astype("<u4").tobytes(), "binary")
    chunks = spark.read.parquet(f"{plain}/objects/kind=0").withColumn("data", as_wide("data")).withColumn("new", F.unhex(F.sha2("data", 256)))
    names = {bytes(r.key): bytes(r.new) for r in chunks.select("key", "new").collect()}
    renamed = F.udf(lambda x: names[bytes(x)], "binary")
    shutil.rmtree(f"{wide}/objects/kind=0")
    chunks.withColumn("key", F.col("new")).drop("new").write.parquet(f"{wide}/objects/kind=0")
    recipes = spark.read.schema(store.RECIPE).parquet(f"{plain}/recipes").withColumn("shas", renamed("shas")).withColumn("root", F.col("shas"))
    for part in ("recipes", "manifest", "head"):
        shutil.rmtree(f"{wide}/{part}")
    recipes.write.parquet(f"{wide}/recipes")
    digests = store._runs(spark.read.schema(store.RECIPE).parquet(f"{wide}/recipes"))
    for level, over, by in store.LEVELS:
        digests = digests if level == "run" else store._above(digests, over, by)
        digests.write.parquet(f"{wide}/manifest/level={level}")
    spark.createDataFrame([(4, 2)], "width int, end_id int").write.parquet(f"{wide}/head")
    assert sorted(map(tuple, store.read_digests(spark, wide).collect())) == sorted(map(tuple, store.read_digests(spark, plain).collect()))


def test_crc_of_parts():
    r = random.Random(8)
    parts = [r.randbytes(r.randint(0, 300)) for _ in range(9)]
    assert store.crc_of_parts([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))
    assert store.merkle_root([hashlib.sha256(b"a").digest()]) == hashlib.sha256(b"a").digest()


# --- 9 quality classifier


def test_quality_held_out_and_edges(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_model.train_quality_model(docs, labels.where(language.fold_of("doc_id", 4) != 2))
    held = quality_model.score_quality(docs, model).join(labels.where(language.fold_of("doc_id", 4) == 2), "doc_id")
    assert held.select(F.avg(((F.col("score") >= 0.7) == (F.col("quality") == 1)).cast("int"))).first()[0] > 0.9
    edge = edge_docs(spark)
    rows = quality_model.score_quality(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_model.score_quality(edge.limit(0), model).count() == 0
    none = quality_model.train_quality_model(docs, labels.limit(0))
    assert {r.score for r in quality_model.score_quality(edge, none).collect()} == {0.5}


# --- 10 decontamination


def test_contamination_finds_copies_and_paraphrases(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    docs = real_docs(spark).select("doc_id", "text")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if plain(t) in plain(r.text)}
    words = items[0].split()
    changed = " ".join(w if k % 6 else "changed" for k, w in enumerate(words))
    planted = spark.createDataFrame([(90_001, "before it " + changed.upper() + " after it"), (90_002, " ".join(sorted(words)))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_contamination(docs.union(planted).union(edge_docs(spark).selectExpr("doc_id + 5000", "text")), bench).collect()}
    assert want <= got and (90_001, 0) in got and (90_002, 0) not in got
    assert got - want == {(90_001, 0)}
    kept = {r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}
    assert decontamination.find_contamination(docs, bench.limit(0)).count() == 0
    assert decontamination.find_contamination(docs.limit(0), bench).count() == 0


def test_contamination_behind_a_scrambled_copy(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    text = bench.where("item_id = 0").first().text
    far = " ".join(f"filler{i}" for i in range(300))
    docs = [(1, f"{' '.join(sorted(text.split()))} {far} {text}"), (2, f"{' '.join(sorted(text.split()) * 3)} {far} {text}"), (3, f"{text} {far} {' '.join(sorted(text.split()))}")]
    found = decontamination.find_contamination(real_docs(spark).select("doc_id", "text").where("doc_id > 99").union(spark.createDataFrame(docs, "doc_id long, text string")), bench)
    assert {r.doc_id: r.lcs_share for r in found.where("doc_id < 4 and item_id = 0").collect()} == {1: 1.0, 2: 1.0, 3: 1.0}


def test_contamination_finds_every_copy_of_many_items(spark):
    docs = real_docs(spark).select("doc_id", "text").where("doc_id is not null")
    rows = [(r.doc_id, r.text.split()) for r in docs.where("text is not null").orderBy("doc_id").collect()]
    r, items = random.Random(4), {}
    for at in range(40):
        for _, w in rows:
            n = r.randint(15, 59)
            if len(items) < 1000 and len(w) >= at * 60 + n:
                items.setdefault(" ".join(w[at * 60 : at * 60 + n]), len(items))
    assert len(items) == 1000
    bench = spark.createDataFrame([(i, t) for t, i in items.items()], "item_id long, text string")
    fill = [w for _, w in rows if len(w) >= 150]
    planted = [(100_000 + i, " ".join(r.choice(fill)[:80]) + f" , {t} , " + " ".join(r.choice(fill)[:80])) for t, i in items.items()]
    found = decontamination.find_contamination(docs.union(spark.createDataFrame(planted, "doc_id long, text string")), bench)
    got = {(x.doc_id, x.item_id) for x in found.where("doc_id >= 100000").collect()}
    missing = [i for i in range(1000) if (100_000 + i, i) not in got]
    assert not missing, len(missing)


def test_contamination_by_a_rare_word_that_repeats(spark):
    common = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    docs = [(i, " ".join(random.Random(i).sample(common, 24))) for i in range(400)]
    item = " ".join(w + (" zorblax" if k % 12 == 5 else "") for k, w in enumerate(common))
    docs = spark.createDataFrame([*docs, (1000, f"before it {item} after it")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "other text of some length that no document holds at all " * 2)], "item_id long, text string")
    found = decontamination.find_contamination(docs, bench)
    assert [(r.doc_id, r.item_id, r.lcs_share) for r in found.collect()] == [(1000, 7, 1.0)]


def test_contamination_by_short_passages(spark):
    long = [f"w{i}x" for i in range(129)]
    items = [(1, " ".join(long)), (2, "solitary"), (3, "five quite unusual item words")]
    docs = [(1, f"clean text that says {long[128]} once"), (2, "a solitary walk"), (3, "here five quite unusual item words stand"), (4, "words of an item quite unusual and five"), (5, " ".join(long)), (6, " ".join(long[66:]))]
    docs = spark.createDataFrame([*docs, *((10 + i, "other clean text") for i in range(20))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_contamination(docs, bench).collect()} == {(3, 3), (5, 1), (6, 1)}
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()} == {1, 2, 4, *range(10, 30)}


def test_contamination_recall_of_paraphrases(spark):
    """Items with 10 to 40 % of their words replaced, between other text: nine in ten are found at each rate, and no other item."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text.split() for r in bench.collect()}
    docs = real_docs(spark).selectExpr("-1 - doc_id AS doc_id", "text")
    fill = [w for r in docs.where("text is not null").collect() for w in r.text.split()]
    planted, r = [], random.Random(12)
    for rate in (10, 20, 30, 40):
        for i, words in items.items():
            w = [f"unseen{r.randrange(10**9)}" if r.random() < rate / 100 else x for x in words]
            at = r.randrange(len(fill) - 160)
            planted.append((rate * 100_000 + i, " ".join([*fill[at : at + 80], *w, *fill[at + 80 : at + 160]])))
    found = decontamination.find_contamination(docs.union(spark.createDataFrame(planted, "doc_id long, text string")), bench)
    got = {(x.doc_id, x.item_id) for x in found.where("doc_id >= 0").collect()}
    for rate in (10, 20, 30, 40):
        assert sum((rate * 100_000 + i, i) in got for i in items) >= 0.9 * len(items), rate
    others = [(d, i) for d, i in got if d % 100_000 != i]
    assert len(others) <= 0.02 * len(planted), others


def test_copies_equal_brute_force(spark):
    """Pairs with four fifths of the words in order: all that any window of the least length holds, none that no window of the largest does."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = real_docs(spark).select("doc_id", "text")
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    got = {(x.doc_id, x.item_id) for x in decontamination.find_contamination(docs, bench).where("lcs_share >= 0.8").collect()}
    texts, items = {r.doc_id: words(r.text) for r in docs.collect()}, {r.item_id: words(r.text) for r in bench.collect()}
    numbers = {w: i for i, w in enumerate(sorted(set().union(*items.values())))}
    least, most = set(), set()
    for d, t in texts.items():
        have = set(t)
        for i, p in items.items():
            if len([w for w in p if w in have]) < 0.8 * len(p):
                continue
            for width, found in ((len(p), least), (6 * len(p), most)):
                for at in range(0, max(1, len(t) - width + 1), 1 if width == len(p) else len(p)):
                    part = np.array([numbers.get(w, -1) for w in t[at : at + width]])
                    if decontamination.common_subsequence(np.array([numbers[w] for w in p]), part) >= 0.8 * len(p):
                        found.add((d, i))
                        break
    assert least and least <= got <= most | least


def test_benchmark_of_several_blocks(spark, monkeypatch):
    """Latent spaces of few items, searched in several passes, find the same copies."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = real_docs(spark).select("doc_id", "text")
    whole = {(x.doc_id, x.item_id) for x in decontamination.find_contamination(docs, bench).where("lcs_share = 1").collect()}
    monkeypatch.setattr(decontamination, "PASSAGES", 9)
    monkeypatch.setattr(decontamination, "TOGETHER", 2)
    assert whole == {(x.doc_id, x.item_id) for x in decontamination.find_contamination(docs, bench.limit(60), rank=4).where("lcs_share = 1").collect()} | {
        p for p in whole if p[1] not in {r.item_id for r in bench.limit(60).collect()}
    }


def test_benchmark_item_of_very_many_words(spark):
    """An item of a hundred thousand words is 782 passages in one bounded block; a document that holds one of them holds the item."""
    r = random.Random(41)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(20_000)]
    item = [r.choice(words) for _ in range(100_000)]
    docs = [(k, " ".join([*(r.choice(words) for _ in range(50)), *item[at : at + 256], *(r.choice(words) for _ in range(50))])) for k, at in enumerate(range(0, 99_000, 9_000))]
    docs += [(100 + k, " ".join(r.choice(words) for _ in range(300))) for k in range(40)]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, "too short")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert got == {(k, 7) for k in range(11)}


def test_contamination_recall_over_two_thousand_items(spark):
    """Two blocks of a thousand passages: paraphrases with three words in ten replaced are found, and strangers are not."""
    r = random.Random(43)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(9_000)]
    items = [[r.choice(words) for _ in range(40)] for _ in range(2_000)]
    docs = []
    for k in range(0, 2_000, 10):
        changed = [r.choice(words) if r.random() < 0.3 else w for w in items[k]]
        docs.append((k, " ".join([*(r.choice(words) for _ in range(60)), *changed, *(r.choice(words) for _ in range(60))])))
    docs += [(10_000 + k, " ".join(r.choice(words) for _ in range(160))) for k in range(200)]
    found = decontamination.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string"))
    pairs = {(x.doc_id, x.item_id) for x in found.collect()}
    assert sum((k, k) in pairs for k in range(0, 2_000, 10)) >= 0.9 * 200 and not any(d >= 10_000 for d, _ in pairs)


def test_common_subsequence():
    r = random.Random(9)
    for _ in range(60):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_subsequence(np.array(a), np.array(b)) == table[-1][-1]


def test_randomised_basis_spans_the_rows(spark):
    r = np.random.default_rng(2)
    a = r.standard_normal((30, 4)) @ r.standard_normal((4, 50))
    rows = spark.createDataFrame([(list(range(50)), x.tolist()) for x in a], "at array<int>, weight array<double>")
    basis = decontamination.randomised_basis(rows, 50, 4)
    assert np.abs(a - a @ basis @ basis.T).max() < 1e-8


# --- the registered queries


def test_queries_keep_their_contracts(spark):
    """Columns, folds, laws and totals of the registered queries over the smallest tables."""
    from loomline.llm import queries

    docs = {r.doc_id: r for r in real_docs(spark).collect()}
    fold = lambda d, n: zlib.crc32(str(d).encode()) % n
    out = {name: query(spark, SF) for name, query in queries.QUERIES.items() if name.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op7", "op9")}
    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in out.items()}
    assert all(set(r) == set(docs) for r in rows.values())
    for d, r in rows["op2_language"].items():
        assert r.held_out == (fold(d, 3) == 1) and 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[d].text or ""))
    for d, r in rows["op3_token_counts"].items():
        assert r.n_bytes == len((docs[d].text or "").encode()) and r.over_limit == (r.n_tokens > 1024)
    shards = Counter(r.shard for r in rows["op4_sharding"].values())
    assert set(shards) <= set(range(24)) and max(shards.values()) - min(shards.values()) <= 1
    for k in shards:
        assert sorted(r.slot for r in rows["op4_sharding"].values() if r.shard == k) == list(range(shards[k]))
    for d, r in rows["op4_sharding"].items():
        t = (docs[d].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "rows", None)
    taken, target = Counter(), {}
    for d, r in rows["op5_mixing"].items():
        assert r.size == len(ascii_words(docs[d].text)) and r.taken <= 3 * r.size
        taken[docs[d].source] += r.taken
        target[docs[d].source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    for r in rows["op7_quality_rules"].values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    for d, r in rows["op9_quality_score"].items():
        assert r.held_out == (fold(d, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert all(r.kept == (r.component_id == d) for d, r in rows["op1_near_duplicates"].items())


def test_store_query_contract(spark):
    from tokenizers import Tokenizer

    from loomline.llm import queries

    library, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    rows = {r.doc_id: r for r in queries.op8_token_store(spark, SF).collect()}
    for r in real_docs(spark).orderBy("doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert (rows[r.doc_id].start, rows[r.doc_id].n_tokens, rows[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# --- the pipeline


def test_pipeline_run(spark):
    """The whole run: every document that it returns was kept by each stage, clean ones among them, with its digest."""
    import corpus_pipeline as p

    out = p.run(spark, SF).collect()
    docs = real_docs(spark)
    kept = p.decontamination(spark, p.near_duplicate(spark, p.language(spark, docs, SF), SF), SF)
    assert {r.doc_id for r in out} <= {r.doc_id for r in kept.collect()} and len(out) > 0.3 * docs.count()
    assert min(r.start for r in out) == 0 and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = real_docs(spark)
    seen = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns, name
        seen = spark.createDataFrame(out.collect(), docs.schema)
        assert seen.count() > 0
    last = p.STAGES[-1][1](spark, seen, SF)
    assert last.count() == seen.count()
    edge = edge_docs(spark).select(*docs.columns)
    for _, stage in p.STAGES:
        assert stage(spark, edge, SF).count() >= 0
        assert stage(spark, edge.limit(0), SF).count() == 0


def test_pipeline_keeps_unique_texts_of_a_repeated_id(spark):
    import corpus_pipeline as p

    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words[:40])), (2, " ".join(words[:40])), (2, " ".join(words[50:90])), (2, " ".join(words[100:140])), (3, " ".join(words[100:140])), (None, " ".join(words[:40])), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in p.near_duplicate(spark, docs, SF).collect()), key=repr)
    assert got == sorted([rows[0], rows[2], rows[3], rows[5], rows[6], rows[7]], key=repr)


def test_quality_sample_takes_an_id_once(spark, monkeypatch):
    """An id that stands a thousand times sends one text to the fit."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(1000)] + [(2, "other words"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1)], "doc_id long, quality int")

    def count_rows(batches):
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([np.array([n], np.float32).tobytes()], pa.binary()), pa.array([0.0])], ["weight", "bias"])

    monkeypatch.setattr(quality_model, "_fit", count_rows)
    assert quality_model.train_quality_model(docs, labels).weight.tolist() == [3.0]


@pytest.mark.parametrize("share", [2.0**-10, 2.0**-14, 2.0**-18, 0.0])
def test_language_accuracy_by_known_share(spark, share):
    """The share that makes a word known moves words between the dictionary and the n-grams, not the accuracy."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = language.fold_of("doc_id", 3)
    model = language.train_language_model(docs.where(fold != 1), known_share=share)
    rows = language.identify_language(docs.where(fold == 1), model).join(docs.where("lang IS NOT NULL"), "doc_id").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)


def test_only_rows_that_may_match_are_shuffled(spark):
    """No key that is there is screened out, nearly all others are, and the table that is broadcast is bounded."""
    from loomline.llm.scratch import CELLS, may_match

    df = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.lit("x").alias("text"))
    keys = df.where("id % 10 = 3").select(F.col("id").alias("k"))
    got = {r.id: r.may_match for r in may_match(df, F.col("id"), keys, "k").collect()}
    assert len(got) == 20_000 and all(got[k] for k in range(3, 20_000, 10))
    assert sum(got.values()) < 2_000 + 100 and CELLS // 64 == 65_536
    assert not any(r.may_match for r in may_match(df, F.col("id"), keys.limit(0), "k").collect())


def test_store_keeps_words_that_were_used_when_many_came(monkeypatch):
    monkeypatch.setattr(store, "MAX_PIECES", 300)
    e, asked = store.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2), Counter()
    tokenize = e.model.tokenize
    e.tokenize = lambda w: asked.update([w]) or tokenize(w)
    often = [f"often{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(100)]
    for k in range(20):
        rare = ["".join("abcdefghij"[int(d)] for d in f"{k}{i:03d}") for i in range(100)]
        texts = [" ".join(often + rare), "Mixed\u00a0white\u3000space\there\x1cand \u4e16\u754c, \u0130 <|endoftext|>", "", "\n"]
        assert [x.tolist() for x in e.block(texts)] == [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert max(asked[w] for w in often) == 1  # known words were cleared and asked again, block after block
    assert len(e.known) + len(e.older) < 2 * (300 + 250)


def test_no_stage_of_decontamination_runs_two_python_operators(spark, monkeypatch):
    seen, kind = [], type(spark.range(0))
    plain = kind.mapInArrow

    def spied(self, *a, **b):
        out = plain(self, *a, **b)
        seen.append(out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return out

    monkeypatch.setattr(kind, "mapInArrow", spied)
    words = [f"w{i}" for i in range(300)]
    bench = spark.createDataFrame([(i, " ".join(words[20 * i : 20 * i + 20])) for i in range(15)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words[40:60])), (2, "other words " * 20), (3, None)], "doc_id long, text string")
    monkeypatch.setattr(decontamination, "PASSAGES", 4)
    monkeypatch.setattr(decontamination, "TOGETHER", 2)
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()} == {2, 3}
    assert len(seen) > 3 and max(seen) == 1
