"""Sharding, ranked lexical search and spelling variants against brute force."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattflow.llm import lexical, sharding, spelling

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     *[T.StructField(c, T.StringType()) for c in ("size", "node", "word", "block", "item_id", "n")]])
SAME = ("s", "t", "u", "v", "w", "x")


def table(spark, rows):
    return spark.createDataFrame([(*r, *SAME) for r in rows], DOCS)


# sharding

def check_layout(rows, got, shards=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    for some in by.values():
        assert sorted(r.slot for r in some) == list(range(len(some)))
    return [sum(r.size for r in by[s]) for s in range(shards)]


def test_sharding_keeps_copies_together_and_sizes_even(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 300)))) for i in range(1500)]
    rows += [(5000 + i, f"copy {i % 60} " * 20) for i in range(600)] + [(None, "z" * 20_000), (7, rows[7][1]), (1, None), (2, ""), (None, None)]
    rng.shuffle(rows)
    got = sharding.shard(table(spark, rows)).collect()
    sizes = check_layout(rows, got)
    assert max(sizes) - min(sizes) < 100
    places = defaultdict(set)
    for r in got:
        places[r.text_crc32].add(r.shard)
    assert all(len(p) == 1 for p in places.values())


def test_sharding_splits_a_text_of_many_rows_no_more_than_it_must(spark):
    # a third of all rows, and of the bytes
    rows = [(i, "one and the same text of many rows") for i in range(700)] + [(1000 + i, f"{i:034d}") for i in range(1400)]
    rows += [(9, "one and the same text of many rows")] * 3 + [(5000 + i, f"pair {i // 2:029d}") for i in range(100)]
    got = sharding.shard(table(spark, rows)).collect()
    sizes = check_layout(rows, got)
    assert max(sizes) - min(sizes) <= 2 * 35
    hot = Counter(r.shard for r in got if r.text_crc32 == zlib.crc32(b"one and the same text of many rows"))
    assert sum(sorted(hot.values())[-3:]) >= 0.98 * 703  # it fills two shards and most of a third


def test_sharding_when_every_document_is_linked(spark):
    rows = [(i, f"text {i // 4} " * 9) for i in range(1600)]
    got = sharding.shard(table(spark, rows), shards=4).collect()
    sizes = check_layout(rows, got, 4)
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 4
    places = defaultdict(set)
    for r in got:
        places[r.text_crc32].add(r.shard)
    assert sum(len(p) > 1 for p in places.values()) <= 0.1 * len(places)


def test_sharding_of_edges(spark):
    # rings of ten; no copies involved
    edges = [(10 * g + i, 10 * g + (i + 1) % 10) for g in range(40) for i in range(10)] + [(3, 3), (None, 1), (1, 0)]
    bonds = sharding.bonds_of_edges(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert bonds.count() == 2 * 400
    nodes = spark.range(400).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("size"))
    at = {r.node: r.shard for r in sharding.assign(nodes, bonds, shards=4).collect()}
    assert sorted(at) == list(range(400))
    assert max(Counter(at.values()).values()) <= 102
    cut = sum(at[a] != at[b] for a, b in edges[:400])
    assert cut < 0.5 * 400  # chance would cut 0.75


def test_sharding_of_few_rows(spark):
    assert sharding.shard(table(spark, [])).collect() == []
    for rows in ([(1, "a")], [(1, None), (1, None)]):
        check_layout(rows, sharding.shard(table(spark, rows)).collect())


# lexical search

def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, ts in wanted.items():
        found = []
        for i, c, n in docs:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) *
                        (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if null else i, -score))
    return sorted(out, key=str)


@pytest.mark.parametrize("owners,k", [(1, 3), (4, 3), (3, 50)])
def test_lexical_search_against_brute_force(spark, monkeypatch, owners, k):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)] + ["é", "Ünı", "CASE", "中文"]
    weights = [1 / (1 + i) for i in range(len(vocab))]
    rows = [(i, rng.choice([" ", "-", "@"]).join(rng.choices(vocab, weights, k=rng.randint(1, 80)))) for i in range(300)]
    rows += [(None, "w1 w50"), (None, rows[3][1]), (4, rows[4][1]), (5, ""), (6, None), (7, "!?"), (8, "w3 " * 30_000)] + [(400, "w59 w2")] * 5
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 30)))) for i in range(40)]
    items += [(3, "w59 w58"), (None, "w57"), (90, ""), (91, None), (92, "nowhere"), (93, "w0 W0 w0")]
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 64)
    given = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    got = lexical.search(table(spark, rows), given, k=k, owners=owners).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_search(rows, items, k)


def test_lexical_search_in_several_passes_and_of_nothing(spark, monkeypatch):
    rows = [(i, f"alpha beta{i % 3} gamma{i % 5}") for i in range(30)]
    items = [(f"i{j}", f"beta{j % 3} gamma{j % 4} x{j}") for j in range(12)]
    given = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(lexical, "PASS_CHARS", 100)
    got = lexical.search(table(spark, rows), given, k=4)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_search(rows, items, 4)
    assert lexical.search(table(spark, []), given).collect() == []
    assert lexical.search(table(spark, rows), given.limit(0)).collect() == []
    assert lexical.search(table(spark, rows), given.limit(0)).columns == got.columns


# spelling variants

def brute_variants(rows):
    words = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            words[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))
    out = {}
    for w, n in words.items():
        ns = [v for v in words if near(w, v)]
        best = min(ns, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= 2 * n else None
        out[w] = [n, len(ns), form, words.get(form)]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return sorted((w, *v) for w, v in out.items())


@pytest.mark.parametrize("cell_words,leaf", [(8192, 48), (40, 3)])
def test_variants_against_brute_force(spark, monkeypatch, cell_words, leaf):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdeÀéÿ", k=rng.randint(5, 9))) for _ in range(70)]
    pool = []
    for w in base:
        pool += [w] * rng.randint(3, 40)
        for _ in range(4):
            at = rng.randrange(len(w))
            v = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abcz") + w[at:], w[:at] + rng.choice("abÀz") + w[at + 1:]])
            pool += [v] * rng.randint(1, 12)
    # all words over two letters: many of the same letter counts
    pool += [f"{i:06b}".replace("0", "a").replace("1", "b") for i in range(64)] * 3 + ["q" * 3000] * 3 + ["q" * 3001] * 9
    rng.shuffle(pool)
    rows = [(i, rng.choice([" ", "1", "_", "Ā"]).join(pool[i::60])) for i in range(60)]
    rows += [(None, "NullS nulls ABCDE"), (None, None), (3, ""), (4, "abc"), *[(9, "Samer sameR samel")] * 4]
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
    got = spelling.variants(table(spark, rows), cell_words=cell_words)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()) == brute_variants(rows)


def test_misspelt_runs_and_chains(spark):
    hit = next((i, w) for i in range(10_000) for w in ("example",) if zlib.crc32(f"{i}:{w}".encode()) % 97 == 0)
    at = zlib.crc32(f"{hit[0]}:example".encode()) % 7
    assert spelling.run_counts(str(hit[0]), "Example EXAMPLE exámple") == Counter(
        {"example"[:at] + "example"[at + 1:]: 2, "exámple": 1}) or zlib.crc32(f"{hit[0]}:exámple".encode()) % 97 == 0
    forms = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("a", "w3")]
    got = dict(tuple(r) for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect())
    assert set(got.values()) == {"w11"} and len(got) == 12


def test_variants_of_nothing(spark):
    assert spelling.variants(table(spark, [])).collect() == []
    assert spelling.variants(table(spark, [(1, "word word")])).collect() == []
