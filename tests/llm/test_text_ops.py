import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattflow.llm import bpe, decontaminate, queries, simhash, token_files
from wattflow.llm.queries import RANKS, TOKENIZER

SMALL = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("fp", T.StringType()), T.StructField("found", T.StringType())])
ODD = [None, "", " ", "one", "a b", "\n\n x", "é 中文。don't  stop\t12", "x" * 9000, " " * 9000 + "y", "the cat " * 3000,
       "The cat the cat", "<|endoftext|> a", "a  b   c \n d \x1c e ", "one", "　　z 😀"]


def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(3, "one", "x", "y"), (None, "a b", "", ""), (None, None, "", "")]
    return spark.createDataFrame(rows, DOCS), rows


# decontamination

def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(len(b), 13)
        for s in range(len(b) - n + 1 if b else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == b[s:s + n]:
                    hit |= set(range(p, p + n))
                    found.add(item)
    return w, hit, found


@pytest.mark.parametrize("part_words", [200_000, 15])
def test_decontamination_against_brute_force(spark, part_words):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(6)] + ["é1", "the"]
    long = " ".join(rng.choice(vocab) for _ in range(60))
    items = [(1, long), (10, "The w1, w2!"), (2, long[-60:]), (3, ""), (None, "w1"), (4, None), (5, "w5 " * 20), (6, "zz")]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 120))) for _ in range(25)]
    texts += [long.upper(), "x " + long[:90] + " y", "the w1 w2 " + "q " * 60, "q " * 57 + "the w1 w2", "zz", None, ""]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(0, texts[0], "", ""), (None, long, "", "")]
    df = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(df, bench, part_words=part_words).collect()
    assert len(got) == len(rows)
    for r in got:
        w, hit, found = brute_hits(long if r.doc_id is None else texts[r.doc_id], [x for x in items if x[0]])
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    clean = {r.doc_id for r in got if not r.contaminated}
    left = decontaminate.without_contaminated(df, bench, part_words=part_words).collect()
    assert {r.doc_id for r in left} == clean and all(r.found in ("y", "") for r in left)
    cut_out = {r.doc_id: r.text for r in decontaminate.without_spans(df, bench).collect()}
    assert cut_out[27].split() == ["q"] * 60 and cut_out[30] is None
    assert decontaminate.report(df, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.report(df.limit(0), bench).count() == 0


def test_test_items_without_id_mark_words(spark, tmp_path):
    import duckdb

    import corpus_pipeline
    df = spark.createDataFrame([(1, "x a b c", "", ""), (2, "a b c d e", "", ""), (3, "q r", "", ""), (4, "d e", "", "")], DOCS)
    bench = spark.createDataFrame([(None, "a b c"), (None, "b c"), (7, "d e")], "item_id long, text string")
    for name, table in (("documents", df), ("benchmark", bench)):
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(con.execute(queries.ORACLE["op6_decontaminate"]).fetchall())
    got = sorted(tuple(r) for r in queries.op6_decontaminate(spark, str(tmp_path)).collect())
    assert got == want and [r[2:4] for r in got] == [(3, 1), (5, 2), (0, 0), (2, 1)]
    parts = decontaminate.report(df, bench, part_words=2, null_ids=True).collect()
    assert sorted(tuple(r) for r in parts) == want
    left = corpus_pipeline.drop_contaminated(spark, df, str(tmp_path)).collect()
    assert [r.doc_id for r in left] == [3]


def test_repeated_test_items_are_sent_once(spark):
    """A part's size is bounded by the distinct items, however often one is repeated."""
    bench = spark.createDataFrame([(1, "A b c"), (2, "d e")] * 50 + [(3, "a b c")], "item_id long, text string")
    sent = decontaminate.stretches(bench, "item_id", "text", 13).collect()
    assert sorted((r.item, r.words) for r in sent) == [(1, ["a", "b", "c"]), (2, ["d", "e"]), (3, ["a", "b", "c"])]
    df = spark.createDataFrame([(1, "x a b c", "", "")], DOCS)
    [got] = decontaminate.report(df, bench, part_words=4).collect()
    assert (got.n_words, got.n_hit, got.n_items) == (4, 3, 2)


def test_long_texts_and_stretches_agree(monkeypatch):
    monkeypatch.setattr(decontaminate, "TEXT_STRETCH", 7)
    w = decontaminate.Windows([(1, [f"a{i}" for i in range(30)]), (2, ["b", "c"])], 13)
    text = ["x"] * 5 + [f"a{i}" for i in range(30)] + ["b", "c"] * 3 + ["a1"]
    spans, items = w.hits([t.encode() for t in text])
    assert spans == [(5, 41)] and items == {1, 2}


# byte-level BPE

def test_tree_equals_whole_encoding(monkeypatch):
    tree = bpe.Tree(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    parts = ["a", "é", "中", "。", " ", "  ", "\n", "'s", "'", "'ll", "1", "!", "…", " ", "　", "the", "😀", "\x1c", "٣", "²"]
    for leaf in (8, 50):
        monkeypatch.setattr(bpe, "LEAF", leaf)
        monkeypatch.setattr(bpe, "REACH", 2)
        monkeypatch.setattr(bpe, "_LONG_SPACE", bpe.regex.compile(bpe._SPACE + "{%d,}" % (leaf // 2)))
        for _ in range(3000):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 150)))
            ids = tree.encode(text)
            assert ids.tolist() == tree.plain.encode_ordinary(text), repr(text)
            assert tree.decode(ids) == text.encode()


def test_bpe_digests(spark):
    df, rows = docs(spark)
    plain = bpe.Tree(RANKS, public_tokenizers.PATTERN).plain
    got = bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for i, t, *_ in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.digests(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# token files

def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer
    df, rows = docs(spark)
    tok, want = Tokenizer.from_file(TOKENIZER), []
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for parts in (1, 4):
        got = sorted(token_files.round_trip(df.repartition(5), TOKENIZER, partitions=parts).collect(), key=lambda r: r.start)
        assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
        assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
        order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
        assert order == sorted(order)  # null first; equal ids in any order
    assert token_files.round_trip(df.limit(0), TOKENIZER).count() == 0


def test_encoder_chunks_equal_whole(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    e, rng = token_files.Encoder(TOKENIZER), random.Random(4)
    parts = ["a", "bc", "é", "中", "。", " ", " ", " ", "  ", "\n", "\t", "'s", "'", "1", "!", " ", "　", "\x1c", "\x85",
             "<|endoftext|>", "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["und, der.", "a,b;c (d) 'tis don't, x,, y!? [z]", "\x02a b\x02 c, \x02", "É, é. ß; ×, 1,000 a_b", "", " ", "x"]
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        flat, n = e.encode(pa.array(part), 7)
        assert n.sum() == len(flat) and len(n) == len(part)
        for t, ids in zip(part, np.split(flat, np.cumsum(n)[:-1])):
            assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [7], repr(t)


def test_one_id_of_most_rows_is_dealt_out(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    got = token_files.round_trip(df.repartition(6), TOKENIZER, partitions=8)
    assert got.count() == 4000 and got.select("start").distinct().count() == 4000
    folder = token_files.shared_folder(spark, "tokens")
    files = token_files.write(df.repartition(6), folder, TOKENIZER, partitions=8)
    assert files.count() == 8 and files.agg(F.max("n_docs")).first()[0] < 1500


# SimHash

def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(monkeypatch):
    texts = ODD + ["A\x1cb C\x85d e f g", "B c\vd\fe", "x y z " * 7]
    want = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(simhash, "PIECE", 5)
    monkeypatch.setattr(simhash, "_STRIP", 3)
    assert [simhash.fingerprint(t) for t in texts if len(t or "") < 100] == [
        w for t, w in zip(texts, want) if len(t or "") < 100]


def components(prints, distance=2):
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= distance:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in prints}


@pytest.mark.parametrize("paired", [0, 64])
def test_links_connect_what_brute_force_connects(spark, paired):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, 2 ** 64 - 1, 2 ** 63}
    for p in list(prints):
        for _ in range(3):  # chains of up to three flipped bits
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            prints.add(p)
    signed = lambda p: p - 2 ** 64 if p >= 2 ** 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    edges = simhash.links(df, 2, paired=paired).collect()
    assert all(((r.a ^ r.b) & (2 ** 64 - 1)).bit_count() <= 2 for r in edges)
    root = {signed(p): signed(p) for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p
    for r in edges:
        root[top(r.a)] = top(r.b)
    groups = lambda of: sorted(sorted(g) for g in _inverse(of).values())
    assert groups({p: top(p) for p in root}) == groups({signed(p): c for p, c in components(prints).items()})


def _inverse(of):
    out = {}
    for k, v in of.items():
        out.setdefault(v, []).append(k)
    return out


def test_near_duplicates_on_the_small_table(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(None, None), (900, ""), (901, " \n"), (None, "same text here now"),
                                  (None, "Same text HERE now"), (902, "same text here now"), (902, "other words are here")],
                                 "doc_id long, text string")
    df = table.unionByName(more)
    rows = df.collect()
    prints = {r: brute_fingerprint(r.text) for r in rows}
    comp = components(set(prints.values()))
    least = {}
    for r in rows:
        if r.doc_id is not None:
            c = comp[prints[r]]
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    got = simhash.near_duplicates(df).select("doc_id", simhash.hex_digits(F.col("fp")).alias("f"), "component_id")
    want = sorted(str((r.doc_id, f"{prints[r]:016x}", least.get(comp[prints[r]]))) for r in rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    kept = simhash.first_of_each_group(df.withColumn("row", F.lit(1))).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())
    assert len({comp[prints[next(x for x in rows if x.doc_id == r.doc_id and x.text == r.text)]] for r in kept}) == len(kept)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.first_of_each_group(df.limit(0)).count() == 0


def test_registered_query_columns(spark):
    assert queries.op8_simhash(spark, SMALL).columns == ["doc_id", "fingerprint", "component_id"]


def test_encoded_documents(spark):
    df, rows = docs(spark)
    plain = bpe.Tree(RANKS, public_tokenizers.PATTERN).plain
    got = bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(str((r.doc_id, r.ids)) for r in got) == sorted(
        str((i, plain.encode_ordinary(t or ""))) for i, t, *_ in rows)
    assert all(r.decodes and r.n_tokens == len(r.ids) for r in got)
