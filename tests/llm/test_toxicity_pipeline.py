import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from wattflow.llm import bpe, decontaminate, secret_scan, toxicity
from wattflow.llm.queries import RANKS, public_tokenizers

from test_text_ops import brute_fingerprint, brute_hits, components
from test_native_scans import brute_secrets

SMALL = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("score", T.StringType())])
LABELS = "doc_id long, toxic int"


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    vocab = [word() for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        sentences = [" ".join(rng.choice(vocab) for _ in range(8)) for _ in range(rng.randint(1, 30))]
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["zounds", "Zoundry", "grump"]) + " you"
        rows.append((i, ". ".join(sentences), "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_offending_sentences(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(None, "zounds", "x"), (5001, None, "x"), (5002, "", "x"), (5001, None, "x")], DOCS)
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, y in labels]
    table = spark.createDataFrame(flipped + [(None, 1), (3, None), (1, 0)], LABELS)
    model = toxicity.train(docs, table)  # labels of held-out rows are wrong, and must not matter
    got = toxicity.judge(docs, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert len(held) > 100 and sum(r.predicted == truth.get(r.doc_id, 0) for r in held) >= 0.98 * len(held)
    assert by_id[None].predicted == 1 and not by_id[None].held_out
    assert by_id[5001].score == by_id[5002].score < 0.3
    found = docs.withColumn("s", toxicity.offending(F.col("text"), model)).filter("doc_id % 5 = 0 and doc_id < 700").collect()
    right = sum(any(w in r.text[s.start:s.end].lower() for s in r.s for w in ("zound", "grump")) for r in found)
    assert right >= 0.95 * len(found)
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_no_labels_one_class_and_empty(spark):
    rows, labels = corpus(60)
    docs = spark.createDataFrame(rows, DOCS)
    for some in ([], [(i, 0) for i, _ in labels], [(i, 1) for i, _ in labels]):
        table = spark.createDataFrame(some, LABELS)
        got = toxicity.judge(docs, toxicity.train(docs, table)).collect()
        assert len(got) == 60 and all(0 <= r.score <= 1 for r in got)
    model = toxicity.train(docs.limit(0), spark.createDataFrame(labels, LABELS))
    assert toxicity.judge(docs.limit(0), model).count() == 0


def test_copies_teach_once():
    rows, labels = corpus(400)
    texts = [(t, y) for (_, t, _), (_, y) in zip(rows, labels)]
    copied = texts + [texts[0]] * 300
    assert set(toxicity.fit(iter(copied), {0: 1.0, 1: 1.0}, 10 ** 9).weights) == set(
        toxicity.fit(iter(texts), {0: 1.0, 1: 1.0}, 10 ** 9).weights)


def test_a_toxic_near_copy_of_a_clean_text_teaches():
    rng = random.Random(8)
    clean = [". ".join(" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(rng.randrange(40)) for _ in range(6))
                       for _ in range(8)) for _ in range(200)]
    toxic = [t + ". you zounds" for t in clean[:100]]
    for rows in ([(t, 0) for t in clean] + [(t, 1) for t in toxic], [(t, 1) for t in toxic] + [(t, 0) for t in clean]):
        model = toxicity.fit(iter(rows), {0: 1.0, 1: 1.0}, 10 ** 9)
        assert model.score("you zounds") > 0.9 and max(model.score(t) for t in clean) < 0.3


def test_scores_and_gradient_against_plain_formulas():
    rng = random.Random(3)
    model = toxicity.Model({"bad": 3.0, "worse": 5.5, "uglyy*": 2.5}, bias=-4.0, leak=0.02)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def plain(text):
        clean = 1 - model.leak
        for sentence in "".join("\n" if c in ".!?" else c for c in text.lower()).split("\n"):
            words = set(sentence.replace(",", " ").split())
            z = sum(3.0 * (w == "bad") + 5.5 * (w == "worse") + 2.5 * (w.startswith("uglyy") and len(w) > 5) for w in words)
            clean *= 1 - max(0.0, (sigmoid(z - 4) - sigmoid(-4)) / (1 - sigmoid(-4)))
        return 1 - clean
    texts = ["", "fine", "Bad, bad day. worse!", "uglyyish? Uglyy uglyyest\nbad", "fine. " * 100_000 + "worse"]
    texts += [" ".join(rng.choice(["bad", "worse", "uglyyone", "ok", "so", "."]) for _ in range(30)) for _ in range(20)]
    for t in texts:
        assert abs(model.score(t) - plain(t)) < 1e-9
    # the fitted point is a stationary one of the penalised likelihood, by finite differences
    names, s_doc = ["bad", "worse"], np.array([0, 0, 1, 2, 3, 3, 4])
    entry_s, entry_f = np.array([0, 1, 1, 2, 3, 4, 5, 6]), np.array([0, 0, 1, 1, 0, 1, 0, 1])
    y, weight = np.array([1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0]), np.ones(7)
    fitted = toxicity._train(names, s_doc, entry_s, entry_f, y, weight)

    def loss(w, bias, leak):
        z = bias + np.bincount(entry_s, np.array(w)[entry_f], len(s_doc))
        clean = np.full(7, np.log1p(-leak))
        np.add.at(clean, s_doc, np.log(1 - (sigmoid(z) - sigmoid(bias)) / (1 - sigmoid(bias))))
        p = 1 - np.exp(clean)
        return -np.sum(weight * np.where(y == 1, np.log(np.maximum(p, 1e-9)), clean)) + toxicity.PENALTY * sum(w) + 0.05 * (bias + 4) ** 2
    w = [fitted.weights.get(n, 0.0) for n in names]
    at = loss(w, fitted.bias, fitted.leak)
    for i in range(2):
        for move in (-0.05, 0.05):
            moved = list(w)
            moved[i] = max(moved[i] + move, 0.0)
            assert loss(moved, fitted.bias, fitted.leak) > at - 2e-3


def test_sample_is_bounded_in_characters_before_texts_move(spark):
    rows, labels = corpus(400)
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.train(docs, table, sample=toxicity.Sample(chars=sum(len(t) for _, t, _ in rows) // 3))
    assert model.weights and all(0 <= r.score <= 1 for r in toxicity.judge(docs, model).collect())


def test_pipeline_against_brute_force_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in docs.collect()}
    want = {i for i, r in rows.items() if model.score(r.text) < 0.3}
    kept = stage["toxicity"](spark, docs, SMALL)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    prints = {i: brute_fingerprint(rows[i].text) for i in want}
    comp, least = components(set(prints.values())), {}
    for i in sorted(want):
        least.setdefault(comp[prints[i]], i)
    want = set(least.values())
    kept = stage["near_duplicates"](spark, kept, SMALL)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want

    def contaminated(text):
        w, hit, _ = brute_hits(text, items)
        return len(hit) > 0 and 20 * len(hit) >= len(w)
    # brute force on all words is slow: the windows are checked on the operator's own test too
    checked = {i for i in want if len(rows[i].text) < 1500}
    kept = stage["decontamination"](spark, kept, SMALL)
    got = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {i for i in checked if contaminated(rows[i].text)} == checked - got
    kept = stage["secrets"](spark, kept, SMALL)
    masked = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == docs.columns and set(masked) == got
    for i, r in masked.items():
        assert (r.text == rows[i].text) == (not brute_secrets(rows[i].text))
        assert r.n_chars == len(r.text) and not brute_secrets(r.text)
    plain = bpe.Tree(RANKS, public_tokenizers.PATTERN).plain
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in out} == got
    for r in out:
        assert r.ids == plain.encode_ordinary(masked[r.doc_id].text) and r.n_tokens == len(r.ids) and r.decodes


def test_pipeline_stages_take_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.limit(5).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (7001, None, None, None, None), (7001, "", "en", "s", 0)], docs.schema))
    for df in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SMALL)
        assert df.count() >= 0


def test_secret_mask_is_no_secret():
    assert not brute_secrets("token = " + secret_scan.MASK)
    assert decontaminate.words_of(None) == [] and np.array(bpe.Tree(
        RANKS, public_tokenizers.PATTERN).encode("")).size == 0
