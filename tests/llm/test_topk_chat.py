import hashlib
import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattflow.llm import chat, topk

VEC = T.StructType([T.StructField("vec_id", T.LongType()),
                    T.StructField("embedding", T.ArrayType(T.FloatType())),
                    T.StructField("score", T.StringType())])


def brute_topk(rows, k, is_query):
    ok = [(i, np.floor(np.array(v, np.float64) * 256)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {(i, tuple(v)) for i, v in ok if is_query(i)}
    out = {}
    for qid in {i for i, _ in queries}:
        hits = [(-int(sum(a * b for a, b in zip(q, v))), i) for j, q in queries if j == qid
                for i, v in ok if i != qid]
        out[qid] = [(i, -s) for s, i in sorted(hits)[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_topk_ties_repeats_bad_vectors_and_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, .05, 6)]) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(6)] + [rows[9]] * 7
    rows += [(300, None), (301, [0.1, None]), (302, [float("nan")]), (303, [float("inf")]),
             (None, rows[0][1]), (304, []), (350, []), (305, [0.25])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VEC)
    s = topk.sparse_rows(df, "vec_id", "embedding")
    q = s.filter("id % 50 = 0")
    want = brute_topk(rows, 5, lambda i: i % 50 == 0)
    assert got(topk.top_k(q, s)) == want
    assert got(topk.top_k(q, s, candidates_per_block=13, queries_per_block=2)) == want
    assert topk.top_k(q.limit(0), s).count() == 0
    assert topk.top_k(q, s.limit(0)).count() == 0


def test_topk_fewer_than_k_and_huge_components(spark):
    df = spark.createDataFrame([(0, [1e30], "a"), (1, [2e30], "b"), (2, [-1.0], "c")], VEC)
    s = topk.sparse_rows(df, "vec_id", "embedding")
    res = got(topk.top_k(s.filter("id = 0"), s))
    assert [i for i, _ in res[0]] == [1, 2]
    assert res[0][0][1] == 2 ** 63 - 1 and res[0][1][1] == -2 ** 63


TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                      T.StructField("formatted", T.StringType())])


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "<", "|im_end|>", "",
             "é\n$1 \\ <<|>", "<|im_sep|><|im_join|>", None, "a<|"]
    rows = [(1, i, ["user", "assistant"][i % 2], t, "x") for i, t in enumerate(nasty)]
    rows += [(2, i, ["assistant", "assistant", "user", None][i % 4], f"t{i}", "x") for i in range(1000)]
    rows += [(3, 0, "a<|im_sep|>\nb", "hello", "x"), (3, 0, "a<|im_sep|>\nb", "hello", "x"),
             (3, None, "user", "first", "x"), (None, 1, "user", "lost", "x"), (4, 5, "user", "", "x")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, TURNS).repartition(5))
    back = {r.conv_id: r for r in formatted.select(
        "*", chat.read_back(F.col("formatted")).alias("t"),
        chat.segments(F.col("formatted")).alias("s")).collect()}
    want = {}
    for c, turn, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None,
                                                              r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [(t.role, t.text) for t in r.t] for c, r in back.items()} == want
    for c, r in back.items():
        assert "".join(s.text for s in r.s) == r.formatted
        assert sum(s.chars for s in r.s) == len(r.formatted)
        loss = [re.sub(r"<(\\*)\\\|", r"<\1|", s.text) for s in r.s if s.loss]
        assert loss == [t for role, t in want[c] if role == "assistant"]
        # one message for each run of a role
        runs = sum(1 for i, t in enumerate(want[c]) if i == 0 or want[c][i - 1][0] != t[0])
        assert r.formatted.count(chat.START) == runs == r.formatted.count(chat.END)
    d = {r.conv_id: r for r in chat.digest(formatted).collect()}
    text = "".join(f"{a}\n{b}\n" for a, b in want[1])
    assert d[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert d[1].loss_chars == len("".join(t for r, t in want[1] if r == "assistant"))
    assert d[4].loss_sha256 == hashlib.sha256(b"").hexdigest()


def test_chat_empty(spark):
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0
