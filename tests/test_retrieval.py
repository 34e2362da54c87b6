import math
from collections import Counter

import numpy as np
import pytest

from docloom.operators import retrieval as R
from docloom.operators import sqlguard
from docloom.plans import answering
from docloom.sources import corpus


def ranked(spark, lists):
    return [spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(x)], "question_id bigint, chunk_id string, rank int") for x in lists]


def test_rrf_sums_and_ties(spark):
    got = R.rrf(*ranked(spark, ["abc", "cd"])).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["c", "a", "b", "d"]
    assert got[0]["rrf_score"] == round(1 / 63 + 1 / 61, 6)


def test_bm25_against_plain_python(spark):
    docs = {1: "免赔额 等待期", 2: "等待期 等待期 a", 3: "b", 4: None, 5: ""}
    df = spark.createDataFrame(list(docs.items()) + [(1, docs[1])], "chunk_id bigint, content string")
    q = spark.createDataFrame([(7, "等待 a"), (8, None), (9, "zzz")], "question_id bigint, question string")
    got = {(r["question_id"], r["chunk_id"]): r["score"] for r in R.bm25_topk(q, R.build_lexical_index(df, "chunk_id", "content")).collect()}

    def toks(t):
        import re

        h = re.findall("[一-鿿]", t or "")
        return h + [a + b for a, b in zip(h, h[1:])] + re.findall("[a-z0-9]+", t or "")

    tf = {i: Counter(toks(t)) for i, t in docs.items()}
    avg = sum(sum(c.values()) for c in tf.values()) / len(docs)
    want = {}
    terms = toks("等待 a")
    df_ = {t: sum(t in c for c in tf.values()) for t in terms}
    for i, c in tf.items():
        if any(t in c for t in terms):
            s = sum(math.log(6 / df_[t]) * (1 + c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) if c[t] else math.log(6 / df_[t]) * 0 + 1) for t in terms if df_[t])
            want[7, i] = round(s, 4)
    assert got == pytest.approx(want, abs=2e-4)


def test_vector_search_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(90, None), (91, [1.0] * 3), (92, [0.0] * 8)]
    df = spark.createDataFrame(rows, "chunk_id bigint, vector array<double>").repartition(3)
    q = spark.createDataFrame([(i, v[i]) for i in (3, 4)], "question_id bigint, vector array<double>")
    got = {(r["question_id"], r["rank"]): r["chunk_id"] for r in R.vector_topk(q, df, 5).collect()}
    m = np.array(v)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for i in (3, 4):
        assert [got[i, k] for k in range(1, 6)] == np.argsort(-(m @ m[i]))[:5].tolist()


def test_dense_and_sparse_embeddings_agree(spark):
    df = spark.createDataFrame([(1, "等待期 a b 等待"), (2, ""), (3, None)], "k bigint, t string")
    dense = {r["k"]: np.array(r["vector"]) for r in R.hash_embed(df, "k", "t").collect()}
    sparse = np.zeros(384)
    for r in R.hash_buckets(df, "k", "t").collect():
        sparse[r["idx"]] = r["value"]
    assert np.allclose(dense[1], sparse / np.linalg.norm(sparse), atol=1e-6)
    assert not dense[2].any() and not dense[3].any()


def test_recursive_pieces_keep_a_repeated_end():
    line = "The insurer pays. "
    p = corpus.recursive_pieces(line + "x" * 150 + ". " + "\n\n" + line.strip(), 180, 20)
    assert p[-1] == line.strip() and len(p) == 2


def test_recursive_pieces_hold_everything():
    t = ("第一句话。" * 50 + "\n\n") * 4 + "x" * 1000
    p = corpus.recursive_pieces(t, 180, 20)
    assert max(map(len, p)) <= 180 and "".join(p).replace("\n", "").count("x") >= 1000
    assert corpus.recursive_pieces("", 180, 20) == []


def test_sql_guard(spark):
    ok = lambda s, m: not _refused(spark, s, m)
    assert ok("select a from document_metadata;", "ast") and ok("select a from document_metadata", "compat")
    assert not ok("select created_time from document_metadata", "compat") and ok("select created_time from document_metadata", "ast")
    for bad in ("", None, "delete from document_metadata", "select 1; select 2", "select 1", "select * from secrets", "select * from document_metadata where id in (select id from other)"):
        assert not ok(bad, "ast"), bad


def _refused(spark, s, m):
    try:
        sqlguard.validate(spark, s, mode=m)
    except sqlguard.Refused:
        return True
    return False


def test_hybrid_on_a_small_corpus(spark):
    c = spark.createDataFrame([(1, "等待期为九十日"), (2, "犹豫期为十五日"), (3, "premium payment")], "id bigint, content string")
    q = spark.createDataFrame([(1, "等待期"), (2, "premium")], "question_id bigint, question string")
    best = {r["question_id"]: r["chunk_id"] for r in answering.hybrid_search(q, c, "id", "content").where("rank = 1").collect()}
    assert best == {1: 1, 2: 3}
