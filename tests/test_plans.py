import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import scores, text
from docloom.operators import citations, facts, history, ops, orphans, policy, retrieval, sqlguard
from docloom.plans import answering

GUARD_CASES = (
    ("SELECT product_name FROM document_metadata", True, True),
    ("SELECT created_time FROM document_metadata", False, True),
    ("SELECT a.id FROM document_metadata a, query_history b", True, False),
    ("WITH x AS (SELECT id FROM document_metadata) SELECT id FROM x", False, True),
    ("DROP TABLE document_metadata", False, False),
    ("SELECT id FROM document_metadata; SELECT 1", False, False),
)


@pytest.mark.parametrize(("sql", "compat", "ast"), GUARD_CASES)
def test_sql_guard_modes(spark, sql, compat, ast):
    for mode, want in (("compat", compat), ("ast", ast)):
        if want:
            assert sqlguard.validate(spark, sql, mode=mode) == sql
        else:
            with pytest.raises(sqlguard.Refused):
                sqlguard.validate(spark, sql, mode=mode)


def test_guarded_sql_leaves_the_sessions_view(spark):
    spark.range(3).createOrReplaceTempView("document_metadata")
    got = sqlguard.run(spark, "SELECT count(*) AS n FROM document_metadata", {"document_metadata": spark.range(7)})
    assert got.first()[0] == 7 and spark.table("document_metadata").count() == 3
    spark.catalog.dropTempView("document_metadata")


def test_keys_and_scores(spark):
    df = spark.createDataFrame([("chunk_1000000000000000001", "0", "0.5", "0.2", "9"), (" CHUNK_7 ", "0.0", None, None, "3"), ("chunk_99999999999999999999", None, None, None, None)], "k string, o string, v string, r string, b string")
    assert [r[0] for r in df.select(orphans.key_number(F.col("k"), "chunk_")).collect()] == [1000000000000000001, 7, None]
    assert [r[0] for r in df.select(scores.display_score(F.col("o"), F.col("v"), F.col("r"), F.col("b"))).collect()] == [0.5, 3.0, 0.0]
    assert [r[0] for r in spark.range(5).select(scores.backoff_seconds(F.col("id"))).collect()] == [0.25, 0.5, 1.0, 2.0, 2.5]
    e = spark.createDataFrame([("产品名称:甲；； 正文",), ("状态：" + "长" * 41,)], "t string").select(text.excerpt(F.col("t")))
    assert [r[0] for r in e.collect()] == ["正文", "长"]


def test_metadata_filter(spark):
    df = spark.createDataFrame([(1, " 条款", "active"), (2, "条款", None), (3, None, "x")], "id int, document_type string, status string")
    ids = lambda f: {r[0] for r in df.where(retrieval.metadata_filter(f, df.columns)).select("id").collect()}
    assert ids(None) == {1, 2, 3} and ids({"document_type": "条款 "}) == {1, 2} and ids({"document_type": "条款", "status": {"$in": ["active"]}}) == {1}
    assert ids({"document_type": None}) == {3} and ids({"lacking": "None"}) == {1, 2, 3} and ids({"status": {"$in": []}}) == set() and ids({"status": {"$in": [None]}}) == {2}


def test_names_are_resolved_exactly_then_by_parts(spark):
    files = spark.createDataFrame([(1, "a/Terms.pdf"), (2, "b/long-terms-2.pdf"), (3, None)], "id bigint, filename string")
    names = spark.createDataFrame([("x/terms.pdf",), ("long-terms",), ("see Terms.pdf here",), ("none",), (None,)], "name string")
    assert {r["name"]: r["file_id"] for r in ops.resolve_documents(names, files).collect()} == {"x/terms.pdf": 1, "long-terms": 2, "see Terms.pdf here": 1, "none": None, None: None}


def test_system_metrics(spark):
    at = datetime(2024, 1, 2)
    df = spark.createDataFrame([(at, 0.0, 10.0, 4, 1), (at, 50.0, None, 6, None), (datetime(2020, 1, 1), 9.0, 9.0, 9, 9)], "timestamp timestamp_ntz, cpu_usage double, memory_usage double, query_count int, error_count int")
    assert tuple(ops.system_metrics(df, at).first()) == (50.0, 10.0, 10, 1, 10.0)
    assert ops.system_metrics(df.limit(0), at).first()["avg_cpu_usage"] is None


def test_ontology(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"version": "1", "synonyms": {"等待期": ["观察期"], "ABC": ["x"], "e": []}}), encoding="utf-8")
    o = facts.read_ontology(spark, f"file://{tmp_path}/o.json")
    assert {r["term"] for r in o.collect()} == {"等待期", "ABC"} and facts.read_ontology(spark, f"file://{tmp_path}/none.json").count() == 0
    q = spark.createDataFrame([(1, "abc的等待期"), (2, "无"), (3, None)], "question_id bigint, question string")
    assert {r[0]: r[1] for r in facts.synonyms_of(q, o).collect()} == {1: ["x", "观察期"], 2: [], 3: []}


def test_details_and_sources(spark):
    h = spark.createDataFrame([(1, '[{"similarity_score": 0.5}]'), (2, None)], "id bigint, retrieved_chunks string")
    assert [r["chunks_used"] for r in history.detail(h, spark.createDataFrame([(1,), (9,)], "id bigint")).collect()] == [1]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(["0.1", "0", None, "", "-1", "0.2", "0.3"])], "question_id int, pos int, similarity_score string")
    assert [r["pos"] for r in citations.shown_sources(rows).orderBy("pos").collect()] == [0, 2, 3, 5]


CHUNKS = [(i, f"本合同等待期为{i}天，被保险人在等待期内因疾病身故的，保险人不承担给付保险金的责任。", 1, "条款甲", i, "条款", "甲") for i in range(1, 6)]


def asked(spark, folder, questions, chunks=CHUNKS, lexical=True, **kw):
    schema = "chunk_id bigint, content string, document_id int, document_name string, page_number int, document_type string, product_name string"
    c = spark.createDataFrame(chunks, schema)
    retrieval.write_index(c, "chunk_id", "content", folder)
    index = retrieval.open_index(spark, folder)
    q = spark.createDataFrame(questions, "question_id bigint, question string")
    return {r["question_id"]: r for r in answering.ask(q, index if lexical else {k: v for k, v in index.items() if k in ("chunks", "vectors")}, c, **kw).collect()}


def test_ask(spark, tmp_path):
    q = [(1, "等待期为多少天，等待期内身故保险人是否给付保险金"), (2, "这样一定能获赔吗"), (3, "北京今天天气怎么样"), (4, " "), (5, "长" * 1001)]
    got = asked(spark, f"file://{tmp_path}/a", q)
    assert {k: r["kind"] for k, r in got.items()} == {1: "answer", 2: "advice", 3: "refusal", 4: "error", 5: "error"}
    assert len(got[1]["citations"]) >= 1 and got[1]["confidence"] == 0.9 and not got[3]["citations"] and got[2]["answer"] == policy.ADVICE_ANSWER and got[4]["answer"] == "blank"
    facts_ = spark.createDataFrame([(1, 1, "产品『甲』已在文档中出现")], "question_id bigint, n int, fact string")
    got = asked(spark, f"file://{tmp_path}/b", q[:1], facts=facts_, narrator_state="no_key")
    assert got[1]["kind"] == "llm_unavailable" and "[1] 知识图谱事实 p.N/A: - 产品" in got[1]["answer"]
    got = asked(spark, f"file://{tmp_path}/c", q[:2], lexical=False, narrator_state="late")
    assert got[1]["kind"] == "degraded" and not got[1]["citations"] and got[2]["kind"] == "advice"


def test_ask_an_empty_index(spark, tmp_path):
    got = asked(spark, f"file://{tmp_path}/e", [(1, "等待期多久"), (2, "这样一定能获赔吗"), (3, "今天天气怎么样")], [])
    assert {k: r["kind"] for k, r in got.items()} == {1: "refusal", 2: "advice", 3: "refusal"} and got[1]["answer"] == policy.REFUSAL_ANSWER


def test_search_without_lexical_tables(spark, tmp_path):
    folder = tmp_path / "v"
    c = spark.createDataFrame([(i, t) for i, t, *_ in CHUNKS], "chunk_id bigint, content string")
    retrieval.write_index(c, "chunk_id", "content", f"file://{folder}")
    retrieval.write_index(spark.createDataFrame([(9, "第九条 犹豫期")], c.schema), "chunk_id", "content", f"file://{folder}", "append")
    q = spark.createDataFrame([(1, "犹豫期")], "question_id bigint, question string")
    assert answering.search(q, retrieval.open_index(spark, f"file://{folder}")).where("rank = 1").first()["chunk_id"] == 9
    __import__("shutil").rmtree(folder / "tokens")
    only = answering.search(q, retrieval.open_index(spark, f"file://{folder}"))
    assert only.where("rank = 1").first()["chunk_id"] == 9 and only.where("bm25_score IS NOT NULL").count() == 0
    given = spark.createDataFrame([(1, [1.0, 0.0])], "question_id bigint, vector array<float>")
    assert retrieval.embedder("hf:model", given)(q, "question_id", "question").first()["vector"] == [1.0, 0.0]
    assert len(retrieval.embedder("local:hash-384", given)(q, "question_id", "question").first()["vector"]) == 384
