import pytest
from pyspark.sql import functions as F

from docloom.functions import scores, text
from docloom.operators import citations, policy

M0 = dict.fromkeys("chunk_id document_id display_name document_title filename source page_number document_type product_name vector_score bm25_score rrf_score final_score ranking_details".split())


def hits(spark, rows):
    base = dict.fromkeys("chunk_id document_id document_name display_name content page_number similarity_score vector_score metadata".split())
    data = [{"question_id": 1, "question": r.pop("question", "等待期多久？"), "pos": i, **base, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame(data, _ddl())


def _ddl():
    from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

    hit = StructType.fromDDL("c " + citations.HIT)["c"].dataType
    return StructType([StructField("question_id", LongType()), StructField("question", StringType()), StructField("pos", IntegerType()), *hit.fields])


def test_normalise(spark):
    df = spark.createDataFrame([(str(x),) for x in (-1, 0, 0.5, 1, 1.2, 2, 3, "x", "NaN")] + [(None,)], "s string")
    assert [round(r[0], 6) for r in df.select(scores.normalise_score(F.col("s"))).collect()] == [0, 0, 0.5, 1, 0, 0, 0.25, 0, 0, 0]


def test_shape(spark):
    rows = [
        {"chunk_id": "12", "document_id": "x", "page_number": "3", "similarity_score": "1.2", "metadata": M0 | {"filename": "f.pdf"}},
        {"chunk_id": " 007", "display_name": "D", "document_name": "n", "page_number": "N/A", "similarity_score": "0.66"},
    ]
    a, b = citations.shape(hits(spark, rows)).orderBy("pos").collect()
    assert (a["chunk_id"], a["document_id"], a["document_name"], a["page_number"]) == ("12", "x", "f.pdf", 3) and 0 <= a["similarity_score"] <= 1
    assert (b["chunk_id"], b["document_id"], b["document_name"], b["page_number"], b["similarity_score"]) == ("7", "-1", "D", None, 0.66)


def test_curation(spark):
    cover = "文档名称：甲\n产品名称：乙\n文档类型：条款\n状态：演示样本"
    rows = [
        {"document_name": "A", "page_number": "1", "content": cover, "similarity_score": "0.95"},
        {"document_name": "B", "page_number": "2", "content": "第三条 等待期为九十日，自合同生效日起计算，等待期内出险不承担责任。", "similarity_score": "0.2"},
        {"document_name": "A", "page_number": "2", "content": "第二条 等待期：本合同的等待期为三十日，投保人须知悉并确认本条内容。", "similarity_score": "0.21"},
        {"document_name": "b ", "page_number": "2", "content": "第三条 等待期为九十日，另一页的文字。", "similarity_score": "0.19"},
    ]
    kept = [r["pos"] for r in citations.curate(hits(spark, rows)).orderBy("citation").collect()]
    assert kept == [2, 1]


def test_dropped_row_does_not_register_its_prefix(spark):
    x, y = ("甲" * 60 + "等待期"), ("乙" * 60 + "等待期")
    rows = [("p1", x, 0.9), ("p1", y, 0.8), ("p2", y, 0.7), ("p3", x, 0.6), ("p4", "", 0.5)]
    data = [{"document_name": p, "page_number": "1", "content": c, "similarity_score": str(s)} for p, c, s in rows]
    assert [r["pos"] for r in citations.curate(hits(spark, data)).orderBy("citation").collect()] == [0, 2]


def test_public_and_gate(spark):
    rows = [
        {"content": "第三条 等待期为九十日，自合同生效日起计算。", "similarity_score": "0.81"},
        {"content": "产品名称：乙 文档类型：条款 状态：演示样本", "similarity_score": "0.05"},
        {"content": "第四条 犹豫期", "similarity_score": "0.0"},
        {"content": "第五条 理赔", "similarity_score": "0.031", "metadata": M0 | {"rrf_score": "0.031", "vector_score": "0.74"}},
    ]
    df = hits(spark, rows)
    assert {r["pos"]: r["public"] for r in citations.public_citations(df).collect()} == {0: 0.81, 3: 0.74}
    for kind, n in (("refusal", 0), ("advice", 0), ("degraded", 0), ("answer", 2)):
        kinds = spark.createDataFrame([(1, kind)], "question_id bigint, kind string")
        assert citations.citations_for_kind(df, kinds).count() == n


@pytest.mark.parametrize(("question", "hits_", "best", "kind"), [("这样一定能获赔吗", 3, 0.9, "advice"), ("今天天气怎么样", 3, 0.9, "refusal"), ("等待期多久", 0, None, "refusal"), ("等待期多久", 2, 0.2, "refusal"), ("等待期多久", 2, 0.5, "answer"), (None, 2, 0.5, "refusal")])
def test_ladder(spark, question, hits_, best, kind):
    df = spark.createDataFrame([(question, hits_, best)], "q string, n int, b double")
    assert df.select(policy.answer_kind(F.col("q"), F.col("n"), F.col("b"))).first()[0] == kind


def test_text_functions(spark):
    df = spark.createDataFrame([("等待,期 A1b", "请问 保额 A 保额 (险)？", "见[12]与[3]。", "【结论】\n可以\n【依据】第三条")], "a string, b string, c string, d string")
    r = df.select(text.hash_tokens(F.col("a")), text.query_terms(F.col("b")), text.first_citation(F.col("c"), F.lit(4)), text.answer_sections(F.col("d")), text.token_bucket(F.lit("等待")), text.token_sign(F.lit("等待"))).first()
    assert r[0] == ["等", "待", "期", "等待", "待期", "a1b"] and r[1] == ["请问", "保额", "险"] and r[2] == 1
    assert [tuple(x) for x in r[3]] == [("conclusion", "可以"), ("evidence", "第三条")] and (r[4], r[5]) == (39, 1)


def test_json_object(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('so: {"a": {"b": 2}} .',), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(text.json_object(F.col("t"))).collect()] == ['{"a": 1}', '{"a": {"b": 2}}', None, None]
