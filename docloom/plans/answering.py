"""Hybrid search and the answer plan over a batch of questions."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.scores import display_score
from docloom.operators.citations import METADATA, best_similarity, curate, public_citations
from docloom.operators.policy import ADVICE_ANSWER, BOUNDARY, BUSY, FACTS_NAME, NO_SNIPPET, REFUSAL_ANSWER, UNAVAILABLE, Policy, answer_kind, question_error
from docloom.operators.retrieval import bm25_topk, build_lexical_index, hash_embed, rrf, vector_topk
from docloom.tables import cut, spread


class Rewriter(Protocol):
    def __call__(self, questions: DataFrame) -> DataFrame: ...


class Narrator(Protocol):
    """Text of an answer from its citations; (question, citations) columns to a text column."""

    def __call__(self, question: Column, citations: Column) -> Column: ...


def extractive(question: Column, citations: Column) -> Column:
    """The deterministic narrator: the sources' first lines with their numbers."""
    return F.array_join(F.transform(citations, lambda c: F.concat(F.substring(c["content"], 1, 120), F.lit("["), c["n"].cast("string"), F.lit("]"))), "\n")


def route(question: Column) -> Column:
    """Rule-based router: counting and listing questions about the metadata go to SQL, others to retrieval."""
    return F.when(F.coalesce(question, F.lit("")).rlike(r"(?i)多少(?:个|款|种|条)产品|有哪些产品|统计|how many (?:products|documents)|list all"), "SQL").otherwise("RAG")


def intent(question: Column) -> Column:
    """Rule-based intent: coverage, claims, comparison or general."""
    q = F.coalesce(question, F.lit(""))
    return F.when(q.rlike("(?i)区别|对比|比较|compare|difference"), "comparison").when(q.rlike("(?i)理赔|报销|claim|材料"), "claims").when(q.rlike("(?i)责任|免赔|等待期|犹豫期|保障|cover|waiting period"), "coverage").otherwise("general")


def intent_filter(kind: Column) -> Column:
    """Document type that an intent restricts the search to; NULL for all."""
    return F.when(kind == "coverage", "条款").when(kind == "claims", "理赔").when(kind == "comparison", "说明书")


def hybrid_search(questions: DataFrame, chunks: DataFrame, key: str, text: str, k: int = 50, top: int = 8) -> DataFrame:
    """(question_id, chunk_id, rank, rrf_score, vector_score, bm25_score): vector and BM25 top k fused, the
    best ``top``. Of several texts of a key the least one is taken; tokens are written to the shared folder, texts are
    joined by the caller after the ranking."""
    rows = chunks.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("chunk_id"), F.col(text).alias("text"))
    base = spread(rows, "chunk_id").groupBy("chunk_id").agg(F.min("text").alias("text"))
    index = build_lexical_index(base, "chunk_id", "text", staged=True, postings_too=False)
    return search(questions, index | {"vectors": hash_embed(base, "chunk_id", "text")}, k, top)


def search(questions: DataFrame, index: dict[str, DataFrame], k: int = 50, top: int = 8, where: DataFrame | None = None) -> DataFrame:
    """The same over an index as ``retrieval.open_index`` gives it; by vectors alone if it has no lexical tables.
    ``where``: chunk ids to keep. (question_id, chunk_id, rank, rrf_score, vector_score, bm25_score)"""
    vectors = index["vectors"] if where is None else index["vectors"].join(where.select("chunk_id").distinct(), "chunk_id", "left_semi")
    dense = vector_topk(hash_embed(questions, "question_id", "question"), vectors, k)
    if "tokens" not in index:
        return rrf(dense, top_n=top, scores=("vector_score",)).withColumn("bm25_score", F.lit(None).cast("double"))
    return rrf(dense, bm25_topk(questions, index, k, where=where), top_n=top, scores=("vector_score", "bm25_score"))


def answer(questions: DataFrame, curated: DataFrame, narrator_state: str = "ok", policy: Policy = Policy(), narrator: Narrator = extractive) -> DataFrame:
    """(question_id, question, kind, confidence, citations, answer): the decision ladder for every question.

    ``curated``: the curated hits with ``citation``, their number. ``narrator_state``: ok, no_key (there is none), failed
    or late; without an answer the first three hits are shown. Public citations are above 0 without a narrator, above
    the policy's floor else; refusals, advice and late answers have none.
    """
    best = best_similarity(curated)
    floor = 0.0 if narrator_state == "no_key" else policy.citation_floor
    shown = public_citations(curated, floor, policy).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct(F.col("citation").alias("n"), "content", F.col("public").alias("score")))).alias("cited"))
    line = F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] "), F.coalesce("document_name", F.lit("未知文档")), F.lit(" p."), F.coalesce("page_number", F.lit("N/A")), F.lit(": "), F.substring(F.translate(F.coalesce("content", F.lit("")), "\n", " "), 1, 180 if narrator_state == "no_key" else 120))
    lines = curated.where("citation <= 3").groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("citation", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    q = questions.join(best, "question_id", "left").join(shown, "question_id", "left").join(lines, "question_id", "left")
    kind = answer_kind(F.col("question"), F.col("hits"), F.col("best"), narrator_state in ("ok", "late"), policy)
    if narrator_state == "late":
        kind = F.when(kind == "answer", "degraded").otherwise(kind)
    cited = F.when(F.col("kind").isin("answer", "llm_unavailable"), F.col("cited"))
    out = q.withColumn("kind", kind).withColumn("citations", F.coalesce(cited, F.array().cast("array<struct<n:int,content:string,score:double>>")))
    summary = F.concat(F.lit(f"【结论】\n{UNAVAILABLE.get(narrator_state, '')}\n\n【条款依据】\n"), F.coalesce("lines", F.lit(NO_SNIPPET)), F.lit(f"\n\n【不确定/边界】\n{BOUNDARY}"))
    text = F.when(F.col("kind") == "answer", narrator(F.col("question"), F.col("citations"))).when(F.col("kind") == "advice", ADVICE_ANSWER).when(F.col("kind") == "refusal", REFUSAL_ANSWER).when(F.col("kind") == "degraded", BUSY).otherwise(summary)
    confidence = F.when(F.col("kind") == "answer", 0.9).when(F.col("kind").isin("advice", "degraded"), 0.0).otherwise(F.round(F.coalesce("best", F.lit(0.0)), 4))
    return out.select("question_id", "question", "kind", confidence.alias("confidence"), "citations", text.alias("answer"))


def retrieved(found: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits in the shape of ``citations.expand_hits`` from ranked chunks and the chunks' columns (chunk_id, content,
    document_id, document_name, page_number, document_type, product_name)."""
    field = lambda c: F.col(c).cast("string").alias(c)
    shown = display_score(F.lit(None).cast("double"), F.col("vector_score"), F.col("rrf_score"), F.col("bm25_score"))
    none = [f.split(":")[0] for f in METADATA[len("struct<") : METADATA.index(",ranking_details")].split(",")]
    known = {"chunk_id", "document_id", "page_number", "document_type", "product_name", "vector_score", "bm25_score", "rrf_score"}
    meta = F.struct(*(field(c) if c in known else F.lit(None).cast("string").alias(c) for c in none)).cast(METADATA[: METADATA.index(",ranking_details")] + ">")
    details = F.lit(None).cast("struct<original_similarity:string,final_score:string>")
    rows = found.join(questions.select("question_id", "question"), "question_id").join(chunks, "chunk_id")
    return rows.select(
        "question_id", "question", (F.col("rank") - 1).alias("pos"), field("chunk_id"), field("document_id"), field("document_name"), field("document_name").alias("display_name"), "content", field("page_number"), shown.cast("string").alias("similarity_score"), field("vector_score"),
        F.struct(*(meta[c].alias(c) for c in none), details.alias("ranking_details")).alias("metadata"),
    )


def ask(questions: DataFrame, index: dict[str, DataFrame], chunks: DataFrame, facts: DataFrame | None = None, narrator_state: str = "ok", policy: Policy = Policy(), limit: int = 4, narrator: Narrator = extractive) -> DataFrame:
    """Answers to a batch of questions over an index, in one plan: each question's intent may restrict the search to a
    document type (all types where that finds nothing), hits are curated, ``facts`` (question_id, n, fact) come before
    them as one hit of score 1, and the ladder decides. ``chunks``: see ``retrieved``. A question that is blank or too
    long gets the kind ``error`` and the reason as its answer; the others are not held up by it.
    """
    checked = questions.withColumn("error", question_error(F.col("question")))
    good = cut(checked.where("error IS NULL").drop("error"))
    found = None
    for kind in ("条款", "理赔", "说明书"):
        own = good.where(intent_filter(intent(F.col("question"))) == kind)
        part = search(own, index, where=chunks.where(F.col("document_type") == kind).select("chunk_id"))
        found = part if found is None else found.unionByName(part)
    found = cut(found)
    rest = good.join(found.select("question_id").distinct(), "question_id", "left_anti")
    hits = retrieved(found.unionByName(search(rest, index)), good, chunks)
    hits = cut(hits)
    curated = curate(hits, policy, limit).join(hits, ["question_id", "pos"])
    if facts is not None:
        told = facts.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "fact"))), lambda x: F.concat(F.lit("- "), x["fact"])), "\n").alias("content"))
        one = good.join(told, "question_id").select("question_id", "question", F.lit(-1).alias("pos"), F.lit(0).alias("citation"), "content", F.lit(FACTS_NAME).alias("document_name"), F.lit("N/A").alias("page_number"), F.lit("1.0").alias("similarity_score"))
        curated = curated.drop("score").unionByName(one, allowMissingColumns=True).withColumn("citation", F.row_number().over(Window.partitionBy("question_id").orderBy("citation")))
    out = answer(good, curated, narrator_state, policy, narrator)
    wrong = checked.where("error IS NOT NULL").select("question_id", "question", F.lit("error").alias("kind"), F.lit(0.0).alias("confidence"), F.array().cast("array<struct<n:int,content:string,score:double>>").alias("citations"), F.col("error").alias("answer"))
    return out.unionByName(wrong)
