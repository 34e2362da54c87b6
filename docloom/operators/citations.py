"""Retrieved hits: shape, curation and what may be published.

A hit row: question_id, question, pos, chunk_id, document_id, document_name, display_name, content,
page_number, similarity_score, vector_score, metadata (struct); all but the first and pos may be NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.scores import coerce_id, coerce_page, gate_score, public_score
from docloom.operators.policy import Policy, relevance_bonus, weak

METADATA = (
    "struct<chunk_id:string,document_id:string,display_name:string,document_title:string,filename:string,source:string,page_number:string,document_type:string,product_name:string,"
    "vector_score:string,bm25_score:string,rrf_score:string,final_score:string,ranking_details:struct<original_similarity:string,final_score:string>>"
)
HIT = f"struct<chunk_id:string,document_id:string,document_name:string,display_name:string,content:string,page_number:string,similarity_score:string,vector_score:string,metadata:{METADATA}>"


def expand_hits(history: DataFrame) -> DataFrame:
    """Hits of the stored answers: elements that are objects of ``retrieved_chunks`` texts that hold a list."""
    r = F.col("retrieved_chunks")
    ok = F.try_parse_json(r).isNotNull() & F.ltrim(F.regexp_replace(r, r"^\s+", "")).startswith("[")
    rows = history.where(r.isNotNull()).select(F.col("id").alias("question_id"), F.col("query").alias("question"), F.when(ok, r).alias("r")).where("r IS NOT NULL").dropDuplicates()
    parsed = rows.select("question_id", "question", F.posexplode(F.from_json("r", f"array<{HIT}>")).alias("pos", "c"))
    return parsed.where("c IS NOT NULL").select("question_id", "question", "pos", "c.*")


def number(col: Column) -> Column:
    return col.try_cast("double")


def gate(df_columns: str = "") -> Column:
    """Gate score of a hit row."""
    m, r = F.col("metadata"), F.col("metadata.ranking_details")
    return gate_score(F.col("similarity_score"), r["original_similarity"], m["vector_score"], F.col("vector_score"), m["bm25_score"], r["final_score"], m["rrf_score"])


def _name(*cols: Column, default: str) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(default))


def doc_page_key() -> Column:
    m = F.col("metadata")
    name = _name(F.col("document_name"), m["document_title"], m["filename"], m["source"], default="unknown")
    return F.concat(F.lower(F.trim(name)), F.lit("|"), F.coalesce(F.col("page_number"), m["page_number"], F.lit("None")))


def scored(hits: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Hits with their curation score: the largest raw score, bonus, one less if weak."""
    m = F.col("metadata")
    base = F.greatest(F.coalesce(number(F.col("similarity_score")), F.lit(0.0)), *(F.coalesce(number(m[k]), F.lit(float("-inf"))) for k in ("rrf_score", "final_score", "bm25_score", "vector_score")))
    named = hits.withColumn("document_name", _name(F.col("document_name"), m["document_title"], m["filename"], m["display_name"], default="未知文档")).withColumn("page_number", F.coalesce("page_number", m["page_number"]))
    return (
        named.withColumn("weak", weak(F.col("content"), policy))
        .withColumn("score", F.round(base + relevance_bonus(F.col("question"), F.col("content"), policy) - F.col("weak").cast("int"), 6))
        .withColumn("page_key", doc_page_key())
        .withColumn("prefix", F.substring(F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", "")), 1, 48))
    )


def curate(hits: DataFrame, policy: Policy = Policy(), limit: int = 4) -> DataFrame:
    """(question_id, citation, pos, score): the citations [1]..[limit] of each question.

    Strong hits by falling score (their order on ties), or all if none is strong; one is kept unless an
    earlier kept one has its document and page or its first 48 characters. A question has as many hits
    as its retrieval returned (some tens), so its fold is a small array.
    """
    limit = max(1, min(int(limit or 4), 8))
    s = scored(hits, policy)
    fields = F.struct((-F.col("score")).alias("o"), F.col("pos"), F.col("score"), F.col("weak"), F.col("page_key"), F.col("prefix"))
    per = s.groupBy("question_id").agg(F.sort_array(F.collect_list(fields)).alias("hits"))
    strong = F.filter("hits", lambda h: ~h["weak"])
    pool = per.withColumn("pool", F.when(F.size(strong) > 0, strong).otherwise(F.col("hits")))
    empty = F.array().cast("array<struct<pos:int,score:double,page_key:string,prefix:string>>")

    def step(kept: Column, h: Column) -> Column:
        clash = F.exists(kept, lambda x: (x["page_key"] == h["page_key"]) | ((h["prefix"] != "") & (x["prefix"] == h["prefix"])))
        one = F.struct(h["pos"].cast("int").alias("pos"), h["score"].cast("double").alias("score"), h["page_key"].alias("page_key"), h["prefix"].alias("prefix"))
        return F.when((F.size(kept) >= limit) | clash, kept).otherwise(F.concat(kept, F.array(one)))

    folded = pool.select("question_id", F.aggregate("pool", empty, step).alias("kept"))
    return folded.select("question_id", F.posexplode("kept").alias("n", "h")).select("question_id", (F.col("n") + 1).alias("citation"), "h.pos", "h.score")


def public_citations(hits: DataFrame, min_score: float = 0.0, policy: Policy = Policy()) -> DataFrame:
    """Hits with evidence above ``min_score`` that are not weak, their score clamped to 0..1 at 4 digits."""
    g = hits.withColumn("gate", gate())
    return g.where((F.col("gate") > min_score) & ~weak(F.col("content"), policy)).withColumn("public", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("gate"))), 4))


def citations_for_kind(hits: DataFrame, kinds: DataFrame, min_score: float | None = None, policy: Policy = Policy()) -> DataFrame:
    """Public citations by the kind of answer (question_id, kind): none for refusal, advice, degraded."""
    floor = policy.citation_floor if not min_score or min_score <= 0 else min_score
    shown = kinds.where(~F.lower(F.coalesce("kind", F.lit("answer"))).isin("refusal", "advice", "degraded", "insufficient_evidence")).select("question_id")
    return public_citations(hits, floor, policy).join(shown, "question_id", "left_semi")


def shape(hits: DataFrame) -> DataFrame:
    """The public form of hits."""
    m = F.col("metadata")
    name = _name(F.col("display_name"), F.col("document_name"), m["display_name"], m["document_title"], m["filename"], default="未知文档")
    return hits.select(
        "question_id",
        "pos",
        coerce_id(F.coalesce(F.col("chunk_id"), m["chunk_id"])).alias("chunk_id"),
        coerce_id(F.coalesce(F.col("document_id"), m["document_id"])).alias("document_id"),
        name.alias("document_name"),
        F.coalesce("content", F.lit("")).alias("content"),
        coerce_page(F.coalesce(F.col("page_number"), m["page_number"])).alias("page_number"),
        F.round(public_score(F.col("similarity_score"), m["vector_score"], F.col("vector_score"), m["ranking_details"]["original_similarity"]), 6).alias("similarity_score"),
    )


def build_context(hits: DataFrame) -> DataFrame:
    """(question_id, context): numbered hits with their known metadata and content, in order."""
    m = F.col("metadata")
    meta = F.concat_ws(" | ", F.nullif(m["document_title"], F.lit("")), F.nullif(m["document_type"], F.lit("")), F.nullif(m["product_name"], F.lit("")))
    part = F.concat(F.lit("【相关文档"), (F.col("pos") + 1).cast("string"), F.lit("】"), F.when(meta == "", "无元数据").otherwise(meta), F.lit("\n"), F.coalesce("content", F.lit("")))
    return hits.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))


def build_prompt(curated: DataFrame, hits: DataFrame) -> DataFrame:
    """(question_id, prompt): the question and its numbered sources."""
    rows = curated.join(hits, ["question_id", "pos"])
    name = _name(F.col("document_name"), F.col("metadata.document_title"), default="未知文档")
    part = F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] 来源："), name, F.lit(" 页码："), F.coalesce("page_number", F.lit("N/A")), F.lit(" 内容："), F.coalesce("content", F.lit("")))
    return rows.groupBy("question_id").agg(F.concat(F.lit("问题："), F.coalesce(F.first("question"), F.lit("")), F.lit("\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("citation", part.alias("t")))), lambda x: x["t"]), "\n")).alias("prompt"))


def preview(hits: DataFrame, n: int = 3, chars: int = 180) -> DataFrame:
    """(question_id, preview): the first ``n`` hits as one-line snippets."""
    s = F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] "), F.substring(F.translate(F.coalesce("content", F.lit("")), "\n", " "), 1, chars))
    return hits.where(F.col("pos") < n).groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", s.alias("t")))), lambda x: x["t"]), "\n").alias("preview"))


def shown_sources(hits: DataFrame, n: int = 4) -> DataFrame:
    """What a page lists: the first hits of each question that are not scored 0 or below; unscored ones stay."""
    w = Window.partitionBy("question_id").orderBy("pos")
    score = number(F.nullif(F.trim("similarity_score"), F.lit("")))
    return hits.where(score.isNull() | (score > 0)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def best_similarity(hits: DataFrame) -> DataFrame:
    """(question_id, hits, best): number of hits and the best gate score."""
    return hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("hits"), F.round(F.max(gate()), 6).alias("best"))
