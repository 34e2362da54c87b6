"""Named queries over the core operators, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import scores, text
from docloom.operators import citations, facts, history, inlining, ops, orphans, policy, retrieval, sqlguard
from docloom.plans import answering
from docloom.sources import corpus
from docloom.streaming import streams
from docloom.tables import cut, load, shared_dir, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# problem 3: nested records to flat tables


def _shredded(spark: SparkSession, d: str, payload: bool = True) -> tuple[DataFrame, inlining.Plan]:
    history = load(spark, d, "query_history").select("id", "retrieved_chunks", "rewriting_metadata_json")
    graph = cut(inlining.schema_graph(history, ["retrieved_chunks", "rewriting_metadata_json"]))  # read several times
    plan = inlining.plan(graph)
    return inlining.shred(history, "id", plan, payload), plan


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _shredded(spark, d, payload=False)
    return rows.where(F.col("child").isin(*inlining.NAMES.values())).select(F.col("record").alias("query_id"), "child", "parent_key", "pos").distinct()


@query("p3_schema_graph")
def p3_schema_graph(spark: SparkSession, d: str) -> DataFrame:
    return inlining.schema_graph(load(spark, d, "query_history"), ["retrieved_chunks", "rewriting_metadata_json"])


def _flat(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows, plan = _shredded(spark, d)
        return inlining.flat_table(rows, plan, name).withColumnRenamed("record", "query_id")

    return run


for _name in inlining.NAMES.values():
    query(f"p3_{_name}_table")(_flat(_name))


# problem 4: references to records that do not exist

_P4_TABLES = ("document_files", "document_chunks", "document_metadata", "graph_entities", "graph_relations", "deletion_log")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references({t: load(spark, d, t) for t in _P4_TABLES})


_P4_SQL = """
WITH refs AS (
  SELECT 'document_chunks' AS child_table, 'document_id' AS ref_field, 'document_files' AS parent_table, id AS child_id, CAST(document_id AS VARCHAR) AS k, created_time AS t FROM document_chunks WHERE document_id IS NOT NULL
  UNION SELECT 'document_metadata', 'chunk_id', 'document_chunks', id, replace(lower(trim(chunk_id)), 'chunk_', ''), created_time FROM document_metadata WHERE chunk_id IS NOT NULL
  UNION SELECT 'graph_relations', 'source_entity_id', 'graph_entities', id, CAST(source_entity_id AS VARCHAR), created_time FROM graph_relations WHERE source_entity_id IS NOT NULL
  UNION SELECT 'graph_relations', 'target_entity_id', 'graph_entities', id, CAST(target_entity_id AS VARCHAR), created_time FROM graph_relations WHERE target_entity_id IS NOT NULL
), parents AS (
  SELECT 'document_files' AS parent_table, CAST(id AS VARCHAR) AS k, max(created_time) AS pt, max(CASE WHEN lower(trim(status)) = 'deleted' THEN 1 ELSE 0 END) AS gone FROM document_files GROUP BY ALL
  UNION ALL SELECT 'document_chunks', CAST(id AS VARCHAR), max(created_time), 0 FROM document_chunks GROUP BY id
  UNION ALL SELECT 'graph_entities', CAST(id AS VARCHAR), max(created_time), 0 FROM graph_entities GROUP BY id
), dels AS (SELECT DISTINCT lower(trim(table_name)) AS parent_table, replace(lower(trim(row_key)), 'chunk_', '') AS k FROM deletion_log WHERE row_key IS NOT NULL),
judged AS (
  SELECT r.child_table, r.ref_field, r.child_id, r.t,
    CASE WHEN p.k IS NULL THEN CASE WHEN d.k IS NOT NULL THEN 'deleted' ELSE 'missing' END
         WHEN p.gone = 1 THEN 'deleted' WHEN p.pt > r.t THEN 'late' END AS orphan_kind
  FROM refs r LEFT JOIN parents p ON p.parent_table = r.parent_table AND p.k = r.k
  LEFT JOIN dels d ON d.parent_table = r.parent_table AND d.k = r.k
), found AS (SELECT DISTINCT child_table, ref_field, child_id, orphan_kind, coalesce(strftime(t, '%Y-%m'), 'unknown') AS period FROM judged WHERE orphan_kind IS NOT NULL)
"""


@query("p4_found", _P4_SQL + "SELECT * FROM found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


@query("p4_report", _P4_SQL + "SELECT child_table, ref_field, orphan_kind, period, count(*) AS orphans FROM found GROUP BY ALL")
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


# retrieval

def _tokens_sql(key: str, value: str, source: str) -> str:
    """A query of (key, t): the hash tokens of a text column."""
    return f"""SELECT {key}, list_concat(list_concat(h, list_transform(range(1, greatest(CAST(len(h) AS BIGINT), 1)), lambda i: h[i] || h[i + 1])), l) AS t
FROM (SELECT {key}, regexp_extract_all(lower({value}), '[一-鿿]') AS h, regexp_extract_all(lower({value}), '[a-z0-9]+') AS l FROM {source})"""


_QUESTIONS_SQL = "questions AS (SELECT DISTINCT item_id AS question_id, question FROM eval_items)"
_CHUNKS_SQL = "chunks AS (SELECT id AS chunk_id, min(content) AS content FROM document_chunks WHERE id IS NOT NULL GROUP BY id)"
_INDEX_SQL = f"""{_CHUNKS_SQL},
toks AS ({_tokens_sql("chunk_id", "coalesce(content, '')", "chunks")}),
postings AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM toks) GROUP BY ALL),
doc_len AS (SELECT chunk_id, len(t) AS dl FROM toks),
term_df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM doc_len)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "document_chunks").where("id IS NOT NULL").select(F.col("id").alias("chunk_id"), "content")
    return spread(rows, "chunk_id").groupBy("chunk_id").agg(F.min("content").alias("content"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "eval_items").select(F.col("item_id").alias("question_id"), "question").distinct()


def _index(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return retrieval.build_lexical_index(_chunks(spark, d), "chunk_id", "content")


def _staged_index(spark: SparkSession, d: str, postings: bool = False) -> dict[str, DataFrame]:
    return retrieval.build_lexical_index(_chunks(spark, d), "chunk_id", "content", staged=True, postings_too=postings)


@query("hash_tokens", f"WITH {_CHUNKS_SQL} SELECT chunk_id, t AS tokens FROM ({_tokens_sql('chunk_id', 'content', 'chunks')}) WHERE t IS NOT NULL")
def q_hash_tokens(spark, d):
    return _chunks(spark, d).where("content IS NOT NULL").select("chunk_id", text.hash_tokens(F.col("content")).alias("tokens"))


@query(
    "hash_embed",
    f"""WITH {_CHUNKS_SQL}, t AS (SELECT chunk_id, unnest(t) AS tok FROM ({_tokens_sql('chunk_id', 'content', 'chunks')}))
SELECT chunk_id, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 384 AS idx, CAST(sum(CASE WHEN CAST(('0x' || substr(md5(tok), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS value FROM t GROUP BY ALL HAVING sum(CASE WHEN CAST(('0x' || substr(md5(tok), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) <> 0""",
)
def q_hash_embed(spark, d):
    return retrieval.hash_buckets(_chunks(spark, d), "chunk_id", "content")


@query("hash_embed_dense")
def q_hash_embed_dense(spark, d):
    return retrieval.hash_embed(_chunks(spark, d), "chunk_id", "content")


@query("bm25_stats", f"WITH {_INDEX_SQL} SELECT term, CAST(df AS BIGINT) AS df, CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl FROM term_df, stats")
def q_bm25_stats(spark, d):
    index = _index(spark, d)
    return index["term_df"].crossJoin(F.broadcast(index["stats"])).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


_BM25_SQL = f"""WITH {_QUESTIONS_SQL}, {_INDEX_SQL},
asked AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest(t) AS term FROM ({_tokens_sql("question_id", "coalesce(question, '')", "questions")})) GROUP BY ALL),
idf AS (SELECT term, ln((n + 1) / df) AS idf FROM term_df, stats),
base AS (SELECT question_id, sum(idf * qtf) AS base FROM asked JOIN idf USING (term) GROUP BY question_id),
m AS (SELECT question_id, chunk_id, sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS matched FROM asked JOIN postings USING (term) JOIN idf USING (term) JOIN doc_len USING (chunk_id), stats{{where}} GROUP BY ALL),
s AS (SELECT question_id, chunk_id, round(matched + base, 4) AS score FROM m JOIN base USING (question_id))
SELECT question_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 50"""


@query("bm25_topk", _BM25_SQL.format(where=""))
def q_bm25_topk(spark, d):
    return retrieval.bm25_topk(_questions(spark, d), _staged_index(spark, d))


@query("bm25_topk_filter", _BM25_SQL.format(where=" WHERE chunk_id IN (SELECT CAST(substr(lower(trim(chunk_id)), 7) AS BIGINT) FROM document_metadata WHERE document_type = '条款')"))
def q_bm25_filter(spark, d):
    keep = load(spark, d, "document_metadata").where("document_type = '条款'").select(orphans.key_number(F.col("chunk_id"), "chunk_").alias("chunk_id"))
    return retrieval.bm25_topk(_questions(spark, d), _staged_index(spark, d), where=keep)


@query(
    "bm25_strict",
    _BM25_SQL.format(where=" WHERE chunk_id < 60").replace("s AS (SELECT question_id, chunk_id, round(matched + base, 4) AS score FROM m JOIN base USING (question_id))", "s AS (SELECT q.question_id, c.chunk_id, round(coalesce(matched, 0) + coalesce(base, 0), 4) AS score FROM questions q CROSS JOIN (SELECT chunk_id FROM doc_len WHERE chunk_id < 60) c LEFT JOIN m USING (question_id, chunk_id) LEFT JOIN base USING (question_id))"),
)
def q_bm25_strict(spark, d):
    """A small part of the corpus, so that questions have fewer matches than places."""
    index = _staged_index(spark, d)
    return retrieval.bm25_topk(_questions(spark, d), index, where=index["doc_len"].where("chunk_id < 60"), strict=True)


@query(
    "keywords_tfidf",
    f"WITH {_INDEX_SQL}, s AS (SELECT chunk_id, term, round(tf * ln((n + 1) / df), 6) AS weight FROM postings JOIN term_df USING (term), stats) SELECT chunk_id, term, weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY weight DESC, term) AS rank FROM s) WHERE rank <= 5",
)
def q_keywords(spark, d):
    return retrieval.keywords_tfidf(_staged_index(spark, d, postings=True))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def _vector_query(metric: str = "cosine", where=None):
    def run(spark, d):
        v = _vectors(spark, d)
        asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "vector")
        return retrieval.vector_topk(asked, v, 10, metric, where, "vec_id")

    return run


def _vector_sql(score: str, where: str = "") -> str:
    return f"""WITH s AS (SELECT q.vec_id AS question_id, v.vec_id, round({score}, 5) + 0.0 AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0{where})
SELECT question_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
query("vec_topk", _vector_sql(_COS))(_vector_query())
query("vec_topk_l2", _vector_sql("0.0 - list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"))(_vector_query("l2"))
query("vec_topk_filter", _vector_sql(_COS, " AND v.label = 3"))(_vector_query(where="label = 3"))
query("vec_topk_in", _vector_sql(_COS, " AND v.label IN (1, 4, 7)"))(_vector_query(where="label IN (1, 4, 7)"))


@query(
    "rrf",
    f"""WITH a AS ({_vector_sql(_COS)}), b AS ({_vector_sql(_COS, " AND v.label IN (1, 4, 7)")}),
u AS (SELECT question_id, vec_id, rank, 0 AS list FROM a UNION ALL SELECT question_id, vec_id, rank, 1 FROM b),
f AS (SELECT question_id, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS r, min(list * 1000 + rank) AS first FROM u GROUP BY ALL)
SELECT question_id, vec_id, round(r, 6) AS rrf_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(r, 12) DESC, first) AS rank FROM f) WHERE rank <= 8""",
)
def q_rrf(spark, d):
    return retrieval.rrf(_vector_query()(spark, d), _vector_query(where="label IN (1, 4, 7)")(spark, d), top_n=8, key="vec_id")


_BUCKETS_SQL = "SELECT {key}, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 384 AS idx, sum(CASE WHEN CAST(('0x' || substr(md5(tok), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM (SELECT {key}, unnest(t) AS tok FROM {toks}) GROUP BY ALL"
_HYBRID_SQL = _BM25_SQL.format(where="").replace(
    "SELECT question_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 50",
    f""", lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 50),
qb AS ({_BUCKETS_SQL.format(key='question_id', toks=f"({_tokens_sql('question_id', 'question', 'questions')})")}), cb AS ({_BUCKETS_SQL.format(key='chunk_id', toks=f"({_tokens_sql('chunk_id', 'content', 'chunks')})")}),
qn AS (SELECT question_id, sqrt(sum(v * v)) AS nq FROM qb GROUP BY ALL), cn AS (SELECT chunk_id, sqrt(sum(v * v)) AS nc FROM cb GROUP BY ALL),
cosine AS (SELECT question_id, chunk_id, round(sum(qb.v * cb.v) / any_value(nq) / any_value(nc), 5) AS score FROM qb JOIN cb USING (idx) JOIN qn USING (question_id) JOIN cn USING (chunk_id) WHERE nq > 0 AND nc > 0 GROUP BY ALL),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM cosine) WHERE rank <= 50),
u AS (SELECT question_id, chunk_id, rank, 0 AS list, score FROM dense UNION ALL SELECT question_id, chunk_id, rank, 1, score FROM lexical),
fused AS (SELECT question_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS r, min(list * 1000 + rank) AS first, max(score) FILTER (list = 0) AS vector_score, max(score) FILTER (list = 1) AS bm25_score FROM u GROUP BY ALL)
SELECT question_id, chunk_id, round(r, 6) AS rrf_score, CAST(rank AS INTEGER) AS rank, vector_score, bm25_score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(r, 12) DESC, first) AS rank FROM fused) WHERE rank <= 8""",
)


@query("hybrid", _HYBRID_SQL)
def q_hybrid(spark, d):
    return answering.hybrid_search(_questions(spark, d), load(spark, d, "document_chunks"), "id", "content")


# hits of stored answers

_HITS_SQL = """WITH raw AS (SELECT DISTINCT id AS question_id, query AS question, retrieved_chunks AS r FROM query_history WHERE json_valid(retrieved_chunks) AND json_type(retrieved_chunks) = 'ARRAY'),
e AS (SELECT question_id, question, unnest(range(CAST(json_array_length(r) AS BIGINT))) AS pos, r FROM raw),
j AS (SELECT question_id, question, CAST(pos AS INTEGER) AS pos, json_extract(r, '$[' || pos || ']') AS c FROM e),
hits AS (SELECT question_id, question, pos, c->>'$.chunk_id' AS chunk_id, c->>'$.document_id' AS document_id, c->>'$.document_name' AS document_name, c->>'$.display_name' AS display_name, c->>'$.content' AS content, c->>'$.page_number' AS page_number,
  c->>'$.similarity_score' AS similarity_score, c->>'$.vector_score' AS vector_score, c->>'$.metadata.document_title' AS m_title, c->>'$.metadata.filename' AS m_file, c->>'$.metadata.source' AS m_source, c->>'$.metadata.display_name' AS m_display, c->>'$.metadata.page_number' AS m_page, c->>'$.metadata.document_type' AS m_type, c->>'$.metadata.product_name' AS m_product,
  c->>'$.metadata.chunk_id' AS m_chunk, c->>'$.metadata.document_id' AS m_doc, c->>'$.metadata.vector_score' AS m_vector, c->>'$.metadata.bm25_score' AS m_bm25, c->>'$.metadata.rrf_score' AS m_rrf, c->>'$.metadata.final_score' AS m_final, c->>'$.metadata.ranking_details.original_similarity' AS r_orig, c->>'$.metadata.ranking_details.final_score' AS r_final
  FROM j WHERE json_type(c) = 'OBJECT')"""


def _norm_sql(x: str) -> str:
    v = f"TRY_CAST({x} AS DOUBLE)"
    return f"(CASE WHEN {v} IS NULL OR {v} < 0 THEN 0.0::DOUBLE WHEN {v} <= 1 THEN {v} WHEN {v} <= 2 THEN greatest(0.0::DOUBLE, 1 - {v}) ELSE 1 / (1 + {v}) END)"


def _greatest_sql(*xs: str) -> str:
    return "greatest(" + ", ".join(map(_norm_sql, xs)) + ")"


_GATE = f"(CASE WHEN {_greatest_sql('r_orig', 'm_vector', 'vector_score')} > 0 THEN {_greatest_sql('r_orig', 'm_vector', 'vector_score')} ELSE {_greatest_sql('similarity_score', 'm_bm25', 'r_final', 'm_rrf')} END)"
_P = policy.Policy()


def _strip_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '^\s+', ''), '\s+$', '')"


def _hits_count_sql(x: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{w}') AS INTEGER)" for w in words) + ")"


def _clause_sql(x: str) -> str:
    return f"({_hits_count_sql(x, _P.clause)} > 0 OR regexp_matches({x}, '{_P.clause_number}'))"


def _weak_sql(x: str) -> str:
    t = _strip_sql(x)
    c, m = f"({_hits_count_sql(t, _P.clause)} + CAST({_clause_sql(t)} AS INTEGER))", _hits_count_sql(t, _P.weak_meta)
    return f"({t} = '' OR (length({t}) < 40 AND NOT {_clause_sql(t)}) OR ({m} >= 2 AND {c} <= 1 AND length({t}) < 280) OR ({m} >= 3 AND {c} = 0))"


def _bonus_sql(q: str, x: str) -> str:
    shared = " + ".join(f"CAST(contains(coalesce({q}, ''), '{w}') AND contains(coalesce({x}, ''), '{w}') AS INTEGER)" for w in _P.bonus)
    return f"(({shared}) * 0.15::DOUBLE + CAST({_clause_sql(f'coalesce({x}, {chr(39) * 2})')} AS INTEGER) * 0.05::DOUBLE - CAST({_weak_sql(x)} AS INTEGER) * 0.5::DOUBLE)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return citations.expand_hits(load(spark, d, "query_history").select("id", "query", "retrieved_chunks"))


@query("score_normalise", f"{_HITS_SQL} SELECT question_id, pos, round({_norm_sql('m_bm25')}, 6) AS bm25, round({_norm_sql('similarity_score')}, 6) AS similarity FROM hits")
def q_score_normalise(spark, d):
    return _hits(spark, d).select("question_id", "pos", F.round(scores.normalise_score(F.col("metadata.bm25_score")), 6).alias("bm25"), F.round(scores.normalise_score(F.col("similarity_score")), 6).alias("similarity"))


@query("display_score", f"{_HITS_SQL} SELECT question_id, pos, round(coalesce(nullif(TRY_CAST(r_orig AS DOUBLE), 0), nullif(TRY_CAST(m_vector AS DOUBLE), 0), nullif(TRY_CAST(m_rrf AS DOUBLE), 0), nullif(TRY_CAST(m_bm25 AS DOUBLE), 0), 0), 6) AS shown FROM hits")
def q_display(spark, d):
    m = F.col("metadata")
    return _hits(spark, d).select("question_id", "pos", F.round(scores.display_score(m["ranking_details"]["original_similarity"], m["vector_score"], m["rrf_score"], m["bm25_score"]), 6).alias("shown"))


@query("metadata_filter", "SELECT DISTINCT id FROM document_metadata WHERE coalesce(trim(document_type), 'None') = '条款' AND status IN ('active', '演示') UNION SELECT DISTINCT id FROM document_metadata WHERE coalesce(trim(product_name), 'None') = 'None'")
def q_metadata_filter(spark, d):
    m = load(spark, d, "document_metadata")
    one = m.where(retrieval.metadata_filter({"document_type": " 条款 ", "status": {"$in": ["active", "演示"]}}, m.columns))
    return one.select("id").unionByName(m.where(retrieval.metadata_filter({"product_name": None}, m.columns)).select("id")).distinct()


@query("gate_score", f"{_HITS_SQL} SELECT question_id, pos, round({_GATE}, 6) AS gate FROM hits")
def q_gate_score(spark, d):
    return _hits(spark, d).select("question_id", "pos", F.round(citations.gate(), 6).alias("gate"))


@query("best_similarity", f"{_HITS_SQL} SELECT question_id, count(*) AS hits, round(max({_GATE}), 6) AS best FROM hits GROUP BY question_id")
def q_best(spark, d):
    return citations.best_similarity(_hits(spark, d))


@query("weak_flag", f"SELECT DISTINCT id, {_weak_sql('content')} AS weak FROM document_chunks")
def q_weak(spark, d):
    return load(spark, d, "document_chunks").select("id", policy.weak(F.col("content")).alias("weak")).distinct()


@query("relevance_bonus", f"{_HITS_SQL} SELECT question_id, pos, round({_bonus_sql('question', 'content')}, 4) AS bonus FROM hits")
def q_bonus(spark, d):
    return _hits(spark, d).select("question_id", "pos", F.round(policy.relevance_bonus(F.col("question"), F.col("content")), 4).alias("bonus"))


_RAW = "greatest(coalesce(TRY_CAST(similarity_score AS DOUBLE), 0.0), " + ", ".join(f"coalesce(TRY_CAST({c} AS DOUBLE), '-inf'::DOUBLE)" for c in ("m_rrf", "m_final", "m_bm25", "m_vector")) + ")"
_CURATE_SQL = f"""{_HITS_SQL}, sc AS (SELECT question_id, pos, {_weak_sql('content')} AS weak, round({_RAW} + {_bonus_sql('question', 'content')} - CAST({_weak_sql('content')} AS INTEGER), 6) AS score,
  lower(trim(coalesce(nullif(coalesce(nullif(document_name, ''), nullif(m_title, ''), nullif(m_file, ''), nullif(m_display, ''), '未知文档'), ''), 'unknown'))) || '|' || coalesce(page_number, m_page, 'None') AS page_key, substr({_strip_sql('content')}, 1, 48) AS prefix FROM hits),
pool AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pos) AS rn FROM sc s WHERE NOT weak OR NOT EXISTS (SELECT 1 FROM sc t WHERE t.question_id = s.question_id AND NOT t.weak)),
fold(question_id, rn, pages, prefixes, kept) AS (
  SELECT question_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS INTEGER[]) FROM (SELECT DISTINCT question_id FROM pool)
  UNION ALL
  SELECT question_id, prn, CASE WHEN ok THEN list_append(pages, page_key) ELSE pages END, CASE WHEN ok AND prefix <> '' THEN list_append(prefixes, prefix) ELSE prefixes END, CASE WHEN ok THEN list_append(kept, pos) ELSE kept END
  FROM (SELECT f.question_id, f.pages, f.prefixes, f.kept, p.rn AS prn, p.page_key, p.prefix, p.pos, len(f.kept) < 4 AND NOT list_contains(f.pages, p.page_key) AND NOT (p.prefix <> '' AND list_contains(f.prefixes, p.prefix)) AS ok FROM fold f JOIN pool p ON p.question_id = f.question_id AND p.rn = f.rn + 1) x),
done AS (SELECT question_id, arg_max(kept, rn) AS kept FROM fold GROUP BY question_id),
ex AS (SELECT question_id, unnest(kept) AS pos, generate_subscripts(kept, 1) AS citation FROM done)
SELECT question_id, CAST(citation AS INTEGER) AS citation, ex.pos, score FROM ex JOIN sc USING (question_id, pos)"""


@query("curate", _CURATE_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1))
def q_curate(spark, d):
    return citations.curate(_hits(spark, d))


_PUBLIC_SQL = f"SELECT question_id, pos, round(least(1.0, greatest(0.0, {_GATE})), 4) AS public FROM hits WHERE {_GATE} > FLOOR AND NOT {_weak_sql('content')}"


@query("public_citations", f"{_HITS_SQL} {_PUBLIC_SQL.replace('FLOOR', '0')}")
def q_public(spark, d):
    return citations.public_citations(_hits(spark, d)).select("question_id", "pos", "public")


_ADVICE_SQL = " OR ".join(f"contains(trim(coalesce({{q}}, '')), '{w}')" for w in _P.advice)
_TOPIC_SQL = " OR ".join(f"contains(trim(coalesce({{q}}, '')), '{w}')" for w in _P.on_topic)
_CHAT_SQL = " OR ".join(f"contains(trim(coalesce({{q}}, '')), '{w}')" for w in _P.chitchat)
_OFF_SQL = f"(CASE WHEN {_TOPIC_SQL} THEN false WHEN {_CHAT_SQL} THEN true WHEN coalesce(hits, 0) = 0 THEN true ELSE length(trim(coalesce({{q}}, ''))) < 40 AND NOT regexp_matches(trim(coalesce({{q}}, '')), '[{_P.topic_characters}]') END)"
_KIND_CTE = f"""{_HITS_SQL}, b AS (SELECT question_id, count(*) AS hits, round(max({_GATE}), 6) AS best FROM hits GROUP BY question_id),
q AS (SELECT DISTINCT id AS question_id, query AS question FROM query_history),
kinds AS (SELECT question_id, CASE WHEN {_ADVICE_SQL.format(q='question')} THEN 'advice' WHEN {_OFF_SQL.format(q='question')} OR coalesce(hits, 0) = 0 OR coalesce(best, 0) < 0.32 THEN 'refusal' ELSE 'answer' END AS kind, hits, best, question FROM q LEFT JOIN b USING (question_id))"""


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "query_history").select(F.col("id").alias("question_id"), F.col("query").alias("question")).distinct()
    return q.join(citations.best_similarity(_hits(spark, d)), "question_id", "left").withColumn("kind", policy.answer_kind(F.col("question"), F.col("hits"), F.col("best")))


@query("answer_kind", f"{_KIND_CTE} SELECT question_id, kind FROM kinds")
def q_kind(spark, d):
    return _kinds(spark, d).select("question_id", "kind")


@query("citations_for_kind", f"{_KIND_CTE} {_PUBLIC_SQL.replace('FLOOR', '0.05')} AND question_id IN (SELECT question_id FROM kinds WHERE kind = 'answer')")
def q_for_kind(spark, d):
    return citations.citations_for_kind(_hits(spark, d), _kinds(spark, d)).select("question_id", "pos", "public")


@query("advice_gate", f"SELECT DISTINCT id, ({_ADVICE_SQL.format(q='query')}) AS advice FROM query_history")
def q_advice(spark, d):
    return load(spark, d, "query_history").select("id", policy.advice_question(F.col("query")).alias("advice")).distinct()


@query("offtopic_gate", f"{_KIND_CTE} SELECT question_id, {_OFF_SQL.format(q='question')} AS off_topic FROM kinds")
def q_offtopic(spark, d):
    return _kinds(spark, d).select("question_id", policy.off_topic(F.col("question"), F.col("hits")).alias("off_topic"))


def _id_sql(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN '-1' WHEN regexp_full_match(trim({x}), '-?[0-9]+') THEN coalesce(CAST(TRY_CAST(trim({x}) AS BIGINT) AS VARCHAR), trim({x})) ELSE trim({x}) END)"


@query(
    "shape",
    f"""{_HITS_SQL} SELECT question_id, pos, {_id_sql('coalesce(chunk_id, m_chunk)')} AS chunk_id, {_id_sql('coalesce(document_id, m_doc)')} AS document_id,
coalesce(nullif(display_name, ''), nullif(document_name, ''), nullif(m_display, ''), nullif(m_title, ''), nullif(m_file, ''), '未知文档') AS document_name, coalesce(content, '') AS content,
CASE WHEN regexp_full_match(trim(coalesce(page_number, m_page)), '-?[0-9]{{1,9}}') THEN TRY_CAST(trim(coalesce(page_number, m_page)) AS INTEGER) END AS page_number,
round(coalesce(nullif({_norm_sql('similarity_score')}, 0), nullif({_norm_sql('m_vector')}, 0), nullif({_norm_sql('vector_score')}, 0), nullif({_norm_sql('r_orig')}, 0), 0), 6) AS similarity_score FROM hits""",
)
def q_shape(spark, d):
    return citations.shape(_hits(spark, d))


_META_SQL = "concat_ws(' | ', nullif(m_title, ''), nullif(m_type, ''), nullif(m_product, ''))"


@query("context", f"{_HITS_SQL} SELECT question_id, string_agg('【相关文档' || (pos + 1) || '】' || CASE WHEN {_META_SQL} = '' THEN '无元数据' ELSE {_META_SQL} END || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY pos) AS context FROM hits GROUP BY question_id")
def q_context(spark, d):
    return citations.build_context(_hits(spark, d))


@query("preview", f"{_HITS_SQL} SELECT question_id, string_agg('[' || (pos + 1) || '] ' || substr(replace(coalesce(content, ''), chr(10), ' '), 1, 180), chr(10) ORDER BY pos) AS preview FROM hits WHERE pos < 3 GROUP BY question_id")
def q_preview(spark, d):
    return citations.preview(_hits(spark, d))


@query(
    "prompt",
    _CURATE_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1).replace("SELECT question_id, CAST(citation AS INTEGER) AS citation, ex.pos, score FROM ex JOIN sc USING (question_id, pos)", "")
    + """SELECT question_id, '问题：' || coalesce(question, '') || chr(10) || string_agg('[' || citation || '] 来源：' || coalesce(nullif(document_name, ''), nullif(m_title, ''), '未知文档') || ' 页码：' || coalesce(page_number, 'N/A') || ' 内容：' || coalesce(content, ''), chr(10) ORDER BY citation) AS prompt FROM ex JOIN hits USING (question_id, pos) GROUP BY question_id, question""",
)
def q_prompt(spark, d):
    hits = _hits(spark, d)
    return citations.build_prompt(citations.curate(hits), hits)


_ANSWERS_SQL = _CURATE_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1).replace("SELECT question_id, CAST(citation AS INTEGER) AS citation, ex.pos, score FROM ex JOIN sc USING (question_id, pos)", "") + f""", cur AS (SELECT hits.*, citation FROM ex JOIN hits USING (question_id, pos)),
b AS (SELECT question_id, count(*) AS hits, round(max({_GATE}), 6) AS best FROM cur GROUP BY question_id), pub AS (SELECT question_id, count(*) AS cites FROM cur WHERE {_GATE} > 0.05 AND NOT {_weak_sql('content')} GROUP BY question_id),
q AS (SELECT DISTINCT id AS question_id, query AS question FROM query_history),
k AS (SELECT q.*, hits, best, CASE WHEN {_ADVICE_SQL.format(q='question')} THEN 'advice' WHEN {_OFF_SQL.format(q='question')} OR coalesce(hits, 0) = 0 OR coalesce(best, 0) < 0.32 THEN 'refusal' ELSE 'answer' END AS kind FROM q LEFT JOIN b USING (question_id))
SELECT question_id, kind, CASE kind WHEN 'answer' THEN 0.9::DOUBLE WHEN 'advice' THEN 0.0::DOUBLE ELSE round(coalesce(best, 0), 4)::DOUBLE END AS confidence, CAST(CASE WHEN kind = 'answer' THEN coalesce(cites, 0) ELSE 0 END AS INTEGER) AS citations FROM k LEFT JOIN pub USING (question_id)"""


@query("answers", _ANSWERS_SQL)
def q_answers(spark, d):
    hits = _hits(spark, d)
    q = load(spark, d, "query_history").select(F.col("id").alias("question_id"), F.col("query").alias("question")).distinct()
    return answering.answer(q, citations.curate(hits).drop("score").join(hits, ["question_id", "pos"])).select("question_id", "kind", "confidence", F.size("citations").alias("citations"))


@query("ask")
def q_ask(spark, d):
    """All evaluation questions through the whole plan, over an index that is written and opened again."""
    folder = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    rows = load(spark, d, "document_chunks")
    retrieval.write_index(rows, "id", "content", folder)
    files = load(spark, d, "document_files").groupBy(F.col("id").alias("document_id")).agg(F.min("original_name").alias("document_name"))
    kinds = load(spark, d, "document_metadata").select(orphans.key_number(F.col("chunk_id"), "chunk_").alias("chunk_id"), "document_type", "product_name").where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min("document_type").alias("document_type"), F.min("product_name").alias("product_name"))
    chunks = rows.where("id IS NOT NULL").groupBy(F.col("id").alias("chunk_id")).agg(F.min(F.struct("document_id", "page_number", "content")).alias("c")).select("chunk_id", "c.*").join(files, "document_id", "left").join(kinds, "chunk_id", "left")
    q = _questions(spark, d)
    told = facts.facts_for(q, load(spark, d, "graph_entities"), load(spark, d, "graph_relations"), load(spark, d, "document_metadata"), "covers")
    return answering.ask(q, retrieval.open_index(spark, folder), chunks, told).select("question_id", "kind", "confidence", F.size("citations").alias("citations"), "answer")


# history

ANCHOR = datetime(2022, 7, 1)
_DAYS = 90
_SINCE = f"TIMESTAMP '{ANCHOR.isoformat(sep=' ')}' - INTERVAL {_DAYS} DAY"


def _history(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "query_history").distinct()


_H = "(SELECT DISTINCT * FROM query_history)"


@query("history_page", f"SELECT id, query, model_used FROM {_H} WHERE model_used = 'claims' ORDER BY created_time DESC NULLS LAST, id DESC LIMIT 50 OFFSET 20")
def q_page(spark, d):
    return history.history_page(_history(spark, d), 20, 50, query_type="claims").select("id", "query", "model_used")


@query("history_count", f"SELECT count(*) AS total FROM {_H} WHERE model_used = 'claims' AND created_time <= TIMESTAMP '{ANCHOR.isoformat(sep=' ')}'")
def q_count(spark, d):
    return history.history_count(_history(spark, d), query_type="claims", end=ANCHOR)


@query(
    "history_json",
    f"""SELECT DISTINCT id, coalesce(CASE WHEN ok THEN CAST(json_array_length(CASE WHEN ok THEN retrieved_chunks END) AS INTEGER) END, 0) AS chunks_used,
coalesce(CASE WHEN ok THEN TRY_CAST(json_extract_string(retrieved_chunks, '$[0].ranking_details.final_score') AS DOUBLE) END, CASE WHEN ok THEN TRY_CAST(json_extract_string(retrieved_chunks, '$[0].similarity_score') AS DOUBLE) END) AS top_score
FROM (SELECT *, CASE WHEN json_valid(retrieved_chunks) THEN json_type(retrieved_chunks) = 'ARRAY' ELSE false END AS ok FROM {_H})""",
)
def q_history_json(spark, d):
    return history.expand_history(_history(spark, d))


@query("suggest", f"SELECT suggestion, CAST(min(source) AS INTEGER) AS source FROM (SELECT DISTINCT query AS suggestion, 0 AS source FROM {_H} WHERE contains(query, '等待期') UNION ALL SELECT '等待期是多久？', 1) GROUP BY suggestion ORDER BY source, suggestion LIMIT 20")
def q_suggest(spark, d):
    return history.suggest(_history(spark, d), "等待期", 20, ("等待期是多久？", "犹豫期多少天？"))


@query(
    "stats_overall",
    f"""SELECT count(*) FILTER (created_time >= {_SINCE}) AS total_queries, count(*) FILTER (CAST(created_time AS DATE) = DATE '{ANCHOR.date()}') AS today_queries,
round(coalesce(avg(response_time) FILTER (created_time >= {_SINCE}), 0), 3) AS avg_response_time, round(coalesce(avg(rating) FILTER (created_time >= {_SINCE}), 0), 2) AS avg_rating,
round(count(*) FILTER (created_time >= {_SINCE}) / {_DAYS}::DOUBLE, 2) AS queries_per_day FROM {_H}""",
)
def q_stats(spark, d):
    return history.query_statistics(_history(spark, d), ANCHOR, _DAYS)


@query("stats_type", f"SELECT model_used, count(model_used) AS typed, count(id) AS queries, round(avg(response_time), 3) AS avg_time FROM {_H} WHERE created_time >= {_SINCE} GROUP BY model_used")
def q_type(spark, d):
    return history.by_type(_history(spark, d), ANCHOR, _DAYS)


@query("rating_hist", f"SELECT rating, count(*) AS n FROM {_H} WHERE created_time >= {_SINCE} AND rating IS NOT NULL GROUP BY rating")
def q_ratings(spark, d):
    return history.ratings(_history(spark, d), ANCHOR, _DAYS)


@query("daily", f"SELECT CAST(created_time AS DATE) AS day, count(*) AS queries, round(avg(response_time), 3) AS avg_time FROM {_H} WHERE created_time >= {_SINCE} GROUP BY 1")
def q_daily(spark, d):
    return history.daily(_history(spark, d), ANCHOR, _DAYS)


@query("frequent", f"SELECT CASE WHEN length(query) > 100 THEN substr(query, 1, 100) || '...' ELSE query END AS question, n FROM (SELECT query, count(*) AS n FROM {_H} WHERE created_time >= {_SINCE} AND query IS NOT NULL GROUP BY query ORDER BY n DESC, query LIMIT 10)")
def q_frequent(spark, d):
    return history.frequent(_history(spark, d), ANCHOR, _DAYS)


_TURNS_SQL = f"t AS (SELECT session_id, id, query, response, row_number() OVER (PARTITION BY session_id ORDER BY created_time DESC NULLS LAST, id DESC) AS back FROM (SELECT DISTINCT session_id, id, query, response, created_time FROM query_history) WHERE session_id IS NOT NULL)"


@query("chat_last_n", f"WITH {_TURNS_SQL} SELECT session_id, id, CAST(back AS INTEGER) AS back FROM t WHERE back <= 10")
def q_chat(spark, d):
    return history.last_turns(_history(spark, d)).select("session_id", "id", "back")


@query("transcript", f"WITH {_TURNS_SQL}, x AS (SELECT session_id, string_agg('用户: ' || coalesce(query, '') || chr(10) || '助理: ' || coalesce(response, ''), chr(10) ORDER BY back DESC) AS s FROM t WHERE back <= 10 GROUP BY session_id) SELECT session_id, CASE WHEN length(s) > 4000 THEN substr(s, length(s) - 3999) ELSE s END AS transcript FROM x")
def q_transcript(spark, d):
    return history.transcript(history.last_turns(_history(spark, d)))


@query("retention", f"SELECT id FROM {_H} WHERE created_time >= {_SINCE} OR created_time IS NULL")
def q_retention(spark, d):
    return history.retain(_history(spark, d), ANCHOR, _DAYS).select("id")


@query("feedback", f"SELECT id, CASE WHEN cost > 0.04 THEN 2 ELSE rating END AS rating, CASE WHEN cost > 0.04 THEN 'dear' ELSE feedback END AS feedback FROM {_H}")
def q_feedback(spark, d):
    h = _history(spark, d)
    updates = h.where("cost > 0.04").select("id", F.lit(2).alias("rating"), F.lit("dear").alias("comment")).unionByName(h.select("id", F.lit(9).alias("rating"), F.lit("out of range").alias("comment")))
    return history.apply_feedback(h, updates).select("id", "rating", "feedback")


@query("delete", f"SELECT id FROM {_H} WHERE id NOT IN (SELECT id FROM query_history WHERE rating = 1)")
def q_delete(spark, d):
    h = _history(spark, d)
    return history.delete_by_id(h, h.where("rating = 1")).select("id")


# texts


@query("excerpt", r"""SELECT DISTINCT id, CASE WHEN length(b) > 180 THEN substr(b, 1, 180) || '…' ELSE b END AS excerpt FROM (SELECT id, trim(regexp_replace(trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g')), '^(?:文档名称|产品名称|文档类型|生效日期|状态)[：:][^。；;]{0,40}[。；;\s]*', '')) AS b FROM document_chunks)""")
def q_excerpt(spark, d):
    return load(spark, d, "document_chunks").select("id", text.excerpt(F.col("content")).alias("excerpt")).distinct()


@query("needle", r"""WITH f AS (SELECT DISTINCT id, trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g')) AS flat FROM document_chunks),
p AS (SELECT id, flat, list_filter(list_transform(regexp_split_to_array(flat, '[。；;!?！？\n]'), lambda x: trim(x)), lambda x: length(x) BETWEEN 8 AND 48) AS l FROM f)
SELECT DISTINCT id, CASE WHEN len(l) > 0 THEN list_filter(l, lambda x: length(x) = list_max(list_transform(l, lambda y: length(y))))[1] ELSE substr(flat, 1, 36) END AS needle FROM p""")
def q_needle(spark, d):
    return load(spark, d, "document_chunks").select("id", text.needle(F.col("content")).alias("needle")).distinct()


@query("cite_parse", r"SELECT DISTINCT id, CASE WHEN n BETWEEN 1 AND 4 THEN n ELSE 1 END AS first_cite, regexp_replace(response, '\[(\d{1,3})\]', '<cite n=\1>', 'g') AS linked FROM (SELECT id, response, TRY_CAST(regexp_extract(coalesce(response, ''), '\[(\d{1,3})\]', 1) AS INTEGER) AS n FROM query_history)")
def q_cite(spark, d):
    return load(spark, d, "query_history").select("id", text.first_citation(F.col("response"), F.lit(4)).alias("first_cite"), text.link_citations(F.col("response")).alias("linked")).distinct()


@query("answer_sections", r"""WITH s AS (SELECT DISTINCT id, coalesce(response, '') AS t FROM query_history), l AS (SELECT id, regexp_extract_all(t, '【([^】]+)】', 1) AS titles, regexp_extract_all(t, '】([^【]*)', 1) AS bodies FROM s),
e AS (SELECT id, titles, bodies, unnest(range(len(titles))) AS n FROM l WHERE len(titles) >= 2)
SELECT DISTINCT id, CAST(n AS INTEGER) AS n, CASE WHEN contains(titles[n + 1], '结论') THEN 'conclusion' WHEN contains(titles[n + 1], '依据') THEN 'evidence' WHEN contains(titles[n + 1], '边界') THEN 'boundary' ELSE titles[n + 1] END AS title, regexp_replace(regexp_replace(bodies[n + 1], '^\s+', ''), '\s+$', '') AS body FROM e""")
def q_sections(spark, d):
    return load(spark, d, "query_history").select("id", F.posexplode(text.answer_sections(F.col("response"))).alias("n", "s")).select("id", "n", "s.title", "s.body").distinct()


@query("locate_excerpt", f"{_HITS_SQL}, c AS (SELECT id, min(content) AS page FROM document_chunks GROUP BY id) SELECT question_id, pos, CAST(CASE WHEN coalesce(content, '') = '' THEN 0 WHEN strpos(page, content) > 0 THEN strpos(page, content) ELSE strpos(page, substr(content, 1, 12)) END AS INTEGER) AS place FROM hits JOIN c ON CAST(c.id AS VARCHAR) = replace(lower(trim(chunk_id)), 'chunk_', '')")
def q_locate(spark, d):
    pages = load(spark, d, "document_chunks").groupBy("id").agg(F.min("content").alias("page"))
    hits = _hits(spark, d).select("question_id", "pos", "content", orphans.key_number(F.col("chunk_id"), "chunk_").alias("id"))
    return hits.join(pages, "id").select("question_id", "pos", text.locate_excerpt(F.col("page"), F.col("content")).cast("int").alias("place"))


@query("kg_terms", r"""SELECT DISTINCT id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:6] AS terms FROM (SELECT id, list_filter(regexp_extract_all(trim(query), '[\p{L}\p{N}]+'), lambda x: length(x) >= 2 OR contains(x, '险')) AS l FROM query_history)""")
def q_terms(spark, d):
    return load(spark, d, "query_history").select("id", text.query_terms(F.col("query")).alias("terms")).distinct()


_REWRITE_SQL = r"""WITH t AS (SELECT DISTINCT id, query, rewriting_metadata_json AS r FROM query_history WHERE rewriting_metadata_json IS NOT NULL),
b AS (SELECT id, query, CASE WHEN regexp_matches(r, '(?s)```.*?```') THEN regexp_replace(regexp_replace(regexp_extract(r, '(?s)```(?:json)?(.*?)```', 1), '^\s+', ''), '\s+$', '') ELSE trim(r) END AS body FROM t),
j AS (SELECT id, query, CASE WHEN json_valid(body) THEN body WHEN json_valid(regexp_extract(body, '(?s)\{.*\}', 0)) THEN regexp_extract(body, '(?s)\{.*\}', 0) END AS j FROM b)"""


@query("rewrite_json", _REWRITE_SQL + " SELECT DISTINCT id, coalesce(nullif(j->>'$.independent_query', ''), nullif(j->>'$.rewritten_query', ''), nullif(j->>'$.original_query', ''), query) AS rewritten, j->>'$.route' AS route FROM j WHERE j IS NOT NULL")
def q_rewrite(spark, d):
    h = load(spark, d, "query_history").select("id", "query", text.json_object(F.col("rewriting_metadata_json")).alias("j")).where("j IS NOT NULL").distinct()
    return h.select("id", F.coalesce(F.nullif(F.get_json_object("j", "$.independent_query"), F.lit("")), F.nullif(F.get_json_object("j", "$.rewritten_query"), F.lit("")), F.nullif(F.get_json_object("j", "$.original_query"), F.lit("")), "query").alias("rewritten"), F.get_json_object("j", "$.route").alias("route"))


ONTOLOGY = {"免赔额": ("自付额", "起付线"), "犹豫期": ("冷静期",), "等待期": ("观察期",), "退保": ("解除合同",), "理赔": ("赔付", "索赔")}


_SYNONYMS_SQL = " || ".join(f"CASE WHEN contains(question, '{t}') THEN {list(s)} ELSE [] END" for t, s in ONTOLOGY.items())


@query(
    "rewrite_vectors",
    r"""WITH t AS (SELECT DISTINCT id, rewriting_metadata_json AS r FROM query_history WHERE json_valid(rewriting_metadata_json)), v AS (SELECT id, json_extract(r, '$.query_vectors') AS l FROM t WHERE json_type(r) = 'OBJECT' AND json_type(r, '$.query_vectors') = 'ARRAY'),
e AS (SELECT id, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS n, l FROM v), j AS (SELECT id, n, json_extract(l, '$[' || n || ']') AS x FROM e)
SELECT id, CAST(n AS INTEGER) AS pos, CASE WHEN json_type(x) = 'VARCHAR' THEN '变体' ELSE coalesce(nullif(x->>'$.title', ''), nullif(x->>'$.vector_type', ''), '变体') END AS title, CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' ELSE coalesce(nullif(x->>'$.query', ''), nullif(x->>'$.text', ''), '') END AS query FROM j WHERE json_type(x) IN ('VARCHAR', 'OBJECT')""",
)
def q_rewrite_vectors(spark, d):
    h = load(spark, d, "query_history").select("id", "rewriting_metadata_json").distinct()
    return h.select("id", F.posexplode(text.query_vectors(F.col("rewriting_metadata_json"))).alias("pos", "v")).where("v IS NOT NULL").select("id", "pos", "v.title", "v.query")


@query("synonym_expand", f"SELECT DISTINCT id, question, {_SYNONYMS_SQL} AS synonyms FROM (SELECT id, query AS question FROM query_history)")
def q_synonyms(spark, d):
    q = load(spark, d, "query_history").select("id", F.col("query").alias("question")).distinct()
    return facts.expand_synonyms(q, ONTOLOGY)


@query(
    "question_route",
    """WITH q AS (SELECT DISTINCT id, coalesce(query, '') AS q FROM query_history), i AS (SELECT id, q, CASE WHEN regexp_matches(q, '(?i)区别|对比|比较|compare|difference') THEN 'comparison' WHEN regexp_matches(q, '(?i)理赔|报销|claim|材料') THEN 'claims' WHEN regexp_matches(q, '(?i)责任|免赔|等待期|犹豫期|保障|cover|waiting period') THEN 'coverage' ELSE 'general' END AS intent FROM q)
SELECT DISTINCT id, CASE WHEN regexp_matches(q, '(?i)多少(?:个|款|种|条)产品|有哪些产品|统计|how many (?:products|documents)|list all') THEN 'SQL' ELSE 'RAG' END AS route, intent, CASE intent WHEN 'coverage' THEN '条款' WHEN 'claims' THEN '理赔' WHEN 'comparison' THEN '说明书' END AS document_type, CASE WHEN trim(q) = '' THEN 'blank' WHEN length(trim(q)) > 1000 THEN 'too_long' END AS error FROM i""",
)
def q_route(spark, d):
    q = load(spark, d, "query_history").select("id", "query").distinct()
    return q.select("id", answering.route(F.col("query")).alias("route"), answering.intent(F.col("query")).alias("intent"), answering.intent_filter(answering.intent(F.col("query"))).alias("document_type"), policy.question_error(F.col("query")).alias("error"))


# chunks and corpus


@query(
    "chunk_fixed",
    "WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''), s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 40, 1), 360)) AS start FROM t) SELECT doc_id, CAST(start / 360 AS INTEGER) AS idx, substr(text, start + 1, 400) AS piece FROM s",
)
def q_fixed(spark, d):
    return corpus.fixed_chunks(load(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text")


@query("chunk_recursive")
def q_recursive(spark, d):
    return corpus.recursive_chunks(load(spark, d, "documents").select("doc_id", "text").distinct(), "doc_id", "text")


@query("chunk_ids", "SELECT DISTINCT id, substr(sha1(coalesce(vector_id, '') || '|' || coalesce(CAST(page_number AS VARCHAR), '') || '|' || CAST(coalesce(chunk_index, 0) AS VARCHAR) || '|' || substr(coalesce(content, ''), 1, 80)), 1, 16) AS chunk_key FROM document_chunks")
def q_ids(spark, d):
    return load(spark, d, "document_chunks").select("id", corpus.chunk_key(F.col("vector_id"), F.col("page_number"), F.coalesce("chunk_index", F.lit(0)), F.coalesce("content", F.lit(""))).alias("chunk_key")).distinct()


@query("corpus_scan", "SELECT DISTINCT id, length(content) AS n_chars, lower(substr(coalesce(content, ''), 1, 20)) AS head FROM document_chunks WHERE page_number = 1")
def q_scan(spark, d):
    return load(spark, d, "document_chunks").where("page_number = 1").select("id", F.char_length("content").cast("bigint").alias("n_chars"), F.lower(F.substring(F.coalesce("content", F.lit("")), 1, 20)).alias("head")).distinct()


@query(
    "corpus_manifest",
    r"""WITH c AS (SELECT DISTINCT id, document_id, page_number, content FROM document_chunks), f AS (SELECT id, max(coalesce(nullif(trim(original_name), ''), regexp_replace(regexp_replace(filename, '^.*[/\\]', ''), '\.[^.]+$', ''))) AS display_name FROM document_files GROUP BY id)
SELECT document_id, coalesce(display_name, '未知文档') AS display_name, count(DISTINCT CASE WHEN trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g')) <> '' THEN page_number END) AS pages, count(DISTINCT c.id) AS chunk_count FROM c LEFT JOIN f ON f.id = c.document_id GROUP BY document_id, display_name""",
)
def q_manifest(spark, d):
    return ops.manifest(load(spark, d, "document_chunks"), load(spark, d, "document_files"))


@query("catalog_union", "WITH u AS (SELECT lower(trim(original_name)) AS name, 0 AS r FROM document_files UNION ALL SELECT lower(trim(product_name)), 1 FROM documents) SELECT name, CASE WHEN min(r) = 0 THEN 'files' ELSE 'corpus' END AS origin FROM u WHERE name IS NOT NULL AND name <> '' GROUP BY name")
def q_catalog(spark, d):
    return ops.catalogue(load(spark, d, "document_files"), load(spark, d, "documents"))


@query(
    "doc_stats",
    """WITH f AS (SELECT id, any_value(status) AS status, any_value(file_size) AS file_size FROM document_files GROUP BY id), a AS (SELECT count(*) AS documents, count(*) FILTER (lower(trim(status)) = 'active') AS active_documents, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size, round(coalesce(avg(file_size), 0), 2) AS avg_size FROM f), b AS (SELECT count(DISTINCT id) AS chunks FROM document_chunks)
SELECT *, round(active_documents / greatest(documents, 1) * 100, 2) AS processing_rate, round(chunks / greatest(active_documents, 1), 2) AS chunks_per_document FROM a, b""",
)
def q_doc_stats(spark, d):
    return ops.document_statistics(load(spark, d, "document_files"), load(spark, d, "document_chunks"))


@query("status_breakdown", "SELECT coalesce(lower(trim(status)), 'unknown') AS status, count(DISTINCT id) AS n FROM document_files GROUP BY 1")
def q_status(spark, d):
    return ops.status_breakdown(load(spark, d, "document_files"))


@query("recent_documents", "SELECT DISTINCT id, original_name, status FROM (SELECT DISTINCT id, original_name, status, created_time FROM document_files ORDER BY created_time DESC NULLS LAST, id DESC LIMIT 10)")
def q_recent(spark, d):
    return ops.recent_documents(load(spark, d, "document_files")).select("id", "original_name", "status")


@query("system_totals", f"SELECT (SELECT count(DISTINCT id) FROM document_files) AS documents, CAST((SELECT coalesce(sum(s), 0) FROM (SELECT id, any_value(file_size) AS s FROM document_files GROUP BY id)) AS BIGINT) AS storage_bytes, (SELECT count(DISTINCT id) FROM document_chunks) AS chunks, (SELECT count(*) FROM {_H}) AS queries, (SELECT round(coalesce(avg(response_time), 0), 3) FROM {_H}) AS avg_response_time")
def q_totals(spark, d):
    return ops.system_totals(load(spark, d, "document_files"), load(spark, d, "document_chunks"), _history(spark, d))


_METRIC_ANCHOR = datetime(2024, 1, 20)


@query("metrics", "WITH m AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 240 HOUR AND ts <= TIMESTAMP '2024-01-20') SELECT round(avg(nullif(value, 0)), 4) AS avg_value, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / greatest(count(*), 1) * 100, 2) AS error_rate FROM m")
def q_metrics(spark, d):
    return ops.metric_summary(load(spark, d, "events"), _METRIC_ANCHOR, 240)


@query("metrics_range", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-20'")
def q_range(spark, d):
    return ops.metrics_range(load(spark, d, "events"), _METRIC_ANCHOR, 24).select("event_id", "event_type")


# facts and guarded SQL

_KG_QUESTION = "医疗 年金保险？"


@query(
    "kg_facts",
    """WITH t AS (SELECT product_name, coalesce(document_type, '未知') AS document_type, count(id) AS n, min(effective_date) AS f FROM document_metadata WHERE product_name <> '' AND (contains(lower(product_name), '医疗') OR contains(lower(product_name), '年金保险')) GROUP BY ALL),
p AS (SELECT product_name, max(n) AS most, string_agg(document_type || '(' || n || '块)', ', ' ORDER BY document_type) AS types, CAST(sum(n) AS BIGINT) AS chunks, min(f) AS min_effective FROM t GROUP BY product_name ORDER BY most DESC, product_name LIMIT 6) SELECT product_name, types, chunks, min_effective FROM p""",
)
def q_kg_facts(spark, d):
    return facts.metadata_facts(load(spark, d, "document_metadata"), facts.terms_of(_KG_QUESTION))


@query(
    "kg_graph",
    """WITH e AS (SELECT DISTINCT id, name, lower(trim(entity_type)) AS kind FROM graph_entities), p AS (SELECT id, name FROM e WHERE kind = 'product' AND (contains(lower(name), '医疗') OR contains(lower(name), '年金保险')) ORDER BY id LIMIT 6),
r AS (SELECT DISTINCT id, source_entity_id, target_entity_id FROM graph_relations WHERE lower(trim(relation_type)) = 'covers'),
h AS (SELECT p.id, e.name AS target, count(*) AS n FROM p JOIN r ON r.source_entity_id = p.id JOIN e ON e.id = r.target_entity_id GROUP BY ALL), t AS (SELECT id, string_agg(target || '(' || n || '块)', ', ' ORDER BY target, n) AS targets FROM h WHERE target IS NOT NULL GROUP BY id),
dd AS (SELECT p.name, coalesce(m.effective_date, '未知') AS d, count(m.id) AS n FROM (SELECT DISTINCT name FROM p) p JOIN document_metadata m ON m.product_name = p.name GROUP BY ALL), d3 AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d) AS k FROM dd), dt AS (SELECT name, string_agg(d || '(' || n || '条)', ', ' ORDER BY d) AS dates FROM d3 WHERE k <= 3 GROUP BY name)
SELECT p.id AS entity_id, p.name, coalesce(targets, '') AS targets, coalesce(dates, '未知') AS dates FROM p LEFT JOIN t USING (id) LEFT JOIN dt USING (name)""",
)
def q_kg_graph(spark, d):
    return facts.graph_facts(load(spark, d, "graph_entities"), load(spark, d, "graph_relations"), load(spark, d, "document_metadata"), facts.terms_of(_KG_QUESTION))


@query(
    "kg_batch",
    rf"""WITH questions AS (SELECT DISTINCT doc_id AS question_id, product_name || ' ' || coalesce(document_type, '') AS question FROM documents), asked AS (SELECT question_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:6] AS terms FROM (SELECT question_id, list_filter(regexp_extract_all(trim(coalesce(question, '')), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2 OR contains(x, '险')) AS l FROM questions)),
terms AS (SELECT question_id, unnest(terms) AS term FROM asked), e AS (SELECT DISTINCT id, name, lower(trim(entity_type)) AS kind FROM graph_entities),
p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY id, name) AS n FROM (SELECT DISTINCT question_id, id, name FROM terms JOIN e ON contains(lower(name), lower(term)) WHERE kind = 'product')),
r AS (SELECT DISTINCT id AS rel, source_entity_id, target_entity_id FROM graph_relations WHERE lower(trim(relation_type)) = 'covers'),
h AS (SELECT p.id, e.name AS target, count(DISTINCT rel) AS n FROM (SELECT DISTINCT id FROM p WHERE n <= 6) p JOIN r ON r.source_entity_id = p.id JOIN e ON e.id = r.target_entity_id WHERE e.name IS NOT NULL GROUP BY ALL), t AS (SELECT id, string_agg(target || '(' || n || '块)', ', ' ORDER BY target, n) AS targets FROM h GROUP BY id),
m AS (SELECT DISTINCT id, product_name, coalesce(effective_date, '未知') AS d FROM document_metadata), dd AS (SELECT product_name, d, count(id) AS n, row_number() OVER (PARTITION BY product_name ORDER BY d) AS k FROM m GROUP BY product_name, d), dt AS (SELECT product_name, string_agg(d || '(' || n || '条)', ', ' ORDER BY d) AS dates FROM dd WHERE k <= 3 GROUP BY product_name),
g AS (SELECT question_id, n, '产品『' || name || CASE WHEN targets IS NOT NULL THEN '』关联文档类型：' || targets ELSE '』已在文档中出现' END || '；生效日期分布：' || coalesce(dates, '未知') AS fact FROM p LEFT JOIN t USING (id) LEFT JOIN dt ON dt.product_name = p.name WHERE n <= 6),
rest AS (SELECT * FROM asked WHERE question_id NOT IN (SELECT question_id FROM g)), k AS (SELECT DISTINCT product_name AS name, coalesce(document_type, '未知') AS kind, effective_date, id FROM document_metadata WHERE product_name <> ''),
per AS (SELECT name, kind, count(id) AS n, min(effective_date) AS f FROM k GROUP BY ALL), s AS (SELECT name, max(n) AS most, min(f) AS f, string_agg(kind || '(' || n || '块)', ', ' ORDER BY kind) AS types FROM per GROUP BY name),
named AS (SELECT DISTINCT question_id, s.* FROM (SELECT question_id, unnest(terms) AS term FROM rest) x JOIN s ON contains(lower(name), lower(term)) UNION SELECT question_id, s.* FROM rest CROSS JOIN s WHERE len(terms) = 0),
f AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY most DESC, name) AS n, '产品『' || name || '』关联文档类型：' || types || '；最早生效日期：' || coalesce(f, '未知') AS fact FROM named)
SELECT question_id, CAST(n AS INTEGER) AS n, fact FROM g UNION ALL SELECT question_id, CAST(n AS INTEGER), fact FROM f WHERE n <= 6""",
)
def q_kg_batch(spark, d):
    """What is known about the products that the corpus's documents name."""
    asked = load(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.concat("product_name", F.lit(" "), F.coalesce("document_type", F.lit(""))).alias("question")).distinct()
    return facts.facts_for(asked, load(spark, d, "graph_entities"), load(spark, d, "graph_relations"), load(spark, d, "document_metadata"), "covers")


_GUARDED = "WITH t AS (SELECT document_type, count(*) AS n FROM document_metadata GROUP BY document_type) SELECT document_type, n FROM t;"


@query("sql_exec", _GUARDED.rstrip(";"))
def q_sql(spark, d):
    return sqlguard.run(spark, _GUARDED, {"document_metadata": load(spark, d, "document_metadata")})


# streaming


@query("stream_daily", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 3) AS avg_value FROM events GROUP BY 1")
def q_stream_daily(spark, d):
    """The events table as a stream of files, counted per day by event time; the batches land in the shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    src = load(spark, d, "events")
    src.write.parquet(f"{folder}/in")
    counts = streams.daily_counts(streams.table_stream(spark, f"{folder}/in", src.schema), "ts")
    # complete mode: each batch replaces the result, so the last one is whole
    q = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search for every evaluation question with the text of its hits."""
    ranked = q_hybrid(spark, d)
    return ranked.join(_chunks(spark, d), "chunk_id").select("question_id", "rank", "chunk_id", "rrf_score", "vector_score", "bm25_score", "content")
