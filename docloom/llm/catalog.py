"""Named queries over the training-data operators, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm import chunking, dedup, langid, leakage, mixing, pairs, sentences
from docloom.tables import load, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_BLANK = "[\\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_P6_COVER = f"SELECT id AS chunk_id, length(regexp_replace(content, '{_BLANK}', '', 'g')) AS characters FROM (SELECT DISTINCT id, content FROM document_chunks) WHERE length(regexp_replace(content, '{_BLANK}', '', 'g')) > 0"
_TRIM = r"regexp_replace(content, '^[ \t\r\n\x0B\f\x{3000}\x{00A0}\x{0085}\x{2028}\x{2029}]+|[ \t\r\n\x0B\f\x{3000}\x{00A0}\x{0085}\x{2028}\x{2029}]+$', '', 'g')"
_P1_COVER = f"SELECT DISTINCT id AS chunk_id, true AS within, true AS overlap, true AS no_more, CAST(0 AS INTEGER) AS first, CAST(length({_TRIM}) AS INTEGER) AS last FROM document_chunks WHERE length({_TRIM}) > 400"


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pieces(load(spark, d, "document_chunks"), "id", "content", "page_number")


@query(
    "p1_found",
    r"SELECT DISTINCT id AS chunk_id FROM document_chunks WHERE length(regexp_replace(content, '^[ \t\r\n\x0B\f\x{3000}\x{00A0}\x{0085}\x{2028}\x{2029}]+|[ \t\r\n\x0B\f\x{3000}\x{00A0}\x{0085}\x{2028}\x{2029}]+$', '', 'g')) > 400",
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.oversized(_pieces(spark, d), "id").withColumnRenamed("id", "chunk_id")


@query("p1_pieces")
def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).withColumnRenamed("id", "chunk_id").distinct()


# what holds of all pieces of an item, against the item's own length
@query("p1_cover", _P1_COVER)
def p1_cover(spark: SparkSession, d: str) -> DataFrame:
    p = _pieces(spark, d).distinct()
    w = Window.partitionBy("id").orderBy("start_pos", "end_pos")
    gap = p.withColumn("joint", F.lag("end_pos").over(w) - F.col("start_pos"))
    return gap.groupBy(F.col("id").alias("chunk_id")).agg((F.max(F.char_length("content")) <= chunking.LIMIT).alias("within"), F.coalesce(F.min("joint") == chunking.OVERLAP, F.lit(True)).alias("overlap"), F.coalesce(F.max("joint") == chunking.OVERLAP, F.lit(True)).alias("no_more"), F.min("start_pos").alias("first"), F.max("end_pos").alias("last"))


@query("p6_cover", _P6_COVER)
def p6_cover(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each text that stand in a unit, without white space."""
    chunks = load(spark, d, "document_chunks").where("content IS NOT NULL").select(F.col("id").alias("chunk_id"), "content").distinct()
    units = sentences.sentence_units(chunks, "chunk_id", "content")
    cut = F.substring(F.col("content"), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    return units.join(chunks, "chunk_id").groupBy("chunk_id").agg(F.sum(F.char_length(F.regexp_replace(cut, _BLANK, ""))).alias("characters"))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(load(spark, d, "document_chunks"), "id", "content").withColumnRenamed("id", "chunk_id")


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    files = dedup.file_repeats(load(spark, d, "document_files"), "id", "file_hash").select(F.lit("document").alias("row_kind"), "first_id", "dup_id")
    chunks = dedup.text_repeats(load(spark, d, "document_chunks"), "id", "content", "ingest_batch").select(F.lit("chunk").alias("row_kind"), "first_id", "dup_id")
    return files.unionByName(chunks)


@query("p5_last_batch")
def p5_last_batch(spark: SparkSession, d: str) -> DataFrame:
    """The repeats in the last delivery, found against the stored arrays of all earlier ones."""
    chunks = load(spark, d, "document_chunks").withColumn("n", F.coalesce("ingest_batch", F.lit(0)))
    last = chunks.agg(F.max("n")).first()[0] or 0
    history = dedup.Segments(spark, f"{shared_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}")
    history.accept(chunks.where(F.col("n") < last), "id", "content")
    return history.accept(chunks.where(F.col("n") == last), "id", "content")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.language_segments(load(spark, d, "documents"), "doc_id", "text", "lang")


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.unlabelled(_segments(spark, d), "doc_id")


@query("p9_documents")
def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(_segments(spark, d), "doc_id")


@query("p9_segments")
def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).distinct()


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "passage")


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_leaked(spark, d), "doc_id", "item_id")


@query("p7_spans")
def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.removal_spans(_leaked(spark, d), "doc_id", "item_id")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts, quota = mixing.prepared(load(spark, d, "documents"), load(spark, d, "source_targets"))
    return mixing.mixture(counts, quota), quota


@query("p8_mix")
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].withColumnRenamed("rec", "doc_id")


@query("p8_report")
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(*_mix(spark, d))


def _broken(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(load(spark, d, "query_history"), "id", "query", "response")


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select(F.col("id").alias("query_id"), "defect").distinct()


@query("p2_scores")
def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every defect of every pair, with its score."""
    return pairs.defective_pairs(load(spark, d, "query_history"), "id", "query", "response", every=True).select(F.col("id").alias("query_id"), "defect", "score").distinct()
