"""Corpus catalogue, document statistics and system metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.scores import percent
from docloom.functions.text import basename



def one_per_id(df: DataFrame, *columns: str) -> DataFrame:
    """(id, columns): of several rows of an id the least one in the columns' order."""
    return df.groupBy("id").agg(F.min(F.struct(*columns)).alias("_one")).select("id", "_one.*")


def manifest(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, display_name, pages, chunk_count): pages that hold text, chunks, a name to show."""
    text = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " "))
    per = one_per_id(chunks, "document_id", "page_number", "content").groupBy("document_id").agg(F.count_distinct(F.when(text != "", F.col("page_number"))).alias("pages"), F.count(F.lit(1)).alias("chunk_count"))
    stem = F.regexp_replace(basename(F.col("filename")), r"\.[^.]+$", "")
    names = files.groupBy("id").agg(F.max(F.coalesce(F.nullif(F.trim("original_name"), F.lit("")), stem)).alias("display_name"))
    return per.join(names.withColumnRenamed("id", "document_id"), "document_id", "left").select("document_id", F.coalesce("display_name", F.lit("未知文档")).alias("display_name"), "pages", "chunk_count")


def catalogue(files: DataFrame, corpus: DataFrame) -> DataFrame:
    """Names from the files, then those of the corpus that are not listed yet: (name, origin), first origin wins."""
    a = files.select(F.lower(F.trim("original_name")).alias("name"), F.lit(0).alias("rank"))
    b = corpus.select(F.lower(F.trim("product_name")).alias("name"), F.lit(1).alias("rank"))
    one = a.unionByName(b).where("name IS NOT NULL AND name <> ''").groupBy("name").agg(F.min("rank").alias("rank"))
    return one.select("name", F.when(F.col("rank") == 0, "files").otherwise("corpus").alias("origin"))


def resolve_documents(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file_id): the first file whose base name equals a name, without case; else the first whose base name
    holds it or is held by it. The second way joins on the parts of the longer name, of the shorter one's length."""
    f = files.where("filename IS NOT NULL").groupBy(F.lower(basename(F.col("filename"))).alias("key")).agg(F.min("id").alias("file_id")).where("key <> ''")
    asked = names.select("name").distinct().withColumn("key", F.lower(basename(F.col("name")))).where("key <> ''")
    exact = asked.join(f, "key").select("name", "file_id", F.lit(0).alias("way"))
    left = asked.join(f.select("key"), "key", "left_anti")

    def parts(df: DataFrame, lengths: DataFrame) -> DataFrame:
        sizes = lengths.agg(F.array_sort(F.collect_set(F.char_length("key"))).alias("_n"))  # lengths of names: a few hundred at most
        cut = df.crossJoin(F.broadcast(sizes)).select("*", F.explode(F.filter("_n", lambda n: n <= F.char_length("key"))).alias("_k"))
        return cut.select(*df.columns, F.explode(F.transform(F.sequence(F.lit(1), F.char_length("key") - F.col("_k") + 1), lambda i: F.substring(F.col("key"), i, F.col("_k")))).alias("part")).distinct()

    inside = parts(f, left).join(left.select("name", F.col("key").alias("part")), "part").select("name", "file_id", F.lit(1).alias("way"))
    around = parts(left, f).join(f.select("file_id", F.col("key").alias("part")), "part").select("name", "file_id", F.lit(1).alias("way"))
    found = exact.unionByName(inside).unionByName(around).groupBy("name").agg(F.min(F.struct("way", "file_id")).alias("m"))
    return names.select("name").distinct().join(found, "name", "left").select("name", F.col("m.file_id").alias("file_id"))


def document_statistics(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row over the distinct file and chunk rows."""
    f = one_per_id(files, "status", "file_size")
    active = F.lower(F.trim("status")) == "active"
    a = f.agg(F.count(F.lit(1)).alias("documents"), F.count_if(active).alias("active_documents"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"), F.round(F.coalesce(F.avg("file_size"), F.lit(0.0)), 2).alias("avg_size"))
    b = chunks.agg(F.count_distinct("id").alias("chunks"))
    return a.crossJoin(b).withColumn("processing_rate", percent(F.col("active_documents"), F.col("documents"))).withColumn("chunks_per_document", F.round(F.col("chunks") / F.greatest("active_documents", F.lit(1)), 2))


def status_breakdown(files: DataFrame) -> DataFrame:
    return one_per_id(files, "status").groupBy(F.coalesce(F.lower(F.trim("status")), F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def recent_documents(files: DataFrame, n: int = 10) -> DataFrame:
    return files.select("id", "original_name", "status", "created_time").distinct().orderBy(F.col("created_time").desc_nulls_last(), F.desc("id")).limit(n)


def system_totals(files: DataFrame, chunks: DataFrame, history: DataFrame) -> DataFrame:
    a = one_per_id(files, "file_size").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("storage_bytes"))
    return a.crossJoin(chunks.agg(F.count_distinct("id").alias("chunks"))).crossJoin(history.agg(F.count(F.lit(1)).alias("queries"), F.round(F.coalesce(F.avg("response_time"), F.lit(0.0)), 3).alias("avg_response_time")))


def metrics_range(metrics: DataFrame, anchor: datetime, hours: int, time: str = "ts") -> DataFrame:
    return metrics.where((F.col(time) >= F.lit(anchor.isoformat(sep=" ")).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col(time) <= F.lit(anchor.isoformat(sep=" ")).cast("timestamp_ntz")))


def metric_summary(metrics: DataFrame, anchor: datetime, hours: int = 24) -> DataFrame:
    """One row: average of the values that are not 0, events, errors and their rate."""
    m = metrics_range(metrics, anchor, hours)
    return m.agg(F.round(F.avg(F.nullif("value", F.lit(0.0))), 4).alias("avg_value"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")).withColumn("error_rate", percent(F.col("errors"), F.col("events")))


def system_metrics(metrics: DataFrame, anchor: datetime, hours: int = 24, time: str = "timestamp") -> DataFrame:
    """One row over (cpu_usage, memory_usage, query_count, error_count): averages of the values that are neither NULL
    nor 0 (NULL if there is none), sums and the error rate."""
    m = metrics_range(metrics, anchor, hours, time)
    total, errors = (F.coalesce(F.sum(c), F.lit(0)) for c in ("query_count", "error_count"))
    return m.agg(
        F.round(F.avg(F.nullif("cpu_usage", F.lit(0))), 2).alias("avg_cpu_usage"), F.round(F.avg(F.nullif("memory_usage", F.lit(0))), 2).alias("avg_memory_usage"), total.alias("total_queries"), errors.alias("total_errors")
    ).withColumn("error_rate", percent(F.col("total_errors"), F.col("total_queries")))


def snapshot(df: DataFrame, folder: str, label: str) -> str:
    """A dated copy of a table; the label may not leave the folder."""
    if not label or "/" in label or "\\" in label or label.startswith("."):
        raise ValueError("bad snapshot label")
    path = f"{folder.rstrip('/')}/{label}"
    df.write.mode("errorifexists").parquet(path)
    return path


def newest(df: DataFrame, by: str, time: str, tie: str) -> DataFrame:
    """The newest row of each group."""
    w = Window.partitionBy(by).orderBy(F.col(time).desc_nulls_last(), F.desc(tie))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_document_type(df: DataFrame, kinds: list[str]) -> DataFrame:
    return df.where(F.col("document_type").isin(*kinds))



def log_entries(df: DataFrame, event: str, at: datetime) -> DataFrame:
    """Structured log rows (timestamp, level, event, data as JSON) of measured operations (operation, duration)."""
    return df.select(F.lit(at.isoformat()).alias("timestamp"), F.when(F.col("duration") > 5, "WARNING").otherwise("INFO").alias("level"), F.lit(event).alias("event"), F.to_json(F.struct("operation", "duration")).alias("data"))


