"""Query history: pages, statistics, suggestions, retention and feedback.

``anchor`` is the time that counts as now. Functions that change the history return its new state.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.scores import percent
from docloom.functions.text import truncated


def since(anchor: datetime, days: int) -> Column:
    return F.lit(anchor.isoformat(sep=" ")).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def matching(history: DataFrame, query_type: str | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    out = history
    if query_type:
        out = out.where(F.col("model_used") == query_type)
    if start:
        out = out.where(F.col("created_time") >= F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz"))
    if end:
        out = out.where(F.col("created_time") <= F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz"))
    return out


def history_page(history: DataFrame, skip: int = 0, limit: int = 50, **where: object) -> DataFrame:
    """Newest first; rows of unknown time last."""
    return matching(history, **where).orderBy(F.col("created_time").desc_nulls_last(), F.desc("id")).offset(skip).limit(limit)


def history_count(history: DataFrame, **where: object) -> DataFrame:
    return matching(history, **where).agg(F.count(F.lit(1)).alias("total"))


def query_statistics(history: DataFrame, anchor: datetime, days: int = 30) -> DataFrame:
    """One row: totals of the last days, today's count, averages (0 if there is nothing)."""
    recent = F.col("created_time") >= since(anchor, days)
    today = F.to_date("created_time") == F.lit(anchor.date().isoformat()).cast("date")
    return history.agg(
        F.count_if(recent).alias("total_queries"),
        F.count_if(today).alias("today_queries"),
        F.round(F.coalesce(F.avg(F.when(recent, F.col("response_time"))), F.lit(0.0)), 3).alias("avg_response_time"),
        F.round(F.coalesce(F.avg(F.when(recent, F.col("rating"))), F.lit(0.0)), 2).alias("avg_rating"),
        F.round(F.count_if(recent) / F.lit(max(days, 1)), 2).alias("queries_per_day"),
    )


def by_type(history: DataFrame, anchor: datetime, days: int = 30) -> DataFrame:
    """Count per type; NULL types are a group whose own count is 0."""
    return history.where(F.col("created_time") >= since(anchor, days)).groupBy("model_used").agg(F.count("model_used").alias("typed"), F.count("id").alias("queries"), F.round(F.avg("response_time"), 3).alias("avg_time"))


def ratings(history: DataFrame, anchor: datetime, days: int = 30) -> DataFrame:
    return history.where((F.col("created_time") >= since(anchor, days)) & F.col("rating").isNotNull()).groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def daily(history: DataFrame, anchor: datetime, days: int = 30) -> DataFrame:
    return history.where(F.col("created_time") >= since(anchor, days)).groupBy(F.to_date("created_time").alias("day")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("response_time"), 3).alias("avg_time"))


def frequent(history: DataFrame, anchor: datetime, days: int = 30, n: int = 10) -> DataFrame:
    """The n most frequent questions, ties by text; shown up to 100 characters."""
    counts = history.where((F.col("created_time") >= since(anchor, days)) & F.col("query").isNotNull()).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "query").limit(n).select(truncated(F.col("query"), 100).alias("question"), "n")


def suggest(history: DataFrame, partial: str, limit: int = 5, predefined: tuple[str, ...] = ()) -> DataFrame:
    """Distinct earlier questions that contain the text, then predefined ones, without repeats."""
    own = history.where(F.contains("query", F.lit(partial))).select(F.col("query").alias("suggestion")).distinct().withColumn("source", F.lit(0))
    given = [(p,) for p in predefined if partial.lower() in p.lower()]
    if given:
        own = own.unionByName(history.sparkSession.createDataFrame(given, "suggestion string").withColumn("source", F.lit(1)))
    one = own.groupBy("suggestion").agg(F.min("source").alias("source"))
    return one.orderBy("source", "suggestion").limit(limit)


def retain(history: DataFrame, anchor: datetime, days: int) -> DataFrame:
    """Without rows older than the cutoff; rows of unknown time stay."""
    return history.where((F.col("created_time") >= since(anchor, days)) | F.col("created_time").isNull())


def removed_by_retention(history: DataFrame, anchor: datetime, days: int) -> DataFrame:
    return history.agg(F.count_if(F.col("created_time") < since(anchor, days)).alias("removed"), F.count(F.lit(1)).alias("before"))


def apply_feedback(history: DataFrame, updates: DataFrame) -> DataFrame:
    """New ratings and comments (id, rating, comment) put in; ratings beyond 1..5 are ignored."""
    u = updates.where(F.col("rating").between(1, 5)).groupBy("id").agg(F.max_by("rating", F.struct("rating", "comment")).alias("new_rating"), F.max_by("comment", F.struct("rating", "comment")).alias("comment"))
    return history.join(u, "id", "left").withColumn("rating", F.coalesce("new_rating", "rating")).withColumn("feedback", F.coalesce("comment", "feedback")).drop("new_rating", "comment")


def detail(history: DataFrame, ids: DataFrame) -> DataFrame:
    """The whole rows of some ids, with what ``expand_history`` reads from them; ids that do not exist give none."""
    rows = history.join(ids.select("id").distinct(), "id", "left_semi")
    return rows.join(expand_history(rows), "id", "left")


def rewriting_json(route: Column, intent: Column, vectors: Column) -> Column:
    """The metadata text of a rewriting."""
    return F.to_json(F.struct(route.alias("route"), intent.alias("primary_search_intent"), vectors.alias("query_vectors")))


def delete_by_id(history: DataFrame, ids: DataFrame) -> DataFrame:
    return history.join(ids.select("id").distinct(), "id", "left_anti")


def with_missing_columns(history: DataFrame, schema: str) -> DataFrame:
    """Additive migration: columns that the table lacks, as NULL."""
    empty = history.sparkSession.createDataFrame([], schema)
    return history.unionByName(empty, allowMissingColumns=True)


def persisted(answers: DataFrame, stream: bool = False) -> DataFrame:
    """The answers that are kept in the history: not advice or unavailable; of a stream only real answers."""
    kinds = ("answer",) if stream else ("answer", "refusal", "degraded")
    return answers.where(F.col("kind").isin(*kinds))


def last_turns(history: DataFrame, n: int = 10) -> DataFrame:
    """The last n turns of each session in time order; the limit is applied before the shuffle."""
    w = Window.partitionBy("session_id").orderBy(F.col("created_time").desc_nulls_last(), F.desc("id"))
    return history.where("session_id IS NOT NULL").select("session_id", "id", "query", "response", "created_time").distinct().withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def transcript(turns: DataFrame, most: int = 4000) -> DataFrame:
    """(session_id, transcript): the turns as lines, the last ``most`` characters."""
    line = F.concat(F.lit("用户: "), F.coalesce("query", F.lit("")), F.lit("\n助理: "), F.coalesce("response", F.lit("")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("o"), line.alias("t")))), lambda x: x["t"])
    text = F.array_join(lines, "\n")
    return turns.groupBy("session_id").agg(text.alias("t")).select("session_id", F.when(F.char_length("t") > most, F.right("t", F.lit(most))).otherwise(F.col("t")).alias("transcript"))


def expand_history(history: DataFrame) -> DataFrame:
    """(id, chunks_used, top_score): length of the stored list, and the first hit's score."""
    r = F.col("retrieved_chunks")
    v = F.try_parse_json(r)
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    items = F.from_json(F.when(is_list, r), "array<struct<similarity_score:string,ranking_details:struct<final_score:string>>>")
    first = F.try_element_at(items, F.lit(1))
    return history.select("id", F.coalesce(F.when(is_list, F.size(items)), F.lit(0)).alias("chunks_used"), F.coalesce(first["ranking_details"]["final_score"].try_cast("double"), first["similarity_score"].try_cast("double")).alias("top_score")).distinct()


def error_rate(errors: Column, queries: Column) -> Column:
    return percent(errors, queries)
