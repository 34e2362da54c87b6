from datetime import datetime as D

from docloom.operators import facts, history, ops
from docloom.streaming import streams

S = "id bigint, query string, response string, model_used string, response_time double, rating int, feedback string, session_id string, created_time timestamp_ntz"


def rows(spark):
    t = D(2024, 1, 10)
    return spark.createDataFrame([(1, "a", "r", "x", 1.0, 5, None, "s", D(2024, 1, 9)), (2, "a", None, None, None, None, None, "s", t), (3, "b" * 120, "r", "x", 3.0, 1, "f", None, D(2023, 1, 1)), (4, None, "r", "y", 2.0, None, None, "u", None)], S)


def test_statistics_and_empty(spark):
    r = history.query_statistics(rows(spark), D(2024, 1, 10), 30).first()
    assert (r["total_queries"], r["today_queries"], r["avg_response_time"], r["avg_rating"]) == (2, 1, 1.0, 5.0)
    e = history.query_statistics(rows(spark).limit(0), D(2024, 1, 10), 30).first()
    assert (e["total_queries"], e["avg_rating"]) == (0, 0.0)
    assert {(r["model_used"], r["typed"], r["queries"]) for r in history.by_type(rows(spark), D(2024, 1, 10)).collect()} == {("x", 1, 1), (None, 0, 1)}


def test_feedback_delete_retention(spark):
    u = spark.createDataFrame([(1, 2, "c"), (2, 9, "bad"), (77, 3, "none")], "id bigint, rating int, comment string")
    got = {r["id"]: (r["rating"], r["feedback"]) for r in history.apply_feedback(rows(spark), u).collect()}
    assert got == {1: (2, "c"), 2: (None, None), 3: (1, "f"), 4: (None, None)}
    assert history.delete_by_id(rows(spark), u).count() == 2
    assert {r["id"] for r in history.retain(rows(spark), D(2024, 1, 10), 30).collect()} == {1, 2, 4}


def test_transcript_and_frequent(spark):
    t = history.transcript(history.last_turns(rows(spark), 1)).where("session_id = 's'").first()
    assert t["transcript"] == "用户: a\n助理: "
    f = history.frequent(rows(spark), D(2024, 1, 10), 9999).collect()
    assert (f[0]["question"], f[0]["n"]) == ("a", 2) and f[1]["question"].endswith("...")


def test_facts(spark):
    m = spark.createDataFrame([(1, "P险", "条款", "2020-01-01"), (2, "P险", None, None), (3, None, "条款", "2019")], "id bigint, product_name string, document_type string, effective_date string")
    r = facts.metadata_facts(m, []).collect()
    assert [(x["product_name"], x["types"], x["min_effective"]) for x in r] == [("P险", "未知(1块), 条款(1块)", "2020-01-01")]
    assert facts.metadata_facts(m, ["nothing"]).count() == 0


def test_metric_summary_all_zero(spark):
    m = spark.createDataFrame([("error", 0.0, D(2024, 1, 1))], "event_type string, value double, ts timestamp_ntz")
    r = ops.metric_summary(m, D(2024, 1, 1, 1)).first()
    assert (r["avg_value"], r["error_rate"]) == (None, 100.0)


def test_stream_once_per_checkpoint(spark, tmp_path):
    src = spark.createDataFrame([(1, 1.0, D(2024, 1, 1)), (1, 1.0, D(2024, 1, 1)), (2, 3.0, D(2024, 1, 2))], "id bigint, value double, ts timestamp_ntz")
    src.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        df = streams.fresh_chunks(streams.table_stream(spark, str(tmp_path / "in"), src.schema), "id", "ts")
        streams.run_available(df, streams.append_sink(str(tmp_path / "out")), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
