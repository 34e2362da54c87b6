from datetime import datetime as D

from docloom.operators import orphans as O

SCHEMAS = {
    "document_files": "id bigint, status string, created_time timestamp_ntz, key string, parent string",
    "document_chunks": "id bigint, document_id bigint, created_time timestamp_ntz",
    "document_metadata": "id bigint, chunk_id string, created_time timestamp_ntz",
    "graph_entities": "id bigint, created_time timestamp_ntz",
    "graph_relations": "id bigint, source_entity_id bigint, target_entity_id bigint, created_time timestamp_ntz",
    "deletion_log": "table_name string, row_key string",
}


def run(spark, **rows):
    tables = {n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()}
    return {tuple(r) for r in O.orphan_references(tables).collect()}


def test_kinds(spark):
    t, u = D(2022, 3, 1), D(2022, 5, 1)
    got = run(
        spark,
        document_files=[(1, "active", t, "x", "y"), (2, " Deleted", t, "x", "y"), (3, None, u, "x", "y"), (4, "active", None, "x", "y")],
        document_chunks=[(10, 1, t), (11, 2, t), (12, 3, t), (13, 4, t), (14, 9, None), (15, None, t), (16, 8, t), (16, 8, t)],
        document_metadata=[(1, " CHUNK_10 ", t), (2, "chunk_99", t), (3, "chunk_x", t), (4, None, t)],
        graph_relations=[(1, 5, 5, t)],
        deletion_log=[(" Document_Files", "8"), ("document_chunks", "chunk_99"), ("graph_entities", "6"), (None, None)],
    )
    assert got == {
        ("document_chunks", "document_id", 11, "deleted", "2022-03"),
        ("document_chunks", "document_id", 12, "late", "2022-03"),
        ("document_chunks", "document_id", 14, "missing", "unknown"),
        ("document_chunks", "document_id", 16, "deleted", "2022-03"),
        ("document_metadata", "chunk_id", 2, "deleted", "2022-03"),
        ("document_metadata", "chunk_id", 3, "missing", "2022-03"),
        ("graph_relations", "source_entity_id", 1, "missing", "2022-03"),
        ("graph_relations", "target_entity_id", 1, "missing", "2022-03"),
    }


def test_empty_tables(spark):
    assert run(spark) == set()


def test_runs_and_blocks(spark):
    keys = [*range(4090, 4100), 4102, -1, 0, None]
    runs = O.key_runs(spark.createDataFrame([(k,) for k in keys], "key bigint"))
    assert sorted((r["run_start"], r["run_end"]) for r in runs.collect()) == [(-1, -1), (0, 0), (4090, 4095), (4096, 4099), (4102, 4102)]
    asked = spark.createDataFrame([(k,) for k in (4089, 4095, 4101, 4102, 99999, -1)], "key bigint")
    assert {r["key"]: r["present"] for r in O.beyond_runs(asked, runs).collect()} == {4089: False, 4095: True, 4101: False, 4102: True, 99999: False, -1: True}


def test_hot_keys_take_the_other_way(spark):
    chunks = [(i, 7, D(2022, 1, 1)) for i in range(1000)] + [(2000, 8, D(2022, 1, 1))]
    got = run(spark, document_chunks=chunks, document_files=[(8, "active", D(2021, 1, 1), "", "")])
    assert len(got) == 1000 and {g[3] for g in got} == {"missing"}
