import json

from docloom.operators import inlining as I


def found(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, retrieved_chunks string, rewriting_metadata_json string, record string, key string")
    plan = I.plan(I.schema_graph(df, ["retrieved_chunks", "rewriting_metadata_json"]))
    shredded = I.shred(df, "id", plan)
    return {(r["record"], r["child"], r["parent_key"], r["pos"]) for r in shredded.collect()}, shredded, plan


def test_elements_positions_and_parents(spark):
    chunks = json.dumps([None, {"chunk_id": 1, "metadata": {"keywords_json": '["a", null, "b"]'}}, {"metadata": {"keywords_json": "a、b"}}, {"metadata": {"keywords_json": "solo"}}, {"metadata": None}])
    meta = json.dumps({"query_vectors": "lone", "micro_ontology": {"x": ["p", None, "q"], "y": {"z": {"w": "one"}}, "n": None, "e": []}})
    got, shredded, plan = found(spark, [(1, chunks, meta, "clash", "clash"), (2, "", "not json", None, None), (3, None, None, None, None)])
    assert got == {
        (1, "chunk", "", 1), (1, "chunk", "", 2), (1, "chunk", "", 3), (1, "chunk", "", 4),
        (1, "keyword", "1", 0), (1, "keyword", "1", 2),
        (1, "vector", "", 0), (1, "term", "x", 0), (1, "term", "x", 2), (1, "term", "y/z/w", 0),
    }
    assert {r["chunk_id"] for r in I.flat_table(shredded, plan, "chunk").collect()} == {"1", None}


def test_fences_strings_and_broken_text(spark):
    inner = json.dumps([{"metadata": {"keywords_json": json.dumps(json.dumps(["k"]))}}])
    fenced = "```json\n" + json.dumps({"query_vectors": {"q": 1}}) + "\n```"
    got, _, _ = found(spark, [(1, json.dumps(inner), fenced, "", ""), (2, '[{"a": 1', "```\n{}```", "", ""), (3, "null", '"text"', "", "")])
    assert got == {(1, "chunk", "", 0), (1, "keyword", "0", 0), (1, "vector", "", 0)}


def test_empty_table_and_repeated_rows(spark):
    assert found(spark, [])[0] == set()
    assert found(spark, [(1, "[1]", None, "", "")] * 3)[0] == {(1, "chunk", "", 0)}


def test_undeclared_lists_become_tables(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, 2], "c": 3}}')], "id bigint, doc string")
    plan = I.plan(I.schema_graph(df, ["doc"], ()), ())
    assert [(t.name, t.path) for t in plan.tables] == [("doc_a_b", ("a", "b"))]
    assert {(r["child"], r["pos"]) for r in I.shred(df, "id", plan).collect()} == {("doc_a_b", 0), ("doc_a_b", 1)}


def shredded(spark, texts, names={}):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, doc string")
    plan = I.plan(I.schema_graph(df, ["doc"], names), names)
    return I.shred(df, "id", plan), plan


def test_keys_with_dots_and_brackets_keep_their_values(spark):
    rows, plan = shredded(spark, ['[{"meta.data": {"x[0]": "v"}, "b\\\\c": 1}]'])
    assert I.read_path(I.written(("a.b", "c\\", "[]"))) == ("a.b", "c\\", "[]")
    assert [r.asDict() for r in I.flat_table(rows, plan, "doc").collect()] == [{"record": 0, "parent_key": "", "place": "", "pos": 0, "b_c": "1", "meta_data_x_0": "v"}]


def test_lists_within_lists_keep_their_links(spark):
    rows, _ = shredded(spark, ['{"a": [["x", "y"], ["z"]], "n": "s", "m": 1}'])
    assert {tuple(r) for r in rows.select("child", "parent_key", "pos").collect()} == {("doc_a", "", 0), ("doc_a", "", 1), ("doc_a_item", "0", 0), ("doc_a_item", "0", 1), ("doc_a_item", "1", 0)}
    rows, _ = shredded(spark, ['{"m": {"a": ["x", ["y"]], "b": ["z"], "e": ["w"]}, "c": 1, "d": 2}', '{"m": {"a": ["x"]}, "c": 1, "d": 2}'])
    assert {tuple(r) for r in rows.where("record = 0").select("parent_key", "place", "pos").collect()} == {("a", "", 0), ("a", "", 1), ("a", "1", 0), ("b", "", 0), ("e", "", 0)}


def test_recursive_elements_are_one_table(spark):
    deep = {"comment": [{"by": "a", "comment": [{"by": "b", "comment": {"by": "c"}}]}]}
    rows, plan = shredded(spark, [json.dumps(deep)])
    assert [t.name for t in plan.tables] == ["doc_comment"] and plan.columns["doc_comment"] == [("by",)]
    assert {tuple(r) for r in I.flat_table(rows, plan, "doc_comment").select("parent_key", "pos", "by").collect()} == {("", 0, "a"), ("0", 0, "b"), ("0/0", 0, "c")}


def test_shared_objects_are_tables_and_open_ones_do_not_depend_on_size(spark):
    rows, plan = shredded(spark, ['{"buyer": {"address": {"city": "x", "zip": "1"}}, "seller": {"address": {"city": "y", "zip": "2"}}, "n": 1}'])
    assert {t.name for t in plan.tables} == {"doc_buyer_address", "doc_seller_address"}
    assert {tuple(r) for r in I.flat_table(rows, plan, "doc_buyer_address").select("city", "zip").collect()} == {("x", "1")}
    for n in (3, 500):  # keys that are data: one table, however many there are
        rows, plan = shredded(spark, [json.dumps({"id": i, "kind": "k", "tags": {f"key{i}": ["p", "q"], f"other{i}": ["r"]}}) for i in range(n)])
        assert [(t.name, t.recursive) for t in plan.tables] == [("doc_tags", True)]
        assert rows.count() == 3 * n
