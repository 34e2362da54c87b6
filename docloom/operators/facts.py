"""Facts about products, from document metadata and the one-hop graph."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import query_terms


def terms_of(question: str, most: int = 6) -> list[str]:
    """As functions.text.query_terms, for one question."""
    runs = re.findall(r"[^\W_]+", (question or "").strip())
    return list(dict.fromkeys(t for t in runs if len(t) >= 2 or "险" in t))[:most]


def matches(name: Column, terms: list[str]) -> Column:
    """Whether a name contains any of the terms, without case; all names match no terms at all."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(name), F.lit(t.lower())) for t in terms)) if terms else F.lit(True)


def metadata_facts(metadata: DataFrame, terms: list[str], limit: int = 6) -> DataFrame:
    """(product_name, types, chunks, min_effective): chunks per document type of the products that match.

    Products by their largest type, ties by name. NULL products are left out, a NULL type is 未知.
    """
    rows = metadata.where(F.col("product_name").isNotNull() & (F.col("product_name") != "") & matches(F.col("product_name"), terms))
    by_type = rows.groupBy("product_name", F.coalesce("document_type", F.lit("未知")).alias("document_type")).agg(F.count("id").alias("n"), F.min("effective_date").alias("first_date"))
    per = by_type.groupBy("product_name").agg(F.max("n").alias("most"), F.sum("n").alias("chunks"), F.min("first_date").alias("min_effective"), F.sort_array(F.collect_list(F.struct("document_type", "n"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["document_type"], F.lit("("), x["n"].cast("string"), F.lit("块)"))), ", ")
    return per.orderBy(F.desc("most"), "product_name").limit(limit).select("product_name", text.alias("types"), "chunks", "min_effective")


def graph_facts(entities: DataFrame, relations: DataFrame, metadata: DataFrame, terms: list[str], relation_type: str = "covers", limit: int = 6) -> DataFrame:
    """(entity_id, name, targets, dates): one hop from product entities that match, with the first three
    effective dates of their metadata. Kinds of entities and relations are compared without case."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    ent = entities.select("id", "name", norm("entity_type").alias("kind")).distinct()
    products = ent.where((F.col("kind") == "product") & F.col("name").isNotNull() & matches(F.col("name"), terms)).orderBy("id").limit(limit)
    rel = relations.where(norm("relation_type") == relation_type).select("id", "source_entity_id", "target_entity_id").distinct()
    names = ent.select(F.col("id").alias("target_entity_id"), F.col("name").alias("target"))
    hop = products.select(F.col("id").alias("source_entity_id")).join(rel, "source_entity_id").join(names, "target_entity_id").groupBy("source_entity_id", "target").agg(F.count(F.lit(1)).alias("n"))
    targets = hop.groupBy("source_entity_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target", "n"))), lambda x: F.concat(x["target"], F.lit("("), x["n"].cast("string"), F.lit("块)"))), ", ").alias("targets"))
    dated = products.select("name").distinct().join(metadata.select(F.col("product_name").alias("name"), "effective_date", "id"), "name").groupBy("name", F.coalesce("effective_date", F.lit("未知")).alias("d")).agg(F.count("id").alias("n"))
    dates = dated.groupBy("name").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("d", "n"))), 1, 3), lambda x: F.concat(x["d"], F.lit("("), x["n"].cast("string"), F.lit("条)"))), ", ").alias("dates"))
    return products.join(targets, products["id"] == targets["source_entity_id"], "left").join(dates, "name", "left").select(F.col("id").alias("entity_id"), "name", F.coalesce("targets", F.lit("")).alias("targets"), F.coalesce("dates", F.lit("未知")).alias("dates"))


def _matched(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, name) of the names that hold one of a question's terms (question_id, term), without case: the parts
    of each name, of the lengths that terms have, are joined with the terms."""
    low = terms.select("question_id", F.lower("term").alias("part")).distinct()
    sizes = low.agg(F.array_sort(F.collect_set(F.char_length("part"))).alias("_n"))  # lengths of terms: a few hundred at most
    cut = names.where("name IS NOT NULL").select("name").distinct().crossJoin(F.broadcast(sizes)).select("name", F.lower("name").alias("_l"), F.explode(F.filter("_n", lambda n: n <= F.char_length("name"))).alias("_k"))
    parts = cut.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("_l") - F.col("_k") + 1), lambda i: F.substring(F.col("_l"), i, F.col("_k")))).alias("part")).distinct()
    return parts.join(low, "part").select("question_id", "name").distinct()


def _listed(key: str, unit: str, most: int | None = None) -> Column:
    """Aggregate of rows (key, n) as 'key(n unit), ...' in the keys' order."""
    items = F.sort_array(F.collect_list(F.struct(key, "n")))
    return F.array_join(F.transform(items if most is None else F.slice(items, 1, most), lambda x: F.concat(x[key], F.lit("("), x["n"].cast("string"), F.lit(unit + ")"))), ", ")


def facts_for(questions: DataFrame, entities: DataFrame, relations: DataFrame, metadata: DataFrame, relation_type: str = "has_document_type", limit: int = 6) -> DataFrame:
    """(question_id, n, fact): at most ``limit`` facts a question, from the products of the graph that its terms name; if
    there is none, from the products of the metadata (of all of them for a question without terms).

    Graph products go by id, others by their largest number of chunks. NULL names and products have no facts.
    """
    norm = lambda c: F.lower(F.trim(F.col(c)))
    asked = questions.select("question_id", query_terms(F.coalesce("question", F.lit(""))).alias("terms")).distinct()
    terms = asked.select("question_id", F.explode("terms").alias("term"))
    ent = entities.select("id", "name", norm("entity_type").alias("kind")).distinct()
    products = ent.where("kind = 'product' AND name IS NOT NULL").select("id", "name")
    w = Window.partitionBy("question_id").orderBy("id", "name")
    mine = _matched(terms, products).join(products, "name").withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    used = mine.select("id", "name").distinct()
    rel = relations.where(norm("relation_type") == relation_type).select(F.col("id").alias("rel"), F.col("source_entity_id").alias("id"), "target_entity_id").distinct()
    hop = used.select("id").distinct().join(rel, "id").join(ent.select(F.col("id").alias("target_entity_id"), F.col("name").alias("target")), "target_entity_id").where("target IS NOT NULL").groupBy("id", "target").agg(F.count(F.lit(1)).alias("n"))
    targets = hop.groupBy("id").agg(_listed("target", "块").alias("targets"))
    dated = used.select("name").distinct().join(metadata.select(F.col("product_name").alias("name"), "effective_date", F.col("id").alias("_m")).distinct(), "name").groupBy("name", F.coalesce("effective_date", F.lit("未知")).alias("d")).agg(F.count("_m").alias("n"))
    dates = dated.groupBy("name").agg(_listed("d", "条", 3).alias("dates"))
    about = F.concat(F.lit("产品『"), F.col("name"), F.when(F.col("targets").isNotNull(), F.concat(F.lit("』关联文档类型："), F.col("targets"))).otherwise("』已在文档中出现"), F.lit("；生效日期分布："), F.coalesce("dates", F.lit("未知")))
    graph = mine.join(targets, "id", "left").join(dates, "name", "left").select("question_id", "n", about.alias("fact"))
    rest = asked.join(graph.select("question_id").distinct(), "question_id", "left_anti")
    known = metadata.where("product_name IS NOT NULL AND product_name <> ''").select(F.col("product_name").alias("name"), F.coalesce("document_type", F.lit("未知")).alias("kind"), "effective_date", "id").distinct()
    per = known.groupBy("name", "kind").agg(F.count("id").alias("n"), F.min("effective_date").alias("first"))
    summed = per.groupBy("name").agg(F.max("n").alias("most"), F.min("first").alias("first"), _listed("kind", "块").alias("types"))
    v = Window.partitionBy("question_id").orderBy(F.desc("most"), "name")
    named = _matched(rest.select("question_id", F.explode("terms").alias("term")), known).join(summed, "name")
    top = summed.orderBy(F.desc("most"), "name").limit(limit)
    found = named.unionByName(rest.where(F.size("terms") == 0).select("question_id").crossJoin(F.broadcast(top)).select(*named.columns)).withColumn("n", F.row_number().over(v)).where(F.col("n") <= limit)
    plain = F.concat(F.lit("产品『"), F.col("name"), F.lit("』关联文档类型："), F.col("types"), F.lit("；最早生效日期："), F.coalesce("first", F.lit("未知")))
    return graph.unionByName(found.select("question_id", "n", plain.alias("fact")))


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """(term, synonyms) of a JSON file with an object ``synonyms``; no rows if the file is missing or has none."""
    try:
        text = spark.read.text(path, wholetext=True)
        found = text.select(F.explode(F.from_json(F.get_json_object("value", "$.synonyms"), "map<string,array<string>>")).alias("term", "synonyms"))
        return found.where(F.size("synonyms") > 0)
    except AnalysisException:
        return spark.createDataFrame([], "term string, synonyms array<string>")


def synonyms_of(questions: DataFrame, ontology: DataFrame) -> DataFrame:
    """(question_id, synonyms): those of all terms of an ontology (term, synonyms) that a question holds, terms in order."""
    held = _matched(ontology.select(F.col("term").alias("question_id"), "term"), questions.select(F.col("question").alias("name"))).select(F.col("question_id").alias("term"), F.col("name").alias("question"))
    per = held.join(ontology, "term").groupBy("question").agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("term", "synonyms"))), lambda x: x["synonyms"]))).alias("synonyms"))
    return questions.join(per, "question", "left").select("question_id", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"))


def prepend_facts(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts (question_id, fact) as a hit of score 1 before the others."""
    one = facts.groupBy("question_id").agg(F.array_join(F.sort_array(F.collect_list("fact")), "\n").alias("content"))
    return hits.select("question_id", "pos", "content", F.col("similarity_score").cast("double").alias("similarity_score")).unionByName(one.select("question_id", F.lit(-1).alias("pos"), "content", F.lit(1.0).alias("similarity_score")))


def expand_synonyms(questions: DataFrame, ontology: dict[str, tuple[str, ...]]) -> DataFrame:
    """Questions with ``synonyms``: those of each term they contain, in the terms' order."""
    found = [F.when(F.contains("question", F.lit(t)), F.array(*map(F.lit, s))).otherwise(F.array().cast("array<string>")) for t, s in ontology.items() if s]
    return questions.withColumn("synonyms", F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>"))
