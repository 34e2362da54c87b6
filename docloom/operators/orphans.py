"""References to records that do not exist.

Parent keys are compressed into contiguous runs; a reference is matched as of the run start at or
before its key and is an orphan when its key lies beyond that run's end.

Scale. Keys are cut into blocks of ``BLOCK`` consecutive values, so runs and the distinct referenced
keys of one block meet in one window partition of bounded size (at most ``BLOCK`` keys and as many
runs), whatever the skew: references are reduced to distinct keys before any of this. The verdict of
a key returns to its references over two ways: keys that hold more than 1/``HOT_SHARE`` of a column's
references are at most ``HOT_SHARE`` in number and are broadcast; all others are joined by shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.tables import stage

BLOCK = 4096
HOT_SHARE = 256


@dataclass(frozen=True)
class Reference:
    """A column of a child table that names rows of a parent table."""

    child_table: str
    ref_field: str
    parent_table: str
    prefix: str = ""


REFERENCES = (
    Reference("document_chunks", "document_id", "document_files"),
    Reference("document_metadata", "chunk_id", "document_chunks", "chunk_"),
    Reference("graph_relations", "source_entity_id", "graph_entities"),
    Reference("graph_relations", "target_entity_id", "graph_entities"),
)


def key_number(col: Column, prefix: str = "") -> Column:
    """The integer a key names, after trimming and ignoring case; NULL when it is no such key or no BIGINT."""
    text = F.lower(F.trim(F.regexp_replace(col.cast("string"), r"^\s+|\s+$", "")))
    digits = F.regexp_extract(text, rf"^(?:{prefix})?(-?[0-9]+)$" if prefix else r"^(-?[0-9]+)$", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def block_of(key: Column) -> Column:
    return F.floor(key / F.lit(BLOCK)).cast("bigint")


def key_runs(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct integer column ``key`` -> (*by, block, run_start, run_end), one row per contiguous run.

    Runs end at block borders. Empty input gives no runs; NULL keys are no keys. ``by``: columns that
    keep several key spaces apart.
    """
    w = Window.partitionBy(*by, "block").orderBy("key")
    return (
        keys.where("key IS NOT NULL")
        .select(*by, "key")
        .distinct()
        .withColumn("block", block_of(F.col("key")))
        .withColumn("island", F.col("key") - F.row_number().over(w))
        .groupBy(*by, "block", "island")
        .agg(F.min("key").alias("run_start"), F.max("key").alias("run_end"))
        .drop("island")
    )


def beyond_runs(keys: DataFrame, runs: DataFrame, *by: str) -> DataFrame:
    """As-of match: (*by, key, present) for every distinct non-null ``key``; present = within a run."""
    asked = keys.where("key IS NOT NULL").select(*by, "key").distinct()
    both = asked.select(*by, block_of(F.col("key")).alias("block"), F.col("key").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("run_end")).unionByName(
        runs.select(*by, "block", F.col("run_start").alias("at"), F.lit(0).alias("kind"), "run_end")
    )
    w = Window.partitionBy(*by, "block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("reach", F.last("run_end", ignorenulls=True).over(w))
        .where("kind = 1")
        .select(*by, F.col("at").alias("key"), (F.coalesce(F.col("reach"), F.col("at") - 1) >= F.col("at")).alias("present"))
    )


def _references(tables: dict[str, DataFrame], references: tuple[Reference, ...]) -> DataFrame:
    """All non-null references of all columns: (ref, parent, key, child_id, created_time)."""

    def one(n: int, r: Reference) -> DataFrame:
        return (
            tables[r.child_table]
            .where(F.col(r.ref_field).isNotNull())
            .select(F.lit(n).alias("ref"), F.lit(r.parent_table).alias("parent"), key_number(F.col(r.ref_field), r.prefix).alias("key"), F.col("id").cast("bigint").alias("child_id"), "created_time")
        )

    return reduce(DataFrame.unionByName, [one(n, r) for n, r in enumerate(references)])


def _parents(tables: dict[str, DataFrame], names: list[str], soft_deleted: tuple[str, ...]) -> DataFrame:
    """(parent, key, parent_time, gone) of all parent rows; row copies and repeated keys are one."""

    def one(name: str) -> DataFrame:
        gone = (F.lower(F.trim(F.col("status"))) == "deleted").cast("int") if name in soft_deleted else F.lit(0)
        return tables[name].where("id IS NOT NULL").select(F.lit(name).alias("parent"), F.col("id").cast("bigint").alias("key"), "created_time", gone.alias("gone"))

    return reduce(DataFrame.unionByName, map(one, names)).groupBy("parent", "key").agg(F.max("created_time").alias("parent_time"), F.max("gone").alias("gone"))


def _deletions(log: DataFrame) -> DataFrame:
    return (
        log.select(F.lower(F.trim("table_name")).alias("parent"), F.coalesce(key_number(F.col("row_key")), key_number(F.col("row_key"), "chunk_")).alias("key"))
        .where("parent IS NOT NULL AND key IS NOT NULL")
        .distinct()
        .withColumn("logged", F.lit(True))
    )


def orphan_references(tables: dict[str, DataFrame], references: tuple[Reference, ...] = REFERENCES, soft_deleted: tuple[str, ...] = ("document_files",)) -> DataFrame:
    """(child_table, ref_field, child_id, orphan_kind, period) over all columns of ``references``.

    Exact copies of a child row count once. A NULL reference is no reference; a text that is no key
    of the parent's form names a row that cannot exist and is ``missing``. Unknown times are never
    ``late`` and give the period ``unknown``. Other columns of the inputs are ignored. A parent row
    whose status is deleted (tables in ``soft_deleted``) is no usable parent.
    """
    refs = _references(tables, references)
    keyed = refs.where("key IS NOT NULL")
    counts = keyed.groupBy("parent", "key").agg(F.count(F.lit(1)).alias("n"))
    parents = _parents(tables, sorted({r.parent_table for r in references}), soft_deleted)
    verdict = (
        counts.join(beyond_runs(counts, key_runs(parents, "parent"), "parent"), ["parent", "key"], "left")
        .join(parents, ["parent", "key"], "left")
        .join(_deletions(tables["deletion_log"]), ["parent", "key"], "left")
        .select(
            "parent",
            "key",
            "n",
            "parent_time",
            F.when(~F.coalesce("present", F.lit(False)), F.when(F.col("logged"), "deleted").otherwise("missing")).when(F.coalesce("gone", F.lit(0)) == 1, "deleted").alias("kind"),
        )
    )
    verdict = stage(verdict, "verdicts")
    total = verdict.agg(F.sum("n")).first()[0] or 0
    hot = verdict.where(F.col("n") * HOT_SHARE > total).drop("n")  # fewer than HOT_SHARE rows
    cold = verdict.where(F.col("n") * HOT_SHARE <= total).drop("n")
    marked = keyed.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["parent", "key"], "left")
    judged = marked.where("hot").drop("hot").unionByName(marked.where("hot IS NULL").drop("hot", "kind", "parent_time").join(cold, ["parent", "key"]))
    kind = F.coalesce("kind", F.when(F.col("parent_time") > F.col("created_time"), "late"))
    found = judged.select("ref", "child_id", "created_time", kind.alias("orphan_kind")).unionByName(refs.where("key IS NULL").select("ref", "child_id", "created_time", F.lit("missing").alias("orphan_kind")))

    def name(field: str) -> Column:
        return F.array(*(F.lit(getattr(r, field)) for r in references))[F.col("ref")]

    return (
        found.where("orphan_kind IS NOT NULL")
        .select(name("child_table").alias("child_table"), name("ref_field").alias("ref_field"), "child_id", "orphan_kind", F.coalesce(F.date_format("created_time", "yyyy-MM"), F.lit("unknown")).alias("period"))
        .distinct()
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, column, kind and period."""
    return found.groupBy("child_table", "ref_field", "orphan_kind", "period").agg(F.count(F.lit(1)).alias("orphans"))
