"""Read-only SQL over allowed tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ALLOWED = frozenset({"document_metadata"})
# Words that the compatible mode refuses anywhere in a statement.
DENIED = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "ATTACH", "PRAGMA", "VACUUM", "REPLACE", "MERGE", "GRANT", "REVOKE", "BEGIN", "COMMIT", "ROLLBACK")


class Refused(ValueError):
    """A statement that the guard does not let through."""


def _single(sql: object) -> str:
    if not isinstance(sql, str) or not sql.strip():
        raise Refused("no statement")
    text = sql.strip()
    if text.endswith(";"):
        text = text[:-1].strip()
    elif ";" in text:
        raise Refused("more than one statement")
    if not re.match(r"(?i)(?:with|select)\b", text):
        raise Refused("not a query")
    return text


def validate(spark: SparkSession, sql: object, allowed: frozenset[str] = ALLOWED, mode: str = "ast") -> str:
    """The statement without its last semicolon, or Refused.

    ``ast`` reads the parser's tree: every relation must be allowed or a CTE of the statement, and the
    plan must be a query. ``compat`` works on the text: denied words anywhere (also inside names such as
    created_time), and only the names right after FROM and JOIN are looked at.
    """
    text = _single(sql)
    if mode == "compat":
        upper = text.upper()
        for word in DENIED:
            if word in upper:
                raise Refused(f"denied word: {word}")
        tables = re.findall(r"(?i)\b(?:from|join)\s+([a-z_]\w*)", text)
        if not tables or any(t.lower() not in allowed for t in tables):
            raise Refused("a table is not allowed")
        return text
    if ";" in re.sub(r"'(?:[^']|'')*'", "", text):
        raise Refused("more than one statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise Refused("it does not parse") from e
    tree = plan.treeString()
    found = {".".join(p.strip(" `") for p in m.split(",")).lower() for m in re.findall(r"'UnresolvedRelation \[([^\]]+)\]", tree)}
    ctes = {c.strip(" `").lower() for c in re.findall(r"(?i)(?:\bwith|,)\s+(`?\w+`?)\s*(?:\([^()]*\))?\s+as\s*\(", text)}
    if re.search(r"'?(?:Insert|Create|Drop|Delete|Update|Merge|Alter|Truncate|AppendData|Overwrite|Command|UnresolvedTableValuedFunction|UnresolvedInlineTable)\w*", tree.split("\n")[0]):
        raise Refused("not a query")
    if not found - ctes or found - ctes - set(allowed):
        raise Refused("a table is not allowed")
    return text


def run(spark: SparkSession, sql: object, tables: dict[str, DataFrame], allowed: frozenset[str] = ALLOWED, mode: str = "ast") -> DataFrame:
    """The result of a statement that passes, over the tables given; views of the session with such names stay as they are."""
    text = validate(spark, sql, allowed, mode)
    from pyspark.sql.utils import AnalysisException

    before = {name: spark.table(name) for name in allowed if any(t.name == name and t.isTemporary for t in spark.catalog.listTables())}
    for name in allowed:
        if name in tables:
            tables[name].createOrReplaceTempView(name)
    try:
        return spark.sql(text)
    except AnalysisException as e:
        raise Refused(str(e).split("\n")[0]) from e
    finally:
        for name in allowed:
            spark.catalog.dropTempView(name)
            if name in before:
                before[name].createOrReplaceTempView(name)
