"""Running generated SQL: one SELECT over known tables, at most so many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LIMIT = 10
#: Plan nodes that read or write anything but registered views.
REFUSED = ("Command", "InsertInto", "CreateTable", "DropTable", "SetCatalog", "AddJar", "OverwriteBy", "AppendData", "DeleteFrom", "UpdateTable", "MergeInto")


class Refused(ValueError):
    """The statement is not a SELECT over the tables allowed."""


def relations(spark: SparkSession, sql: str) -> tuple[set[str], str]:
    """Names of the tables a statement reads, and its parsed plan's text; nothing is run."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    names, stack = set(), [plan]
    while stack:
        node = stack.pop()
        if node.nodeName() == "UnresolvedRelation":
            names.add(node.tableName().replace("`", "").lower())
        if any(word in node.nodeName() for word in REFUSED):
            raise Refused(f"not a query: {node.nodeName()}")
        for group in (node.children(), node.innerChildren(), node.subqueries()):
            stack += [group.apply(i) for i in range(group.size()) if hasattr(group.apply(i), "nodeName")]
    return names, plan.toString()


def select(spark: SparkSession, sql: str, allowed: set[str], limit: int = LIMIT) -> DataFrame:
    """The rows of a SELECT, ``limit`` at most; anything else raises ``Refused``."""
    statement = sql.strip().rstrip(";").strip()
    if not statement.lower().startswith(("select", "with")) or ";" in statement:
        raise Refused("one SELECT is allowed")
    names, _ = relations(spark, statement)
    defined = {n.lower() for n in _common_names(statement)}
    if unknown := names - {a.lower() for a in allowed} - defined:
        raise Refused(f"tables not allowed: {', '.join(sorted(unknown))}")
    return spark.sql(statement).limit(limit)


def _common_names(sql: str) -> list[str]:
    import re

    return re.findall(r"(?i)(?:\bwith|,)\s+([A-Za-z_]\w*)\s+as\s*\(", sql)
