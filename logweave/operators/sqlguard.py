"""Read-only SQL over the registered tables, with a default limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a result that names no limit itself (a fixed value).
MAX_ROWS = 500


class NotReadOnly(ValueError):
    """The statement would change something or is a command."""


def check_read_only(spark: SparkSession, sql: str) -> None:
    """Parse with Spark's parser and reject commands and writes anywhere in the plan."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        command = any(c.getSimpleName() == "Command" for c in _kinds(node.getClass()))
        if command or kind.startswith(("InsertInto", "Create", "Drop", "Replace", "Set", "Unresolved" + "Insert")) or kind in ("OverwriteByExpression", "AppendData"):
            raise NotReadOnly(f"{kind} is not allowed")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]


def _kinds(cls) -> list:
    found, todo = [], [cls]
    while todo:
        c = todo.pop()
        found.append(c)
        todo += list(c.getInterfaces()) + ([c.getSuperclass()] if c.getSuperclass() is not None else [])
    return found


def is_limited(spark: SparkSession, sql: str) -> bool:
    """Whether the outermost query has a limit; one inside of it, in a text or in a comment is none."""
    node = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    while node.getClass().getSimpleName() in ("UnresolvedWith", "UnresolvedHint", "GlobalOffset", "Offset"):
        node = node.children().apply(0)
    return node.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit")


def query(spark: SparkSession, sql: str) -> DataFrame:
    """The result of a SELECT; where it has no LIMIT of its own, at most MAX_ROWS rows."""
    text = sql.strip().rstrip(";").rstrip()
    check_read_only(spark, text)
    out = spark.sql(text)
    return out if is_limited(spark, text) else out.limit(MAX_ROWS)


def as_payload(df: DataFrame) -> dict:
    """columns, rows and row_count of a result whose size its limit bounds; times as ISO text."""
    rows = [[x.isoformat() if hasattr(x, "isoformat") else x if isinstance(x, (int, float, bool, str, list, dict, type(None))) else str(x) for x in r] for r in df.collect()]
    return {"columns": df.columns, "rows": rows, "row_count": len(rows)}
