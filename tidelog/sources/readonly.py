"""Queries written by others: read-only by their parsed plan, over named tables, with bounded answers."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows and characters of a cell that an answer has, and seconds that it may take.
MAX_ROWS, MAX_CELL, TIMEOUT = 50, 200, 5.0
#: Functions that run code of their own choice.
_UNSAFE = {"reflect", "java_method", "try_reflect", "read_files", "read_kafka"}


#: Nodes of a parsed query; whatever else a text parses to is refused.
_QUERY = set(
    "UnresolvedWith UnresolvedRelation UnresolvedSubqueryAlias SubqueryAlias UnresolvedSubqueryColumnAliases Project Filter Join LateralJoin AsOfJoin Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except OneRowRelation "
    "UnresolvedInlineTable LocalRelation Window WithWindowDefinition UnresolvedHint Generate Pivot UnresolvedPivot Unpivot Sample RepartitionByExpression Repartition Range InnerScopedCTE".split()
)


class Refused(ValueError):
    """A text that is no single query over the given tables."""


@dataclass(frozen=True)
class Answer:
    columns: list[str]
    rows: list[tuple]
    truncated: bool


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.length())]


def _checked(spark: SparkSession, sql: str, tables: set[str]) -> None:
    jvm = spark.sparkContext._jvm
    if not sql.strip():
        raise Refused("empty")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().removesuffix(";"))
    except Exception as e:
        raise Refused("not one statement") from e
    is_a = lambda node, name: jvm.java.lang.Class.forName(name).isInstance(node)
    names = {t.lower() for t in tables}
    todo, relations = [plan], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        ranged = kind == "UnresolvedTableValuedFunction" and node.name().mkString(".").lower() == "range"
        if kind not in _QUERY and not ranged:
            raise Refused(f"{kind} is no query")
        if kind == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                names.add(pair.productElement(0).lower())
                todo.append(pair.productElement(1))
        if kind == "UnresolvedRelation":
            relations.append(node.multipartIdentifier().mkString(".").lower())
        exprs = _items(node.expressions())
        while exprs:
            e = exprs.pop()
            if e.getClass().getSimpleName() == "UnresolvedFunction" and e.nameParts().mkString(".").lower().split(".")[-1] in _UNSAFE:
                raise Refused("a function that runs code")
            if is_a(e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
                todo.append(e.plan())
            exprs += _items(e.children())
        todo += _items(node.children())
    unknown = sorted(set(relations) - names)
    if unknown:
        raise Refused(f"no table {unknown[0]}")


def query(tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """The rows of one query over `tables` by name, whole; Refused for anything else: commands, writes, several statements, scripts, other tables and files."""
    spark = next(iter(tables.values())).sparkSession
    _checked(spark, sql, set(tables))
    # Views of names that no session has used stand for the tables while the query is analysed.
    tag = uuid.uuid4().hex
    views = {n: f"_{tag}_{i}" for i, n in enumerate(tables)}
    for n, v in views.items():
        tables[n].createTempView(v)
    try:
        stands = ", ".join(f"`{n}` AS (SELECT * FROM {v})" for n, v in views.items())
        return spark.sql(f"WITH {stands} SELECT * FROM (\n{sql.strip().removesuffix(';')}\n)")
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)


def answer(tables: dict[str, DataFrame], sql: str, timeout: float = TIMEOUT) -> Answer:
    """At most MAX_ROWS rows of a query, cells as text of at most MAX_CELL characters, and whether there were more; a query that takes longer than `timeout` is cancelled."""
    found = query(tables, sql)
    spark = found.sparkSession
    flat = found.toDF(*[str(i) for i in range(len(found.columns))])
    cells = [F.substring(F.col(f"`{i}`").cast("string"), 1, MAX_CELL).alias(str(i)) for i in range(len(found.columns))]
    tag = f"query-{uuid.uuid4().hex}"
    late = threading.Timer(timeout, lambda: spark.sparkContext.cancelJobsWithTag(tag))
    spark.sparkContext.addJobTag(tag)
    late.start()
    try:
        rows = flat.select(*cells).limit(MAX_ROWS + 1).collect()
    except Exception as e:
        if not late.is_alive():
            raise TimeoutError(f"no answer in {timeout} s") from e
        raise
    finally:
        late.cancel()
        spark.sparkContext.removeJobTag(tag)
    return Answer(found.columns, [tuple(r) for r in rows[:MAX_ROWS]], len(rows) > MAX_ROWS)
