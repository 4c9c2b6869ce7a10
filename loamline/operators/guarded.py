"""Read-only SQL over named tables: one query, checked on its parsed plan before Spark resolves anything, a row cap, a deadline.

Spark resolves `text.`/some/file`` to a file and calls JVM methods by name, so the statement's words are not what must be checked.
The parsed plan is: it may hold nodes of queries only, its relations must be the given tables or its own common tables, and
its functions must be Spark's own, without those that reach outside of the data. All three are read from the plan's nodes and
expressions, so that no spelling of a string, name or comment matters. Parsing reads no file and runs no function.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Nodes of a parsed query. Whatever is not listed (commands, table functions, scripts, file scans) is refused.
QUERY_NODES = frozenset("""
Project Filter Aggregate Sort Join Union Distinct Except Intersect Window GlobalLimit LocalLimit LimitAll Offset Generate Pivot Unpivot Expand Sample
SubqueryAlias OneRowRelation UnresolvedRelation UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedInlineTable LocalRelation
UnresolvedWith CTE WithWindowDefinition LateralJoin LateralSubquery UnresolvedHint
""".split())  # fmt: skip
#: Functions of Spark that run code, read files, name things at run time or tell of the session.
OUTSIDE = frozenset("reflect java_method try_reflect identifier read_files read_kafka read_statestore input_file_name input_file_block_start input_file_block_length current_user user session_user current_catalog current_database current_schema version".split())
#: Expressions that name a relation, a column or a function only once the statement runs.
AT_RUN_TIME = frozenset({"ExpressionWithUnresolvedIdentifier", "UnresolvedFunctionName"})

_TEXT = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"", re.S)


def _each(items) -> Iterator:
    """The members of a collection of the JVM, nested ones too."""
    it = items.iterator()
    while it.hasNext():
        yield it.next()


def _walk(plan) -> Iterator[tuple[str, bool, object]]:
    """(class, is a plan, node) of all nodes of a parsed plan: plans, their expressions, and plans inside of expressions."""
    todo = [(plan, True)]
    while todo:
        node, is_plan = todo.pop()
        kind = node.getClass().getSimpleName()
        yield kind, is_plan, node
        if is_plan:
            todo += [(x, True) for x in [*_each(node.children()), *_each(node.innerChildren())]]
            todo += [(x, False) for x in _each(node.expressions())]
            if kind == "WithWindowDefinition":  # a map, which `expressions` leaves out
                todo += [(x, False) for x in _each(node.windowDefinitions().values())]
        else:
            todo += [(x, False) for x in _each(node.children())]
            if any(m.getName() == "plan" and not m.getParameterCount() for m in node.getClass().getMethods()):
                todo.append((node.plan(), True))


def functions(spark: SparkSession) -> frozenset[str]:
    """Names of Spark's own functions that a statement may call."""
    names = (r.function.removeprefix("system.builtin.").lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect())
    return frozenset(names) - OUTSIDE


def check(spark: SparkSession, sql: str, tables) -> str:
    """The statement without its closing semicolon; ValueError if it is anything but one query over the given tables."""
    body = sql.strip().removesuffix(";").rstrip()
    code = _TEXT.sub("''", body)
    if "--" in code or "/*" in code:  # a rule of the interface, not of safety
        raise ValueError("comments are not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except Exception as e:
        raise ValueError("not a single statement that can be parsed") from e
    relations, common, called = set(), set(), set()
    for kind, is_plan, node in _walk(plan):
        if is_plan and kind not in QUERY_NODES:
            raise ValueError(f"only queries are allowed, not {kind}")
        if not is_plan and kind in AT_RUN_TIME:
            raise ValueError("names that are settled at run time are not allowed")
        if kind == "UnresolvedRelation":
            relations.add(tuple(_each(node.multipartIdentifier())))
        elif kind == "UnresolvedWith":
            common |= {x.alias().lower() for x in _each(node.innerChildren())}
        elif kind == "UnresolvedFunction":
            called.add(tuple(_each(node.nameParts())))
        elif kind == "UnresolvedGenerator":
            called.add((node.name().funcName(),) if node.name().database().isEmpty() else (node.name().unquotedString(), ""))
    known = {x.lower() for x in tables} | common
    strange = sorted(".".join(r) for r in relations if len(r) > 1 or r[0].lower() not in known)
    if strange:
        raise ValueError(f"unknown tables: {', '.join(strange)}")
    mine = functions(spark) if called else frozenset()
    outside = sorted(".".join(f) for f in called if len(f) > 1 or f[0].lower() not in mine)
    if outside:
        raise ValueError(f"functions that reach outside of the tables, or are not Spark's own, are not allowed: {', '.join(outside)}")
    return body


def read_only_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int = 200) -> DataFrame:
    """The statement's rows, at most `limit` (1 to 10000) of them; the named tables are all it can read."""
    body = check(spark, sql, tables)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(body).limit(max(1, min(int(limit), 10_000)))


def collect_within(df: DataFrame, seconds: float = 5.0) -> list[dict]:
    """Rows as dicts; TimeoutError once the deadline has passed, with the running jobs interrupted."""
    spark, tag, late = df.sparkSession, f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.addTag(tag)
    timer.start()
    try:
        return [r.asDict(recursive=True) for r in df.collect()]
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"Query exceeded {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
