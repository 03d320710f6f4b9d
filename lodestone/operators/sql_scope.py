"""Spark SQL over the rows of looked-up keys: the view `hits` and the table function `key_lookup('k')`."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SqlScopeError
from ..functions.keys import key_expr
from .index import Index, QueryOptions, expand_items
from .postings import join_at

_SCOPE = "SQL runs over the rows of looked-up keys: it may name only `hits` and key_lookup('key')"


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _named(spark, sql: str) -> tuple[set[str], set[str], list[str | None]]:
    """Relations and table functions that a query names outside its own CTEs, and the literal keys of key_lookup (None: another argument), by the parsed plan.

    Only the grammar's queries pass: no statement that writes, sets or shows anything."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    parser.parsePlan(sql)  # what is no SQL at all says so
    try:
        plan = parser.parseQuery(sql)
    except Exception as e:
        raise SqlScopeError(_SCOPE) from e
    tables, functions, keys = set(), set(), []

    def expression(e, own):
        if hasattr_plan(e):
            node(e.plan(), own)
        for c in _seq(e.children()):
            expression(c, own)

    def node(p, own):
        kind = p.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            for cte in _seq(p.cteRelations()):  # each sees those before it
                node(cte._2(), own | {cte._1().lower()} if p.allowRecursion() else own)
                own = own | {cte._1().lower()}
        elif kind == "UnresolvedRelation":
            name = ".".join(_seq(p.multipartIdentifier())).lower()
            if name not in own:
                tables.add(name)
        elif kind == "UnresolvedTableValuedFunction":
            name = ".".join(_seq(p.name())).lower()
            functions.add(name)
            if name == "key_lookup":
                args = _seq(p.functionArgs())
                literal = len(args) == 1 and args[0].getClass().getSimpleName() == "Literal" and args[0].value() is not None
                keys.append(args[0].value().toString() if literal else None)
        for e in _seq(p.expressions()):
            expression(e, own)
        for c in _seq(p.children()):
            node(c, own)

    subquery = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression", False, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    hasattr_plan = subquery.isInstance
    node(plan, frozenset())
    return tables, functions, keys


def run_sql(index: Index, sql: str, key: str | None = None, opts: QueryOptions | None = None) -> DataFrame:
    """The result of sql in a session that holds only `hits` (the rows of key; none without one) and key_lookup."""
    named, functions, keys = _named(index.spark, sql)
    if not (named | functions) & {"hits", "key_lookup"} or named - {"hits"} or functions - {"key_lookup", "range", "explode", "stack"}:
        raise SqlScopeError(_SCOPE)
    session = index.spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    inner = Index(session, index.store.fs.root, index.time_column)
    opts = opts or QueryOptions()
    hits = inner.lookup(key, opts).rows if key is not None else inner._empty(opts)
    hits.createOrReplaceTempView("hits")
    if "key_lookup" in functions:
        rows = _of_any_key(inner) if None in keys else reduce(DataFrame.unionByName, [_of_key(inner, k) for k in dict.fromkeys(keys)])
        hidden = f"v{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(hidden)
        cols = [c for c in rows.columns if c != "_key"]
        names = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in cols)
        cols = ", ".join(f"`{c}`" for c in cols)
        session.sql(f"CREATE TEMPORARY FUNCTION key_lookup(k STRING) RETURNS TABLE({names}) RETURN SELECT {cols} FROM {hidden} WHERE _key = k")
    return session.sql(sql)


def _of_key(index: Index, key: str) -> DataFrame:
    """The rows of a literal key, with it as _key: a lookup, so only its files are read, by a pushed predicate."""
    rows = index.lookup(key).rows.drop("source_file", "row_number")
    return rows.withColumn("_key", F.lit(key))


def _of_any_key(index: Index) -> DataFrame:
    """All live rows with their _key, for arguments that the plan does not tell."""
    entries = index.entries()
    data, few = index.data_of(entries)
    if data is None:
        return index._empty(QueryOptions()).drop("source_file", "row_number").withColumn("_key", F.lit(""))
    m = F.col("_metadata")
    rows = data.select("*", key_expr(data.schema, index.key_columns()).alias("_key"), m["file_path"].alias("_file"), m["row_index"].alias("_row"))
    live = entries.select(F.col("key").alias("_key"), F.col("file_path").alias("_file"), F.explode("row_numbers").alias("_row"))
    rows = join_at(rows, live, ["_key", "_file", "_row"], few)  # as often as entries name them, as in a lookup
    rows, cols, _ = expand_items(rows.drop("_row", "_file"), data.schema, index.time_column)
    return rows.select(*[F.col(f"`{c}`") for c in cols], "_key")
