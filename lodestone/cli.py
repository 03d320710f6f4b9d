"""Command line: python -m lodestone.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .daemon import DaemonOptions, query_json, serve_forever
from .errors import LodestoneError
from .functions.keys import encode_cli_key
from .functions.times import parse_time_ms
from .operators.index import Index, QueryOptions, naive_scan
from .operators.secondary import Secondary
from .operators.sql_scope import run_sql
from .session import get_spark
from .sources import layouts
from .sources.sinks import json_rows
from .sources.snapshots import index_table
from .stress import bench, stress


def _columns(values: list[str] | None) -> list[str]:
    return [c.strip() for v in values or [] for c in v.split(",") if c.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description="Keyed lookups over Parquet, on Spark")
    p.add_argument("--cpus", default="*")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, index: bool = True):
        q = sub.add_parser(name, help=text)
        if index:
            q.add_argument("--index", required=True)
            q.add_argument("--time-column", default="timestamp")
        return q

    def lookup_args(q):
        q.add_argument("key")
        q.add_argument("--offset", type=int, default=0)
        q.add_argument("--columns", action="append")
        q.add_argument("--since")
        q.add_argument("--until")
        q.add_argument("--min-listens", type=int)
        q.add_argument("--covering-only", action="store_true")
        q.add_argument("--no-verify", action="store_true")

    def build_args(q):
        q.add_argument("--key-columns", action="append", default=None)
        q.add_argument("--buckets", type=int, default=16)
        q.add_argument("--covering", action="store_true")

    q = add("generate", "write sample listening history", index=False)
    q.add_argument("--out", required=True)
    q.add_argument("--layout", choices=layouts.LAYOUTS, default="sorted")
    q.add_argument("--users", type=int, default=24)
    q.add_argument("--per-user", type=int, default=6)
    q.add_argument("--files", type=int, default=2)
    q.add_argument("--seed", type=int, default=42)
    q = add("lake-generate", "write a lake of date and bucket folders", index=False)
    q.add_argument("--out", required=True)
    q.add_argument("--users", type=int, default=1000)
    q.add_argument("--per-user", type=int, default=4)
    q.add_argument("--days", type=int, default=2)
    q.add_argument("--buckets", type=int, default=8)
    q = add("index", "append a fragment over Parquet files")
    q.add_argument("--data", action="append", required=True)
    q.add_argument("--fragment-id")
    q.add_argument("--note")
    build_args(q)
    q = add("snapshot-index", "follow a table's snapshots")
    q.add_argument("--table")
    q.add_argument("--rest-uri")
    q.add_argument("--namespace")
    q.add_argument("--table-name")
    q.add_argument("--rest-token", default=os.environ.get("LODESTONE_REST_TOKEN"))
    q.add_argument("--catalog")
    build_args(q)
    q = add("query", "the rows of a key")
    lookup_args(q)
    q.add_argument("--limit", type=int, default=10)
    q = add("explain", "what a query would touch")
    lookup_args(q)
    q.add_argument("--limit", type=int)
    q.add_argument("--pages", action="store_true", help="read footers for the pages that hold the key's rows")
    q = add("secondary-build", "index another column")
    q.add_argument("--dimension", required=True)
    q = add("secondary-query", "rows by another column: a value (or prefix), or a range")
    q.add_argument("--dimension", required=True)
    q.add_argument("--value")
    q.add_argument("--range-start")
    q.add_argument("--range-end")
    q.add_argument("--offset", type=int, default=0)
    q.add_argument("--limit", type=int, default=10)
    q = add("sql", "SQL over the rows of a key")
    q.add_argument("--key")
    q.add_argument("--sql", required=True)
    add("stats", "fragments and files")
    q = add("compact", "rewrite the live set as one fragment")
    q.add_argument("--fragment-id")
    q = add("forget", "hide keys")
    q.add_argument("keys", nargs="+")
    q.add_argument("--check", action="store_true")
    add("verify", "compare files with their stored identity")
    q = add("bench", "lookups against a scan")
    q.add_argument("--keys", type=int, default=5)
    q.add_argument("--rounds", type=int, default=1)
    q = add("stress", "concurrent lookups")
    q.add_argument("--keys", type=int, default=20)
    q.add_argument("--workers", type=int, default=4)
    q.add_argument("--rate", type=float)
    q = add("scan", "the rows of a key by a scan", index=False)
    q.add_argument("key")
    q.add_argument("--data", action="append", required=True)
    q.add_argument("--key-columns", action="append", default=None)
    q = add("daemon", "HTTP JSON service")
    q.add_argument("--host", default="127.0.0.1")
    q.add_argument("--port", type=int, default=8080)
    q.add_argument("--token", default=os.environ.get("LODESTONE_TOKEN"))
    q.add_argument("--tls-cert")
    q.add_argument("--tls-key")
    q.add_argument("--insecure", action="store_true")
    q = add("demo", "generate, index, query and bench", index=False)
    q.add_argument("--out", required=True)
    return p


def _options(a) -> QueryOptions:
    return QueryOptions(offset=a.offset, limit=a.limit, columns=_columns(a.columns) or None, since_ms=parse_time_ms(a.since) if a.since else None, until_ms=parse_time_ms(a.until, end_of_day=True) if a.until else None, covering_only=a.covering_only, min_count=a.min_listens, verify=not a.no_verify)


def run(a, spark, out=sys.stdout) -> int:
    def show(value) -> None:
        print(json.dumps(value, default=str), file=out)

    def lines(df) -> None:
        for r in json_rows(df).toLocalIterator():
            print(r[0], file=out)

    keys = _columns(getattr(a, "key_columns", None)) or ["user_id"]
    index = Index(spark, a.index, a.time_column) if getattr(a, "index", None) else None
    if a.command == "generate":
        layouts.write_layout(layouts.sample_listens(spark, a.users, a.per_user, a.seed), a.out, a.layout, files=a.files)
        show({"out": a.out, "layout": a.layout})
    elif a.command == "lake-generate":
        layouts.lake(spark, a.out, a.users, a.per_user, a.days, a.buckets)
        show({"out": a.out})
    elif a.command == "index":
        show({"fragment_id": index.build(a.data, keys, fragment_id=a.fragment_id, buckets=a.buckets, covering=a.covering, note=a.note)})
    elif a.command == "snapshot-index":
        rest = {"uri": a.rest_uri, "namespace": a.namespace, "table": a.table_name, "token": a.rest_token} if a.rest_uri else None
        show(vars(index_table(index, keys, a.table, rest, a.catalog, buckets=a.buckets, covering=a.covering)))
    elif a.command == "query":
        show(query_json(index, encode_cli_key(a.key), _options(a)))
    elif a.command == "explain":
        show(index.explain(encode_cli_key(a.key), _options(a), a.pages))
    elif a.command == "secondary-build":
        Secondary(index, a.dimension).build()
        show({"dimension": a.dimension})
    elif a.command == "secondary-query":
        s = Secondary(index, a.dimension)
        refs = s.lookup_range(a.range_start, a.range_end) if a.range_start is not None and a.range_end is not None else s.lookup(a.value)
        lines(s.rows(refs, a.offset, a.limit))
    elif a.command == "sql":
        lines(run_sql(index, a.sql, encode_cli_key(a.key) if a.key else None))
    elif a.command == "stats":
        show(index.stats())
    elif a.command == "compact":
        show(index.compact(a.fragment_id))
    elif a.command == "forget":
        names = [encode_cli_key(k) for k in a.keys]
        had = [r[0] for r in index.entries(names).select("key").distinct().collect()] if a.check else None
        show({"fragment_id": index.forget(names)} | ({"had_entries": sorted(had)} if a.check else {}))
    elif a.command == "verify":
        counts = {r.status: r["count"] for r in index.verify().groupBy("status").count().collect()}
        show({k: counts.get(k, 0) for k in ("ok", "stale", "skipped")})
        return 1 if counts.get("stale") else 0
    elif a.command == "bench":
        show(bench(index, a.keys, a.rounds))
    elif a.command == "stress":
        result = stress(index, a.keys, a.workers, rate=a.rate)
        show(result)
        return 1 if result["mismatches"] else 0
    elif a.command == "scan":
        lines(naive_scan(spark, a.data, keys, encode_cli_key(a.key)))
    elif a.command == "daemon":
        serve_forever(spark, DaemonOptions(a.index, a.host, a.port, a.token, a.tls_cert, a.tls_key, a.insecure, a.time_column))
    elif a.command == "demo":
        layouts.write_layout(layouts.sample_listens(spark), f"{a.out}/data", "sorted")
        index = Index(spark, f"{a.out}/index")
        index.build(f"{a.out}/data", ["user_id"], covering=True)
        show(query_json(index, "user_0000", QueryOptions(limit=3)))
        show(bench(index, 3))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(a, get_spark(a.cpus))
    except (LodestoneError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
