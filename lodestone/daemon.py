"""HTTP JSON service over an index: /health, /v1/query, /v1/explain, /v1/stats. GET only; bearer token; TLS off loopback."""

from __future__ import annotations

import hmac
import ipaddress
import json
import ssl
import threading
import urllib.parse
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .errors import BadRequest, LodestoneError
from .operators.index import Index, QueryOptions
from .sources.sinks import json_rows


@dataclass
class DaemonOptions:
    index: str
    host: str = "127.0.0.1"
    port: int = 0
    token: str | None = None
    tls_cert: str | None = None
    tls_key: str | None = None
    insecure: bool = False
    time_column: str | None = "timestamp"


def is_loopback(host: str) -> bool:
    try:
        return ipaddress.ip_address(host).is_loopback
    except ValueError:
        return host == "localhost"


def check_policy(o: DaemonOptions) -> None:
    if bool(o.tls_cert) != bool(o.tls_key):
        raise ValueError("a TLS certificate and its key go together")
    if not is_loopback(o.host) and not o.insecure and not (o.tls_cert and o.token):
        raise ValueError("off loopback the daemon needs a TLS certificate and a token, or insecure")


def parse_options(query: str) -> tuple[str, QueryOptions]:
    p = {k: v[-1] for k, v in urllib.parse.parse_qs(query, keep_blank_values=True).items()}

    def number(name: str, default=None):
        if not p.get(name):
            return default
        try:
            n = int(p[name])
        except ValueError:
            raise BadRequest(f"invalid {name}") from None
        if n < 0 and name in ("offset", "limit", "min_listens"):
            raise BadRequest(f"invalid {name}")
        return n

    def flag(name: str, default: bool) -> bool:
        return p[name].lower() in ("1", "true", "yes", "on") if name in p else default

    if not p.get("key"):
        raise BadRequest("missing key")
    columns = [c.strip() for c in p.get("columns", "").split(",") if c.strip()]
    return p["key"], QueryOptions(offset=number("offset", 0), limit=number("limit"), columns=columns or None, since_ms=number("since_ms"), until_ms=number("until_ms"), covering_only=flag("covering_only", False), min_count=number("min_listens"), verify=flag("verify", True))


def query_json(index: Index, key: str, opts: QueryOptions) -> dict:
    r = index.lookup(key, opts)
    rows = [json.loads(x[0]) for x in json_rows(r.rows.drop("source_file", "row_number")).collect()] if r.rows is not None else []
    values = []
    for c in r.covering.collect():
        total = int(c.total) if c.total is not None and c.total == int(c.total) else float(c.total or 0)
        values.append({"file": c.file, "value_count": c.value_count, "listen_count": c.value_count, "total_duration_ms": total, "min_ts": c.min_ts, "max_ts": c.max_ts})
    t = r.metrics["timings"]
    lookup, resolve, plan = t.get("index_lookup_ms", 0), t.get("metadata_resolve_ms", 0), t.get("plan_ms", 0)
    totals = r.metrics["totals"]
    return {
        "key": key,
        "rows": rows,
        "covering": [f"file={v['file']} listen_count={v['listen_count']}" for v in values],
        "covering_values": values,
        "timings": {"index_lookup_ms": lookup, "metadata_resolve_ms": max(0, resolve - lookup), "ranged_read_ms": 0, "decode_extract_ms": max(0, plan - resolve), "total_ms": max(lookup, resolve, plan)},
        "totals": {"rows": len(rows), "value_count": totals["value_count"], "bytes_ranged": 0, "pages_touched": 0, "files_touched": totals["files_touched"], "skipped_by_predicate": totals["skipped_by_predicate"], "offset": opts.offset, "limit": opts.limit},
    }


class DaemonHandle:
    def __init__(self, server: ThreadingHTTPServer, base_url: str):
        self._server, self._url = server, base_url
        self._thread = threading.Thread(target=server.serve_forever, daemon=True)
        self._thread.start()

    def base_url(self) -> str:
        return self._url

    def stop(self) -> None:
        self._server.shutdown()
        self._server.server_close()
        self._thread.join(5)


def start(spark: SparkSession, o: DaemonOptions) -> DaemonHandle:
    check_policy(o)
    index = Index(spark, o.index, o.time_column)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def send(self, status: int, body: dict) -> None:
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def refuse(self) -> None:
            self.send(405, {"error": "method_not_allowed", "message": "method not allowed"})

        do_POST = do_PUT = do_DELETE = do_PATCH = do_HEAD = do_OPTIONS = refuse

        def do_GET(self) -> None:
            url = urllib.parse.urlsplit(self.path)
            if url.path == "/health":
                return self.send(200, {"ok": True})
            if o.token:
                got = self.headers.get("Authorization")
                if not got or not got.startswith("Bearer "):
                    return self.send(401, {"error": "unauthenticated", "message": "unauthorized"})
                if not hmac.compare_digest(got[7:].encode(), o.token.encode()):
                    return self.send(401, {"error": "unauthenticated", "message": "invalid token"})
            try:
                if url.path == "/v1/query":
                    body = query_json(index, *parse_options(url.query))
                elif url.path == "/v1/explain":
                    body = index.explain(*parse_options(url.query))
                elif url.path == "/v1/stats":
                    body = index.stats()
                else:
                    return self.send(404, {"error": "not_found", "message": "not found"})
            except LodestoneError as e:
                return self.send(400 if e.code == "bad_request" else 500, {"error": e.code, "message": str(e)} | e.extra)
            except Exception as e:  # a request must not end the daemon
                return self.send(500, {"error": "internal", "message": str(e).splitlines()[0][:300] if str(e) else type(e).__name__})
            self.send(200, body)

    server = ThreadingHTTPServer((o.host, o.port), Handler)
    scheme = "http"
    if o.tls_cert:
        context = ssl.SSLContext(ssl.PROTOCOL_TLS_SERVER)
        context.load_cert_chain(o.tls_cert, o.tls_key)
        server.socket = context.wrap_socket(server.socket, server_side=True)
        scheme = "https"
    return DaemonHandle(server, f"{scheme}://{o.host}:{server.server_address[1]}")


def serve_forever(spark: SparkSession, o: DaemonOptions) -> None:
    handle = start(spark, o)
    print(handle.base_url(), flush=True)
    try:
        threading.Event().wait()
    finally:
        handle.stop()
