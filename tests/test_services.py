import http.server
import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from lodestone import cli, daemon
from lodestone.errors import CatalogError, UnsupportedDeletes
from lodestone.operators.index import Index
from lodestone.sources import layouts, snapshots
from lodestone.streaming.incremental import index_new_files

KEYS = {"key", "rows", "covering", "covering_values", "timings", "totals"}


def get(url, token=None, method="GET"):
    r = urllib.request.Request(url, method=method, headers={"Authorization": token} if token else {})
    try:
        with urllib.request.urlopen(r) as x:
            return x.status, json.load(x)
    except urllib.error.HTTPError as e:
        return e.code, json.load(e)


def test_daemon(spark, listens, tmp_path):
    root = str(tmp_path / "i")
    Index(spark, root).build(listens, ["user_id"], covering=True)
    h = daemon.start(spark, daemon.DaemonOptions(root, token="t"))
    try:
        u = h.base_url()
        assert get(f"{u}/health") == (200, {"ok": True})
        assert get(f"{u}/v1/query?key=x")[1] == {"error": "unauthenticated", "message": "unauthorized"}
        assert get(f"{u}/v1/query?key=x", "Bearer no")[1]["message"] == "invalid token"
        status, body = get(f"{u}/v1/query?key=user_0001&limit=2&columns=user_id,track_uri", "Bearer t")
        assert status == 200 and set(body) == KEYS and len(body["rows"]) == 2 and set(body["rows"][0]) == {"user_id", "track_uri"}
        assert body["covering_values"][0]["value_count"] == body["covering_values"][0]["listen_count"] == 6
        assert get(f"{u}/v1/query?key=a&limit=x", "Bearer t") == (400, {"error": "bad_request", "message": "invalid limit"})
        assert get(f"{u}/v1/query", "Bearer t")[0] == 400
        assert get(f"{u}/nope", "Bearer t")[0] == 404
        assert get(f"{u}/v1/query", "Bearer t", "POST")[0] == 405
        assert get(f"{u}/v1/explain?key=user_0001", "Bearer t")[1]["num_entries"] == 1
        assert get(f"{u}/v1/stats", "Bearer t")[1]["num_fragments"] == 1
    finally:
        h.stop()
    with pytest.raises(ValueError):
        daemon.check_policy(daemon.DaemonOptions(root, host="0.0.0.0"))
    daemon.check_policy(daemon.DaemonOptions(root, host="0.0.0.0", insecure=True))


def run(spark, *argv):
    out = io.StringIO()
    code = cli.run(cli.parser().parse_args(list(argv)), spark, out)
    return code, [json.loads(x) for x in out.getvalue().splitlines()]


def test_cli(spark, tmp_path):
    d, i = str(tmp_path / "d"), str(tmp_path / "i")
    run(spark, "generate", "--out", d, "--users", "5", "--per-user", "3")
    assert run(spark, "index", "--index", i, "--data", d, "--covering", "--fragment-id", "a")[1] == [{"fragment_id": "a"}]
    assert len(run(spark, "query", "--index", i, "user_0001")[1][0]["rows"]) == 3
    assert run(spark, "explain", "--index", i, "user_0001")[1][0]["num_entries"] == 1
    assert run(spark, "sql", "--index", i, "--key", "user_0001", "--sql", "select count(*) n from hits")[1] == [{"n": 3}]
    run(spark, "secondary-build", "--index", i, "--dimension", "track_uri")
    assert len(run(spark, "secondary-query", "--index", i, "--dimension", "track_uri", "--range-start", "a", "--range-end", "z", "--limit", "4")[1]) == 4
    assert run(spark, "forget", "--index", i, "user_0001", "--check")[1][0]["had_entries"] == ["user_0001"]
    assert run(spark, "compact", "--index", i)[1][0]["keys"] == 4
    code, (found,) = run(spark, "verify", "--index", i)
    assert code == 0 and found["ok"] >= 1 and found["stale"] == 0
    assert run(spark, "stats", "--index", i)[1][0]["num_fragments"] == 1
    assert len(run(spark, "scan", "--data", d, "user_0002")[1]) == 3
    assert run(spark, "stress", "--index", i, "--keys", "3", "--workers", "2")[1][0]["mismatches"] == 0


def avro(spark, path, schema, records):
    jvm = spark._jvm
    s = jvm.org.apache.avro.Schema.Parser().parse(json.dumps(schema))
    w = jvm.org.apache.avro.file.DataFileWriter(jvm.org.apache.avro.generic.GenericDatumWriter(s))
    w.create(s, jvm.java.io.File(path))

    def record(schema, value):
        out = jvm.org.apache.avro.generic.GenericData.Record(schema)
        for k, v in value.items():
            out.put(k, record(schema.getField(k).schema(), v) if isinstance(v, dict) else v)
        return out

    for r in records:
        w.append(record(s, r))
    w.close()


LIST = {"type": "record", "name": "m", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "sequence-number".replace("-", "_"), "type": "long"}]}
ENTRY = {"type": "record", "name": "e", "fields": [{"name": "status", "type": "int"}, {"name": "data_file", "type": {"type": "record", "name": "f", "fields": [{"name": "file_path", "type": "string"}, {"name": "content", "type": "int"}]}}]}


def snapshot(spark, root, number, manifests):
    """manifests: lists of (path, content, status), with the sequence number of each."""
    meta = root / "metadata"
    meta.mkdir(exist_ok=True)
    listed = []
    for k, (seq, files) in enumerate(manifests):
        path = str(meta / f"m{number}-{k}.avro")
        avro(spark, path, ENTRY, [{"status": s, "data_file": {"file_path": p, "content": c}} for p, c, s in files])
        listed.append({"manifest_path": path, "sequence_number": seq})
    avro(spark, str(meta / f"l{number}.avro"), LIST, listed)
    (meta / f"v{number}.metadata.json").write_text(json.dumps({"location": str(root), "current-snapshot-id": number, "snapshots": [{"snapshot-id": number, "manifest-list": str(meta / f"l{number}.avro")}]}))
    (meta / "version-hint.text").write_text(str(number))


@pytest.fixture()
def files(spark, tmp_path):
    out = []
    for k in range(3):
        p = str(tmp_path / f"f{k}")
        layouts.sample_listens(spark, 3, 4, seed=k).coalesce(1).write.parquet(p)
        out.append(spark.read.parquet(p).select("_metadata.file_path").first()[0])
    return out


def test_snapshots(spark, tmp_path, files):
    index = Index(spark, str(tmp_path / "i"))
    table = tmp_path / "t"
    table.mkdir()
    go = lambda: snapshots.index_table(index, ["user_id"], str(table), covering=True)
    count = lambda: index.lookup("user_0001").rows.count()
    snapshot(spark, table, 1, [(1, [(files[0], 0, 1), (files[1], 0, 1)])])
    assert go().files_indexed == 2 and count() == 8
    assert go().skipped
    pos = str(tmp_path / "pos")
    spark.createDataFrame([(files[0], 0), (files[0], 1)], "file_path string, pos long").coalesce(1).write.parquet(pos)
    row = spark.read.parquet(files[0]).select("user_id", "_metadata.row_index").filter("row_index < 2 and user_id = 'user_0001'").count()
    pos = spark.read.parquet(pos).select("_metadata.file_path").first()[0]
    snapshot(spark, table, 2, [(1, [(files[0], 0, 1), (files[1], 0, 1)]), (2, [(pos, 1, 1)])])
    assert go().files_indexed == 1 and count() == 8 - row
    eq = str(tmp_path / "eq")
    spark.createDataFrame([("user_0001",)], "user_id string").coalesce(1).write.parquet(eq)
    eq = spark.read.parquet(eq).select("_metadata.file_path").first()[0]
    # the third file comes after the delete, so the delete does not touch it
    snapshot(spark, table, 3, [(1, [(files[0], 0, 1), (files[1], 0, 2)]), (2, [(pos, 1, 1)]), (3, [(eq, 2, 1)]), (4, [(files[2], 0, 1)])])
    assert go().files_indexed == 2 and count() == 4
    assert index.lookup("user_0002").rows.count() >= 6
    assert snapshots.read_current_snapshot_id(spark, str(table)) == 3 and len(snapshots.list_current_files(spark, str(table))) == 2
    index.compact()
    assert count() == 4 and go().skipped
    snapshot(spark, table, 1, [(1, [(files[0], 0, 1), (files[1], 0, 1)])])  # rolled back
    assert not go().skipped and count() == 8


def test_snapshots_fail_closed(spark, tmp_path, files):
    index = Index(spark, str(tmp_path / "i"))
    for k, bad in enumerate([("/x/d.puffin", 1), ("/x/a.orc", 0), (files[0], 7)]):
        table = tmp_path / f"t{k}"
        table.mkdir()
        snapshot(spark, table, 1, [(1, [(bad[0], bad[1], 1)])])
        with pytest.raises(UnsupportedDeletes):
            snapshots.index_table(index, ["user_id"], str(table))
    spark.createDataFrame([(files[0], -1)], "file_path string, pos long").coalesce(1).write.parquet(str(tmp_path / "p"))
    bad = spark.read.parquet(str(tmp_path / "p")).select("_metadata.file_path").first()[0]
    snap = snapshots.Snapshot(9, "", [(files[0], 1)], [(bad, 1)])
    with pytest.raises(UnsupportedDeletes):
        snapshots.index_snapshot(index, snap, ["user_id"])
    assert index.store.registry() == []
    with pytest.raises(CatalogError):
        snapshots.index_table(index, ["user_id"], catalog="glue")


def test_rest_catalog():
    seen = []

    class H(http.server.BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_GET(self):
            seen.append((self.path, self.headers.get("Authorization")))
            code = 503 if len(seen) < 3 else 404 if "gone" in self.path else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"metadata": {"current-snapshot-id": -1}}).encode())

    s = http.server.HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        uri = f"http://127.0.0.1:{s.server_address[1]}"
        assert snapshots.rest_metadata(uri, "a.b", "t", "k", pause_s=0) == {"current-snapshot-id": -1}
        assert len(seen) == 3 and seen[-1] == ("/v1/namespaces/a%1Fb/tables/t", "Bearer k")
        with pytest.raises(CatalogError):
            snapshots.rest_metadata(uri, "a", "gone")
    finally:
        s.shutdown()


def test_stream(spark, listens, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    for _ in range(2):  # the second run finds nothing new
        index_new_files(index, listens, ["user_id"], str(tmp_path / "c"), max_files=1)
    assert index.stats()["num_fragments"] == 2 and index.lookup("user_0005").rows.count() == 6
