"""Table snapshots: metadata discovery, manifests, deletes, and incremental indexing."""

from __future__ import annotations

import json
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CatalogError, UnsupportedDeletes
from ..operators.index import Index
from ..operators.postings import canonical
from ..plans.fs import Fs

#: Numbers for the content of a data file in a manifest, and for an entry that was deleted (fixed values of the format).
DATA, POSITION, EQUALITY, GONE = 0, 1, 2, 2


@dataclass
class Snapshot:
    """files: (path, content, seq) of the live files of one snapshot."""

    snapshot_id: int | None
    location: str
    data: list[tuple[str, int]] = field(default_factory=list)
    positions: list[tuple[str, int]] = field(default_factory=list)
    equalities: list[tuple[str, int]] = field(default_factory=list)


# ---- metadata


def hadoop_metadata(spark: SparkSession, table: str) -> dict:
    """Of a table folder: the version that version-hint.text names, else the highest one."""
    fs = Fs(spark, table)
    names = [n for n in fs.list("metadata") if n.endswith(".metadata.json")]
    if not names:
        raise CatalogError(f"no metadata in {table}")

    def version(name: str) -> int:
        m = re.match(r"v?(\d+)", name)
        return int(m[1]) if m else -1

    hint = fs.read("metadata/version-hint.text").strip() if fs.exists("metadata/version-hint.text") else ""
    chosen = next((n for n in names if hint and n.split(".")[0] in (hint, f"v{hint}")), None) or next((n for n in names if hint.isdigit() and version(n) == int(hint)), None)
    return json.loads(fs.read(f"metadata/{chosen or max(names, key=lambda n: (version(n), n))}"))


def rest_metadata(uri: str, namespace: str, table: str, token: str | None = None, attempts: int = 20, pause_s: float = 0.2) -> dict:
    """From a REST catalog; a nested namespace a.b is sent with U+001F between its parts."""
    ns = urllib.parse.quote("\x1f".join(namespace.split(".")), safe="")
    url = f"{uri.rstrip('/')}/v1/namespaces/{ns}/tables/{urllib.parse.quote(table, safe='')}"
    request = urllib.request.Request(url, headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
    for i in range(attempts):
        try:
            with urllib.request.urlopen(request, timeout=30) as r:
                value = json.load(r)
            return value.get("metadata") or value
        except urllib.error.HTTPError as e:
            if e.code not in (429, 500, 502, 503, 504) or i == attempts - 1:
                raise CatalogError(f"catalog answered {e.code}") from e
        except (urllib.error.URLError, ValueError) as e:
            if i == attempts - 1:
                raise CatalogError(f"catalog can't be read: {e}") from e
        time.sleep(random.random() * pause_s)
    raise CatalogError("catalog can't be read")


def load_metadata(spark: SparkSession, table: str | None = None, rest: dict | None = None, catalog: str | None = None) -> dict:
    if catalog in ("glue", "nessie"):
        raise CatalogError(f"unsupported catalog: {catalog}")
    return rest_metadata(**rest) if rest else hadoop_metadata(spark, table)


# ---- manifests


def read_avro(spark: SparkSession, path: str) -> list[dict]:
    """Records of an Avro file, by the Avro library that Spark has; names lose case and `-` becomes `_`."""
    jvm = spark._jvm
    avro = jvm.org.apache.avro
    fs = Fs(spark, "")
    f, p = fs._p(path)
    stream = avro.file.SeekableByteArrayInput(f.open(p).readAllBytes())
    reader = avro.file.DataFileReader(stream, avro.generic.GenericDatumReader())
    out = []
    try:
        while reader.hasNext():
            out.append(json.loads(reader.next().toString()))
    finally:
        reader.close()

    def fold(v):
        if isinstance(v, dict):
            return {k.lower().replace("-", "_"): fold(x) for k, x in v.items()}
        return [fold(x) for x in v] if isinstance(v, list) else v

    return fold(out)


def list_snapshot(spark: SparkSession, metadata: dict, snapshot_id: int | None = None) -> Snapshot:
    """The live files of a snapshot (the current one). Fails on what can't be applied, before anything is published."""
    location = metadata.get("location", "")
    wanted = snapshot_id if snapshot_id is not None else metadata.get("current-snapshot-id", metadata.get("current_snapshot_id"))
    if wanted in (None, -1):
        return Snapshot(None, location)
    snap = next((s for s in metadata.get("snapshots", []) if s.get("snapshot-id", s.get("snapshot_id")) == wanted), None)
    if snap is None:
        raise CatalogError(f"snapshot {wanted} is not in the metadata")
    out = Snapshot(wanted, location)
    listed = snap.get("manifest-list", snap.get("manifest_list"))
    manifests = read_avro(spark, listed) if listed else [{"manifest_path": p} for p in snap.get("manifests", [])]
    for m in manifests:
        for e in read_avro(spark, m["manifest_path"]):
            if e.get("status") == GONE:
                continue
            f = e["data_file"]
            path, content = f["file_path"], f.get("content") or DATA
            kind = str(f.get("file_format") or "parquet").lower()
            if path.endswith(".puffin") or kind == "puffin":
                raise UnsupportedDeletes(f"deletion vectors are not supported: {path}")
            if kind != "parquet" or not path.lower().endswith(".parquet"):
                raise UnsupportedDeletes(f"only Parquet files are supported: {path}")
            seq = e.get("sequence_number") or m.get("sequence_number") or 0
            if content not in (DATA, POSITION, EQUALITY):
                raise UnsupportedDeletes(f"unknown content {content}: {path}")
            (out.data, out.positions, out.equalities)[content].append((path, seq))
    return out


def read_current_snapshot_id(spark: SparkSession, table: str) -> int | None:
    return list_snapshot(spark, hadoop_metadata(spark, table)).snapshot_id


def list_current_files(spark: SparkSession, table: str) -> list[str]:
    return [p for p, _ in list_snapshot(spark, hadoop_metadata(spark, table)).data]


def position_deletes(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame | None:
    """file_path, pos of all position delete files."""
    if not files:
        return None
    out = None
    for path, seq in files:
        d = spark.read.parquet(path)
        if not {"file_path", "pos"} <= set(d.columns) or dict(d.dtypes)["pos"] not in ("bigint", "int"):
            raise UnsupportedDeletes(f"a position delete file needs file_path and pos: {path}")
        d = d.select("file_path", F.col("pos").cast("long").alias("pos"), F.lit(seq).cast("long").alias("seq"))
        out = d if out is None else out.unionByName(d)
    if not out.filter("file_path is null or pos is null or pos < 0").isEmpty():
        raise UnsupportedDeletes("a position delete is null or negative")
    return out


def equality_deletes(spark: SparkSession, files: list[tuple[str, int]], with_seq: bool) -> list[DataFrame]:
    """Delete records, a DataFrame per set of columns."""
    by: dict[tuple, DataFrame] = {}
    for path, seq in files:
        d = spark.read.parquet(path)
        if not d.columns or any("<" in t for _, t in d.dtypes):
            raise UnsupportedDeletes(f"an equality delete file needs plain columns: {path}")
        key = tuple(sorted(d.dtypes))
        d = d.withColumn("seq", F.lit(seq).cast("long")) if with_seq else d
        by[key] = by[key].unionByName(d) if key in by else d
    return list(by.values())


# ---- incremental indexing


@dataclass
class SnapshotReport:
    snapshot_id: int | None
    fragment_id: str | None
    files_indexed: int
    skipped: bool
    location: str


def snapshot_diff(now: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (file_path) that are new, and those that are gone."""
    a, b = now.select(canonical(F.col("file_path")).alias("_c"), "file_path"), indexed.select(canonical(F.col("file_path")).alias("_c"), "file_path")
    return a.join(b.select("_c").distinct(), "_c", "left_anti").drop("_c"), b.join(a.select("_c").distinct(), "_c", "left_anti").drop("_c")


def index_snapshot(index: Index, snapshot: Snapshot, key_columns: list[str], *, prefix: str = "snapshot", buckets: int = 16, covering=False, compat: bool = False) -> SnapshotReport:
    """Brings the index to a snapshot in one published step: new files in, gone files dropped, files with new deletes read again.

    compat: a snapshot that any fragment has is a no-op, and equality deletes ignore sequence numbers; without it, only the latest
    fragment's snapshot counts (a rollback is applied), and a delete touches only rows that were there before it."""
    spark, store = index.spark, index.store
    ms = [m for m in store.manifests() if m["snapshot_id"] is not None]
    if snapshot.snapshot_id is None or (any(m["snapshot_id"] == snapshot.snapshot_id for m in ms) if compat else ms and ms[-1]["snapshot_id"] == snapshot.snapshot_id):
        return SnapshotReport(snapshot.snapshot_id, None, 0, True, snapshot.location)
    pos = position_deletes(spark, snapshot.positions)
    eq = equality_deletes(spark, snapshot.equalities, with_seq=not compat)
    files = store.files()
    floors = files.filter("role <> 'delete'").groupBy("file_path").agg(F.max_by("role", F.struct("seq", F.col("role") == "live")).alias("role"))
    indexed = floors.filter("role = 'live'").select("file_path")
    now = spark.createDataFrame(snapshot.data, "file_path string, seq long")
    added, gone = snapshot_diff(now, indexed)
    known = {r[0] for r in files.filter("role = 'delete'").select("file_path").distinct().toLocalIterator()}
    new_deletes = {p for p, _ in snapshot.positions + snapshot.equalities}
    again = None
    last_deletes = {r[0] for r in files.filter("role = 'delete'").join(files.agg(F.max(F.when(F.col("snapshot"), F.col("seq"))).alias("seq")), "seq", "left_semi").select("file_path").toLocalIterator()} if known else set()
    if new_deletes != last_deletes:
        kept = now.join(added, "file_path", "left_anti")
        if snapshot.equalities or last_deletes - new_deletes:
            again = kept.select("file_path")
        else:
            named = pos.select(canonical(F.col("file_path")).alias("_c")).distinct()
            again = kept.withColumn("_c", canonical(F.col("file_path"))).join(named, "_c", "left_semi").select("file_path")
    scan = added if again is None else added.unionByName(again)
    scan = [r[0] for r in scan.join(now, "file_path").orderBy("seq", "file_path").select("file_path").collect()]
    dropped = [r[0] for r in gone.collect()]
    if again is not None:
        old = indexed.withColumn("_c", canonical(F.col("file_path"))).join(again.select(canonical(F.col("file_path")).alias("_c")), "_c", "left_semi")
        dropped += [r[0] for r in old.select("file_path").collect()]
    fragment = f"{prefix}-{snapshot.snapshot_id}"
    if fragment in store.registry():
        fragment = f"{fragment}-{len(ms)}"
    if compat or not snapshot.equalities or not scan:
        eq_plain = [d.drop("seq") for d in eq]
        index.build(scan, key_columns, fragment_id=fragment, buckets=buckets, covering=covering, position_deletes=pos, equality_deletes=eq_plain if scan else (), kind="snapshot", snapshot_id=snapshot.snapshot_id, dropped=dropped, delete_files=sorted(new_deletes), note=f"snapshot {snapshot.snapshot_id}")
    else:
        _build_by_seq(index, scan, dict(snapshot.data), key_columns, fragment, buckets, covering, pos, eq, snapshot, dropped, sorted(new_deletes))
    return SnapshotReport(snapshot.snapshot_id, fragment, len(scan), False, snapshot.location)


def _build_by_seq(index, scan, seqs, key_columns, fragment, buckets, covering, pos, eq, snapshot, dropped, delete_files):
    """A fragment whose files have different sequence numbers: postings per number, with the deletes that are later."""
    from ..functions import covering as cov
    from ..operators.postings import postings

    spark = index.spark
    entries = files = None
    for seq in sorted({seqs[p] for p in scan}):
        data = spark.read.parquet(*[p for p in scan if seqs[p] == seq])
        c = cov.Covering.sniff(data.schema, index.time_column) if covering is True else covering
        part = postings(data, key_columns, c or None, pos, [d.filter(F.col("seq") > seq).drop("seq") for d in eq])
        m = F.col("_metadata")
        f = data.select(m["file_path"].alias("file_path"), m["file_size"].alias("file_size"), F.unix_millis(m["file_modification_time"]).alias("file_mtime_ms")).distinct().withColumn("role", F.lit("live"))
        entries, files = (part, f) if entries is None else (entries.unionByName(part), files.unionByName(f))
    extra = [(p, "dropped") for p in dropped] + [(p, "delete") for p in delete_files]
    if extra:
        files = files.unionByName(spark.createDataFrame(extra, "file_path string, role string"), allowMissingColumns=True)
    index.store.append(fragment, entries, files, buckets, key_columns=key_columns, kind="snapshot", snapshot_id=snapshot.snapshot_id, subset=True, note=f"snapshot {snapshot.snapshot_id}")


def index_table(index: Index, key_columns: list[str], table: str | None = None, rest: dict | None = None, catalog: str | None = None, **kw) -> SnapshotReport:
    """The current snapshot of a table, by Hadoop metadata or a REST catalog."""
    return index_snapshot(index, list_snapshot(index.spark, load_metadata(index.spark, table, rest, catalog)), key_columns, **kw)
