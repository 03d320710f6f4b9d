"""The index on disk: a registry, and append-only fragments of entries and file events.

    registry.json                      {"format_version": 1, "fragments": [ids, oldest first]}
    forgotten/                         keys that stay hidden, whatever is indexed later (JSON lines)
    fragments/<id>/manifest.json       small: seq, buckets, columns, snapshot, note
    fragments/<id>/entries/bucket=N/   postings, sorted by key
    fragments/<id>/files/              a row per file event: path, identity, role
    secondary/<column>/                secondary postings

The registry is published last, by rename; what it does not name does not exist. Seq is a fragment's place in it, counted up.
"""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedFormat
from ..functions.keys import bucket_expr
from ..operators.postings import SCHEMA
from .fs import Fs
from .liveness import live_entries

FILES = "file_path string, file_size bigint, file_mtime_ms bigint, file_etag string, role string"
FORMAT_VERSION = 1
#: Bytes of source tables for each task that writes entries; with more than that to a bucket, several tasks write it, each some of its keys.
TASK_BYTES = 256 << 20


def _source_bytes(df: DataFrame) -> int:
    """The bytes of the tables that df reads, by Spark's own figures; a table of unknown size counts as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 55)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.fs = spark, Fs(spark, root)

    # ---- registry

    def registry(self) -> list[str]:
        if not self.fs.exists("registry.json"):
            return []
        value = json.loads(self.fs.read("registry.json"))
        if isinstance(value, list):  # the form before format_version
            return value
        if value.get("format_version") != FORMAT_VERSION:
            raise UnsupportedFormat(f"unsupported index format_version {value.get('format_version')}")
        return value["fragments"]

    def publish(self, fragments: list[str]) -> None:
        self.fs.write("registry.json", json.dumps({"format_version": FORMAT_VERSION, "fragments": fragments}, indent=2))

    def manifests(self) -> list[dict]:
        """Of the fragments in order; small whatever the number of files and keys."""
        return [json.loads(self.fs.read(f"fragments/{f}/manifest.json")) for f in self.registry()]

    # ---- fragments

    def append(self, fragment_id: str | None, entries: DataFrame, files: DataFrame, buckets: int, *, key_columns=(), value_columns=(), snapshot_id=None, kind: str = "plain", note: str | None = None, subset: bool = False, replace: bool = False, prefix: str = "frag", drops: bool = True, tombstones: bool = True, schema: str | None = None, paths=()) -> str:
        """Writes a fragment and publishes it. entries: postings() or the entries of other fragments; replace: it becomes the only one.

        subset: entries name some rows of a key in a file, not all (deletes were applied). drops, tombstones: whether there may be any;
        schema, paths: of the data, as JSON and as given. The same id again overwrites the fragment in its place.
        """
        if buckets < 1:
            raise ValueError("buckets must be 1 or more")
        with self.fs.lock():
            known = self.registry()
            seq = max([m["seq"] for m in self.manifests()], default=0) + 1
            fragment_id = fragment_id or f"{prefix}-{seq:06d}"
            if fragment_id in known and not replace:
                seq = next(m["seq"] for m in self.manifests() if m["fragment_id"] == fragment_id)
            at = f"fragments/{fragment_id}"
            columns = {"fragment_id": F.lit(fragment_id), "seq": F.lit(seq).cast("long"), "bucket": bucket_expr(F.col("key"), buckets)}
            for name, missing in (("file_etag", F.lit(None).cast("string")), ("tombstone", F.lit(False))):
                if name not in entries.columns:
                    columns[name] = missing
            out = entries.withColumns(columns).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA])
            parts = -(-_source_bytes(entries) // TASK_BYTES)
            split = -(-parts // buckets)
            out = out.repartition(buckets * split, "bucket", F.pmod(F.xxhash64("key"), F.lit(split))) if split > 1 else out.repartition("bucket")
            out = out.sortWithinPartitions("bucket", "key", "file_path")
            fresh = f"{at}.new" if fragment_id in known else at
            out.write.mode("overwrite").partitionBy("bucket").parquet(self.fs.path(f"{fresh}/entries"))
            names = [f.split()[0] for f in FILES.split(", ")]
            files.select(*[F.col(n) if n in files.columns else F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in FILES.split(", "))]).select(*names).write.mode("overwrite").parquet(self.fs.path(f"{fresh}/files"))
            manifest = {"fragment_id": fragment_id, "seq": seq, "created_at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z"), "num_buckets": buckets, "note": note, "kind": kind, "subset": subset, "key_columns": list(key_columns), "value_columns": list(value_columns), "snapshot_id": snapshot_id, "drops": drops, "tombstones": tombstones, "schema": schema, "paths": list(paths)}
            self.fs.write(f"{fresh}/manifest.json", json.dumps(manifest, indent=2))
            if fresh != at:
                self.fs.delete(at)
                f, p = self.fs._p(fresh)
                f.rename(p, self.fs._p(at)[1])
            self.publish([fragment_id] if replace else known + [fragment_id] * (fragment_id not in known))
            if replace:
                self._collect_garbage([fragment_id])
        return fragment_id

    def _collect_garbage(self, keep: list[str]) -> None:
        for name in self.fs.list("fragments"):
            if name not in keep:
                self.fs.delete(f"fragments/{name}")

    # ---- reading

    def _read(self, paths: list[str], schema) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", paths[0] if len(paths) == 1 else self.fs.path("fragments")).parquet(*paths)

    def entries(self, keys: list[str] | None = None, buckets: dict[str, list[int]] | None = None) -> DataFrame:
        """All entries, dead ones too; buckets: only these partitions per fragment."""
        parts = []
        for m in self.manifests():
            df = self.spark.read.schema(SCHEMA).parquet(self.fs.path(f"fragments/{m['fragment_id']}/entries"))
            if buckets is not None:
                df = df.filter(F.col("bucket").isin(buckets[m["fragment_id"]]))  # literals: partitions are pruned when the plan is made
            parts.append(df.select(*SCHEMA.names))
        out = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return out.filter(F.col("key").isin(keys)) if keys is not None else out

    def files(self) -> DataFrame:
        """file events with fragment_id, seq, snapshot."""
        parts = []
        for m in self.manifests():
            df = self.spark.read.schema(FILES).parquet(self.fs.path(f"fragments/{m['fragment_id']}/files"))
            parts.append(df.select("*", F.lit(m["fragment_id"]).alias("fragment_id"), F.lit(m["seq"]).cast("long").alias("seq"), F.lit(m["kind"] == "snapshot").alias("snapshot")))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], FILES + ", fragment_id string, seq bigint, snapshot boolean")

    def forgotten(self) -> DataFrame | None:
        """The keys hidden for good; None if there are none."""
        if not self.fs.list("forgotten"):
            return None
        return self.spark.read.schema("key string").json(self.fs.path("forgotten"))

    def live(self, keys: list[str] | None = None, buckets: dict[str, list[int]] | None = None) -> DataFrame:
        """Live entries. Rules that no manifest has a case of take no part in the plan; of given keys only their files' events do."""
        ms = self.manifests()
        entries = self.entries(keys, buckets)
        files = self.files() if any(m.get("drops", True) or m["kind"] == "snapshot" for m in ms) else None
        if files is not None and keys is not None:
            files = files.join(entries.select("file_path").distinct(), "file_path", "left_semi")
        return live_entries(entries, files, self.forgotten(), any(m.get("tombstones", True) for m in ms))
