"""Latency and throughput of lookups, and how much of the files they touch."""

from __future__ import annotations

import random
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from .operators.index import Index, QueryOptions, naive_scan
from .operators.postings import readable


def percentile(values: list[float], p: float) -> float:
    """Nearest rank on (n - 1) * p, rounded."""
    v = sorted(values)
    return v[round((len(v) - 1) * p)] if v else 0.0


def sample_keys(index: Index, n: int, seed: int = 1) -> list[str]:
    rows = index.entries().select("key").distinct().orderBy(F.xxhash64("key", F.lit(seed))).limit(n).collect()
    return [r[0] for r in rows]


def bench(index: Index, keys: int = 5, rounds: int = 1, batch: int = 100) -> dict:
    """Single lookups, one batched job, an index-only answer, and the files and bytes (of the pages that hold the key's rows) that a lookup reads against all there are."""
    names = sample_keys(index, max(keys, batch))
    single, covering = [], []
    for _ in range(rounds):
        for k in names[:keys]:
            t = time.perf_counter()
            index.lookup(k).rows.count()
            single.append(time.perf_counter() - t)
            t = time.perf_counter()
            index.covering(k).collect()
            covering.append(time.perf_counter() - t)
    t = time.perf_counter()
    rows = index.lookup_many(names[:batch], QueryOptions(verify=False)).count()
    batched = time.perf_counter() - t
    e = index.explain(names[0], pages=True)
    total = index.store.files().filter("role = 'live'").agg(F.count(F.lit(1)), F.sum("file_size")).first()
    return {"lookup_p50_s": percentile(single, 0.5), "lookup_p99_s": percentile(single, 0.99), "covering_p50_s": percentile(covering, 0.5), "batch_keys": len(names[:batch]), "batch_rows": rows, "batch_s": batched, "batch_keys_per_s": len(names[:batch]) / batched, "files_read": len(e["files"]), "files": total[0], "bytes_read": e["estimated_bytes"], "bytes": total[1]}


def stress(index: Index, keys: int = 20, workers: int = 4, verify_every: int = 5, rate: float | None = None, seed: int = 1) -> dict:
    """Concurrent lookups, closed loop, or open at rate per second; every verify_every-th is held against a scan."""
    names = sample_keys(index, keys, seed)
    files = [readable(r[0]) for r in index.store.files().filter("role = 'live'").select("file_path").distinct().collect()]
    columns = index.key_columns()
    begun = time.perf_counter()

    def one(i: int) -> tuple[float, bool]:
        if rate:
            time.sleep(max(0.0, begun + i / rate - time.perf_counter()))
        t = time.perf_counter()
        n = index.lookup(names[i]).rows.count()
        took = time.perf_counter() - t
        return took, verify_every <= 0 or i % verify_every or n == naive_scan(index.spark, files, columns, names[i], time_column=index.time_column).count()

    order = list(range(len(names)))
    random.Random(seed).shuffle(order)
    with ThreadPoolExecutor(workers) as pool:
        out = list(pool.map(one, order))
    wall = time.perf_counter() - begun
    took = [x for x, _ in out]
    return {"lookups": len(out), "mismatches": sum(not ok for _, ok in out), "p50_s": percentile(took, 0.5), "p99_s": percentile(took, 0.99), "per_s": len(out) / wall}
