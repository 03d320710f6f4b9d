"""Where a key's rows stand within Parquet files: pages by the offset index. For explain; reading needs none of it."""

from __future__ import annotations

import bisect

from pyspark.sql import SparkSession


def page_locations(spark: SparkSession, path: str, rows: list[int], columns: list[str] | None = None) -> list[dict]:
    """The pages (column, offset, size) of a file that hold some of its rows, each once; [] if the file has no offset index.

    One footer is read on the driver, by the Parquet library that Spark has."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    out, base = [], 0
    rows = sorted(set(rows))
    try:
        for group in reader.getFooter().getBlocks():
            end = base + group.getRowCount()
            here = [r - base for r in rows[bisect.bisect_left(rows, base) : bisect.bisect_left(rows, end)]]
            base = end
            if not here:
                continue
            for column in group.getColumns():
                name = column.getPath().toDotString()
                if columns and name.split(".")[0] not in columns:
                    continue
                index = reader.readOffsetIndex(column)
                if index is None:
                    continue
                first = [index.getFirstRowIndex(i) for i in range(index.getPageCount())]
                for page in sorted({bisect.bisect_right(first, r) - 1 for r in here}):
                    out.append({"column": name, "offset": index.getOffset(page), "size": index.getCompressedPageSize(page)})
    finally:
        reader.close()
    return out


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = 0) -> list[tuple[int, int]]:
    """(start, end) ranges in order, those merged that overlap or are no more than gap apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
