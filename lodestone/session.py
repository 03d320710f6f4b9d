"""Session and shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **conf) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").appName("lodestone")
    base = {"spark.sql.shuffle.partitions": partitions, "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for k, v in (base | conf).items():
        b = b.config(k, str(v))
    return b.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see: under spark.checkpoint.dir; only on a local master, as in tests, in a temporary folder where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
