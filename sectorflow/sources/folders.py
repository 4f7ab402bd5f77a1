"""Where tables go that are written on the way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, or a temporary one for a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not where:
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="sectorflow-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        where = _LOCAL[0]
    return f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
