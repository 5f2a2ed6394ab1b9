"""Stages that are written once and read by all that need them: a folder by fingerprint, complete with its marker."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def fingerprint(parts: object) -> str:
    """Ten hexadecimal digits of the parts' JSON, keys sorted."""
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:10]


@cache
def code_version() -> str:
    """Digest of the library's own files: stages of another version aren't reused."""
    root = Path(__file__).resolve().parent.parent
    files = sorted(p for folder in (root, *(root / n for n in ("functions", "operators", "plans", "sources"))) for p in folder.glob("*.py"))
    return hashlib.md5(b"".join(p.read_bytes() for p in files)).hexdigest()


def files_of(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """Path, size and time of the files that the paths name, by Hadoop's file systems."""
    found = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(at):
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)


def saved(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], settings: object = None) -> DataFrame:
    """What ``build`` gives, written below ``spark.checkpoint.dir`` or read from there if it is complete.

    The folder's name holds the fingerprint of the input files, the settings and the library's version. Without that
    folder nothing is written.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return build()
    path = f"{shared.rstrip('/')}/stage-{name}-{fingerprint([files_of(spark, inputs), settings, code_version()])}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pool_signature(pool: DataFrame, key: str = "id") -> DataFrame:
    """Rows and an order-free sum of the keys' hashes: equal for equal sets of records."""
    from pyspark.sql import functions as F

    return pool.agg(F.count("*").alias("n"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("signature"))
