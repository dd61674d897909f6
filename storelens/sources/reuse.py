"""Stored tables that later applications use again.

A table derived from input files is written under a name made from what it was derived from: the files' names, sizes and
modification times, the parameters, and ``VERSION`` (raised when the derivation changes).  Another application that finds
the name under the shared folder reads the table; any change to the input leads to another name.  A table appears under
its name by one rename after it has been written, so half-written ones are never read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from storelens.session import fresh_dir, path_exists, shared_dir

VERSION = 2
COMPRESSION = "zstd"  # of the stored lines and the rollup: about 0.7 of the bytes that Spark's default takes


def fingerprint(spark: SparkSession, paths: list[str], *params) -> str:
    """Hash of the files under ``paths`` (names, sizes, modification times; hidden ones do not count) and ``params``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for top in paths:
        path = jvm.org.apache.hadoop.fs.Path(top)
        fs = path.getFileSystem(conf)
        for found in fs.globStatus(path) or []:
            files = fs.listFiles(found.getPath(), True)
            while files.hasNext():
                f = files.next()
                name = f.getPath().toString()
                if not any(part.startswith(("_", ".")) for part in name.split("/")[-1:]):
                    seen.append((name, f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps([VERSION, sorted(seen), params], default=str).encode()).hexdigest()[:40]


def reused(spark: SparkSession, kind: str, mark: str, write: Callable[[str], None]) -> str:
    """The folder of ``kind`` and ``mark``; ``write(folder)`` makes it if it is not there."""
    path = shared_dir(spark, "storelens", "kept", kind, mark)
    if path_exists(spark, path):
        return path
    new = fresh_dir(spark, kind)
    write(new)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, src = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    fs = to.getFileSystem(conf)
    fs.mkdirs(to.getParent())
    # whoever is second keeps its own copy
    return path if not path_exists(spark, path) and fs.rename(src, to) else new
