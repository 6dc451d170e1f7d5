"""The folder that the driver and all executors share, for tables that pass from one job to the next."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Only where there are no other executors (a local master, as in tests) may none be
    named: a temporary folder stands for it then."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = getattr(sc, "_tickloom_shared", None) or "file://" + tempfile.mkdtemp(prefix="tickloom-")
        sc._tickloom_shared = named
    return named


def passing(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return f"{folder}/rows"
