"""Where a plan is cut and stored."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where none is named one is made, but only for a local master: on a cluster, a folder of one machine would be none for the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    spark.conf.set("spark.checkpoint.dir", made := tempfile.mkdtemp(prefix="tidemill-"))
    return made


def new_folder(spark: SparkSession, what: str) -> str:
    """The path of a folder of its own below the shared one, as Python on any machine opens it."""
    return f"{re.sub('^file:(//)?', '', shared_folder(spark))}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df in the shared folder, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def empty_files(spark: SparkSession, base: str, recursive: bool = True) -> list[str]:
    """The files below a folder that have no bytes, which Spark's own listing leaves out. Names that begin with . or _ don't count, as there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    found, each = [], at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, recursive)
    while each.hasNext():
        f = each.next()
        if f.getLen() == 0 and not re.search("/[._][^/]*$", path := f.getPath().toString()):
            found.append(path)
    return found
