"""Written tables in the cluster's shared folder: they cut lineage and outlive executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a private one, which only a local master may use."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return shared or _own_dir()


def written(df: DataFrame, name: str, dictionary_bytes: int | None = None, drop_shuffles: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the table read back.

    A lost executor costs the tasks it ran, not the steps before this one. The files stay for as long as results
    built on them may be read, or until discard(); clearing the folder is the cluster's business, as with checkpoint().
    dictionary_bytes: how large Parquet's dictionary of a column may grow, for columns of many different long values.
    drop_shuffles: the shuffle files of this write go when it ends, not when the driver happens to collect its garbage.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    options = {"parquet.dictionary.page.size": str(dictionary_bytes)} if dictionary_bytes else {}
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    if drop_shuffles:
        conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if drop_shuffles:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the one table of written() that df reads; nothing that reads it may be run after this."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    if len(folders) > 1:
        raise ValueError(f"reads {len(folders)} tables")
    for folder in folders:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
