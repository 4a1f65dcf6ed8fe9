"""Reading of the tables and materialisation in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def integral(df: DataFrame, id_col: str) -> None:
    """Ids are compared as integers: texts would become null without a word."""
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} is {df.schema[id_col].dataType.simpleString()}; ids must be integers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, read by Spark whatever the path's scheme."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        found = tempfile.mkdtemp(prefix="cellprobe-ckpt-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: While a step runs: what its shuffles wrote goes when its result is in the shared folder.
_MEANWHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: For a step with a very long expression: the JVM's compiler leaves generated methods of over 8000 bytecodes interpreted,
#: so the expression is to be split into methods of its own.
SPLIT_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


@contextlib.contextmanager
def _step(spark: SparkSession, conf: dict[str, str] | None = None) -> Iterator[None]:
    wanted = _MEANWHILE | (conf or {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame, conf: dict[str, str] | None = None) -> DataFrame:
    """Compute now and cut the lineage with a reliable checkpoint in the shared folder.

    A checkpoint remembers the estimated size and the constraints of the plan that made it. Over the rounds of a loop
    estimates of joins multiply to numbers of millions of digits, so the result is made a plan without any.
    """
    spark = df.sparkSession
    shared_dir(spark)
    with _step(spark, conf):
        kept = df.select("*").checkpoint(eager=True)  # a plan is told when it is made whether its shuffle files go
    jvm = spark._jsparkSession
    return DataFrame(jvm.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)


def written(df: DataFrame, partition_by: list[str] | None = None, conf: dict[str, str] | None = None, hashes: bool = False) -> tuple[DataFrame, str]:
    """Compute now into a Parquet table in the shared folder; returns the reread table and its path.

    ``hashes`` tells that the rows are mostly hashes, on which compression and dictionaries are lost work.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cellprobe-{uuid.uuid4().hex}"
    out = df.write.option("compression", "lz4" if hashes else "zstd").option("parquet.enable.dictionary", str(not hashes).lower())
    with _step(spark, conf):
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made, through Hadoop's file system of that path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
