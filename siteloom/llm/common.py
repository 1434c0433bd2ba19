"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these six code points (space and TAB to CR).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a local session that names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="siteloom-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by reliable files in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and where; compressed, unlike a checkpoint, and read by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more; it learns of that when the driver's JVM collects
    its garbage, which between large steps may not happen for long. What ran last is held until something else runs."""
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of fixed-size keys (80 bytes at most) that are broadcast.
SMALL = 500_000


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str] | Column, how: str) -> DataFrame:
    """rows joined to keys, a checkpointed table of fixed-size rows: broadcast where it is small, so that rows stay where they are."""
    return rows.join(F.broadcast(keys) if keys.count() <= SMALL else keys, on, how)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch_path, wherever it is stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_names(df: DataFrame, n: int) -> list[str]:
    """n column names that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    names = (f"_free{i}" for i in range(n + len(taken)))
    return [x for x in names if x not in taken][:n]


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def normalised(col: str) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(col), f"{SPACE_CLASS}+", " ")
