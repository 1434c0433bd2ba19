"""Operator 6: exact dedup by progressive refinement (length, prefix hash, full hash), in DataFrame operations only.

One aggregate over fixed-size keys finds the pairs of normalised length and prefix hash that two rows or more share. Only rows of
such pairs are hashed in full, and of their digests those that occur twice are the groups. No text is shuffled to find them: tables of up
to common.SMALL rows of fixed-size keys are broadcast to the scan; larger ones are joined by a shuffle of keys and digests, with the digest
taken before it. Both sides of each such join are plain exchanges, so a text that a third of all rows share is split.

Defined results: null text counts as empty; empty texts equal each other; texts of any length are compared whole; of rows that share
both text and smallest id all are marked as kept; a group whose ids are all null keeps those rows; other columns are never read and
may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import checkpointed, free_names, join_keys, normalised

#: Code points that the second round hashes.
PREFIX = 256


def _round(text: Column, prefix: int) -> list[Column]:
    return [F.length(text).alias("_len"), F.xxhash64(F.substring(text, 1, prefix)).alias("_pre")]


def shared_prefixes(df: DataFrame, text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """(_len, _pre) that two rows or more share: rounds one and two, in one aggregate that combines before its shuffle."""
    keys = df.select(normalised(text_col).alias("_norm")).select(*_round(F.col("_norm"), prefix))
    return checkpointed(keys.groupBy("_len", "_pre").count().filter("count > 1").select("_len", "_pre"))


def duplicate_groups(df: DataFrame, shared: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """(text_sha256, keep_id, group_size) of each text that two rows or more have: round three."""
    rows = df.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_norm")).select("_id", "_norm", *_round(F.col("_norm"), prefix))
    if shared.count() <= common.SMALL:
        full = rows.join(F.broadcast(shared), ["_len", "_pre"], "left_semi").select("_id", F.sha2("_norm", 256).alias("text_sha256"))
    else:
        full = rows.select("_id", "_len", "_pre", F.sha2("_norm", 256).alias("text_sha256")).join(shared, ["_len", "_pre"], "left_semi")
    return checkpointed(full.groupBy("text_sha256").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The digest of each row is a column of the result, so here the last scan takes it of every text.
    """
    groups = duplicate_groups(df, shared_prefixes(df, text_col), id_col, text_col)
    rows = df.select(F.col(id_col), F.sha2(normalised(text_col), 256).alias("text_sha256"))
    alone = F.col("group_size").isNull()
    return join_keys(rows, groups, ["text_sha256"], "left").select(
        F.col(id_col),
        F.when(alone, F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns. Only texts whose length and prefix another row shares are hashed in full."""
    shared = shared_prefixes(df, text_col)
    groups = duplicate_groups(df, shared, id_col, text_col)
    norm, size, pre, met, sha, keep, found = free_names(df, 7)
    rows = df.withColumn(norm, normalised(text_col)).withColumn(size, F.length(norm)).withColumn(pre, F.xxhash64(F.substring(norm, 1, PREFIX)))
    candidates = shared.select(F.col("_len").alias(size), F.col("_pre").alias(pre), F.lit(True).alias(met))
    rows = join_keys(rows, candidates, [size, pre], "left").withColumn(sha, F.when(F.col(met), F.sha2(norm, 256))).drop(norm, size, pre, met)
    rows = join_keys(rows, groups.select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep), F.lit(True).alias(found)), [sha], "left")
    return rows.filter(F.col(found).isNull() | F.col(id_col).eqNullSafe(F.col(keep))).select(*[F.col(f"`{c}`") for c in df.columns])
