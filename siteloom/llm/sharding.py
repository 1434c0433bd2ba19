"""Operator 1: sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame operations only.

The walk multiplies a 64-bit state by a constant modulo 2^64. Spark's arithmetic raises on overflow, so the state is kept as two
32-bit limbs in longs and the constant as four 16-bit ones; no partial product exceeds 2^50.

Slots number the rows of a shard from 0 without gaps. A shard is not sorted as a whole: it is cut into BUCKETS by the state
after the first step (more of them where a shard would have over BUCKET_ROWS rows in each), rows are numbered within a bucket, and
a table of shards x buckets counts, a row for a million or so of the input, gives each bucket's first slot.

Defined results: a null key hashes as 0; null text has size 16 and a null checksum; rows that share a key share a shard and get
different slots; a text of any length counts whole; other columns are never read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: the multiplier 2862933555777941757 in 16-bit limbs, lowest first, and 2^31.
MULTIPLIER = 2862933555777941757
LIMBS = [(MULTIPLIER >> s) & 0xFFFF for s in (0, 16, 32, 48)]
SPAN = float(1 << 31)
BUCKETS = 64
BUCKET_ROWS = 1 << 20


def _low_part(product: Column) -> Column:
    return F.shiftleft(product.bitwiseAND(F.lit(0xFFFF)), 16)


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) times MULTIPLIER plus 1, modulo 2^64."""
    c0, c1, c2, c3 = (F.lit(x).cast("long") for x in LIMBS)
    mask = F.lit(0xFFFFFFFF).cast("long")
    low = lo * c0 + _low_part(lo * c1) + F.lit(1)
    high = hi * c0 + _low_part(hi * c1) + F.shiftright(lo * c1, 16) + lo * c2 + _low_part(lo * c3) + F.shiftright(low, 32)
    return high.bitwiseAND(mask), low.bitwiseAND(mask)


def _limbs(key: Column) -> tuple[Column, Column]:
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    return F.shiftrightunsigned(k, 32), k.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def first_draw(key: Column) -> Column:
    """The 31 bits that the walk draws first."""
    return F.shiftright(_step(*_limbs(key))[0], 1)


def jump_hash(key: Column, *shards: int) -> Column:
    """array<int>: the bucket of key among each of the given numbers of shards, from one walk."""
    hi, lo = _limbs(key)
    most = max(shards)
    zero = F.lit(0).cast("long")
    start = F.struct(hi.alias("hi"), lo.alias("lo"), zero.alias("j"), *[zero.alias(f"b{n}") for n in shards])

    def walk(s: Column, _: Column) -> Column:
        nhi, nlo = _step(s["hi"], s["lo"])
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(SPAN) / (F.shiftright(nhi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(nhi.alias("hi"), nlo.alias("lo"), j.alias("j"), *[F.when(s["j"] < n, s["j"]).otherwise(s[f"b{n}"]).alias(f"b{n}") for n in shards])
        return F.when(s["j"] >= most, s).otherwise(moved)

    # Each step raises j by one at least, so most + 1 steps end every walk; those after the end leave the state alone.
    return F.aggregate(F.sequence(F.lit(0), F.lit(most)), start, walk, lambda s: F.array(*[s[f"b{n}"].cast("int") for n in shards]))


def shard(df: DataFrame, n_shards: int, key_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard among n_shards + 1)."""
    key = F.col(key_col)
    buckets = buckets or max(BUCKETS, -(-df.count() // (n_shards * BUCKET_ROWS)))
    placed = df.select(
        key,
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.encode(text_col, "UTF-8")).alias("text_crc32"),
        jump_hash(key, n_shards, n_shards + 1).alias("_b"),
        F.pmod(first_draw(key), F.lit(buckets)).cast("int").alias("_bucket"),
    ).select(key, "size", "text_crc32", F.col("_b")[0].alias("shard"), F.col("_b")[1].alias("grown_shard"), "_bucket")
    # n_shards x BUCKETS rows or a row for BUCKET_ROWS of df: broadcast within that bound.
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    firsts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(key, F.col("text_crc32"))
    numbered = placed.withColumn("_i", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(firsts), ["shard", "_bucket"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_i")).cast("long").alias("slot"), "grown_shard"
    )
