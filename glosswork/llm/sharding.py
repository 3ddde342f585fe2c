"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash
of the record; pass two shuffles each bucket in memory (Fisher-Yates, Spark's
seeded shuffle of an array) and deals the concatenation of the buckets round
robin, so that shard sizes in rows differ by one at most. Whole records go
through both passes. All of it is DataFrame code. The number of buckets comes
from the records' summed bytes.

The permutation is a function of the records and the seed alone: neither files,
partitions, settings nor the order of arrival count. A bucket is one task, is
sorted by its records' hashes before it is shuffled, and takes its random
numbers from the seed, so a task that runs again after a lost executor gives
the same rows. Equal keys or texts spread like any others, as the whole record
is hashed. Records that are equal in all columns, and so many that they would
overfill a bucket, are counted, and then hashed with the number of the copy.

Defined results: a null text has size 1 (none plus 1) and the CRC of the empty
text; repeated rows are separate records; an empty table gives an empty
result. Input columns named like a result are replaced. Columns must be
orderable (no maps).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import checkpoint, checkpoint_folder, free, table, widened

SHARDS = 16
#: Bytes of records that one bucket is to hold in the second pass, and times as many at which copies are counted.
BUCKET_BYTES, OVERFULL = 32 << 20, 4
#: Buckets whose starts (16 bytes each) are broadcast; more are joined.
SENT_BUCKETS = 1 << 20


#: Bytes of a record beside its values: its hashes and offsets.
RECORD_BYTES = 64


def record_bytes(docs: DataFrame) -> Column:
    """Bytes of a record's values, the length of their texts."""
    return sum((F.coalesce(F.octet_length(F.col(c) if t in ("string", "binary") else F.col(c).cast("string")), F.lit(0)).cast("long") for c, t in docs.dtypes), F.lit(RECORD_BYTES))


def bucket_count(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of bucket_bytes that the records of docs fill."""
    size = docs.agg(F.coalesce(F.sum(record_bytes(docs)), F.lit(0))).first()[0]
    return max(1, -(-size // bucket_bytes))


def scattered(docs: DataFrame, n: int, seed: int, copies: bool = False) -> DataFrame:
    """(_r, _h, _g, _b): each record of docs, two hashes of it and its bucket. copies: equal records are told apart by a number."""
    cols = docs.columns
    copy = free("_copy", docs)
    if copies:
        docs = docs.groupBy(*cols).agg(F.count("*").alias(copy)).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy))))
    told = [*cols, copy] if copies else cols
    h = [F.xxhash64(F.lit(seed + k), *told).alias(x) for k, x in enumerate(("_h", "_g"))]
    return docs.select(F.struct(*cols).alias("_r"), *h, record_bytes(docs.select(*cols)).alias("_n")).withColumn("_b", F.pmod("_h", F.lit(n)).cast("int"))


def bucket_starts(totals: DataFrame, block: int = 4096) -> DataFrame:
    """(_b, _start): the rows of all buckets before each, of (_b, _k); sums of blocks of buckets first, so that no window holds them all."""
    x = totals.withColumn("_g", F.floor(F.col("_b") / block))
    before = lambda w: F.coalesce(F.sum("_k").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = x.groupBy("_g").agg(F.sum("_k").alias("_k")).select("_g", before(W.orderBy("_g")).alias("_s"))
    inner = x.select("_b", "_g", before(W.partitionBy("_g").orderBy("_b")).alias("_i"))
    return inner.join(blocks, "_g").select("_b", (F.col("_s") + F.col("_i")).alias("_start"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with shard and slot, law `rows`. A task of the result holds one bucket, a run of slots of each shard."""
    docs = docs.select(*[c for c in docs.columns if c not in ("shard", "slot")])
    n = bucket_count(docs, bucket_bytes)
    for copies in (False, True):
        spread = scattered(docs, n, seed, copies)
        # One row a bucket.
        totals = checkpoint(spread.groupBy("_b").agg(F.count("*").alias("_k"), F.sum("_n").alias("_n")))
        if (totals.agg(F.max("_n")).first()[0] or 0) <= OVERFULL * bucket_bytes:
            break
    starts = bucket_starts(totals.select("_b", "_k"))
    if n <= SENT_BUCKETS:
        starts = F.broadcast(starts)
    # Pass one: bucket k to task k. Sorted there, so that the order of arrival does not matter.
    buckets = spread.select("_b", "_h", "_g", "_r").repartitionById(n, F.col("_b")).groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_h", "_g", "_r"))).alias("_a"))
    # Pass two: Fisher-Yates within the bucket, then round robin over the concatenation.
    dealt = buckets.withColumn("_a", F.shuffle("_a", F.lit(seed))).join(starts, "_b").select("_start", F.posexplode("_a").alias("_i", "_x"))
    at = F.col("_start") + F.col("_i")
    return dealt.select("_x._r.*", F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes one folder of Parquet files for each shard, rows in the order of their slots within a file and from file to file."""
    dealt = shard(docs, shards, seed, bucket_bytes)
    dealt.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the documents as they are read from the written shards."""
    path = f"{checkpoint_folder(spark)}/shards-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    write_shards(docs, path)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    out = spark.read.schema(widened(docs, ("slot", "long"), ("shard", "int"))).parquet(path)
    return out.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = None
