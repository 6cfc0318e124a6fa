"""Reproducible shuffle into shards: a Feistel permutation of global row numbers, in column expressions only.

Row numbers follow from the rows alone (order of a hash of id and content), so a table gives the same shards on any
cluster.  The permutation maps [0, n) onto itself.  A number is written as (l, r) with l < a, r < b and a * b just
above n; every round adds a keyed hash of one half to the other, modulo its range, and swaps them, which can be undone.
Cycle walking repeats the network while the value is n or more.  Row number x goes to shard p(x) mod shards and slot
p(x) div shards: shards differ by one row at most and slots have no gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROUNDS = 6
WALK = 40
BUCKET_BITS = 12


def feistel(x: Column, n: Column, seed: int = 42, rounds: int = ROUNDS) -> Column:
    """One pass of the network over [0, a * b), a = ceil(sqrt(n)), b = ceil(n / a); ``rounds`` is even."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    b = F.greatest(F.ceil(n / a), F.lit(1)).cast("long")

    def step(s: Column, k: Column) -> Column:
        moved = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k, F.lit(seed)), s["a"]), s["a"])
        return F.struct(s["r"].alias("l"), moved.alias("r"), s["b"].alias("a"), s["a"].alias("b"))

    start = F.struct(
        ((x - F.pmod(x, b)) / b).cast("long").alias("l"), F.pmod(x, b).alias("r"), a.alias("a"), b.alias("b")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["l"] * s["b"] + s["r"])


def permute(x: Column, n: Column, seed: int = 42) -> Column:
    """p(x) for x in [0, n): a one-to-one map onto [0, n).

    a * b exceeds n by less than a, so a pass leaves [0, n) with probability about 1 / sqrt(n).  A walk of more than
    ``WALK`` passes raises an error (never a wrong place).
    """
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        feistel(x, n, seed),
        lambda v, _: F.when(v < n, v).otherwise(feistel(v, n, seed)),
    )
    return F.aggregate(
        F.array(walked),
        F.lit(-1).cast("long"),
        lambda _, v: F.when(v < n, v).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")),
    )


def numbered(rows: DataFrame, keys: list[str], out: str = "number", bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Distinct ``keys`` with their count, and global row numbers 0..n-1: one output row per input row, and n.

    Equal rows are counted before anything is shuffled by bucket, so a row repeated any number of times weighs one.
    Buckets are the leading bits of the hash; each numbers its own rows and adds the total of the buckets before it
    (a table of 2^bucket_bits rows, broadcast).
    """
    top = F.shiftrightunsigned(F.xxhash64(*keys), 64 - bucket_bits)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_hash", F.xxhash64(*keys))
    counted = counted.withColumn("_bucket", top)
    running = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = counted.groupBy("_bucket").agg(F.sum("_copies").alias("_t"))
    before = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_t").over(running), F.lit(0)).alias("_before"),
        F.sum("_t").over(W.partitionBy(F.lit(1))).alias("n"),
    )
    within = W.partitionBy("_bucket").orderBy("_hash", *keys).rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("_within", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    placed = placed.join(F.broadcast(before), "_bucket")
    first = F.col("_before") + F.col("_within")
    return placed.select(*keys, "n", F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias(out))


def shard(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, seed: int = 42
) -> DataFrame:
    """Per row of ``docs``: doc_id, size (UTF-8 bytes plus 8), text_crc32, law = 'rows', shard, slot, grown_shard (null).

    Under law ``rows`` shard sizes differ by at most one and slots run from 0 without gaps; copies of a text are
    spread like other rows.  A null text has 0 bytes (size 8, crc 0).  Null and repeated ids and repeated rows each
    take a place of their own.  Other columns are ignored, whatever their names.  An empty table gives no rows.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )
    place = numbered(narrow, ["doc_id", "size", "text_crc32"]).withColumn("_p", permute(F.col("number"), F.col("n"), seed))
    return place.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("_p"), F.lit(shards)).cast("int").alias("shard"),
        ((F.col("_p") - F.pmod(F.col("_p"), F.lit(shards))) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
