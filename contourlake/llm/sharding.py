"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table, written

#: Hex digits of the digest that make a score: 13 digits are 52 bits, exact in a double.
DIGITS = 13


def draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) that the key's text and the shard alone decide."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), shard.cast("string")))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard with the greatest weight / -ln(draw); a further shard takes keys only into itself.

    Weights are positive; a tie goes to the lowest shard. A null key counts as the text ``null``.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    weight = F.array(*map(F.lit, weights))
    scores = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: F.struct((F.get(weight, s) / -F.log(draw(key, s))).alias("score"), (-s).alias("shard")))
    return (-F.array_max(scores)["shard"]).cast("int")


def shard(docs: DataFrame, key: str, weights: list[float], order: str | None = None) -> DataFrame:
    """Rows of ``docs`` with ``shard`` and a gapless ``slot`` in it, counted in the order of ``order``.

    Nothing gathers a shard in one task: rows are dealt by ranges of (shard, order), whatever a
    shard's size, and the counts of the ranges give each its first slot. Rows with equal keys go to
    one shard and differ in slot. An empty table gives no rows; columns of ``docs`` named like an
    output column are replaced.
    """
    spark, kept = docs.sparkSession, [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")  # so that no column of ``docs`` meets one of these
    placed = docs.select(row, rendezvous(F.col(f"`{key}`"), weights).alias("shard"), F.col(f"`{order or key}`").alias("order"))
    ranged = placed.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order")
    numbered = written(ranged.select("row", "shard", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("number")), "shards")
    first = numbered.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    # One row for each range and shard: ranges number as partitions do, not as rows.
    ranges = spark.createDataFrame(_offsets(first.collect()), "part int, shard int, first long, base long")
    joined = numbered.join(F.broadcast(ranges), ["part", "shard"])
    return joined.select(*(F.col("row").getField(c).alias(c) for c in kept), "shard", F.expr("number - first + base").alias("slot"))


def _offsets(rows: list) -> list[tuple[int, int, int, int]]:
    out, at, last = [], 0, None
    for r in sorted(rows, key=lambda r: (r["shard"], r["part"])):
        at = at if r["shard"] == last else 0
        out.append((r["part"], r["shard"], r["first"], at))
        at, last = at + r["n"], r["shard"]
    return out


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + F.lit(16)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    out = shard(docs, "doc_id", [1.0] * 40).withColumn("grown_shard", rendezvous(F.col("doc_id"), [1.0] * 41))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

