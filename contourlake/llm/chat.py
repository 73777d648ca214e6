"""Chat formatting: conversations logged again as they grew collapse to their longest form, then are rendered."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table, written

BEGIN, END = "<|im_start|>", "<|im_end|>"


def _rolling(batches):
    """Hash of each turn with all before it in its conversation. Rows come sorted; one turn's state is kept."""
    schema = pa.schema([("conv_id", pa.int64()), ("prefix", pa.binary()), ("n", pa.int64()), ("last", pa.bool_())])
    held = None  # the newest row: whether it is its conversation's last is known when the next comes
    for batch in batches:
        out = []
        for conv, digest in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            same = held is not None and held[0] == conv
            if held is not None:
                out.append((*held, not same))
            held = (conv, hashlib.md5((held[1] if same else b"") + digest).digest(), held[2] + 1 if same else 1)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*held, True), schema, strict=True)], schema=schema)


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``n_turns`` of the conversations that no other one begins with.

    ``turns``: conv_id, turn, role, text. A conversation is its turns in the order of turn (null
    last; turns of one number by their digest); null roles count as ``none``, null texts as empty. Of equal conversations the least conv_id
    stays. Rows without conv_id belong to none. Only hashes of turns are shuffled; equal conversations
    and equal beginnings, however many, meet as one row after map-side aggregation.
    """
    narrow = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("none")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = narrow.select("conv_id", "turn", F.unhex(digest(F.col("role"), F.col("text"))).alias("digest"))
    dealt = hashed.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "digest")
    prefixes = written(dealt.select("conv_id", "digest").mapInArrow(_rolling, "conv_id long, prefix binary, n long, last boolean"), "prefixes")
    finals = prefixes.where("last").groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.min("n").alias("n_turns"))
    begun = prefixes.where("NOT last").select("prefix").distinct()
    return finals.join(begun, "prefix", "left_anti").select("conv_id", "n_turns")


def digest(role, text):
    """A turn's digest, as hex; it also orders turns of one number."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def rendered(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``text`` of the maximal conversations, one row for each.

    A turn is rendered as the begin mark, its role, a newline, its text, the end mark and a newline;
    marks within roles and texts get a space after ``<``. An empty table gives no rows.
    """
    kept = maximal(turns)
    narrow = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("none")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = [F.regexp_replace(c, r"<(\|im_(?:start|end)\|>)", "< $1") for c in ("role", "text")]
    line = F.concat(F.lit(BEGIN), plain[0], F.lit("\n"), plain[1], F.lit(END + "\n"))
    turn = F.struct(F.col("turn").isNull().alias("no_turn"), "turn", digest(F.col("role"), F.col("text")).alias("digest"), line.alias("line"))
    joined = narrow.join(kept, "conv_id").groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return joined.select("conv_id", "n_turns", F.array_join(F.col("turns.line"), "").alias("text"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


OP5_SQL = r"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, 'none') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(role || chr(1) || text ORDER BY turn NULLS LAST, md5(strlen(role) || ':' || role || text)) AS turns FROM t GROUP BY conv_id),
begun AS (SELECT DISTINCT md5(array_to_string(turns[1:k], chr(2))) AS h FROM c, unnest(range(1, len(turns))) AS r(k)),
ended AS (SELECT md5(array_to_string(turns, chr(2))) AS h, min(conv_id) AS conv_id FROM c GROUP BY 1),
kept AS (SELECT conv_id FROM ended WHERE h NOT IN (SELECT h FROM begun))
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || regexp_replace(role, '<(\|im_(start|end)\|>)', '< \1', 'g') || chr(10)
         || regexp_replace(text, '<(\|im_(start|end)\|>)', '< \1', 'g') || '<|im_end|>' || chr(10), ''
         ORDER BY turn NULLS LAST, md5(strlen(role) || ':' || role || text)) AS text
FROM t JOIN kept USING (conv_id) GROUP BY conv_id
"""
