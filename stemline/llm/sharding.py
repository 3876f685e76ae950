"""Jump consistent hashing: stable keys to shards without a ring table, in built-in expressions only.

The generator is the 64-bit multiplicative one of Lamping and Veach's paper.  Its
state is kept as two 32-bit halves, for ANSI arithmetic raises on overflow; a jump
is at least one shard long, so ``shards`` steps always suffice.

Defined results: a null key goes where the key 0 goes; a null text counts 16 bytes and
has the checksum of the empty string; repeated keys share a shard and have slots of
their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MULTIPLIER = 2862933555777941757
MASK = 0xFFFFFFFF


def _times(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2**64 in halves of 32 bits, no product over 2**62."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & MASK
    low = lambda x, m: (x.bitwiseAND(0xFFFF) * m, F.shiftright(x, 16) * m)
    a, b = low(lo, m_lo)
    part = a + F.shiftleft(b.bitwiseAND(0xFFFF), 16) + 1
    c, d = low(hi, m_lo)
    upper = F.shiftright(part, 32) + F.shiftright(b, 16) + (lo * m_hi).bitwiseAND(MASK) + c.bitwiseAND(MASK) + F.shiftleft(d.bitwiseAND(0xFFFF), 16)
    return upper.bitwiseAND(MASK), part.bitwiseAND(MASK)


def jump(key: Column, shards: int) -> tuple[Column, Column]:
    """(shard among ``shards``, shard among one more) of a long key."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftright(key, 32).bitwiseAND(MASK).alias("hi"), key.bitwiseAND(MASK).alias("lo"),
        F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("grown"), F.lit(0).cast("long").alias("next"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _times(s["hi"], s["lo"])
        now = F.when(s["next"] < shards, s["next"]).otherwise(s["now"])
        grown = F.when(s["next"] < shards + 1, s["next"]).otherwise(s["grown"])
        jumped = F.floor((s["next"] + 1) * (F.lit(2.0**31) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), now.alias("now"), grown.alias("grown"), jumped.alias("next"))
        return F.when(s["next"] > shards, s).otherwise(moved)

    steps = F.transform(F.sequence(F.lit(0), F.lit(shards + 1)), lambda x: x.cast("long"))
    end = F.aggregate(steps, start, step)
    return end["now"].cast("int"), end["grown"].cast("int")


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", parts: int | None = None, rows_per_part: int = 50_000) -> DataFrame:
    """Every row with its shard and a slot that is gapless from 0 within the shard.

    Slots are numbered in ``parts`` independent parts of each shard and offset by the
    parts before, so no task ever holds a whole shard; their number follows from that of the rows,
    by hash of key and text, so that one key's rows are spread too."""
    if parts is None:
        parts = max(16, math.ceil(docs.count() / (shards * rows_per_part)))
    now, grown = jump(F.col(key), shards)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"), now.alias("shard"), grown.alias("grown_shard"),
        F.pmod(F.xxhash64(key, text), F.lit(parts)).cast("int").alias("part"),
    )
    # a row per shard and part, far fewer than the input's
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("base"))
    slot = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("at", slot)
        .join(before, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("at") + F.col("base")).cast("long").alias("slot"), "grown_shard")
    )
