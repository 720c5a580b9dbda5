"""Sharding by weighted rendezvous hashing of stable record keys, in built-in functions only.

Shard s of weight w gets the score w / -ln(u), where u in (0, 1) comes from xxhash64(key, s); the record goes to the
highest score. A score depends on the key and its own shard alone, so one more shard takes records only into itself,
and a changed weight moves records only to or from that shard.

Defined results. Null key: hashed as the string "null", so all such rows share a shard. Null text: size 16, crc32 of
no bytes (0). Equal keys, equal texts and repeated rows: each row has its own slot; rows with one key share a shard.
Equal scores: the lower shard number. Empty table: no rows. Extra columns: kept by `place` (one that is already called
as the new column gets "_in" appended), absent from `assign`. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import carry, gapless, let, pick, stage, unload

RECORD_OVERHEAD = 16


def scores(key: Column, weights: Sequence[float]) -> Column:
    """The array of every shard's score for this key."""
    whole = F.coalesce(key.cast("string"), F.lit("null"))
    hashes = F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)]), lambda s: F.struct(s["w"].alias("w"), F.xxhash64(whole, s["i"]).alias("h")))
    return F.transform(hashes, lambda s: s["w"] / -F.log((F.shiftrightunsigned(s["h"], 11).cast("double") + 0.5) / F.lit(float(1 << 53))))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    return let(scores(key, weights), lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def place(records: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """records with their shard; `records.write.partitionBy(out)` then writes one folder a shard."""
    return unload(carry(records, key), records, more={out: shard_of(F.col(key), weights)})


def assign(docs: DataFrame, n_shards: int = 40, weights: Sequence[float] | None = None) -> DataFrame:
    """One row per document: size, checksum, shard, its slot there, and the shard it would have with one shard more.

    Texts are read once and never shuffle: sizes and checksums are staged and do. Slots are numbered by (shard, hash bucket), so a shard that
    holds much of the table is numbered by many tasks.
    """
    w = list(weights or [1.0] * n_shards)
    grown = [*w, sum(w) / len(w)]
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = pick(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        let(
            scores(F.col("doc_id"), grown),
            lambda a: let(F.slice(a, 1, len(w)), lambda b: F.struct((F.array_position(b, F.array_max(b)) - 1).cast("int").alias("shard"), (F.array_position(a, F.array_max(a)) - 1).cast("int").alias("grown_shard"))),
        ).alias("_s"),
    ).select("doc_id", "size", "text_crc32", "law", "_s.shard", "_s.grown_shard")
    n = max(8, 2 * docs.sparkSession.sparkContext.defaultParallelism)
    return gapless(stage(slim, "shards"), ["shard"], ["doc_id", "text_crc32", "size"], "slot", n).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
