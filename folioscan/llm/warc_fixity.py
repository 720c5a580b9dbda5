"""Merkle fixity audit of web archive records, in DataFrame operations.

Each page is a WARC record. The records of both replicas are hashed and ordered by key, the union of their keys, and
FANOUT neighbours make an offset range: its hash covers, for each child that the replica has, the child's place, its
offset in the range, its length and its hash. Level by level this gives one root a replica. Equal roots: the same
records at the same offsets. Otherwise the audit descends from the roots and, at each level, looks only at children of
nodes that differ or that one replica lacks, down to the records. As offsets count from the start of their range, a
record that is lost, added or cut leaves all ranges alike but those that hold it.

Only keys, lengths and hashes shuffle; no group has more than FANOUT rows.

Defined results. Null url or html: as the empty text. Null page_id: a key of its own. Repeated page_ids: the records of
a key are matched in the order of their hashes (by hash bucket), so a fault in one of them may show at others of that
key. Missing in the second replica: status "missing"; there but not in the first: "extra", with an ordinal and without
offset. Pages of any length are hashed whole. Empty tables: no rows. Extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import gapless, ordinals, pick, stage

FANOUT = 16


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC/1.1 resource record."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def digests(pages: DataFrame) -> DataFrame:
    """(key, page_id, nth, length, sha256) of every record; nth tells the records of one key apart."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    slim = pick(pages, "page_id", "url", "html").select("page_id", record.alias("_r")).select(
        F.coalesce(F.concat(F.lit("="), F.col("page_id").cast("string")), F.lit("null")).alias("key"), "page_id", F.octet_length("_r").cast("long").alias("length"), F.sha2("_r", 256).alias("sha256")
    )
    return stage(gapless(stage(slim, "digests"), ["key"], ["sha256"], "nth"), "digests").select("key", "page_id", "nth", "length", "sha256")


def _levels(leaves: DataFrame, n: int, fanout: int) -> list[DataFrame]:
    """leaves: (replica, node, length, hash). The leaves and every level of ranges above them, the root last."""
    levels = [leaves]
    while n > 1:
        children = F.sort_array(F.collect_list(F.struct("node", "length", "hash")))
        up = levels[-1].groupBy("replica", F.floor(F.col("node") / fanout).alias("up")).agg(children.alias("c"), F.sum("length").alias("length"))

        def entry(x, i):
            offset = F.aggregate(F.slice("c", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["length"])
            return F.concat_ws(":", x["node"].cast("string"), offset.cast("string"), x["length"].cast("string"), x["hash"])

        text = F.array_join(F.transform("c", entry), ",")
        levels.append(stage(up.select("replica", F.col("up").alias("node"), "length", F.sha2(text.cast("binary"), 256).alias("hash")), "merkle"))
        n = -(-n // fanout)
    return levels


def _unlike(level: DataFrame) -> DataFrame:
    """Nodes that differ between the replicas or that only one has: (node, first, second), the hashes or null."""
    both = level.groupBy("node").agg(*[F.max(F.when(F.col("replica") == r, F.col("hash"))).alias(r) for r in ("first", "second")])
    return both.filter(~F.col("first").eqNullSafe(F.col("second")))


def roots(first: DataFrame, second: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(replica, hash) of the two roots; a replica without records has none."""
    _, levels = _trees(digests(first), digests(second), fanout)
    return levels[-1].select("replica", "hash")


def _trees(a: DataFrame, b: DataFrame, fanout: int) -> tuple[DataFrame, list[DataFrame]]:
    """(every record of either replica in order, the levels of both trees)."""
    one, other = a.toDF("key", "page_id", "nth", "length", "sha256"), b.toDF("key", "_other", "nth", "replica_length", "replica_sha256")
    union = one.join(other, ["key", "nth"], "full").withColumn("page_id", F.coalesce("page_id", "_other")).drop("_other")
    placed = stage(ordinals(union, ["page_id", "key", "nth"], {"length": "offset", "replica_length": "replica_offset"}), "placed")
    leaves = [
        placed.filter(F.col(h).isNotNull()).select(F.lit(r).alias("replica"), F.col("ordinal").alias("node"), F.col(n).alias("length"), F.col(h).alias("hash"))
        for r, n, h in (("first", "length", "sha256"), ("second", "replica_length", "replica_sha256"))
    ]
    return placed, _levels(leaves[0].unionByName(leaves[1]), placed.count(), fanout)


def audit(first: DataFrame, second: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per record of either replica: page_id, ordinal, offset, length, sha256, replica_sha256, status."""
    placed, levels = _trees(digests(first), digests(second), fanout)
    unlike = _unlike(levels[-1])
    for level in reversed(levels[:-1]):
        suspects = level.join(unlike.select(F.col("node").alias("_up")), F.floor(F.col("node") / fanout) == F.col("_up"), "left_semi")
        unlike = stage(_unlike(suspects), "unlike")
    found = F.when(F.col("first").isNull(), "extra").when(F.col("second").isNull(), "missing").otherwise("corrupt")
    judged = placed.join(unlike.select(F.col("node").alias("ordinal"), found.alias("_found")), "ordinal", "left")
    offset = F.when(F.col("sha256").isNotNull(), F.col("offset"))
    return judged.select("page_id", "ordinal", offset.alias("offset"), "length", "sha256", "replica_sha256", F.coalesce("_found", F.lit("intact")).alias("status"))


def with_faults(pages: DataFrame) -> DataFrame:
    """A second replica with known faults, for drills: every 97th page altered in its first character, every 193rd cut by
    one, every 389th lost, and every 211th there once more under the number -page_id - 1."""
    html = F.coalesce("html", F.lit(""))
    altered = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("?"), F.substring(html, 2, 2_000_000_000))).when(F.col("page_id") % 193 == 7, F.expr("left(coalesce(html, ''), greatest(length(coalesce(html, '')) - 1, 0))")).otherwise(html)
    pages = pick(pages, "page_id", "url", "html")
    copies = F.when(F.col("page_id") % 389 == 11, F.array().cast("array<bigint>")).when(F.col("page_id") % 211 == 13, F.array("page_id", -F.col("page_id") - 1)).otherwise(F.array("page_id"))
    return pages.select(F.explode(copies).alias("page_id"), "url", altered.alias("html"))
