"""Token ids as binary segments: documents in ascending doc_id order, boundaries in Elias-Fano code.

A table of segments is a Parquet folder (any store that Spark writes) with one row per segment: part, number in the
part, documents and ids in it, and its image (see elias_fano.write_segment). Parts are ranges of doc_id in ascending
order; a segment's header says what precedes it in its part, so only one total per part is needed to place it.

Defined results. Null text: as the empty text, the end id alone. Empty table: no segments. Very long texts: a segment
of their own. Equal doc_ids: adjacent, in the order of the hash of their text. Null doc_id: first. Extra columns:
ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.llm.common import pick, stage_path
from folioscan.llm.elias_fano import Segment, write_segment
from folioscan.llm.tokens import encoder, slices, text_sizes

#: Bytes of text encoded at once, and ids in a segment (what is encoded at once stays together and may exceed it).
CHUNK, SEGMENT_IDS = 4_000_000, 2_000_000
#: Documents in a batch that is read back.
READ = 4096


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, parts: int | None = None) -> None:
    """Encode every text, append end_id, and write segments to path. Only the texts shuffle, once, into doc_id ranges."""
    n = parts or max(8, 2 * docs.rdd.getNumPartitions())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ordinal, start = TaskContext.get().partitionId(), 0, 0, 0
        keys, ids, lengths, held = [], [], [], 0

        def flush():
            nonlocal seq, ordinal, start, keys, ids, lengths, held
            n = np.concatenate(lengths)
            image = write_segment(ordinal, start, keys, n, np.concatenate(ids))
            row = {"part": [part], "seq": [seq], "n_docs": [len(keys)], "n_ids": [int(n.sum())], "image": [image]}
            seq, ordinal, start, keys, ids, lengths, held = seq + 1, ordinal + len(keys), start + int(n.sum()), [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())]))

        enc = encoder(tokenizer, end_id)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(text_sizes(texts), CHUNK):
                flat, n = enc.encode(texts.slice(a, b - a))
                if keys and held + len(flat) > SEGMENT_IDS:
                    yield flush()
                keys += doc_ids[a:b]
                ids.append(flat)
                lengths.append(n)
                held += len(flat)
        if keys:
            yield flush()

    ranged = pick(docs, "doc_id", "text").withColumn("_h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    ranged.mapInArrow(pack, "part int, seq int, n_docs long, n_ids long, image binary").write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, the ids.

    Offsets and doc_ids are decoded from one select directory entry to the next; no table of offsets is made.
    """
    segments = spark.read.parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    # one row per part, of which there are as many as write tasks: small by construction
    placed = segments.select("part", "image").join(F.broadcast(starts), "part").select("part_start", "image")

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part_start, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Segment(image.as_buffer())
                spans = s.spans()
                while some := list(itertools.islice(spans, READ)):
                    docs = [s.ids[a:b].astype("<u4") for _, a, b in some]
                    keys, begins, ends = zip(*some, strict=True)
                    columns = [
                        pa.array(keys, pa.int64()),
                        pa.array([a + part_start + s.start for a in begins], pa.int64()),
                        pa.array([b - a for a, b in zip(begins, ends, strict=True)], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in docs], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32) for x in docs], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return placed.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the segments to the shared folder and give what reading them back yields."""
    path = stage_path(docs.sparkSession, "token-segments")
    write_tokens(docs, tokenizer, path, end_id)
    return read_tokens(docs.sparkSession, path)
