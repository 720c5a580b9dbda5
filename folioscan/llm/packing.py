"""Vector bin packing of token pieces by the dot-product heuristic.

A document's ids are cut at every `tokens` ids; whole pieces fill a sequence each. What remains at the documents' ends
is packed under simultaneous limits on tokens, segments and loss-bearing tokens: the open sequence takes, among the
pieces that fit in every dimension, the one whose demand (each part divided by its limit) has the largest dot product
with the room left; when none fits, the next sequence is opened. Pieces of equal demand are one class, so a step costs
a pass over the classes and not over the pieces. Pieces are dealt into groups by a hash, each as large as an input
partition, and packed group by group; a group's last sequences are all that is lost by this.

Defined results. Null or empty text: the end id alone, one piece of one id. Very long texts: cut. Ties: the class with
more tokens, then more loss-bearing tokens, first; inside a class by (doc_id, start, checksum). Repeated rows: packed
each. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import pick
from folioscan.llm.tokens import encoder, slices, text_sizes


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss_tokens: int = 1024


CHUNK = 4_000_000
_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("loss", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
_PIECE_DDL = "doc_id long, start long, length long, loss long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, limits: Limits = Limits()) -> DataFrame:
    """One row per piece. The first id of a document is never predicted, so it bears no loss."""
    most = min(limits.tokens, limits.loss_tokens)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(text_sizes(texts), CHUNK):
                flat, counts = enc.encode(texts.slice(a, b - a))
                raw, rows, at = memoryview(flat.astype("<u4").tobytes()), [], 0
                for key, n in zip(doc_ids[a:b], counts.tolist(), strict=True):
                    for s in range(0, n, most):
                        m = min(most, n - s)
                        rows.append((key, s, m, m - (s == 0), zlib.crc32(raw[4 * (at + s) : 4 * (at + s + m)]), n))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=pa.schema(_PIECE))

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut, _PIECE_DDL)


def pack_vectors(demands: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in its bin) of each demand vector; demands within a class keep their order. Each must fit an empty bin."""
    classes, of = np.unique(-demands, axis=0, return_inverse=True)  # the largest first, so argmax breaks ties for them
    classes, of = -classes, of.ravel()
    order = np.argsort(of, kind="stable")
    left = np.bincount(of, minlength=len(classes))
    nxt = np.concatenate(([0], np.cumsum(left)[:-1]))
    bins, places = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
    number = np.arange(len(classes))
    columns = [np.ascontiguousarray(c) for c in classes.T]
    scaled = [c / m for c, m in zip(columns, limits.tolist(), strict=True)]
    falling, spent, n_bin, todo = -columns[0], 0, -1, len(of)
    full = columns[0] == limits[0]  # these fill a bin each
    if full.any():
        which = np.flatnonzero(np.isin(of, np.flatnonzero(full)))
        bins[which], places[which] = np.arange(len(which)), 0
        n_bin, todo = len(which) - 1, todo - len(which)
        left[full] = 0
        spent = len(number)
    while todo:
        if 2 * spent > len(number):  # leave out the classes that are used up
            some = left[number] > 0
            number, spent = number[some], 0
            columns, scaled = [c[some] for c in columns], [c[some] for c in scaled]
            falling = -columns[0]
        here = left[number] > 0
        n_bin, place, room = n_bin + 1, 0, limits.tolist()
        while True:
            if room[0] < -falling[-1]:
                break
            low = int(np.searchsorted(falling, -room[0]))  # smaller ones fit in the first dimension
            fits = here[low:].copy()
            score = scaled[0][low:] * (room[0] / limits[0])
            for c, x, r, m in zip(columns[1:], scaled[1:], room[1:], limits[1:], strict=True):
                fits &= c[low:] <= r
                score += x[low:] * (r / m)
            if not fits.any():
                break
            score[~fits] = -1
            best = low + int(score.argmax())
            k = number[best]
            item = order[nxt[k]]
            nxt[k] += 1
            left[k] -= 1
            if not left[k]:
                here[best] = False
                spent += 1
            bins[item], places[item] = n_bin, place
            place, todo = place + 1, todo - 1
            room = [r - int(c[best]) for r, c in zip(room, columns, strict=True)]
    return bins, places


def pack(pieces: DataFrame, limits: Limits = Limits(), groups: int = 8) -> DataFrame:
    """pieces with sequence_id and offset (ids before the piece in its sequence)."""
    caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.int64)
    fields = [*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        group = table.column("_g")[0].as_py() if table.num_rows else 0
        length, loss = table.column("length").to_numpy(), table.column("loss").to_numpy()
        bins, places = pack_vectors(np.stack([length, np.ones_like(length), loss], axis=1), caps)
        order = np.lexsort((places, bins))
        ahead = np.cumsum(length[order]) - length[order]
        first = np.searchsorted(bins[order], bins[order])
        offset = np.empty_like(length)
        offset[order] = ahead - ahead[first]
        table = table.drop_columns(["_g"])
        return table.append_column("sequence_id", pa.array((group << 40) + bins)).append_column("offset", pa.array(offset)).cast(pa.schema(fields))

    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("_g").applyInArrow(one, _PIECE_DDL + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, limits: Limits = Limits()) -> DataFrame:
    """Every id of every document in exactly one piece, every piece in a sequence within the limits."""
    return pack(cut_documents(docs, tokenizer, end_id, limits), limits, max(1, docs.rdd.getNumPartitions()))


def cut_conversations(conversations: DataFrame, tokenizer: str, end_id: int = 0, limits: Limits = Limits()) -> DataFrame:
    """Pieces of formatted conversations (conv_id as doc_id), of which only the replies' ids bear loss.

    Text between replies and replies are encoded apart, so that the mask ends where ids end. A piece ends where the next
    id would exceed the limit on tokens or on loss.
    """
    from folioscan.llm.chat_format import format_conversations

    spans = format_conversations(conversations)
    edges = F.concat(F.flatten(F.transform("replies", lambda r: F.array(r["lo"], r["hi"]))), F.array(F.length("formatted").cast("long")))
    segments = F.transform(edges, lambda e, i: F.substr(F.col("formatted"), (F.when(i > 0, F.get(edges, i - 1)).otherwise(0) + 1).cast("int"), (e - F.when(i > 0, F.get(edges, i - 1)).otherwise(0)).cast("int")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, None)
        for batch in batches:
            rows = []
            for key, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat, counts = enc.encode(parts.values)
                bears = np.append(np.repeat(np.arange(len(counts)) % 2 == 1, counts), False)  # replies are every second part
                ids = np.append(flat, end_id).astype("<u4")
                total, at = np.concatenate(([0], np.cumsum(bears))), 0
                while at < len(ids):
                    stop = min(len(ids), at + limits.tokens, int(np.searchsorted(total, total[at] + limits.loss_tokens, "right")) - 1)
                    rows.append((key, at, stop - at, int(total[stop] - total[at]), zlib.crc32(ids[at:stop].tobytes()), len(ids)))
                    at = stop
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=pa.schema(_PIECE))

    return spans.select(F.col("conv_id").cast("long").alias("doc_id"), segments.alias("parts")).mapInArrow(cut, _PIECE_DDL)


def pack_conversations(conversations: DataFrame, tokenizer: str, end_id: int = 0, limits: Limits = Limits()) -> DataFrame:
    """Every id of every formatted conversation in one piece, every piece in a sequence within the limits on tokens, segments and loss."""
    return pack(cut_conversations(conversations, tokenizer, end_id, limits), limits, max(1, conversations.rdd.getNumPartitions()))


def fullest(packed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(limit, sequences): by which limit sequences are closest to full; of equals the first of tokens, segments, loss_tokens."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("segments"), F.sum("loss").alias("loss_tokens"))
    names = ("tokens", "segments", "loss_tokens")
    most = F.array_max(F.array(*[F.struct((F.col(n) / getattr(limits, n)).alias("share"), F.lit(-k).alias("k")) for k, n in enumerate(names)]))["k"]
    return used.select(F.get(F.array(*map(F.lit, names)), -most).alias("limit")).groupBy("limit").agg(F.count("*").alias("sequences"))
