"""Two renderings of a document met page by page, as compressed pages instead of rows.

The rows of a page that stand together become one value of bytes before the shuffle: numbers as differences, bytes of
equal weight together, texts in a row, all under zstd, some 5 bytes a cell instead of 20. A kernel then sees both sides of
whole pages as columns, finds what lies near with pages.meeting and compares each two texts once.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from folioscan.operators import kernels, pages
from folioscan.operators.spatial import COORDS

_ZSTD = pa.Codec("zstd", 1)
_HEAD = "<iiB"
#: Longest text that is compared with many others at once, and pairs compared so.
_SHORT, _PAIRS = 32, 4096


class Both(NamedTuple):
    """Two renderings as one table of compressed pages (keys, _cell, _n, _rows), with the types of ident on both sides."""

    frame: DataFrame
    keys: list[str]
    ident: str
    kinds: tuple[str, str]
    texts: int


class Side(NamedTuple):
    """Rows of one rendering: the place of each row's page among the compressed ones, ident, boxes, texts."""

    piece: np.ndarray
    ident: pa.Array
    boxes: np.ndarray
    texts: list[pa.Array]


def encoded(cuts: np.ndarray, ident: pa.Array, boxes: np.ndarray, texts: list[pa.Array]) -> list[bytes]:
    """A value of bytes for the rows from each cut to the next; unknown sides are NaN."""
    whole = bool(np.isfinite(boxes).all() and (np.abs(boxes) < 2.0**53).all() and (boxes == np.trunc(boxes)).all())
    sides = (boxes.astype(np.int64) if whole else np.ascontiguousarray(boxes).view(np.int64)).T
    own = pa.types.is_integer(ident.type) and not ident.null_count
    number = ident.to_numpy(zero_copy_only=False).astype(np.int64) if own else np.arange(len(ident))
    filled = [pc.fill_null(t.cast(pa.string()), "") for t in texts]
    ends = [np.frombuffer(t.buffers()[1], np.int32)[t.offset : t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int32) for t in filled]
    data = [memoryview(t.buffers()[2] or b"") for t in filled]
    sizes = [np.where(t.is_null().to_numpy(zero_copy_only=False), -1, np.diff(e)) for t, e in zip(texts, ends, strict=True)]
    m = np.stack([number, sides[0], sides[1], sides[2] - sides[0], sides[3] - sides[1], *sizes]).astype(np.int64)
    first = m[:3, cuts[:-1]]
    m[:3, 1:] = m[:3, 1:] - m[:3, :-1]
    m[:3, cuts[:-1]] = first
    half = np.maximum.reduceat(m.max(axis=0), cuts[:-1]) < 2**31
    half &= np.minimum.reduceat(m.min(axis=0), cuts[:-1]) >= -(2**31)
    lean = m.astype(np.int32)
    out = []
    for a, b, small in zip(cuts[:-1].tolist(), cuts[1:].tolist(), half.tolist(), strict=True):
        numbers = np.ascontiguousarray((lean if small else m)[:, a:b])
        body = [struct.pack(_HEAD, b - a, len(m), whole + 2 * own + 4 * small), numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()]
        body += [d[e[a] : e[b]] for d, e in zip(data, ends, strict=True)]
        if not own:
            body.append(pickle.dumps(ident.slice(a, b - a).to_pylist()))
        together = b"".join(body)
        out.append(struct.pack("<q", len(together)) + _ZSTD.compress(together, asbytes=True))
    return out


def decoded(blobs: list[bytes], places: np.ndarray, n_texts: int, kind: pa.DataType) -> Side:
    """The rows of encoded pages, places being that of each."""
    counts, idents, boxes, others = [], [], [], []
    parts: list[list] = [[] for _ in range(2 * n_texts)]
    for blob in blobs:
        together = _ZSTD.decompress(memoryview(blob)[8:], struct.unpack_from("<q", blob)[0], asbytes=True)
        n, rows, flags = struct.unpack_from(_HEAD, together)
        at = struct.calcsize(_HEAD)
        width = 4 if flags & 4 else 8
        m = np.frombuffer(together, np.uint8, rows * n * width, at).reshape(width, rows * n).T.copy().view(f"i{width}").reshape(rows, n).astype(np.int64)
        at += rows * n * width
        m[:3] = np.cumsum(m[:3], axis=1)
        m[3] += m[1]
        m[4] += m[2]
        counts.append(n)
        boxes.append(m[1:5].astype(float) if flags & 1 else m[1:5].view(float))
        for k in range(n_texts):
            size = int(np.maximum(m[5 + k], 0).sum())
            parts[2 * k].append(m[5 + k])
            parts[2 * k + 1].append(together[at : at + size])
            at += size
        idents.append(m[0])
        others.append(None if flags & 2 else pickle.loads(together[at:]))
    texts = []
    for k in range(n_texts):
        sizes = np.concatenate(parts[2 * k]) if blobs else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
        t = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(b"".join(parts[2 * k + 1]))).cast(pa.string())
        texts.append(pc.if_else(pa.array(sizes >= 0), t, pa.scalar(None, pa.string())))
    if any(x is not None for x in others):
        ident = pa.array([v for x, m in zip(others, idents, strict=True) for v in (m.tolist() if x is None else x)], kind)
    else:
        ident = pa.array(np.concatenate(idents) if blobs else np.zeros(0, np.int64)).cast(kind)
    return Side(np.repeat(places, counts).astype(np.int64), ident, np.concatenate(boxes, axis=1).T if blobs else np.zeros((0, 4)), texts)


def packed(rows: DataFrame, keys: list[str], ident: str, texts: list[str], is_cell: bool) -> DataFrame:
    """(keys, _cell, _n, _rows): a row for each run of equal keys in a batch."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in keys:
                c = batch.column(k)
                new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            cuts = np.append(first, batch.num_rows)
            blobs = encoded(cuts, batch.column(ident), pages.boxes_of({c: batch.column(c) for c in COORDS}), [batch.column(t) for t in texts])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(first)) for k in keys), pa.array([is_cell] * len(first)), pa.array(np.diff(cuts).astype(np.int64)), pa.array(blobs, pa.binary())], [*keys, "_cell", "_n", "_rows"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _cell boolean, _n long, _rows binary"
    return rows.select(*keys, ident, *COORDS, *texts).mapInArrow(pack, schema)


def paired(cells: DataFrame, others: DataFrame, keys: list[str], ident: str, text: Callable[[Column], Column], raw: bool = False) -> Both:
    """Cells and others (keys, ident, box, text) with their texts in the form given; raw: and cells with theirs as it stands, where it differs."""

    def side(df: DataFrame, is_cell: bool) -> DataFrame:
        form = text(F.col("text"))
        own = F.when(F.col("text") != form, F.col("text")) if is_cell else F.lit(None).cast("string")
        return packed(df.select(*keys, ident, *COORDS, form.alias("_text"), *([own.alias("_raw")] if raw else [])), keys, ident, ["_text", "_raw"][: 1 + raw], is_cell)

    return Both(side(cells, True).unionByName(side(others, False)), keys, ident, (dict(cells.dtypes)[ident], dict(others.dtypes)[ident]), 1 + raw)


def meet(both: Both, kernel: Callable[[Side, Side, np.ndarray, np.ndarray], tuple[np.ndarray, list]], names: list[str], schema: str) -> DataFrame:
    """What the kernel makes of the cells and the others of whole pages, given the page of each place and whether that has a key: the place that each row of its own belongs to, and columns (names, with types in schema; the keys precede)."""
    keys, types = both.keys, dict(both.frame.dtypes)
    kinds = [to_arrow_type(_parse_datatype_string(k)) for k in both.kinds]
    n_texts = both.texts

    def run(page: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
        is_cell = rows.column("_cell").to_numpy(zero_copy_only=False).astype(bool)
        blobs = rows.column("_rows")
        a, b = (decoded([blobs[i].as_py() for i in at.tolist()], at, n_texts, kind) for at, kind in zip((np.flatnonzero(is_cell), np.flatnonzero(~is_cell)), kinds, strict=True))
        with_key = np.logical_and.reduce([rows.column(k).is_valid().to_numpy(zero_copy_only=False) for k in keys])
        place, columns = kernel(a, b, page, with_key)
        of = pa.array(place, pa.int64())
        return pa.RecordBatch.from_arrays([*(rows.column(k).take(of) for k in keys), *columns], [*keys, *names])

    return kernels.whole_pages(both.frame, keys, run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema, long="_n")


# --- texts --------------------------------------------------------------------------------------------------------------


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """The edit distance of each a with its b, in letters."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.zeros(len(a), np.int64)
    longer = np.maximum(la, lb)
    short = np.flatnonzero(longer <= _SHORT)
    short = short[np.argsort(longer[short], kind="stable")]
    for at in range(0, len(short), _PAIRS):
        k = short[at : at + _PAIRS]
        p, q = int(la[k].max()), int(lb[k].max())
        s, t = (np.array([x[i] for i in k.tolist()], f"U{max(1, n)}").view(np.uint32).reshape(len(k), -1).T.copy() for x, n in ((a, p), (b, q)))
        d = np.zeros((p + 1, q + 1, len(k)), np.uint8)
        d[:, 0], d[0] = np.arange(p + 1)[:, None], np.arange(q + 1)[:, None]
        for i in range(p):
            apart = (t != s[i]).view(np.uint8)
            for j in range(q):
                np.minimum(d[i, j + 1], d[i + 1, j], out=d[i + 1, j + 1])
                d[i + 1, j + 1] += 1
                np.minimum(d[i + 1, j + 1], d[i, j] + apart[j], out=d[i + 1, j + 1])
        out[k] = d[la[k], lb[k], np.arange(len(k))]
    for k in np.flatnonzero(longer > _SHORT).tolist():
        s, t = (np.frombuffer(x[k].encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b))
        steps = np.arange(len(t) + 1)
        row = steps.copy()
        for i, c in enumerate(s.tolist()):
            low = np.minimum(row[1:] + 1, row[:-1] + (t != c))
            row = np.minimum.accumulate(np.concatenate(([i + 1], low)) - steps) + steps
        out[k] = row[-1]
    return out


class Texts:
    """Texts of both sides as numbers, and how alike any two are, each two compared once."""

    def __init__(self, a: pa.Array, b: pa.Array):
        coded = pa.concat_arrays([a, b]).dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.a, self.b = codes[: len(a)], codes[len(a) :]
        self.values = coded.dictionary
        self.length = pc.utf8_length(self.values).to_numpy(zero_copy_only=False).astype(np.int64)
        self.spaced = pc.match_substring(self.values, " ").to_numpy(zero_copy_only=False).astype(bool)
        self.blank = np.append(self.length == 0, True)  # no text, by its number -1, too
        self._letters = None

    def of(self, i: np.ndarray) -> list[str]:
        return self.values.take(pa.array(i)).to_pylist()

    def letters(self) -> np.ndarray:
        """Which ASCII letters a text has, by the last six bits of each."""
        if self._letters is None:
            _, ends, data = self.values.buffers()
            ends = np.frombuffer(ends, np.int32)[self.values.offset : self.values.offset + len(self.length) + 1] if len(self.length) else np.zeros(1, np.int32)
            some = np.flatnonzero(np.diff(ends))
            self._letters = np.zeros(len(self.length), np.uint64)
            if len(some):
                data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
                bits = np.where(data < 128, np.uint64(1) << (data & 63).astype(np.uint64), np.uint64(0))
                self._letters[some] = np.bitwise_or.reduceat(bits, (ends[:-1] - ends[0])[some])
        return self._letters

    def least(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """No more than the distance of the texts i and j: by their lengths, and by letters that only one has."""
        m = self.letters()
        p, q = m[i], m[j]
        return np.maximum(np.abs(self.length[i] - self.length[j]), np.maximum(np.bitwise_count(p & ~q), np.bitwise_count(q & ~p)))

    def _plain(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """text.levenshtein_similarity of texts that differ."""
        longer = np.maximum(self.length[i], self.length[j])
        return 1 - distances(self.of(i), self.of(j)) / longer

    def _once(self, i: np.ndarray, j: np.ndarray, alike: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        wide = len(self.values) + 1
        pairs, back = np.unique(i * wide + j, return_inverse=True)
        p, q = pairs // wide, pairs % wide
        s = np.ones(len(pairs))
        other = np.flatnonzero(p != q)
        s[other] = alike(p[other], q[other])
        return s[back]

    def similarity(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """text.levenshtein_similarity of the texts numbered i and j."""
        return self._once(i, j, self._plain)

    def token_similarity(self, i: np.ndarray, j: np.ndarray, phrase: bool, floor: float = 0.0) -> np.ndarray:
        """text.token_similarity of the texts numbered i and j; below floor it may come out as 0."""

        def alike(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            spaced = self.spaced[q]
            out = np.zeros(len(p))
            ask = np.flatnonzero(spaced | (self.least(p, q) <= (1 - floor) * np.maximum(self.length[p], self.length[q]) + 1e-9))
            out[ask] = self._plain(p[ask], q[ask])
            if spaced.any():
                places = np.flatnonzero(spaced)
                words = [(k, x, w) for k, x, y in zip(places.tolist(), self.of(p[places]), self.of(q[places]), strict=True) for w in y.split(" ")]
                k, a, b = zip(*words, strict=True)
                longer = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)])
                np.maximum.at(out, np.array(k), 1 - distances(list(a), list(b)) / longer)
            if phrase:
                for k, (x, y) in enumerate(zip(self.of(p), self.of(q), strict=True)):
                    if x in y or y in x:
                        out[k] = 1.0
            return out

        return self._once(i, j, alike)


def near(a: Side, b: Side, page: np.ndarray, with_key: np.ndarray, around: bool, bins: tuple[float, float] | None = pages.BINS) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), in order, of the rows of a and of b of one page that overlap; around: those too that share an interval of x and lie at most half of a's height apart along y."""
    other = np.flatnonzero(with_key[b.piece])
    p, q = a.boxes, b.boxes[other]
    reach = p
    if around:
        half = 0.5 * np.maximum(1e-6, p[:, 3] - p[:, 1])
        reach = np.stack([p[:, 0], p[:, 1] - half - 1e-6, p[:, 2], p[:, 3] + half + 1e-6], axis=1)
    i, j = pages.meeting(reach, q, bins, (page[a.piece], page[b.piece[other]]))
    if around:
        gap = np.maximum(0.0, np.maximum(q[j, 1] - p[i, 3], p[i, 1] - q[j, 3]))
        ok = gap <= half[i]
        i, j = i[ok], j[ok]
    return i, other[j]
