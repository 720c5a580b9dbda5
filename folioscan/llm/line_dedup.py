"""Line dedup by winnowing over line hashes, in built-in functions only.

A run of consecutive non-blank lines counts as a match if it has MIN_CHARS characters, or WINDOW lines, and occurs at
an earlier place (doc_id, line) too. Windows are the shortest stretches that reach either bound, one from each line
downwards and one from each line upwards; any run that counts holds such a window, and the windows inside it cover it.

1. Winnowing. Of each window the smallest line hash is selected (the leftmost of equal ones). Only these fingerprints
   travel, without texts or neighbours, and are pre-aggregated; one selected at a single position is dropped.
2. Positions. Windows whose fingerprint was met again are joined with it. The most frequent fingerprints are salted, so
   a line in a third of all documents is spread over many tasks.
3. Extension. A window reaches from its fingerprint to both sides: the offset to the left and the hashes of all its
   lines tell whether it equals another. Equal windows are aggregated to their earliest place; as the windows of a
   match overlap, together they are the match extended both ways. No two positions are ever paired.
4. Lines of windows whose earliest place is another are deleted: of every repeated run its first occurrence stays.

Defined results. Null or empty text: no lines, nothing removed, kept as it is. Blank lines: never matched or counted,
they stay. Lines are compared without white space at their ends, by 128 bits of hash. A text of fewer than MIN_CHARS
characters and WINDOW lines: kept whole. Very long texts: read whole. Null doc_id: before all others. Equal doc_ids:
rows are numbered apart by the hash of their text; of identical rows one is the first and the others repeat it. Extra
columns: kept (see unload for clashes with the added ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import carry, let, pick, salted, stage, unload

MIN_CHARS, WINDOW = 60, 8
SPACE = " \t\x0b\f\r"
_ROW = ["_z", "_d", "_h"]


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _solid(lines: Column) -> Column:
    """(h, g: two hashes, n: characters, i: number) of each line that isn't blank."""
    trimmed = F.transform(lines, lambda x, i: F.struct(F.btrim(x, F.lit(SPACE)).alias("t"), i.alias("i")))
    return F.transform(
        F.filter(trimmed, lambda x: x["t"] != ""), lambda x: F.struct(F.xxhash64(x["t"]).alias("h"), F.xxhash64(F.lit(1), x["t"]).alias("g"), F.length(x["t"]).alias("n"), x["i"].alias("i"))
    )


def _identity() -> list[Column]:
    """What tells rows apart, without nulls: whether there is a doc_id, the doc_id, and the hash of the text."""
    return [F.col("doc_id").isNotNull().alias("_z"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_d"), F.xxhash64("text").alias("_h")]


def _windows(s: Column, min_chars: int, window: int) -> Column:
    """The distinct windows of an array of lines: (fp, left, e1, e2, at, to), places being numbers in the array."""

    def reach(part: Column) -> Column:
        """Lines, from the first, until a bound is reached; 0 if none is."""
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"))
        met = F.aggregate(part, zero, lambda a, x: F.when(a["n"] >= min_chars, a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), (a["k"] + 1).alias("k"))))
        return let(met, lambda a: F.when((a["n"] >= min_chars) | (a["k"] >= window), a["k"]).otherwise(0))

    width = F.lit(window)
    down = F.transform(s, lambda x, i: F.when(x["n"] >= min_chars, 1).otherwise(reach(F.slice(s, i + 1, width))))
    up = F.transform(s, lambda x, i: F.when(x["n"] >= min_chars, 1).otherwise(let(F.greatest(i + 2 - width, F.lit(1)), lambda a: reach(F.reverse(F.slice(s, a, i + 2 - a))))))
    # start and length in one integer: sets of integers are hashed
    starts = F.transform(down, lambda k, i: F.when(k > 0, F.shiftleft(i.cast("long"), 8) + k))
    stops = F.transform(up, lambda k, i: F.when(k > 0, F.shiftleft((i + 1 - k).cast("long"), 8) + k))
    codes = F.filter(F.array_union(starts, stops), lambda c: c.isNotNull())

    def one(c: Column) -> Column:
        at, k = F.shiftright(c, 8).cast("int"), F.pmod(c, F.lit(256)).cast("int")

        def named(w: Column) -> Column:
            hs = F.transform(w, lambda x: x["h"])
            fp = F.array_min(hs)
            return F.struct(
                fp.alias("fp"), (F.array_position(hs, fp) - 1).cast("int").alias("left"), F.xxhash64(hs).alias("e1"), F.xxhash64(F.transform(w, lambda x: x["g"])).alias("e2"), at.alias("at"), (at + k - 1).alias("to")
            )

        return let(F.slice(s, at + 1, k), named)

    return F.transform(codes, one)


def _selected(docs: DataFrame, min_chars: int, window: int) -> DataFrame:
    """(fp) of every selected position of every row."""

    def minima(s: Column) -> Column:
        places = F.array_distinct(F.transform(_windows(s, min_chars, window), lambda w: w["at"] + w["left"]))
        return F.transform(places, lambda p: F.get(s, p)["h"])

    return docs.select(F.explode(let(_solid(_split(F.col("text"))), minima)).alias("fp"))


def removals(docs: DataFrame, min_chars: int = MIN_CHARS, window: int = WINDOW) -> DataFrame:
    """(_z, _d, _h, lines array<int>): numbers of a row's lines that are to be deleted."""
    slim = pick(docs, "doc_id", "text")
    met = stage(_selected(slim, min_chars, window).groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1"), "fingerprints")

    def numbered(s: Column) -> Column:
        """The windows, with the numbers of their lines in the text."""
        return F.transform(_windows(s, min_chars, window), lambda w: w.withField("lines", F.transform(F.slice(s, w["at"] + 1, w["to"] - w["at"] + 1), lambda x: x["i"])).dropFields("to"))

    placed = slim.select(*_identity(), F.explode(let(_solid(_split(F.col("text"))), numbered)).alias("w")).select(*_ROW, "w.*")
    rows, groups, keys = salted(placed, met, ["fp"], "n", F.struct("_h", "at"))
    again = stage(rows.join(groups.drop("n"), keys).drop("_salt"), "windows")
    same = ["fp", "left", "e1", "e2"]
    place = F.struct(*_ROW, "at")
    first = stage(again.groupBy(*same).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).filter(F.col("first") != F.col("last")).drop("last"), "matches")
    rows, groups, keys = salted(again, first, same, "n", F.struct("_h", "at"))
    later = rows.join(groups.drop("n"), keys).filter(place != F.col("first"))
    return later.select(*_ROW, F.explode("lines").alias("line")).groupBy(*_ROW).agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, window: int = WINDOW) -> DataFrame:
    """docs with `text` without the later runs, and _n_lines, _n_removed (of non-blank lines)."""
    whole = carry(docs, "doc_id", "text").select("*", *_identity())
    joined = whole.join(removals(docs, min_chars, window).withColumnRenamed("lines", "_gone"), _ROW, "left")
    # identical rows share their places: all but one of them repeat the one
    joined = joined.withColumn("_copy", F.row_number().over(Window.partitionBy(*_ROW).orderBy(*_ROW)))
    lines = _split(F.col("text"))
    solid = _solid(lines)
    counts = let(solid, lambda s: F.struct(F.size(s).alias("k"), F.aggregate(s, F.lit(0), lambda a, x: a + x["n"]).alias("n"), F.transform(s, lambda x: x["i"]).alias("all")))
    joined = joined.withColumn("_c", counts)
    counts_as_match = (F.col("_c.n") >= min_chars) | (F.col("_c.k") >= window)
    gone = F.when((F.col("_copy") > 1) & counts_as_match, F.col("_c.all")).otherwise(F.col("_gone"))
    joined = joined.withColumn("_gone", gone)

    def left(x: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i)), "\n")

    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(let(lines, left))
    return unload(joined, docs, {"text": text}, {"_n_lines": F.col("_c.k").cast("long"), "_n_removed": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")})
