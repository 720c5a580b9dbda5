"""Property profiles: which values the properties of a document's items take, how often, which are rare, and where.

Properties are unpivoted in one Expand and counted in one aggregation, by page first. Sizes are classed as regular or
irregular, the exact number staying with the item. What is kept of a value are its first items only: Spark limits the
ranks before the shuffle (a window group limit), so a value that millions of items have moves a few rows a task. profile,
which needs both, reads its items once: each batch of sorted rows is reduced to counts by page and first items before
anything is unpivoted, and these few rows are counted and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from folioscan.functions import geometry as g
from folioscan.operators.lineage import cut

#: Rare: fewer items, or a smaller share in percent, or (sizes) at most so many on some page. Uncommon: below 5 or this share.
RARE_COUNT, RARE_PERCENT, RARE_ON_PAGE, UNCOMMON_COUNT, UNCOMMON_SHARE = 4, 2.0, 5, 5, 0.05
#: Properties that are measured: their values are classes.
SIZES = ("text_size", "line_height", "size")


def flag(c: str) -> Column:
    return F.when(F.col(c), "True").when(~F.col(c), "False")


def known(c: str) -> Column:
    """An empty name counts, as unknown."""
    return F.when(F.col(c) == "", "Unknown").otherwise(F.col(c))


def spelt(c: str) -> Column:
    return F.when(F.col(c) == "", "None").otherwise(F.col(c))


def some(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def size(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.when(g.is_regular(F.col(c)), "regular").otherwise("irregular"))


def color(c: str) -> Column:
    return g.packed_color(F.col("red"), F.col("green"), F.col("blue")).cast("string")


#: (reading, column) of each property, by kind of item; what reads as null is no item.
ELEMENTS = {
    "embedded": (flag, "font.embedded"), "encoding": (spelt, "font.encoding"), "family_name": (known, "font.family_name"), "name": (known, "font.name"), "monospaced": (flag, "font.monospaced"), "subset": (flag, "font.subset"),
    "has_clip": (flag, "has_clip"), "text_size": (size, "text_size"), "line_height": (size, "line_height"),
}
SPANS = {"font": (some, "font"), "size": (size, "size"), "color": (color, "red")}
WORDS = {"fontname": (some, "font"), "size": (size, "size")}
CELLS = {"font_name": (some, "font_name")}


def _long(rows: DataFrame, properties: dict, kept: list[str]) -> DataFrame:
    """kept, prop, value and exact of every property that an item has."""
    entry = lambda read, c: F.struct(read(c).cast("string").alias("value"), (F.col(c) if read is size else F.lit(None)).cast("double").alias("exact"))
    wide = rows.select(*kept, *[entry(read, c).alias(f"_p_{n}") for n, (read, c) in properties.items()])
    long = wide.unpivot(kept, [f"_p_{n}" for n in properties], "prop", "_e")
    return long.select(*kept, F.substr("prop", F.lit(4)).alias("prop"), "_e.value", "_e.exact").filter("value is not null")


def _shares(by_page: DataFrame, keys: tuple[str, ...], page: str) -> DataFrame:
    """The histogram of counts k by page."""
    ks = [*keys, "prop", "value"]
    counted = by_page.groupBy(*ks).agg(F.sum("k").alias("n"), F.min(F.when(F.col(page).isNotNull(), F.col("k"))).alias("least_page"))
    w = Window.partitionBy(*keys, "prop")
    shares = counted.withColumn("total", F.sum("n").over(w)).withColumn("pct", 100.0 * F.col("n") / F.col("total"))
    return shares.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "value"))).select(*ks, "n", "total", "pct", "rank", "least_page")


def _listed(long: DataFrame, keys: tuple[str, ...], page: str, order: tuple[str, ...], item: tuple[str, ...], keep: int) -> DataFrame:
    """The first items of unpivoted rows."""
    ks = [*keys, "prop", "value"]
    ranked = long.withColumn("_k", F.row_number().over(Window.partitionBy(*ks).orderBy(*order))).filter(F.col("_k") <= keep)
    shown = F.struct(F.col(page).alias("page"), *item, "exact")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_k", shown.alias("item")))), lambda x: x["item"])
    return ranked.groupBy(*ks).agg(listed.alias("items"))


def histogram(rows: DataFrame, properties: dict, keys: tuple[str, ...] = ("doc_id",), page: str = "page_ix") -> DataFrame:
    """(keys, prop, value, n, total, pct, rank, least_page): least_page is the smallest count on a page that has the value."""
    by_page = _long(rows, properties, [*keys, page]).groupBy(*keys, "prop", "value", page).agg(F.count("*").alias("k"))
    return _shares(by_page, keys, page)


def first_items(rows: DataFrame, properties: dict, keys: tuple[str, ...] = ("doc_id",), page: str = "page_ix", order: tuple[str, ...] = ("page_ix",), item: tuple[str, ...] = ("text",), keep: int = 10) -> DataFrame:
    """(keys, prop, value, items): the first `keep` items of each value, as structs (page, item, exact) in order."""
    kept = list(dict.fromkeys([*keys, page, *order, *item]))
    return _listed(_long(rows, properties, kept), keys, page, order, item, keep)


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """A number for each row, equal where all columns are; null is a value."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        code = np.unique(code * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code


def _reduced(rows: DataFrame, properties: dict, keys: tuple[str, ...], page: str, order: tuple[str, ...], item: tuple[str, ...], keep: int) -> DataFrame:
    """Rows (keys, page, order, item, prop, value, exact, k): for each batch of items its counts k by page, and with a null k its first `keep` items of each value."""
    kept = list(dict.fromkeys([*keys, page, *order, *item]))
    sizes = {n for n, (read, _) in properties.items() if read is size}
    wide = rows.select(*kept, *[read(c).cast("string").alias(f"_p_{n}") for n, (read, c) in properties.items()], *[F.col(properties[n][1]).cast("double").alias(f"_x_{n}") for n in sorted(sizes)])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            owner = _codes([batch.column(k) for k in keys])
            place = _codes([pa.array(owner), batch.column(page)])
            of, counts, exact, props, values = [], [], [], [], []
            for n in properties:
                value = batch.column(f"_p_{n}").dictionary_encode()
                some = np.flatnonzero(batch.column(f"_p_{n}").is_valid().to_numpy(zero_copy_only=False))
                if not len(some):
                    continue
                what = value.indices.drop_null().to_numpy().astype(np.int64)
                _, first, k = np.unique(place[some] * len(value.dictionary) + what, return_index=True, return_counts=True)
                group = owner[some] * len(value.dictionary) + what
                by = np.argsort(group, kind="stable")
                begins = np.flatnonzero(np.diff(group[by], prepend=-1))
                shown = np.sort(by[np.arange(len(by)) - np.repeat(begins, np.diff(np.append(begins, len(by)))) < keep])
                both = pa.array(some[np.concatenate([first, shown])])
                of.append(both)
                counts += [pa.array(k.astype(np.int64)), pa.nulls(len(shown), pa.int64())]
                exact.append(batch.column(f"_x_{n}").take(both) if n in sizes else pa.nulls(len(both), pa.float64()))
                props.append(pa.repeat(pa.scalar(n), len(both)))
                values.append(batch.column(f"_p_{n}").take(both))
            if of:
                at = pa.concat_arrays(of)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), *(pa.concat_arrays(x) for x in (props, values, exact, counts))], [*kept, "prop", "value", "exact", "k"])

    schema = StructType([StructField(c, rows.schema[c].dataType) for c in kept] + [StructField("prop", StringType()), StructField("value", StringType()), StructField("exact", DoubleType()), StructField("k", LongType())])
    return wide.sortWithinPartitions(*keys, *order).mapInArrow(reduce, schema)


def profile(rows: DataFrame, properties: dict, keys: tuple[str, ...] = ("doc_id",), page: str = "page_ix", order: tuple[str, ...] = ("page_ix",), item: tuple[str, ...] = ("text",), keep: int = 10) -> DataFrame:
    """The histogram with the first items of each value."""
    found = cut(_reduced(rows, properties, keys, page, order, item, keep))
    counts = found.filter("k is not null").groupBy(*keys, "prop", "value", page).agg(F.sum("k").alias("k"))
    return _shares(counts, keys, page).join(_listed(found.filter("k is null"), keys, page, order, item, keep), [*keys, "prop", "value"])


def is_rare(sizes: tuple[str, ...] = SIZES) -> Column:
    on_page = F.col("prop").isin(*sizes) & (F.col("least_page") <= RARE_ON_PAGE)
    return (F.col("n") < RARE_COUNT) | (F.col("pct") < RARE_PERCENT) | F.coalesce(on_page, F.lit(False))


def is_uncommon() -> Column:
    return F.col("n") < F.greatest(F.lit(float(UNCOMMON_COUNT)), UNCOMMON_SHARE * F.col("total"))


def rare(profiled: DataFrame) -> DataFrame:
    return profiled.filter(is_rare())


def uncommon(profiled: DataFrame) -> DataFrame:
    return profiled.filter(is_uncommon())
