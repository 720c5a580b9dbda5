"""Elements of a page: spans joined with the properties of their fonts and with the clip events of their page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as tx


#: Names meet by so many of their last characters.
ANCHOR = 8


def _parts(name: Column, lengths: Column) -> Column:
    """The distinct stretches of a name that have one of the lengths (up to ANCHOR)."""
    n = F.length(name)
    of = lambda k: F.when(k == 0, F.array(F.lit(""))).when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(name, i, k))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(lengths, of)))


def _first(names: DataFrame, fonts: DataFrame, ks: list[str]) -> DataFrame:
    """(keys, font, font_id, font_name) of distinct names that meet a font: the first, by font_id, whose name holds the name or is held by it.

    The held name's last characters (up to ANCHOR) must be a stretch of the other name, which is an equi-join; only
    stretches as long as some held name's last characters take part, and the names that meet are compared.
    """
    known = fonts.select(*ks, "font_id", F.col("name").alias("font_name")).filter("font_name is not null").groupBy(*ks, "font_name").agg(F.min("font_id").alias("font_id"))
    last = lambda c: F.substr(c, F.greatest(F.length(c) - ANCHOR + 1, F.lit(1)))

    def cut(df: DataFrame, name: str, other: DataFrame, held: str) -> DataFrame:
        lengths = other.agg(F.collect_set(F.least(F.length(held), F.lit(ANCHOR)))).scalar()
        return df.withColumn("_lengths", lengths).withColumn("_part", F.explode(_parts(F.col(name), F.col("_lengths")))).drop("_lengths")

    held = cut(names, "font", known, "font_name").join(known.withColumn("_part", last(F.col("font_name"))), [*ks, "_part"]).filter(F.contains("font", "font_name"))
    holds = names.withColumn("_part", last(F.col("font"))).join(cut(known, "font_name", names, "font"), [*ks, "_part"]).filter(F.contains("font_name", "font"))
    first = held.unionByName(holds).groupBy(*ks, "font").agg(F.min(F.struct("font_id", "font_name")).alias("_f"))
    return first.select(*ks, "font", "_f.font_id", "_f.font_name")


def _names(spans: DataFrame, ks: list[str]) -> DataFrame:
    return spans.select(*ks, "font").filter("font is not null").distinct()


def font_of(spans: DataFrame, fonts: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """spans with font_id and font_name of the first font, by font_id, whose name holds the span's or is held by it.

    keys: what spans and fonts must agree in; none where all documents share one table of fonts. Distinct names are
    joined, not spans.
    """
    ks = list(keys)
    return spans.join(_first(_names(spans, ks), fonts, ks), [*ks, "font"], "left").select(*spans.columns, "font_id", "font_name")


def clip_of(spans: DataFrame, events: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_ix"), ident: str = "span_index", event: str = "event_id") -> DataFrame:
    """spans with has_clip: whether any event of the span's share of its page's events (event order, has_clip) is clipped.

    Spans and events run through the page at their own pace: with E events and S spans, span i has the events from
    round(i * E / S) to round((i + 1) * E / S), at least one while there are any left. A page without events clips nothing.
    """
    ks = list(keys)
    flags = events.groupBy(*ks).agg(F.transform(F.sort_array(F.collect_list(F.struct(event, "has_clip"))), lambda x: x["has_clip"]).alias("_flags"))
    page = Window.partitionBy(*ks)
    placed = spans.withColumn("_i", F.row_number().over(page.orderBy(ident)) - 1).withColumn("_s", F.count("*").over(page)).join(flags, ks, "left")
    at = lambda i: F.bround(i * F.size("_flags") / F.col("_s")).cast("int")
    placed = placed.withColumn("_a", at(F.col("_i"))).withColumn("_n", F.greatest(F.lit(1), at(F.col("_i") + 1) - F.col("_a")))
    clipped = F.exists(F.slice("_flags", F.col("_a") + 1, F.col("_n")), lambda x: x)
    return placed.select(*spans.columns, F.coalesce(clipped, F.lit(False)).alias("has_clip"))


def assemble(spans: DataFrame, fonts: DataFrame, events: DataFrame, font_keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One element per span that has a text: path, page, text, font, has_clip, size, line height, box.

    spans: doc_id, page_ix, span_index, text, font, size, line_height, x0, y0, x1, y1. fonts: doc_id, font_id, name,
    embedded, encoding, font_type. events: doc_id, page_ix, event_id, text, has_clip; those without text or clip are no
    events. A span whose font isn't known keeps its own name. font_keys: () where one table of fonts serves all documents.
    """
    shown = spans.filter(tx.normalize_clip(F.col("text")) != "")
    real = events.filter((tx.normalize_clip(F.coalesce("text", F.lit(""))) != "") | F.col("has_clip"))
    ks = list(font_keys)
    # a font's properties go to the distinct names, so that spans are joined once
    known = _first(_names(shown, ks), fonts, ks).join(fonts.select(*ks, "font_id", "embedded", "encoding", "font_type"), [*ks, "font_id"], "left")
    j = clip_of(shown, real).join(known, [*ks, "font"], "left")
    name = F.coalesce("font_name", "font")
    font = F.struct(
        F.col("embedded"), F.col("encoding"), tx.font_family(name).alias("family_name"), name.alias("name"), F.col("font_type"), F.lit(None).cast("boolean").alias("monospaced"), tx.is_subset_font(name).alias("subset")
    )
    path = F.format_string("//Document/P[%d]/StyleSpan", F.col("page_ix").cast("int"))
    return j.select("doc_id", "page_ix", "span_index", path.alias("path"), F.trim("text").alias("text"), font.alias("font"), "has_clip", F.col("size").alias("text_size"), "line_height", "x0", "y0", "x1", "y1")
