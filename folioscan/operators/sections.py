"""The report of a document, section by section: every section is a table of lines (doc_id, section, rank, line).

Sections know nothing of each other; `assemble` puts a document's lines together with one aggregation and `write_texts`
stores a text file a document. Every section lists at most so many items of a document (SHOWN and the like) and says how
many more there are; the limits are ranks, which Spark applies before the shuffle.

Documents without rows of a kind get the line that says so, from the table of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import slugify
from folioscan.operators import explain, profile

#: Items listed of hidden texts and anomalies, texts of a font, of a property value, of a cluster; clusters; features of each.
SHOWN, FONT_TEXTS, VALUE_TEXTS, CLUSTER_TEXTS, CLUSTERS, FEATURES = 20, 5, 3, 10, 3, 3
#: Standard scores from which a feature is said to be off.
OFF = 2.5
TITLE, KIND, FONTS, PROPERTIES, HIDDEN, ANOMALIES, GROUPS, ADVICE, END = range(9)


def _lines(rows: DataFrame, section: int, rank: Column, line: Column) -> DataFrame:
    """Lines of one section; a null line is none."""
    return rows.select("doc_id", F.lit(section).alias("section"), F.array(*[F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in rank]).alias("rank"), line.alias("line")).filter("line is not null")


def _each(rows: DataFrame, section: int, *lines: Column) -> DataFrame:
    """The same lines for every row of a table of documents, in order, nulls left out."""
    told = rows.select("doc_id", F.posexplode(F.array(*lines)).alias("k", "line"))
    return _lines(told, section, [0, F.col("k")], F.col("line"))


def _percent(c: Column) -> Column:
    """To one place as printf does it, half to even on the exact number; format_string rounds the shortest decimals that stand for it."""
    tenths = F.floor(c * 10)
    above = (c * 16 - (2 * tenths + 1)) + c * 4  # the sign of 20 c less an odd number, both steps exact near a half
    up = F.when((above > 0) | ((above == 0) & (tenths % 2 == 1)), 1).otherwise(0)
    return F.format_string("%.1f", (tenths + up) / 10)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))


def title(documents: DataFrame) -> DataFrame:
    """documents: doc_id and error (null where processing went well)."""
    return _each(documents, TITLE, F.concat(F.lit("# Report on "), F.col("doc_id").cast("string")), F.when(F.col("error").isNotNull(), F.concat(F.lit("Processing failed: "), F.col("error"))))


def kind(documents: DataFrame) -> DataFrame:
    """documents: doc_id, has_text, pipeline, restrictions (array of what isn't allowed, null if unknown)."""
    limits = F.when(F.size("restrictions") > 0, F.concat(F.lit("- Not allowed: "), F.array_join("restrictions", ", "))).when(F.col("restrictions").isNotNull(), "- No restrictions")
    return _each(documents, KIND, F.lit("## Kind of document"), F.when(F.col("has_text"), "- Has a text layer").otherwise("- Scanned, without a text layer"), F.concat(F.lit("- Read by "), F.col("pipeline")), limits)


def fonts(documents: DataFrame, profiled: DataFrame, prop: str = "font_name") -> DataFrame:
    """Fonts that few items have, rarest first, with their texts. profiled: rows of profile.profile whose items hold text."""
    mine = profiled.filter(F.col("prop") == prop)
    odd = mine.filter(profile.is_uncommon()).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "value")))
    texts = F.transform(F.slice("items", 1, FONT_TEXTS), lambda x: F.concat(F.lit("  - "), _quoted(x["text"])))
    more = F.when(F.col("n") > FONT_TEXTS, F.array(F.format_string("  - and %d more", F.col("n") - FONT_TEXTS))).otherwise(F.array().cast("array<string>"))
    told = F.concat(F.array(F.concat(F.lit("### "), F.col("value")), F.format_string("- %d items (%s%%)", F.col("n"), _percent(F.col("pct")))), texts, more)
    listed = odd.select("doc_id", "k", F.posexplode(told).alias("i", "line"))
    counts = mine.groupBy("doc_id").agg(F.count("*").alias("fonts"), F.count_if(profile.is_uncommon()).alias("odd"))
    all_docs = documents.select("doc_id").join(counts, "doc_id", "left")
    head = F.when(F.col("fonts").isNull(), "No data on fonts.").when(F.col("odd") > 0, F.format_string("%d of %d fonts are uncommon:", F.col("odd"), F.col("fonts"))).otherwise(F.format_string("All %d fonts are common.", F.col("fonts")))
    return _each(all_docs, FONTS, F.lit("## Fonts"), head).unionByName(_lines(listed, FONTS, [1, F.col("k"), F.col("i")], F.col("line")))


def properties(documents: DataFrame, profiled: DataFrame) -> DataFrame:
    """Properties with a single value, and for the others the values that few items have."""
    odd = profile.is_uncommon()
    per = profiled.groupBy("doc_id", "prop").agg(F.count("*").alias("values"), F.min("value").alias("only"), F.count_if(odd).alias("odd"))
    same = F.concat(F.lit("- "), F.col("prop"), F.lit(": always "), F.col("only"))
    head = F.when(F.col("values") == 1, same).when(F.col("odd") == 0, F.format_string("- %s: %d values, all common", F.col("prop"), F.col("values"))).otherwise(F.format_string("- %s: %d values, %d uncommon", F.col("prop"), F.col("values"), F.col("odd")))
    ranked = per.withColumn("line", head).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy((F.col("values") > 1).cast("int"), "prop")))
    shown = F.array_join(F.transform(F.slice("items", 1, VALUE_TEXTS), lambda x: _quoted(x["text"])), ", ")
    value = F.format_string("  - %s: %d items (%s%%), such as %s", F.col("value"), F.col("n"), _percent(F.col("pct")), shown)
    some = profiled.filter(odd).withColumn("v", F.row_number().over(Window.partitionBy("doc_id", "prop").orderBy("n", "value"))).select("doc_id", "prop", "v", value.alias("line"))
    below = some.join(ranked.filter("values > 1").select("doc_id", "prop", "k"), ["doc_id", "prop"])
    every = documents.select("doc_id").join(per.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    heads = _each(every, PROPERTIES, F.lit("## Properties of elements"), F.when(F.col("known").isNull(), "No data on properties."))
    return heads.unionByName(_lines(ranked, PROPERTIES, [1, F.col("k"), 0], F.col("line"))).unionByName(_lines(below, PROPERTIES, [1, F.col("k"), F.col("v")], F.col("line")))


def hidden(documents: DataFrame, found: DataFrame, order: tuple[str, ...] = ("page_ix", "cell_index")) -> DataFrame:
    """Texts that one rendering hides. found: doc_id, text, kind and the columns of order."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    first = found.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= SHOWN)
    counts = documents.select("doc_id").join(found.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").fillna(0, ["n"])
    head = F.when(F.col("n") > 0, F.format_string("%d texts are in the file but not in sight:", F.col("n"))).otherwise("No hidden text.")
    lines = _lines(first, HIDDEN, [1, F.col("k")], F.format_string("%d. %s, %s", F.col("k"), _quoted(F.col("text")), F.col("kind")))
    rest = _lines(counts.filter(F.col("n") > SHOWN), HIDDEN, [2], F.format_string("and %d more", F.col("n") - SHOWN))
    return _each(counts, HIDDEN, F.lit("## Hidden text"), head).unionByName(lines).unionByName(rest)


def _off(z: Column, names: Column) -> Column:
    """The features of an item that are off, strongest first, as (score, feature, z)."""
    pairs = F.transform(z, lambda v, i: F.struct((-F.abs(v)).alias("s"), F.get(names, i).alias("feature"), v.alias("z")))
    return F.slice(F.sort_array(F.filter(pairs, lambda p: p["s"] < -OFF)), 1, FEATURES)


def anomalies(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """Items that two or three methods find odd. scored: doc_id, id, text, votes, z (standard scores), names (of the features)."""
    hit = scored.filter("votes >= 2")
    counts = scored.groupBy("doc_id").agg(F.count("*").alias("items"), F.count_if(F.col("votes") >= 2).alias("n"), F.count_if(F.col("votes") == 3).alias("high"))
    every = documents.select("doc_id").join(counts, "doc_id", "left")
    some = F.format_string("%d of %d items (%s%%): %d by all three methods, %d by two", F.col("n"), F.col("items"), _percent(100.0 * F.col("n") / F.col("items")), F.col("high"), F.col("n") - F.col("high"))
    heads = _each(every, ANOMALIES, F.lit("## Anomalies"), F.when(F.col("items").isNull(), "No scores.").when(F.col("n") == 0, "No anomalies.").otherwise(some))
    first = hit.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("votes"), "id"))).filter(F.col("k") <= SHOWN).withColumn("off", _off(F.col("z"), F.col("names")))
    line = F.format_string("%d. [%s] %s", F.col("k"), F.when(F.col("votes") == 3, "HIGH").otherwise("MEDIUM"), _quoted(F.col("text")))
    why = first.select("doc_id", "k", F.posexplode_outer("off").alias("i", "o"))
    told = explain.explain(why.select("doc_id", "k", "i", F.col("o.feature").alias("feature"), F.col("o.z").alias("z")), "feature", F.col("z") > 0)
    reason = F.when(F.col("feature").isNull(), "   - no single feature stands out").otherwise(F.format_string("   - %s (%+.2f): %s", F.col("feature"), F.col("z"), F.coalesce("finding", F.when(F.col("z") > 0, "higher than usual").otherwise("lower than usual"))))
    rest = _lines(every.filter(F.col("n") > SHOWN), ANOMALIES, [2], F.format_string("and %d more", F.col("n") - SHOWN))
    return functools.reduce(DataFrame.unionByName, [heads, _lines(first, ANOMALIES, [1, F.col("k"), 0], line), _lines(told, ANOMALIES, [1, F.col("k"), F.coalesce(F.col("i"), F.lit(0)) + 1], reason), rest])


def groups(documents: DataFrame, clustered: DataFrame) -> DataFrame:
    """The smallest clusters, their texts, and the features that set them apart. clustered: doc_id, id, text, cluster (-1: noise), z, names."""
    sizes = clustered.groupBy("doc_id", "cluster").agg(F.count("*").alias("size"))
    totals = sizes.groupBy("doc_id").agg(F.count_if(F.col("cluster") >= 0).alias("clusters"), F.coalesce(F.sum(F.when(F.col("cluster") < 0, F.col("size"))), F.lit(0)).alias("noise"))
    every = documents.select("doc_id").join(totals, "doc_id", "left")
    heads = _each(every, GROUPS, F.lit("## Smallest clusters"), F.when(F.col("clusters").isNull(), "No clusters.").otherwise(F.format_string("%d clusters, %d items in none", F.col("clusters"), F.col("noise"))))
    small = sizes.filter("cluster >= 0").withColumn("c", F.row_number().over(Window.partitionBy("doc_id").orderBy("size", "cluster"))).filter(F.col("c") <= CLUSTERS)
    named = _lines(small, GROUPS, [1, F.col("c"), 0], F.format_string("### Cluster %d (%d items)", F.col("cluster"), F.col("size")))
    members = clustered.join(small.select("doc_id", "cluster", "c", "size"), ["doc_id", "cluster"])
    first = members.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "cluster").orderBy("id"))).filter(F.col("k") <= CLUSTER_TEXTS)
    texts = _lines(first, GROUPS, [1, F.col("c"), 1, F.col("k")], F.format_string("%d. %s", F.col("k"), _quoted(F.col("text"))))
    more = _lines(small.filter(F.col("size") > CLUSTER_TEXTS), GROUPS, [1, F.col("c"), 2], F.format_string("and %d more items", F.col("size") - CLUSTER_TEXTS))
    long = lambda rows, *keys: rows.select(*keys, F.posexplode(F.arrays_zip("z", "names")).alias("f", "v")).select(*keys, "f", F.col("v.names").alias("feature"), F.col("v.z").alias("z"))
    own = long(members, "doc_id", "c").groupBy("doc_id", "c", "f", "feature").agg(F.avg("z").alias("mean"))
    whole = long(clustered, "doc_id").groupBy("doc_id", "f").agg(F.avg("z").alias("all"))
    apart = own.join(whole, ["doc_id", "f"]).withColumn("d", F.abs(F.col("mean") - F.col("all")))
    w = Window.partitionBy("doc_id", "c")
    share = apart.withColumn("pct", 100.0 * F.col("d") / F.sum("d").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("d"), "f"))).filter(F.col("k") <= FEATURES)
    told = explain.explain(share, "feature", F.col("mean") > 0)
    why = F.format_string("- %s (%s%%), mean %+.2f: %s", F.col("feature"), _percent(F.coalesce("pct", F.lit(0.0))), F.col("mean"), F.coalesce("finding", F.when(F.col("mean") > 0, "higher than usual").otherwise("lower than usual")))
    return functools.reduce(DataFrame.unionByName, [heads, named, texts, more, _lines(told, GROUPS, [1, F.col("c"), 3, F.col("k")], why)])


#: Advice: (name, condition over a document's checks, text).
RULES = (
    ("inverted tables", "inverted_tables > 0", "Some tables have their top below their bottom: see which way their y axis runs."),
    ("no tables", "tables = 0", "No table was found: see if the page has one that the reader missed."),
    ("pictures from below", "pictures_from_below > 0", "Pictures count y from the bottom: flip them before they are drawn."),
    ("no baselines", "baselines = 0", "No alignment baseline was found: see if their detection ran."),
)


def recommendations(checks: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, rank, name, advice) of every rule that a document's checks meet; a null check meets none."""
    met = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(k).alias("rank"), F.lit(n).alias("name"), F.lit(t).alias("advice"))) for k, (n, c, t) in enumerate(rules)]))
    return checks.select("doc_id", F.explode(met).alias("r")).select("doc_id", "r.*")


def advice(checks: DataFrame, rules=RULES) -> DataFrame:
    found = recommendations(checks, rules)
    heads = _each(found.select("doc_id").distinct(), ADVICE, F.lit("## Recommendations"))
    return heads.unionByName(_lines(found, ADVICE, [1, F.col("rank")], F.concat(F.lit("- "), F.col("advice"))))


def end(documents: DataFrame) -> DataFrame:
    return _each(documents, END, F.lit("---"), F.lit("End of report"))


def assemble(*sections: DataFrame) -> DataFrame:
    """(doc_id, n_lines, report): a document's lines in order of section and rank, put together in one aggregation."""
    lines = functools.reduce(DataFrame.unionByName, sections)
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.expr("listagg(line, '\\n') within group (order by section, rank)").alias("report"))


def write_texts(reports: DataFrame, path: str) -> None:
    """A folder a document, named by its slug, with one text file; names that the slug changes get the CRC-32 of the whole name."""
    name = F.col("doc_id").cast("string")
    slug = slugify(name)
    kept = F.when(slug == name, name).otherwise(F.concat(slug, F.lit("-"), F.lower(F.hex(F.crc32(name.cast("binary"))))))
    reports.select(kept.alias("document"), F.col("report").alias("value")).repartition("document").write.mode("overwrite").partitionBy("document").text(path)


def _word(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def logic(records: DataFrame) -> DataFrame:
    """(doc_id, report): one JSON a document, from records of seven kinds (doc_id, page_ix, seq, kind, name, body as JSON).

    kind payload (name: the payload's, body: its path) and note (body) belong to the document. overview (an object whose
    fields are added, later ones win), baselines and text_blocks (name: the stage, the last one wins), colon_spacing (the
    last one wins), event (name: its category) and highlight (name: its type) belong to a page; events and highlights
    stay in order of seq.
    """
    r = records.withColumn("v", F.try_parse_json("body"))
    last = F.max_by("v", "seq").alias("v")
    entries = lambda rows, keys, out: rows.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.to_json("v").alias("v"))))).alias(out))
    page = ["doc_id", "page_ix"]
    fields = r.filter("kind = 'overview'").select(*page, "seq", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("name", "v"))
    parts = [entries(fields.groupBy(*page, "name").agg(last), page, "overview")]
    parts += [entries(r.filter(F.col("kind") == k).groupBy(*page, "name").agg(last), page, k) for k in ("baselines", "text_blocks")]
    parts.append(r.filter("kind = 'colon_spacing'").groupBy(*page).agg(F.to_json(F.max_by("v", "seq")).alias("colon_spacing")))
    for k, label, out in (("highlight", "type", "highlighted_items"), ("event", "category", "events")):
        one = F.concat(F.lit(f'{{"{label}":'), _word(F.col("name")), F.when(F.length(F.to_json("v")) > 2, F.concat(F.lit(","), F.substr(F.to_json("v"), F.lit(2)))).otherwise("}"))
        parts.append(r.filter(F.col("kind") == k).groupBy(*page).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", one.alias("j")))), lambda x: x["j"]).alias(out)))
    pages = r.filter("page_ix is not null").select(*page).distinct()
    for p in parts:
        pages = pages.join(p, page, "left")
    obj = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(F.coalesce(c, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), lambda e: F.concat(_word(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ","), F.lit("]"))
    body = F.concat(
        F.lit('{"overview":'), obj("overview"), F.lit(',"baselines":'), obj("baselines"), F.lit(',"text_blocks":'), obj("text_blocks"), F.lit(',"colon_spacing":'), F.coalesce("colon_spacing", F.lit("{}")),
        F.lit(',"highlighted_items":'), listed("highlighted_items"), F.lit(',"events":'), listed("events"), F.lit("}"),
    )
    by_doc = pages.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("page_ix").cast("string").alias("k"), body.alias("v"))))).alias("pages"))
    payloads = entries(r.filter("kind = 'payload'").groupBy("doc_id", "name").agg(last), ["doc_id"], "payloads")
    notes = r.filter("kind = 'note'").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.to_json("v").alias("j")))), lambda x: x["j"]).alias("notes"))
    docs = r.select("doc_id").distinct().join(payloads, "doc_id", "left").join(by_doc, "doc_id", "left").join(notes, "doc_id", "left")
    label = _word(F.col("doc_id").cast("string"))
    whole = F.concat(F.lit('{"document":{"label":'), label, F.lit(',"payloads":'), obj("payloads"), F.lit('},"pages":'), obj("pages"), F.lit(',"notes":'), listed("notes"), F.lit("}"))
    return docs.select("doc_id", whole.alias("report"))
