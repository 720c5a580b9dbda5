"""A corpus pipeline of five stages over `documents`: rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of documents. The lines that line dedup deletes are gone from the texts that later stages see.

Defined results. Columns beside those of documents, also ones whose names differ from theirs in letter case only: left
out by the first stage that meets them. Empty tables: no rows. Texts of any length: judged, cut and packed whole. Null
lang, source, n_chars: kept as they are. What nulls, empty texts, repeated rows and ties come to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from folioscan.llm.common import let, pick, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule keeps.

    Null, empty and blank texts have no words and go. Rows are judged one by one: repeated rows stay or go together, a
    null doc_id makes no difference, and there are no ties.
    """
    return quality_rules.apply_rules(pick(docs, *COLUMNS))


#: Share of its lines with text that must be left of a document that lost lines.
LEAST_LEFT = 0.2


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of lines or runs of lines that have 60 characters or 8 lines; n_chars follows the text.

    A document of which less than a fifth of its lines is left goes: what it says stands elsewhere, and the rest is near
    nothing any more, so that no later stage could tell. A null, empty or blank text has no lines to lose and stays. Of
    repeated rows the first stays. Order, and so which copy is the first: null doc_ids, then ascending doc_id, then the
    text's hash.
    """
    stays = let(F.struct("_n_lines", "_n_removed"), lambda n: (n["_n_removed"] == 0) | (n["_n_lines"] - n["_n_removed"] >= F.greatest(F.lit(1.0), LEAST_LEFT * n["_n_lines"])))
    cut = line_dedup.dedup_lines(pick(docs, *COLUMNS)).filter(stays)
    n_chars = F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id.

    Null and empty texts are equal texts, and so one class; texts without words match equal ones only. A null doc_id
    stays only where its class has no other. Repeated rows: one stays. Different texts of one doc_id may both stay.
    """
    return near_dedup.distinct(pick(docs, *COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item.

    Null and empty texts have no windows and stay. Rows are judged one by one; a null doc_id makes no difference.
    """
    return decontaminate.clean(pick(docs, *COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 ids.

    Null and empty texts are one piece, the end id. Repeated rows and rows with a null doc_id are packed each. Ties
    among pieces are settled as packing says.
    """
    import public_tokenizers

    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Near-duplicate classes are components of a graph and packing is sequential: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
