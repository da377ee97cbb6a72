"""From raw documents to packed training sequences: language ID, line dedup, n-gram Jaccard join, decontamination, packing.

Every row of documents is decided on its own, by its doc_id and text: rows that repeat a doc_id with another text are documents of
their own, and rows without one are too. They come after all others in the order of ids, and stay null in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.llm import decontamination, jaccard, language, lines, packing, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL: an id above 2 ** 62, from the text, where there is none.
OWN_ID = f"coalesce(cast(doc_id as long), xxhash64(text, 'no id') & {2**62 - 1}L | {2**62}L)"


def _known(docs: DataFrame) -> DataFrame:
    """The columns of documents with an id in every row; _id is the row's own one, _row the hash of its text."""
    return docs.select(*COLUMNS).select(F.expr(OWN_ID).alias("doc_id"), *COLUMNS[1:], F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_row"))


def _documents(known: DataFrame) -> DataFrame:
    return known.select(F.col("_id").alias("doc_id"), *COLUMNS[1:])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, as lang; null texts and those without a letter go, and all where no document is labelled.

    Null and repeated ids don't matter. Other columns than those of documents go, here and in all stages. No rows give no rows.
    """
    scratch.lean(spark)
    found = language.identify(docs.select(*COLUMNS), language.fit(docs)).where(F.col("lang_pred") != language.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one matches; a document that loses all its words goes, one that had none stays.

    Rows with a repeated doc_id are in order of their texts' hashes; rows that are wholly equal keep the same lines. n_chars follows.
    """
    out = lines.dedup_lines(_known(docs))
    out = out.where(r"n_removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    return _documents(out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, of equal ones with the least hash of its text.

    Of rows that are wholly equal one stays. Documents without words, or with a null text, are in no group and stay.
    """
    known = _known(docs)
    found = jaccard.jaccard_groups(known)
    rows = found.groupBy("component", "component_id", F.struct("doc_id", "row").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    first = rows.where("component is not null").groupBy("component").agg(F.min(F.struct("x", "n")).alias("f")).select("f.x.doc_id", F.col("f.x.row").alias("_row"), "f.n")
    first = scratch.stored(first.unionByName(rows.where("component is null").select("x.doc_id", F.col("x.row").alias("_row"), F.lit(1).cast("long").alias("n")).distinct()), "kept")
    out = _documents(known.join(first.where("n = 1"), ["doc_id", "_row"], "left_semi"))
    again = first.where("n > 1")
    if not again.isEmpty():
        out = out.unionByName(_documents(known.join(again, ["doc_id", "_row"], "left_semi").dropDuplicates(["doc_id", "_row"])))
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in passages of the benchmark. Null texts and those without words stay."""
    known = _known(docs)
    hit = decontamination.judged(known, scratch.table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", F.col("row").alias("_row")).distinct()
    return _documents(known.join(hit, ["doc_id", "_row"], "left_anti"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is its end id; no rows give no pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", decontaminate),
    ("best_fit_packing", pack),
]
#: Language models and packing aren't expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again; the tables of stages before the last are deleted once the next is written."""
    out = scratch.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, out = out, scratch.stored(stage(spark, out, sf_dir), name)
        scratch.forget(before)
    return STAGES[-1][1](spark, out, sf_dir)
