"""Corpus pipeline: documents in, packed training sequences out.

Stages, each over all rows its predecessor kept: language identification (documents of no recognisable language go), line
dedup per source, near-dedup (the smallest id of each group stays), benchmark decontamination (documents with a window that
matches a benchmark item go) and packing. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm import crf_language, decontaminate, line_dedup, packing, setsketch
from isobar.llm.common import fresh, materialize, read_table

#: A document stays if its language has at least this mean posterior; a text mixed of two languages in equal parts has 0.5.
LEAST_LANGUAGE_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without words and those in which no language reaches LEAST_LANGUAGE_SCORE. Rows are judged one by one."""
    return crf_language.recognised(docs, crf_language.learn_folds(docs), LEAST_LANGUAGE_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's boilerplate lines out of its documents; n_chars follows the text."""
    before, after, copy = fresh(docs, "lines_before", "lines_after", "is_copy")
    out = line_dedup.drop_boilerplate(docs, lines_in=before, lines_out=after, copy=copy)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Where ids repeat or are missing, rows are told apart by a number of their own: of a group's rows the one with the
    smallest id stays (no id comes last), of several with that id the first. Empty texts are no duplicates and stay.
    """
    if setsketch.distinct_ids(docs):
        kept = setsketch.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id"))
        return docs.join(kept, docs["doc_id"] == kept["_kept_id"], "left_semi")
    rows = setsketch.rows_with_components(docs)
    first = rows.groupBy("_component").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))).alias("first")).select(F.col("first._row").alias("_kept_row"))
    return rows.join(first, rows["_row"] == first["_kept_row"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that matches a benchmark item go. Rows are judged one by one."""
    return decontaminate.uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", sequences)]

#: SQL can't express the language model, the sketches and the packing; tests hold these stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
