"""Corpus pipeline: toxicity, quality, line dedup, near-dedup and packing of ``documents``.

Every stage takes ``(spark, docs, sf_dir)``.  The filters keep the columns of
documents; the last stage returns where each piece of the packed corpus lies.
``run`` writes each stage as Parquet into the shared folder and reads it again,
so a lost executor never costs more than one stage's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import line_dedup, packing, quality, simhash, toxicity
from quillspark.llm.common import materialize, table, unused


#: A line is boilerplate on more than one in twenty of its source's documents, whatever their number.
LINE_RATIO = 0.05
#: Fewest documents that make a line more than a document and its copy.
LINE_PAGES = 3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; null and empty texts stay, repeated rows are judged alike."""
    judged = unused(docs, "toxicity")
    found = toxicity.score_toxicity(docs, toxicity.trained_model(spark, sf_dir), out_col=judged)
    return found.where(F.col(f"{judged}.predicted") == 0).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are well written, by the tail probability of their grade.

    Null and empty texts have no features and are judged by the thresholds alone;
    repeated rows are judged alike.
    """
    judged = unused(docs, "quality")
    graded = quality.grade_quality(docs, quality.trained_model(spark, sf_dir), out_col=judged)
    return graded.where(quality.is_kept(judged)).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; ``n_chars`` follows the text.

    Null texts stay null, and repeated rows are documents of their own.
    """
    dropped = unused(docs, "lines_dropped")
    cleaned = line_dedup.drop_boilerplate(docs, F.col("source"), ratio=LINE_RATIO, min_pages=LINE_PAGES, count_col=dropped)
    if "n_chars" in docs.columns:
        changed = F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        cleaned = cleaned.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return cleaned.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8), that with the smallest id.

    A group none of whose rows has an id keeps one of them.  Rows that share an
    id but not the text are told apart; rows alike in both count once.
    """
    groups = materialize(simhash.similar_documents(docs.select("doc_id", "text")), "near-copies")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    row = unused(docs, "row_hash")
    kept = groups.groupBy("root").agg(first["row"].alias(row))
    rows = docs.withColumn(row, simhash.row_hash("doc_id", "text"))
    return rows.join(kept, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and place in it.

    Null and empty texts are the end token alone; repeated rows are packed each; an
    empty table gives no rows; other columns aren't passed on.
    """
    import public_tokenizers

    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("line dedup", drop_boilerplate),
    ("simhash near-dedup", drop_near_copies),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express the learnt and tokenised stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
