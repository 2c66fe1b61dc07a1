"""The training-corpus pipeline: stages over `documents`, each written as Parquet and read again for the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
What becomes of nulls, empty texts, repeated rows and empty tables is said at each stage; further columns stay until the
last one, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitforge.llm import bpe, decontam, line_dedup, near_dedup, quality
from splitforge.llm.queries import VOCABULARY, table
from splitforge.llm.shared import stored

#: Similarity in percent from which two documents are near duplicates.
SIMILARITY = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score predicts label 1, by the rule ensemble learnt from `labels`.

    The score depends on the text alone, so rows join their verdict by id; rows repeated with one id and other texts
    stay if the best of their texts does, rows without id go. Null and empty texts are scored by their zero statistics;
    an empty table gives no rows, one without labels keeps all rows.
    """
    scores = quality.score_documents(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("doc_id").distinct()
    return docs.join(scores, "doc_id", "left_semi").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier one; a document of which nothing is left goes.

    So do null texts and texts without words. Rows without id keep their texts; rows repeated with one id aren't held
    against one another, and each loses what stands in earlier documents; an empty table gives no rows.
    """
    rows = line_dedup.without_repeats(docs)
    return rows.where("trim(BOTH ' \t\n\r' FROM text) != ''").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates.

    Null texts and texts without words are like nothing and stay; rows repeated with one id stay or go together; rows
    without id go, since no group can be named after them; an empty table gives no rows.
    """
    kept = near_dedup.groups(docs, SIMILARITY).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Null and empty texts hold none and stay, each repeated row is judged by its own text, rows without id stay unless
    theirs holds one; an empty table gives no rows, an empty benchmark keeps all.
    """
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document as digests: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    One row for each row, also repeated ones and those without id; null and empty texts have no tokens; an empty table
    gives no rows.
    """
    return bpe.round_trip(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_passages),
    ("near_dedup", one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("encoding", encode),
]

#: The fitted classifier, the similarity groups and the token ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before it is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
