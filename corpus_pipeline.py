"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept,
and returns a DataFrame that is written as Parquet and read again for the next.  All
but the last return the columns of ``documents``.

1. quality: documents that the classifier scores below its threshold go
2. exact copies: of equal texts the one with the smallest id stays
3. near copies: of documents linked by five-word shingles at 0.8 the smallest id stays
4. personal data: spans are replaced by the name of their kind
5. packing: what is left, in sequences of 2048 token ids: a row for each piece of a
   document with its ids, its sequence and its offset there (``packing.sequences`` joins them)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import exact_dedup, jaccard_join, packing, pii, quality
from keelson.llm._common import rows_without, settle, settle_alone
from keelson.llm.queries import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores at least the threshold, all columns as they were.

    Each row is judged by its text alone, whatever its id: null and empty texts score as
    texts without words, repeated rows alike.  Labels of ids not in ``docs`` teach
    nothing; without positives or unlabelled rows every row stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    return quality.scored(docs, model, score_col="__score").filter(F.col("__score") >= quality.THRESHOLD).drop("__score")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (white space normalised, null as empty) one with the smallest id.

    Rows of a null id can't be named and stay; of rows equal in id and text one stays,
    of rows equal in id alone each that has the smallest id of its text.
    """
    return exact_dedup.drop_copies(docs, settle(exact_dedup.exact_dedup(docs), "verdict"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked directly or over others the one with the smallest id.

    Groups of large sets are chosen by ``EXPECTED``, so a link just at the bar is missed
    with a chance of about e**-30: counting at 0.8 sends too many signatures to common passages.

    Texts without words link with nothing and stay, rows of a null id stay.  Rows that
    share an id are one document: its rows stay if one of their texts is the group's least.
    """
    near = settle(jaccard_join.jaccard_components(docs, k=5, num=80, den=100, exact=False), "near")
    verdict = near.filter("doc_id is not null").groupBy("doc_id").agg(F.min((F.col("doc_id") != F.col("component_id")).cast("int")).alias("linked"))
    gone = settle(verdict.filter("linked = 1").select("doc_id"), "near-gone")
    return rows_without(docs, "doc_id", gone).select(*docs.columns)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; spans become the name of their kind and ``n_chars`` follows (0 for a null text, which stays null)."""
    return pii.redacted(docs).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row's ids, with its ids and its place in a sequence; a null text has its end id alone."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("exact_copies", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("personal_data", remove_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on its way is deleted when its rows are settled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, the linking or the packing; tests hold them against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
