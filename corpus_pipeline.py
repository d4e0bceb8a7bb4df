"""A corpus pipeline of five stages: toxicity, exact dedup, near dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: documents with the columns of ``documents``, and the
placements of the pieces for the last one. Every stage works on all that the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import materialize
from cinelake.llm.exact_dedup import BLANKS, exact_dedup
from cinelake.llm.jaccard import jaccard_classes, with_nodes
from cinelake.llm.packing import best_fit_pack, document_pieces
from cinelake.llm.suffix_dedup import repeated_strings
from cinelake.llm.toxicity import drop_toxic, fit_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labels, doesn't predict toxic. Null and blank texts, repeated rows and null
    ids stay if the prior is under a half. No rows give no rows."""
    docs = docs.select(COLUMNS)
    return drop_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (blanks aside) the longest, then the smallest id; repeated rows become one.

    Null, empty and blank texts are equal. A null id sorts last. No rows give no rows.
    """
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha")).distinct()
    own = docs.select(*COLUMNS, F.sha2(F.translate(F.coalesce("text", F.lit("")), BLANKS, ""), 256).alias("sha"))
    met = own["doc_id"].eqNullSafe(kept["k_id"]) & (own["sha"] == kept["k_sha"])
    return own.join(kept, met, "left_semi").dropDuplicates(["doc_id", "sha"]).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that near-duplicate links connect, the one with the smallest id.

    Documents without a word link with nothing and stay. Repeated rows are one; rows that share an id but not a text are
    told apart by their shingle sets. A group of rows without ids keeps one. No rows give no rows.
    """
    docs = docs.select(COLUMNS)
    stay = jaccard_classes(docs).where("kept").select(F.col("doc_id").alias("k_id"), F.col("node").alias("k_node")).distinct()
    stay = materialize(stay, "stay")
    often = materialize(docs.groupBy(F.col("doc_id").alias("r_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "often")
    is_often, stays = F.col("doc_id").eqNullSafe(F.col("r_id")), F.col("doc_id").eqNullSafe(F.col("k_id"))
    once = docs.join(often, is_often, "left_anti").join(stay, stays, "left_semi")
    several = with_nodes(docs.join(often, is_often, "left_semi")).join(stay, stays & (F.col("node") == F.col("k_node")), "left_semi")
    return once.unionByName(several.dropDuplicates(["doc_id", "node"]).select(COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 50 and more that a document with a smaller id holds; n_chars is counted again.

    Null texts become empty ones. Rows with a null id lose nothing; rows that repeat an id lose nothing to each other. No
    row is dropped, also none whose text is all repeated. No rows give no rows.
    """
    cut = repeated_strings(docs.select(COLUMNS), output="text", carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of at most 4096 ids.

    Null and empty texts are a piece of the end id alone; repeated rows and null ids have pieces of their own. No rows give
    no pieces.
    """
    return best_fit_pack(materialize(document_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "cut"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("jaccard", near), ("suffix_dedup", passages), ("packing", packing)]

#: Toxicity, repeated passages and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
