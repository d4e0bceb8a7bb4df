"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import materialize, tree_merge

#: What the normal form deletes (space and U+0009 to U+000D).
BLANKS = " \t\n\x0b\x0c\r"


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after the blanks are deleted. Of equal texts the row with the most code
    points stays, and of those the smallest id. Every row makes a thin entry (SHA-256, a second hash, the length and
    the id); the entries form sorted runs that ``tree_merge`` joins in rounds of ``fan_in``. An entry joins a group only
    if digest, second hash and length all agree, so each level verifies what it merges.

    A null text counts as empty, so all null, empty and blank texts are one group. Null ids sort last and group like
    others. Rows that repeat an id and a text share one decision (kept is true for each of them). Other columns are not
    read, whatever their names. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = df.select(F.col(id_col).alias("__id"), text.alias("__text")).select(
        "__id", F.length("__text").alias("__points"), F.translate("__text", BLANKS, "").alias("__norm")
    )
    thin = materialize(
        thin.select(
            "__id",
            "__points",
            F.unhex(F.sha2("__norm", 256)).alias("__sha"),
            F.xxhash64("__norm").alias("__second"),
            F.octet_length("__norm").alias("__bytes"),
        ),
        "digests",
    )
    best = [-F.col("__points"), F.col("__id").isNull(), F.col("__id")]
    done = tree_merge(thin, ["__sha", "__second", "__bytes"], best, "__id", fan_in)
    return done.select(
        F.col("__id").alias(id_col),
        F.col("best.b2").alias("keep_id"),
        "group_size",
        F.col("__id").eqNullSafe(F.col("best.b2")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_dedup`` of all documents: doc_id, keep_id, group_size, kept, text_sha256. Nulls, blank texts, ties, repeated rows
    and empty tables as stated there."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
