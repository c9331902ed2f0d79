"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveloom.llm.common import materialize

#: One run of these characters counts as one space.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def signatures(df: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    """(id, n_bytes, prefix_hash, digest) per row: one scan of the texts, no shuffle. The text itself
    never moves; what follows reads only the columns that its step needs."""
    norm = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return norm.select(
        "id",
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64(F.substring("norm", 1, prefix)).alias("prefix_hash"),
        F.unhex(F.sha2("norm", 256)).alias("digest"),
    )


def refine(sig: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of every group of two or more. Each step drops the rows that its
    key shows to be alone, so full digests are grouped only for rows whose length and prefix agree with
    another row's. All groupings are counted map-side first: a hot group is one row per task."""
    several = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same_length = sig.join(several(sig, "n_bytes"), ["n_bytes"], "left_semi")
    same_prefix = same_length.join(several(same_length, "n_bytes", "prefix_hash"), ["n_bytes", "prefix_hash"], "left_semi")
    return (
        same_prefix.groupBy("digest")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of blanks is replaced by one space; null counts as
    empty. Of equal texts the smallest id stays. Rows that repeat id and text are each returned, with
    the same keep_id, and count in group_size; where the smallest id is repeated, all its rows say kept.
    A null id stays only in a group without other ids (keep_id is then null). Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    sig = materialize(signatures(df, id_col, text_col, prefix), "exact-signatures")
    return (
        sig.join(refine(sig), ["digest"], "left")
        .select(
            F.col("id").alias(id_col),
            F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
        .select(id_col, "keep_id", "group_size", "kept", "text_sha256")
    )
