"""Exact duplicates by a 128-bit content hash with a comparison of bytes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.runtime import BROADCAST_ROWS, checkpointed, read_table, small_side

from .text import ascii_lower


def content_hash(text: Column) -> Column:
    """128 bits as binary."""
    return F.unhex(F.md5(text))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_of=content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after lower-casing A-Z. Hashes are
    counted first; only texts whose hash occurs twice travel, and those are
    grouped by (hash, bytes): the hash deals them out, the bytes are compared
    within a hash, so a collision gives two groups. Each map task sends one
    row for a text however often it has it, so a hot group stays small in the
    shuffle. Members then meet the groups, which are broadcast if few, else
    by a join that Spark may split where a group is hot.

    keep: "smallest" or "largest" id stays. Null texts are empty texts. Null
    ids count as rows and stay only where a group has no other id. Rows under
    one id and one text share a verdict. Other columns are not read; an empty
    table gives an empty result.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col).alias("id"), text.alias("body"))
    rows = rows.select("id", "body", hash_of(F.col("body")).alias("hash"))
    best = {"smallest": F.min, "largest": F.max}[keep]
    digest = F.unhex(F.sha2("body", 256)).alias("digest")
    twice = checkpointed(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"))
    same = rows.join(small_side(twice), "hash", "left_semi").groupBy("hash", "body").agg(F.count(F.lit(1)).alias("group_size"), best("id").alias("keep_id"))
    groups = checkpointed(same.select("hash", digest, "group_size", "keep_id"))
    members = rows.select("id", "hash", digest).join(small_side(groups, BROADCAST_ROWS // 4), ["hash", "digest"], "left")
    keep_id = F.coalesce("keep_id", "id")
    return members.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_first_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of `df` that stay, with all their columns; rows without an id stay."""
    verdict = exact_dedup(df, id_col, text_col, keep)
    gone = checkpointed(verdict.filter(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__gone")).distinct())
    return df.join(small_side(gone), df[id_col] == F.col("__gone"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""
