"""Exact deduplication by skew-safe combining.

Texts are equal when identical after each run of ASCII white space becomes one space. Three combining stages, each
grouping by the digest AND the full normalised text:

1. local: the map side of the first aggregate merges equal rows of a partition, so a text that a third of all rows
   share leaves each partition at most once per salt;
2. salted: rows meet by (digest, salt, text), the salt spreading the partial winners of one hot text over tasks;
3. global: the few salt winners of a digest meet and give the row that stays and the group's size.

Members then find their group by digest alone. That is exact because stage 3 counts the different texts under each
digest; only if some digest has several does a second join compare the members' full texts.

Defined results: null text counts as empty; ties and repeated rows (same id, same text) all name the same row to
stay, so each of the repeated rows is marked kept; the smallest id ignores null ids, a group of null ids only has
keep_id null and is kept; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm.common import SPACES, read, text_or_empty
from tabvet.session import materialize

SALTS = 8


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    norm = docs.select("doc_id", F.regexp_replace(text_or_empty(), SPACES, " ").alias("norm"))
    return norm.withColumn("digest", digest(F.col("norm")))


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per different text: digest, norm, keep_id, group_size."""
    salted = (
        normalised(docs, digest)
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    return salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text)."""
    by_digest = materialize(
        groups(docs, digest, salts)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    members = normalised(docs, digest)
    if by_digest.where("texts > 1").isEmpty():  # no digest stands for two texts: the digest alone names the group
        found = members.select("doc_id", "digest", sha256(F.col("norm")).alias("text_sha256")).join(by_digest, "digest")
    else:
        found = (
            members.withColumn("text_sha256", sha256(F.col("norm"))).join(groups(docs, digest, salts), ["digest", "norm"])
        )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
