"""A corpus pipeline: quality filter, exact dedup, near-duplicate join, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet to the shared
checkpoint folder and rereads it as the next stage's docs. All stages but the last return the columns of documents.
The duplicate stages keep one whole row of each group, whatever the doc_ids: ids may repeat, be null or name several
texts. Both compare whole texts; a group's row is the one with the smallest doc_id, null ids last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm.bpe import bpe
from tabvet.llm.common import SPACES, read, text_or_empty
from tabvet.llm.exact_dedup import exact_dedup
from tabvet.llm.jaccard_join import jaccard_components
from tabvet.llm.mix import mix_texts
from tabvet.llm.quality import keep_good
from tabvet.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text, the one row with the smallest doc_id (null ids last).

    Exact dedup gives its verdict on every row, named by doc_id and a row number. Ties go to a text that its normalised
    form equals, then to the smaller other values."""
    numbered = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    found = exact_dedup(numbered.select(name.alias("doc_id"), "text")).where("not kept")
    tied = F.col("doc_id.doc_id").eqNullSafe(F.col("keep_id.doc_id"))
    dropped = materialize(found.select("doc_id.row", F.col("keep_id.row").alias("kept"), tied.alias("tied")))
    return numbered.join(without_ties(numbered, dropped), "row", "left_anti").select(*COLUMNS)


def without_ties(numbered: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows to drop where rows with the id of the kept row (tied) may have the smaller values: row."""
    tied = dropped.where("tied").select("row", "kept")
    if tied.isEmpty():
        return dropped.select("row")
    raw = ~F.col("text").eqNullSafe(F.regexp_replace(text_or_empty(), SPACES, " "))
    rivals = tied.unionByName(tied.select(F.col("kept").alias("row"), "kept").distinct())
    order = F.struct(raw.alias("raw"), F.when(raw, F.col("text")).alias("text"), *COLUMNS[2:], "row")
    best = numbered.join(rivals, "row").groupBy("kept").agg(F.min(order)["row"].alias("row"))
    swapped = materialize(best.where("row <> kept"))
    return dropped.select("row").join(swapped, "row", "left_anti").unionByName(swapped.select(F.col("kept").alias("row")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that link at 0.75 on five-word shingles, the one row with the smallest doc_id.

    The join works on row numbers given in the order of doc_id, null ids last, so the smallest number of a component
    is the row to stay. Rows without words belong to no component and all stay."""
    numbered = materialize(with_row_numbers(docs.select(*COLUMNS)))
    found = jaccard_components(numbered.select(F.col("row").alias("doc_id"), "text"))
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias("row"))
    return numbered.join(dropped, "row", "left_anti").select(*COLUMNS)


def with_row_numbers(docs: DataFrame) -> DataFrame:
    """docs and row, a different long for each row that follows the order of doc_id, null ids last.

    A sort by range cuts the rows into ordered partitions; the number is the partition and the place in it. Rows of one
    doc_id (or of none) follow the hash of their values, so reruns agree and many of them are not one range."""
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64(*COLUMNS))
    return ordered.withColumn("row", F.monotonically_increasing_id())


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a row for the words of a document that are read once or more, twice or more, ..."""
    return mix_texts(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded text."""
    return bpe(docs, keep_ids=True).drop("decoded")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources", mixed_sources),
    ("BPE encoding and decoding", encoded),
]

#: No stage but exact dedup can be said in SQL: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
