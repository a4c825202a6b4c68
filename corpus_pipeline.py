"""A corpus pipeline of four stages over the documents table.

Toxic documents go; of each group of near-duplicates one stays; passages that a document
with a smaller id holds are cut out; what is left is packed into training sequences. Every
stage takes (spark, docs, folder) and all but the last return documents' columns; ``run``
writes each stage's rows as Parquet and reads them again for the next.

Rows are judged one by one: rows that share an id stay as long as their texts differ. A row
without an id may be toxic or a near copy like any other, is not cut at the third stage, as
it has no place in the order of ids, and is packed with a null doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.llm import packing, shingles, suffixes, toxicity
from plotline.llm.queries import WORD_BPE
from plotline.llm.vocabulary import tokenizer_path
from plotline.session import durable


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity chain does not reject, unchanged."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    columns = docs.columns
    cast = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    return toxicity.kept(cast, labels).select(*columns)


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns as c0, c1, ... by their place, and the name of each wanted column among them.

    Columns are taken by place, so no given column can clash with one that a stage adds.
    """
    places = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*places.values()), places


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The row with the smallest id of each group linked by word 5-gram similarity of 0.75 or more.

    A row without an id comes after all others. Texts without words link with nothing and stay.
    """
    given, at = _renamed(docs)
    keyed = durable(given.withColumn("row", F.monotonically_increasing_id()))
    group = shingles.linked(keyed.select(F.col("row").alias("doc_id"), F.col(at["text"]).alias("text"))).select(
        F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    first = (keyed.select("row", F.col(at["doc_id"]).alias("id")).join(group, "row").groupBy("group")
             .agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select(F.col("first.row").alias("row")))
    return keyed.join(first, "row", "left_semi").drop("row").toDF(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents less the bytes of 50-byte strings that a smaller document holds; n_chars follows the text."""
    given, at = _renamed(docs)
    key, text = at["doc_id"], at["text"]
    rest = [c for c in given.columns if c != text]
    out = suffixes.without_repeats(given.where(F.col(key).isNotNull()).select(
        F.col(key).alias("doc_id"), F.col(text).alias("text"), *rest)).withColumn(text, F.col("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn(at["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*given.columns).unionByName(given.where(F.col(key).isNull())).toDF(*docs.columns)


def into_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The packed pieces of the documents left."""
    return packing.sequences(docs, tokenizer_path(WORD_BPE[0]), end=2, nameless=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("packing", into_sequences),
]

#: A classifier, a similarity join and a tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
