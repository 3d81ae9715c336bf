"""A training corpus from raw documents: five stages, each one of the operators in ``tonelake.llm``.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonelake.llm.mixing import mix_documents, taken_text
from tonelake.llm.packing import pack_documents
from tonelake.llm.quality import fit, score_documents
from tonelake.llm.simhash import near_duplicates
from tonelake.llm.store import written
from tonelake.llm.substrings import substring_dedup
from tonelake.llm.tokens import default_vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows of what it is given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, fit(docs, labels), keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the smallest number (null is the last), then the smallest text hash.

    Only rows of one group replace each other: rows without a number, or with one number and different texts, all stay
    if they are no copies. Of rows with one number and one text that of the least language, source and length stays.
    """
    rows = near_duplicates(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("least"))
    first = rows.select(F.col("least.doc_id").alias("_of"), F.col("least.mark").alias("_kept"))
    marked = docs.select(*COLUMNS).withColumn("_mark", F.xxhash64("text"))
    left = marked.join(first, marked["doc_id"].eqNullSafe(first["_of"]) & (marked["_mark"] == first["_kept"]), "left_semi")
    one = left.groupBy("doc_id", "_mark").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("row"))
    return one.select("doc_id", "row.*").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; a text without any stays as it is."""
    out = substring_dedup(docs, keep=("lang", "source"), whole=True).withColumnRenamed("kept_text", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as the words that the mix takes of it, those taken twice in a second line; documents it takes nothing of go.

    Each of several rows with one number, text and source meets the spans of one of them.
    """
    taken = mix_documents(docs).where("taken > 0")
    taken = taken.select(F.col("doc_id").alias("_of"), "mark", F.col("source").alias("_from"), F.col("nth").alias("_nth"), "spans", "size")
    equal = Window.partitionBy("doc_id", "_mark", "source").orderBy("lang", "n_chars")
    rows = docs.select(*COLUMNS).withColumn("_mark", F.xxhash64("text")).withColumn("_number", F.row_number().over(equal))
    same = rows["doc_id"].eqNullSafe(taken["_of"]) & (rows["_mark"] == taken["mark"]) & rows["source"].eqNullSafe(taken["_from"])
    joined = rows.join(taken, same & (rows["_number"] == taken["_nth"])).select("doc_id", "text", "lang", "source", "spans", "size")

    def cut(batches):
        for b in batches:
            texts = []
            for text, spans, size in zip(b["text"].to_pylist(), b["spans"].to_pylist(), b["size"].to_pylist()):
                whole = len(spans) == 3 and spans[1] - spans[0] == size
                texts.append("\n".join([text] * spans[2]) if whole else taken_text(text, spans))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string()), b["lang"], b["source"]], names=["doc_id", "text", "lang", "source"])

    out = joined.mapInArrow(cut, "doc_id long, text string, lang string, source string")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in the training sequences."""
    packed = pack_documents(docs, default_vocabulary())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", passages),
    ("source mixing", mixture),
    ("best-fit packing", packing),
]

#: No stage but the mixture's targets can be said in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
