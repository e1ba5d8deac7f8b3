"""A training-corpus pipeline over ``documents``: five stages, each written as a table and read again.

Quality classifier (bad documents go), line dedup within each source, SimHash near-dedup (one document of each group
with similar shingle sets stays), mixing of the sources to target weights, and SentencePiece encoding.

All stages find their columns by exact name, so further ones may clash with them, and pass an empty table on as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from mergrove.llm import common, linededup, mixing, quality, sentencepieces, similar

#: The tokenizer's model file.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; it learns from ``labels`` and the documents given.

    Null and empty texts are scored as empty ones; rows with a null id and repeated rows are scored like any other.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that over a tenth of their source's documents hold.

    Null texts stay null; null sources are one source; repeated rows count each.
    """
    return linededup.line_dedup(docs, "source")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose sets of five-word shingles are 0.8 similar or more.

    Null and empty texts are one group; rows with a null id stay; of rows equal in id and shingles one stays.
    """
    return similar.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order in which the sources mix to the square roots of their sizes.

    Null sources are one source; null ids and texts and repeated rows have places like any other.
    """
    return mixing.in_order(docs, common.parts_for(docs, 32 << 20))


def _placed(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, text, position)``: ``position`` is the row's place from 0 in the files it was read from, one
    after the other; null without files.  What is counted in one place is one row a file."""
    wanted = ("doc_id", "source", "text")
    if not docs.inputFiles():
        return common.take(docs, **{c: c for c in wanted}).withColumn("position", F.lit(None).cast("long"))
    at = [docs.columns.index(c) for c in wanted]
    plain = docs.select("*", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    plain = plain.toDF(*[f"c{i}" for i in range(len(docs.columns))], "file", "at").select(*[F.col(f"c{i}").alias(c) for i, c in zip(at, wanted)], "file", "at")
    before = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    sizes = plain.groupBy(F.col("file").alias("f")).agg(F.count("*").alias("n"))
    starts = sizes.select("f", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return plain.join(F.broadcast(starts), F.col("file") == F.col("f")).select(*wanted, (F.col("start") + F.col("at")).alias("position"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, source, position, n_tokens, ids, ids_sha256, round_trip, parity)`` of every document; sorting by
    ``position`` gives the mixture.

    Null texts have no tokens; null ids and sources stay; repeated rows are encoded each.
    """
    keyed = _placed(docs).select(F.struct("doc_id", "source", "position").alias("doc_id"), "text")
    coded = sentencepieces.encode(keyed, sentencepieces.read_model(MODEL), cache=150_000, chunk=1 << 19)  # a worker holds it in other stages too
    return coded.select("id.doc_id", "id.source", "id.position", "n_tokens", "ids", "ids_sha256", "round_trip", "parity")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL can express neither the classifier nor fingerprints or tokens; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; of the tables in between, only the last stage's input is left for the result to read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = common.made()
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "stage")
        common.clean(spark, first, (docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
