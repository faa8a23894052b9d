"""A training corpus from documents: language ID, line dedup, near-duplicate join, mixing, BPE. Each stage takes
(spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.bpe import encode_documents
from evalspark.llm.common import document_key, source_key
from evalspark.llm.language import UNKNOWN, identify, train
from evalspark.llm.line_dedup import line_dedup
from evalspark.llm.mixing import mix
from evalspark.llm.ngram_join import ngram_groups
from evalspark.llm.queries import word_vocabulary
from evalspark.plans.lineage import cut_lineage, work_folder

LEAST_CHANCE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the network knows: those without a letter, and those whose best language has a chance
    under LEAST_CHANCE, go."""
    told = identify(docs, train(docs))
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_CHANCE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came earlier; a document of which nothing is left goes."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = line_dedup(docs, carry=rest).filter((F.col("n_dropped") == 0) | (F.trim(F.translate("text", "\n", " ")) != ""))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the document with the smallest id, those without an id
    last. Rows are told apart by id and text; of rows that agree in both one stays."""
    keyed = docs.withColumn("__key", document_key())
    groups = ngram_groups(keyed, id_col="__key", words=5, percent=80).select(F.col("doc_id").alias("__key"), "component_id").distinct()
    first = keyed.select("__key", "doc_id").distinct().join(groups, "__key").groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__key")).alias("first"))
    kept = keyed.join(cut_lineage(first.select("first.__key")), "__key", "left_semi")
    return kept.dropDuplicates(["__key"]).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it, 0 to 3."""
    keyed = docs.withColumns({"__key": document_key(), "__source": source_key()})
    copies = mix(keyed, id_col="__key").select(F.col("doc_id").alias("__key"), source_key().alias("__source"), "copies")
    copies = copies.groupBy("__key", "__source").agg(F.max("copies").cast("int").alias("copies")).filter("copies > 0")
    taken = keyed.join(copies, ["__key", "__source"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken."""
    return encode_documents(docs, word_vocabulary()).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixed", mixed), ("encoded", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet beside the checkpoints and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = work_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
