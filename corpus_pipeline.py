"""The training-data pipeline over `documents`: five stages, each on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame that is
written as Parquet and reread as the next stage's docs. run() applies them to `documents`.
Rows with a null id pass every stage that decides by id; empty tables pass as empty tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import bpe, decontaminate, language, line_dedup, minhash
from corpusgraph.llm.common import materialize, read, unused


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go."""
    return language.drop_unidentified(docs, language.train(language.training_rows(docs)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the first document that holds them; text and n_chars follow."""
    found = line_dedup.drop_repeated_lines(docs)
    kept = found.columns[-3]
    text = F.when(F.col("text").isNotNull(), F.decode(kept, "UTF-8"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    gone = unused(docs, "_gone")
    found = minhash.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, F.col("doc_id") == F.col(gone), "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of what they decode to."""
    found = bpe.encode_decode(docs)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE", encode),
]

#: Language ID and BPE can't be written in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
