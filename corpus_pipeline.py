"""The corpus pipeline: five stages over documents, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder of the session (spark.checkpoint.dir) and gives it, read again, to the next. All but the last return the
columns of documents.

1. language: predicts each text's language by the byte network and drops what it rejects: texts without a
   letter (`und`), and texts whose predicted language has a mean probability below LEAST_SCORE. `lang` becomes
   the prediction.
2. lines: deletes later copies of repeated line runs; a document left without words goes.
3. near duplicates: of each group linked by 5-word shingles of similarity 0.8 or more, the smallest doc_id stays.
4. mixing: draws the sources by weights 3, 1, 2, repeating; a document drawn twice comes twice, one drawn in
   part keeps the words drawn.
5. packing: cuts what is left into power-of-two sequences.

An empty table passes every stage as an empty table. Rows that repeat id and text are near duplicates of each
other, so one of them stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm import jaccard, language, lines, mixing, packing
from terralith.llm.common import shared_folder
from terralith.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this mean probability of the best language a text is taken for none of those known.
LEAST_SCORE = 0.3


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = language.fit(docs.filter(~language.held_out(F.col("doc_id"), 5, 0)))
    said = language.classify(_documents(docs), net)
    kept = said.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _documents(kept.withColumn("lang", F.col("lang_pred")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_documents(docs)).filter(F.col("n_lines") > F.col("n_lines_removed"))
    return _documents(kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(jaccard.one_of_each(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(mixing.assemble(_documents(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, TOKENIZER))


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Several stages are beyond SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
