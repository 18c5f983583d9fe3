"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents that copy
benchmark items go, secrets are redacted, and what is left is encoded to pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder and
reads them again as the next one's docs. Rows with a null id or text, repeated rows and extra columns pass every stage
under the rules its operator states; an empty table gives an empty result. The last stage puts digests of the pieces in
place of the text and keeps the other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.llm import decontaminate, near_dups, secret_scan, sentencepiece_codec, toxicity
from docgrid.llm._shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier is fitted on the labelled rows of the whole corpus; documents at or over its threshold go."""
    return toxicity.clean(docs, toxicity.fitted(spark, sf_dir))


def drop_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component, the document with the smallest id stays, once; documents without words stay."""
    name = "_dropped_id"  # whatever docs' columns are called, this one is only joined on
    dropped = near_dups.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(dropped, docs["doc_id"].eqNullSafe(dropped[name]), "left_anti")
    # Rows with the id of the kept one: equal rows stay once.
    return kept.dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs, secret_scan.trained(secret_scan.labelled_findings(spark)))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dups", drop_near_dups),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", encode_pieces),
]
#: Likelihoods, alignments and forests are beyond SQL; tests compare each stage's rows with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
