"""The corpus pipeline: quality, near duplicates, repeated passages, mixture, tokens.

Each stage takes all that the one before kept and returns the columns of
documents, the last one tokens. The caller writes each result and reads it
again; run() does so in the shared folder.

In all stages but the last, columns beside those of documents are left out.
An empty table stays empty. Long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, common, jaccard, mixing, quality, repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Expected share of the tokens that the mixture keeps.
KEPT = 0.9


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as empty ones, rows with a null or shared
    doc_id as any other, so repeated rows share their fate.
    """
    return quality.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, that with the least id.

    A document is its id and text. Null ids come last, equal ids go by a hash
    of the text, and of rows with equal id and text one stays. Texts without
    words all stay.
    """
    members, _ = jaccard.jaccard_join(docs)
    each = members.where("n_shingles > 0").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("many"))
    each = common.written(each, "members")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = each.groupBy("component").agg(F.min(rank).alias("first"))
    each = each.join(first, "component").select("doc_id", "text_hash", "many", (rank == F.col("first")).alias("stays"))
    others = each.where("not stays or many > 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "stays")
    rows = docs.select(*COLUMNS).withColumn("text_hash", jaccard.text_hash("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    rest = rows.join(others, same, "left_anti").select(*COLUMNS)
    repeated = rows.join(others.where("stays"), same, "left_semi").groupBy("doc_id", "text_hash")
    return rest.union(repeated.agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred before are cut out; documents without any other text go.

    Null and empty texts stay as they are. Null ids come last; rows equal in
    doc_id and text are one document and have one result.
    """
    return repeats.cleaned_documents(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of KEPT of the tokens, weighted towards the targets of source, language and topic; every category keeps a part.

    Rows whose source or lang is null or has no target are a category of their
    own; texts without words share their cell's weight; equal ids, null ones
    too, share their fate.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS), keep=KEPT, others=True).where("sampled").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, and checksums of the ids and of what they decode to. Null and empty texts have no tokens; every row stays."""
    vocabulary = bpe.load_vocabulary(bpe.vocabulary_path())
    coded = bpe.encode_and_decode(docs.select("doc_id", "text", "lang", "source"), vocabulary)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
