"""The corpus pipeline: five stages, each applied to what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Whoever runs it writes each stage's result
as Parquet and reads it again as the next one's docs; :func:`run` does so in the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locarium.llm.base import Scratch, table
from locarium.llm.bpe import encoded
from locarium.llm.minhash import near_duplicates, row_key
from locarium.llm.mixing import Mix, mixed_documents
from locarium.llm.quality import THRESHOLD, train_quality
from locarium.llm.secret_scan import redact, secret_spans

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A tenth of the tokens is left out, so that no source weighs more than its siblings need.
MIX = Mix(num=9, den=10, max_epochs=1, seed=23)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; with no labelled document, all of them. A null or empty text gets the
    score of no words; repeated rows are judged each."""
    labels = table(spark, sf_dir, "labels")
    if not labels.where("quality is not null and doc_id is not null").take(1):
        return docs.select(*COLUMNS)
    model = train_quality(docs, labels)
    return docs.select(*COLUMNS, model.column()("text").alias("_q")).where(F.col("_q.score") >= THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; where several rows
    of the group have it, the smallest text stays. Rows of one id in different groups are told
    apart, and rows without an id stay."""
    gone = near_duplicates(docs, width=5, keys=True).where("doc_id is not null").groupBy("doc_id", "component")
    gone = gone.agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows"), F.collect_set("key").alias("keys")).where("not kept or rows > 1")
    gone = Scratch(spark, "dedup").keep(gone.select("doc_id", "component", "kept", F.explode("keys").alias("key")))
    few = gone.count() <= 1_000_000  # ids to send; beyond that, a shuffle
    drop = gone.where("not kept").select("doc_id", "key")
    rows = docs.select(*COLUMNS, row_key().alias("key"))
    kept = rows.join(F.broadcast(drop) if few else drop, ["doc_id", "key"], "left_anti")
    again = gone.where("kept").select("doc_id", "key", "component")
    if not again.take(1):
        return kept.select(*COLUMNS)
    again = F.broadcast(again) if few else again
    one = kept.join(again, ["doc_id", "key"]).groupBy("doc_id", "component").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return kept.join(again, ["doc_id", "key"], "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by the name of its kind; n_chars follows. A null text stays null,
    repeated rows stay."""
    found = docs.select(*COLUMNS, secret_spans()("text").alias("_s"))
    clean = found.withColumn("text", redact(F.col("text"), F.col("_s")))
    return clean.withColumn("n_chars", F.when(F.size("_s.kinds") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the words: larger domains, languages and sources are cut towards equal weights, none is repeated.
    Null languages and sources are the blank ones; repeated rows are drawn together."""
    return mixed_documents(docs.select(*COLUMNS), MIX)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every document, with count and digests; none for a null or empty
    text. As in all stages, other columns than those of documents aren't read, texts are taken whole, and an empty
    table gives an empty one."""
    return docs.select("doc_id", "lang", "source", encoded(with_ids=True)("text").alias("t")).select("doc_id", "lang", "source", "t.*")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]
#: The classifier and the encoding can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, kept = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = kept.keep(docs)
            kept.only(docs)
    return docs
