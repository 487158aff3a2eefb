"""Quality classifier: hashed word n-grams, logistic regression by FTRL, sparse dot products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import table
from .linear import Features, Ftrl, Model, fitted, held_out, labelled_sample

FOLDS, FOLD, THRESHOLD = 4, 2, 0.7
#: The fit reads at most this many labelled documents; all documents are scored.
MOST_LABELLED = 6000


def train_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, bits: int = 22, epochs: int = 4, seed: int = 11) -> Model:
    """Learn ``labels.quality`` from labelled documents outside the held-out fold."""
    sample, counts = labelled_sample(docs, labels, "quality", FOLDS, FOLD, most)
    return fitted(sample, counts, Features(bits), Ftrl(bits, alpha=0.3, l1=1.0, l2=0.1), epochs, seed)


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    A null or empty text gets the score of no words; repeated rows are scored
    each; a text of any length is scored whole; other columns of docs aren't read;
    an empty table gives an empty one.
    """
    scored = docs.select("doc_id", model.column()("text").alias("q"))
    return scored.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), F.col("q.score").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
