"""Toxicity: a classifier whose score may not depend on which group a text names.

Each labelled text that mentions an identity term is copied with its terms
swapped for others, and training penalises the difference of the two scores, so
that a neutral mention of a group isn't taken for toxicity.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import table
from .linear import Features, Ftrl, Model, fitted, held_out, labelled_sample

FOLDS, FOLD, THRESHOLD = 5, 0, 0.5
#: The fit reads at most this many labelled documents; all documents are scored.
MOST_LABELLED = 6000
#: Terms within a group stand in for each other. A parameter of the operator.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "arab"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
)


class Swaps:
    """Counterfactual versions of a text: every identity term replaced by others of its group."""

    def __init__(self, groups=IDENTITY_GROUPS, copies: int = 2):
        self.groups, self.copies = groups, copies
        self.place = {w: (g, k) for g in groups for k, w in enumerate(g)}
        self.term = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, self.place), key=len, reverse=True)) + r")\b", re.IGNORECASE) if self.place else None

    def __call__(self, text: str) -> list[str]:
        if self.term is None or not self.term.search(text):
            return []
        seed, out = zlib.crc32(text.encode("utf-8", "surrogatepass")), []
        for c in range(self.copies):

            def other(m, c=c):
                group, k = self.place[m[0].lower()]
                return group[(k + 1 + (seed + c) % (len(group) - 1)) % len(group)] if len(group) > 1 else m[0]

            out.append(self.term.sub(other, text))
        return out


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, bits: int = 22, epochs: int = 8, seed: int = 13, groups=IDENTITY_GROUPS, strength: float = 1.0) -> Model:
    """Learn ``labels.toxic`` from labelled documents outside the held-out fold."""
    sample, counts = labelled_sample(docs, labels, "toxic", FOLDS, FOLD, most)
    return fitted(sample, counts, Features(bits, prefix=4), Ftrl(bits, alpha=1.0, l1=3.0, l2=0.1), epochs, seed, Swaps(groups), strength)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    A null or empty text gets the score of no words; repeated rows are scored
    each; a text of any length is scored whole; other columns of docs aren't read;
    an empty table gives an empty one.
    """
    scored = docs.select("doc_id", model.column()("text").alias("t"))
    return scored.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), F.col("t.score").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
