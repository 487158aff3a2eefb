"""Mixing sources to target weights over a domain - language - source tree.

Budgets go down the tree: each node shares its tokens among its children by
weight; a child can take ``max_epochs`` times its supply at most, and what it can't
take goes to its siblings first. Only if all of them are full does the parent
take less, which its own siblings make up for. A leaf's budget buys whole seeded
epochs and then the longest prefix of one more, in the order of a hash of seed,
epoch and id.

The prefix is found without sorting a leaf: tokens are summed by the hash's first
digits, and only the rows of the one bucket where the budget ends are ordered.
What results is one row for each leaf; whether a document is in is then decided
row by row, without a shuffle of texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, table

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Weights by name for each level (others count ``other``); tokens to draw as a
    share of the supply, num / den; 0 excludes a node."""

    domain: dict[str, int] = field(default_factory=dict)
    lang: dict[str, int] = field(default_factory=dict)
    source: dict[str, int] = field(default_factory=dict)
    other: int = 1
    num: int = 1
    den: int = 1
    max_epochs: int = 4
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The standard taxonomy: sources fall to three domains by the number in their name."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.concat(F.lit("d"), (F.coalesce(number.try_cast("long"), F.lit(0)) % 3).cast("string"))


def words(text: Column) -> Column:
    """How many words stand between ASCII white space; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(mix.other)
    for name, weight in getattr(mix, level).items():
        out = F.when(F.col(level) == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def _shared(nodes: DataFrame, over: list[str], level: str, mix: Mix) -> DataFrame:
    """Add ``budget`` to the children ``nodes`` of parents with column ``given``.

    Children in order of capacity for their weight fill up first; the rest share what is left.
    """
    nodes = nodes.withColumn("w", _weight(level, mix)).withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0)))
    by = Window.partitionBy(*over) if over else Window.partitionBy(F.lit(1))
    order = by.orderBy(F.col("cap").cast("double") / F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit(1)), level)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    wide = lambda c, n: c.cast(f"decimal({n},0)")
    full = wide(F.col("cap"), 20) * wide(rest, 17) <= wide(F.col("w"), 17) * wide(F.col("given") - before, 20)
    nodes = nodes.withColumn("full", full)
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(by)
    open_w = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(by)
    nodes = nodes.withColumn("left", F.col("given") - taken).withColumn("open_w", open_w)
    share = F.expr("cast(w as decimal(17,0)) * cast(left as decimal(20,0)) div cast(open_w as decimal(17,0))")
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("cap")).when(F.col("w") > 0, share).otherwise(F.lit(0)).cast("long")).drop("w", "full", "left", "open_w", "given")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, supply -> budget, by water filling from the root down."""
    leaves = leaves.withColumn("cap", F.col("supply") * mix.max_epochs)
    given = leaves.agg(F.expr(f"cast(coalesce(sum(supply), 0) as decimal(20,0)) * {mix.num} div {mix.den}").alias("given"))
    nodes = leaves.groupBy("domain").agg(F.sum(F.when((_weight("lang", mix) > 0) & (_weight("source", mix) > 0), F.col("cap")).otherwise(0)).alias("cap"))
    level = _shared(nodes.join(F.broadcast(given)), [], "domain", mix)
    nodes = leaves.groupBy("domain", "lang").agg(F.sum(F.when(_weight("source", mix) > 0, F.col("cap")).otherwise(0)).alias("cap"))
    level = _shared(nodes.join(level.select("domain", F.col("budget").alias("given")), "domain"), ["domain"], "lang", mix)
    return _shared(leaves.join(level.select("domain", "lang", F.col("budget").alias("given")), ["domain", "lang"]), ["domain", "lang"], "source", mix)


def _order(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _leaf_columns(docs: DataFrame, domain, tokens) -> DataFrame:
    """docs with domain, lang and source (blank for null) and the token count, under names of our own."""
    return docs.select(F.col("doc_id"), domain(F.coalesce("source", F.lit(""))).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), tokens(F.col("text")).alias("n_tokens"))


def plan_mix(rows: DataFrame, mix: Mix, scratch: Scratch, digits: int | None = None) -> DataFrame:
    """A row for each leaf: ``epochs`` whole epochs, then all buckets before ``cut`` and, in it,
    the rows whose hash is up to last_hash. ``rows``: doc_id, LEVELS, n_tokens.

    A bucket is the first ``digits`` hex digits of the hash; without a number, as many as give the
    largest leaf about as many buckets as rows in each, so that neither is ordered in one
    task beyond the square root of its rows (within a factor of four).
    """
    leaves = scratch.keep(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("rows")))
    if digits is None:
        digits = max(1, round(math.log(leaves.agg(F.max("rows")).first()[0] or 1, 256)))
    plan = leaf_budgets(leaves, mix)
    whole = F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(F.lit(0)).cast("int")
    plan = scratch.keep(plan.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply")).select(*LEVELS, "budget", "epochs", "rest"))
    hashed = _joined(rows, plan.where("rest > 0")).withColumn("hash", _order(F.col("epochs"), mix.seed)).withColumn("bucket", F.substring("hash", 1, digits))
    sums = hashed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket")) - F.col("n")
    cut = sums.withColumn("before", before).where("before <= rest").groupBy(*LEVELS).agg(F.max(F.struct("bucket", "before")).alias("c")).select(*LEVELS, F.col("c.bucket").alias("cut"), F.col("c.before").alias("before"))
    plan = scratch.keep(plan.join(cut, list(LEVELS), "left"))
    edge = _joined(rows, plan.where("rest > 0")).withColumn("hash", _order(F.col("epochs"), mix.seed)).where(F.substring("hash", 1, digits) == F.col("cut"))
    upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("hash", "doc_id"))
    last = edge.withColumn("upto", upto).where("upto <= rest").groupBy(*LEVELS).agg(F.max(F.struct("hash", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))).alias("l"))
    return scratch.keep(plan.join(last.select(*LEVELS, F.col("l.hash").alias("last_hash")), list(LEVELS), "left"))


def _joined(rows: DataFrame, plan: DataFrame, most_sent: int = 50_000) -> DataFrame:
    """Rows with their leaf's plan: sent to all executors if it is small, else by a shuffle."""
    return rows.join(F.broadcast(plan) if plan.count() <= most_sent else plan, list(LEVELS))


def _chosen(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row for each epoch in which a row of the plan is drawn."""
    hashed = _order(F.col("epochs"), mix.seed)
    bucket = F.substring(hashed, F.lit(1), F.length("cut"))
    partial = (F.col("rest") > 0) & ((bucket < F.col("cut")) | ((bucket == F.col("cut")) & F.coalesce(hashed <= F.col("last_hash"), F.lit(False))))
    times = F.col("epochs") + F.coalesce(partial, F.lit(False)).cast("int")
    return rows.withColumn("times", times).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))


def mixed(docs: DataFrame, mix: Mix, domain=domain_of, tokens=words, digits: int | None = None) -> DataFrame:
    """doc_id, epoch, domain, lang, source, n_tokens: a row for each time a document is drawn.

    ``tokens`` counts a text's tokens (none in a null or empty text; such a document is
    drawn if the prefix goes past it); texts of any length are counted whole. A null language or
    source is the blank one. Repeated rows count each, but are drawn together. An empty table
    gives an empty one; other columns aren't read. ``digits`` as in :func:`plan_mix`.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(_leaf_columns(docs, domain, tokens))
    plan = plan_mix(rows, mix, scratch, digits)
    scratch.only(rows, plan)
    return _chosen(_joined(rows, plan), mix).select("doc_id", F.col("epoch").cast("int").alias("epoch"), *LEVELS, "n_tokens")


def mixed_documents(docs: DataFrame, mix: Mix, domain=domain_of, tokens=words, digits: int | None = None) -> DataFrame:
    """The drawn documents themselves, with the columns of docs: as often as they are drawn."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(_leaf_columns(docs, domain, tokens))
    plan = plan_mix(rows, mix, scratch, digits)
    scratch.only(plan)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), domain(F.coalesce("source", F.lit(""))).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    return _chosen(_joined(own, plan), mix).select("row.*")


#: The mix of the query: three domains by 5 : 3 : 2, English twice as much as the others.
MIX = Mix(domain={"d0": 5, "d1": 3, "d2": 2}, lang={"en": 2}, num=1, den=1, max_epochs=4)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), MIX)


def _level_sql(name: str, nodes: str, over: str, level: str, weight: str) -> str:
    by = f"PARTITION BY {over}" if over else ""
    keys = f"{over}, {level}" if over else level
    return f"""
{name}_a AS (SELECT *, CAST({weight} AS HUGEINT) AS w FROM ({nodes})),
{name}_b AS (SELECT *, cap * sum(w) OVER ({by} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= w * (given - coalesce(sum(cap) OVER ({by} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_up FROM {name}_a),
{name} AS (SELECT {keys}, CASE WHEN full_up THEN cap ELSE
  w * (given - sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ({by})) // sum(CASE WHEN full_up THEN 0 ELSE w END) OVER ({by}) END AS budget FROM {name}_b)"""


OP1_SQL = (
    r"""
WITH docs AS (
  SELECT doc_id, 'd' || CAST(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT), 0) % 3 AS VARCHAR) AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT), 0) AS n_tokens
  FROM documents
), leaves AS (SELECT domain, lang, source, sum(n_tokens) AS supply, sum(n_tokens) * 4 AS cap FROM docs GROUP BY ALL),"""
    + _level_sql("top", "SELECT domain, sum(cap) AS cap, (SELECT sum(supply) FROM leaves) AS given FROM leaves GROUP BY domain", "", "domain", "CASE domain WHEN 'd0' THEN 5 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END")
    + ","
    + _level_sql("middle", "SELECT l.domain, l.lang, sum(cap) AS cap, any_value(t.budget) AS given FROM leaves l JOIN top t USING (domain) GROUP BY l.domain, l.lang", "domain", "lang", "CASE lang WHEN 'en' THEN 2 ELSE 1 END")
    + ","
    + _level_sql("low", "SELECT l.domain, l.lang, l.source, cap, m.budget AS given FROM leaves l JOIN middle m USING (domain, lang)", "domain, lang", "source", "1")
    + """,
epochs AS (
  SELECT domain, lang, source, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS e, CASE WHEN supply > 0 THEN budget % supply ELSE budget END AS rest
  FROM low JOIN leaves USING (domain, lang, source)
), drawn AS (
  SELECT d.*, e, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || CAST(e AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id) AS upto
  FROM docs d JOIN epochs USING (domain, lang, source)
)
SELECT doc_id, CAST(unnest(range(0, CAST(e + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT))) AS INTEGER) AS epoch, domain, lang, source, n_tokens FROM drawn
"""
)
