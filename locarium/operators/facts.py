"""Facts from pages, and choosing among them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locarium.functions.text import nearest_label


def unique_best(rows: DataFrame, by: list[str], score: list) -> DataFrame:
    """The row with the best score of each group, none if several share it."""
    w = Window.partitionBy(*by).orderBy(*score)
    ranked = rows.withColumn("_r", F.rank().over(w)).where("_r = 1")
    return ranked.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where("_n = 1").drop("_r", "_n")


def modal_value(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The commonest value of each group, the first seen of equally common ones."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*by).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias(value), F.max("n").alias("n"))


def sitewide(facts: DataFrame, by: list[str], url: str, least: int = 2) -> DataFrame:
    """Values that stand on several pages."""
    return facts.groupBy(*by).agg(F.countDistinct(url).alias("pages")).where(F.col("pages") >= least)


def role_votes(facts: DataFrame, by: list[str], role: str, first: str, second: str) -> DataFrame:
    """Values that at least as many mentions give to one role as to another."""
    return facts.groupBy(*by).agg(F.count_if(F.col(role) == first).alias("votes"), F.count_if(F.col(role) == second).alias("against")).where("against <= votes")


def single_value(rows: DataFrame, by: list[str], key, value: str, order: str) -> DataFrame:
    """The first spelling of groups whose values all have one key."""
    return rows.withColumn("_k", key).groupBy(*by).agg(F.countDistinct("_k").alias("_n"), F.min_by(value, order).alias(value)).where("_n = 1").drop("_n")


def greedy_clusters(rows: DataFrame, by: list[str], value: str, order: str, match) -> DataFrame:
    """(by, head, size): each value joins the first cluster whose head matches it, in order.

    ``match(a, b)`` is a column expression; the fold runs within Spark, over one group's values.
    """
    groups = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("v"))
    empty = F.array().cast("array<struct<head:string,size:int>>")

    def add(acc, x):
        at = F.array_position(F.transform(acc, lambda c: match(c["head"], x[value])), F.lit(True))
        grown = F.transform(acc, lambda c, i: F.struct(c["head"].alias("head"), (c["size"] + F.when(i == at - 1, 1).otherwise(0)).alias("size")))
        return F.when(at > 0, grown).otherwise(F.concat(acc, F.array(F.struct(x[value].alias("head"), F.lit(1).alias("size")))))

    return groups.select(*by, F.explode(F.aggregate("v", empty, add)).alias("c")).select(*by, "c.*")


def jsonld_objects(text) -> Column:
    """Every object of a JSON text at any depth, as (type, name, telephone, email, address, the last as JSON)."""
    kind = pa.list_(pa.struct([(k, pa.string()) for k in ("type", "name", "telephone", "email", "address")]))

    def walk(x):
        if isinstance(x, dict):
            yield x
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            yield from walk(y)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for v in batch:
                try:
                    found = list(walk(json.loads(v.as_py() or "null")))
                except (ValueError, RecursionError):
                    found = []
                say = lambda x: None if x is None else x if isinstance(x, str) else json.dumps(x)
                out.append([{"type": say(o.get("@type")), **{k: say(o.get(k)) for k in ("name", "telephone", "email", "address")}} for o in found])
            yield pa.array(out, kind)

    return F.arrow_udf(run, "array<struct<type:string,name:string,telephone:string,email:string,address:string>>")(text)


def labelled_matches(text, pattern: str, labels: dict[str, str]) -> Column:
    """(value, role) of each match of a pattern, with the role whose word stands nearest (S-21, D1)."""
    import re

    compiled = re.compile(pattern)
    kind = pa.list_(pa.struct([("value", pa.string()), ("role", pa.string())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for v in batch:
                s = v.as_py() or ""
                out.append([{"value": m[0], "role": nearest_label(s, m.start(), m.end(), labels)} for m in compiled.finditer(s)])
            yield pa.array(out, kind)

    return F.arrow_udf(run, "array<struct<value:string,role:string>>")(text)


def neighbour_roles(lines: DataFrame, by: str, order: str, text: str, role: str, name: str) -> DataFrame:
    """Names with the role on the line below, or above (S-20): patterns say which lines are which."""
    w = Window.partitionBy(by).orderBy(order)
    rows = lines.select(by, order, text, F.lag(text).over(w).alias("above"), F.lead(text).over(w).alias("below"))
    is_role = lambda c: F.coalesce(F.col(c).rlike(role), F.lit(False))
    found = rows.where(F.col(text).rlike(name) & ~F.col(text).rlike(role))
    return found.select(by, order, F.col(text).alias("name"), F.when(is_role("below"), F.col("below")).when(is_role("above"), F.col("above")).alias("role")).where("role is not null")
