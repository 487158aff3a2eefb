"""Choosing among ranked sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agrees(city: Column, state: Column, postal: Column, text: Column) -> Column:
    """Whether a matched text speaks of the same place; blank parts agree with anything."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (blank(state) | F.contains(F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", " "), F.lit(" ")), F.concat(F.lit(" "), F.lower(state), F.lit(" ")))) & (blank(city) | F.contains(low, F.lower(city))) & (blank(postal) | F.contains(low, postal))


def accepted(source: Column, sub_rank: Column, quality: Column, house: Column, region: Column, top: dict[str, int], qualities: dict[str, list[str]], need_house: tuple[str, ...]) -> Column:
    """Each source's own rule (C2): how many hits count, which qualities, whether a house number and a region are needed."""
    ok = F.lit(True)
    for name, n in top.items():
        ok = ok & ((source != name) | (sub_rank <= n))
    for name, values in qualities.items():
        ok = ok & ((source != name) | F.coalesce(quality.isin(*values), F.lit(False)))
    for name in need_house:
        ok = ok & ((source != name) | (F.coalesce(house, F.lit(False)) & region.isNotNull()))
    return ok


def first_acceptable(candidates: DataFrame, ident: str, ok: Column, rank: list[str], note: Column) -> DataFrame:
    """For each id the first acceptable candidate and the notes of those before it, in rank order."""
    place = F.struct(*rank)
    rows = candidates.withColumn("ok", F.coalesce(ok, F.lit(False)))
    best = rows.groupBy(ident).agg(F.min(F.when(F.col("ok"), place)).alias("best"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct(place.alias("place"), note.alias("note"))))).alias("failed"))
    before = F.filter("failed", lambda n: F.col("best").isNull() | (n["place"] < F.col("best")))
    best = best.select(ident, "best", F.transform(before, lambda n: n["note"]).alias("notes"))
    hits = rows.where("ok").withColumn("best", place)
    return best.join(hits, [ident, "best"], "left").select(ident, *[c for c in candidates.columns if c != ident], "notes")


def first_answer(tries: DataFrame, ident: str, order: str) -> DataFrame:
    """The first 200 response with a body among a few tries."""
    good = tries.where("status = 200 and body is not null and body <> ''")
    return good.withColumn("n", F.row_number().over(Window.partitionBy(ident).orderBy(order))).where("n = 1").drop("n")
