"""Facets, keywords, tags, details, nearest-first lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locarium.functions.geo import haversine
from locarium.functions.predicates import has_coordinates, has_value


def any_of(column: str, values: list, multiple: bool = False) -> Column:
    """OR within one facet; ``multiple``: the column holds several answers joined by ``; `` (F1, F2)."""
    if not multiple:
        return F.coalesce(F.col(column).isin(*values), F.lit(False))
    return F.arrays_overlap(F.split(F.coalesce(column, F.lit("")), r";\s*"), F.array(*[F.lit(v) for v in values]))


def faceted(places: DataFrame, chosen: dict[str, list], multiple: tuple[str, ...] = ()) -> DataFrame:
    """AND across facets; facets without a choice are left out of the plan."""
    active = [any_of(k, v, k in multiple) for k, v in chosen.items() if v]
    return places.where(reduce(lambda a, b: a & b, active)) if active else places


def by_controls(places: DataFrame, controls: dict[str, tuple[str, bool]], chosen: dict[str, list]) -> DataFrame:
    """Facets by the names of their controls (F3): ``controls`` maps each to its field and whether that holds several
    answers; a control that isn't mapped is an error."""
    if unknown := sorted(set(chosen) - set(controls)):
        raise ValueError(f"no such controls: {', '.join(unknown)}")
    return faceted(places, {controls[c][0]: v for c, v in chosen.items()}, tuple(f for f, several in controls.values() if several))


def keyword_search(places: DataFrame, query: str, columns: list[str], hidden: tuple[str, ...] = ()) -> DataFrame:
    """Rows in which every word of the query stands somewhere in the columns (F4, F5); none for a blank query."""
    words = query.lower().split()
    if not words:
        return places.limit(0)
    text = F.lower(F.concat_ws(" ", *[c for c in columns if c not in hidden]))
    return places.where(reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in words]))


def with_miles(places: DataFrame, lat: float, lon: float) -> DataFrame:
    """Add miles from an origin, infinite where coordinates are missing."""
    return places.withColumn("miles", haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")))


def top_with_total(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows and, on each, how many there are in all (O3, A1)."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(n).join(F.broadcast(total))  # total is one row


def nearest_first(places: DataFrame, lat: float, lon: float, n: int) -> DataFrame:
    """Nearest n: by distance, then name, then id; rows without coordinates last."""
    return top_with_total(with_miles(places, lat, lon), ["miles", "name", "id"], n)


def bounding_box(places: DataFrame, lat: float | None = None, lon: float | None = None, n: int | None = None) -> DataFrame:
    """West, south, east, north of all valid points, or of the origin and its nearest n (A5, O4, GE14)."""
    valid = places.where(has_coordinates())
    if n is not None:
        valid = with_miles(valid, lat, lon).orderBy("miles", "name", "id").limit(n)
    extra = (lambda f, v, x: f(v, F.lit(x))) if n is not None else (lambda f, v, x: v)
    return valid.agg(
        extra(F.least, F.min("lon"), lon).alias("west"), extra(F.least, F.min("lat"), lat).alias("south"),
        extra(F.greatest, F.max("lon"), lon).alias("east"), extra(F.greatest, F.max("lat"), lat).alias("north"), F.count("*").alias("points"),
    )


def options_in_use(places: DataFrame, column: str, options: list[str], separator: str | None = None) -> DataFrame:
    """Listed options that occur, in listed order (A2, J17, O6). Joins the short list with the distinct answers."""
    value = F.explode(F.split(column, separator)) if separator else F.col(column)
    used = places.select(value.alias("option")).where("option is not null and option <> ''").distinct()
    listed = places.sparkSession.createDataFrame(list(enumerate(options)), "pos int, option string")
    return listed.join(used, "option", "left_semi").select("pos", "option")


def card_tags(column_tags: dict[str, list[tuple[str, str]]], separator: str = r";\s*") -> Column:
    """For each field the label of the first listed answer that the row has; one tag a field."""
    tags = []
    for field, answers in column_tags.items():
        given = F.split(F.coalesce(field, F.lit("")), separator)
        tags.append(F.coalesce(*[F.when(F.array_contains(given, a), F.lit(label)) for a, label in answers], F.lit(None).cast("string")))
    return F.filter(F.array(*tags), lambda t: t.isNotNull())


def detail_rows(places: DataFrame, sections: dict[str, list[str]], hidden: tuple[str, ...] = ()) -> DataFrame:
    """(id, section_pos, section, field_pos, field, value), without empty fields (F13); so empty sections don't appear."""
    cells = [
        F.struct(F.lit(s).alias("section_pos"), F.lit(section).alias("section"), F.lit(k).alias("field_pos"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
        for s, (section, fields) in enumerate(sections.items())
        for k, f in enumerate(fields)
        if f not in hidden
    ]
    return places.select("id", F.explode(F.array(*cells)).alias("c")).select("id", "c.*").where(has_value("value"))


def visible(places: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    """Hidden fields aren't shown; they aren't deleted."""
    return places.drop(*hidden)


def not_repeated(other: Column, *parts: Column) -> Column:
    """Blank where the text only repeats the joined parts that have values."""
    joined = F.array_join(F.filter(F.array(*parts), lambda p: has_value(p)), " | ")
    return F.when(other == joined, F.lit("")).otherwise(other)
