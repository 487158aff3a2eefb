"""Normalising records: change log, review flags, extracted values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_log(rows: DataFrame, ident: str, rules: list[tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """(id, field, old, new) for each rule that changes a value (X7); rules run in order, so a
    field may appear twice, each time with what that rule saw."""
    steps, now = [], {}
    for field, rule in rules:
        old = now.get(field, F.col(field))
        new = rule(old)
        steps.append(F.struct(F.lit(field).alias("field"), old.alias("old"), new.alias("new")))
        now[field] = new
    changed = F.filter(F.array(*steps), lambda s: ~s["old"].eqNullSafe(s["new"]))
    return rows.select(ident, F.explode(changed).alias("s")).select(ident, "s.*")


def normalized(rows: DataFrame, rules: list[tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """Apply the rules in order."""
    for field, rule in rules:
        rows = rows.withColumn(field, rule(F.col(field)))
    return rows


def lead_title(role, name, roles: dict[str, str], usual: str, flagged: str, usual_flagged: str) -> Column:
    """The title that a role after a name implies (S-8): NULL without a known role, blank for the usual one
    (another where the record's name matches ``flagged``), else the title, after ``Interim`` if it says so.

    ``roles``: pattern -> title.
    """
    out = F.lit(None).cast("string")
    for pattern, title in roles.items():
        said = F.when(role.rlike(rf"(?i)^interim\s+(?:{pattern})$"), F.lit(f"Interim {title}")).when(role.rlike(rf"(?i)^(?:{pattern})$"), F.lit(title))
        out = F.coalesce(out, said)
    plain = F.when(F.coalesce(name.rlike(rf"(?i)\b(?:{flagged})\b"), F.lit(False)), F.lit(usual_flagged)).otherwise(F.lit(usual))
    return F.when(out == plain, F.lit("")).otherwise(out)


def same_coordinates(places: DataFrame, per: list[str]) -> DataFrame:
    """Spots with more than one place, per file if ``per`` names its column (A4)."""
    spots = places.where("lat is not null and lon is not null").groupBy(*per, "lat", "lon")
    return spots.agg(F.count("*").alias("rows"), F.sort_array(F.collect_list("id")).alias("ids")).where("rows > 1")


def emails(rows: DataFrame, ident: str, column: str) -> DataFrame:
    """Distinct addresses of each row's text, in lower case."""
    pattern = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    # rows without the sign need no pattern
    found = F.array_distinct(F.transform(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), lambda e: F.lower(e)))
    return rows.where(F.contains(column, F.lit("@"))).select(ident, F.explode(found).alias("email"))
