"""Import: validation, merging under a policy, duplicates, optimistic changes, changed partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locarium.functions.predicates import merge_blank, required_missing


def validated(rows: DataFrame, required: list[str], numbers: list[str], flags_ok: tuple[str, ...] = ()) -> DataFrame:
    """Add ``errors``: what is wrong with each record (F11). ``numbers`` hold JSON as read (so that the text
    ``"12"`` isn't the number 12), or null; those in ``flags_ok`` may be true or false."""
    bad = [F.when(required_missing(c), F.lit(f"missing {c}")) for c in required]
    for c in numbers:
        ok = F.col(c).rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$") | (F.col(c).isin("true", "false") if c in flags_ok else F.lit(False))
        bad.append(F.when(F.col(c).isNotNull() & ~ok, F.lit(f"{c} is not a number")))
    return rows.withColumn("errors", F.array_compact(F.array(*bad)))


def with_defaults(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """All declared fields in declared order; missing ones are blank, numbers NULL."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit("" if t == "string" else None)).cast(t).alias(c) for c, t in schema.items()])


def unknown_fields(records: DataFrame, known: list[str], json: str = "json") -> DataFrame:
    """Keys of JSON objects that aren't declared, and how often they occur (M6)."""
    keys = records.select(F.explode(F.json_object_keys(json)).alias("field"))
    declared = records.sparkSession.createDataFrame([(k,) for k in known], "field string")
    return keys.groupBy("field").agg(F.count("*").alias("records")).join(declared, "field", "left_anti")


def merged(existing: DataFrame, incoming: DataFrame, fields: list[str], policy: str) -> DataFrame:
    """One row for each id (J1, M1-M3). ``incoming`` has ``file_rank`` and ``row_idx``, which order it.

    fill: the first non-blank value of each field, else the first value; skip: the first
    record; replace: the last record whole.
    """
    columns = ["id", *fields]
    rows = existing.select(*columns, F.lit(-1).alias("file_rank"), F.lit(0).alias("row_idx")).unionByName(incoming.select(*columns, "file_rank", "row_idx"))
    place = F.struct("file_rank", "row_idx")
    if policy == "skip":
        picks = [F.min_by(F.struct(*fields), place).alias("r")]
    elif policy == "replace":
        picks = [F.max_by(F.struct(*fields), place).alias("r")]
    elif policy == "fill":
        # min_by over non-blank values combines before the shuffle; no window, no sort
        first = [F.coalesce(F.min_by(c, F.when(~merge_blank(c), place)), F.min_by(c, place)).alias(c) for c in fields]
        return rows.groupBy("id").agg(*first)
    else:
        raise ValueError(f"no such policy: {policy}")
    return rows.groupBy("id").agg(*picks).select("id", "r.*")


def merge_counters(existing: DataFrame, incoming: DataFrame, fields: list[str], policy: str) -> DataFrame:
    """added, filled, replaced, skipped, ungeocoded (M4): what each incoming record did, in order."""
    columns = ["id", *fields]
    rows = existing.select(*columns, F.lit(-1).alias("file_rank"), F.lit(0).alias("row_idx")).unionByName(incoming.select(*columns, "file_rank", "row_idx"))
    w = Window.partitionBy("id").orderBy("file_rank", "row_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.row_number().over(w) > 1
    had = [F.coalesce(F.max((~merge_blank(c)).cast("int")).over(before), F.lit(0)) for c in fields]
    fills = F.greatest(*[((h == 0) & ~merge_blank(c)).cast("int") for h, c in zip(had, fields, strict=True)], F.lit(0)) == 1
    differs = F.struct(*fields) != F.lag(F.struct(*fields)).over(w)
    done = F.when(F.col("file_rank") < 0, F.lit("old")).when(~F.col("seen"), F.lit("added"))
    done = done.when(F.lit(policy == "fill") & F.col("fills"), F.lit("filled")).when(F.lit(policy == "replace") & F.coalesce("differs", F.lit(True)), F.lit("replaced")).otherwise(F.lit("skipped"))
    rows = rows.withColumns({"seen": seen, "fills": fills, "differs": differs}).withColumn("done", done)
    counted = [F.count_if(F.col("done") == x).alias(x) for x in ("added", "filled", "replaced", "skipped")]
    if {"lat", "lon"} <= set(fields):
        counted.append(F.count_if((F.col("done") == "added") & (F.col("lat").isNull() | F.col("lon").isNull())).alias("ungeocoded"))
    return rows.agg(*counted)


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """Ids that occur more than once (M5); null ids are reported as NULL."""
    return rows.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1 or id is null")


def apply_changes(rows: DataFrame, changes: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Set a field only where it still is what the change expects (M7): (rows, changes that failed).

    A change that expects null adds a value where there is none. Changes of unknown records or
    fields fail, with ``found`` false; of several changes that hold, the largest new value counts.
    """
    stacked = rows.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("now")) for f in fields])).alias("c")).select("id", "c.*", F.lit(True).alias("found"))
    checked = changes.join(stacked, ["id", "field"], "left").withColumn("found", F.coalesce("found", F.lit(False))).withColumn("ok", F.col("found") & F.col("now").eqNullSafe(F.col("current_value")))
    good = checked.where("ok").groupBy("id").agg(*[F.max(F.when(F.col("field") == f, F.struct(F.col("new_value").alias("v")))).alias(f"_{f}") for f in fields])
    out = rows.join(good, "id", "left").select("id", *[F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v")).otherwise(F.col(f)).alias(f) for f in fields])
    return out, checked.where("not ok").select("id", "field", "current_value", "new_value", "now", "found")


def content_hash(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Order-free content of each partition: its rows, and two sums of 64-bit row hashes (SK2, M8)."""
    # nulls and lengths go into the hash, so that no two rows run into each other
    cells = [F.struct(F.col(f).isNull(), F.coalesce(F.length(F.col(f).cast("string")), F.lit(0)), F.col(f).cast("string")) for f in fields]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)"))
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.struct(total(1), total(2)).alias("hash"))


def changed_partitions(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, change): partitions to write, ``changed`` or ``new`` (write-if-changed), and ``orphan`` ones to
    delete (SK2, SK3). Null keys are a partition like any other."""
    a = content_hash(old, keys, fields).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("rows").alias("old_rows"), F.col("hash").alias("old_hash"))
    b = content_hash(new, keys, fields)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = a.join(b, same, "full_outer")
    what = F.when(F.col("old_rows").isNull(), "new").when(F.col("rows").isNull(), "orphan").when((F.col("hash") != F.col("old_hash")) | (F.col("rows") != F.col("old_rows")), "changed")
    place = [F.when(F.col("rows").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return both.withColumn("change", what).where("change is not null").select(*place, "change")


def ranked_first(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; Spark limits each group before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
