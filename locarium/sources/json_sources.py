"""Readers: JSON arrays, trees of files, strict imports, GeoJSON, stored responses."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared types of the schema document and what they are here.
TYPES = {"number": T.DoubleType(), "number or null": T.DoubleType()}


def schema_of(document: dict) -> T.StructType:
    """The declared fields in order (SC5); everything but numbers is text, blank being ``""``."""
    return T.StructType([T.StructField(f["key"], TYPES.get(f["type"], T.StringType())) for f in document["fields"]])


def read_schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema document, read by Spark, from any store; one small file."""
    return schema_of(json.loads(spark.read.option("wholetext", True).text(path).first()[0]))


def read_places(spark: SparkSession, paths: str | list[str], schema: T.StructType, provenance: bool = False) -> DataFrame:
    """Trusted JSON arrays (SC1-SC4, SC10): files, folders and globs, at any depth, with or without a
    byte order mark. A malformed file fails the job. ``provenance`` adds the file."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(paths)
    return rows.withColumn("file", F.col("_metadata.file_path")) if provenance else rows


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Untrusted JSON arrays as (file, row_idx, record VARIANT) (H11): keys, nulls and types stay as they
    are in the file. A file that isn't an array of objects gives one row with ``error``."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(paths).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    parsed = files.withColumn("v", F.try_parse_json("value"))
    good = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("ARRAY<")), F.lit(False))
    bad = parsed.where(~good).select("file", F.lit(None).cast("int").alias("row_idx"), F.lit(None).cast("variant").alias("record"), F.lit("not a JSON array").alias("error"))
    items = F.from_json("value", "array<string>")
    rows = parsed.where(good).select("file", F.posexplode(items).alias("row_idx", "text"))
    record = F.try_parse_json("text")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(record), F.lit("OBJECT<")), F.lit(False))
    rows = rows.select("file", "row_idx", F.when(is_object, record).alias("record"), F.when(~is_object, "not an object").alias("error"))
    return rows.unionByName(bad)


def record_fields(records: DataFrame, keys: list[str], numbers: tuple[str, ...] = ()) -> DataFrame:
    """(file, row_idx, key columns as text, unknown ARRAY<STRING>): what the declared keys hold.
    Those of ``numbers`` are JSON as it stands, texts in quotes, for :func:`~locarium.operators.merge.validated`."""
    text = F.to_json("record")
    raw = lambda k: F.to_json(F.try_variant_get("record", f"$['{k}']", "variant"))
    held = lambda k: F.when(raw(k) != "null", raw(k)) if k in numbers else F.get_json_object(text, f"$['{k}']")
    return records.where("error is null").select("file", "row_idx", *[held(k).alias(k) for k in keys], F.array_except(F.json_object_keys(text), F.array(*[F.lit(k) for k in keys])).alias("unknown"))


def read_geojson(spark: SparkSession, path: str, ident: str = "id") -> DataFrame:
    """Features as (id, properties, geom ARRAY<ARRAY<ARRAY<STRUCT<x,y>>>>) (SC7, X6); a Polygon has one part."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    f = raw.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>")).when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>")))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    geom = F.transform(parts, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point)))
    return f.select(F.col("f.properties")[ident].alias("id"), F.col("f.properties").alias("properties"), geom.alias("geom"))


def read_each(spark: SparkSession, paths: list[str], read) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """Read files one by one, so that a bad one doesn't stop the others (SC11): frames, and (path, error)."""
    frames, errors = [], []
    for p in paths:
        try:
            frame = read(spark, p)
            frame.limit(0).collect()
            frames.append(frame)
        except Exception as e:
            errors.append((p, str(e).splitlines()[0]))
    return frames, errors


def topology_shapes(text: str, layer: str) -> list[tuple[str, dict, list]]:
    """(id, properties, parts) of one layer of a quantised topology: delta-coded arcs to rings (SC8)."""
    doc = json.loads(text)
    scale, shift = (doc["transform"][k] for k in ("scale", "translate")) if "transform" in doc else ((1, 1), (0, 0))
    arcs = []
    for arc in doc["arcs"]:
        x = y = 0
        points = []
        for dx, dy, *_ in arc:
            x, y = (x + dx, y + dy) if "transform" in doc else (dx, dy)
            points.append((float(x * scale[0] + shift[0]), float(y * scale[1] + shift[1])))
        arcs.append(points)

    def ring(refs):
        out = []
        for r in refs:
            points = arcs[r] if r >= 0 else arcs[~r][::-1]
            out += points[1:] if out else points
        return out

    out = []
    for g in doc["objects"][layer]["geometries"]:
        polygons = {"Polygon": lambda a: [a], "MultiPolygon": lambda a: a}.get(g.get("type"), lambda a: [])(g.get("arcs"))
        out.append((str(g.get("id")), {k: str(v) for k, v in (g.get("properties") or {}).items()}, [[ring(r) for r in rings] for rings in polygons]))
    return out


def read_topojson(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(id, properties, geom) of a topology file, decoded where the file is read."""
    kind = T._parse_datatype_string("array<struct<id:string,properties:map<string,string>,geom:array<array<array<struct<x:double,y:double>>>>>>")
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    shapes = F.udf(lambda text: topology_shapes(text, layer), kind)  # one call a file
    return files.select(F.explode(shapes("value")).alias("s")).select("s.*")
