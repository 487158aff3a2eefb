"""Reader and writer queries: files written to the shared folder, read back, and held against their tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from locarium.operators import merge as M
from locarium.operators import spatial as S
from locarium.operators.lineage import shared_folder
from locarium.sources import json_sources as J
from locarium.sources import sinks as K

from .registry import load, query

_DECLARED = {"fields": [{"key": "id", "type": "text"}, {"key": "name", "type": "text"}, {"key": "lat", "type": "number or null"}]}


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _arrays(spark, sf_dir, path: str, more) -> None:
    """A JSON array file of the nations (a table of fixed size) of each region, every second one with a byte order mark;
    ``more(key)`` gives the last members of each object."""
    k = F.col("n_nationkey")
    text = F.concat(F.lit('{"id":"'), k.cast("string"), F.lit('","name":"'), "n_name", F.lit('"'), more(k), F.lit("}"))
    files = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(text)), ",").alias("t"))
    files = files.select("n_regionkey", F.concat(F.when(F.col("n_regionkey") % 2 == 0, "\ufeff").otherwise(""), F.lit("["), "t", F.lit("]")).alias("value"))
    files.write.partitionBy("n_regionkey").text(path)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, n_nationkey / 4.0::DOUBLE AS lat, 'n_regionkey=' || n_regionkey AS folder FROM nation")
def places_read(spark, sf_dir):
    """SC1 SC2 SC3 SC4 SC5 SC10: trusted JSON arrays of a tree of folders, with and without a byte order mark."""
    path = _folder(spark)
    _arrays(spark, sf_dir, path, lambda k: F.concat(F.lit(',"lat":'), (k / F.lit(4.0)).cast("string")))
    rows = J.read_places(spark, [path], J.schema_of(_DECLARED), provenance=True)
    return rows.select("id", "name", "lat", F.regexp_extract("file", "(n_regionkey=[0-9]+)", 1).alias("folder"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 3 = 1 THEN ['lat is not a number'] ELSE [] END AS errors, CASE WHEN n_nationkey % 5 = 0 THEN ['odd'] ELSE [] END AS unknown FROM nation""")
def records_imported(spark, sf_dir):
    """SC1 F11 M6: untrusted records with their types: numbers in quotes are errors, unknown keys are named."""
    path = _folder(spark)
    last = lambda k: F.concat(F.when(k % 3 == 0, F.concat(F.lit(',"lat":'), k.cast("string"))).when(k % 3 == 1, ',"lat":"12"').otherwise(',"lat":null'), F.when(k % 5 == 0, ',"odd":1').otherwise(""))
    _arrays(spark, sf_dir, path, last)
    found = J.record_fields(J.read_records(spark, path), ["id", "name", "lat"], ("lat",))
    return M.validated(found, ["id", "name"], ["lat"]).select("id", "errors", "unknown")


@query("SELECT s_suppkey, s_name || CASE WHEN s_nationkey % 2 = 0 THEN '!' ELSE '' END AS s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier WHERE s_nationkey <> 7")
def partitions_written(spark, sf_dir):
    """SK2 SK11 M8: only changed partitions are written, orphans deleted; what is stored then is the new version."""
    path, keys, fields = _folder(spark), ["s_nationkey"], ["s_suppkey", "s_name"]
    old = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    new = old.where("s_nationkey <> 7").withColumn("s_name", F.when(F.col("s_nationkey") % 2 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    K.write_partitions(old, path, keys)
    changed = M.changed_partitions(old, new, keys, fields)
    K.write_partitions(new, path, keys, changed)
    K.delete_orphans(spark, path, keys, changed.where("change = 'orphan'"))
    return spark.read.schema("s_suppkey long, s_name string, s_nationkey long").json(path)


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN chr(39) || '=' || s_name WHEN 1 THEN chr(39) || '-' || s_name ELSE s_name || ', \"x\"' END AS cell FROM supplier")
def csv_written(spark, sf_dir):
    """SK6: cells of a CSV file as a spreadsheet reads them."""
    path, k = _folder(spark), F.col("s_suppkey")
    cell = F.when(k % 4 == 0, F.concat(F.lit("="), "s_name")).when(k % 4 == 1, F.concat(F.lit("-"), "s_name")).otherwise(F.concat("s_name", F.lit(', "x"')))
    K.write_csv(load(spark, sf_dir, "supplier").select("s_suppkey", cell.alias("cell")), path)
    return spark.read.option("header", True).option("escape", "\\").schema("s_suppkey long, cell string").csv(path)


_SIDE = "(1 + n_nationkey % 3)"


@query(f"SELECT 'n' || n_nationkey AS id, p AS part, CAST({_SIDE} * {_SIDE} AS DOUBLE) AS area, n_name AS name FROM nation, (VALUES (0), (1)) AS v(p) WHERE p = 0 OR n_nationkey % 2 = 0")
def geojson_read(spark, sf_dir):
    """SC7 X6 GE4: features of polygons and multipolygons with their properties."""
    path, k = _folder(spark), F.col("n_nationkey")
    side = F.lit(1) + k % 3
    corner = lambda x, y: F.concat(F.lit("["), (x + k * 10).cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
    ring = lambda up: F.concat(F.lit("[["), F.concat_ws(",", *[corner(x, y + up) for x, y in ((F.lit(0), F.lit(0)), (side, F.lit(0)), (side, side), (F.lit(0), side), (F.lit(0), F.lit(0)))]), F.lit("]]"))
    two = k % 2 == 0
    shape = F.concat(F.lit('{"type":"'), F.when(two, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), F.when(two, F.concat(F.lit("["), ring(0), F.lit(","), ring(5), F.lit("]"))).otherwise(ring(0)), F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"id":"n'), k.cast("string"), F.lit('","name":"'), "n_name", F.lit('"},"geometry":'), shape, F.lit("}"))
    load(spark, sf_dir, "nation").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("value")).write.text(path)
    found = J.read_geojson(spark, path)
    areas = S.ring_areas(S.segments_of(found)).join(found.select("id", F.col("properties")["name"].alias("name")), "id")
    return areas.select("id", F.col("part").cast("int").alias("part"), F.abs("area").alias("area"), "name")


@query("SELECT r_name AS id, 0 AS part, 4.0::DOUBLE * (r_regionkey + 1) AS area FROM region")
def topology_read(spark, sf_dir):
    """SC8: shapes of a quantised topology, of arcs that are shared and reversed."""
    path = _folder(spark)
    regions = sorted((r.r_regionkey, r.r_name) for r in load(spark, sf_dir, "region").collect())  # a table of fixed size
    arcs = [arc for k, _ in regions for arc in ([[0, 0], [4, 0], [0, 2 * (k + 1)]], [[4, 2 * (k + 1)], [-4, 0], [0, -2 * (k + 1)]])]
    shapes = [{"type": "Polygon", "id": name, "arcs": [[2 * n, 2 * n + 1] if n % 2 else [~(2 * n + 1), ~(2 * n)]]} for n, (_, name) in enumerate(regions)]
    document = {"type": "Topology", "transform": {"scale": [0.5, 1], "translate": [10, 0]}, "arcs": arcs, "objects": {"units": {"type": "GeometryCollection", "geometries": shapes}}}
    spark.createDataFrame([(json.dumps(document),)], "value string").write.text(path)
    areas = S.ring_areas(S.segments_of(J.read_topojson(spark, path, "units")))
    return areas.select("id", F.col("part").cast("int").alias("part"), F.abs("area").alias("area"))
