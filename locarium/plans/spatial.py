"""Boundary queries over shapes and points derived from tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from locarium.functions import text as T
from locarium.operators import spatial as S

from .registry import load, places, places_sql, query


def _box(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n), (w, s)]


#: Shapes: a square, an L, a square with a hole, two parts, a shared edge, an overlap, an island.
SHAPES = {
    "square": [[_box(0, 0, 4, 4)]],
    "right": [[_box(4, 0, 8, 4)]],
    "ell": [[[(0, 4), (4, 4), (4, 6), (2, 6), (2, 10), (0, 10), (0, 4)]]],
    "holed": [[_box(4, 4, 10, 10), _box(6, 6, 8, 8)]],
    "over": [[_box(7, 2, 10, 5)]],
    "parts": [[_box(8, 0, 9, 2)], [_box(12, 12, 13, 13)], [_box(12, 14, 15, 15)]],
}
_ROWS = [
    (name, p, r, k + 1, float(a[0]), float(a[1]), float(b[0]), float(b[1]))
    for name, parts in SHAPES.items()
    for p, rings in enumerate(parts)
    for r, ring in enumerate(rings)
    for k, (a, b) in enumerate(zip(ring, ring[1:], strict=False))
]
#: One set of shapes for each supplier, 20 degrees east of the one before.
_LITERAL = "(SELECT * FROM (VALUES " + ", ".join(f"('{n}', {p}, {r}, {k}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, p, r, k, a, b, c, d in _ROWS) + ") AS s(id, part, ring, seq, x1, y1, x2, y2))"
_SEG = f"(SELECT id || '-' || s_suppkey AS id, part, ring, seq, x1 + 20.0::DOUBLE * s_suppkey AS x1, y1, x2 + 20.0::DOUBLE * s_suppkey AS x2, y2 FROM {_LITERAL}, supplier)"
_PTS = "(SELECT c_custkey AS point, (c_custkey * 37 % 1100) / 100.0::DOUBLE + 0.005 + 20.0::DOUBLE * (c_custkey % 100) AS x, (c_custkey * 53 % 1090) / 100.0::DOUBLE + 0.005 AS y FROM customer)"


def _segments(spark, sf_dir):
    kind = "array<struct<id: string, geom: array<array<array<struct<x: double, y: double>>>>>>"
    shapes = F.from_json(F.lit(json.dumps([{"id": n, "geom": [[[{"x": x, "y": y} for x, y in ring] for ring in rings] for rings in parts]} for n, parts in SHAPES.items()])), kind)
    k = F.col("s_suppkey")
    east = lambda geom: F.transform(geom, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct((p["x"] + F.lit(20.0) * k).alias("x"), p["y"].alias("y")))))
    rows = load(spark, sf_dir, "supplier").select(k, F.explode(shapes).alias("s"))
    return S.segments_of(rows.select(F.concat_ws("-", "s.id", k.cast("string")).alias("id"), east(F.col("s.geom")).alias("geom")))


def _customers(spark, sf_dir):
    k = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(k.alias("point"), ((k * 37 % 1100) / F.lit(100.0) + 0.005 + F.lit(20.0) * (k % 100)).alias("x"), ((k * 53 % 1090) / F.lit(100.0) + 0.005).alias("y"))


def _pip(points: str) -> str:
    return f"""(SELECT point, id FROM (SELECT point, id, part, ring, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 AS odd FROM {points} p, {_SEG} s GROUP BY ALL)
      GROUP BY point, id, part HAVING max(CASE WHEN ring = 0 THEN odd ELSE 0 END) = 1 AND max(CASE WHEN ring > 0 THEN odd ELSE 0 END) = 0)"""


_K = "cos(radians(y))"
_LEN = f"(((x2 - x1) * {_K}) * ((x2 - x1) * {_K}) + (y2 - y1) * (y2 - y1))"
_T = f"greatest(0.0, least(1.0, (((x - x1) * {_K}) * ((x2 - x1) * {_K}) + (y - y1) * (y2 - y1)) / (CASE WHEN {_LEN} = 0 THEN 1.0 ELSE {_LEN} END)))"
_DIST = f"sqrt(pow((x - x1) * {_K} - {_T} * ((x2 - x1) * {_K}), 2) + pow((y - y1) - {_T} * (y2 - y1), 2))"


@query(f"SELECT DISTINCT point, id FROM {_pip(_PTS)}")
def point_in_polygon(spark, sf_dir):
    """J6 GE2: which shapes hold a point."""
    return S.containing(_customers(spark, sf_dir), _segments(spark, sf_dir))


@query(f"SELECT point, id, round(min({_DIST}), 6) AS distance FROM {_PTS} p, {_SEG} s GROUP BY ALL HAVING min({_DIST}) < 0.3")
def nearest_edge(spark, sf_dir):
    """J7 GE3: shapes with an edge within a tolerance, across cells too."""
    return S.near_edges(_customers(spark, sf_dir), _segments(spark, sf_dir), 0.3).withColumn("distance", F.round("distance", 6))


@query(f"""WITH i AS (SELECT DISTINCT point, id FROM {_pip(_PTS)}) SELECT point, id, 'inside' AS how FROM i UNION ALL
SELECT point, id, 'edge' FROM {_PTS} p, {_SEG} s WHERE point NOT IN (SELECT point FROM i) GROUP BY point, id HAVING min({_DIST}) < 0.3""")
def point_group_with_fallback(spark, sf_dir):
    """Inside, else near an edge."""
    return S.assigned(_customers(spark, sf_dir), _segments(spark, sf_dir), 0.3)


@query(f"SELECT id, part, ring, sum(x1 * y2 - x2 * y1) / 2 AS area FROM {_SEG} GROUP BY ALL")
def polygon_areas(spark, sf_dir):
    """GE4 GE11 X6: signed areas of outer rings and holes."""
    return S.ring_areas(_segments(spark, sf_dir))


@query(f"SELECT id, part, area FROM (SELECT id, part, abs(sum(x1 * y2 - x2 * y1) / 2) AS area FROM {_SEG} WHERE ring = 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY area DESC, part) = 1")
def largest_part(spark, sf_dir):
    """The largest part, the first of equal ones."""
    return S.largest_parts(_segments(spark, sf_dir))


@query(f"SELECT id, part, round(avg(x1), 1) AS x, round(avg(y1), 1) AS y, min(x1) AS west, max(y1) AS north FROM {_SEG} WHERE ring = 0 GROUP BY ALL")
def part_centroids(spark, sf_dir):
    """GE5 GE8 A5: vertex means as keys, and boxes."""
    seg = _segments(spark, sf_dir)
    return S.centroids(seg).join(S.parts_of(seg).select("id", "part", "west", "north"), ["id", "part"])


@query(f"SELECT id, part, ring, CAST(count(*) AS BIGINT) AS edges FROM {_SEG} WHERE ring > 0 GROUP BY ALL")
def holes(spark, sf_dir):
    """GE11: holes as rings of their own."""
    return _segments(spark, sf_dir).where("ring > 0").groupBy("id", "part", "ring").agg(F.count("*").alias("edges"))


_GRID = "(SELECT n AS point, CAST(n % 40 AS INTEGER) AS gx, CAST(n // 40 AS INTEGER) AS gy, 20.1 + (n % 40) * 0.3::DOUBLE AS x, 0.1 + (n // 40) * 0.3::DOUBLE AS y FROM (SELECT unnest(range(1600)) AS n))"


def _grid(spark):
    return S.sample_grid(spark, 20.0, 0.0, 40, 40, 0.3, 0.1)


@query(f"""WITH h AS (SELECT DISTINCT point, id FROM {_pip(_GRID)}), p AS (SELECT a.id AS a, b.id AS b, a.point FROM h a JOIN h b ON a.point = b.point AND a.id < b.id)
SELECT a, b, count(*) AS points, arg_min(x, point) AS x, arg_min(y, point) AS y FROM p JOIN {_GRID} USING (point) GROUP BY a, b""")
def overlap_pairs(spark, sf_dir):
    """A6 GE12 D15: shapes that share sample points."""
    return S.overlaps(S.containing(_grid(spark), _segments(spark, sf_dir)), _grid(spark))


@query(f"SELECT point, gx, gy FROM {_GRID} WHERE x < 30 AND y < 10 AND point NOT IN (SELECT point FROM {_pip(_GRID)})")
def coverage_gaps(spark, sf_dir):
    """D15 GE12: sample points within the whole that no shape holds."""
    land = _grid(spark).where("x < 30 and y < 10")
    return S.uncovered(land, S.containing(land, _segments(spark, sf_dir))).select("point", "gx", "gy")


@query(f"""WITH RECURSIVE g AS (SELECT gx, gy FROM {_GRID} WHERE x < 30 AND y < 10 AND point NOT IN (SELECT point FROM {_pip(_GRID)})),
r AS (SELECT gx, gy, CAST(gy AS BIGINT) * 4294967296 + gx AS c FROM g UNION SELECT g.gx, g.gy, r.c FROM r JOIN g ON abs(g.gx - r.gx) + abs(g.gy - r.gy) = 1)
SELECT gx, gy, min(c) AS component FROM r GROUP BY gx, gy""")
def grid_components(spark, sf_dir):
    """GE13: gaps as 4-neighbour components."""
    return S.grid_components(coverage_gaps(spark, sf_dir))


@query(f"SELECT x1 AS x, y1 AS y, list_sort(list(DISTINCT id)) AS owners FROM {_SEG} GROUP BY x1, y1")
def vertex_owners(spark, sf_dir):
    """Who shares a vertex."""
    return S.vertex_owners(_segments(spark, sf_dir))


@query(f"""SELECT DISTINCT id, part FROM {_SEG} s WHERE (id, part) NOT IN (SELECT (id, part) FROM (SELECT id, part, abs(sum(x1 * y2 - x2 * y1)) AS area FROM {_SEG} WHERE ring = 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY area DESC, part) = 1)
  AND NOT EXISTS (SELECT 1 FROM {_SEG} a, {_SEG} b WHERE a.id = s.id AND a.part = s.part AND b.id <> s.id AND a.x1 = b.x1 AND a.y1 = b.y1)""")
def island_parts(spark, sf_dir):
    """Detached parts that touch nobody."""
    return S.island_parts(_segments(spark, sf_dir))


_MERGED = "(SELECT CASE WHEN split_part(id, '-', 1) IN ('square', 'right', 'ell') THEN 'west-' || split_part(id, '-', 2) ELSE id END AS \"group\", s.* FROM " + _SEG + " s WHERE NOT starts_with(id, 'over'))"


def _groups(spark, sf_dir):
    names = _segments(spark, sf_dir).select("id").distinct().where("not startswith(id, 'over')")
    shape, of = F.substring_index("id", "-", 1), F.substring_index("id", "-", -1)
    return names.select("id", F.when(shape.isin("square", "right", "ell"), F.concat(F.lit("west-"), of)).otherwise(F.col("id")).alias("group"))


@query(f"""SELECT "group", CASE WHEN (x1, y1) < (x2, y2) THEN x1 ELSE x2 END AS ax, CASE WHEN (x1, y1) < (x2, y2) THEN y1 ELSE y2 END AS ay, CASE WHEN (x1, y1) < (x2, y2) THEN x2 ELSE x1 END AS bx, CASE WHEN (x1, y1) < (x2, y2) THEN y2 ELSE y1 END AS by FROM {_MERGED} GROUP BY ALL HAVING count(*) % 2 = 1""")
def dissolve_edges(spark, sf_dir):
    """Outlines of merged shapes; shared edges cancel out."""
    return S.dissolved_edges(_segments(spark, sf_dir), _groups(spark, sf_dir))


@query()
def dissolved_rings(spark, sf_dir):
    """The outlines as rings."""
    return S.stitched(S.dissolved_edges(_segments(spark, sf_dir), _groups(spark, sf_dir)))


def _inside(x: str, y: str) -> str:
    return f"sum(CASE WHEN (y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1"


@query(f"""WITH b AS (SELECT id, part, ring, min(x1) AS w, max(x1) AS e, min(y1) AS s, max(y1) AS n FROM {_SEG} GROUP BY ALL), g AS (SELECT b.*, m, i, j, w + (e - w) * i / m AS x, s + (n - s) * j / m AS y FROM b, (VALUES (4), (8)) AS m(m), range(1, 8) AS i(i), range(1, 8) AS j(j) WHERE i < m AND j < m),
h AS (SELECT g.id, g.part, g.ring, m, i, j, x, y FROM g JOIN {_SEG} t ON t.id = g.id AND t.part = g.part AND t.ring = g.ring GROUP BY ALL HAVING {_inside("x", "y")})
SELECT id, part, ring, round(x, 6) AS x, round(y, 6) AS y FROM h QUALIFY row_number() OVER (PARTITION BY id, part, ring ORDER BY m, i, j) = 1""")
def interior_points(spark, sf_dir):
    """GE6: a point inside each ring, by a grid that gets finer."""
    rows = S.interior_points(_segments(spark, sf_dir))
    return rows.select("id", "part", "ring", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def label_points(spark, sf_dir):
    """GE7: where to put a label."""
    return S.label_points(_segments(spark, sf_dir))


@query(f"""SELECT CAST(floor((lon + 180) / 360 * 4096 / 40) AS BIGINT) AS cx, CAST(floor((0.5 - ln(tan(0.7853981633974483 + radians(lat) / 2)) / (2 * 3.141592653589793)) * 4096 / 40) AS BIGINT) AS cy, count(*) AS places
FROM {places_sql("customer")} WHERE lat IS NOT NULL GROUP BY ALL""")
def zoom_grid_clusters(spark, sf_dir):
    """Counts by squares of the map at a zoom."""
    return S.zoom_clusters(places(spark, sf_dir, "customer"), 4)


_NAMED = "(SELECT n_nationkey, n_regionkey, translate(n_name, '0123456789', 'abcdefghij') AS n_name FROM nation)"
_UNITS = f"""(SELECT n_nationkey AS fips, n_name AS name, 'R' || n_regionkey AS state, 'R' || n_regionkey || ':' || regexp_replace(lower(n_name), '[^a-z]', '', 'g') AS key FROM {_NAMED})"""
_ENTRIES = f"""(SELECT CAST(n_nationkey % 7 AS VARCHAR) AS "group", n_name || ' County, R' || n_regionkey AS entry, 'R' || n_regionkey || ':' || regexp_replace(lower(n_name), '[^a-z]', '', 'g') AS key FROM {_NAMED} WHERE n_nationkey % 4 <> 1
  UNION ALL SELECT '9', n_name || ', R' || n_regionkey, 'R' || n_regionkey || ':' || regexp_replace(lower(n_name), '[^a-z]', '', 'g') FROM {_NAMED} WHERE n_nationkey % 6 = 0)"""


def _units(spark, sf_dir):
    nation = load(spark, sf_dir, "nation").withColumn("n_name", F.translate("n_name", "0123456789", "abcdefghij"))
    state = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    units = nation.select(F.col("n_nationkey").alias("fips"), F.col("n_name").alias("name"), state.alias("state"), T.unit_key(state, T.fold("n_name")).alias("key"))
    named = nation.where("n_nationkey % 4 <> 1").select((F.col("n_nationkey") % 7).cast("string").alias("group"), F.concat("n_name", F.lit(" County, "), state).alias("e"))
    named = named.unionByName(nation.where("n_nationkey % 6 = 0").select(F.lit("9").alias("group"), F.concat("n_name", F.lit(", "), state).alias("e")))
    entries = named.groupBy("group").agg(F.collect_list("e").alias("entries"))
    return units, S.unit_keys(entries, lambda state, name: T.unit_key(state, T.fold(name)))


@query(f'SELECT "group", entry, fips FROM {_ENTRIES} e JOIN {_UNITS} u USING (key)')
def unit_assignment(spark, sf_dir):
    """J2 A23 S-12 E6: units that a group's entries name."""
    units, entries = _units(spark, sf_dir)
    return entries.join(units, "key").select("group", "entry", "fips")


@query(f"SELECT fips, name FROM {_UNITS} WHERE key NOT IN (SELECT key FROM {_ENTRIES}) AND state <> 'R4'")
def unowned_units(spark, sf_dir):
    """Units in no group, without excepted states."""
    units, entries = _units(spark, sf_dir)
    return units.where("state <> 'R4'").join(entries, "key", "left_anti").select("fips", "name")


@query(f'SELECT fips, count(DISTINCT "group") AS groups FROM {_ENTRIES} JOIN {_UNITS} USING (key) GROUP BY fips HAVING count(DISTINCT "group") > 1')
def double_owned_units(spark, sf_dir):
    """Units that two groups claim."""
    units, entries = _units(spark, sf_dir)
    return entries.join(units, "key").groupBy("fips").agg(F.countDistinct("group").alias("groups")).where("groups > 1")


@query("SELECT key, CAST(count(*) AS BIGINT) AS units, list_sort(list(n_nationkey)) AS fips, bool_or(n_nationkey >= 20) AS city FROM (SELECT n_nationkey, substr(n_name, 1, 1) AS key FROM nation) GROUP BY key")
def unit_index(spark, sf_dir):
    """A23 S-13: ids under one key, and whether one is a city by its number."""
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.substring("n_name", 1, 1).alias("key"))
    return nation.groupBy("key").agg(F.count("*").alias("units"), F.sort_array(F.collect_list("n_nationkey")).alias("fips"), F.bool_or(F.col("n_nationkey") >= 20).alias("city"))


_SITES = "(SELECT s_suppkey AS id, 'Group of ' || n_name AS site, CASE WHEN s_suppkey % 5 = 0 THEN 'elsewhere' ELSE lower(n_name) || ' ' END AS label, CAST(s_suppkey AS VARCHAR) AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_EXCEPT = "(SELECT CAST(n * 10 AS VARCHAR) AS key FROM (SELECT unnest(range(1, 60)) AS n))"


def _mismatches(spark, sf_dir):
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = load(spark, sf_dir, "supplier").join(nation, "s_nationkey")
    rows = rows.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Group of "), "n_name").alias("site"), F.when(F.col("s_suppkey") % 5 == 0, "elsewhere").otherwise(F.concat(F.lower("n_name"), F.lit(" "))).alias("label"), F.col("s_suppkey").cast("string").alias("key"))
    short = lambda c: T.squeezed(F.regexp_replace(F.lower(c), r"^group of\b", ""))
    allowed = spark.range(1, 60).select((F.col("id") * 10).cast("string").alias("key"))
    return rows.where(short("site") != short("label")), allowed


@query(f"SELECT id, site, label FROM {_SITES} WHERE label = 'elsewhere' AND key NOT IN (SELECT key FROM {_EXCEPT})")
def group_mismatch(spark, sf_dir):
    """J9 J11 S-27: names that differ, without those that an exception explains."""
    rows, allowed = _mismatches(spark, sf_dir)
    return rows.join(allowed, "key", "left_anti").select("id", "site", "label")


@query(f"SELECT key FROM {_EXCEPT} WHERE key NOT IN (SELECT key FROM {_SITES} WHERE label = 'elsewhere')")
def stale_exceptions(spark, sf_dir):
    """Exceptions that nothing needs any more."""
    rows, allowed = _mismatches(spark, sf_dir)
    return allowed.join(rows, "key", "left_anti")


@query(f"""SELECT c_custkey AS customer, id, CASE WHEN id IS NULL THEN 'no shape' ELSE 'ok' END AS status FROM customer LEFT JOIN (SELECT DISTINCT id FROM {_SEG}) ON id = ['square-', 'circle-', 'ell-'][c_custkey % 3 + 1] || (c_custkey // 3)""")
def shape_join(spark, sf_dir):
    """Properties with their shapes; a missing one is an error."""
    k = F.col("c_custkey")
    wanted = F.concat(F.element_at(F.array(F.lit("square-"), F.lit("circle-"), F.lit("ell-")), (k % 3 + 1).cast("int")), F.floor(k / 3).cast("string"))
    built = _segments(spark, sf_dir).select("id").distinct()
    rows = load(spark, sf_dir, "customer").select(k.alias("customer"), wanted.alias("id")).join(built.withColumn("there", F.lit(True)), "id", "left")
    return rows.select("customer", F.when(F.col("there"), F.col("id")).alias("id"), F.when(F.col("there"), "ok").otherwise("no shape").alias("status"))
