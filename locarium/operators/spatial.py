"""Points, polygons, edges and grids.

Polygons travel as ``segments``: (id, part, ring, seq, x1, y1, x2, y2), ring 0 being
the outer one. Spatial joins have a grid cell as their equality key, so that they
shuffle by cell and never compare all points with all edges. Spark's estimates don't
count the rows that an explode makes, so a table of edges or cells looks small and would be
broadcast at any size; its joins ask for a shuffle ("merge").
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locarium.functions.geo import crosses, grid_cell, segment_distance

from .lineage import cut


#: A row of cells: beyond any column number, so that no two cells share a label.
_ROW = 1 << 32


def segments_of(features: DataFrame) -> DataFrame:
    """Edges of ``geom`` ARRAY<ARRAY<ARRAY<STRUCT<x,y>>>> (X6); a ring repeats its first vertex at the end."""
    rings = features.select("id", F.posexplode("geom").alias("part", "rings")).select("id", "part", F.posexplode("rings").alias("ring", "v"))
    edges = F.transform(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.struct(i.alias("seq"), F.element_at("v", i).alias("a"), F.element_at("v", i + 1).alias("b")))
    return rings.where("size(v) > 1").select("id", "part", "ring", F.explode(edges).alias("e")).select("id", "part", "ring", F.col("e.seq").alias("seq"), F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def parts_of(segments: DataFrame) -> DataFrame:
    """The bounding box of each part."""
    return segments.where("ring = 0").groupBy("id", "part").agg(F.min("x1").alias("west"), F.min("y1").alias("south"), F.max("x1").alias("east"), F.max("y1").alias("north"))


def _cells(rows: DataFrame, size: float, wider: Column | None = None, higher: float = 0.0) -> DataFrame:
    """One row for each grid cell that the box west..north, made wider and higher, touches."""
    wider = F.lit(0.0) if wider is None else wider
    rows = rows.withColumn("cx", F.explode(F.sequence(grid_cell(F.col("west") - wider, size), grid_cell(F.col("east") + wider, size))))
    return rows.withColumn("cy", F.explode(F.sequence(grid_cell(F.col("south") - higher, size), grid_cell(F.col("north") + higher, size))))


def _with_cell(points: DataFrame, size: float) -> DataFrame:
    return points.withColumn("cx", grid_cell(F.col("x"), size)).withColumn("cy", grid_cell(F.col("y"), size))


def containing(points: DataFrame, segments: DataFrame, cell: float = 2.0) -> DataFrame:
    """(point, id): the polygons around each point (J6, GE2). ``points``: point, x, y.

    Cell, then box, then parity: inside the outer ring an odd number of times, and inside no hole.
    """
    near = _with_cell(points.where("x is not null and y is not null"), cell).join(_cells(parts_of(segments), cell).hint("merge"), ["cx", "cy"])
    near = near.where("x >= west and x <= east and y >= south and y <= north").select("point", "x", "y", "id", "part")
    edges = near.join(segments.hint("merge"), ["id", "part"])
    odd = edges.groupBy("point", "id", "part", "ring").agg((F.sum(crosses(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))) % 2).alias("odd"))
    parts = odd.groupBy("point", "id", "part").agg(F.max(F.when(F.col("ring") == 0, F.col("odd")).otherwise(0)).alias("outer"), F.max(F.when(F.col("ring") > 0, F.col("odd")).otherwise(0)).alias("hole"))
    return parts.where("outer = 1 and hole = 0").select("point", "id").distinct()


def near_edges(points: DataFrame, segments: DataFrame, tolerance: float, cell: float = 2.0) -> DataFrame:
    """(point, id, distance) of polygons with an edge nearer than the tolerance (J7, GE3).

    Edges are put into every cell within the tolerance, so that edges across a cell's border count.
    """
    boxes = segments.select("id", "x1", "y1", "x2", "y2", F.least("x1", "x2").alias("west"), F.least("y1", "y2").alias("south"), F.greatest("x1", "x2").alias("east"), F.greatest("y1", "y2").alias("north"))
    # a degree of longitude is shorter than one of latitude, most so at the end nearer to a pole; at the pole itself all of them are near
    pole = F.greatest(F.abs("south"), F.abs("north")) + tolerance
    wider = F.least(F.lit(360.0), F.when(pole < 90, F.lit(tolerance) / F.cos(F.radians(pole))).otherwise(360.0))
    near = _with_cell(points.where("x is not null and y is not null"), cell).join(_cells(boxes, cell, wider, tolerance).hint("merge"), ["cx", "cy"])
    distance = segment_distance(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))
    return near.withColumn("distance", distance).where(F.col("distance") < tolerance).groupBy("point", "id").agg(F.min("distance").alias("distance"))


def assigned(points: DataFrame, segments: DataFrame, tolerance: float, cell: float = 2.0) -> DataFrame:
    """(point, id, how): the polygons around a point, else those with an edge near it."""
    inside = containing(points, segments, cell)
    rest = points.join(inside.select("point").distinct().hint("merge"), "point", "left_anti")
    edge = near_edges(rest, segments, tolerance, cell)
    return inside.withColumn("how", F.lit("inside")).unionByName(edge.select("point", "id").withColumn("how", F.lit("edge")))


def ring_areas(segments: DataFrame) -> DataFrame:
    """Signed shoelace area of each ring (GE4)."""
    return segments.groupBy("id", "part", "ring").agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))


def largest_parts(segments: DataFrame) -> DataFrame:
    """The largest part of each polygon by its outer ring, the first of equal ones."""
    areas = ring_areas(segments).where("ring = 0").withColumn("area", F.abs("area"))
    order = Window.partitionBy("id").orderBy(F.desc("area"), "part")
    return areas.withColumn("n", F.row_number().over(order)).where("n = 1").select("id", "part", "area")


def centroids(segments: DataFrame, digits: int = 1) -> DataFrame:
    """Mean vertex of each part, rounded as a key (GE5)."""
    return segments.where("ring = 0").groupBy("id", "part").agg(F.round(F.avg("x1"), digits).alias("x"), F.round(F.avg("y1"), digits).alias("y"))


def sample_grid(spark, west: float, south: float, nx: int, ny: int, step: float, offset: float) -> DataFrame:
    """Sample points of a grid (GE12): (point, gx, gy, x, y), made on the executors."""
    cells = spark.range(nx * ny).select(F.col("id").alias("point"), (F.col("id") % nx).cast("int").alias("gx"), F.floor(F.col("id") / nx).cast("int").alias("gy"))
    return cells.withColumn("x", F.lit(west + offset) + F.col("gx") * F.lit(step)).withColumn("y", F.lit(south + offset) + F.col("gy") * F.lit(step))


def overlaps(hits: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b, points, x, y): pairs of polygons that share sample points, with the first."""
    many = hits.groupBy("point").agg(F.array_sort(F.collect_set("id")).alias("ids")).where("size(ids) > 1")
    i = F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = many.select("point", F.explode(F.flatten(i)).alias("p")).join(points, "point")
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("points"), F.min_by("x", "point").alias("x"), F.min_by("y", "point").alias("y"))


def uncovered(points: DataFrame, hits: DataFrame) -> DataFrame:
    """Sample points in no polygon."""
    return points.join(hits, "point", "left_anti")


def grid_components(cells: DataFrame) -> DataFrame:
    """(gx, gy, component): 4-neighbour components (GE13); component is the smallest cell's gy * 2 ** 32 + gx.

    Every cell takes the smallest label around, and then its label's own label, until nothing changes.
    """
    label = F.col("gy").cast("long") * _ROW + F.col("gx")
    now = cut(cells.select("gx", "gy", label.alias("component")))
    moves = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    while True:
        around = now.withColumn("m", moves).select((F.col("gx") + F.col("m.dx")).alias("gx"), (F.col("gy") + F.col("m.dy")).alias("gy"), "component")
        best = around.groupBy("gx", "gy").agg(F.min("component").alias("least"))
        step = now.join(best, ["gx", "gy"])
        # a component's own cell may have moved on: follow it
        jump = step.select(label.alias("least"), F.col("least").alias("further"))
        new = cut(step.join(jump, "least", "left").select("gx", "gy", "component", F.least("least", "further").alias("now")))
        if not new.where("now <> component").take(1):
            return new.select("gx", "gy", "component")
        now = new.select("gx", "gy", F.col("now").alias("component"))


def vertex_owners(segments: DataFrame) -> DataFrame:
    """Which polygons share each exact vertex."""
    return segments.groupBy(F.col("x1").alias("x"), F.col("y1").alias("y")).agg(F.array_sort(F.collect_set("id")).alias("owners"))


def island_parts(segments: DataFrame) -> DataFrame:
    """Parts other than the largest that share no vertex with another polygon."""
    shared = vertex_owners(segments).where("size(owners) > 1").select(F.col("x").alias("x1"), F.col("y").alias("y1"))
    touching = segments.join(shared, ["x1", "y1"], "left_semi").select("id", "part").distinct()
    parts = segments.select("id", "part").distinct()
    return parts.join(largest_parts(segments).select("id", "part"), ["id", "part"], "left_anti").join(touching, ["id", "part"], "left_anti")


def dissolved_edges(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges of each group's union (A16): an edge that two members share cancels out. ``groups``: id, group."""
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") <= F.col("y2")))
    ends = {n: F.when(forward, F.col(a)).otherwise(F.col(b)) for n, a, b in (("ax", "x1", "x2"), ("ay", "y1", "y2"), ("bx", "x2", "x1"), ("by", "y2", "y1"))}
    edges = segments.join(groups, "id").select("group", *[c.alias(n) for n, c in ends.items()])
    return edges.groupBy("group", "ax", "ay", "bx", "by").agg(F.count("*").alias("uses")).where("uses % 2 = 1").drop("uses")


def stitched(edges: DataFrame) -> DataFrame:
    """(group, ring, seq, x, y): rings of dissolved edges, one group at a time; a group is one area's outline."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left: dict[tuple, list[tuple]] = {}
        for a, b in sorted(zip(zip(rows["ax"], rows["ay"], strict=True), zip(rows["bx"], rows["by"], strict=True), strict=True)):
            left.setdefault(a, []).append(b)
            left.setdefault(b, []).append(a)
        out, ring = [], 0
        while left:
            start = at = min(left)
            seq = 0
            while True:
                out.append((rows["group"].iat[0], ring, seq, *at))
                to = min(left[at])
                for u, v in ((at, to), (to, at)):
                    left[u].remove(v)
                    if not left[u]:
                        del left[u]
                at, seq = to, seq + 1
                if at == start or at not in left:
                    break
            ring += 1
        return pd.DataFrame(out, columns=["group", "ring", "seq", "x", "y"])

    kind = dict(edges.dtypes)["group"]
    return edges.groupBy("group").applyInPandas(run, f"group {kind}, ring int, seq int, x double, y double")


#: Pairs of a square and an edge that are computed at a time.
_PAIRS = 1 << 17


def _from_edges(p, x, y, first, count, edges) -> np.ndarray:
    """For squares around (x, y) in polygons p: the distance of the centre to the nearest edge, negative outside.
    A polygon's edges are ``count`` from ``first`` on."""
    out, ends, start = np.empty(len(p)), np.cumsum(count[p]), 0
    while start < len(p):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _PAIRS, "right")))
        lens = count[p[start:stop]]
        begins = np.cumsum(lens) - lens
        x1, y1, dx, dy, rise, length = edges[:, np.arange(lens.sum()) + np.repeat(first[p[start:stop]] - begins, lens)]
        px, py = np.repeat(x[start:stop], lens) - x1, np.repeat(y[start:stop], lens)
        spans = (y1 > py) != (y1 + dy > py)
        py = py - y1
        odd = np.logical_xor.reduceat(spans & (px < dx * py / rise), begins)
        t = ((px * dx + py * dy) / length).clip(0, 1)
        least = np.sqrt(np.fmin.reduceat((px - t * dx) ** 2 + (py - t * dy) ** 2, begins))
        out[start:stop] = np.where(odd, least, -least)
        start = stop
    return out


def _labels(first: np.ndarray, x1, y1, x2, y2, precision: float) -> tuple[np.ndarray, np.ndarray]:
    """The label points of polygons whose edges begin at ``first``, all refined at once."""
    count = np.diff(np.append(first, len(x1)))
    scale = np.array([max(1e-6, math.cos(math.radians(v))) for v in y1[first]])
    x1, x2 = x1 * np.repeat(scale, count), x2 * np.repeat(scale, count)
    dx, dy = x2 - x1, y2 - y1
    edges = np.array([x1, y1, dx, dy, dy + (dy == 0), (dx * dx + dy * dy) + ((dx == 0) & (dy == 0))])
    west, south, east, north = np.fmin.reduceat(x1, first), np.fmin.reduceat(y1, first), np.fmax.reduceat(x1, first), np.fmax.reduceat(y1, first)
    half = np.fmax(np.fmin(east - west, north - south) / 2, precision)
    todo = []
    for k, (w, s, e, n, h) in enumerate(zip(*(v.tolist() for v in (west, south, east, north, half)), strict=True)):
        x = w + h
        while x < e + h:
            y = s + h
            while y < n + h:
                todo.append((k, x, y, h))
                y += 2 * h
            x += 2 * h
    p, x, y, h = np.array(todo, dtype=float).reshape(-1, 4).T
    p = p.astype(np.int64)
    best, best_x, best_y = np.full(len(first), -np.inf), (west + east) / 2, (south + north) / 2
    while len(p):
        d = _from_edges(p, x, y, first, count, edges)
        order = np.lexsort((y, x, d, p))
        top = order[np.append(p[order][1:] != p[order][:-1], True)]
        q = p[top]
        better = (d[top] > best[q]) | ((d[top] == best[q]) & ((x[top] > best_x[q]) | ((x[top] == best_x[q]) & (y[top] > best_y[q]))))
        q, top = q[better], top[better]
        best[q], best_x[q], best_y[q] = d[top], x[top], y[top]
        more = d + h * 2**0.5 > best[p] + precision
        p, h = np.repeat(p[more], 4), np.repeat(h[more] / 2, 4)
        x = np.repeat(x[more], 4) + np.tile([-1, -1, 1, 1], len(p) // 4) * h
        y = np.repeat(y[more], 4) + np.tile([-1, 1, -1, 1], len(p) // 4) * h
    return np.round(best_x / scale, 4), np.round(best_y, 4)


def label_points(segments: DataFrame, precision: float = 0.005) -> DataFrame:
    """(id, x, y): the point of each polygon's largest part that is farthest from its edges (GE7), by
    refining the best squares of a grid; 4 decimals. Distances are true to scale at the part's first vertex.

    Edges come sorted by polygon, and all polygons of a batch are refined together; one that several batches hold waits
    for its last edge."""

    def starts(ids: pa.Array) -> np.ndarray:
        codes = ids.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))

    def labelled(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        first = starts(rows["id"])
        x, y = _labels(first, *(rows[c].to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")), precision)
        return pa.RecordBatch.from_arrays([rows["id"].take(pa.array(first)), pa.array(x), pa.array(y)], ["id", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(starts(batch["id"])[-1])
            if held and (last or held[0]["id"][0] != batch["id"][0]):
                yield labelled([*held, *([batch[:last]] if last else [])])
                held = []
            elif last:
                yield labelled([batch[:last]])
            held.append(batch[last:])
        if held:
            yield labelled(held)

    largest = segments.join(largest_parts(segments).select("id", "part").hint("merge"), ["id", "part"], "left_semi")
    kind = dict(segments.dtypes)["id"]
    edges = largest.repartition("id").sortWithinPartitions("id", "ring", "seq").select("id", "x1", "y1", "x2", "y2")
    return edges.mapInArrow(run, f"id {kind}, x double, y double")


def interior_points(segments: DataFrame, most: int = 200) -> DataFrame:
    """(id, part, ring, x, y): a point inside each ring (GE6): the first of a grid of 4, 8, 16... by as many that is
    inside, from west to east and then from south to north; the mean vertex, if none below ``most`` is."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x1, y1, x2, y2 = (rows[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
        rise = np.where(y2 != y1, y2 - y1, 1.0)
        west, east, south, north, n, found = x1.min(), x1.max(), y1.min(), y1.max(), 4, (x1.mean(), y1.mean())
        while n < most:
            k = np.arange(1, n)
            y = south + (north - south) * k / n
            spans = (y1 > y[:, None]) != (y2 > y[:, None])
            at = (x2 - x1) * (y[:, None] - y1) / rise + x1
            inside = np.array([((spans & (x < at)).sum(1) % 2).astype(bool) for x in west + (east - west) * k / n])
            if inside.any():
                i, j = np.argwhere(inside)[0]
                found = (west + (east - west) * (i + 1) / n, y[j])
                break
            n *= 2
        return pd.DataFrame({"id": [rows["id"].iat[0]], "part": [rows["part"].iat[0]], "ring": [rows["ring"].iat[0]], "x": [found[0]], "y": [found[1]]})

    kinds = dict(segments.dtypes)
    return segments.groupBy("id", "part", "ring").applyInPandas(run, f"id {kinds['id']}, part {kinds['part']}, ring {kinds['ring']}, x double, y double")


def zoom_clusters(places: DataFrame, zoom: int, pixels: int = 40) -> DataFrame:
    """Counts of places by squares of a Web Mercator map (A19): a documented approximation of greedy clusters."""
    world = 256 * 2**zoom
    px = (F.col("lon") + 180) / 360 * world
    py = (F.lit(0.5) - F.log(F.tan(F.lit(0.7853981633974483) + F.radians("lat") / 2)) / (2 * 3.141592653589793)) * world
    cells = places.where("lat is not null and lon is not null").select(F.floor(px / pixels).alias("cx"), F.floor(py / pixels).alias("cy"))
    return cells.groupBy("cx", "cy").agg(F.count("*").alias("places"))


def unit_keys(entries: DataFrame, key) -> DataFrame:
    """(group, key) of ``"Name, ST"`` entries, exploded."""
    rows = entries.select("group", F.explode("entries").alias("entry"))
    name, state = F.trim(F.substring_index("entry", ",", 1)), F.trim(F.element_at(F.split("entry", ","), -1))
    return rows.select("group", "entry", key(state, name).alias("key"))
