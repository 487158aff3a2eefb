"""Near duplicates among embeddings by an inverted multi-index.

Each half of a normalised vector has a codebook of its own; the product of the
two is a grid of cells, and each vector lies in one. A multi-sequence traversal
lists, for a vector, the nearest cells in order of the summed half distances; it
goes on until it has met a partner at the threshold with the target recall. The
candidates met are verified by cosine in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, table
from .components import connected_components


def dimension(vectors: DataFrame, column: str) -> int:
    """The longest vector's length; shorter ones are taken as filled with zeros."""
    return vectors.agg(F.max(F.size(column))).first()[0] or 0


def usable(column: str):
    """Not null, not empty, no null or non-finite component."""
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; vectors travel as they came and are divided where they are used."""
    scale = np.abs(x).max(1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """The vectors as rows of doubles, filled with zeros to a width."""
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def bounded_sample(vectors: DataFrame, ident: str, column: str, most: int, width: int, seed: int = 3) -> np.ndarray:
    """At most ``most`` vectors, chosen by a hash of their ids."""
    rows = vectors.select(ident, F.col(column).cast("array<double>").alias("v")).orderBy(F.xxhash64(ident, F.lit(seed)), ident).limit(most).toArrow()
    return matrix(pd.Series(rows["v"].to_pylist()), width)


def codebook(points: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Lloyd's k-means on a sample."""
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = (((centers**2).sum(1) - 2 * points @ centers.T)).argmin(1)
        total = np.zeros_like(centers)
        np.add.at(total, near, points)
        many = np.bincount(near, minlength=len(centers))
        centers = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], centers)
    return centers


def along(centers: np.ndarray) -> np.ndarray:
    """The centers in order of their widest direction, so that neighbours have near numbers."""
    moved = centers - centers.mean(0)
    return centers[np.argsort(moved @ np.linalg.svd(moved, full_matrices=False)[2][0], kind="stable")] if len(centers) > 2 and moved.size else centers


class MultiIndex:
    """The grid of two codebooks; its cells are gathered into ``side`` by ``side`` tiles."""

    def __init__(self, sample: np.ndarray, words: int, side: int = 1):
        self.cut, self.side = sample.shape[1] // 2, side
        self.books = [along(codebook(sample[:, : self.cut], words)), along(codebook(sample[:, self.cut :], words, seed=2))]
        self.width = len(self.books[1])

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        parts = x[:, : self.cut], x[:, self.cut :]
        return [np.maximum(0, (p**2).sum(1)[:, None] + (b**2).sum(1) - 2 * p @ b.T) for p, b in zip(parts, self.books, strict=True)]

    def tile(self, cells: np.ndarray) -> np.ndarray:
        i, j = cells // self.width, cells % self.width
        return i * self.side // len(self.books[0]) * self.side + j * self.side // self.width

    def traverse(self, a: np.ndarray, b: np.ndarray) -> Iterator[int]:
        """Cells in order of a[i] + b[j]: a heap over two sorted lists."""
        ra, rb = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, seen = [(a[ra[0]] + b[rb[0]], 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(ra[i]) * self.width + int(rb[j])
            for u, v in ((i + 1, j), (i, j + 1)):
                if u < len(ra) and v < len(rb) and (u, v) not in seen:
                    seen.add((u, v))
                    heapq.heappush(heap, (a[ra[u]] + b[rb[v]], u, v))

    def probes(self, sample: np.ndarray, least: float, recall: float, seed: int = 4) -> int:
        """Cells to visit until, of a pair of cosine ``least`` in a random direction, one meets the
        other's cell with the recall. Measured on the sample, each vector with a partner made for
        it; nearer partners are met sooner.
        """
        rng = np.random.default_rng(seed)
        noise = rng.standard_normal(sample.shape)
        noise -= (noise * sample).sum(1)[:, None] * sample
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-300)[:, None]
        own, other = self.distances(sample), self.distances(least * sample + np.sqrt(1 - least**2) * noise)
        place = np.minimum(self._place(own, other), self._place(other, own))
        return int(np.quantile(place, recall, method="higher")) + 1

    @staticmethod
    def _place(of: list[np.ndarray], to: list[np.ndarray]) -> np.ndarray:
        """For each row, how many cells come before the other's cell in its traversal."""
        k = np.arange(len(of[0]))
        score = of[0][k, to[0].argmin(1)] + of[1][k, to[1].argmin(1)]
        first = np.sort(of[1], 1)
        return np.array([np.searchsorted(first[n], score[n] - of[0][n]).sum() for n in k])


def _linked(rows: pd.DataFrame, width: int, least: float) -> pd.DataFrame:
    """Links within one block of a tile: counts by vector, and a spanning forest.

    ``rows`` has the vectors that lie here (``asks`` false) and those that visit (true), with the
    cells they visit (all of them, or those of this tile). A pair counts for the visitor, and for
    the visited too unless that one visits the visitor's cell itself.
    """
    asks = rows["asks"].to_numpy()
    here, there = rows[~asks].sort_values("home"), rows[asks]
    if not len(here) or not len(there):
        return pd.DataFrame({"rep": [], "n": [], "root": []}).astype("int64")
    y, x = unit(matrix(here["v"], width)), unit(matrix(there["v"], width))
    ids_y, ids_x, w_y, w_x = here["rep"].to_numpy(), there["rep"].to_numpy(), here["copies"].to_numpy(), there["copies"].to_numpy()
    n_y, n_x = np.zeros(len(y), np.int64), np.zeros(len(x), np.int64)
    ids, node = np.unique(np.concatenate([ids_x, ids_y]), return_inverse=True)
    node_x, node_y, label = node[: len(x)], node[len(x) :], np.arange(len(ids))
    home_y, home_x = here["home"].to_numpy(), there["home"].to_numpy()
    back = [np.frombuffer(c, np.int32) for c in here["cells"]]  # what those here visit
    visit = [np.frombuffer(c, np.int32) for c in there["cells"]]
    who, cell = np.repeat(np.arange(len(x)), [len(c) for c in visit]), np.concatenate(visit)
    order = np.argsort(cell, kind="stable")
    who, cell = who[order], cell[order]
    for c in np.unique(home_y):
        low, high = np.searchsorted(home_y, [c, c + 1])
        start, stop = np.searchsorted(cell, [c, c + 1])
        if start == stop:
            continue
        homes, home = np.unique(home_x[who[start:stop]], return_inverse=True)
        met = np.zeros((len(homes), high - low), bool)
        for k in range(low, high):
            met[np.isin(homes, back[k], assume_unique=True), k - low] = True
        for at in range(start, stop, 1024):
            some = who[at : min(at + 1024, stop)]
            cosine = x[some] @ y[low:high].T
            hit = (cosine >= least - 1e-9) & (ids_x[some][:, None] != ids_y[low:high])
            for i, j in zip(*np.nonzero(hit & (np.abs(cosine - least) < 1e-9)), strict=True):
                hit[i, j] = float(np.dot(x[some[i]], y[low + j])) >= least
            n_x[some] += hit @ w_y[low:high]
            n_y[low:high] += (hit & ~met[home[at - start : at - start + len(some)]]).T @ w_x[some]
            for i in np.flatnonzero(hit.any(1)):
                found = np.unique(label[np.append(node_y[low:high][hit[i]], node_x[some[i]])])
                if len(found) > 1:
                    label[np.isin(label, found)] = found[0]
    n = np.bincount(node_x, n_x, len(ids)) + np.bincount(node_y, n_y, len(ids))
    # of a pair that counts for one only, the other is still in the forest
    keep = (n > 0) | (np.bincount(label, minlength=len(ids))[label] > 1)
    return pd.DataFrame({"rep": ids[keep], "n": n[keep].astype("int64"), "root": ids[label[keep]]}).astype("int64")


def similar_vectors(vectors: DataFrame, ident: str = "vec_id", column: str = "embedding", group: str = "label", least: float = 0.93, recall: float = 0.999, cell: int = 128, most_words: int = 1024, sample: int = 20_000, block: int = 4096, most_sent: int = 200_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: links are pairs of rows of equal, non-null
    group whose cosine is ``least`` or more.

    Rows of equal group and vector form one class that goes on once; they are linked with
    each other. Null or zero vectors, and those with null or non-finite components, link with
    nothing; nor do rows of null group or null id. Shorter vectors are filled with zeros. Rows of
    one id are compared like any others. An empty table gives an empty one; other columns
    aren't read.

    Each group has a grid for its own size: words of the two codebooks for about ``cell`` distinct
    vectors in each cell, as a power of two, ``most_words`` at most (then the cells get fuller); a
    group of up to ``cell`` vectors is one cell. The codebooks are fitted on at most ``sample``
    vectors; every vector is in the index. Neighbouring cells go to one task as a tile of about
    ``block`` vectors, so that a visitor is sent once for all its cells there; larger tiles are
    dealt out in blocks. Up to ``most_sent`` rows of sizes are broadcast; more are joined by a shuffle.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    sent = lambda df: F.broadcast(df) if df.count() <= most_sent else df
    rows = vectors.select(F.col(ident).alias("id"), F.col(group).alias("g"), F.when(usable(column), F.col(column)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = rows.withColumn("norm", norm).withColumn("live", F.col("id").isNotNull() & F.col("g").isNotNull() & F.coalesce(F.col("norm") > 0, F.lit(False)) & F.coalesce(F.col("norm") < float("inf"), F.lit(False)))
    rows = rows.select("id", "g", "v", "live", *(F.when(F.col("live"), F.xxhash64(F.lit(k), "v")).alias(f"f{k}") for k in (1, 2)))
    known = scratch.keep(rows.select("id", "g", "live", "f1", "f2", F.when(F.col("live"), F.size("v")).alias("d")))
    sizes = scratch.keep(known.where("live").groupBy("g").agg(F.countDistinct("f1", "f2").alias("n"), F.max("d").alias("d")))
    level = F.least(F.greatest(F.round(F.log2(F.col("n") / cell) / 2), F.lit(0)), F.lit(int(np.log2(most_words)))).cast("int")
    sizes = sizes.select("g", level.alias("level"), "d")
    there = sizes.groupBy("level").agg(F.max("d").alias("d")).collect()  # a row for each power of two
    if not there:
        return known.select(F.col("id").alias(ident), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    width = max(r["d"] for r in there)
    fit = np.unique(unit(bounded_sample(rows.where("live"), "id", "v", sample, width)), axis=0)
    fit = fit[np.random.default_rng(6).permutation(len(fit))]
    indexes = {}
    for r in there:
        words = 1 << r["level"]
        index = MultiIndex(fit, words, max(1, round(words * (cell / block) ** 0.5)))
        indexes[r["level"]] = index, index.probes(fit[:2000], least, recall)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            home, tile = np.zeros(len(pdf), np.int32), np.zeros(len(pdf), np.int32)
            cells, tiles, spots = ([None] * len(pdf) for _ in range(3))
            for k, (index, probes) in indexes.items():
                at = np.flatnonzero(pdf["level"].to_numpy() == k)
                if not len(at):
                    continue
                for n, a, b in zip(at, *index.distances(unit(matrix(pdf["v"].iloc[at], width))), strict=True):
                    seen = np.fromiter((c for c, _ in zip(index.traverse(a, b), range(probes))), np.int32)
                    of = index.tile(seen)
                    home[n], tile[n], cells[n], tiles[n] = seen[0], of[0], seen.tobytes(), np.unique(of)
                    spots[n] = [seen[of == t].tobytes() for t in tiles[n]]
            yield pdf.drop(columns="level").assign(home=home, tile=tile, cells=cells, tiles=tiles, spots=spots)

    kind = dict(rows.dtypes)
    classes = rows.where("live").groupBy("g", "f1", "f2").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = classes.join(sent(sizes.where("level > 0").select("g", "level")), "g", "left").na.fill(0, ["level"])
    classes = classes.select("g", "f1", "f2", "first", "copies", "v", "level", F.monotonically_increasing_id().alias("rep"))
    placed = scratch.keep(classes.mapInPandas(place, f"g {kind['g']}, f1 long, f2 long, first {kind['id']}, copies long, v {kind['v']}, rep long, home int, tile int, cells binary, tiles array<int>, spots array<binary>"))
    # tiles with their blocks of vectors and of visitors
    homes = placed.groupBy("g", "tile").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asked = placed.select("g", F.explode("tiles").alias("tile")).groupBy("g", "tile").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("turns"))
    sized = sent(scratch.keep(homes.join(asked, ["g", "tile"])))
    columns = ["g", "tile", "part", "turn", "rep", "copies", "v", "home", "cells", "asks"]
    part, turn = F.pmod(F.xxhash64("rep"), "blocks").cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), "turns").cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = placed.join(sized, ["g", "tile"]).withColumn("part", part).withColumn("turn", each("turns")).withColumn("asks", F.lit(False)).select(columns)
    visits = placed.select("g", "rep", "copies", "v", "home", F.explode(F.arrays_zip("tiles", "spots")).alias("t")).select("g", "rep", "copies", "v", "home", F.col("t.tiles").alias("tile"), F.col("t.spots").alias("cells"))
    visits = visits.join(sized, ["g", "tile"]).withColumn("turn", turn).withColumn("part", each("blocks")).withColumn("asks", F.lit(True)).select(columns)
    found = here.unionByName(visits).groupBy("g", "tile", "part", "turn").applyInPandas(lambda rows: _linked(rows, width, least), "rep long, n long, root long")
    found = scratch.keep(found)
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("id", "rep")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = placed.select("g", "f1", "f2", "first", "copies", "rep").join(counts, "rep", "left").join(comp, "rep", "left")
    named = scratch.keep(named.select("g", "f1", "f2", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    scratch.only(known, named)
    least_id = named.groupBy("component").agg(F.min("first").alias("least"))
    named = named.join(least_id, "component").select("g", "f1", "f2", "n_links", "least")
    out = known.select("id", "g", "f1", "f2").join(named, ["g", "f1", "f2"], "left")
    out = out.select(F.col("id").alias(ident), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    return out.withColumn("kept", F.col(ident).eqNullSafe(F.col("component_id")))


def op8_embed_dedup(spark, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE live AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM live a JOIN live b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = e.vec_id
"""
