"""Exact top-k search as a Voronoi kNN join under the inner product.

Queries and data are grouped by their nearest pivot. The summaries of the groups
(count, radius, largest norm) bound every inner product between two groups:
``p.q + r|q| + s|p| + rs`` for pivots p, q and radii r, s. Each query is first
solved within its own group, which gives the score that it must beat; a data group
is then copied only to the query groups that its bound doesn't rule out, and solved
there, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, table
from .embed_dedup import bounded_sample, codebook, dimension, matrix, usable

_RESULT = "row long, query_id long, vec_id long, score long"


def _solve(rows: pd.DataFrame, width: int, k: int, exact: bool) -> pd.DataFrame:
    """The best k of one block of data for each query of one block of queries: only scores
    that reach the query's bar, ties to the smaller id, never the query's own row."""
    asks = rows["asks"].to_numpy()
    data, queries = rows[~asks], rows[asks]
    if not len(data) or not len(queries):
        return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
    data = data.sort_values("id")
    kind = np.float64 if exact else np.int64
    y, ids, places = matrix(data["v"], width).astype(kind), data["id"].to_numpy(), data["row"].to_numpy()
    bars = queries["bar"].to_numpy(dtype=float, na_value=-np.inf)
    x, own, asked = matrix(queries["v"], width).astype(kind), queries["row"].to_numpy(), queries["id"].to_numpy()
    out_n, out_y, out_s, many = [], [], [], []
    for at in range(0, len(x), 256):
        scores = x[at : at + 256] @ y.T
        for n, row in enumerate(scores, at):
            may = np.flatnonzero((row >= bars[n]) & (places != own[n]))
            if len(may) > k:
                worst = np.partition(row[may], len(may) - k)[len(may) - k]
                may = may[row[may] >= worst]
                may = may[np.argsort(-row[may], kind="stable")][:k]
            many.append(len(may))
            out_y.append(ids[may])
            out_s.append(row[may].astype(np.int64))
    out_n = np.repeat(np.arange(len(x)), many)
    return pd.DataFrame({"row": own[out_n], "query_id": asked[out_n], "vec_id": np.concatenate(out_y), "score": np.concatenate(out_s)}).astype("int64")


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, ident: str = "vec_id", column: str = "embedding", group: int = 2048, most_pivots: int = 1024, sample: int = 16_384, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` picks (a condition on
    the id), the k best of all other rows by the inner product of floor(scale * x).

    Ties go to the smaller id; all rows, if fewer than k. Vectors that are null or hold
    null or non-finite components take no part; shorter ones are filled with zeros. Null ids
    take no part. Rows of one id are rows like any others: each is a candidate of the
    others, and each that is a query gets a list of its own. An empty table gives an empty
    one; other columns aren't read.

    Pivots, one for about ``group`` rows and ``most_pivots`` at most, are taken from at most
    ``sample`` vectors; every row is searched. Groups are dealt to tasks in blocks of up to
    twice ``block`` rows and as many queries, however large they are; fewer, where vectors have
    more than 512 components. What the driver holds and sends is one row for each pivot, with
    a list of pivots at most.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    whole = F.transform(F.col(column), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    rows = vectors.where(F.col(ident).isNotNull() & usable(column)).select(F.col(ident).cast("long").alias("id"), whole.alias("v"))
    peak = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    total, width, most = peak[0], peak[1] or 0, float(peak[2] or 0)
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    exact = width * most * most < 2.0**53  # else 64-bit integers do the sums
    small = "smallint" if most < 32_000 else "int" if most < 2e9 else "long"
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.col("v").cast(f"array<{small}>").alias("v"))
    points = bounded_sample(rows, "id", "v", sample, width)
    pivots = codebook(points, int(min(most_pivots, max(1, total // group))), rounds=4)
    block = max(1, min(block, (1 << 22) // width))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = matrix(pdf["v"], width)
            d = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T
            cell = d.argmin(1)
            yield pdf.assign(cell=cell.astype("int32"), away=np.linalg.norm(x - pivots[cell], axis=1))

    placed = scratch.keep(rows.mapInPandas(place, f"row long, id long, v array<{small}>, cell int, away double"))
    queries = placed.where(is_query(F.col("id")))
    # summaries: a row for each pivot, most_pivots at most
    count, radius, reach, many = (np.zeros(len(pivots)) for _ in range(4))
    for r in placed.groupBy("cell").agg(F.count("*"), F.max("away")).collect():
        count[r[0]], radius[r[0]] = r[1], r[2]
    for r in queries.groupBy("cell").agg(F.count("*"), F.max("away")).collect():
        many[r[0]], reach[r[0]] = r[1], r[2]
    norms, cross = np.linalg.norm(pivots, axis=1), pivots @ pivots.T
    bound = cross + reach[:, None] * norms + norms[:, None] * radius + reach[:, None] * radius

    # query cells are gathered into teams of about `block` queries; a larger cell comes in turns
    team, load = np.zeros(len(pivots), int), many[0]
    for c in range(1, len(pivots)):
        team[c] = team[c - 1] + (load + many[c] > block)
        load = many[c] if team[c] > team[c - 1] else load + many[c]
    turns = np.maximum(1, np.ceil(np.bincount(team, many) / (2 * block))).astype(int)
    blocks = np.maximum(1, np.ceil(count / (2 * block))).astype(int)
    spin = np.maximum(1, np.ceil(many / (2 * block))).astype(int)
    cells = [(c, int(blocks[c]), int(spin[c]), int(team[c]), int(turns[team[c]])) for c in range(len(pivots))]
    cells = F.broadcast(spark.createDataFrame(cells, "cell int, blocks int, spin int, team int, turns int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    no_bar, asks = F.lit(None).cast("double").alias("bar"), F.lit(True).alias("asks")
    solve = lambda rows: _solve(rows, width, k, exact)

    # first within the own group
    data = placed.join(cells, "cell").select("cell", "row", "id", "v", "spin", dealt("blocks").alias("block"))
    own_data = data.select("cell", "block", each("spin").alias("turn"), "row", "id", "v", no_bar, F.lit(False).alias("asks"))
    queries = queries.join(cells, "cell").select("cell", "row", "id", "v", "blocks", "spin", "team", dealt("turns").alias("turn"))
    own_asks = queries.select("cell", each("blocks").alias("block"), dealt("spin").alias("turn"), "row", "id", "v", no_bar, asks)
    near = scratch.keep(own_data.unionByName(own_asks).groupBy("cell", "block", "turn").applyInPandas(solve, _RESULT))
    rank = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    bars = near.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("bar"))
    queries = scratch.keep(queries.select("cell", "row", "id", "v", "team", "turn").join(bars, "row", "left"))

    # a query group needs the data groups whose bound reaches the lowest bar of one of its cells
    low = np.full(len(pivots), np.inf)
    for r in queries.groupBy("cell").agg(F.min(F.coalesce("bar", F.lit(float("-inf"))))).collect():
        low[r[0]] = r[1]
    needed = (bound + 1e-6 * (1 + np.abs(bound)) >= low[:, None]) & (many[:, None] > 0)
    np.fill_diagonal(needed, False)
    best = near
    if needed.any():
        # a block of data goes once to a team (and each of its turns), with the query cells there that need it
        to = [(h, [(int(t), int(turns[t])) for t in np.unique(team[needed[:, h]])]) for h in range(len(pivots)) if needed[:, h].any()]
        to = F.broadcast(spark.createDataFrame(to, "cell int, teams array<struct<team int, turns int>>"))
        sent = data.join(to, "cell").select("cell", "block", "row", "id", "v", F.explode("teams").alias("t")).select("cell", "block", "t.*", "row", "id", "v")
        sent = sent.select(F.col("cell").alias("home"), "block", "team", each("turns").alias("turn"), "row", "id", "v", no_bar, F.lit(False).alias("asks"))
        come = [(c, [(int(h), int(blocks[h])) for h in np.flatnonzero(needed[c])]) for c in range(len(pivots)) if needed[c].any()]
        come = F.broadcast(spark.createDataFrame(come, "cell int, homes array<struct<home int, blocks int>>"))
        come = queries.join(come, "cell").select(F.explode("homes").alias("h"), "team", "turn", "row", "id", "v", "bar").select("h.*", "team", "turn", "row", "id", "v", "bar")
        come = come.select("home", each("blocks").alias("block"), "team", "turn", "row", "id", "v", "bar", asks)
        far = sent.unionByName(come).groupBy("home", "block", "team", "turn").applyInPandas(solve, _RESULT)
        best = near.unionByName(far)
    best = best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
