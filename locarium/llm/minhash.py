"""Near duplicates by MinHash with tensored banding, verified on full shingle sets.

Two small collections of half keys are made per document, and every pair of a
half key from each is the key of one table: ``halves ** 2`` tables cost only
``2 * halves * rows`` minhashes. A pair of similarity J misses all tables only if
it shares no half key in one collection: with the standard 14 halves of 2 rows
and J = 0.8, once in a million.

1. One pass makes each document's signature; equal sets become one class, and
   only its smallest id goes on.
2. Half keys that nobody shares, and all but one of those with the same members, are
   dropped before the tables' keys are formed.
3. Members of a table's bucket are linked to its smallest member (a star), and
   the links are confirmed on full sets.
4. Buckets that still hold several components are compared within, first by the
   half keys alone: members of different components that share enough of them form
   clusters (of those of similarity 0.8 fewer than one pair in a million share less
   than the standard 6 of 28). The sets of each cluster are then compared once, all
   with all, as matrix products. Both go by blocks of bounded size, and emit at most
   one row for each member, so that no link between components is lost and no
   table grows with the square of a group.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, give_back, spread, table, text_udf
from .components import connected_components

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    """Hash of a word; remembers up to 100,000 words of up to 64 bytes."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, width: int, words: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word sequences of a width (of all words, if there are
    fewer). Words stand between ASCII white space, with A-Z in lower case."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, n)
    if n < width:
        return np.frombuffer(xxhash.xxh64_digest(h.tobytes(), n), np.uint64).copy()
    out = h[: n - width + 1].copy()
    for k in range(1, width):
        out *= _P
        out += h[k : n - width + 1 + k]
        out ^= out >> np.uint64(32)
    out = _mixed(out)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


class Signer:
    def __init__(self, width: int, halves: int, rows: int, seed: int):
        self.width, self.halves, self.rows, self.words = width, halves, rows, _WordHashes()
        rng = np.random.default_rng(seed)
        self.xor, self.times = (rng.integers(1, 1 << 63, 2 * halves * rows, np.uint64) for _ in range(2))
        self.times |= np.uint64(1)

    def __call__(self, text: str) -> tuple:
        s = shingle_set(text, self.width, self.words)
        if not len(s):
            return 0, None, None, [], []
        least = np.full(len(self.xor), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(s), 2048):
            block = (s[None, k : k + 2048] ^ self.xor[:, None]) * self.times[:, None]
            np.minimum(least, block.min(1), out=least)
        keys = np.zeros(2 * self.halves, np.uint64)
        for row in _mixed(least).reshape(2 * self.halves, self.rows).T:
            keys = _mixed(keys * _P + row)
        keys = (keys >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()
        print1, print2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
        return len(s), print1, print2, keys[: self.halves], keys[self.halves :]


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _confirmed(sets_a: pd.Series, sets_b: pd.Series, num: int, den: int) -> pd.Series:
    load = partial(np.frombuffer, dtype=np.uint64)
    return pd.Series([similar(load(a), load(b), num, den) for a, b in zip(sets_a, sets_b, strict=True)], dtype=bool)


def _joined(label: np.ndarray, at: np.ndarray) -> None:
    """Give all rows of the labels found at these places the smallest of them."""
    found = np.unique(label[at])
    if len(found) > 1:
        label[np.isin(label, found)] = found[0]


def _alike(rows: pd.DataFrame, num: int, den: int, agree: int) -> pd.DataFrame:
    """(a, b): a spanning forest of the pairs of one pair of blocks of a bucket that may be
    similar - of different components, sizes that allow it, and ``agree`` equal half keys."""
    block, comp = rows["block"].to_numpy(), rows["comp"].to_numpy()
    keys, size, reps = np.stack(rows["keys"].to_numpy()), rows["n"].to_numpy(), rows["rep"].to_numpy()
    p, q = rows["p"].iat[0], rows["q"].iat[0]
    values, many = np.unique(comp, return_counts=True)
    odd = comp != values[many.argmax()]  # pairs within the commonest component need no look
    label = np.arange(len(reps))
    sides = [(np.flatnonzero((block == p) & odd), np.flatnonzero(block == q))]
    if p != q:
        sides.append((np.flatnonzero((block == q) & odd), np.flatnonzero((block == p) & ~odd)))
    for left, right in sides:
        turned = np.ascontiguousarray(keys[right].T)
        for i in left:
            same = np.zeros(len(right), np.uint8)
            for k, key in enumerate(keys[i]):
                same += turned[k] == key
            n = size[right]
            may = (same >= agree) & (comp[right] != comp[i]) & (den * np.minimum(n, size[i]) >= num * np.maximum(n, size[i]))
            if may.any():
                _joined(label, np.append(right[may], i))
    met = np.isin(label, np.flatnonzero(np.bincount(label, minlength=len(label)) > 1))
    return pd.DataFrame({"a": reps[met], "b": reps[label[met]]}).astype("int64")


def shared_shingles(first: list[np.ndarray], second: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: a product of 0/1 matrices over the shingles
    that more than one set has, so many columns at a time."""
    sets = first + second
    every, place, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(many > 1) - 1
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    often = many[place] > 1
    row, col = row[often], number[place[often]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(first), len(second)), np.float32)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        low, high = np.searchsorted(col, [start, start + columns])
        there = np.zeros((len(sets), min(columns, int(number[-1]) + 1 - start)), np.float32)
        there[row[low:high], col[low:high] - start] = 1
        out += there[: len(first)] @ there[len(first) :].T
    return out.astype(np.int64)


def _between(rows: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """(a, b): links of one pair of blocks of a cluster that join components."""
    block, comp = rows["block"].to_numpy(), rows["comp"].to_numpy()
    p, q = rows["p"].iat[0], rows["q"].iat[0]
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    left = np.flatnonzero(block == p)
    right = left if p == q else np.flatnonzero(block == q)
    values, place = np.unique(comp, return_inverse=True)
    label = np.arange(len(values))
    if len(values) > 1 and len(left) and len(right):
        both = shared_shingles([sets[i] for i in left], [sets[j] for j in right])
        n = np.array([len(x) for x in sets])
        linked = den * both >= num * (n[left][:, None] + n[right] - both)
        for k, i in enumerate(left):
            to = place[right[linked[k]]]
            _joined(label, np.append(to, place[i]))
    moved = label != np.arange(len(label))
    return pd.DataFrame({"a": values[moved], "b": values[label[moved]]}).astype("int64")


def row_key() -> Column:
    """A hash of doc_id and text, which tells rows of one id apart."""
    return F.xxhash64("doc_id", "text")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100), halves: int = 14, rows: int = 2, agree: int = 6, block: int = 512, most_sent: int = 500_000, seed: int = 5, keys: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if the Jaccard similarity of their sets of distinct
    ``width``-word sequences is at least ``similarity``; component_id is the
    smallest doc_id that links reach, and ``kept`` marks the row that has it.
    A document without words or text has an empty set and is linked with nothing.
    Repeated rows are linked with each other (and each kept, if they have the
    smallest id); a null doc_id never names a component unless no other is in it.
    Texts of any length are taken whole; other columns of docs aren't read; an empty
    table gives an empty one. Sets hold 64-bit hashes of the word sequences, so two
    sequences of one hash (one pair in 2 ** 64) count as equal. ``agree``: equal half keys of a pair worth a
    comparison; ``block``: rows of a block. ``most_sent``: up to so many candidate ids
    are broadcast to find their texts and sets; more are joined by a shuffle. With ``keys`` also
    key (:func:`row_key`) and component, a number that differs where an id that stands on
    several texts names several components (null for an empty set).
    """
    spark, (num, den) = docs.sparkSession, similarity
    scratch = Scratch(spark, "minhash")
    sign = text_udf(partial(Signer, width, halves, rows, seed), "n long, f1 long, f2 long, a array<int>, b array<int>")
    signed = scratch.keep(docs.select("doc_id", row_key().alias("key"), sign("text").alias("s")).select("doc_id", "key", "s.*"))
    # a class is one set, whatever ids its rows have; rep numbers it
    classes = signed.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = scratch.keep(classes.withColumn("rep", F.monotonically_increasing_id()))

    # half keys that at least two classes share; a key is its place and its 32 bits, which shuffles write in few bytes
    half = classes.select("rep", F.posexplode(F.concat("a", "b")).alias("at", "x")).select("rep", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("x").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    first = F.col("key") < halves << 32
    shared = half.groupBy("key").agg(F.count("*").alias("of")).where("of > 1")
    half = scratch.keep(half.join(shared, "key"))
    # of a collection's half keys with the same members one is enough: a pair that shares 9 and 9 has one table's key, not 81
    same = half.groupBy("key", "of").agg(F.min("rep").alias("low"), F.bit_xor(F.xxhash64("rep")).alias("members"))
    same = same.groupBy(first.alias("first"), "of", "low", "members").agg(F.min("key").alias("key"), F.count("*").alias("times"))
    tensor = half.drop("of").join(same.select("key", "first", (F.col("of") * F.col("times")).alias("score")), "key")
    tensor = tensor.groupBy("rep").agg(F.collect_list(F.when(F.col("first"), F.col("key"))).alias("a"), F.collect_list(F.when(~F.col("first"), F.col("key"))).alias("b"), F.sum("score").alias("score"))
    tensor = scratch.keep(tensor.where("size(a) > 0 and size(b) > 0"))
    scratch.drop(half)

    # tables: every pair of half keys; of buckets with the same members one is enough
    keyed = tensor.select("rep", "score", F.explode("a").alias("x"), "b").select("rep", "score", "x", F.explode("b").alias("y")).select("rep", "score", "x", F.xxhash64("x", "y").alias("key"))
    # the center: the member whose half keys most others share, so that most are linked to it
    center = F.max(F.struct("score", (-F.col("rep")).alias("m"), "rep"))["rep"]
    buckets = keyed.groupBy("key").agg(F.count("*").alias("of"), center.alias("center"), F.bit_xor(F.xxhash64("rep")).alias("members")).where("of > 1")
    buckets = buckets.groupBy("of", "center", "members").agg(F.min("key").alias("key"))
    members = scratch.keep(keyed.drop("score").join(buckets.drop("members"), "key"))
    scratch.drop(tensor)

    # full sets of the candidates, from their texts
    wanted = scratch.keep(members.select("rep").distinct().join(classes.select("rep", "key", "f1", "f2"), "rep"))
    sent = lambda ids: F.broadcast(ids) if ids.count() <= most_sent else ids
    found = sent(wanted)

    def full():
        words = _WordHashes()

        def one(text: str) -> tuple:
            s = shingle_set(text, width, words).tobytes()
            p, q = np.frombuffer(xxhash.xxh3_128_digest(s), np.int64).tolist()
            return p, q, s

        return one

    texts = docs.select(row_key().alias("key"), "text").join(found, "key")
    sets = texts.select("rep", "f1", "f2", text_udf(full, "g1 long, g2 long, shingles binary")("text").alias("s")).where("s.g1 = f1 and s.g2 = f2")
    sets = scratch.keep(sets.select("rep", "s.shingles"))
    # rows of one id and text give their set each; only then are the sets shuffled to leave one
    if not sets.groupBy("rep").agg(F.count("*").alias("of")).where("of > 1").isEmpty():
        repeated, sets = sets, scratch.keep(sets.groupBy("rep").agg(F.first("shingles").alias("shingles")))
        scratch.drop(repeated)
    scratch.drop(wanted)

    # stars: every member with the smallest of its bucket
    size = F.length("shingles") / 8
    bounds = sets.select("rep", size.alias("n"))
    stars = members.where("rep <> center").select("rep", "center").distinct()
    stars = stars.join(bounds, "rep").join(bounds.withColumnsRenamed({"rep": "center", "n": "m"}), "center").where(f"{den} * least(n, m) >= {num} * greatest(n, m)").select("rep", "center")
    confirmed = F.pandas_udf(_pair_check(num, den), "boolean").asNondeterministic()
    # members of a large star are dealt to parts, each with the center's set
    stars = scratch.keep(stars)
    parts_of = scratch.keep(stars.groupBy("center").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    centers = sets.withColumnsRenamed({"rep": "center", "shingles": "others"}).join(sent(parts_of), "center").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = scratch.keep(stars.join(parts_of, "center").select("rep", "center", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part")))
    pairs = sets.join(sent(dealt), "rep").join(centers, ["center", "part"])
    links = scratch.keep(pairs.withColumn("ok", confirmed("shingles", "others")).where("ok").select(F.col("rep").alias("a"), F.col("center").alias("b")))
    comp = connected_components(links, scratch)
    scratch.drop(stars, parts_of, dealt, links)

    # buckets that still hold several components, in blocks
    # (those of one center that share a half key go together: a group of copies shares most of its buckets)
    known = members.where("of > 2").select(F.xxhash64("x", "center").alias("key"), "rep").distinct()
    known = scratch.keep(known.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp")))
    scratch.drop(members)
    mixed = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("of")).where("low < high").select("key", "of")
    halves_of = classes.select("rep", "n", F.concat("a", "b").alias("keys"))
    dealt = _dealt(known.join(mixed, "key"), "of", 2 * block, ["key", "rep", "comp"]).join(halves_of, "rep")
    # by an explicit number: few bytes, but much work, which mustn't meet in a few tasks
    parts = spread(docs)
    alike = dealt.repartition(parts, "key", "p", "q").groupBy("key", "p", "q").applyInPandas(lambda rows: _alike(rows, num, den, agree), "a long, b long")
    clusters = connected_components(scratch.keep(alike.distinct()), scratch)
    scratch.drop(known)
    # a cluster's root isn't listed, so it is added
    clusters = scratch.keep(clusters.withColumnsRenamed({"id": "rep", "component": "cluster"}).unionByName(clusters.select(F.col("component").alias("rep"), F.col("component").alias("cluster")).distinct()))
    clusters = clusters.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "cluster", F.coalesce("component", "rep").alias("comp"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("of"))
    clusters = scratch.keep(clusters.join(sizes, "cluster"))
    # the sets of the clusters' members are picked where they are, then dealt
    dealt = _dealt(sets.join(sent(clusters), "rep"), "of", block, ["cluster", "rep", "comp", "shingles"])
    more = dealt.repartition(parts, "cluster", "p", "q").groupBy("cluster", "p", "q").applyInPandas(lambda rows: _between(rows, num, den), "a long, b long")
    over = connected_components(scratch.keep(more.distinct()), scratch)

    named = classes.select("rep", "first", "f1", "f2").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = named.join(over.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("first", "f1", "f2", F.coalesce("top", "component").alias("component"))
    named = scratch.keep(named)
    # the smallest id of each component of several classes
    least = scratch.keep(named.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("of")).where("of > 1").drop("of"))
    named = scratch.keep(named.join(sent(least), "component", "left").select("f1", "f2", "component", F.coalesce("least", "first").alias("name")))
    scratch.only(signed, named)
    give_back()
    out = signed.select("doc_id", "key", "n", "f1", "f2").join(named, ["f1", "f2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"), *(["key", "component"] if keys else []))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _dealt(rows: DataFrame, of: str, block: int, columns: list[str]) -> DataFrame:
    """Deal groups of size ``of`` to blocks, and each member to the pairs (p, q) of its own block and every other."""
    rows = rows.withColumn("blocks", F.ceil(F.col(of) / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(*columns, "block", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"))


def _pair_check(num: int, den: int):
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        return _confirmed(a, b, num, den)

    return check


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


#: Every pair of documents that share a shingle, then components by recursion.
OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN comp c ON s.doc_id = c.x
"""
