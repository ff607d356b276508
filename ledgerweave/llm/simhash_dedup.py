"""SimHash near-dedup with tiled exact comparison.

Fingerprints are majority bits of shingle hashes.  Distinct fingerprints are
compared exactly in tiles, by exclusive-or and bit counts; tiles whose bit
counts differ by more than the radius are skipped.  Which fingerprints meet in
a tile is decided without loss: of radius + 1 blocks of bits, two fingerprints
within the radius agree on one whole block, so tiles are made within equal
blocks; a block value that many fingerprints have is cut into tiles of bounded
size by bit count, and only pairs of tiles within the radius are compared.

Each task returns a spanning forest of the links that it found, never all pairs.

Nulls and special cases: null or blank text has fingerprint zero, linked like
any other; a null doc_id ranks after every number, and a component that has
only such rows has a null component_id; repeated rows get equal results; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerweave.llm._components import components, local_roots
from ledgerweave.llm._store import Stored, n_partitions
from ledgerweave.llm._words import U64, Words, give_back_memory, groups, pieces

NO_ID = 2**63 - 1
TILE = 8192
SMALL = 48


def fingerprint_rows(rows: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text."""
    w = Words(rows, lower=True)
    joined, off = w.spaced()
    n = np.diff(w.first)
    out = np.zeros(len(rows), dtype=np.uint64)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    has = np.flatnonzero(count)
    if not len(has):
        return out
    count = count[has]
    begin = np.concatenate(([0], np.cumsum(count)[:-1]))
    at = np.repeat(w.first[:-1][has] - begin, count) + np.arange(count.sum())
    end = at + np.repeat(np.minimum(n[has], shingle), count)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(off[at].tolist(), (off[end] - 1).tolist())), dtype=np.uint64, count=len(at))
    ones = np.zeros((len(has), 64), dtype=np.int64)
    step = 1 << 16
    text = np.repeat(np.arange(len(has)), count)
    for k in range(0, len(h), step):
        bits = np.unpackbits(h[k : k + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        t = text[k : k + step]
        cut = groups(t)
        ones[t[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    out[has] = np.packbits((2 * ones > count[:, None]), axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        give_back_memory()
        for batch in batches:
            fps = [fingerprint_rows(rows, shingle, seed) for _, rows in pieces(batch.column(batch.num_columns - 1))]
            fps = np.concatenate(fps) if fps else np.empty(0, np.uint64)
            yield pa.record_batch([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return run


class _Forest:
    """Links gathered as a forest of bounded size."""

    def __init__(self, n: int, most: int = 1 << 21):
        self.n, self.most, self.a, self.b, self.held = n, most, [], [], 0

    def add(self, a, b):
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.held += len(a)
            if self.held > self.most + self.n:
                root = self.roots()
                at = np.flatnonzero(root != np.arange(self.n))
                self.a, self.b, self.held = [at], [root[at]], len(at)

    def roots(self):
        if not self.a:
            return np.arange(self.n)
        return local_roots(self.n, np.concatenate(self.a), np.concatenate(self.b))


def tile_links(fp: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int, add, block: int = 1024) -> None:
    """Compare fingerprints at x with those at y, both sorted by bit count, block by block; x is y compares each pair once."""
    px, py = np.bitwise_count(fp[x]).astype(int), np.bitwise_count(fp[y]).astype(int)
    same = x is y
    for i in range(0, len(x), block):
        a, lo, hi = fp[x[i : i + block]], px[i] - radius, px[min(i + block, len(x)) - 1] + radius
        for j in range(i if same else 0, len(y), block):
            if py[j] > hi or py[min(j + block, len(y)) - 1] < lo:
                continue
            near = np.bitwise_count(a[:, None] ^ fp[y[j : j + block]][None, :]) <= radius
            r, c = np.nonzero(near)
            if same and i == j:
                r, c = r[r < c], c[r < c]
            add(x[i + r], y[j + c])


def _links(radius: int):
    def run(batches):
        give_back_memory()
        cols = [[], [], [], []]
        for batch in batches:
            for c, k in zip(cols, range(4)):
                c.append(batch.column(k).to_numpy(zero_copy_only=False))
        if not cols[0]:
            return
        key, pair, side, fp = (np.concatenate(c) for c in cols)
        fp = fp.view(np.uint64)
        pops = np.bitwise_count(fp)
        order = np.lexsort((pops, side, pair, key))
        key, pair, side, fp = key[order], pair[order], side[order], fp[order]
        values, node = np.unique(fp, return_inverse=True)
        forest = _Forest(len(values))
        at = groups(key * np.int64(1000003) ^ pair)
        size = np.diff(np.append(at, len(key)))
        small = np.repeat(size <= SMALL, size) & (pair < 0)
        s = np.flatnonzero(small)
        group = np.repeat(np.arange(len(at)), size)[s]
        f, nd = fp[s], node[s]
        for d in range(1, SMALL):
            ok = np.flatnonzero(group[d:] == group[:-d])
            if not len(ok):
                break
            near = np.bitwise_count(f[ok] ^ f[ok + d]) <= radius
            forest.add(nd[ok[near]], nd[ok[near] + d])
        for g, n in zip(at[(size > SMALL) | (pair[at] >= 0)], size[(size > SMALL) | (pair[at] >= 0)]):
            add = lambda a, b: forest.add(node[a], node[b])
            idx = np.arange(g, g + n)
            left, right = idx[side[g : g + n] == 0], idx[side[g : g + n] == 1]
            if len(right):
                tile_links(fp, left, right, radius, add)
            else:
                tile_links(fp, left, left, radius, add)
        root = forest.roots()
        moved = np.flatnonzero(root != np.arange(len(values)))
        yield pa.record_batch([pa.array(values[moved].view(np.int64)), pa.array(values[root[moved]].view(np.int64))], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints fp within the radius; not every pair, but every component."""
    spark = fps.sparkSession
    n = n_partitions(spark)
    width = 64 // (radius + 1)
    mask = (1 << width) - 1
    block = [F.lit(k * (1 << width)) + F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit(mask)) for k in range(radius + 1)]
    keyed = fps.select(F.explode(F.array(*block)).alias("key"), "fp")
    counts = keyed.groupBy("key", F.bit_count("fp").alias("pop")).agg(F.count("*").alias("n"))
    heavy = counts.groupBy("key").agg(F.sum("n").alias("all"), F.collect_list(F.struct("pop", "n")).alias("by")).where(F.col("all") > tile)
    tiles = heavy.select("key", F.explode("by").alias("x")).select("key", "x.pop", F.ceil(F.col("x.n") / tile).alias("cuts"))
    each = tiles.select("key", "pop", F.explode(F.sequence(F.lit(0), F.col("cuts").cast("int") - 1)).alias("cut"))
    name = lambda p, c: F.col(p) * F.lit(1 << 20) + F.col(c)
    other = each.toDF("key", "pop2", "cut2")
    pairs = each.join(other, "key").where((F.col("pop2") - F.col("pop")).between(0, radius) & (name("pop2", "cut2") >= name("pop", "cut")))
    pairs = pairs.select("key", F.xxhash64("key", name("pop", "cut"), name("pop2", "cut2")).bitwiseAND(F.lit(NO_ID)).alias("pair"), "pop", "cut", "pop2", "cut2")
    sides = pairs.select("key", "pair", "pop", "cut", F.lit(0).alias("side")).unionAll(
        pairs.where((F.col("pop2") != F.col("pop")) | (F.col("cut2") != F.col("cut"))).select("key", "pair", "pop2", "cut2", F.lit(1))
    )
    known = tiles.groupBy("key").agg(F.lit(True).alias("big"))
    marked = keyed.join(known, "key", "left")
    light = marked.where("big is null").select("key", F.lit(-1).cast("long").alias("pair"), F.lit(0).alias("side"), "fp")
    placed = marked.where("big").withColumn("pop", F.bit_count("fp")).join(tiles, ["key", "pop"])
    placed = placed.withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    dense = placed.join(sides, ["key", "pop", "cut"]).select("key", "pair", "side", "fp")
    return light.unionAll(dense).repartition(n, "key", "pair").select(F.col("key").cast("long"), "pair", "side", "fp").mapInArrow(_links(radius), "a long, b long")


def _judged(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int, radius: int) -> DataFrame:
    """_id, print (hash of the text), fp, root (of the component) and component_id of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("_text"))
    fps = Stored(rows.mapInArrow(_fingerprints(shingle, seed), f"_id {kind}, print long, fp long"), "fingerprints").df
    distinct = Stored(fps.groupBy("fp").agg(F.min("_id").alias("least")), "classes").df
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    class_of = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = class_of.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(class_of.join(first, "root").select("fp", "root", "component_id"), "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """The id, fingerprint (hex) and component_id, the smallest id reachable by links."""
    at = _judged(docs, id_col, text_col, shingle, seed, radius)
    return at.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """Documents without near copies: of each component the row with the smallest id stays (null ids last), all columns kept.

    Of rows of a component that share that id one stays; a component whose rows
    have no ids keeps one of them.
    """
    at = _judged(docs, id_col, text_col, shingle, seed, radius)
    best = at.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "print")).alias("x")).select(F.col("x._id").alias("_keep"), F.col("x.print").alias("_print"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"))
    kept = rows.join(best, rows["_id"].eqNullSafe(best["_keep"]) & (rows["_text"] == best["_print"]), "left_semi")
    return kept.dropDuplicates(["_id", "_text"]).select("_row.*")
