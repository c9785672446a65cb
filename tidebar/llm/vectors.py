"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and cut into cells of one width; `k` cells make a
bucket, `tables` buckets hash a vector. k grows with the logarithm of the number of vectors, so that about BUCKET
unrelated (orthogonal) vectors share a bucket at every size; the tables follow from k, so that a pair exactly at the
threshold misses all of them with MISS at most, closer pairs less.

Buckets are met twice. First with a sketch of each vector, the signs of 192 random projections: a vector without another
whose sketch is near its own (sketch_limit; a pair exactly at cosine 0.9 is missed so with 3.2e-6, closer pairs less, at
a threshold of 0.999 with 1e-4) goes no further. The others travel whole and are compared by cosine in double precision.
A pair is counted in the first table where it meets. Equal vectors are one class with a size; buckets beyond BLOCK vectors are
compared block against block, so neither pairs are emitted nor a group is unbounded.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, groups, spanning_forest
from .shared import cut, partitions

WIDTH, BUCKET, BLOCK, MISS, BITS, TILE = 2.0, 1024, 2048, 7e-4, 192, 256
WORDS = [f"s{i}" for i in range(BITS // 64)]


def cell_probability(distance: float, width: float) -> float:
    """That two points at this distance share a cell of one Gaussian projection."""
    if distance == 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def shape(n: int, threshold: float, k: int | None = None, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """(cells of a bucket, tables) for n vectors."""
    if k is None:
        k = max(1, math.ceil(math.log(max(n, 1) / BUCKET) / -math.log(cell_probability(math.sqrt(2), width))))
    met = cell_probability(math.sqrt(2 - 2 * min(threshold, 1)), width) ** k
    return k, 1 if met == 1 else math.ceil(math.log(miss) / math.log1p(-met))


def sketch_limit(threshold: float) -> int:
    """Signs in which the sketches of two vectors at the threshold differ, 5 standard deviations above the mean."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.floor(BITS * p + 5 * math.sqrt(BITS * p * (1 - p)))


@lru_cache(maxsize=8)
def _directions(dim: int, k: int, tables: int, width: float):
    rng = np.random.default_rng(dim * 1_000_003 + 17)
    return rng.standard_normal((dim, tables * k)), rng.uniform(0, width, tables * k), rng.integers(1, 2**62, k, dtype=np.int64) | 1


@lru_cache(maxsize=8)
def _signs(dim: int):
    return np.random.default_rng(dim * 1_000_003 + 18).standard_normal((dim, BITS))


def bucket_keys(vectors: np.ndarray, k: int, tables: int, width: float = WIDTH) -> np.ndarray:
    """(n x tables) 32-bit bucket keys of n normalised vectors."""
    a, b, mix = _directions(vectors.shape[1], k, tables, width)
    cells = np.floor((vectors @ a + b) / width).astype(np.int64).reshape(len(vectors), tables, k)
    return ((cells * mix).sum(axis=2) >> 24).astype(np.int32)


def sketches(vectors: np.ndarray) -> np.ndarray:
    """(n x WORDS) 64-bit words of signs."""
    return np.packbits(vectors @ _signs(vectors.shape[1]) > 0, axis=1).view(np.uint64)


def normalise(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrices(column: pa.ListArray):
    """(rows, their normalised vectors in double precision) for each length of vectors."""
    edges, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(edges)
    for dim in np.unique(size).tolist():
        own = np.flatnonzero(size == dim)
        yield own, normalise(flat[edges[own][:, None] + np.arange(dim)])


def plausible(sketch: np.ndarray, block: np.ndarray, across: bool, limit: int) -> np.ndarray:
    """Which of the vectors have another (of another block, if across) whose sketch differs in at most `limit` signs."""
    out = np.zeros(len(sketch), bool)
    for lo in range(0, len(sketch), TILE):
        part = sketch[lo : lo + TILE]
        apart = sum(np.bitwise_count(part[:, None, w] ^ sketch[None, :, w]) for w in range(sketch.shape[1]))
        near = apart <= limit
        if across:
            near &= block[lo : lo + TILE, None] != block[None, :]
        else:
            near[np.arange(len(part)), lo + np.arange(len(part))] = False
        out[lo : lo + TILE] = near.any(axis=1)
    return out


def compare(table: int, near: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """near: which vectors are linked, without the diagonal. Weight of each vector's links that meet here first; a spanning forest of all links."""
    weight = np.zeros(len(near), np.int64)
    i, j = np.nonzero(np.triu(near))
    for lo in range(0, len(i), 1 << 16):
        a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        new = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
        np.add.at(weight, a[new], sizes[b[new]])
        np.add.at(weight, b[new], sizes[a[new]])
    return weight, spanning_forest(near)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, k: int | None = None, width: float = WIDTH, miss: float = MISS) -> DataFrame:
    """All rows as (id, n_links, component_id, kept).

    n_links: other rows whose cosine with this one is at least the threshold and that share a bucket with it.
    component_id: the smallest id reachable by links, itself included. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; nor do vectors of different lengths. Repeated rows are linked like others;
    rows with one id and different vectors are separate vectors. Further columns are ignored; an empty table gives no rows.
    Equal vectors are told by 128 bits of hashes. k: cells of a bucket, by default from the number of distinct vectors.
    """
    parts = partitions(vectors.sparkSession)
    number = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    x = F.transform(F.col(vector_col), lambda v: v.cast(number))
    fit = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(fit, x).alias("v"))
    rows = rows.select("id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("h2"))
    classes = rows.where("v is not null").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    k, tables = shape(classes.count(), threshold, k, width, miss)
    limit = sketch_limit(threshold)

    def hashed(batches):
        for batch in batches:
            keys, sketch = np.zeros((batch.num_rows, tables), np.int32), np.zeros((batch.num_rows, len(WORDS)), np.uint64)
            for own, v in matrices(batch.column("v")):
                keys[own], sketch[own] = bucket_keys(v, k, tables, width), sketches(v)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("dim"), lists, *map(pa.array, sketch.T.copy().view(np.int64))], names=["cid", "dim", "keys", *WORDS])

    # the keys are kept, since another product of matrices can round a projection into the next cell
    keyed = cut(classes.select("cid", F.size("v").alias("dim"), "v").mapInArrow(hashed, "cid long, dim int, keys array<int>, " + ", ".join(f"{w} long" for w in WORDS)), "vector-keys")
    met = keyed.select("cid", "dim", *WORDS, F.posexplode("keys").alias("t", "bucket"))
    large = cut(met.groupBy("t", "bucket", "dim").count().where(F.col("count") > BLOCK), "large-buckets")
    blocks = F.coalesce(F.ceil(F.col("count") / BLOCK).cast("int"), F.lit(1))
    placed = met.join(large, ["t", "bucket", "dim"], "left").select("t", "bucket", "dim", "cid", *WORDS, F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.select("t", "bucket", "dim", "cid", *WORDS, "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    group = ["t", "bucket", "dim", "bi", "bj"]

    def sift(batches):
        for (_, _, _, bi, bj), g in groups(batches, group):
            if g.num_rows > 1:
                own = g["own"].to_numpy()
                some = plausible(np.stack([g[w].to_numpy() for w in WORDS], axis=1).view(np.uint64), own, bi != bj, limit)
                if some.any():
                    yield from g.select([*group, "cid", "own"]).filter(pa.array(some)).to_batches()

    likely = cut(placed.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(sift, "t int, bucket int, dim int, bi int, bj int, cid long, own int"), "likely-vectors")
    dealt = likely.join(classes.select("cid", "n", "v"), "cid").join(keyed.select("cid", "keys"), "cid")

    def links(batches):
        for (t, _, _, bi, bj), g in groups(batches, group):
            cid, own = g["cid"].to_numpy(), g["own"].to_numpy()
            ((_, v),) = matrices(g["v"].combine_chunks())
            near = v @ v.T >= threshold
            np.fill_diagonal(near, False)
            if bi != bj:
                near &= own[:, None] != own[None, :]
            if near.any():
                weight, forest = compare(t, near, g["keys"].combine_chunks().flatten().to_numpy().reshape(-1, tables), g["n"].to_numpy())
                some = np.flatnonzero(weight)
                a = np.concatenate((cid[some], cid[[f[0] for f in forest]]))
                b = np.concatenate((np.full(len(some), -1), cid[[f[1] for f in forest]]))
                w = np.concatenate((weight[some], np.zeros(len(forest), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(w)], names=["a", "b", "weight"])

    found = cut(dealt.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(links, "a long, b long, weight long"), "vector-links")
    weights = found.where("b = -1").groupBy("a").agg(F.sum("weight").alias("weight"))
    joined = components(found.where("b >= 0").select("a", "b"))
    state = classes.select("cid", "h1", "h2", "n", "least").join(weights, F.col("cid") == weights["a"], "left").join(joined, F.col("cid") == F.col("node"), "left")
    state = cut(state.select("h1", "h2", "least", (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component")), "vector-state")
    least = state.groupBy("component").agg(F.min("least").alias("component_id"))
    state = cut(state.join(least, "component").select("h1", "h2", "n_links", "component_id"), "vector-components")
    out = rows.select("id", "h1", "h2").join(state, ["h1", "h2"], "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
