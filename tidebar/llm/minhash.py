"""MinHash near-dedup with SuperMinHash signatures.

Every shingle draws one random permutation of the signature's places and, step by step, offers (step + a random fraction)
to its next place; a place keeps the least offer. Because each shingle serves a place per step, the ranks are negatively
correlated, which lowers the estimate's variance, and drawing stops at the step after which no place can improve.
Bands of the signature make candidate buckets; candidates are verified on their full shingle sets; verified links are
grouped by union-find.

Buckets are not expanded into pairs. First, all members are compared with one member of the bucket, that which shares
buckets with most others; a member that is so for many is sent once to each block of them. Buckets whose members then still lie in several components are compared in full inside tasks,
block against block, and yield a spanning forest of their links: no link between components is lost. A block is bounded in
sets and in shingles, so a bucket of long texts is cut into more of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, groups, spanning_forest
from .shared import cut, joined_by, partitions, slices

BANDS, ROWS = 40, 5  # at similarity 0.8 all bands miss with (1 - 0.8 ** 5) ** 40 = 1e-7
CHUNK = 1 << 15
BLOCK, ITEMS = 1024, 1 << 21  # sets, and about as many shingles, compared in one task at a time against another such block
GOLDEN, M1, M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """word -> 64-bit hash; emptied when it holds `limit` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, words_of: WordHash, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of `size` words; with fewer words, the whole sequence as one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words_of.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * GOLDEN + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def superminhash(items: np.ndarray, m: int) -> np.ndarray:
    """The signature of a set of distinct 64-bit hashes: m numbers."""
    sig = np.full(m, np.inf)
    for lo in range(0, len(items), CHUNK):
        x, places = items[lo : lo + CHUNK], None
        rows = np.arange(len(x))
        for step in range(m):
            if sig.max() < step:
                break
            r = mix(x + np.uint64((step + 1) * int(GOLDEN) % 2**64))
            pick = step + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - step) >> np.uint64(32)).astype(np.int64)
            if step == 0:
                place, first = pick, pick
            else:
                if places is None:
                    places = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
                    places[rows, first], places[:, 0] = 0, first
                place = places[rows, pick]
                places[rows, pick] = places[:, step]
                places[:, step] = place
            np.minimum.at(sig, place, step + (r >> np.uint64(32)).astype(np.float64) / 2**32)
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = sig.view(np.uint64).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        out = mix(out * GOLDEN + x[:, i])
    return out.view(np.int64)


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """docs (id, text) -> (id, sha, n, print, bands): set size, 128-bit fingerprint of the set, band keys (none for an empty set)."""

    def sign(batches):
        words_of = WordHash()
        for batch in slices(batches):
            n, prints, keys = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words_of, size)
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(superminhash(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sha"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "sha", "n", "print", "bands"])

    return docs.mapInArrow(sign, f"id {dict(docs.dtypes)['id']}, sha binary, n long, print binary, bands array<long>")


def _sets(batches, size: int) -> Iterator[pa.RecordBatch]:
    words_of = WordHash()
    for batch in slices(batches):
        sets = [shingles(t, words_of, size).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sets, pa.list_(pa.int64()))], names=["cid", "set"])


def near_sets(sets: pa.Array, percent: int) -> np.ndarray:
    """Which of the sets are similar, without the diagonal; overlaps are counted 4096 distinct items at a time."""
    flat, edges = sets.values.to_numpy(), sets.offsets.to_numpy().astype(np.int64)
    flat, size = flat[edges[0] : edges[-1]], np.diff(edges)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(flat, kind="stable")
    item = np.cumsum(np.diff(flat[order], prepend=flat[order[:1]]) != 0)
    common = np.zeros((len(size), len(size)), np.float32)
    for lo in range(0, int(item[-1]) + 1, 4096):
        a, b = np.searchsorted(item, (lo, lo + 4096))
        has = np.zeros((len(size), 4096), np.float32)
        has[owner[order[a:b]], item[a:b] - lo] = 1
        common += has @ has.T
    near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(near, False)
    return near


def _near_pivot(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, block, kind, cid, set), the pivot's first in each block -> (a, b) of the partners whose sets are similar to its."""
    for (a, _), g in groups(batches, ["a", "block"]):
        sets, cid = g["set"].combine_chunks(), g["cid"].to_numpy()
        flat, edges = sets.values.to_numpy(), sets.offsets.to_numpy().astype(np.int64)
        pivot = np.sort(flat[edges[0] : edges[1]])
        shared = pivot[np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)] == flat
        upto = np.concatenate(([0], np.cumsum(shared)))
        common, size = upto[edges[1:]] - upto[edges[:-1]], np.diff(edges)
        near = 100 * common >= percent * (len(pivot) + size - common)
        near[0] = False
        if near.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(near.sum(), a)), pa.array(cid[near])], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """All rows as (id, text_key, n_shingles, component_id, kept); text_key: the first 16 bytes of the text's SHA-256; links: Jaccard similarity of shingle sets of percent / 100 or more.

    Words are runs of other than ASCII white space, A-Z lower-cased. Null and empty texts have no shingles and are their
    own components. Rows with equal sets are linked. component_id is the smallest id of the component (a row without a
    set: its own); rows with one id and different texts are separate. kept: id = component_id. Further columns are
    ignored; an empty table gives no rows. Shingles are compared by 64-bit hashes.
    """
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.substring(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), 1, 16).alias("sha"))
    signed = cut(signatures(text, size, bands, rows), "signatures")
    classes = signed.where("n > 0").groupBy("print").agg(F.min(F.struct("id", "sha")).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes.select("print", "least.id", "least.sha", "n", "bands").withColumn("cid", F.monotonically_increasing_id()), "set-classes")
    met = classes.select("cid", "n", F.explode("bands").alias("bucket"))
    blocks = F.least(F.count(F.lit(1)), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / ITEMS))).cast("int")
    full = cut(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), blocks.alias("blocks")).where("c > 1"), "full-buckets")
    members = cut(met.join(full, "bucket"), "members")
    ranked = members.join(cut(members.groupBy("cid").agg(F.sum("c").alias("reach")), "reach"), "cid")
    first = cut(ranked.groupBy("bucket").agg(F.max(F.struct("reach", "cid", "n")).alias("p")).select("bucket", F.col("p.cid").alias("pivot"), F.col("p.n").alias("np")), "bucket-pivots")
    members = cut(members.join(first, "bucket"), "starred")
    wanted = members.select("cid").distinct().join(classes.select("cid", "id", "sha"), "cid")
    whole = text.join(wanted.withColumnRenamed("id", "wid"), text["id"].eqNullSafe(F.col("wid")) & (text["sha"] == wanted["sha"])).select("cid", "text")
    sets = cut(whole.mapInArrow(lambda b: _sets(b, size), "cid long, set array<long>").dropDuplicates(["cid"]), "sets")

    parts = partitions(docs.sparkSession)

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs (a pivot, b, na, nb) -> the links among them, found block by block of each pivot's partners."""
        likely = cut(pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "nb").distinct(), "pairs")
        count, items = F.count(F.lit(1)), F.sum("nb")
        pivots = cut(likely.groupBy("a").agg(count.alias("c"), F.ceil(F.greatest(count / BLOCK, items / ITEMS)).cast("int").alias("blocks")), "pivots")
        placed = joined_by(likely.select("a", "b"), pivots, "a", "c", likely.count()).select("a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"), F.lit(1).alias("kind"), F.col("b").alias("cid"))
        heads = pivots.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), F.col("a").alias("cid"))
        whole = placed.unionByName(heads).join(sets, "cid").repartition(parts, "a", "block").sortWithinPartitions("a", "block", "kind")
        return cut(whole.mapInArrow(lambda b: _near_pivot(b, percent), "a long, b long"), "near-links")

    star = members.where("cid <> pivot").select("pivot", "cid", "n", "np").distinct()
    links = verified(star.select(F.col("pivot").alias("a"), F.col("cid").alias("b"), F.col("np").alias("na"), F.col("n").alias("nb")))
    labels = cut(components(links), "labels")
    now = cut(members.join(labels, members["cid"] == labels["node"], "left").select("bucket", "cid", "c", "blocks", F.coalesce("component", "cid").alias("label")), "labelled")
    split = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    placed = now.where("c > 2").join(cut(split, "split-buckets"), "bucket").select("bucket", "cid", F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = cut(placed.select("bucket", "cid", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj")), "split-members")
    group = ["bucket", "bi", "bj"]

    def compare(batches):
        for (_, bi, bj), rows in groups(batches, group):
            near = near_sets(rows["set"].combine_chunks(), percent)
            own, cid = rows["own"].to_numpy(), rows["cid"].to_numpy()
            if bi != bj:
                near &= own[:, None] != own[None, :]
            pairs = np.array(spanning_forest(near), np.int64).reshape(-1, 2)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(cid[pairs[:, 0]]), pa.array(cid[pairs[:, 1]])], names=["a", "b"])

    more = placed.join(sets, "cid").repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(compare, "a long, b long")
    known = labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    labels = cut(components(known.unionByName(cut(more, "more-links"))), "labels")
    state = cut(classes.join(labels, classes["cid"] == labels["node"], "left").select("print", "id", F.coalesce("component", "cid").alias("component")), "set-components")
    least = state.groupBy("component").agg(F.min("id").alias("component_id"))
    state = cut(state.join(least, "component").select("print", "component_id"), "near-components")
    out = signed.join(state, "print", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("sha").alias("text_key"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
