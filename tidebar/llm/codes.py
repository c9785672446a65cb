"""Vector code compression: product quantization in whole numbers, with a GNAT over each part's entries.

A component x becomes floor(1024 * x); a vector is cut into equal parts, and each part is coded by its nearest entry of the
part's codebook. A codebook begins with the parts of the vectors of the least ids; in each round parts are assigned, and an
entry becomes the floor of the mean of its parts. Assignments are summed inside tasks, so that a round sends one row for each
entry and task, and the codebooks (parts x entries rows) are all that the driver holds.

Nearest entries are found in a geometric near-neighbour access tree: some entries of a node are its split points, each other
entry belongs to the child of its nearest split point, and for each split point and child the tree has the least and
greatest distance between the two. Where a query's distance to a split point shows that all of a child lies farther than the
best entry so far, strictly and after rounding against elimination, that child is left out. What remains is compared by
whole squared distances, of equal ones the lower index.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, joined_by

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
SPLITS, LEAF = 16, 64  # split points of a node; entries that are compared without a further node
ROUNDING = 1e-9  # relative error granted to distances, whose squares are exact
MOST, LOW = 1 << 62, 31  # components beyond it count as it; sums are sent in two words, the lower one of so many bits


@dataclass
class Node:
    """index: entries of a leaf, or the split points; least and most: distances from split point to child."""

    index: np.ndarray
    points: np.ndarray
    least: np.ndarray | None = None
    most: np.ndarray | None = None
    children: list[Node | None] = field(default_factory=list)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, exact: whole numbers in double precision, or Python's where these are too large."""
    if a.dtype == object or b.dtype == object:
        return ((a.astype(object)[:, None, :] - b.astype(object)[None, :, :]) ** 2).sum(axis=2)
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def exact(x: np.ndarray) -> np.ndarray:
    """Which rows are so small that squared distances between them are whole numbers in double precision."""
    return np.abs(x).max(axis=1, initial=0).astype(np.float64) ** 2 * x.shape[1] < 1 << 50


def build(entries: np.ndarray, index: np.ndarray | None = None) -> Node:
    """The tree over entries, split points by farthest-first traversal."""
    index = np.arange(len(entries)) if index is None else index
    points = entries[index]
    if len(index) <= LEAF:
        return Node(index, points)
    chosen, near = [0], squared(points, points[:1])[:, 0]
    while len(chosen) < SPLITS and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(points, points[chosen[-1:]])[:, 0])
    apart = np.sqrt(squared(points[chosen], points).astype(np.float64))  # split point to entry
    owner = apart.argmin(axis=0)
    rest = np.ones(len(index), bool)
    rest[chosen] = False
    if len(chosen) == 1:  # all equal: the lowest index is nearest to everything
        return Node(index[:1], points[:1])
    node = Node(index[chosen], points[chosen], np.full((len(chosen),) * 2, np.inf), np.full((len(chosen),) * 2, -np.inf))
    for j in range(len(chosen)):
        own = rest & (owner == j)
        node.children.append(build(entries, index[own]) if own.any() else None)
        if own.any():
            node.least[:, j], node.most[:, j] = apart[:, own].min(axis=1) * (1 - ROUNDING), apart[:, own].max(axis=1) * (1 + ROUNDING)
    return node


class Search:
    """The nearest entries of a block of queries: best squared distance and index of each."""

    def __init__(self, queries: np.ndarray):
        self.queries = queries
        self.best = np.full(len(queries), np.inf)
        self.index = np.full(len(queries), np.iinfo(np.int64).max)
        self.compared = 0

    def offer(self, rows: np.ndarray, node: Node) -> np.ndarray:
        """Compare the rows with the node's entries; their squared distances."""
        d = squared(self.queries[rows], node.points)
        self.compared += d.size
        least = d.min(axis=1)
        index = np.where(d == least[:, None], node.index[None, :], np.iinfo(np.int64).max).min(axis=1)
        better = (least < self.best[rows]) | (least == self.best[rows]) & (index < self.index[rows])
        self.best[rows[better]], self.index[rows[better]] = least[better], index[better]
        return d

    def visit(self, node: Node, rows: np.ndarray) -> None:
        d = np.sqrt(self.offer(rows, node))
        if not node.children:
            return
        first = d.argmin(axis=1)
        low, high = d * (1 - ROUNDING), d * (1 + ROUNDING)
        for j, child in enumerate(node.children):  # each query's own child first, which mostly has its nearest entry
            if child is not None and len(own := rows[first == j]):
                self.visit(child, own)
        for j, child in enumerate(node.children):
            if child is not None:
                # the nearest that an entry of the child can be, by each split point
                least = np.maximum(node.least[None, :, j] - high, low - node.most[None, :, j]).max(axis=1)
                some = (first != j) & ~(least > np.sqrt(self.best[rows]) * (1 + ROUNDING))
                if some.any():
                    self.visit(child, rows[some])


def nearest(queries: np.ndarray, entries: np.ndarray, tree: Node | None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each query's nearest entry; without a tree, and for rows too large for it, entry by entry."""
    index, least = np.zeros(len(queries), np.int64), np.zeros(len(queries), object)
    fast = np.flatnonzero(exact(queries)) if tree is not None else np.zeros(0, np.int64)
    found = Search(queries[fast].astype(np.float64))
    if len(fast):
        found.visit(tree, np.arange(len(fast)))
        index[fast], least[fast] = found.index, found.best.astype(np.int64).astype(object)
    for row in np.setdiff1d(np.arange(len(queries)), fast, assume_unique=True).tolist():
        d = squared(queries[row : row + 1].astype(object), entries.astype(object))[0]
        index[row], least[row] = d.argmin(), d.min()
    return index, least


def trees(books: list[np.ndarray]) -> list[Node | None]:
    """A tree for each codebook whose entries are small enough."""
    return [build(b.astype(np.float64)) if len(b) and exact(b).all() else None for b in books]


def _part_rows(batch: pa.RecordBatch, part: int, size: int) -> np.ndarray:
    return batch.column(f"p{part}").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)


def _sums(books: list[np.ndarray]):
    """Batches of parts -> (part, entry, n, high, low): how many parts each entry has, and their sums in two words a component."""

    def run(batches):
        index, totals, counts = trees(books), [np.zeros(b.shape, object) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for part, book in enumerate(books):
                rows = _part_rows(batch, part, book.shape[1])
                own, _ = nearest(rows, book, index[part])
                counts[part] += np.bincount(own, minlength=len(book))
                for word, scale in ((rows >> LOW, 1 << LOW), (rows & ((1 << LOW) - 1), 1)):
                    some = np.zeros(book.shape, np.int64)
                    np.add.at(some, own, word)
                    totals[part] += some.astype(object) * scale
        for part, n in enumerate(counts):
            used = np.flatnonzero(n)
            high, low = ([[int(x) >> LOW for x in r] for r in totals[part][used]], [[int(x) & ((1 << LOW) - 1) for x in r] for r in totals[part][used]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(high, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))], names=["part", "entry", "n", "high", "low"])

    return run


def whole_parts(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """((id, label, p0, p1, ...): the parts of all kept vectors as whole numbers; components of a part)."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fit = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & (F.size(x) > 0) & (F.size(x) % parts == 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x")).where(fit)
    first = rows.agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", F.size("x").alias("dim"))).alias("least")).first()["least"]
    size = first["dim"] // parts if first else 1
    whole = F.transform("x", lambda v: F.when(v * SCALE >= float(MOST), F.lit(MOST)).when(v * SCALE <= -float(MOST), F.lit(-MOST)).otherwise(F.floor(v * SCALE).cast("long")))
    rows = rows.where(F.size("x") == size * parts).select("id", "label", whole.alias("w"))
    return rows.select("id", "label", *[F.slice("w", p * size + 1, size).alias(f"p{p}") for p in range(parts)]), size


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, codes array<int>, error, label_error), codebooks): a row for each kept vector.

    Dropped are vectors that are null, empty or hold null or non-finite components; so are those whose length isn't that of
    the least id's kept vector, or no multiple of `parts`. Zero vectors are vectors like others. Components beyond 2^62
    count as 2^62. error: squared distances to the entries, summed over the parts; label_error: errors summed over equal
    labels, null ones together. Sums that fit no long are null. Repeated rows are vectors each; null ids come last where
    the first codebook is chosen, of equal ids the smaller parts first. With fewer vectors than entries there are as many
    entries as vectors. Further columns are ignored; an empty table gives no rows and empty codebooks.
    """
    spark = vectors.sparkSession
    rows, size = whole_parts(vectors, id_col, vector_col, label_col, parts)
    rows = cut(rows, "vector-parts")
    names = [f"p{p}" for p in range(parts)]
    first = rows.orderBy(F.col("id").asc_nulls_last(), *names).select(*names).limit(entries).collect()
    books = [np.array([r[p] for r in first], np.int64).reshape(-1, size) for p in names]
    for _ in range(rounds if first else 0):
        sums = rows.select(*names).mapInArrow(_sums(books), "part int, entry int, n long, high array<long>, low array<long>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.array(*[F.sum(F.col(w)[k]) for k in range(size)]).alias(w) for w in ("high", "low")])
        for r in total.collect():  # at most parts x entries rows
            books[r["part"]][r["entry"]] = [((h << LOW) + low) // r["n"] for h, low in zip(r["high"], r["low"], strict=True)]

    def code(batches):
        index = trees(books)
        for batch in batches:
            found = [nearest(_part_rows(batch, p, book.shape[1]), book, index[p]) for p, book in enumerate(books)]
            codes = np.stack([own.astype(np.int32) for own, _ in found], axis=1)
            error = [int(e) if e < 1 << 63 else None for e in sum(d for _, d in found)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(list(codes), pa.list_(pa.int32())), pa.array(error, pa.int64())], names=["id", "label", "codes", "error"])

    kinds = dict(rows.dtypes)
    coded = cut(rows.mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error long"), "vector-codes")
    key = F.struct("label").alias("of")
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    known = F.count("error") == F.count(F.lit(1))
    by_label = cut(coded.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.when(known & (whole < F.lit(1 << 62).cast("decimal(38,0)") * 2), whole).cast("long").alias("label_error")), "label-errors")
    out = joined_by(coded.select("*", key), by_label, "of", "rows", coded.count())
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", "error", "label_error"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book.tolist() for x in entry).encode()).hexdigest()


_ROUND = """near{0} AS (SELECT part, id, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.part, p.id, e.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - e.x[i]) * (p.x[i] - e.x[i])))::BIGINT AS d FROM parts p JOIN book{0} e USING (part)) GROUP BY ALL)"""
_NEXT = """moved{1} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT n.part, n.entry, i, sum(p.x[i])::BIGINT AS s, count(*) AS n FROM near{0} n JOIN parts p USING (part, id), unnest(range(1, len(p.x) + 1)) t(i) GROUP BY ALL) GROUP BY ALL),
book{1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{0} b LEFT JOIN moved{1} m USING (part, entry))"""
_STEPS = ",\n".join(f"{_ROUND.format(k)},\n{_NEXT.format(k, k + 1)}" for k in range(ROUNDS))
#: The same in SQL, for vectors of one length.
ORACLE = f"""
WITH fit AS (SELECT vec_id AS id, label, list_transform(embedding, lambda v: floor(v::DOUBLE * {SCALE})::BIGINT) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS (SELECT id, part, w[part * len(w) // {PARTS} + 1 : (part + 1) * len(w) // {PARTS}] AS x FROM fit, unnest(range({PARTS})) t(part)),
ranked AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM fit),
book0 AS (SELECT part, entry, x FROM parts JOIN ranked USING (id) WHERE entry < {ENTRIES}),
{_STEPS},
{_ROUND.format(ROUNDS)},
coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY id),
hash AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM book{ROUNDS})
SELECT id AS vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN fit USING (id), hash"""
