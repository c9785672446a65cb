"""Packing by Karmarkar-Karp multiway differencing.

A document's ids are cut at multiples of the capacity; full pieces are sequences of their own. What is left of each is cut
at quarters of the capacity, since differencing levels windows of a few pieces only roughly, and dealt into shards of
bounded size; in each, differencing repeatedly merges the two partial partitions with the largest imbalances,
largest windows against smallest, into near-equal windows. While a window exceeds the capacity, the shard is packed
again with more windows.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, slices
from .tokens import chunk_ids

SHARD_WINDOWS = 256
SHARD_PIECES = 1 << 16  # many short pieces make further shards, so that a task's memory is bounded in pieces too
FULL = 1 << 60  # sequence ids of full pieces start here


def difference(lengths: np.ndarray, k: int) -> list[list[int]]:
    """Indices of the lengths in k windows of near-equal sums.

    A partial partition keeps its non-empty windows alone: their negated sums in ascending order, and beside each a node,
    an index of the lengths or a pair of nodes. So merging one length costs no more than finding its place.
    """
    order, size = np.argsort(-lengths, kind="stable").tolist(), lengths.tolist()
    heap = [(-size[i], n, [-size[i]], [i]) for n, i in enumerate(order)]  # ascending, and so a heap
    turn = len(heap)
    while len(heap) > 1:
        _, _, s1, n1 = heapq.heappop(heap)
        _, _, s2, n2 = heap[0]
        if len(s1) < len(s2):
            s1, n1, s2, n2 = s2, n2, s1, n1
        over = len(s1) + len(s2) - k
        if len(s2) == 1 and over <= 1:
            x, node = s2[0], n2[0]
            if over == 1:  # all windows are taken: the least one gets it
                x, node = x + s1.pop(), (n1.pop(), node)
            at = bisect.bisect(s1, x)
            s1.insert(at, x)
            n1.insert(at, node)
        else:
            free = min(len(s1), k - len(s2))  # the largest windows of one side meet empty ones of the other
            rest = len(s2) - max(0, over)
            joined = [(s1[j] + s2[k - 1 - j], (n1[j], n2[k - 1 - j])) for j in range(free, len(s1))]
            both = sorted([*joined, *zip(s1[:free], n1[:free], strict=True), *zip(s2[:rest], n2[:rest], strict=True)], key=itemgetter(0))
            s1, n1 = [s for s, _ in both], [n for _, n in both]
        heapq.heapreplace(heap, (s1[0] - (s1[-1] if len(s1) == k else 0), turn, s1, n1))
        turn += 1
    return [_leaves(node) for node in heap[0][3]] if heap else []


def _leaves(node) -> list[int]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += x
        else:
            out.append(x)
    return out


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`; as few as differencing reaches."""
    k = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        windows = difference(lengths, k)
        if max(int(lengths[w].sum()) for w in windows) <= capacity:
            return windows
        k += 1


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, then quarters of one."""
    full, quarter = n - n % capacity, max(1, capacity // 4)
    return [(a, capacity) for a in range(0, full, capacity)] + [(a, min(quarter, n - a)) for a in range(full, n, quarter)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) per piece; null text has the end id alone."""

    def cut_ids(batches):
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            table = chunk_ids(tokenizer)
            rows = []
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = table.encode(text) + end
                for a, n in cut_points(len(data) // 4, capacity):
                    part = data[4 * a : 4 * (a + n)]
                    rows.append((id_, a, n, zlib.crc32(part), len(data) // 4, np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [batch.schema.field("id").type, *[pa.int64()] * 4, pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    id_type = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut_ids, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>")
    return out.withColumnRenamed("id", id_col) if with_ids else out.drop("ids").withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece, with sequence_id and offset: pieces lie gapless from 0 in sequences of at most `capacity` ids.

    Every id of every row lies in exactly one piece; a null or empty text is its end id; repeated rows and ids are
    packed each; further columns are ignored; an empty table gives no rows. Offsets follow the pieces' order in a window.
    """
    spark = docs.sparkSession
    found = cut(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids).withColumnRenamed(id_col, "id"), "pieces").withColumn("row", F.monotonically_increasing_id())
    full = found.where(F.col("length") == capacity).withColumn("sequence_id", F.lit(FULL) + F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    rest = found.where(F.col("length") < capacity)
    total, count = rest.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, round(total / (SHARD_WINDOWS * capacity)), count // SHARD_PIECES)
    slots = rest.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=False, ignore_index=True)
        length, shard = rows["length"].to_numpy(), int(rows["shard"].iloc[0])
        window, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for w, members in enumerate(pack(length, capacity)):
            window[members], offset[members] = w, np.cumsum(length[members]) - length[members]
        return pd.DataFrame({"row": rows["row"], "sequence_id": (shard << 20) + window, "offset": offset})

    placed = slots.groupBy("shard").applyInPandas(pack_shard, "row long, sequence_id long, offset long")
    return full.unionByName(rest.join(cut(placed, "windows"), "row")).drop("row").withColumnRenamed("id", id_col)
