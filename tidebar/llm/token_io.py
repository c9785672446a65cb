"""Token-id files: Simple-8b word-aligned coding.

A file is a folder of Parquet parts whose rows are blocks of whole documents in ascending id order. A block's payload:
magic, counts, the documents' token counts and the ids, both as Simple-8b words. A word is 64 bits: a selector in the top
four, 60 bits of ids below. Selector 0 is an escape: the next word is one raw 64-bit value. Blocks decode on their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions, slices
from .tokens import byte_level_ids, chunk_ids

#: Fixed values, by selector: ids per word, bits per id.
COUNTS = np.array([1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MAGIC = b"S8B1"
BLOCK_IDS = 65536


def encode(ids: np.ndarray) -> np.ndarray:
    """Words of the ids (any unsigned 64-bit numbers)."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8")
    choice = np.zeros(n, np.int8)
    # the first selector with room for an id, less one, and its maximum over the next `reach` ids; none are left after the last
    level = np.zeros(n + 240, np.uint8)
    for bits in BITS[1:].tolist():
        level[:n] += ids >> np.uint64(bits) > 0
    reach, widest = 1, {}
    for count in (*range(1, 9), 10, 12, 15, 20, 30, 60, 120, 240):
        level = np.maximum(level[: len(level) - (count - reach)], level[count - reach :])
        reach = count
        widest[count] = level[:n]
    for sel in range(15, 0, -1):  # from the fewest ids a word to the most: the last that fits stays
        choice[widest[COUNTS[sel]] < sel] = sel
    step = COUNTS[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    sel = choice[at]
    size = 1 + (sel == 0)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    padded = np.concatenate((ids, np.zeros(240, np.uint64)))
    words[place[sel == 0] + 1] = ids[at[sel == 0]]
    for s in np.unique(sel[sel > 0]).tolist():
        k = np.arange(COUNTS[s])
        bits = np.bitwise_or.reduce(padded[at[sel == s][:, None] + k] << (k * BITS[s]).astype(np.uint64)[None, :], axis=1) if BITS[s] else np.zeros((sel == s).sum(), np.uint64)
        words[place[sel == s]] = bits | np.uint64(s << 60)
    return words.astype("<u8")


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of the words."""
    words = np.asarray(words, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    i = 0
    for z in np.flatnonzero(sel == 0).tolist():  # a raw word is no selector word
        if z >= i:
            raw[z + 1] = True
            i = z + 2
    at, sel = np.flatnonzero(~raw), sel[~raw]
    place = np.cumsum(COUNTS[sel]) - COUNTS[sel]
    out = np.zeros(int(COUNTS[sel].sum()), np.uint64)
    out[place[sel == 0]] = words[at[sel == 0] + 1]
    for s in np.unique(sel[sel > 1]).tolist():
        k = np.arange(COUNTS[s])
        out[place[sel == s][:, None] + k] = (words[at[sel == s]][:, None] >> (k * BITS[s]).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
    return out[:n]


def to_payload(counts: list[int], ids: np.ndarray) -> bytes:
    lengths = encode(np.array(counts, np.uint64))
    return MAGIC + np.array([len(counts), len(lengths), len(ids)], "<u4").tobytes() + lengths.tobytes() + encode(ids).tobytes()


def from_payload(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The documents' token counts, and all ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, words, n = np.frombuffer(data, "<u4", 3, 4).tolist()
    body = np.frombuffer(data, "<u8", offset=16)
    return decode(body[:words], docs).astype(np.int64), decode(body[words:], n)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, add end_id, and write the ids in ascending id order (null ids first, ties by text).

    Null text counts as empty; repeated rows are written each; further columns are ignored.
    """

    def encoded(texts):
        table = chunk_ids(tokenizer)
        if table.byte_level:
            return byte_level_ids(tokenizer).encode(texts)
        found = [np.frombuffer(table.encode(t), "<u4") for t in texts.to_pylist()]
        return np.concatenate(found), np.array([len(x) for x in found])

    def blocks(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, counts, parts, held = [], [], [], 0

        def row():
            data = np.concatenate(parts)
            arrays = [[part], [number], [ids], [len(data)], [to_payload(counts, data)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, [pa.int32(), pa.int32(), pa.list_(id_kind), pa.int64(), pa.binary()], strict=True)], names=["part", "block", "ids", "n_ids", "payload"])

        for batch in slices(batches):
            id_kind = batch.schema.field("id").type
            found, n = encoded(batch.column("text"))
            upto = np.cumsum(n)
            found, upto = np.insert(found, upto, end_id), upto + np.arange(1, len(n) + 1)
            for id_, a, b in zip(batch.column("id").to_pylist(), [0, *upto[:-1].tolist()], upto.tolist(), strict=True):
                ids.append(id_)
                counts.append(b - a)
                parts.append(found[a:b])
                held += b - a
                if held >= BLOCK_IDS:
                    yield row()
                    ids, counts, parts, held, number = [], [], [], 0, number + 1
        if ids:
            yield row()

    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "id").sortWithinPartitions("id", "text")
    rows.mapInArrow(blocks, f"part int, block int, ids array<{id_type}>, n_ids long, payload binary").write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids binary of little-endian unsigned 32-bit) per document; start: ids of all documents before it.

    with_ids=False leaves the ids themselves null.
    """
    file = spark.read.parquet(path)
    blocks = file.select("part", "block", "n_ids")
    by_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))  # a row per part file
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    base = blocks.select("part", "block", F.coalesce(within, F.lit(0)).alias("inner")).join(by_part, "part").select("part", "block", (F.col("inner") + F.coalesce("before", F.lit(0))).alias("base"))
    id_kind = dict(file.dtypes)["ids"][6:-1]

    def documents(batches):
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for part, block, ids, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "ids", "payload")), strict=True):
                counts, all_ids = from_payload(payload)
                data, ends = all_ids.astype("<u4").tobytes(), np.cumsum(counts)
                texts = [data[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(texts)
                columns = [pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(ids, kind), pa.array(ends - counts), pa.array(counts), pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array(texts if with_ids else [None] * n, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "id", "inner_start", "n_tokens", "ids_crc32", "ids"])

    out = file.select("part", "block", "ids", "payload").mapInArrow(documents, f"part int, block int, id {id_kind}, inner_start long, n_tokens long, ids_crc32 long, ids binary")
    return out.join(base, ["part", "block"]).select("id", (F.col("base") + F.col("inner_start")).alias("start"), "n_tokens", "ids_crc32", "ids")
