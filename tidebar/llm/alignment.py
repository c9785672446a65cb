"""Cross-tokenizer alignment by interval coalescing.

All tokens of both tokenizers are byte intervals of one text. Sorted by start, with the running maximum of their ends, they
fall into groups that break where a start reaches that maximum: there both tokenizations end a token. Within a group every
token is expanded to the tokens of the other side that it overlaps; those of them that end together are links.

Texts are cut at places where neither tokenizer can join what stands on both sides, so each distinct chunk of a block of
documents is encoded and aligned once, all new ones of a batch together. Counts of linked id pairs over the corpus meet the
documents by blocks: a block of about BLOCK bytes of text asks for each of its distinct pairs once and gets their counts
back in one row, whose size is bounded by the block's text; documents themselves are rows of chunk numbers by then.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, partitions, slices
from .tokens import PUNCTUATION, WHITE, byte_letters

BLOCK = 1 << 23  # bytes of text
AT_ONCE = 1 << 13  # chunks that are encoded and aligned together
ROWS = 1 << 10  # documents that are summed together


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of both sides, numbered from 0 by place; no token is empty."""
    start, end = np.concatenate((a_start, b_start)), np.concatenate((a_end, b_end))
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(a_start)], group[len(a_start) :]


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (token of A, token of B) that share a byte; each side is sorted and without overlaps of its own."""
    lo, hi = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = hi - lo
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class Pair:
    """Two tokenizers: byte-level A from a tokenizers file, B from a sentencepiece model with bytes for what it doesn't know."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letter = {c: k for k, c in enumerate(byte_letters())}
        special = {x.content for x in self.a.get_added_tokens_decoder().values() if x.special}
        entries = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=True).items())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        of_a = {i: bytes(map(letter.__getitem__, t)) if t not in special and all(c in letter for c in t) else t.encode() for i, t in entries}
        self.bytes = ([of_a.get(i, b"") for i in range(max(of_a) + 1)], [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.sizes = tuple(np.array([len(x) for x in table], np.int64) for table in self.bytes)
        # ids in decimal, within a group and at the end of its side
        self.marks = tuple(tuple(np.array([f"{i}{mark}" for i in range(len(table))], object) for mark in (",", end)) for table, end in zip(self.bytes, "|;", strict=True))
        # B joins nothing across a blank that follows another character, a line break, or a letter before punctuation,
        # as no piece of its vocabulary holds these; A never does
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        letters = not any(re.search(f"[A-Za-z][{PUNCTUATION}]", p) for p in plain)
        if any(re.search("[^▁]▁", p) or "\n" in p for p in plain):
            self.find = None
        else:
            held = "".join(c for c in WHITE if c != " " and any(c in p for p in plain))
            word = f"(?:[^{WHITE}]*[A-Za-z](?=[{PUNCTUATION}])|[^{WHITE}]+)" if letters else f"[^{WHITE}]+"
            more = f"(?:[{held}][{WHITE}]*{word}?)*" if held else ""
            self.find = re.compile(f"[{WHITE}]+{word}?{more}|{word}{more}").findall

    def chunks(self, text: str) -> list[str]:
        return self.find(text) if self.find else [text]

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of chunks of texts that begin with a blank."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        # B puts a blank first; behind a line break no piece can take it up, so both are cut off again
        own = [c[:1] == " " for c in chunks]
        b = self.b.encode([c[1:] if blank else f"\n{c}" for c, blank in zip(chunks, own, strict=True)], num_threads=1)
        return a, [ids if blank else ids[2:] for ids, blank in zip(b, own, strict=True)]


class Aligned(dict):
    """chunk -> number; what is known of each numbered chunk of one block."""

    def __init__(self, pair: Pair):
        super().__init__()
        self.pair = pair
        self.new: list[str] = []  # numbered, but not aligned yet
        self.text: list[str] = []  # groups, as `a1,a2|b1;a3|b2,b3`
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links
        self.links: list[np.ndarray] = []  # id of A << 32 | id of B, chunk by chunk
        self.wrong: set[int] = set()  # chunks whose bytes one side doesn't give back

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        n = self[chunk] = len(self)
        return n

    def settle(self) -> None:
        """Align what is new, some thousands of chunks at once."""
        for lo in range(0, len(self.new), AT_ONCE):
            self.add(self.new[lo : lo + AT_ONCE])
        self.new = []

    def add(self, chunks: list[str]) -> None:
        pair, ids = self.pair, self.pair.encode([*chunks])
        data = [c.encode() for c in chunks]
        want = np.fromiter(map(len, data), np.int64, len(data))
        for _ in range(2):
            flat = [np.fromiter(chain.from_iterable(x), np.int64) for x in ids]
            n = [np.fromiter(map(len, x), np.int64, len(x)) for x in ids]
            owner = [np.repeat(np.arange(len(chunks)), k) for k in n]
            lengths = [np.bincount(o, weights=size[f], minlength=len(chunks)).astype(np.int64) for o, size, f in zip(owner, pair.sizes, flat, strict=True)]
            if all((k == want).all() for k in lengths) and all(b"".join(map(table.__getitem__, f.tolist())) == b"".join(data) for table, f in zip(pair.bytes, flat, strict=True)):
                break
            for k, (d, *both) in enumerate(zip(data, *ids, strict=True)):
                if any(b"".join(map(table.__getitem__, x)) != d for table, x in zip(pair.bytes, both, strict=True)):
                    self.wrong.add(len(self.text) + k)
                    ids[0][k], ids[1][k], data[k], want[k] = [], [], b"", 0
        # the chunks stand behind each other in one long text
        end_a, end_b = (np.cumsum(size[f]) for size, f in zip(pair.sizes, flat, strict=True))
        start_a, start_b = end_a - pair.sizes[0][flat[0]], end_b - pair.sizes[1][flat[1]]
        group_a, group_b = coalesce(start_a, end_a, start_b, end_b)
        first, second = overlaps(start_a, end_a, start_b, end_b)
        together = end_a[first] == end_b[second]
        first, second = first[together], second[together]
        n_links = np.bincount(owner[0][first], minlength=len(chunks))
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        n_groups = np.bincount(owner[0][last_a], minlength=len(chunks))
        (inner_a, end_of_a), (inner_b, end_of_b) = pair.marks
        pieces = np.concatenate((np.where(last_a, end_of_a[flat[0]], inner_a[flat[0]]), np.where(last_b, end_of_b[flat[1]], inner_b[flat[1]])))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        pieces, upto = pieces[order].tolist(), np.concatenate(([0], np.cumsum(n[0] + n[1]))).tolist()
        self.text += ["".join(pieces[p:q])[:-1] for p, q in zip(upto[:-1], upto[1:], strict=True)]
        self.sizes = np.concatenate((self.sizes, np.stack((n[0], n[1], n_groups, n_links), axis=1)))
        self.links.append(flat[0][first] << 32 | flat[1][second])

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The chunk numbers of each text; a text of which a chunk is wrong is a chunk of its own."""
        out = [np.fromiter(map(self.__getitem__, cs), np.int64, len(cs)) for cs in map(self.pair.chunks, texts)]
        self.settle()
        if self.wrong:
            for k, x in enumerate(out):
                if not self.wrong.isdisjoint(x.tolist()):
                    out[k] = np.array([self[texts[k]]])
            self.settle()
        return out


COLUMNS = "block long, kind int, n_a long, n_b long, n_groups long, n_links long, sha string, chunks array<int>, times array<int>, pairs array<long>, counts array<long>, links array<int>, link_sizes array<int>"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
_KINDS = {c.split(" ")[0]: _TYPES[c.split(" ")[1]] for c in COLUMNS.split(", ")}


def _batch(n: int, more: dict) -> pa.RecordBatch:
    """n rows of COLUMNS and further ones; what isn't given is null."""
    columns = {k: pa.nulls(n, t) for k, t in _KINDS.items()} | more
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, _KINDS[k]) for k, c in columns.items()], names=list(columns))


def _encoded(path_a: str, path_b: str, with_groups: bool):
    """Batches (id, text) -> a row per document (kind 1) and per block (kind 0: pairs and their counts in the block, and the links of each chunk)."""

    def table(block: int, held: Aligned, used: np.ndarray, id_type: pa.DataType) -> pa.RecordBatch:
        pairs, link = np.unique(np.concatenate([np.zeros(0, np.int64), *held.links]), return_inverse=True)
        sizes = held.sizes[:, 3]
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, link, np.repeat(used, sizes))
        return _batch(1, {"id": pa.nulls(1, id_type), "groups": pa.nulls(1, pa.string()), "block": [block], "kind": [0], "pairs": [pairs], "counts": [counts], "links": [link.astype(np.int32)], "link_sizes": [sizes.astype(np.int32)]})

    def run(batches):
        pair, number, held, used, size = Pair(path_a, path_b), 0, None, np.zeros(0, np.int64), 0
        partition = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            if held is None:
                held, used, size = Aligned(pair), np.zeros(0, np.int64), 0
            texts = batch.column("text").to_pylist()
            some = [k for k, t in enumerate(texts) if t]
            found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
            for k, x in zip(some, held.numbers([f" {texts[k]}" for k in some]), strict=True):
                found[k] = x[:0] if int(x[0]) in held.wrong else x
                size += len(texts[k])
            used = np.concatenate((used, np.zeros(len(held) - len(used), np.int64)))
            chunks, times, sums, shas, whole = [], [], np.zeros((len(texts), 4), np.int64), [], []
            for k, x in enumerate(found):
                own, n = np.unique(x, return_counts=True)
                np.add.at(used, own, n)
                chunks.append(own.astype(np.int32))
                times.append(n.astype(np.int32))
                sums[k] = (held.sizes[own] * n[:, None]).sum(axis=0)
                line = ";".join(map(held.text.__getitem__, x.tolist()))
                shas.append(hashlib.sha256(line.encode()).hexdigest() if len(x) else "")
                whole.append(line if with_groups else None)
            yield _batch(len(texts), {"id": batch.column("id"), "groups": pa.array(whole, pa.string()), "block": [partition + number] * len(texts), "kind": [1] * len(texts), **dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums.T, strict=True)), "sha": shas, "chunks": chunks, "times": times})
            if size >= BLOCK:
                yield table(partition + number, held, used, batch.column("id").type)
                held, number = None, number + 1
        if held is not None:
            yield table(partition + number, held, used, batch.column("id").type)

    return run


def _of_chunks(answer: pa.RecordBatch | None, own: pa.RecordBatch) -> list[np.ndarray]:
    """For each chunk of a block: how many of its links are the most frequent of their B id, and the sum of its links' counts."""
    edges = np.concatenate(([0], np.cumsum(own["link_sizes"][0].values.to_numpy(), dtype=np.int64)))
    link, out = own["links"][0].values.to_numpy(), []
    for name in ("best", "counts"):
        value = answer[name][0].values.to_numpy() if answer is not None else np.zeros(0, np.int64)
        upto = np.concatenate(([0], np.cumsum(value[link], dtype=np.int64)))
        out.append(upto[edges[1:]] - upto[edges[:-1]])
    return out


def _summed(batches):
    """Rows sorted by block and kind (-1: the pairs' counts in the corpus) -> (row, n_best, count_sum) of each document.

    A block's first two rows give what each of its chunks adds; its documents then pass by, some at a time.
    """
    answer, of_chunk = None, []
    for batch in batches:
        kind = batch["kind"].to_numpy()
        first = np.flatnonzero((kind < 1) | (np.diff(kind, prepend=-9) != 0)).tolist()
        for lo, hi in zip(first, [*first[1:], len(kind)], strict=True):
            if kind[lo] == -1:
                answer = batch.slice(lo, 1)
            elif kind[lo] == 0:
                answer, of_chunk = None, _of_chunks(answer, batch.slice(lo, 1))
            else:
                for k in range(lo, hi, ROWS):
                    rows = batch.slice(k, min(ROWS, hi - k))
                    own, times, out = rows["chunks"].flatten().to_numpy(), rows["times"].flatten().to_numpy(), []
                    at = rows["chunks"].offsets.to_numpy().astype(np.int64)
                    for x in of_chunk:
                        of_row = np.concatenate(([0], np.cumsum(x[own] * times)))
                        out.append(np.diff(of_row[at - at[0]]))
                    yield pa.RecordBatch.from_arrays([rows["row"], *map(pa.array, out)], names=["row", "n_best", "count_sum"])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """All rows as (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups).

    A encodes a blank and the text, B the text, to which it adds the blank. groups: ids in decimal, `a1,a2|b1;a3|b2,b3`, on
    request (null otherwise; its SHA-256 is always given). links: pairs of tokens that end together; an id pair's count is
    that of its links in all documents; n_best: links whose count no other pair with the same id of B exceeds.

    Null and empty texts, and texts whose bytes one of the tokenizers doesn't give back, have no tokens: zeros and empty
    strings. Strings of special tokens are plain text. Repeated rows, and rows with null ids, are documents each. Further
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(text.dtypes)["id"]
    encoded = cut(text.mapInArrow(_encoded(path_a, path_b, with_groups), f"{COLUMNS}, id {kind}, groups string").withColumn("row", F.monotonically_increasing_id()), "aligned")
    asked = encoded.where("kind = 0").select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = cut(counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND((1 << 32) - 1)))), "pair-counts")
    answers = asked.select("block", "pair").join(counts, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("x"))
    answers = answers.select("block", F.lit(-1).alias("kind"), F.transform("x", lambda x: x["count"]).alias("counts"), F.transform("x", lambda x: x["best"].cast("long")).alias("best"))
    asks = encoded.select("block", "kind", "row", "chunks", "times", "links", "link_sizes")
    met = asks.unionByName(answers, allowMissingColumns=True).repartition(partitions(spark), "block").sortWithinPartitions("block", "kind", "row")
    found = met.mapInArrow(_summed, "row long, n_best long, count_sum long")
    out = encoded.where("kind = 1").join(found, "row")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("sha").alias("groups_sha256"), "groups")
