"""Language ID with hyperdimensional profiles.

Each letter has a random +1/-1 vector; a trigram's vector binds (multiplies) its letters' vectors after permuting
(rotating) them by place; a text's vector bundles (adds) those of its trigrams, and a language's prototype bundles the
length-normalised vectors of its training texts. Prediction is by cosine with the prototypes, less their mean.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import cut, slices

DIM = 512
SYMBOLS = 64  # 0: a stretch without letters; 1-26: a-z; 27-63: all other letters, by code point
SEED = 20240611


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    table[letters] = 27 + letters % 37
    table[97:123] = np.arange(1, 27)
    return table


class Profiles:
    """Vectors of the trigrams met so far: at most SYMBOLS ** 3 of them, one byte a dimension."""

    def __init__(self, dim: int = DIM):
        letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))
        self.by_place = [np.roll(letters, shift, axis=1) for shift in (2, 1, 0)]
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.vectors = np.zeros((0, dim), np.int8)
        self.used = 0

    def trigrams(self, text: str | None) -> np.ndarray:
        """Ids of the text's trigrams over letters; a run of other characters counts as one blank."""
        s = symbol_table()[np.frombuffer(unicodedata.normalize("NFC", text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        s = np.concatenate(([0], s, [0])).astype(np.int32)
        s = s[(s != 0) | np.concatenate(([True], s[:-1] != 0))]
        return s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:] if len(s) > 2 else s[:0]

    def rows(self, ids: np.ndarray) -> np.ndarray:
        new = np.unique(ids[self.row[ids] < 0])
        if len(new):
            a, b, c = self.by_place
            while self.used + len(new) > len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.zeros((max(4096, len(self.vectors)), self.vectors.shape[1]), np.int8)))
            self.vectors[self.used : self.used + len(new)] = a[new // SYMBOLS**2] * b[new // SYMBOLS % SYMBOLS] * c[new % SYMBOLS]
            self.row[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        return self.row[ids]

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x dim) bundled vectors, and whether each text has a letter. Works on 64 texts, or one long one, at a time."""
        out, has = np.zeros((len(texts), self.by_place[0].shape[1]), np.float32), np.zeros(len(texts), bool)
        for lo in range(0, len(texts), 64):
            rows = [self.rows(self.trigrams(t)) for t in texts[lo : lo + 64]]
            used = np.unique(np.concatenate(rows)) if rows else np.zeros(0, int)
            if not len(used):
                continue
            place = np.zeros(self.used, np.int64)
            place[used] = np.arange(len(used))
            counts = np.zeros((len(rows), len(used)), np.float32)
            for k, r in enumerate(rows):
                counts[k] = np.bincount(place[r], minlength=len(used)) if len(r) else 0
                has[lo + k] = len(r) > 0
            out[lo : lo + len(rows)] = counts @ self.vectors[used].astype(np.float32)
        return out, has


@lru_cache(maxsize=2)
def profiles(dim: int) -> Profiles:
    return Profiles(dim)


def _normal(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> DataFrame:
    """Prototypes (lang, vector array<double>) from all rows with a text and a language; empty texts add nothing."""

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            v = _normal(profiles(dim).bundle(texts)[0].astype(np.float64))
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + v[np.array([x == lang for x in langs])].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(partial, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    return sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).select("lang", F.col("v.x").alias("vector"))


def language_id(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> DataFrame:
    """docs with lang_pred and score (cosine, 0 to 1), from prototypes learnt on `training`.

    `und` and 0 where the text is null or has no letter, or where no language could be learnt. The prototypes (one row
    of `dim` numbers per language) go to the driver and to each task; texts don't move. Columns of docs named
    lang_pred or score are replaced, others may have any name; rows come back in their multiplicity. Letters outside a-z
    share 37 vectors, by code point: scripts stay apart by their mixture, single letters may not.
    """
    learnt = sorted((r["lang"], r["vector"]) for r in train(training, text_col, lang_col, dim).collect())
    names = [r[0] for r in learnt]
    protos = np.array([r[1] for r in learnt], dtype=np.float32).reshape(len(names), dim)
    shared = protos.mean(axis=0) if len(names) > 1 else np.zeros(dim, np.float32)
    shared = _normal(shared)
    protos = _normal(_normal(protos) - (_normal(protos) @ shared)[:, None] * shared) if len(names) > 1 else _normal(protos)

    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def predict(batches):
        for batch in slices(batches, text_col):
            v, has = profiles(dim).bundle(batch.column(text_col).to_pylist())
            if not names:
                has[:] = False
            v = _normal(v - (v @ shared)[:, None] * shared) if len(names) > 1 else _normal(v)
            cos = v @ protos.T if names else np.zeros((len(v), 1))
            best = cos.argmax(axis=1)
            pred = [names[b] if h else "und" for b, h in zip(best, has, strict=True)]
            score = np.where(has, np.clip(cos[np.arange(len(v)), best], 0, 1), 0.0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)
