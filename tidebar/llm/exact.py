"""Exact dedup by a distributed content sort, in DataFrame operations only.

Sampled splitters range-partition the rows by (leading bytes, hash, salt); each partition is sorted externally by the
whole normalised bytes, so equal texts are neighbours and are compared in full. A text that holds more rows than a
partition's fair share is salted over several ranges; its pieces are merged by one small row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, partitions

#: Only these letters are folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text):
    """Text with A-Z lower-cased and nothing else changed; null as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with keep_id (largest id of the group), group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Exactly one row of a group is kept:
    that with the largest id (nulls last; of repeated ids any one). Columns of docs that bear the names of the added
    ones are replaced. An empty table gives no rows.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    parts = partitions(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    norm = fold(F.col("row")[text_col])
    rows = docs.select(row).select("row", F.col("row")[id_col].alias("id"), F.xxhash64(norm).alias("h"))
    fair = max(16, docs.count() // (4 * parts))  # at most 4 * parts texts can have more rows: a proven bound for the broadcasts
    hot = cut(rows.groupBy("h").count().where(F.col("count") > fair).select("h", F.ceil(F.col("count") / fair).cast("int").alias("pieces")), "hot-texts")
    whole = rows.join(F.broadcast(hot), "h").groupBy(F.sha2(norm, 256).alias("sha")).agg(F.max("id").alias("all_keep"), F.count(F.lit(1)).alias("all_size"))
    rows = rows.join(F.broadcast(hot), "h", "left").select("row", "id", "h", F.pmod(F.xxhash64("id", F.lit(7)), F.coalesce("pieces", F.lit(1))).alias("salt"), fold(F.substring(F.col("row")[text_col], 1, 12)).alias("lead"))
    dealt = rows.repartitionByRange(parts, "lead", "h", "salt").withColumn("norm", norm)
    same = Window.partitionBy("lead", "h", "salt", "norm")
    found = dealt.select(
        "row", "id", F.sha2("norm", 256).alias("sha"),
        F.max("id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"),
        F.row_number().over(same.orderBy(F.col("id").desc_nulls_last())).alias("rn"),
    ).join(F.broadcast(cut(whole, "hot-groups")), "sha", "left")
    keep, size = F.when(F.col("all_size").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")), F.coalesce("all_size", "group_size")
    first = (F.col("rn") == 1) & F.col("id").eqNullSafe(keep)
    return found.select("row.*", keep.alias("keep_id"), size.alias("group_size"), first.alias("kept"), F.col("sha").alias("text_sha256"))
