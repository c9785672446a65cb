"""Shared folder and lineage cuts for the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_MADE: list[list[str]] = []  # tables cut in each settled() that is under way


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; where unset, on a single machine, an own one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tidebar-"))
        base = _OWN[0]
    return base.rstrip("/") + "/tidebar"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lost executor costs no recomputation before this point."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    for made in _MADE:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """cut(make(), name), after which the tables that make() has cut are deleted: none but the result may be in use."""
    _MADE.append([])
    try:
        df = make()
        made = list(_MADE[-1])
        out = cut(df, name)
    finally:
        _MADE.pop()
    drop(spark, made)
    return out


def drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def joined_by(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, share: int = 1000) -> DataFrame:
    """rows joined from the left with a table that has one row for each key, and in `weight` the number of rows with it.

    Keys that more than one in `share` of all `total` rows have, at most `share` of them, are broadcast; the rest is shuffled
    by key without their rows, so that no task gets a hot key. Keys aren't null.
    """
    hot = F.broadcast(table.where(F.col(weight) * share > total))
    rest = rows.join(F.broadcast(table.where(F.col(weight) * share > total).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.where(F.col(weight) * share <= total), key, "left"))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches, column: str = "text", most: int = 1 << 22):
    """The rows of Arrow batches in slices of about `most` bytes of text, so that a worker holds the results of few texts at a time."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        edges = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
