"""Secret scan over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text). A ledger table records, per blob, which rule
versions have scanned it and what they found; only (blob, rule version) pairs that the ledger lacks are scanned, once
per blob however many paths hold it, and the findings are joined back to all paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, fresh_path, slices

SPAN = "array<struct<rule:string,start:int,end:int>>"


class Rule:
    """A pattern and a test of its matches; `version` changes with either."""

    def __init__(self, kind: str, pattern: str, least: int, group: int = 0, flags: int = 0):
        self.kind, self.least, self.group, self.regex = kind, least, group, re.compile(pattern, flags | re.ASCII)
        self.version = f"{kind}:{hashlib.sha256(repr((pattern, least, group, flags)).encode()).hexdigest()[:12]}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if len(m[self.group]) >= self.least]


#: The three base kinds, in their order, and further kinds that add spans.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
]
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
]
RULES = BASE + MORE


def scan(text: str, rules: list[Rule]) -> list[dict]:
    found = [(a, k, b, r.version) for k, r in enumerate(rules) for a, b in r.spans(text)]
    return [{"rule": v, "start": a, "end": b} for a, _, b, v in sorted(found)]


def _scanner(rules: list[Rule]) -> Callable:
    def scan_blobs(batches):
        by_version = {r.version: r for r in rules}
        for batch in slices(batches):
            blobs, texts, todo = (batch.column(c).to_pylist() for c in ("blob", "text", "todo"))
            found = [scan(t, [by_version[v] for v in vs]) for t, vs in zip(texts, todo, strict=True)]
            span = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(todo, pa.list_(pa.string())), pa.array(found, span)], names=["blob", "rules", "findings"])

    return scan_blobs


def secret_scan(versions: DataFrame, ledger: str | None = None, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """versions (id, text) -> (id, blob, findings array<struct<rule, start, end>>) for every row, in input multiplicity.

    ledger: path of the ledger table, made if absent and appended to; None: a new one. Null text counts as empty;
    a null id is kept. Repeated rows come back repeated; further columns are ignored; an empty table gives no rows.
    Offsets are code points, end exclusive. Findings are ordered by start, then by the order of `rules`.
    """
    spark, rules = versions.sparkSession, rules or RULES
    ledger = ledger or fresh_path(spark, "secret-ledger")
    text = F.coalesce(F.col(text_col), F.lit(""))
    paths = versions.select(F.col(id_col).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    wanted = F.array(*[F.lit(r.version) for r in rules])
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"))
    old = _read_ledger(spark, ledger)
    if old is None:
        todo = blobs.withColumn("todo", wanted)
    else:
        seen = old.select("blob", F.explode("rules").alias("r")).groupBy("blob").agg(F.collect_set("r").alias("seen"))
        todo = blobs.join(seen, "blob", "left").select("blob", "text", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
    todo.mapInArrow(_scanner(rules), f"blob binary, rules array<string>, findings {SPAN}").write.mode("append").parquet(ledger)
    current = {r.version: k for k, r in enumerate(rules)}
    order = F.create_map(*[F.lit(x) for kv in current.items() for x in kv])
    found = (
        _read_ledger(spark, ledger).select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin(list(current)))
        .groupBy("blob").agg(F.sort_array(F.collect_set(F.struct(F.col("f.start").alias("start"), order[F.col("f.rule")].alias("k"), F.col("f.end").alias("end"), F.col("f.rule").alias("rule")))).alias("s"))
        .select("blob", F.transform("s", lambda x: F.struct(x["rule"].alias("rule"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings"))
    )
    found = cut(found, "secret-findings")
    none = F.array().cast(SPAN)
    return paths.drop("text").join(found, "blob", "left").select(F.col("path").alias(id_col), "blob", F.coalesce("findings", none).alias("findings"))


def _read_ledger(spark, path: str) -> DataFrame | None:
    """The ledger at path, or None where there is none yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(f"blob binary, rules array<string>, findings {SPAN}").parquet(path)
